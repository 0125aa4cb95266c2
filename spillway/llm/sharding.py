"""Shards in random order by a two-pass external shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spillway.llm.common import running_total, save, table, text_of

BUCKET_BYTES = 32 << 20


def shuffle_table(docs: DataFrame, seed: int, bucket_bytes: int = BUCKET_BYTES, size: str | None = None) -> DataFrame:
    """(row, bucket, place): ``docs``, each row as one struct, in a uniformly random order of all rows, by bucket and then place.

    Pass 1 scatters the rows over buckets by a seeded hash of their number, so
    that buckets are even whatever the rows hold, copies included. Pass 2 takes
    one bucket at a time into memory, shuffles it by Fisher-Yates and writes it.
    The seed, the input files and their splits decide the order: a task that is
    run again makes the same rows. ``size`` names a column of sizes in bytes, by
    which the number of buckets is chosen; without it a row counts 1 KB.
    """
    total = docs.agg(F.sum(F.col(size)) if size else F.count("*") * 1024).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("bucket", T.IntegerType()), T.StructField("place", T.LongType())])
    names = [f.name for f in schema.fields]
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number"))
    scattered = numbered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(buckets)).cast("int"))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and number; a bucket goes out when the next begins."""

        def out(part: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket = part.column(2)[0].as_py()
            order = np.arange(part.num_rows)
            np.random.default_rng([seed & 0xFFFFFFFF, bucket]).shuffle(order)  # Fisher-Yates
            place = pa.array(np.arange(part.num_rows))
            mixed = part.take(pa.array(order))
            made = pa.table([mixed.column(0), pa.array(np.full(part.num_rows, bucket, np.int32)), place], names=names)
            yield from made.combine_chunks().to_batches(4096)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column(2).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column(2)[0].as_py() != own[a]:
                    yield from out(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(pa.Table.from_batches(held))

    mixed = scattered.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "number").mapInArrow(permute, schema)
    return save(mixed, "shuffled")


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs``, all columns, with shard (from 0), slot (gapless from 0 in its shard) and size.

    Law ``rows``: counts of shards differ by one at most. A shard is a run of
    the shuffled order. size is the text's UTF-8 bytes (null: none) plus 1. Null
    ids and texts, repeated rows and equal texts are rows like any other; an
    empty table gives an empty result, long texts count as all others. The columns
    that this adds replace those of the same name; all others stay, whatever theirs.
    """
    own = [c for c in docs.columns if c not in ("shard", "slot", "size")]
    sized = docs.select(*[F.col(f"`{c}`") for c in own], (F.octet_length(text_of()) + 1).cast("long").alias("size"))
    mixed = shuffle_table(sized, seed, bucket_bytes, "size")
    total = mixed.count()
    counted = mixed.select("bucket").groupBy("bucket").count()
    starts = running_total(counted.withColumnRenamed("bucket", "block"), [], [F.lit(0)], "count", "first").select(F.col("block").alias("bucket"), "first")
    low, more = divmod(total, shards)
    at = F.col("first") + F.col("place")
    wide = at < more * (low + 1)
    number = F.when(wide, F.floor(at / (low + 1))).otherwise(more + F.floor((at - more * (low + 1)) / max(low, 1)))
    first = F.col("shard") * low + F.least(F.col("shard"), F.lit(more))
    out = mixed.join(F.broadcast(starts) if counted.count() <= 100_000 else starts, "bucket")
    placed = out.withColumn("shard", number.cast("int")).withColumn("slot", (at - first).cast("long"))
    return placed.select(*[F.col("row")[c].alias(c) for c in [*own, "size"]], "shard", "slot")


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.encode(text_of(), "UTF-8"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
