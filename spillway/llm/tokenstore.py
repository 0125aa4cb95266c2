"""A content-addressed store of token id streams.

A store is a folder of three tables. ``objects``: each distinct chunk of ids
once, under its hash. ``recipes``: a row for each document in ascending order
of doc_id with the hashes of its chunks and their Merkle root. ``manifest``: the
Merkle tree above the documents, up to one root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.llm.common import BATCH_ROWS, batches_of, new_path, only, running_total, save, table, text_of, write
from spillway.llm.tokens import encoder, in_slices

LEAST, MASK_BITS, MOST, WINDOW = 64, 8, 1024, 32
FANOUT = 1024
_GEAR = np.random.default_rng(11).integers(0, 2**32, size=1 << 17, dtype=np.uint32)


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """At each place a hash of the 32 ids up to there; older ones have been shifted out."""
    values = _GEAR[ids & np.uint32(len(_GEAR) - 1)]
    out = values.copy()
    for back in range(1, min(WINDOW, len(ids))):
        out[back:] += values[:-back] << np.uint32(back)
    return out


def marked(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: the top bits of the rolling hash are zero."""
    return np.flatnonzero(rolling_hash(ids) >> np.uint32(32 - MASK_BITS) == 0) + 1


def cut_points(marks: list[int], n: int) -> list[int]:
    """Ends of the chunks of ``n`` ids: the first mark after LEAST to MOST ids, else after MOST.

    LEAST is over WINDOW, so what stands before a document never moves its cuts.
    """
    ends, start, k = [], 0, 0
    while start < n:
        while k < len(marks) and marks[k] < start + LEAST:
            k += 1
        end = min(marks[k] if k < len(marks) else n, start + MOST, n)
        ends.append(end)
        start = end
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(hashes: list[bytes]) -> bytes:
    level = hashes or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0]


def crc_joined(crc: int, more: int, more_bytes: int) -> int:
    """The CRC-32 of two byte strings after each other, from theirs and the second's length."""
    zeros = bytes(more_bytes)
    return zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ more


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Encode all rows of ``docs`` (doc_id, text), end each with ``end_id`` and write a store under ``path``.

    Null texts count as empty: their stream is the end id. Rows that repeat a
    doc_id, and rows with a null one (they come first), are documents of their
    own. An empty table makes an empty store. Other columns are not read.
    """
    spark = docs.sparkSession

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, False).encode
        for batch in batches:
            row_ids, doc_ids, texts = (c.to_pylist() for c in batch.columns)
            seen: set[bytes] = set()
            for a, b in in_slices(texts, 1 << 23):
                out: list[tuple] = []
                ids, ends = encode(texts[a:b], end_id)
                marks, wide = marked(ids), 4 if ids.max() > 0xFFFF else 2
                data, lead, first = ids.astype(f"<u{wide}").tobytes(), bytes([wide]), 0
                for row, doc, last in zip(row_ids[a:b], doc_ids[a:b], ends.tolist(), strict=True):
                    own = (marks[np.searchsorted(marks, first, "right") : np.searchsorted(marks, last, "right")] - first).tolist()
                    start, parts, sizes = 0, [], []
                    for stop in cut_points(own, last - first):
                        chunk = lead + data[(first + start) * wide : (first + stop) * wide]
                        parts.append(name := digest(chunk))
                        sizes.append(stop - start)
                        start = stop
                        if name not in seen:
                            seen.add(name)
                            out.append(("object", name, chunk, None, None, None, None, None))
                    first = last
                    out.append(("recipe", digest(row.to_bytes(8, "little")), None, row, doc, parts, sizes, merkle_root(parts)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = pa.array([b""], pa.binary())
        for batch in batches:
            if batch.num_rows:
                hashes = batch.column(1)
                before = pa.concat_arrays([last, hashes.slice(0, len(hashes) - 1)])
                last = hashes.slice(len(hashes) - 1)
                yield batch.filter(pc.not_equal(hashes, before))

    names = ["kind", "hash", "data", "row", "doc_id", "parts", "sizes", "root"]
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
    schema = "kind string, hash binary, data binary, row long, doc_id long, parts array<binary>, sizes array<int>, root binary"
    rows = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # one row of each batch carries a chunk's ids, so a chunk that a third of all documents share is dealt out in few copies
    dealt = rows.mapInArrow(chunks, schema).repartition("hash").sortWithinPartitions("hash")
    before = batches_of(spark, 2 * BATCH_ROWS)  # more texts at once have fewer different words in all
    try:
        write(dealt.mapInArrow(once, schema), f"{path}/objects", "kind")
    finally:
        batches_of(spark, int(before))
    raw = spark.read.schema(schema).parquet(f"{path}/objects").where("kind = 'recipe'").select("row", "doc_id", "parts", "sizes", "root")
    ordered = raw.withColumn("n_tokens", F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))
    ordered = save(ordered.repartitionByRange("doc_id", "row").withColumn("block", F.spark_partition_id()), "recipes")
    started = running_total(ordered, [], [F.col("doc_id"), F.col("row")], "n_tokens", "start")
    started = started.withColumn("number", F.row_number().over(Window.partitionBy("block").orderBy("doc_id", "row")))
    write(started.drop("row").repartitionByRange("start").sortWithinPartitions("start"), f"{path}/recipes")
    write(manifest(spark.read.parquet(f"{path}/recipes")), f"{path}/manifest")


def manifest(recipes: DataFrame) -> DataFrame:
    """The Merkle tree above the documents: level, block, part, hash, n_docs, n_tokens.

    Level 1 hashes the roots of up to 1024 documents of a block in order, level
    2 those of each block, level 3 (one row; none for an empty store) all blocks.
    """

    def up(df: DataFrame, level: int, keys: list, order: str) -> DataFrame:
        inner = F.array_sort(F.collect_list(F.struct(order, "hash")))
        joined = F.sha2(F.array_join(F.transform(inner, lambda x: x["hash"]), ","), 256)
        return df.groupBy(*keys).agg(joined.alias("hash"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).withColumn("level", F.lit(level))

    docs = recipes.select("block", F.floor((F.col("number") - 1) / FANOUT).alias("part"), "number", F.hex("root").alias("hash"), F.lit(1).alias("n_docs"), "n_tokens")
    first = up(docs, 1, ["block", "part"], "number")
    second = up(first, 2, ["block"], "part")
    third = up(second, 3, [], "block").where("n_docs is not null")
    return first.unionByName(second, allowMissingColumns=True).unionByName(third, allowMissingColumns=True)


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Read a store's files and return doc_id, start, n_tokens, ids_crc32 of each document, in no order.

    Fails if a chunk is not what its name says, if a recipe names a chunk that
    is missing, if a document's chunks do not give its Merkle root, or the
    documents the manifest's. Each distinct chunk is read once; documents join
    its checksum instead of its ids, whose checksums then add up.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    tops = [df.where("level = 3").select("hash", "n_docs", "n_tokens").collect() for df in (spark.read.parquet(f"{path}/manifest"), manifest(recipes))]
    if tops[0] != tops[1]:
        raise ValueError(f"the recipes do not give the manifest's root: {tops}")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, datas = (c.to_pylist() for c in batch.columns)
            if any(digest(x) != h for h, x in zip(hashes, datas, strict=True)):
                raise ValueError("a chunk is not what its name says")
            ids = [unpack(x) for x in datas]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int32()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())], names=["hash", "n", "crc"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, starts, roots, parts = (c.to_pylist() for c in batch.columns)
            out = []
            for root, chunks in zip(roots, parts, strict=True):
                if any(x["crc"] is None for x in chunks) or merkle_root([x["hash"] for x in chunks]) != root:
                    raise ValueError("a document's chunks do not give its root")
                crc = n = 0
                for x in chunks:
                    crc, n = crc_joined(crc, x["crc"], 4 * x["n"]), n + x["n"]
                out.append((n, crc))
            counts, crcs = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    objects = _objects(spark, path).mapInArrow(checked, "hash binary, n int, crc long")
    asked = recipes.select("doc_id", "start", "root", F.posexplode("parts").alias("k", "hash"))
    found = asked.join(objects, "hash", "left").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("k", "hash", "n", "crc"))).alias("chunks"))
    return found.select("doc_id", "start", "root", "chunks").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, hash binary, data binary").parquet(f"{path}/objects").where("kind = 'object'").select("hash", "data")


def unpack(chunk: bytes) -> np.ndarray:
    return np.frombuffer(chunk, dtype=f"<u{chunk[0]}", offset=1).astype("<u4")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (array) of each document of a store, put together from its chunks."""

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2).to_pylist()
            ids = pa.array([np.concatenate([unpack(x["data"]) for x in chunks]).astype(np.int64) for chunks in parts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["doc_id", "start", "ids"])

    recipes = spark.read.parquet(f"{path}/recipes")
    objects = _objects(spark, path)
    asked = recipes.select("doc_id", "start", F.posexplode("parts").alias("k", "hash")).join(objects, "hash")
    found = asked.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "data"))).alias("chunks"))
    return found.select("doc_id", "start", "chunks").mapInArrow(put_together, "doc_id long, start long, ids array<long>")


def op6_content_addressed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return verify_store(spark, path)
