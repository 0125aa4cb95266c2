"""SimHash fingerprints with permuted block tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import drop_saved, only, save, table, text_of

BITS = 128
WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64)


class SimHasher:
    """Weighted term hashes vote on signed bits.

    Terms are words (lower case) and neighbouring pairs of them. A term that
    comes n times weighs 1 + ln n. A text without words votes as one empty term.
    """

    def __call__(self, text: str) -> bytes:
        words = WORD.findall(text.lower()) or [""]
        lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        pairs = (lanes[:-1] * _MIX[0]) ^ (lanes[1:] * _MIX[1])
        pairs = (pairs ^ (pairs >> np.uint64(29))) * _MIX[2]
        terms = np.concatenate([lanes, pairs ^ (pairs >> np.uint64(32))])
        _, first, counts = np.unique(terms[:, 0], return_index=True, return_counts=True)
        weights, terms = (1 + np.log(counts)).astype(np.float32), np.ascontiguousarray(terms[first])
        votes = np.zeros(BITS)
        for at in range(0, len(terms), 4096):
            bits = np.unpackbits(terms[at : at + 4096].view(np.uint8), axis=1).astype(np.float32)
            votes += weights[at : at + 4096] @ bits
        return np.packbits(2 * votes > weights.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that the share of differing bits stands for; 0 if they differ by half or more."""
    apart = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, math.cos(math.pi * apart / (8 * len(a))))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The next document is the one after it in descending doc_id (nulls last,
    equal ids by their text's hash); after the last comes the first. A null text
    counts as empty. Rows are dealt in ranges of that order; only the first
    and last row of each range are matched across ranges.
    """
    ordered = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_of().alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("row")]
    ranged = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    names = ["part", "kind", "doc_id", "text", "fingerprint", "n_chars", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.float64(), pa.float64()]
    schema = "part int, kind string, doc_id long, text string, fingerprint binary, n_chars long, edited_sha256 string, edited_fingerprint binary, near_edited double, near_next double"

    def finish(simhash: SimHasher, text: str, own: bytes, following: str, next_own: bytes) -> tuple:
        made = edited(text, following)
        other = simhash(made)
        return own, len(text), hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest(), other, likeness(own, other), likeness(own, next_own)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash, before, out = SimHasher(), None, []
        for batch in batches:
            for part, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = simhash(text)
                if before:
                    out.append((part, "done", before[0], None, *finish(simhash, before[1], before[2], text, own)))
                else:
                    out.append((part, "first", doc, text, own, None, None, None, None, None))
                before = doc, text, own
                if len(out) >= 2000:
                    yield pack(out)
                    out = []
        if before:
            out.append((part, "last", before[0], before[1], before[2], None, None, None, None, None))
            yield pack(out)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash = SimHasher()
        for batch in batches:
            rows = [(0, "done", doc, None, *finish(simhash, text, own, after, other)) for doc, text, own, after, other in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pack(rows)

    made = save(ranged.mapInArrow(work, schema), "ranges")
    firsts, lasts = made.where("kind = 'first'"), made.where("kind = 'last'")
    parts = sorted(r["part"] for r in firsts.select("part").collect())  # one number for each range
    follows = made.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next_part int")
    after = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("after"), F.col("fingerprint").alias("other"))
    seams = lasts.select("part", "doc_id", "text", "fingerprint").join(follows, "part").join(after, "next_part").select("doc_id", "text", "fingerprint", "after", "other")
    both = made.where("kind = 'done'").unionByName(seams.mapInArrow(across, schema))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return both.select("doc_id", "n_chars", "edited_sha256", hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")


def blocks_for(n: int, radius: int, bits: int = BITS) -> int:
    """Blocks that a fingerprint is cut into, so that a table's key keeps its buckets small for ``n`` fingerprints."""
    blocks = radius + 1
    while (blocks - radius) * (bits // blocks) < math.log2(max(n, 1)) - 6 and blocks < radius + 4:
        blocks += 1
    return blocks


def within_radius(fingerprints: DataFrame, queries: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """(query, fingerprint, apart): all distinct fingerprints within ``radius`` bits of each query fingerprint.

    Both tables have a column ``fingerprint`` (lower-case hex). The bits are cut
    into ``blocks`` > radius blocks; at least blocks - radius of them are equal
    in such a pair, so a table for each choice of so many blocks, permuted to
    the front as its key, finds it. Copies of a fingerprint count once.
    """
    distinct = only(fingerprints, "fingerprint").where("fingerprint is not null").distinct()
    asked = only(queries, "fingerprint").where("fingerprint is not null").distinct()
    blocks = blocks or blocks_for(distinct.count(), radius)
    edges = np.linspace(0, BITS, blocks + 1).astype(int)
    choices = list(combinations(range(blocks), blocks - radius))
    bits = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(BITS // 32)])
    block = [F.substring("_bits", int(a) + 1, int(b - a)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = F.array(*[F.xxhash64(F.lit(t), *[block[i] for i in chosen]) for t, chosen in enumerate(choices)])
    key = lambda df, name: df.withColumn("_bits", bits).select(F.col("fingerprint").alias(name), F.explode(keys).alias("key"))
    word = lambda c, i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    apart = sum((F.bit_count(word("query", i).bitwiseXOR(word("found", i))) for i in range(1, BITS // 32)), F.bit_count(word("query", 0).bitwiseXOR(word("found", 0))))
    pairs = key(asked, "query").join(key(distinct, "found"), "key").where(apart <= radius)
    return pairs.select("query", F.col("found").alias("fingerprint"), apart.alias("apart")).distinct()


def op7_simhash_fingerprints(spark: SparkSession, sf_dir: str, radius: int = 6) -> DataFrame:
    """The fingerprints, with n_near for each row whose doc_id is divisible by 100: rows within ``radius`` bits, itself included."""
    made = save(fingerprints_with_next(table(spark, sf_dir, "documents")), "fingerprints")
    asked = made.where("doc_id % 100 = 0").select("fingerprint")
    copies = made.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    near = within_radius(made, asked, radius).join(copies, "fingerprint").groupBy(F.col("query").alias("fingerprint")).agg(F.sum("copies").alias("_near"))
    out = made.join(near, "fingerprint", "left")
    return out.select(*made.columns, F.when(F.col("doc_id") % 100 == 0, F.col("_near")).alias("n_near"))
