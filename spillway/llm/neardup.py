"""SimHash near-duplicates found by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import only, save, table, text_hash, text_of, without
from spillway.llm.components import connected_components

BITS = 64
#: Two bits of a fingerprint to a block: a block's reference is the first one with these bits turned over.
BLOCK_BITS = 2
SHINGLES_AT_ONCE = 1 << 16


def simhash(text: str, size: int = 3) -> int:
    """64 majority bits over the XXH64 (seed 42) of the text's word shingles; 0 for no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[at : at + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, hash, fp) for each row: the text's hash, and the fingerprint's 64 bits as a signed long. A null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x, size) for x in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "hash", "fp"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_hash().alias("hash"), text_of().alias("text")).mapInArrow(work, "doc_id long, hash long, fp long")


class Pivots:
    """Reference fingerprints, and what Hamming distances to them say about a pair.

    ``refs[0]`` is a seeded random fingerprint; ``refs[1 + b]`` is the same with
    block ``b`` turned over; the last ``extra`` are random. By the triangle
    inequality a pair within ``radius`` has coordinates that nowhere differ by
    more than ``radius``. The difference between the coordinates 0 and 1 + b
    tells the distance on block b alone. At most ``radius`` blocks differ in
    it, so with the blocks in ``groups`` groups, all coordinates of some
    ``groups - radius`` groups agree: one table for each such choice, keyed by
    these coordinates, holds every pair within the radius together at least once.
    """

    def __init__(self, radius: int, groups: int, extra: int = 8, seed: int = 7):
        self.radius, blocks = radius, BITS // BLOCK_BITS
        rng = np.random.default_rng(seed)
        base, others = rng.integers(0, 2**64, dtype=np.uint64), rng.integers(0, 2**64, size=extra, dtype=np.uint64)
        masks = np.array([((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * b) for b in range(blocks)], dtype=np.uint64)
        self.refs = np.concatenate([[base], base ^ masks, others]).astype(np.uint64)
        self.blocks, self.extra = blocks, extra
        parts = np.array_split(np.arange(blocks), groups)
        self.tables = [np.concatenate([parts[g] for g in chosen]) for chosen in combinations(range(groups), groups - radius)]

    def distances(self, fps: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[:, None] ^ self.refs[None, :]).astype(np.int16)

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """A row for each fingerprint, a column for each table."""
        d = self.distances(fps)
        on_block = (BLOCK_BITS + d[:, :1] - d[:, 1 : 1 + self.blocks]) // 2
        out = np.empty((len(fps), len(self.tables)), dtype=np.int64)
        for t, blocks in enumerate(self.tables):
            key = np.full(len(fps), t, dtype=np.uint64)
            for b in blocks:
                key = key * np.uint64(BLOCK_BITS + 1) + on_block[:, b].astype(np.uint64)
            out[:, t] = (key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)).view(np.int64)  # equal keys stay equal; a chance meeting is only one more pair to verify
        return out

    def close(self, a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray) -> np.ndarray:
        """Which pairs are within the radius: first by the largest coordinate difference, then exactly."""
        maybe = (np.abs(da - db) <= self.radius).all(axis=-1)
        maybe[maybe] = np.bitwise_count((a ^ b)[maybe]) <= self.radius
        return maybe

    def spare(self, fps: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fps[:, None] ^ self.refs[None, -self.extra :]).astype(np.int8)


def _settle(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> None:
    """Join the sets of both ends of each pair. ``label`` holds each row's root, the smallest row of its set, before and after."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # the larger root, and so all of its set, goes below the smaller
        while (label[label] != label).any():
            label[:] = label[label]


def _cell_links(cell: np.ndarray, fps: np.ndarray, pivots: Pivots, long_run: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by cell: links that join what is within the radius, at most one for each row."""
    n, label, d = len(fps), np.arange(len(fps)), pivots.spare(fps)
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    lengths = np.diff(np.r_[starts, n])
    big = np.repeat(lengths > long_run, lengths)
    left, right = [], []
    for step in range(1, min(long_run, lengths.max(initial=0))):
        i = np.flatnonzero((cell[:-step] == cell[step:]) & ~big[:-step])
        if not len(i):
            break
        i = i[pivots.close(fps[i], fps[i + step], d[i], d[i + step])]
        left.append(i)
        right.append(i + step)
    if left:
        _settle(np.concatenate(left), np.concatenate(right), label)
    for start, length in zip(starts[lengths > long_run], lengths[lengths > long_run], strict=True):
        end = start + length
        for at in range(start, end, 128):
            rows = slice(at, min(at + 128, end))
            a, b = np.broadcast_arrays(fps[rows, None], fps[None, at:end])
            da, db = np.broadcast_arrays(d[rows, None, :], d[None, at:end, :])
            i, j = np.nonzero(pivots.close(a, b, da, db))
            _settle(i + at, j + at, label)
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def links(fps: DataFrame, radius: int = 2, groups: int | None = None, tile_rows: int = 20_000) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose closure holds every pair within ``radius`` bits.

    One row is dealt to a cell of each pivot table; cells are compared inside
    tasks and give no more links than they have rows, so near copies do not
    multiply. A cell of over ``tile_rows`` rows is cut into parts, and every
    two parts meet in a task of their own. ``groups`` grows with the table
    (more tables with longer keys), which changes the work and not the result.
    """
    spark = fps.sparkSession
    if groups is None:
        n = fps.count()
        groups = radius + 1 + (n > 1 << 24) + (n > 1 << 32)
    pivots = Pivots(radius, groups)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            keys = pivots.keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(own, keys.shape[1]))], names=["cell", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(cell: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            a, b = _cell_links(cell, own.view(np.uint64), pivots)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            if held[0][0][0] == held[-1][0][-1]:
                continue
            cell, own = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.flatnonzero(cell != cell[-1])[-1]) + 1
            yield out(cell[:cut], own[:cut])
            held = [(cell[cut:], own[cut:])]
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = only(fps, "fp").mapInArrow(deal, "cell long, fp long")
    hot = dealt.groupBy("cell").count().where(F.col("count") > tile_rows).select("cell", F.ceil(F.col("count") / tile_rows).alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.xxhash64("cell", F.least(own, j), F.greatest(own, j)))
    tiled = dealt.join(hot, "cell", "left").select(F.explode(F.when(F.col("parts").isNull(), F.array("cell")).otherwise(tiles)).alias("cell"), "fp")
    return tiled.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def _rooted(docs: DataFrame, radius: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of ``docs`` and, for each distinct one, root (of its component) and least (its smallest doc_id)."""
    fps = save(fingerprints(docs, size), "fingerprints")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = save(links(firsts.select("fp"), radius), "links")
    roots = connected_components(edges)
    known = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return fps, save(known, "roots")


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fp, component_id.

    component_id is the smallest doc_id among all rows that links of at most
    ``radius`` differing bits reach. Rows without words share fingerprint 0.
    A null doc_id keeps its row; it is the id of a component only when that has
    no other. Rows that repeat a doc_id are separate rows. Long texts are read
    whole. Other columns of ``docs`` are not read. Empty tables give empty results.
    """
    fps, known = _rooted(docs, radius, size)
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    mapped = known.join(ids, "root").select("fp", "component_id")
    return fps.join(mapped, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3) -> DataFrame:
    """``docs``, all columns, with one row for each component: that of the smallest doc_id (null ones last), then of the smallest text hash.

    Rows that share both doc_id and text are told apart by nothing; one of them stays
    if theirs is the row that does.
    """
    fps, known = _rooted(docs, radius, size)
    rows = fps.join(known.select("fp", "root"), "fp").select("root", "doc_id", "hash")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("_id"), F.col("first.hash").alias("_hash"))
    every = rows.groupBy("doc_id", "hash").count()
    judged = every.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    judged = save(judged.select("doc_id", "hash", F.col("_hash").isNotNull().alias("kept"), "count"), "judged")
    once = without(docs, judged.where("not kept or count > 1"))
    repeated = judged.where("kept and count > 1")
    if repeated.isEmpty():
        return once
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_own_id"), text_hash().alias("_own_hash"))
    same = F.col("_own_id").eqNullSafe(F.col("doc_id")) & (F.col("_own_hash") == F.col("hash"))
    return once.unionByName(own.join(repeated, same, "left_semi").dropDuplicates(["_own_id", "_own_hash"]).select("_row.*"))


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
