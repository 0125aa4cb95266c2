"""Exact search for the largest inner products, by buckets of vectors of like length.

Vectors are put in order of their length and cut into buckets. A query goes
through the buckets from the longest on and keeps its best scores. What a bucket
must still beat, divided by the query's and the bucket's length, is a cosine:
over 1 it rules the bucket out; else it bounds the length of the vectors that
may count, and the range of each of their coordinates. What is left is verified
by its product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.llm.common import drop_saved, only, save, table

SCALE, EVERY, TOP = 256, 50, 5
#: A bucket ends after so many vectors, or before one of less than this share of its longest's length.
BUCKET_ROWS, LEAST_SHARE = 2048, 0.9
#: Queries that go through buckets together, and buckets to a group that is a task's own.
QUERY_ROWS, GROUP_BUCKETS = 256, 8
#: Coordinates of a query, its largest, by which vectors are tried.
FOCUS = 4
#: Lets rounding rule nothing out.
SLACK = 1e-9
_LONG = 2**63 - 1


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, length, v): ``floor(scale * x)`` of each component, and the vector's length by them.

    Null vectors are left out, and those with a component that is null or, scaled, not finite.
    """
    times = lambda x: F.lit(float(scale)) * x.cast("double")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(times(x)) & (F.abs(times(x)) < float("inf")))
    # doubles of 52 bits and more are whole, and floor() would hold them within a long
    whole = F.transform("embedding", lambda x: F.when(F.abs(times(x)) < 2.0**52, F.floor(times(x)).cast("double")).otherwise(times(x)))
    rows = only(vectors, "vec_id", "embedding").where(F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), whole.alias("v"))
    return rows.select("row", "vec_id", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("length"), "v")


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """A row for each list; shorter ones are filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


_BLOCK = "length double, rows long, ids binary, known binary, lengths binary, v binary"
_BLOCK_NAMES = ["length", "rows", "ids", "known", "lengths", "v"]


def _block(rows: np.ndarray, ids: pa.Array, lengths: np.ndarray, v: pa.ListArray) -> list:
    m = _matrix(v)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    packed = np.stack([rows, np.where(known, ids.fill_null(0).to_numpy(), 0)]).astype("<i8").tobytes()
    return [float(lengths.max()), len(rows), packed, known.tobytes(), lengths.astype("<f8").tobytes(), m.astype("<f8").tobytes()]


class Block:
    """Vectors in descending order of length."""

    def __init__(self, n: int, packed: bytes, known: bytes, lengths: bytes, v: bytes):
        self.rows, self.ids = np.frombuffer(packed, "<i8").reshape(2, n)
        self.known, self.lengths, self.v = np.frombuffer(known, bool), np.frombuffer(lengths, "<f8"), np.frombuffer(v, "<f8").reshape(n, -1)

    def wide(self, width: int) -> np.ndarray:
        return np.pad(self.v, ((0, 0), (0, max(0, width - self.v.shape[1]))))


def buckets(vectors: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each bucket. Rows are dealt by ranges of length, then id and row, so that vectors of one length are spread too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            all_rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
            for part in all_rows:
                lengths, start = part.column(2).to_numpy(), 0
                while start < len(lengths):
                    stop = min(start + rows, start + int(np.searchsorted(-lengths[start:], -LEAST_SHARE * lengths[start], "right")))
                    if stop == len(lengths) and not final:
                        break
                    one = part.slice(start, stop - start)
                    block = _block(one.column(0).to_numpy(), one.column(1), one.column(2).to_numpy(), pa.ListArray.from_arrays(*_offsets(one.column(3))))
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in block], names=_BLOCK_NAMES)
                    start = stop
                if start < len(lengths):
                    held.append(part.slice(start))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) > rows:
                    yield from cut(False)
        if held:
            yield from cut(True)

    ordered = [F.desc("length"), F.asc("vec_id"), F.asc("row")]
    return vectors.repartitionByRange(*ordered).sortWithinPartitions(*ordered).mapInArrow(work, _BLOCK)


def _offsets(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    offsets = lists.offsets.to_numpy()
    return pa.array(offsets - offsets[0]), lists.flatten()


class Best:
    """The best scores so far of a block of queries."""

    def __init__(self, queries: Block, top: int):
        self.q, self.top, n = queries, top, len(queries.rows)
        self.scores = np.full((n, top), -_LONG)
        self.ids, self.rows, self.known = np.zeros((n, top), np.int64), np.full((n, top), -1), np.zeros((n, top), bool)
        self.tried = {"ruled out": 0, "length": 0, "coordinate": 0}

    def _exact(self, p: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
        """Products of whole numbers, in doubles as long as no sum can pass 53 bits; beyond 64 bits they count as their end."""
        if bound < 2.0**52:
            return (p @ q.T).astype(np.int64)
        whole = lambda m: [[int(x) for x in row] for row in m.tolist()]
        asked = whole(q)
        return np.array([[max(-_LONG, min(_LONG, sum(map(int.__mul__, x, y)))) for y in asked] for x in whole(p)], np.int64).reshape(len(p), len(q))

    def _take(self, at: np.ndarray, query: np.ndarray, scores: np.ndarray, b: Block) -> None:
        """Put pairs (place in ``b``, query) with their scores among the best."""
        order = np.argsort(query, kind="stable")
        at, query, scores = at[order], query[order], scores[order]
        queries, first = np.unique(query, return_index=True)
        for k, f, e in zip(queries.tolist(), first.tolist(), [*first[1:].tolist(), len(query)], strict=True):
            places = at[f:e]
            ids, rows, known = (np.r_[old[k], new[places]] for old, new in ((self.ids, b.ids), (self.rows, b.rows), (self.known, b.known)))
            s = np.r_[self.scores[k], scores[f:e]]
            best = np.lexsort((rows, ids, ~known, -s, rows < 0))[: self.top]
            self.scores[k], self.ids[k], self.rows[k], self.known[k] = s[best], ids[best], rows[best], known[best]

    def through(self, b: Block) -> None:
        """Take what the bucket ``b`` has that is as good as what is known."""
        width = max(self.q.v.shape[1], b.v.shape[1])
        p, q = b.wide(width), self.q.wide(width)
        full = self.rows[:, -1] >= 0
        floor, least = np.where(full, self.scores[:, -1], -_LONG), np.where(full, self.scores[:, -1].astype(float), -np.inf)
        least -= SLACK * np.abs(np.where(np.isfinite(least), least, 0))
        longest, bound = float(b.lengths[0]), float(b.lengths[0]) * float(self.q.lengths.max())
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.nan_to_num(least / (self.q.lengths * longest), nan=-1.0, neginf=-1.0, posinf=2.0)
            cosine[(self.q.lengths == 0) | (longest == 0)] = np.where(least[(self.q.lengths == 0) | (longest == 0)] > 0, 2.0, -1.0)
            share = np.where(least > 0, np.nan_to_num(least / self.q.lengths, nan=0.0, posinf=np.inf), -1.0)
        open_ = cosine <= 1 + SLACK
        self.tried["ruled out"] += int((~open_).sum())
        upto = np.searchsorted(-b.lengths, -(share * (1 - SLACK)), "right")  # as many are long enough
        by_range = self._ranges(b, p, q, cosine, open_, upto)
        for k, at in by_range.items():
            self.tried["coordinate"] += 1
            if len(at):
                self._verified(at, np.full(len(at), k), self._exact(p[at], q[k : k + 1], bound)[:, 0], b, floor)
        rest = np.array([k for k in np.flatnonzero(open_) if k not in by_range and upto[k]], int)
        if len(rest):
            self.tried["length"] += len(rest)
            n = int(upto[rest].max())
            scores = self._exact(p[:n], q[rest], bound)
            own = b.rows[:n, None] == self.q.rows[rest][None, :]
            must = floor[rest]
            if n > self.top:
                seen = np.where(own, -_LONG, scores)
                must = np.maximum(must, -np.partition(-seen, self.top - 1, axis=0)[self.top - 1])
            at, query = np.nonzero((scores >= must[None, :]) & ~own)
            if len(at):
                self._take(at, rest[query], scores[at, query], b)

    def _verified(self, at: np.ndarray, query: np.ndarray, scores: np.ndarray, b: Block, floor: np.ndarray) -> None:
        good = (b.rows[at] != self.q.rows[query]) & (scores >= floor[query])
        if good.any():
            self._take(at[good], query[good], scores[good], b)

    def _ranges(self, b: Block, p: np.ndarray, q: np.ndarray, cosine: np.ndarray, open_: np.ndarray, upto: np.ndarray) -> dict[int, np.ndarray]:
        """For each query for which a coordinate's range holds fewer vectors than length leaves, the vectors that lie in the ranges of all its largest coordinates.

        A unit vector within an angle t of another differs from it by t at most
        in the angle to any axis.
        """
        tried = np.flatnonzero(open_ & (cosine > 0) & (self.q.lengths > 0) & (upto > 0))
        if not len(tried) or not p.shape[1] or b.lengths[-1] <= 0:
            return {}
        unit = p / b.lengths[:, None]
        ways = np.clip(q[tried] / self.q.lengths[tried, None], -1, 1)
        focus = np.argsort(-np.abs(ways), axis=1)[:, :FOCUS]
        angle = np.arccos(np.clip(cosine[tried], -1, 1))[:, None] + 1e-7
        axis = np.arccos(np.take_along_axis(ways, focus, 1))
        low, high = np.cos(np.minimum(axis + angle, math.pi)) - SLACK, np.cos(np.maximum(axis - angle, 0)) + SLACK
        first, last = np.zeros(focus.shape, int), np.zeros(focus.shape, int)
        orders: dict[int, np.ndarray] = {}
        for c in np.unique(focus).tolist():
            orders[c] = np.argsort(unit[:, c], kind="stable")
            values, mine = unit[orders[c], c], focus == c
            first[mine], last[mine] = np.searchsorted(values, low[mine]), np.searchsorted(values, high[mine], "right")
        least = np.argmin(last - first, axis=1)
        out = {}
        for i, k in enumerate(tried.tolist()):
            f = least[i]
            if 4 * (last[i, f] - first[i, f]) >= upto[k]:
                continue
            at = orders[focus[i, f]][first[i, f] : last[i, f]]
            at = at[at < upto[k]]
            values = unit[at[:, None], focus[i][None, :]]
            out[k] = at[((values >= low[i]) & (values <= high[i])).all(1)]
        return out


def top_products(vectors: DataFrame, every: int = EVERY, top: int = TOP, scale: int = SCALE, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``top`` other rows with the highest products.

    ``vectors``: (vec_id, embedding). Products are of whole components
    ``floor(scale * x)`` and exact; beyond 64 bits they count as their
    end. Ties go to the smaller id, null ids
    last. A null id makes no query but is a candidate. Rows that repeat an id
    are queries and candidates of their own. Of vectors of different sizes the
    shorter counts as filled with zeros. Null vectors and those with a component that
    is null or, scaled, not finite take no part; an empty table gives no rows; other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = save(scaled(vectors, scale), "scaled")
    blocks = save(buckets(rows, bucket_rows), "buckets")
    groups = max(1, -(-blocks.count() // GROUP_BUCKETS))
    asked = save(buckets(rows.where((F.col("vec_id") % every) == 0), query_rows), "queries")
    query_groups = max(1, asked.count())
    side = lambda df, kind, own, n, other: df.withColumn(own, F.pmod(F.xxhash64("ids"), F.lit(n))).select(F.lit(kind).alias("kind"), own, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("_other"), *_BLOCK_NAMES)
    numbered = asked.withColumn("_q", F.monotonically_increasing_id())
    left = side(numbered.select(*_BLOCK_NAMES), 0, "_q", query_groups, groups).select("kind", F.col("_q").alias("q"), F.col("_other").cast("long").alias("g"), *_BLOCK_NAMES)
    right = side(blocks, 1, "_g", groups, query_groups).select("kind", F.col("_other").cast("long").alias("q"), F.col("_g").alias("g"), *_BLOCK_NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries = None, []

        def rows_of(found: list[Best]) -> Iterator[pa.RecordBatch]:
            for best in found:
                k, r = np.nonzero(best.rows >= 0)
                ids = pa.array(best.ids[k, r], mask=~best.known[k, r])
                yield pa.RecordBatch.from_arrays([pa.array(best.q.rows[k]), pa.array(best.q.ids[k]), ids, pa.array(best.rows[k, r]), pa.array(best.scores[k, r])], names=["query_row", "query_id", "vec_id", "row", "score"])

        for batch in batches:
            for kind, q, g, _, n, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (q, g) != now:
                    yield from rows_of(queries)
                    now, queries = (q, g), []
                if kind == 0:
                    queries.append(Best(Block(n, *packed), top))
                else:
                    block = Block(n, *packed)
                    for best in queries:
                        best.through(block)
        yield from rows_of(queries)

    dealt = left.unionByName(right).repartition("q", "g").sortWithinPartitions("q", "g", "kind", F.desc("length"))
    found = dealt.mapInArrow(work, "query_row long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("row"))
    ranked = save(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "best")
    drop_saved(rows, blocks, asked)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS own FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.own, p.vec_id, list_inner_product(q.v, p.v)::BIGINT AS score
  FROM whole q JOIN whole p ON q.own <> p.own WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""
