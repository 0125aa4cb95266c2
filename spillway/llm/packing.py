"""Best-fit packing of documents into sequences by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so the histogram of lengths has at
most ``capacity`` rows however large the corpus is. The plan is made on it: runs
of sequences that hold the same lengths at the same places. Documents of one
length are alike to the plan; each finds its place by its rank among them.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import only, running_total, save, table, text_of
from spillway.llm.tokens import encoder, in_slices

CAPACITY = 2048
#: Each plan calls lengths over capacity / parts large, and makes so many groups of them; the plan with the fewest sequences wins.
SETTINGS = ((2, 20), (3, 10), (3, 20))
#: The plan's rows depend on the capacity alone; above this number they are joined without a broadcast.
MAX_BROADCAST_PLAN = 500_000

Run = tuple[int, list[int]]  # so many sequences, each of these lengths in this order


def best_configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[int, list[int]]]:
    """(times, how many of each size) by the linear programme over all configurations, rounded down.

    Columns are generated: a knapsack over the capacity finds the configuration
    that the present prices favour most, until none is better.
    """
    k = len(sizes)
    base = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(rounds):
        prices = np.linalg.solve(base.T, np.ones(k))
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(1, capacity + 1):
            best[room] = best[room - 1]
            for i, s in enumerate(sizes):
                if s <= room and best[room - s] + prices[i] > best[room] + 1e-12:
                    best[room], took[room] = best[room - s] + prices[i], i
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if took[room] < 0:
                room -= 1
            else:
                column[took[room]] += 1
                room -= sizes[took[room]]
        x, change = np.linalg.solve(base, np.array(demand, float)), np.linalg.solve(base, column)
        ratio = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
        base[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(base, np.array(demand, float))
    return [(int(np.floor(n + 1e-9)), base[:, j].astype(int).tolist()) for j, n in enumerate(x) if n >= 1]


def _group(large: list[tuple[int, int]], groups: int) -> list[deque[list[int]]]:
    """Lengths (largest first, with their counts) in groups of equal cardinality."""
    each = -(-sum(n for _, n in large) // groups)
    out, room = [deque()], each
    for length, n in large:
        while n:
            if not room:
                out.append(deque())
                room = each
            part = min(n, room)
            out[-1].append([length, part])
            n, room = n - part, room - part
    return [g for g in out if g]


def _substitute(times: int, config: list[int], groups: list[deque[list[int]]]) -> Iterator[Run]:
    """Actual lengths for a configuration of rounded ones."""
    wanted = [(groups[g], n) for g, n in enumerate(config) if n]
    while times:
        if not all(g and sum(c for _, c in g) >= n for g, n in wanted):
            return
        same = min(times, *[g[0][1] // n for g, n in wanted])
        lengths = []
        for g, n in wanted:
            if same:
                lengths += [g[0][0]] * n
                g[0][1] -= n * same
                if not g[0][1]:
                    g.popleft()
                continue
            for _ in range(n):
                lengths.append(g[0][0])
                g[0][1] -= 1
                if not g[0][1]:
                    g.popleft()
        times -= same or 1
        yield same or 1, lengths


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, settings: tuple[tuple[int, int], ...] = SETTINGS) -> list[Run]:
    """Runs of sequences that hold each length as often as the histogram has it."""
    plans = [_plan(histogram, capacity, parts, groups) for parts, groups in settings]
    return min(plans, key=lambda runs: sum(n for n, _ in runs))


def _plan(histogram: dict[int, int], capacity: int, parts: int, groups: int) -> list[Run]:
    small_most = capacity // parts
    runs: list[Run] = [(n, [capacity]) for length, n in histogram.items() if length == capacity and n]
    large = sorted(((x, n) for x, n in histogram.items() if small_most < x < capacity and n), reverse=True)
    rest = Counter({x: n for x, n in histogram.items() if x <= small_most and n})
    if large:
        grouped = _group(large, groups)
        tops = [g[0][0] for g in grouped]
        sizes = sorted(set(tops), reverse=True)
        merged = [deque(x for g, top in zip(grouped, tops, strict=True) if top == s for x in g) for s in sizes]
        demand = [sum(n for _, n in g) for g in merged]
        for times, config in best_configurations(sizes, demand, capacity):
            runs += _substitute(times, config, merged)
        for g in merged:
            for length, n in g:
                rest[length] += n
    room: dict[int, list[Run]] = defaultdict(list)
    for n, lengths in runs:
        room[capacity - sum(lengths)].append((n, lengths))
    for length in sorted(rest, reverse=True):
        left, free = rest[length], length
        while left:
            while free <= capacity and not room.get(free):
                free += 1
            if free > capacity:
                each = capacity // length
                for n, k in ((left // each, each), (1, left % each)):
                    if n and k:
                        room[capacity - k * length].append((n, [length] * k))
                break
            n, lengths = room[free].pop()
            placed = min(n, left)
            if placed < n:
                room[free].append((n - placed, lengths))
            room[free - length].append((placed, [*lengths, length]))
            left -= placed
            free = length if free - length >= length else free
    return [run for _, runs_ in sorted(room.items()) for run in runs_]


def places(runs: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first, offset) of all places in the plan."""
    ranks: Counter[int] = Counter()
    out, first = [], 0
    for n, lengths in runs:
        at = 0
        for length in lengths:
            out.append((length, ranks[length], ranks[length] + n - 1, first, at))
            ranks[length] += n
            at += length
        first += n
    return out


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as little-endian 32-bit bytes) of each piece.

    A document's ids end with ``end_id``. Only those of more than ``capacity``
    ids are cut, into full pieces but for the first. Null texts count as empty.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, True).encode
        for batch in batches:
            docs_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                rows: list[tuple] = []
                ids, ends = encode(texts[a:b], end_id)
                raw, first = memoryview(ids.tobytes()), 0
                for doc, last in zip(docs_ids[a:b], ends.tolist(), strict=True):
                    n, start = last - first, 0
                    length = n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        part = raw[4 * (first + start) : 4 * (first + start + length)]
                        rows.append((doc, piece, start, length, zlib.crc32(part), bytes(part) if with_ids else None))
                        start, length = start + length, capacity
                    first = last
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(work, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces``, all columns, with sequence_id and offset: their place in sequences of at most ``capacity``.

    ``length`` must be from 1 to ``capacity``. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    kept = save(pieces.withColumn("block", F.spark_partition_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in kept.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    found = places(plan_packing(histogram, capacity))
    plan = spark.createDataFrame(found, "p_length long, p_first long, p_last long, p_sequence long, p_offset long")
    if len(found) <= MAX_BROADCAST_PLAN:
        plan = F.broadcast(plan)
    ranked = running_total(kept.withColumn("_one", F.lit(1)), ["length"], [F.col("doc_id"), F.col("piece")], "_one", "_rank").drop("_one", "block")
    placed = ranked.join(plan, (F.col("length") == F.col("p_length")) & F.col("_rank").between(F.col("p_first"), F.col("p_last")))
    out = placed.withColumn("sequence_id", F.col("p_sequence") + F.col("_rank") - F.col("p_first")).withColumn("offset", F.col("p_offset"))
    return out.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) with their sequence_id and offset in it.

    Null texts count as empty and give the end id alone; a null doc_id stays
    null; rows that repeat a doc_id are packed as documents of their own.
    Columns other than doc_id and text are not read.
    """
    return pack(token_pieces(docs, vocabulary, capacity, end_id, with_ids), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
