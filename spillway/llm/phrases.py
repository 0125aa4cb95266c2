"""Collocations of each language by suffix sorting: every frequent phrase is counted as a prefix of truncated suffixes.

Words are written as codes of equal width. A suffix is the codes of up to
``max_words`` words, filled with zeros, so that suffixes of one language and
first word stand together in order, and those of one phrase stand together
among them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.llm.common import batches_of, drop_saved, only, save, table

LEAST_COUNT, MAX_WORDS, KEEP = 100, 5, 2000
#: A phrase goes if a longer one has this many hundredths of its occurrences.
CLOSED_PERCENT = 100
#: So many frequent words at most (about 130 bytes each) go to every worker under 4-byte numbers; beyond it words are known by 16-byte digests.
MAX_NUMBERED = 1_000_000
DIGEST = 16
NO_LANGUAGE = b"und"
#: So many frequent pairs of numbered words at most, 8 bytes each, go to every worker; beyond it suffixes end at words alone.
MAX_PAIRS, PAIRS_COUNTED, SUFFIXES_HELD = 4_000_000, 1_500_000, 1_000_000
#: Phrases of three words and more are first counted by cells, about one for each occurrence, from 2 ** 16 to 2 ** 28, in blocks of 2 ** 16.
BLOCK_BITS, CELL_BITS = 16, 28
#: Bytes of text that are worked on at once, words that a count holds, suffixes that reach a worker at once, parts of a language for the first ranking.
SLICE, COUNTED, SUFFIX_ROWS, PARTS = 1 << 21, 400_000, 20_000, 32
#: A break between pieces: it is none of the characters that a word may hold.
BREAK = b"."
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, A-Z in lower case, with ``BREAK`` between its pieces."""
    return text.lower().translate(_BREAKS).replace(BREAK, b" . ").split()


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[bytes]]]:
    """(language, words) of the batch's texts, those of a language in slices, with a break after each text."""
    by_lang: dict[bytes, list[bytes]] = {}
    sizes: Counter[bytes] = Counter()
    for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        lang, text = NO_LANGUAGE if lang is None else lang, text or b""
        by_lang.setdefault(lang, []).append(text)
        sizes[lang] += len(text)
        if sizes[lang] >= SLICE:
            yield lang, words_of(b"\n".join(by_lang.pop(lang)))
            del sizes[lang]
    for lang, texts in by_lang.items():
        yield lang, words_of(b"\n".join(texts))


def _source(docs: DataFrame) -> DataFrame:
    return only(docs, "lang", "text").select(F.col("lang").cast("string").cast("binary"), F.col("text").cast("string").cast("binary"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): the occurrences of each word of a language, and, where ``word`` is null, of all."""

    def rows(lang: bytes, counts: Counter) -> pa.RecordBatch:
        counts[None] = counts.total() - counts.pop(BREAK, 0)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.binary()), len(counts)), pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "f"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = {}
        for batch in batches:
            for lang, words in _sequences(batch):
                counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > COUNTED:
                yield from map(rows, counts, counts.values())
                counts = {}
        yield from map(rows, counts, counts.values())

    return _source(docs).mapInArrow(work, "lang binary, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Codes:
    """A word's code: its number, or the digest of its language and itself. Zeros stand for a break and for words that no phrase holds."""

    def __init__(self, numbers: dict[bytes, dict[bytes, int]] | None):
        self.numbers, self.width = numbers, DIGEST if numbers is None else 4

    def of(self, lang: bytes, words: list[bytes]) -> np.ndarray:
        """A row of bytes for each word."""
        if self.numbers is not None:
            own = self.numbers.get(lang, {})
            return np.fromiter(map(own.get, words, repeat(0)), ">u4", len(words)).view(np.uint8).reshape(-1, 4)
        known = {w: hashlib.md5(b"%d " % len(lang) + lang + w).digest() for w in set(words)} | {BREAK: bytes(DIGEST)}
        return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint8).reshape(-1, DIGEST)


def _binary(rows: np.ndarray) -> pa.Array:
    """An array of the rows' bytes."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _combined(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, with the sum of their counts; a hash puts them beside each other."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    key = np.zeros(len(rows), np.uint64)
    for part in wide.view("<u8").T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    rows, counts = rows[order], counts[order]
    starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)][: len(rows)])
    return rows[starts], np.add.reduceat(counts, starts)


def sequences(docs: DataFrame, codes) -> DataFrame:
    """(codes): texts as the codes of their words, a row for each slice; a run of words without a code is one zero.

    ``codes``: a broadcast ``Codes``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words in _sequences(batch):
                coded = codes.value.of(lang, words)
                there = coded.any(1)
                kept = np.ascontiguousarray(coded[there | np.r_[False, there[:-1]]])
                yield pa.RecordBatch.from_arrays([pa.array([kept.tobytes()], pa.binary())], names=["codes"])

    return _source(docs).mapInArrow(work, "codes binary")


def _pairs(numbers: np.ndarray) -> np.ndarray:
    """Each number with the next one, as one of 64 bits; with a zero there is no pair: 0."""
    first, second = numbers[:-1].astype(np.uint64), numbers[1:].astype(np.uint64)
    return (first << np.uint64(32) | second) * ((first > 0) & (second > 0))


def pair_counts(coded: DataFrame) -> DataFrame:
    """(pair, n): the occurrences of each pair of neighbouring words of ``sequences`` in numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["pair", "n"])
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for data in batch.column(0):
                new, n = np.unique(_pairs(np.frombuffer(data.as_buffer(), ">u4")), return_counts=True)
                keys, counts = np.r_[keys, new], np.r_[counts, n]
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
                keys, counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
                if len(keys) > PAIRS_COUNTED:
                    yield rows(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield rows(keys, counts)

    return coded.mapInArrow(work, "pair long, n long").where("pair <> 0").groupBy("pair").agg(F.sum("n").alias("n"))


def _goes_on(words: np.ndarray, pairs: np.ndarray | None) -> np.ndarray:
    """For each word whether a phrase may go on to the next one: neither is a zero, and the two are in ``pairs``, if those are given."""
    there = words.any(1)
    goes_on = there[:-1] & there[1:]
    if pairs is not None and len(pairs):
        own = _pairs(words.view(">u4")[:, 0])
        goes_on &= pairs[np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)] == own
    return goes_on


def _alive(goes_on: np.ndarray, at: np.ndarray, max_words: int) -> np.ndarray:
    """For each place and k whether the suffix there has a word k."""
    goes_on = np.r_[True, goes_on, np.zeros(max_words, bool)]  # at k: into the word k
    return np.logical_and.accumulate(np.stack([np.ones(len(at), bool), *(goes_on[at + k] for k in range(1, max_words))], 1), 1)


def _cells(words: np.ndarray, at: np.ndarray, max_words: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, cells): where the first k + 1 numbered words of each place are counted, from three words on."""
    numbers = np.r_[words.view(">u4")[:, 0].astype(np.uint64), np.zeros(max_words, np.uint64)]
    h = numbers[at]
    for k in range(1, max_words):
        h = (h * np.uint64(0xD6E8FEB86659FD93) ^ numbers[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k > 1:
            yield k, (h >> np.uint64(64 - bits)).astype(np.int64)


def marked_cells(coded: DataFrame, max_words: int, least: int, pairs, bits: int) -> np.ndarray:
    """A bit for each of 2 ** ``bits`` cells: whether the phrases of three words and more that fall into it come ``least`` times together.

    A phrase that comes so often is in a marked cell, so that nothing else has
    to be counted by itself. A task gives the cells that it has met, in blocks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.r_[True, np.diff(cells >> BLOCK_BITS) != 0, True]) if len(cells) else np.zeros(1, np.int64)
            spans = list(zip(edges, edges[1:], strict=False))
            low, many = (cells & ((1 << BLOCK_BITS) - 1)).astype("<u2"), np.minimum(counts, 2**31 - 1).astype("<i4")
            return pa.RecordBatch.from_arrays([pa.array([int(cells[a] >> BLOCK_BITS) for a, _ in spans], pa.int32()), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([many[a:b].tobytes() for a, b in spans], pa.binary())], names=["block", "low", "many"])

        held = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for data in batch.column(0):
                words = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 4)
                if len(words) < 3:
                    continue
                goes_on = _goes_on(words, pairs.value)
                at = np.flatnonzero(goes_on)
                alive = _alive(goes_on, at, max_words)
                new, n = np.unique(np.concatenate([c[alive[:, k]] for k, c in _cells(words, at, max_words, bits)]), return_counts=True)
                cells, order = np.unique(np.r_[held[0], new], return_inverse=True)
                held = cells, np.bincount(order, np.r_[held[1], n], len(cells)).astype(np.int64)
                if len(cells) > PAIRS_COUNTED:
                    yield rows(*held)
                    held = cells[:0], cells[:0]
        yield rows(*held)

    def summed(group: pa.Table) -> pa.Table:
        counts = np.zeros(1 << BLOCK_BITS, np.int64)
        for low, many in zip(group["low"].to_pylist(), group["many"].to_pylist(), strict=True):
            counts[np.frombuffer(low, "<u2")] += np.frombuffer(many, "<i4")
        return pa.table([pa.array([group["block"][0].as_py()], pa.int32()), pa.array([np.packbits(counts >= least).tobytes()], pa.binary())], names=["block", "bits"])

    marks = np.zeros((1 << bits) >> 3, np.uint8).reshape(-1, (1 << BLOCK_BITS) >> 3)
    found = save(coded.mapInArrow(work, "block int, low binary, many binary").groupBy("block").applyInArrow(summed, "block int, bits binary"), "cells")
    for r in found.toLocalIterator():
        marks[r.block] = np.frombuffer(bytes(r.bits), np.uint8)
    drop_saved(found)
    return marks.reshape(-1)


def suffixes(coded: DataFrame, width: int, max_words: int = MAX_WORDS, pairs=None, marks=None, bits: int = 0) -> DataFrame:
    """(key, n): the suffixes of two words and more, cut after ``max_words``; a task gives equal ones as one row, as far as it can hold them.

    A zero ends a suffix, and so does a pair of words that is not in ``pairs``, a
    broadcast sorted array, if that is given. With ``marks``, a broadcast of
    ``marked_cells``, so does a phrase whose cell is not marked, and suffixes of
    two words are left out, since ``pair_counts`` has them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, max_words * width), np.uint8), np.empty(0, np.int64)
        given = lambda rows, counts: pa.RecordBatch.from_arrays([_binary(rows), pa.array(counts)], names=["key", "n"])
        for batch in batches:
            for data in batch.column(0):
                words = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, width)
                if len(words) < 2:
                    continue
                goes_on = _goes_on(words, None if pairs is None else pairs.value)
                at = np.flatnonzero(goes_on)
                if not len(at) or pairs is not None and not len(pairs.value):
                    continue
                alive = _alive(goes_on, at, max_words)
                if marks is not None:
                    for k, cells in _cells(words, at, max_words, bits):
                        alive[:, k] &= (marks.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
                    alive = np.logical_and.accumulate(alive, 1)
                    at, alive = at[alive[:, 2]], alive[alive[:, 2]]
                    if not len(at):
                        continue
                words = np.concatenate([words, np.zeros((max_words, width), np.uint8)])
                rows = np.stack([words[at + k] for k in range(max_words)], 1) * alive[:, :, None]
                held = _combined(np.concatenate([held[0], rows.reshape(len(at), -1)]), np.r_[held[1], np.ones(len(at), np.int64)])
                if len(held[0]) > SUFFIXES_HELD:
                    yield given(*held)
                    held = held[0][:0], held[1][:0]
        yield given(*held)

    return coded.mapInArrow(work, "key binary, n long")


class PrefixStack:
    """The open prefixes of sorted suffixes, one of each length, and what they have counted.

    A prefix is closed as soon as a suffix without it comes. Closed ones with
    ``least`` occurrences are given out, and in any case those at either end of
    the run: what a neighbouring run counts of them has to be added.
    """

    def __init__(self, width: int, max_words: int, least: int):
        self.width, self.max_words, self.least = width, max_words, least
        self.last: np.ndarray | None = None
        self.open: dict[int, tuple[bytes, int, bool]] = {}

    def push(self, rows: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, int]]:
        out: list[tuple[bytes, int]] = []
        before = np.concatenate([rows[:1] if self.last is None else self.last, rows[:-1]])
        words = rows.reshape(len(rows), self.max_words, self.width)
        differs = np.logical_or.accumulate((words != before.reshape(words.shape)).any(2), 1)
        if self.last is None:
            differs[0] = True
        for k in range(2, self.max_words + 1):
            starts = np.flatnonzero(differs[:, k - 1])
            edges = np.r_[0, starts] if not len(starts) or starts[0] else starts
            sums = np.add.reduceat(counts, edges)
            if edges is not starts:  # goes on from the last batch
                key, had, first = self.open[k]
                self.open[k] = key, had + int(sums[0]), first
                edges, sums = edges[1:], sums[1:]
            if not len(edges):
                continue
            out += self._closed(k)
            inner = np.flatnonzero((sums[:-1] >= self.least) & words[edges[:-1], k - 1].any(1))
            if k not in self.open:  # the first prefix of the run
                inner = np.union1d(inner, [0] if len(edges) > 1 and words[edges[0], k - 1].any() else []).astype(np.int64)
            out += [(rows[e, : k * self.width].tobytes(), int(s)) for e, s in zip(edges[inner], sums[inner], strict=True)]
            self.open[k] = rows[edges[-1], : k * self.width].tobytes() if words[edges[-1], k - 1].any() else b"", int(sums[-1]), k not in self.open and len(edges) == 1
        self.last = rows[-1:].copy()
        return out

    def _closed(self, k: int, end: bool = False) -> list[tuple[bytes, int]]:
        key, n, first = self.open.get(k, (b"", 0, False))
        return [(key, n)] if key and (n >= self.least or first or end) else []

    def end(self) -> list[tuple[bytes, int]]:
        return [x for k in self.open for x in self._closed(k, True)]


def prefix_counts(suffix_rows: DataFrame, width: int, max_words: int, least: int) -> DataFrame:
    """(key, f): each phrase of two words and more with ``least`` occurrences.

    Suffixes are dealt by ranges of language, first word and what follows, so
    that a word before a third of all others is spread over many tasks. Of a
    phrase that ranges share each gives its part; a sum joins them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = PrefixStack(width, max_words, least)

        def rows(found: list[tuple[bytes, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["key", "f"])

        for batch in batches:
            if batch.num_rows:
                keys = b"".join(batch.column(0).to_pylist())
                yield rows(stack.push(np.frombuffer(keys, np.uint8).reshape(batch.num_rows, -1), batch.column(1).to_numpy()))
        yield rows(stack.end())

    dealt = suffix_rows.repartitionByRange("key").sortWithinPartitions(F.col("key").desc())
    return dealt.mapInArrow(work, "key binary, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def mine_phrases(docs: DataFrame, least: int = LEAST_COUNT, max_words: int = MAX_WORDS, keep: int = KEEP, closed_percent: int = CLOSED_PERCENT, max_numbered: int = MAX_NUMBERED, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """Each language's first ``keep`` phrases: (lang, rank, phrase, a, l, r, n, score), without those that longer ones cover.

    A null language counts as ``und``, a null text as empty; a text without
    words and an empty table give nothing. Repeated rows and ids count each;
    other columns are not read. Texts may be of any length: nothing is cut, a
    text's words are held at once by the task that has it. Words with fewer
    occurrences than ``least`` are in no candidate and in no part of one, so
    they end suffixes as long as the others are few enough to be numbered; in
    the same way rarer pairs of words do.
    Equal scores go by ``a``, then by the phrase's bytes, which are distinct.
    """
    spark = docs.sparkSession
    counts = save(word_counts(docs).where(F.col("word").isNull() | (F.col("f") >= least)), "words")
    frequent = counts.where(F.col("word").isNotNull())
    numbers: dict[bytes, dict[bytes, int]] | None = None
    if frequent.limit(max_numbered + 1).count() <= max_numbered:
        numbers = {}
        for k, x in enumerate(frequent.orderBy("lang", F.desc("f"), "word").select("lang", "word").toLocalIterator()):
            numbers.setdefault(bytes(x.lang), {})[bytes(x.word)] = k + 1
    own = Codes(numbers)
    codes, width = spark.sparkContext.broadcast(own), own.width
    coded, pairs, marks, bits = save(sequences(docs, codes), "sequences"), None, None, 0
    if numbers is not None:
        common = save(pair_counts(coded).where(F.col("n") >= least), "pairs")
        if common.limit(max_pairs + 1).count() <= max_pairs:
            pairs = spark.sparkContext.broadcast(np.sort(common.select("pair").toPandas()["pair"].to_numpy(np.int64)).astype(np.uint64))
            if max_words > 2 and len(pairs.value):
                phrases_at_most = (max_words - 2) * common.agg(F.sum("n")).first()[0]
                bits = min(CELL_BITS, max(BLOCK_BITS, int(phrases_at_most).bit_length()))
                marks = spark.sparkContext.broadcast(marked_cells(coded, max_words, least, pairs, bits))
    rows = save(suffixes(coded, width, max_words, pairs, marks, bits), "suffixes")
    drop_saved(coded)
    before = batches_of(spark, SUFFIX_ROWS)
    phrases = prefix_counts(rows, width, max_words, least)
    if marks is not None:
        phrases = phrases.where(F.length("key") > 2 * width).unionByName(common.select(F.unhex(F.lpad(F.hex("pair"), 16, "0")).alias("key"), F.col("n").alias("f")))
    phrases = save(phrases, "phrases")
    if numbers is not None:
        drop_saved(common)

    def with_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words, _ = (c.to_pylist() for c in batch.columns)
            keys = [codes.value.of(a, [w]).tobytes() for a, w in zip(langs, words, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["lang", "word", "f", "key"])

    words = save(frequent.select("lang", "word", "f").mapInArrow(with_code, "lang binary, word binary, f long, key binary"), "codes")
    batches_of(spark, int(before))
    drop_saved(rows)

    size = (F.length("key") / width).cast("int")
    at = lambda first, n: F.expr(f"substring(key, ({first}) * {width} + 1, ({n}) * {width})")
    longer = phrases.withColumn("k", size).where("k > 2").select("f", F.explode(F.array(at("0", "k - 1"), at("1", "k - 1"))).alias("key")).groupBy("key").agg(F.max("f").alias("longer"))
    left = phrases.join(longer, "key", "left").where(f"longer IS NULL OR 100 * longer < {closed_percent} * f").select("key", F.col("f").alias("a"), size.alias("k"))

    spelled = left.select("key", "a", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.substring(F.col("key"), i * width + 1, F.lit(width)))).alias("i", "code"))
    spelled = spelled.join(words.select(F.col("key").alias("code"), "lang", "word"), "code").groupBy("key", "a")
    spelled = spelled.agg(F.min("lang").alias("lang"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"].cast("string"))).alias("phrase"))
    parts = phrases.select("key", "f").unionByName(words.select("key", "f"))
    cuts = left.select("key", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k").select("key", "a", "cut", at("0", "cut").alias("head"), at("cut", "k - cut").alias("tail"))
    cuts = cuts.join(parts.select(F.col("key").alias("head"), F.col("f").alias("l")), "head").join(parts.select(F.col("key").alias("tail"), F.col("f").alias("r")), "tail")
    totals = counts.where(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    cuts = cuts.join(words.select(F.col("key").alias("first"), "lang"), F.substring("key", 1, width) == F.col("first")).join(totals, "lang")
    score = F.expr("(CAST(a AS decimal(17,0)) * CAST(n AS decimal(17,0)) * 1000BD) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    lowest = cuts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "cut", "l", "r", "n")).alias("low")).select("key", "low.*")
    found = lowest.join(spelled, "key").select(F.col("lang").cast("string").alias("lang"), "phrase", "a", "l", "r", "n", "score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    near = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= keep)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS p FROM starts, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w)),
counted AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY lang, k, p HAVING count(*) >= 100),
inner_parts AS (SELECT lang, f, unnest([list_slice(p, 1, k - 1), list_slice(p, 2, k)]) AS p FROM counted WHERE k > 2),
longest AS (SELECT lang, p, max(f) AS longer FROM inner_parts GROUP BY lang, p),
kept AS (SELECT c.* FROM counted c LEFT JOIN longest g ON c.lang = g.lang AND c.p = g.p WHERE c.k > 1 AND (g.longer IS NULL OR 100 * g.longer < 100 * c.f)),
cuts AS (SELECT lang, p, f AS a, k, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.p, c.a, x.f AS l, y.f AS r, t.n, c.cut, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, c.cut) JOIN counted y ON y.lang = c.lang AND y.p = list_slice(c.p, c.cut + 1, c.k) JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
spelled AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM lowest)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM spelled QUALIFY rank <= 2000
"""
