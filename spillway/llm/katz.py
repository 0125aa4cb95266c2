"""Katz backoff language model: Good-Turing discounts and exactly normalised backoff weights.

Texts are cut into slices of some 350,000 tokens. A slice knows its distinct
n-grams; what it needs to know of the whole corpus about them (how often each
comes, what a history leaves to unseen words) is summed by key over all slices
and comes back in the slice's own order. An n-gram stands for a 64-bit hash.
N-grams of three words and more are in the model from CUTOFF occurrences on, so
one is asked for only if the shorter ones at both of its ends come that often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.llm.common import batches_of, drop_bucketed, drop_folder, new_path, only, save, save_bucketed, table, text_of, write

TOKENS = 350_000
ORDER = 3
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Least count in the model of n-grams of three words and more.
CUTOFF = 2
#: Texts are taken in so many bytes at once, a longer one alone, before a slice's size is looked at.
BYTES_AT_ONCE = 1 << 19
#: Slices to a bucket of keys: a task sums about so many slices' keys at once.
BUCKET = 4
END, START = np.uint64(1), np.uint64(2)  # what no word's hash is


HALF = 14


def pack(*arrays: np.ndarray) -> list[bytes]:
    return [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes()) for x in arrays]


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data) if data else b"", kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, all first bytes, then all second ones: the leading ones are mostly zero."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return pack(steps.view("u1").reshape(-1, 8).T)[0]


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpack(data, "u1").reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def pack_numbers(rows: np.ndarray) -> bytes:
    """Rows of numbers: whole ones in as few bytes as the largest needs, others as doubles (of half the size if none loses by it) or, if many repeat, places among the distinct ones.

    A head of two numbers for each row (bytes of a number, HALF for the smaller
    doubles, and how many distinct ones are listed) comes first. Numbers of several bytes are stored as all
    first bytes, then all second ones.
    """
    head, parts = [], []
    for row in rows:
        listed = np.empty(0, "<f8")
        whole = len(row) == 0 or (row.min() >= 0 and row.max() < 2**32 and (row == np.floor(row)).all())
        if not whole:
            distinct, place = np.unique(row, return_inverse=True)
            if 2 * len(distinct) < len(row):
                listed, row, whole = distinct.astype("<f8"), place, True
        top = row.max(initial=0) if whole else 0
        half = not whole and (row.astype("<f4") == row).all()
        size = (4 if half else 8) if not whole else 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
        head += [HALF if half else size, len(listed)]
        numbers = row.astype(f"<u{size}" if whole else f"<f{size}").view("u1").reshape(-1, size).T
        parts += [listed.tobytes(), numbers.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<u4").tobytes() + b"".join(parts))


def unpack_numbers(data: bytes, width: int) -> np.ndarray:
    """The ``width`` rows of ``pack_numbers`` as doubles."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    head, at, rows = np.frombuffer(raw, "<u4", 2 * width).reshape(width, 2).tolist(), 8 * width, []
    n = (len(raw) - at - 8 * sum(k for _, k in head)) // sum(4 if size == HALF else size for size, _ in head)
    for size, k in head:
        listed, at = np.frombuffer(raw, "<f8", k, at), at + 8 * k
        kind, size = ("f", 4) if size == HALF else ("f" if size == 8 else "u", size)
        row = np.ascontiguousarray(np.frombuffer(raw, "u1", size * n, at).reshape(size, n).T).view(f"<{kind}{size}").ravel()
        rows.append(listed[row] if k else row.astype("<f8"))
        at += size * n
    return np.array(rows)


def pack_weights(weights: np.ndarray, asked: np.ndarray) -> bytes:
    """Whether each of the weights is below zero, and those that are asked for without their sign.

    The last 16 bits of a double are left out: nothing is subtracted from a weight
    any more, and what is scored by it is right to 1e-11.
    """
    signs = pack_numbers((weights < 0).astype(float)[None])
    short = (np.abs(weights[asked]).view("<u8") & np.uint64(0xFFFFFFFFFFFF0000)).view("<f8")
    return len(signs).to_bytes(4, "little") + signs + pack_numbers(short[None])


def weights_of(parts: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """What ``pack_weights`` was given, of all parts: the signs and the weights that were asked for."""
    cut = [(x[4 : 4 + (n := int.from_bytes(x[:4], "little"))], x[4 + n :]) for x in parts or []]
    signs, weights = (np.concatenate([unpack_numbers(x, 1)[0] for x in own]) if own else np.empty(0) for own in ([a for a, _ in cut], [b for _, b in cut]))
    return signs > 0, weights


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words in a row after lower-casing A to Z, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten()
    real = pc.not_equal(flat, "")
    at = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    return flat.filter(real), np.diff(at[parts.offsets.to_numpy()])


def mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    a = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(32))


def hash_words(words: pa.Array) -> np.ndarray:
    """64 bits of each word, 3 or more: of up to 16 bytes all at once, of longer ones by XXH3."""
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(ends)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    at = ends[:-1, None] + np.arange(16)
    heads = np.where(np.arange(16) < sizes[:, None], data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8).view("<u8")
    hashes = mix(mix(mix(heads[:, 0] + np.uint64(7)) ^ heads[:, 1]) + sizes.astype(np.uint64))
    long = np.flatnonzero(sizes > 16)
    hashes[long] = np.fromiter(map(xxhash.xxh3_64_intdigest, words.take(pa.array(long)).to_pylist()), np.uint64, len(long))
    return np.where(hashes < 3, hashes + np.uint64(3), hashes)


def extend(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of the n-grams that have ``words`` after the n-grams of ``keys``."""
    mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) ^ ((words ^ (words >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, each key's place among them, and the keys' sorted order (equal ones as they came) with where it reaches each distinct one.

    Numbers are sorted faster than places: the first bits of each key with its place as the last ones.
    """
    low = np.uint64((1 << max(1, (len(keys) - 1).bit_length())) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():  # different keys with the same first bits
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts, place = np.flatnonzero(new), np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[starts], place, order, starts


def least_count(n: int) -> int:
    return CUTOFF if n > 2 else 1


class Slice:
    """A slice's texts, n-gram by n-gram.

    Arrays over tokens have a last element more, for START: what stands before
    each text's first token. ``c<n>`` of the row are counts of n-grams and whether
    the slice is the first to have each, ``h<n>`` the weights of n-grams as
    histories, as ``sum_by_key`` answered them.
    """

    def __init__(self, row: dict, model: Katz | None = None):
        self.row, self.model, self.kept = row, model, {}
        self.ids, self.held, self.ends = unpack(row["ids"], "<i8"), unpack(row["held"], "u1").astype(bool), unpack(row["ends"], "<i8")
        self.null = unpack(row["no_id"], "u1").astype(bool)
        words, codes = unpack(row["words"], "<u8"), unpack_numbers(row["codes"], 1)[0].astype(np.int64)
        codes = np.r_[codes, np.flatnonzero(words == START)]
        self.tokens = words[codes]
        order = np.argsort(words)
        rank, first = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        place = rank[codes]
        first[place[::-1]] = np.arange(len(place))[::-1]
        self.kept["grams", 1] = words[order], place, first
        sizes = np.diff(np.r_[0, self.ends])
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.trained = np.r_[~self.held[self.owner], False]
        self.before = np.arange(-1, len(self.tokens) - 1)
        self.before[self.ends - sizes] = self.before[-1] = len(self.tokens) - 1

    def keys(self, n: int) -> np.ndarray:
        """Of the n-gram that ends at each token."""
        keys = self.tokens
        for _ in range(n - 1):
            keys = extend(keys[self.before], self.tokens)
        return keys

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams that are asked for, each token's place among them (-1: not asked), and the first token of each."""
        if ("grams", n) not in self.kept:
            at = np.arange(len(self.tokens))
            if n > 2:
                often = self.counts(n - 1) >= CUTOFF
                often[-1] = True
                at = np.flatnonzero(often & often[self.before])
            keys, own, order, starts = distinct(self.keys(n)[at])
            place = np.full(len(self.tokens), -1)
            place[at] = own
            self.kept["grams", n] = keys, place, at[order[starts]]
        return self.kept["grams", n]

    def counted(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """What ``sum_by_key`` gets: n-grams and how often each comes in training texts."""
        keys, place, _ = self.grams(n)
        return keys, np.bincount(place[self.trained & (place >= 0)], minlength=len(keys))[None]

    def counts(self, n: int) -> np.ndarray:
        """Of each token's n-gram in all training texts; 0 if not asked for, and for START the number of texts."""
        if ("counts", n) not in self.kept:
            counts = np.r_[sums_of(self.row[f"c{n}"], 2)[0], 0][self.grams(n)[1]]
            counts[-1] = self.model.texts
            self.kept["counts", n] = counts
        return self.kept["counts", n]

    def histories(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams that longer ones in the model may follow, and each token's place among them (-1: none may)."""
        keys, place, first = self.grams(n)
        may = self.counts(n)[first] >= least_count(n + 1)
        return keys[may], np.where(np.r_[may, False][place], (np.cumsum(may) - 1)[place], -1)

    def asked(self, n: int) -> np.ndarray:
        """Whether a weight is asked for each of ``histories``: a token comes after it whose longer n-gram is not in the model."""
        keys, place = self.histories(n)
        out, place = np.zeros(len(keys), bool), place[self.before]
        out[place[(place >= 0) & (self.counts(n + 1) < least_count(n + 1))]] = True
        return out

    def left(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """What ``sum_by_key`` gets of each n-gram as a history: of the longer ones that this slice is the first to have, the sums of their discounted counts and of their probabilities without the first word; its count twice, and one more if the slice asks for its weight."""
        keys, place = self.histories(n)
        _, _, first = self.grams(n + 1)
        counts, owned = sums_of(self.row[f"c{n + 1}"], 2)
        at = np.flatnonzero((owned > 0) & (counts >= least_count(n + 1)))
        history, first = place[self.before[first[at]]], first[at]
        sums = [np.bincount(history, weights=x, minlength=len(keys)) for x in (self.model.discounted(n + 1, counts[at]), self.probability(n)[first])]
        many = np.zeros(len(keys))
        many[place[place >= 0]] = self.counts(n)[place >= 0]
        return keys, np.array([*sums, 2 * many + self.asked(n)])

    def probability(self, n: int) -> np.ndarray:
        """Of each token after the n - 1 before it: discounted if the n-gram is in the model, else the history's weight times that after one word less."""
        counts = self.counts(n)
        if n == 1:
            return self.model.word(counts)
        known, place = self.asked(n - 1), self.histories(n - 1)[1][self.before]
        one_more, told = weights_of(self.row[f"h{n - 1}"])
        weights = np.ones(len(known) + 1)
        weights[:-1][known] = told
        below = np.maximum(self.counts(n - 1)[self.before], 1) + np.r_[one_more, False][place]
        return np.where(counts >= least_count(n), self.model.discounted(n, counts) / below, weights[place] * self.probability(n - 1))


SLICE_SCHEMA = "slice long, ids binary, no_id binary, held binary, ends binary, words binary, codes binary"


def slices(docs: DataFrame, tokens: int = TOKENS, modulus: int = 7, held: int = 2) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) in slices of at least ``tokens`` tokens or a partition's rest.

    Held out are the rows whose crc32 of doc_id as text (empty for null) leaves ``held``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        waiting: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal number, waiting, size
            ids, no_id, out_of, counts = (np.concatenate([w[i] for w in waiting]) for i in range(4))
            coded = pa.concat_arrays([w[4] for w in waiting]).dictionary_encode()
            hashes = hash_words(coded.dictionary)
            words = np.unique(np.r_[hashes, END, START])
            place = np.searchsorted(words, hashes).astype("<u4")
            end = np.uint32(np.searchsorted(words, END))
            codes = np.insert(place[coded.indices.to_numpy()], np.cumsum(counts), end).astype("<u4")
            common = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")  # stored so that most codes are small
            rank = np.empty(len(words), "<u4")
            rank[common] = np.arange(len(words))
            row = [[(part << 24) + number], *[[x] for x in pack(ids, no_id, out_of, np.cumsum(counts + 1).astype("<i8"), words[common])], [pack_numbers(rank[codes][None])]]
            number, waiting, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int64()) for k, c in enumerate(row)], names=["slice", "ids", "no_id", "held", "ends", "words", "codes"])

        for batch in batches:
            reached = np.cumsum(pc.binary_length(batch.column(1)).to_numpy()) // BYTES_AT_ONCE
            starts = [0, *(np.flatnonzero(np.diff(reached)) + 1).tolist()] if batch.num_rows else []
            for at, after in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                rows = batch.slice(at, after - at)
                words, counts = split_words(rows.column(1))
                ids = rows.column(0)
                waiting.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype("u1"), rows.column(2).to_numpy(zero_copy_only=False).astype("u1"), counts, words))
                size += counts.sum() + len(counts)
                if size >= tokens:
                    yield out()
        if waiting:
            yield out()

    crc = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_of().alias("text"), (crc % modulus == held).cast("tinyint").alias("held"))
    return save_bucketed(rows.mapInArrow(cut, SLICE_SCHEMA), "slices", "slice")


def sum_by_key(df: DataFrame, give: Callable[[dict], tuple[np.ndarray, np.ndarray]], width: int, name: str, buckets: int, keep: Callable[[np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """For each row (a slice) of ``df``: ``width`` values of each of its keys, summed over all slices.

    ``give`` makes sorted distinct keys and their values from a row. Keys are
    dealt to buckets by their first bits, so that a slice's keys of a bucket
    stay together and in order, and no key has more than one row for a slice.
    Gives answers (slice, parts: the sums in the order of the slice's keys and a
    further number, 1 where the slice is the first to have the key, else 0; saved
    in buckets of slice) and totals (counts: how many keys have the first sum 1,
    2, ..., how many more than 0, and the sum of all). A table of the keys whose
    sums ``keep`` takes stays as a part of the model (bucket, data: keys, more: sums).
    With ``finish`` the last value is not summed: the largest of its
    halves is taken, and what ``finish`` makes of all takes the place of the sums and of the
    further number; a slice gets their signs, and the rest for those of its keys
    whose last value is odd.
    """
    bits = max(1, int(np.ceil(np.log2(max(buckets, 1)))))
    columns = df.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_py() for i, c in enumerate(columns)}
                keys, values = give(row)
                edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(1 << bits, dtype=np.uint64))
                edges = np.r_[edges, len(keys)]
                used = np.flatnonzero(np.diff(edges)).tolist()
                own = [slice(edges[b], edges[b + 1]) for b in used]
                data = [used, [row["slice"]] * len(used), [pack_keys(keys[x]) for x in own], [pack_numbers(values[:, x]) for x in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["bucket", "slice", "data", "more"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64())]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            own = [unpack_keys(r[2]) for r in rows]
            values = np.concatenate([unpack_numbers(r[3], width) for r in rows], axis=1)
            asked = values[-1] % 2 > 0 if finish else np.ones(values.shape[1], bool)
            keys, place, order, starts = distinct(np.concatenate(own))
            values = values[:, order]
            sums = np.add.reduceat(values, starts, axis=1)
            if finish:
                sums[-1] = np.maximum.reduceat(values[-1] // 2, starts)
            stored = keep(sums)
            sums = finish(sums) if finish else sums
            owned = np.zeros((0 if finish else 1, len(place)))
            owned[:, order[starts]] = 1
            bucket, at, made = rows[0][0], 0, []
            for r, n in zip(rows, map(len, own), strict=True):
                own_sums, own_first = sums[:, place[at : at + n]], owned[:, at : at + n]
                made.append(("answer", bucket, r[1], pack_weights(own_sums[0], asked[at : at + n]) if finish else pack_numbers(np.concatenate([own_sums, own_first])), None, None))
                at += n
            made.append(("table", bucket, None, pack_keys(keys[stored]), pack_numbers(sums[:, stored]), None))
            if not finish:
                some = np.bincount(np.minimum(sums[0], DISCOUNTED + 2).astype(np.int64), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
                made.append(("total", bucket, None, None, None, [*some.tolist(), (sums[0] > 0).sum(), sums[0].sum()]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=["kind", "bucket", "slice", "data", "more", "counts"])

        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield out(held)
                    held = []
                held.append(r)
        if held:
            yield out(held)

    schema = "kind string, bucket int, slice long, data binary, more binary, counts array<double>"
    dealt = df.mapInArrow(deal, "bucket int, slice long, data binary, more binary")
    dealt = dealt.repartitionById(1 << bits, F.col("bucket")).sortWithinPartitions("bucket", "slice")
    path = new_path(df.sparkSession, name)
    write(dealt.mapInArrow(merge, schema), path, "kind")
    made = df.sparkSession.read.schema(schema).parquet(path)
    answered = made.where("kind = 'answer'").groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("bucket", "data"))).alias("parts"))
    answered = save_bucketed(answered.select("slice", F.transform("parts", lambda x: x["data"]).alias("parts")), f"answers-{name}", "slice")
    drop_folder(df.sparkSession, f"{path}/kind=answer")
    return answered, made.where("kind = 'total'").select("counts")


def sums_of(parts: list[bytes] | None, width: int) -> np.ndarray:
    return np.concatenate([unpack_numbers(x, width) for x in parts], axis=1) if parts else np.empty((width, 0))


def count_of_counts(totals: DataFrame) -> np.ndarray:
    """How many n-grams have count 1, 2, ... DISCOUNTED + 1, how many have any, and all their occurrences."""
    summed = totals.select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()  # one row for each number
    out = np.zeros(DISCOUNTED + 3)
    for r in summed:
        out[r["k"]] = r["n"]
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discount ratios for counts 0 to DISCOUNTED + 1 (1 for the last and all larger), after Katz.

    ``n[r - 1]``: how many have count r. Where these give no ratio between 0 and
    1 (sparse counts), r - D over r takes its place, D being n1 / (n1 + 2 n2), or a half.
    """
    k = DISCOUNTED
    out = np.ones(k + 2)
    r = np.arange(1, k + 1)
    with np.errstate(all="ignore"):
        far = (k + 1) * n[k] / n[0]
        ratio = ((r + 1) * n[1 : k + 1] / n[:k] / r - far) / (1 - far)
    if not (np.isfinite(ratio).all() and (ratio > 0).all() and (ratio < 1).all()):
        d = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        ratio = 1 - d / r
    out[1 : k + 1] = ratio
    return out


class Katz:
    """What the whole corpus says: how many training texts and tokens, and the discounts of n-grams of each length."""

    def __init__(self, texts: int):
        self.texts, self.total, self.distinct, self.unknown = texts, 0.0, 0.0, 1.0
        self.ratios: dict[int, np.ndarray] = {}

    def learn(self, n: int, counts: np.ndarray) -> None:
        """``counts``: of n-grams, as ``count_of_counts`` has them."""
        if n == 1:
            self.distinct, self.total = counts[-2:]
        else:  # each token ends one n-gram, so what is missing was not asked for and came once
            counts = np.r_[self.total - (np.arange(2, DISCOUNTED + 2) * counts[1 : DISCOUNTED + 1]).sum() - self._over(counts), counts[1:]]
        self.ratios[n] = discounts(counts)
        self.ratios[n][: least_count(n)] = 0
        if n == 1 and self.total:
            freed = sum(counts[r - 1] * r * (1 - self.ratios[1][r]) for r in range(1, DISCOUNTED + 1))
            self.unknown = freed / self.total
            if not 0 < self.unknown < 1:  # no count is small enough to be discounted
                self.ratios[1], self.unknown = self.ratios[1] * self.total / (self.total + 1), 1 / (self.total + 1)

    @staticmethod
    def _over(counts: np.ndarray) -> float:
        """Occurrences of n-grams that come more than DISCOUNTED + 1 times."""
        return counts[-1] - (np.arange(1, DISCOUNTED + 2) * counts[: DISCOUNTED + 1]).sum()

    def discounted(self, n: int, counts: np.ndarray) -> np.ndarray:
        return self.ratios[n][np.minimum(counts, DISCOUNTED + 1).astype(int)] * counts

    def word(self, counts: np.ndarray) -> np.ndarray:
        """The probability of words with these counts."""
        return np.where(counts > 0, self.discounted(1, counts) / max(self.total, 1), self.unknown)


def backoff(sums: np.ndarray) -> np.ndarray:
    """A history's weight of words that never followed it.

    Rows of ``sums``: of all that follows it in the model, the sum of discounted
    counts and that of the probabilities after one word less; how often it came. A
    history whose counts leave nothing gets one more observation, which goes to
    the unseen; its weight is stored below zero. All are doubles: a weight is
    right to about 1e-16 over the share of the unseen.
    """
    held, seen, history = sums
    left = history - held
    none = left <= 1e-9 * np.maximum(history, 1)
    weight = np.where(none, -1, left) / (np.maximum(history, 1) + none) / np.maximum(1 - seen, np.finfo(float).eps)
    return np.where(history > 0, weight, 1)[None]


def score(docs: DataFrame, modulus: int = 7, held: int = 2, tokens: int = TOKENS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text).

    The model learns n-grams of up to ``order`` words from the rows that are not
    held out and scores all. Null texts count as empty: one end token. Null and
    repeated ids, repeated rows and long texts are rows like any other; extra columns
    are not read; an empty table gives no rows. Without training rows every token is
    unknown and has probability 1. The model stays in the shared folder: of each
    length a table of n-grams and counts, and of all but the longest one of the
    histories that any follow and their weights, parted by the first bits of the keys.
    """
    spark = docs.sparkSession
    cut = slices(docs, tokens, modulus, held)
    buckets = -(-cut.count() // BUCKET)
    crc = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    model = Katz(only(docs, "doc_id").where(crc % modulus != held).count())
    before = batches_of(spark, 1)  # a row is a whole slice from here on
    known, saved = cut, [cut]
    try:
        for n in range(1, order + 1):
            found, totals = sum_by_key(known, lambda row, n=n: Slice(row, model).counted(n), 1, f"grams{n}", buckets, lambda sums, n=n: sums[0] >= least_count(n))
            saved.append(found)
            model.learn(n, count_of_counts(totals))
            known = known.join(found.withColumnRenamed("parts", f"c{n}"), "slice", "left")
            if n > 1:
                found, _ = sum_by_key(known, lambda row, n=n: Slice(row, model).left(n - 1), 3, f"histories{n - 1}", buckets, lambda sums: sums[0] > 0, backoff)
                saved.append(found)
                known = known.join(found.withColumnRenamed("parts", f"h{n - 1}"), "slice", "left")

        def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    own = Slice({c: batch.column(i)[k].as_py() for i, c in enumerate(batch.schema.names)}, model)
                    counts, p = own.counts(1)[:-1], own.probability(order)[:-1]
                    base = np.log10((counts + 1) / (model.total + model.distinct + 1))
                    by = lambda x: np.bincount(own.owner, weights=x, minlength=len(own.ids))  # noqa: B023, E731
                    n, n_known = by(None).astype(np.int64), by(counts > 0).astype(np.int64)
                    columns = [pa.array(own.ids, mask=own.null), pa.array(own.held), pa.array(n), pa.array(n_known), pa.array(np.full(len(n), int(model.total))), pa.array(by(base)), pa.array(by(np.log10(p)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        scored = save(known.mapInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores")
    finally:
        batches_of(spark, int(before))
    for df in saved:
        drop_bucketed(df)
    return scored


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
