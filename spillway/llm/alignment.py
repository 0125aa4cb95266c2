"""Two tokenizers' tokens of the same text, aligned by the owners of its bytes."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.llm.common import drop_saved, new_path, only, save, table, text_of, write
from spillway.llm.tokens import BAR, CUT, PIECES_KEPT, Known, WordEncoder, id_lists, in_slices

SPACE = "▁"
#: Pairs of ids with counts that go to every worker, 16 bytes each; beyond it links are joined with their counts.
MAX_PAIRS = 3_000_000
#: Characters of text aligned at once, pairs that a task counts before it gives them out.
SLICE, COUNTED = 1 << 20, 1_000_000
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class ByteStrings:
    """Byte strings by number, in one array, so that many can be put after each other at once."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.lengths[numbers]
        shift = self.starts[numbers] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(lengths.sum())]


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class ByteLevelSide:
    """Tokens of a byte-level vocabulary file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.encoder = WordEncoder(path, True)
        names, alphabet = self.encoder.tokenizer.get_vocab(with_added_tokens=True), byte_level_alphabet()
        entries = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            entries[k] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        self.entries = ByteStrings(entries)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(texts)


class PieceSide:
    """Tokens of a piece model that puts a space first. No piece has a space after another character, so that words are encoded apart."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = self.model.id_to_piece(list(range(len(self.model))))
        if any(SPACE in x.lstrip(SPACE) for x in pieces):
            raise ValueError(f"{path} has pieces that go over a word's start")
        bytes_of = lambda k, x: bytes.fromhex(_BYTE.fullmatch(x)[1]) if self.model.is_byte(k) else x.replace(SPACE, " ").encode()
        self.entries = ByteStrings([bytes_of(k, x) for k, x in enumerate(pieces)])
        self.known = Known(PIECES_KEPT)
        self.space = self.model.piece_to_id(SPACE)

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of each word, its first space put by the model; of one space alone, which ends a text, the model would make nothing."""
        words = words.to_pylist()
        ids = self.model.encode([x[1:] for x in words], num_threads=1)
        return id_lists([[self.space] if x == " " else own for x, own in zip(words, ids, strict=True)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with the space that the model would put there, and where each text's ids end."""
        whole = [BAR in x for x in texts]
        parts = pc.split_pattern(pa.array(["" if w else CUT.sub(lambda m: BAR if m.string[m.start()] == " " else "", x) for w, x in zip(whole, texts, strict=True)], pa.large_string()), BAR)
        coded = parts.flatten().dictionary_encode()
        known = self.known.ids_of(coded.dictionary, self._words)
        odd = id_lists(self.model.encode([x[1:] for w, x in zip(whole, texts, strict=True) if w], num_threads=1))
        codes, ends = coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy()[1:].astype(np.int64)
        codes[ends[np.array(whole, bool)] - 1] = len(known) + np.arange(sum(whole))
        found = pa.concat_arrays([known, odd]).take(pa.array(codes))
        return found.flatten().to_numpy(), found.offsets.to_numpy()[ends]


_SIDES: dict[tuple[str, str], tuple[ByteLevelSide, PieceSide]] = {}


def sides(vocabulary: str, model: str) -> tuple[ByteLevelSide, PieceSide]:
    """Both tokenizers, once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (vocabulary, model) not in _SIDES:
        _SIDES[vocabulary, model] = ByteLevelSide(vocabulary), PieceSide(model)
    return _SIDES[vocabulary, model]


def fitting(ids: np.ndarray, ends: np.ndarray, entries: ByteStrings, data: np.ndarray, data_ends: np.ndarray) -> np.ndarray:
    """For each text whether its tokens' bytes are its own."""
    size = np.r_[0, np.cumsum(entries.lengths[ids])][ends]
    same = np.diff(size, prepend=0) == np.diff(data_ends, prepend=0)
    joined, first, own = entries.joined(ids), np.r_[0, size[:-1]], np.r_[0, data_ends[:-1]]
    if same.all():
        wrong = np.r_[0, np.cumsum(joined != data)]
        return wrong[data_ends] == wrong[own]
    return np.array([s and np.array_equal(joined[f:g], data[o:e]) for s, f, g, o, e in zip(same, first, size, own, data_ends, strict=True)], bool)


def owners(ids: np.ndarray, entries: ByteStrings) -> np.ndarray:
    """For each byte the place of the token that it belongs to."""
    return np.repeat(np.arange(len(ids), dtype=np.int32), entries.lengths[ids])


class Aligned:
    """Texts in a row under two tokenizers: their cuts, groups and links.

    ``cuts`` are the byte places where both owners change at once, that is where
    a token of each side ends; every text ends with one. A link is a pair of
    tokens that end together (``link`` "end") or share a byte ("overlap").
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, one: ByteStrings, two: ByteStrings, link: str = "end"):
        own_a, own_b = owners(a, one), owners(b, two)
        turn_a, turn_b = (np.r_[x[1:] != x[:-1], np.ones(min(1, len(x)), bool)] for x in (own_a, own_b))
        self.cuts = np.flatnonzero(turn_a & turn_b)
        at = self.cuts if link == "end" else np.flatnonzero(turn_a | turn_b)
        self.a, self.b, self.places = a, b, at
        self.link_a, self.link_b = own_a[at], own_b[at]
        self.last_a, self.last_b = own_a[self.cuts], own_b[self.cuts]

    def digests(self, group_ends: np.ndarray, numbers: ByteStrings) -> list[str]:
        """The hash of each text's groups as text; ``group_ends``: the groups up to each text's end. ``numbers``: three strings for each id, ended by a comma, a bar and a semicolon."""
        groups = np.arange(len(self.cuts))
        group_a = np.repeat(groups, np.diff(self.last_a, prepend=-1))
        group_b = np.repeat(groups, np.diff(self.last_b, prepend=-1))
        items = np.empty(len(self.a) + len(self.b), np.int64)
        before_b, upto_a = np.r_[-1, self.last_b[:-1]] + 1, self.last_a + 1
        mark_a, mark_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        mark_a[self.last_a], mark_b[self.last_b] = 1, 2
        items[np.arange(len(self.a)) + before_b[group_a]] = self.a.astype(np.int64) * 3 + mark_a
        items[np.arange(len(self.b)) + upto_a[group_b]] = self.b.astype(np.int64) * 3 + mark_b
        text = numbers.joined(items).tobytes()
        size = np.r_[0, np.cumsum(numbers.lengths[items])]
        tokens = np.r_[0, self.last_a + self.last_b + 2]
        ends = size[tokens[group_ends]].tolist()
        return [hashlib.sha256(text[f : e - 1]).hexdigest() if e > f else "" for f, e in zip([0, *ends], ends, strict=False)]


def align(docs: DataFrame, vocabulary: str, model: str, link: str = "end") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) for each row of ``docs`` (doc_id, text).

    Side A encodes a space and the text by the byte-level ``vocabulary``, side B
    the text by the piece ``model``, which puts the space itself. ``links`` holds
    8 bytes for each link, in order: A's id in the upper half, B's in the lower.
    A null or empty text, and one whose bytes either side does not give back,
    has no tokens. Texts may be of any length; repeated rows and ids are texts of
    their own, a null id stays null, other columns are not read. ``row`` numbers
    the rows.
    """
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sides(vocabulary, model)
        most = max(len(one.entries.lengths), len(two.entries.lengths))
        numbers = ByteStrings([b"%d%c" % (k, mark) for k in range(most) for mark in b",|;"])
        for batch in batches:
            rows, ids, texts = (c.to_pylist() for c in batch.columns)
            for start, stop in in_slices(texts, SLICE):
                own = [f" {x}" if x else "" for x in texts[start:stop]]
                for _ in range(2):  # the second time without the texts that a side does not give back
                    data_ends = np.cumsum([len(x.encode()) for x in own])
                    data = np.frombuffer("".join(own).encode(), np.uint8)
                    (a, ends_a), (b, ends_b) = one.encode(own), two.encode(own)
                    right = fitting(a, ends_a, one.entries, data, data_ends) & fitting(b, ends_b, two.entries, data, data_ends)
                    if right.all():
                        break
                    own = [x if ok else "" for x, ok in zip(own, right, strict=True)]
                found = Aligned(a, b, one.entries, two.entries, link)
                group_ends, link_ends = (np.searchsorted(x, data_ends) for x in (found.cuts, found.places))
                pairs = (a[found.link_a].astype("<u8") << np.uint64(32) | b[found.link_b].astype("<u8")).tobytes()
                cut = lambda ends: np.diff(ends, prepend=0).tolist()
                links = [pairs[8 * f : 8 * e] for f, e in zip([0, *link_ends.tolist()], link_ends.tolist(), strict=False)]
                columns = [rows[start:stop], ids[start:stop], cut(ends_a), cut(ends_b), cut(group_ends), cut(link_ends), found.digests(group_ends, numbers), links]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    numbered = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text_of().alias("text"))
    return numbered.mapInArrow(work, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary")


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate(pairs), np.concatenate(counts)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[starts], np.add.reduceat(n[order], starts) if len(starts) else n


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, n, best): the links of each pair of ids over all texts, and whether no pair of the same B id has more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["pair", "n"])
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
            new, n = np.unique(flat, return_counts=True)
            keys, counts = _merged([keys, new], [counts, n.astype(np.int64)])
            if len(keys) > COUNTED:
                yield rows(keys, counts)
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield rows(keys, counts)

    summed = aligned.select("links").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    split = save(summed.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n"), "pairs")
    return split.join(split.groupBy("b").agg(F.max("n").alias("_most")), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("_most")).alias("best"))


def with_counts(aligned: DataFrame, pairs: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``aligned`` without its links, with ``n_best`` (links whose pair is the best of its B id) and ``count_sum`` (the counts of all links' pairs).

    ``pairs``: the saved result of ``pair_counts``. While it has ``max_pairs``
    rows at most, it goes to the workers; beyond it each text's distinct pairs
    are joined with it.
    """
    spark, columns = aligned.sparkSession, [c for c in aligned.columns if c != "links"]
    if pairs.limit(max_pairs + 1).count() <= max_pairs:
        found = pairs.select("pair", "n", "best").orderBy("pair").toPandas()
        known = spark.sparkContext.broadcast((found["pair"].to_numpy(np.int64), found["n"].to_numpy(np.int64), found["best"].to_numpy(bool)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, best = known.value
            for batch in batches:
                links = batch.column(batch.num_columns - 1).to_pylist()
                at = np.searchsorted(keys, np.frombuffer(b"".join(links), "<i8"))
                ends = np.cumsum([len(x) // 8 for x in links])
                sums = [np.diff(np.r_[0, np.cumsum(x[at])][ends], prepend=0) for x in (best.astype(np.int64), n)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, sums)], names=[*columns, "n_best", "count_sum"])

        kinds = ", ".join(f"{c} {t}" for c, t in aligned.select(columns).dtypes)
        return aligned.select(*columns, "links").mapInArrow(work, f"{kinds}, n_best long, count_sum long")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, times = np.unique(np.frombuffer(links, "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array(keys), pa.array(times.astype(np.int64))], names=["row", "pair", "times"])

    own = aligned.select("row", "links").where("n_links > 0").mapInArrow(distinct, "row long, pair long, times long")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    sums = own.join(pairs.select("pair", "n", "best"), "pair").groupBy("row").agg(best, F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return aligned.select(columns).join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def op11_byte_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = save(align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")), "aligned")
    out = with_counts(aligned, save(pair_counts(aligned), "counts"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
