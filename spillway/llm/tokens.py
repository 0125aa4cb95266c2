"""Token ids of whole texts, with each distinct word encoded once per worker.

Neither kind of vocabulary lets a token cross from a non-space to a following
space, so a text may be cut there: its ids are those of its parts in a row.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where a text may be cut: before a space or line break that follows no white space.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
DOUBLE = re.compile(r"\s[ \n]")
BAR = "\x00"
#: Letters up to U+017F, and ASCII punctuation but the apostrophe, which may begin a contraction.
LETTERS = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}"
MARKS = r"!-&(-/:-@\[-`{-~"
#: Letters end a token before marks.
MARKED = rf"(?s)^(?P<core>.*[{LETTERS}])(?P<marks>[{MARKS}]+)$"
#: A line break before ASCII is a token of its own.
BROKEN = r"^\n[!-~]"
#: What may be lower-cased before it is encoded; U+0130 has a small letter of two characters.
LATIN = r"^[\x{0}-\x{12f}\x{131}-\x{17f}]*$"
TWO_LETTERS = "\u0130"
WORDS_KEPT, PIECES_KEPT = 150_000, 450_000
LONGEST_KEPT = 64


def id_lists(ids: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
    return pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(sizes)], flat)


class Known:
    """Texts met and the ids of each, up to a bound: common ones come early, and what comes when all is full is encoded again."""

    def __init__(self, most: int):
        self.most, self.texts, self.ids = most, pa.array([], pa.large_string()), id_lists([])

    def ids_of(self, texts: pa.Array, make: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """A list of ids for each of ``texts`` (distinct); ``make`` gives those of the ones not met."""
        place = pc.index_in(texts, value_set=self.texts)
        unmet = pc.is_null(place)
        new = texts.filter(unmet)
        fresh = make(new)
        found = pa.concat_arrays([self.ids, fresh])
        codes = place.fill_null(0).to_numpy().astype(np.int64)
        codes[unmet.to_numpy(zero_copy_only=False)] = len(self.ids) + np.arange(len(new))
        if len(self.texts) < self.most:
            short = pc.less_equal(pc.utf8_length(new), LONGEST_KEPT)
            self.texts, self.ids = pa.concat_arrays([self.texts, new.filter(short)]), pa.concat_arrays([self.ids, fresh.filter(short)])
        return found.take(pa.array(codes))


class WordEncoder:
    """Ids (unsigned 32-bit) by the ``tokenizers`` library from a vocabulary file.

    ``keeps_space``: a space is part of the word that follows it (byte-level
    vocabularies); otherwise white space only separates and case is dropped.
    ``added``: a text's vocabulary tokens such as <|endoftext|> give their ids,
    as the library has it unless told otherwise; without it they are plain text.
    """

    def __init__(self, path: str, keeps_space: bool, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        names = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.lead = re.match("[^A-Za-z]*", os.path.commonprefix(names))[0]
        self.added = re.compile("|".join(map(re.escape, names)), re.IGNORECASE) if names else None
        self.keeps_space = keeps_space
        self.words, self.pieces = Known(WORDS_KEPT), Known(PIECES_KEPT)

    def _whole(self, text: str) -> bool:
        """Whether a text is encoded at once: it has the bar or, in any case of letters (words are lower-cased before they are encoded), an added token."""
        return BAR in text or self.added is not None and self.lead in text and self.added.search(text) is not None

    def _barred(self, text: str) -> str:
        """The text with a bar wherever it is cut."""
        if not self.keeps_space:
            return text.replace("\n", BAR).replace(" ", BAR)
        if DOUBLE.search(text):
            return CUT.sub(BAR, text)
        return text.replace("\n", BAR + "\n").replace(" ", BAR + " ")

    def _by_library(self, texts: pa.Array) -> pa.Array:
        return id_lists([x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])

    def _by_pieces(self, words: pa.Array) -> pa.Array:
        """Ids of words from those of their pieces: a leading line break, the letters, the marks behind them."""
        flags = lambda x: x.to_numpy(zero_copy_only=False)
        broken = np.zeros(len(words), bool)
        if self.keeps_space:
            broken = flags(pc.match_substring_regex(words, BROKEN)) & ~flags(pc.match_substring(words, TWO_LETTERS))
            if broken.any():
                words = pc.if_else(pa.array(broken), pc.utf8_slice_codeunits(words, 1), words)
        else:
            words = pc.if_else(pc.match_substring_regex(words, LATIN), pc.utf8_lower(words), words)
        split = pc.extract_regex(words, MARKED)
        marked = flags(pc.is_valid(split)) & ~flags(pc.match_substring(words, TWO_LETTERS))
        heads = pc.if_else(pa.array(marked), split.field("core"), words)
        marks = split.field("marks").filter(pa.array(marked))
        pieces = pa.concat_arrays([pa.array(["\n"] * int(broken.sum()), pa.large_string()), heads, marks.cast(pa.large_string())]).dictionary_encode()
        owner = np.r_[np.flatnonzero(broken), np.arange(len(words)), np.flatnonzero(marked)]
        codes = pieces.indices.to_numpy()[np.argsort(owner, kind="stable")]
        ids = self.pieces.ids_of(pieces.dictionary, self._by_library).take(pa.array(codes))
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        return pa.LargeListArray.from_arrays(ids.offsets.to_numpy()[np.r_[0, ends]], ids.flatten())

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by ``end_id`` if given, and where each text's ids end."""
        whole = {k: x for k, x in enumerate(texts) if self._whole(x)}
        parts = pc.split_pattern(pa.array(["" if k in whole else self._barred(x) for k, x in enumerate(texts)], pa.large_string()), BAR)
        coded = parts.flatten().dictionary_encode()
        lists = [self.words.ids_of(coded.dictionary, self._by_pieces), self._by_library(pa.array(whole.values(), pa.large_string())), id_lists([] if end_id is None else [[end_id]])]
        codes, ends = coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy()[1:].astype(np.int64)
        codes[ends[list(whole)] - 1] = len(lists[0]) + np.arange(len(whole))  # the one empty part that stands for it
        if end_id is not None:
            codes = np.insert(codes, ends, len(lists[0]) + len(whole))
            ends = ends + np.arange(1, len(ends) + 1)
        found = pa.concat_arrays(lists).take(pa.array(codes))
        out = found.flatten().to_numpy(), found.offsets.to_numpy()[ends]
        pa.default_memory_pool().release_unused()  # Arrow keeps what it has freed, and workers outlive their tasks
        return out


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """One encoder for each Python worker, with the words it has met."""
    if (path, keeps_space) not in _ENCODERS:
        _ENCODERS[path, keeps_space] = WordEncoder(path, keeps_space, added=True)
    return _ENCODERS[path, keeps_space]


def in_slices(texts: list[str], chars: int = 1 << 22):
    """Ranges of rows of about ``chars`` characters each."""
    start = size = 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
