"""Alignment, exact search and phrases against plain code over odd rows, ties, repeated rows, long texts and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spillway.llm import alignment, common, phrases, queries, topk

EXTRA = "_key string, row long, links binary, key binary, n long, v double, length int, rank int, score double, word string"
FILL = ("k", 1, b"x", b"y", 2, 0.5, 3, 4, 1.5, "w")


def table(spark, rows, columns, parts=3):
    return spark.createDataFrame([(*r, *FILL) for r in rows], f"{columns}, {EXTRA}").repartition(parts)


# Alignment


def bytes_of_entry():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {chr(b if b in printable else next(others)): b for b in range(256)}


def aligned_by_hand(docs):
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, out, counts = bytes_of_entry(), [], collections.Counter()
    for doc, text in docs:
        whole = (" " + (text or "")).encode()
        a = a_side.encode(" " + (text or ""), add_special_tokens=False)
        a_ids, a_bytes = a.ids, [bytes(letters[c] for c in t) for t in a.tokens]
        b_ids = b_side.encode(text or "")
        b_bytes = [bytes.fromhex(m[1]) if (m := re.fullmatch("<0x(..)>", p)) else p.replace("▁", " ").encode() for p in b_side.encode(text or "", out_type=str)]
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append((doc, 0, 0, [], ""))
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes)]
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            first = i, j
            while i < len(ends[0]) and ends[0][i] <= cut:
                i += 1
            while j < len(ends[1]) and ends[1][j] <= cut:
                j += 1
            groups.append(",".join(map(str, a_ids[first[0] : i])) + "|" + ",".join(map(str, b_ids[first[1] : j])))
            links.append((a_ids[i - 1], b_ids[j - 1]))
        counts.update(links)
        out.append((doc, len(a_ids), len(b_ids), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(d, na, nb, len(x), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), sha) for d, na, nb, x, sha in out]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéßñ漢🙂'") for _ in range(rng.randint(1, 8)))
    prose = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(30)]
    odd = ["", None, " ", "   ", "\n", "a  b\t\tc \n d", "x▁y z", "▁", "<|endoftext|> it's <s> </s> <unk> <0x41>", "a\x00b c", "　wide space", "tail  ", "é ﬁ ①", "<0x0A> \n\n\n x", "1234567890 12,345.67"]
    long = " ".join(word() for _ in range(30000))
    return [*enumerate(prose + odd), (100, prose[0]), (100, prose[0]), (None, prose[1]), (None, None), (101, long)]


def test_alignment_equals_plain_code(spark, texts):
    docs = table(spark, texts, "doc_id long, text string")
    want = sorted(map(repr, aligned_by_hand(texts)))
    aligned = common.save(alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")), "aligned")
    pairs = common.save(alignment.pair_counts(aligned), "counts")
    for most in (alignment.MAX_PAIRS, 0):  # the counts go to the workers, or are joined
        got = alignment.with_counts(aligned, pairs, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted(map(repr, map(tuple, got.collect()))) == want
    assert any("0, 0, 0, 0, 0, 0, ''" in x for x in want) and pairs.where("best").select("b").distinct().count() == pairs.select("b").distinct().count()


def test_alignment_of_texts_that_end_with_a_space(spark):
    """One space after a word has a token of its own; side B may not lose it, nor the text with it."""
    docs = list(enumerate(["hello ", "a b ", " ", "  ", "word  ", "line\n ", "tab\t ", "a\xa0 ", "x\x00 ", "</s> ", "hello", " hello ", "日本 ", "▁ ", "a\x1f "]))
    aligned = common.save(alignment.align(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")), "aligned")
    got = alignment.with_counts(aligned, common.save(alignment.pair_counts(aligned), "counts"))
    got = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(aligned_by_hand(docs))


def test_alignment_overlaps():
    """Without the rule of ends, all pairs of tokens that share a byte are links."""
    rng = np.random.default_rng(3)
    one, two = (alignment.ByteStrings([b"x" * k for k in range(1, 6)]) for _ in range(2))
    for _ in range(50):
        a, b = rng.integers(0, 5, 40).astype(np.uint32), rng.integers(0, 5, 40).astype(np.uint32)
        size = min(one.lengths[a].sum(), two.lengths[b].sum())
        a, b = (x[np.cumsum(s.lengths[x]) <= size] for x, s in ((a, one), (b, two)))
        a, b = (np.r_[x, np.zeros(int(size - s.lengths[x].sum()), np.uint32)] for x, s in ((a, one), (b, two)))
        spans = [[(e - n, e) for e, n in zip(np.cumsum(s.lengths[x]).tolist(), s.lengths[x].tolist(), strict=True)] for x, s in ((a, one), (b, two))]
        want = {(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if max(x[0], y[0]) < min(x[1], y[1])}
        found = alignment.Aligned(a, b, one, two, "overlap")
        assert set(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == want and len(found.link_a) == len(want)
        assert (found.cuts + 1).tolist() == sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})


# Exact search


def searched_by_hand(rows, every=50, top=5):
    whole = []
    for at, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(256 * x) for x in v):
            whole.append((at, i, [math.floor(256 * x) if abs(x) < 2**44 else int(256 * x) for x in v]))
    end, out = 2**63 - 1, []
    for at, i, q in whole:
        if i is None or i % every:
            continue
        scores = [(-max(-end, min(end, sum(x * y for x, y in zip(q, p, strict=False)))), j is None, j or 0, a, j) for a, j, p in whole if a != at]
        out += [(i, k + 1, x[4], -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return sorted(map(repr, out))


def searched(spark, rows, **how):
    df = table(spark, rows, "vec_id long, embedding array<double>")
    return sorted(map(repr, (tuple(r) for r in topk.top_products(df, **how).collect())))


@pytest.mark.parametrize("spread", ["alike", "lengths", "clusters"])
def test_search_equals_brute_force(spark, spread):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(700, 12))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    if spread == "lengths":
        m *= np.exp(rng.normal(size=(700, 1)) * 2)
    if spread == "clusters":
        m = np.repeat(m[:35], 20, axis=0) + rng.normal(size=(700, 12)) * 0.02
    rows = list(enumerate(m.tolist()))
    assert searched(spark, rows, bucket_rows=64, query_rows=4) == searched_by_hand(rows)


def test_search_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(120)]
    rows += [(k, rows[0][1]) for k in range(120, 200)] + [(50, rows[0][1]), (50, rows[3][1]), (None, rows[0][1]), (None, rows[0][1])]  # copies, repeated and null ids
    rows += [(300, None), (350, [None, 1.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, []), (550, [0.0] * 6), (600, [0.5, 0.25]), (650, [1e9] * 6), (700, [-1e9] * 6), (701, [3e15, 0.1]), (750, [1e300, -1e300, 1.0])]
    assert searched(spark, rows, bucket_rows=16, query_rows=3) == searched_by_hand(rows)
    assert searched(spark, rows[:3]) == searched_by_hand(rows[:3]) and searched(spark, rows[:1]) == []


def test_search_rules_out_by_length_and_coordinates():
    """The cosine that a bucket must beat rules it out, or bounds lengths or coordinates; none of it changes results."""
    rng = np.random.default_rng(4)
    v = np.floor(256 * (np.repeat(rng.normal(size=(30, 8)), 40, axis=0) * np.repeat(np.exp(rng.normal(size=(300, 1)) * 0.3), 4, axis=0) + rng.normal(size=(1200, 8)) * 0.01))
    lengths = np.linalg.norm(v, axis=1)
    order = np.argsort(-lengths)
    v, lengths = v[order], lengths[order]

    def block(at):
        own = lambda x, t: x.astype(t).tobytes()
        return topk.Block(len(at), own(np.stack([at, at]), "<i8"), bytes([1]) * len(at), own(lengths[at], "<f8"), own(v[at], "<f8"))

    best = topk.Best(block(np.arange(0, 1200, 50)), 5)
    for start in range(0, 1200, 100):
        best.through(block(np.arange(start, start + 100)))
    assert min(best.tried.values()) > 0
    for k, q in enumerate(best.q.rows.tolist()):
        scores = v @ v[q]
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        assert [(-s, i) for s, i in zip(best.scores[k].tolist(), best.ids[k].tolist(), strict=True)] == want


# Phrases


def mined_by_hand(rows, least, max_words=5, keep=2000, percent=100):
    pieces = collections.defaultdict(list)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        pieces["und" if lang is None else lang] += [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]
    out = []
    for lang, own in pieces.items():
        n, f = sum(map(len, own)), collections.Counter()
        for p in own:
            f.update(tuple(p[i : i + k]) for i in range(len(p)) for k in range(1, max_words + 1) if i + k <= len(p))
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, x: any(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1))
        found = []
        for p, a in frequent.items():
            if any(len(x) > len(p) and 100 * b >= percent * a and inside(p, x) for x, b in frequent.items()):
                continue
            score, cut = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]], n))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r, n) in enumerate(sorted(found)[:keep])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(9)
    words = ["the", "The", "of", "a", "é", "É", "b.", "x\x01", "x", "漢", "und", "in to"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" "] * 9 + ["  ", "\t", ", ", "\n", " ! ", ":", "\r"]) for _ in range(n))
    rows = [(rng.choice(["en", "en", "en", "de", None, ""]), text(rng.randint(0, 90))) for _ in range(150)]
    line = "one common line of seven words here. "
    rows += [("en", line * 30)] * 5 + [("en", "new york city new york city")] * 20  # a hot line, copies
    return rows + [("en", None), (None, None), ("en", ""), ("fr", " \n"), ("en", text(30000)), ("und", "the of the of the of")]


def mined(spark, rows, **how):
    df = table(spark, rows, "lang string, text string")
    return sorted(tuple(r) for r in phrases.mine_phrases(df, **how).collect())


@pytest.mark.parametrize(("least", "how"), [(3, {}), (12, {"max_numbered": 0}), (12, {"max_pairs": 0}), (5, {"keep": 7, "max_words": 3}), (3, {"closed_percent": 60})])
def test_phrases_equal_plain_code(spark, prose, least, how):
    want = mined_by_hand(prose, least, how.get("max_words", 5), how.get("keep", 2000), how.get("closed_percent", 100))
    assert want and mined(spark, prose, least=least, **how) == want


def test_prefix_stack_over_any_cut():
    """Counts of prefixes are the same however the sorted suffixes are cut into batches and runs."""
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 4, size=(400, 4)).astype(np.uint8) * np.logical_and.accumulate(rng.random((400, 4)) < 0.8, 1)
    rows = rows[rows[:, 1] > 0]
    rows = rows[np.lexsort(rows.T[::-1])][::-1]
    want = collections.Counter(bytes(r[:k]) for r in rows for k in range(2, 5) if r[k - 1])
    for trial in range(20):
        edges = np.unique(np.r_[0, rng.integers(0, len(rows), rng.integers(0, 12)), len(rows)])
        runs, got = np.unique(rng.choice(edges, 3)), collections.Counter()
        stack = phrases.PrefixStack(1, 4, 6)
        found = []
        for f, e in zip(edges, edges[1:], strict=False):
            if f in runs:
                found += stack.end()
                stack = phrases.PrefixStack(1, 4, 6)
            found += stack.push(rows[f:e], np.ones(e - f, np.int64))
        for key, n in found + stack.end():
            got[key] += n
        assert {k: n for k, n in got.items() if n >= 6} == {k: n for k, n in want.items() if n >= 6}, trial
        assert trial or all(n >= 6 or k in (bytes(rows[0][: len(k)]), bytes(rows[-1][: len(k)])) for k, n in stack.end())


def test_scores_beyond_64_bits(spark):
    score = "(CAST(a AS decimal(17,0)) * CAST(n AS decimal(17,0)) * 1000BD) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))"
    rows = [(10**12 + 7, 9 * 10**13 + 1, 10**12 + 9, 3 * 10**12 + 1), (100, 10**15, 100, 101), (7, 13, 7, 9)]
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").selectExpr(f"{score} AS s", "a", "n", "l", "r").collect()
    assert all(x.s == 1000 * x.a * x.n // (x.l * x.r) for x in got)


@pytest.mark.parametrize("name", ["op11_byte_owners", "op12_norm_buckets", "op13_phrase_collocations"])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path))
    assert out.count() == 0 and len(out.columns) > 3
