"""Operators against brute force, exact round trips and held-out accuracy, on odd rows too."""

import collections
import functools
import glob
import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from spillway.llm import common, decontaminate, fingerprint, katz, neardup, packing, pii, quality, sharding, substring, tokens, tokenstore

SCHEMA = "doc_id long, text string, tag string, row long"


def odd_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 90))) for _ in range(60)]
    rows = [(k, x) for k, x in enumerate(texts)]
    rows += [(100, texts[0]), (101, texts[0]), (100, texts[0]), (None, texts[3]), (None, None), (103, None), (104, ""), (105, " \n\t"), (106, " ".join(word() for _ in range(30000))), (107, "\x00 x  y\n\n z")]
    return [(i, x, "t", 5) for i, x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_encoder_gives_the_library_ids():
    rng = random.Random(3)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "Bc", "'s", "1", "é", "́", " ", "\x1c", "\x00", "漢", "🙂", "<|endoftext|>", "!", "--", "\u0085", "İ", "Σς", "　"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        ids, ends = tokens.WordEncoder(path, spaces).encode(texts)
        for text, a, b in zip(texts, [0, *ends], ends, strict=False):
            assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def katz_by_hand(data, order):
    """Rows as ``katz.score`` gives them, and the model's probability of a word after a history."""
    rows = [(i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, (t or "").encode().lower().split() + ["end"]) for i, t in data]
    grams = lambda ws, n: zip(*(["start"] * (n - 1 - k) + ws[max(0, k - n + 1) :] for k in range(n)), strict=False)
    train = [ws for _, held, ws in rows if not held]
    c = {n: collections.Counter(g for ws in train for g in grams(ws, n)) for n in range(1, order + 1)}
    total = sum(c[1].values())
    d = {n: katz.discounts(np.array([sum(x == r for x in c[n].values()) for r in range(1, 7)] + [0, 0], float)) for n in c}
    for n in d:
        d[n][: 2 if n > 2 else 1] = 0
    unknown = 1 - sum(d[1][min(x, 6)] * x for x in c[1].values()) / total
    if not 0 < unknown < 1:
        d[1], unknown = d[1] * total / (total + 1), 1 / (total + 1)
    of, follow = collections.Counter(), collections.defaultdict(list)
    for n in range(2, order + 1):
        for g, x in c[n].items():
            of[g[:-1]] += x
            if d[n][min(x, 6)]:
                follow[g[:-1]].append(g[-1])

    @functools.cache
    def weights(h):
        kept = sum(d[len(h) + 1][min(c[len(h) + 1][*h, w], 6)] * c[len(h) + 1][*h, w] for w in follow[h])
        left = of[h] - kept
        more = left <= 1e-9 * of[h]
        return of[h] + more, (1 if more else left) / (of[h] + more) / (1 - sum(p(h[1:], w) for w in follow[h]))

    @functools.cache
    def p(h, w):
        if not h:
            return d[1][min(c[1][w,], 6)] * c[1][w,] / total if c[1][w,] else unknown
        if not follow[h]:
            return p(h[1:], w)
        below, weight = weights(h)
        n, x = len(h) + 1, c[len(h) + 1][*h, w]
        return d[n][min(x, 6)] * x / below if x >= (2 if n > 2 else 1) else weight * p(h[1:], w)

    base = lambda w: np.log10((c[1][w,] + 1) / (total + len(c[1]) + 1))
    out = []
    for i, held, ws in rows:
        score = sum(np.log10(p(g[:-1], g[-1])) for g in grams(ws, order))
        out.append((str(i), held, len(ws), sum(c[1][w,] > 0 for w in ws), total, round(sum(map(base, ws)), 5), round(score, 5)))
    return sorted(out), p, list(follow), [w for (w,) in c[1]]


def test_katz(spark, docs, none):
    words = [f"w{int(k**2 / 40)}" for k in range(60)]
    rng = random.Random(31)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    small = spark.createDataFrame([(k, x, k) for k, x in enumerate([*texts, texts[3], texts[3]])], "doc_id long, text string, held int").repartition(3)
    for frame, orders in ((small, (1, 4)), (docs, (3,))):
        data = [(r["doc_id"], r["text"]) for r in frame.collect()]
        for order in orders:
            want, p, histories, known = katz_by_hand(data, order)
            for h in histories[:: max(1, len(histories) // 40)]:
                assert sum(p(h, w) for w in known) + p(h, "?") == pytest.approx(1)
            got = katz.score(frame, tokens=500, order=order).collect()
            assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want
    assert katz.score(none).count() == 0
    assert [r["score"] for r in katz.score(spark.createDataFrame([(0, "a b")], "doc_id long, text string"), modulus=1, held=0).collect()] == [0.0]


@pytest.mark.parametrize("n", [10**6, 5 * 10**7, 10**10])
def test_katz_weight_after_a_fixed_pair(n):
    """A history seen twice, always before a word that after one word less comes n times of n + 1."""
    seen = n / (n + 1)
    weight = katz.backoff(np.array([[2.0], [seen], [2.0]]))[0, 0]
    assert abs(weight) == pytest.approx((n + 1) / 3, rel=1e-16 * n + 1e-9) and weight < 0


def test_katz_adds_up_over_its_own_tables(spark):
    """The probabilities after every history, from the model's stored tables alone, add up to 1."""
    rng = random.Random(4)
    words = [f"w{int(k**2 / 60)}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    katz.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), tokens=500)
    top = f"{common.work_dir(spark)}/spillway"
    newest = lambda name: spark.read.parquet(max(glob.glob(f"{top}/{name}-*"), key=os.path.getmtime)).where("kind = 'table'").select("data", "more").collect()

    def stored(name, width):
        out = {}
        for r in newest(name):
            out.update(zip(katz.unpack_keys(r["data"]).tolist(), katz.unpack_numbers(r["more"], width).T.tolist(), strict=True))
        return out

    counts, weights = {n: stored(f"grams{n}", 1) for n in (1, 2, 3)}, {n: stored(f"histories{n}", 1) for n in (1, 2)}
    trained = [x for k, x in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    model = katz.Katz(len(trained))
    for n in (1, 2, 3):
        own = np.array([x[0] for x in counts[n].values()])
        model.learn(n, np.r_[[(own == r).sum() for r in range(1, 7)], (own > 0).sum(), own.sum()].astype(float))
    vocabulary = np.array(sorted(counts[1]), np.uint64)

    def after(history, count, n):
        """Probabilities of all words, and of one not known, after a history of n - 1 words."""
        if n == 1:
            return np.r_[model.word(np.array([counts[1][w][0] for w in vocabulary.tolist()])), model.unknown]
        below = after(history[1:], counts[n - 2][key(history[1:])][0] if n > 2 else 0, n - 1)
        own = weights[n - 1].get(key(history))
        if own is None:
            return below
        weight = own[0]
        out = abs(weight) * below
        for k, w in enumerate(vocabulary.tolist()):
            c = counts[n].get(int(katz.extend(np.array([key(history)], np.uint64), np.array([w], np.uint64))[0]))
            if c:
                out[k] = model.discounted(n, np.array(c))[0] / (count + (weight < 0))
        return out

    def key(words):
        keys = np.array([words[0]], np.uint64)
        for w in words[1:]:
            keys = katz.extend(keys, np.array([w], np.uint64))
        return int(keys[0])

    histories = [(w,) for w in vocabulary.tolist()] + [(w, v) for w in vocabulary.tolist()[:12] for v in vocabulary.tolist()[:12] if key((w, v)) in counts[2]]
    for h in histories:
        assert after(h, counts[len(h)][key(h)][0], len(h) + 1).sum() == pytest.approx(1, abs=1e-9)
    assert len(histories) > 60


def test_substring(spark, docs, none):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    passage = words(60)
    fuzzy = ["zzz" if k in (13, 29, 45) else w for k, w in enumerate(passage)]
    texts = [(1, words(100) + passage + words(50)), (2, words(10) + passage + words(300)), (3, words(40) + fuzzy + words(20)), (4, words(400)), (5, words(30) + passage[:40] + words(30)), (6, words(70))]
    rows = [(i, " ".join(x)) for i, x in texts]
    rows += [(8, rows[3][1]), (9, rows[3][1]), (10, None), (11, ""), (12, "short"), (13, "short")]
    found = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {frozenset((r["doc_id"], r["ref_doc_id"])) for r in found}
    assert set().union(*groups) == {1, 2, 3, 4, 8, 9}
    assert all(r["end"] - r["start"] in range(58, 63) for r in found if r["start"] is not None)
    assert substring.repeated_passages(none).count() == 0
    substring.repeated_passages(docs).count()


def test_pii(spark, docs, none):
    old = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def want(text):
        out = []
        for rank, (kind, pattern) in enumerate(old.items()):
            for m in re.finditer(pattern, text):
                d = [int(x) for x in re.sub("[^0-9]", "", m[0])]
                luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
                if kind == "email" or kind == "ip" and all(int(x) < 256 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15:
                    out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
        return ",".join(x for *_, x in sorted(out))

    rng = random.Random(1)
    bits = ["a@b.c", ".d", "@", "_x@y.z-", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.01.1.1", "4111 1111 1111 1111", "5500000000000004", "12345678901234567890123", "+1 (555) 555-1234", "+12 .. 3", "+", " ", "é", "🙂", "\n", "0", "99", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    selector = pii.fit_selector(spark)
    frame = spark.createDataFrame([(k, x, 1) for k, x in enumerate([*texts, None, 'see token = "0123456789abcdef0123456789abcdef01234567" now'])], "doc_id long, text string, base int")
    got = pii.detect(frame, selector).select("doc_id", "text", pii.joined("base").alias("b"), pii.joined("spans").alias("s")).collect()
    assert all(r["b"] == want(r["text"] or "") for r in got)
    assert all(set(filter(None, r["b"].split(","))) <= set(r["s"].split(",")) for r in got)
    assert max(got, key=lambda r: r["doc_id"])["s"] == "secret:13:53"
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame, selector).collect()}
    assert clean[len(texts)] is None and clean[len(texts) + 1] == 'see token = "[SECRET]" now'
    assert pii.redact(docs, selector).columns == docs.columns and pii.detect(none, selector).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert (got.ids_crc32 == got.ids.map(zlib.crc32)).all()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    want = sorted(len(whole.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(want) == got.length.sum() and len(got) == sum(-(-n // 2048) for n in want)
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    rng = random.Random(2)
    for _ in range(20):
        histogram = collections.Counter(rng.randint(1, rng.choice([300, 2048])) for _ in range(rng.randint(1, 3000)))
        runs = packing.plan_packing(dict(histogram))
        used = collections.Counter()
        for n, lengths in runs:
            assert sum(lengths) <= 2048
            used.update({x: n * lengths.count(x) for x in set(lengths)})
        assert used == histogram


def test_sharding(docs, none):
    got = sharding.shard(docs, 8, bucket_bytes=20_000).toPandas()
    assert len(got) == docs.count() and set(docs.columns) <= set(got.columns)
    counts = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] + 1 == counts["count"]).all() and (counts["nunique"] == counts["count"]).all()
    assert sharding.shard(none).count() == 0


def test_tokenstore(spark, docs, none):
    path = common.new_path(spark, "teststore")
    tokenstore.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    want = sorted((str(r["doc_id"]), tuple(whole.encode(r["text"] or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    read = tokenstore.read_ids(spark, path).orderBy("start").collect()
    assert sorted((str(r["doc_id"]), tuple(r["ids"])) for r in read) == want
    said = {r["start"]: r for r in tokenstore.verify_store(spark, path).collect()}
    at = 0
    for r in read:
        assert (at, len(r["ids"])) == (r["start"], said[at]["n_tokens"]) and said[at]["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])
    ids = [r["doc_id"] for r in read if r["doc_id"] is not None]
    assert ids == sorted(ids)
    empty = common.new_path(spark, "teststore")
    tokenstore.write_store(none, empty, public_tokenizers.path("word_bpe_49k.json"))
    assert tokenstore.verify_store(spark, empty).count() == 0


def test_fingerprints(spark, docs, none):
    rows = spark.createDataFrame([(k, f"{k} " * (k % 50) + "é🙂 tail" * (k % 3)) for k in range(80)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints_with_next(rows).collect()}
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    for k, x in texts.items():
        nxt = texts[k - 1 if k else 79]
        made = x[: len(x) - len(x) // 2] + nxt[: len(x) // 2]
        assert got[k]["edited_sha256"] == hashlib.sha256(made.encode()).hexdigest() and got[k]["n_chars"] == len(x)
    one = fingerprint.fingerprints_with_next(docs)
    assert one.count() == docs.count() and fingerprint.fingerprints_with_next(none).count() == 0
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(30)]
    marks = [b ^ sum(1 << rng.randrange(128) for _ in range(rng.randint(0, 9))) for b in base for _ in range(5)] + base
    frame = spark.createDataFrame([(f"{m:032x}",) for m in marks], "fingerprint string")
    for blocks in (7, 8):
        found = {(r["query"], r["fingerprint"]) for r in fingerprint.within_radius(frame, frame, 6, blocks).collect()}
        assert found == {(f"{a:032x}", f"{b:032x}") for a in set(marks) for b in set(marks) if (a ^ b).bit_count() <= 6}


def test_decontamination(spark, docs, none):
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["Ab", "c", "d1", "é", "x"]) for _ in range(n))
    items = [(k, words(rng.randint(0, 30))) for k in range(25)] + [(30, None), (31, "Ab"), (31, "zz yy")]
    rows = [(k, words(rng.randint(0, 60)) + rng.choice(["", " " + (items[k % 20][1] or ""), ", zz--YY!"])) for k in range(150)] + [(None, None)]
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x7f" else c for c in t or "")) if w]

    def want(text):
        w, hit, ids = split(text), set(), set()
        for i, t in items:
            v = split(t)
            n = min(13, len(v))
            for s in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == s:
                        hit |= set(range(k, k + n))
                        ids.add(str(i))
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for most in (200_000, 1):
        for r in decontaminate.contamination(frame, bench, max_broadcast=most).collect():
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want(texts[r["doc_id"]])
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.contamination(none, bench).count() == 0


def test_near_duplicates(spark, docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count() and neardup.near_duplicates(none).count() == 0
    assert neardup.drop_near_duplicates(docs).columns == docs.columns
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(60)})
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    near = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps[:i]) if (a ^ b).bit_count() <= 2]
    truth = roots_of(len(fps), near)
    place = {f: k for k, f in enumerate(fps)}
    for groups, tile in ((3, 20_000), (4, 50), (3, 7)):
        links = [(place[r["a"] & (1 << 64) - 1], place[r["b"] & (1 << 64) - 1]) for r in neardup.links(frame, 2, groups, tile).collect()]
        assert all(truth[a] == truth[b] for a, b in links)  # a link joins only what is linked
        assert roots_of(len(fps), links) == truth  # and together they join all of it


def roots_of(n, pairs):
    root = list(range(n))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((of(a), of(b)))
        root[b] = a
    return [of(x) for x in range(n)]


def test_links_within_long_cells():
    rng = random.Random(12)
    for n, long_run in ((40, 4), (300, 16), (900, 256), (900, 2000)):
        fps = [rng.getrandbits(64)]
        while len(fps) < n:  # chains of close ones, in any order
            near = rng.choice(fps[-3:]) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            fps.append(near if rng.random() < 0.9 else rng.getrandbits(64))
        fps = list(dict.fromkeys(fps))
        n = len(fps)
        rng.shuffle(fps)
        marks = np.array(fps, np.uint64)
        a, b = neardup._cell_links(np.zeros(n, np.int64), marks, neardup.Pivots(2, 3), long_run)
        at = {f: k for k, f in enumerate(fps)}
        got = roots_of(n, [(at[int(x)], at[int(y)]) for x, y in zip(a, b, strict=True)])
        i, j = np.nonzero(np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 2)
        assert got == roots_of(n, zip(i.tolist(), j.tolist(), strict=True)) and len(a) < n


def test_near_duplicates_of_a_large_group(spark):
    import corpus_pipeline

    rng = random.Random(13)
    copies = [[f"w{k}" for k in range(400)]]
    for k in range(2500):  # copies of copies
        words = copies[rng.randrange(max(0, k - 1500), k + 1)].copy()
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        copies.append(words)
    rows = [(k, " ".join(words)) for k, words in enumerate(copies)]
    fps = np.array([neardup.simhash(x) for _, x in rows], np.uint64)
    distinct = np.unique(fps)
    cells = neardup.Pivots(2, 3).keys(distinct)
    assert max(np.unique(cells, return_counts=True)[1]) > 256
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    want = dict(enumerate(roots_of(len(rows), zip(i.tolist(), j.tolist(), strict=True))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame).collect()} == want
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()} == set(want.values())


def test_pii_upper_case(spark):
    texts = ["WRITE TO JOE [AT] EXAMPLE [DOT] COM", "MAIL JOE (AT) EXAMPLE (DOT) COM NOW", "write to joe [at] example [dot] com", "NOTHING HERE [AT ALL]"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert [clean[k] for k in range(4)] == ["WRITE TO [CONTACT]", "MAIL [CONTACT] NOW", "write to [CONTACT]", texts[3]]


def test_added_tokens_in_texts(spark):
    rng = random.Random(14)
    bits = [" ", "\n", "\t", "a", "Bc", "'s", "é", "\x00", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "endoftext", "!", "İ"]
    texts = ["end <|endoftext|> next", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(3000))]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path)
        ids, ends = tokens.encoder(path, spaces).encode(texts)
        for text, a, b in zip(texts, [0, *ends], ends, strict=False):
            assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    frame = spark.createDataFrame(list(enumerate(texts[:200])), "doc_id long, text string")
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(frame, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    assert got.length.sum() == sum(len(whole.encode(x, add_special_tokens=False).ids) + 1 for x in texts[:200])
    store, whole = common.new_path(spark, "teststore"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenstore.write_store(frame, store, public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: list(r["ids"])[:-1] for r in tokenstore.read_ids(spark, store).collect()} == {k: whole.encode(x, add_special_tokens=False).ids for k, x in enumerate(texts[:200])}


def test_substring_two_passages(spark):
    rng = random.Random(15)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    rows, want = [], {}
    for k, between in enumerate((31, 40, 100, 150)):
        first, second = words(60), words(55)
        rows += [(2 * k, " ".join(words(20) + first + words(between) + second + words(30))), (2 * k + 1, " ".join(words(45) + first + words(between) + second))]
        want[k] = ([(20, 80), (80 + between, 135 + between)], [(45, 105), (105 + between, 160 + between)])
    found = [r for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    for k, places in want.items():
        own = [r for r in found if r["doc_id"] // 2 == k]
        assert all(r["ref_doc_id"] == r["doc_id"] ^ 1 for r in own)
        whole = [(own[0]["doc_id"] % 2, own[0]["start"], own[0]["end"])] if len(own) == 1 else []
        if whole:  # as one passage, if that has the share of equal words
            assert own[0]["equal"] >= 0.8 * (own[0]["end"] - own[0]["start"]) and k == 0
        else:
            assert sorted((r["start"], r["end"]) for r in own) == places[own[0]["doc_id"] % 2]
            assert sorted((r["ref_start"], r["ref_end"]) for r in own) == places[own[0]["ref_doc_id"] % 2]


def test_substring_seeds_held_elsewhere(spark):
    rng = random.Random(16)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    texts, number = [], iter(range(100))
    hashed = lambda x: spark.range(1).selectExpr(f"xxhash64('{x}') AS h").first()["h"]
    for _ in range(6):
        passage = words(60)
        b, c = " ".join(words(20) + passage), " ".join(words(30) + passage + words(10))
        least = min(hashed(b), hashed(c))
        for part in (passage[:30], passage[30:]):  # earlier holders of all seeds but those across the seam
            while hashed(a := " ".join(words(5) + part + words(5))) >= least:
                pass
            texts.append((next(number), a))
        texts += [(next(number), b), (next(number), c)]
    found = substring.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {frozenset((r["doc_id"], r["ref_doc_id"])) for r in found} == {frozenset((4 * k + 2, 4 * k + 3)) for k in range(6)}
    assert all((r["start"], r["end"]) in ((20, 80), (30, 90)) for r in found)


@pytest.mark.parametrize("crowd", [0, 40, 600])
def test_substring_only_seeds_held_elsewhere(spark, crowd):
    """Pairs whose common seeds all have an earlier holder without the passage: of few texts, and of a crowd that fills several tiles."""
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    hashed = lambda x: xxhash.xxh64(x.encode(), seed=42).intdigest() - (1 << 64) * (xxhash.xxh64(x.encode(), seed=42).intdigest() >> 63)
    texts, line, want = [(1000 + k, "") for k in range(2)], words(15), []
    for k in range(6):
        passage = words(25) + line + words(25) if crowd else words(120)
        cut = lambda part, step, off: ["zzz%d" % n if n % step == off else w for n, w in enumerate(part)]
        other = cut(passage[:25], 5, 2) + line + cut(passage[40:], 5, 2) if crowd else cut(passage, 17, 5)
        pair = [" ".join(words(20) + passage + words(20)), " ".join(words(30) + other + words(9))]
        for first in range(0, 0 if crowd else 86, 17):  # earlier holders of 35 words each
            while hashed(a := " ".join(words(5) + passage[first : first + 35] + words(5))) >= min(map(hashed, pair)):
                pass
            texts.append((100 + 10 * k + first // 17, a))
        texts += [(10 * k, pair[0]), (10 * k + 1, pair[1])]
        want.append(frozenset((10 * k, 10 * k + 1)))
    texts += [(2000 + k, " ".join(words(30 + k % 50) + line + words(70))) for k in range(crowd)]
    found = substring.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {frozenset((r["doc_id"], r["ref_doc_id"])) for r in found} == set(want)


def test_substring_crowd_joined_by_first(spark):
    """Texts that all share a passage with the first holder stay a star, however many there are; one that it does not join is paired."""
    rng = random.Random(22)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]
    passage = words(90)
    texts = [(k, " ".join(words(10) + ["y%d" % k if n % 40 == k % 40 else w for n, w in enumerate(passage)] + words(10))) for k in range(80)]
    found = substring.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r[c] for r in found for c in ("doc_id", "ref_doc_id")} == set(range(80))
    links = {frozenset((r["doc_id"], r["ref_doc_id"])) for r in found}
    near = {k: {k}.union(*(x for x in links if k in x)) for k in range(80)}
    assert all(near[a] & near[b] for a in range(80) for b in range(a))
    assert len(links) < 80 * 79 / 4


def test_substring_candidates():
    """Pairs come from keys in common alone: as all pairs would give them, and none of texts that share their seed's line only."""
    rng = np.random.default_rng(23)
    keys, use = rng.integers(0, 60, (40, 6)), rng.random((40, 6)) < 0.8
    for n_others in (0, 17):
        known = rng.random(40) < 0.3
        known = np.concatenate([np.sort(known[:n_others]), np.sort(known[n_others:])])
        got = {frozenset((int(p), int(q))): int(t) for x in substring._candidates(keys, use, n_others, known) for p, q, t in zip(*x, strict=True)}
        held = [keys[k][use[k]].tolist() for k in range(40)]
        pairs = [(p, q) for p in range(40) for q in range(p) if (not n_others or q < n_others <= p) and not (known[p] and known[q])]
        common = {frozenset((p, q)): set(held[p]) & set(held[q]) for p, q in pairs}
        assert got == {x: max(sum(held[k].count(g) for g in both) for k in x) for x, both in common.items() if both}
    line = np.tile(np.arange(11), (3000, 1))
    keys = np.concatenate([line, 11 + np.arange(3000 * 50).reshape(3000, 50)], 1)
    assert not sum(len(p) for p, *_ in substring._candidates(keys, keys > 10, 0, np.zeros(3000, bool)))


def word_pairs(n):
    """Made-up words of two texts that share passages, with words changed, put in and left out; some are runs of few words."""
    rng = np.random.default_rng(24)
    for k in range(n):
        few = rng.choice([3, 40, 4000])
        draw = lambda size: (few * rng.random(size) ** 2).astype("<u4")  # noqa: B023, E731
        a = np.repeat(draw(rng.integers(0, 30)), rng.integers(5, 30)) if k % 5 == 0 else draw(rng.integers(0, 500))
        b = a[rng.integers(0, len(a) // 3 + 1) :].copy()
        changed = np.flatnonzero(rng.random(len(b)) < rng.choice([0, 0.05, 0.2]))
        b[changed] = draw(len(changed))
        b = np.delete(b, rng.integers(0, len(b), rng.integers(0, 4))) if len(b) else b
        yield a, np.r_[draw(rng.integers(0, 90)), np.insert(b, rng.integers(0, len(b) + 1, 3), draw(3)), draw(rng.integers(0, 40))]


def test_substring_aligned_together(monkeypatch):
    """Many pairs aligned at once give what each gives alone, run by run."""
    pairs = list(word_pairs(300))
    want = [substring.passages_of(np.array(substring.matching_blocks(a.tolist(), b.tolist()), np.int64).reshape(-1, 3)) for a, b in pairs]
    assert sum(map(bool, want)) > 100 and sum(len(x) > 1 for x in want)
    assert list(substring.align_all(*zip(*pairs, strict=True))) == want
    assert [substring.align(a, b) for a, b in pairs[:40]] == want[:40]
    monkeypatch.setattr(substring, "AT_ONCE", 2000)  # halved again and again, some searched on their own
    assert list(substring.align_all(*zip(*pairs, strict=True))) == want
    assert list(substring.align_all([], [])) == []


def test_substring_sieve():
    """Chains whose words' single bytes rule a passage out are left out, and none that has one."""
    pairs = list(word_pairs(300))
    low = [pa.array([x.astype(np.uint8).tobytes() for x in side], pa.binary()) for side in zip(*pairs, strict=True)]
    may = substring.may_share(*low)
    assert all(may[k] for k, found in enumerate(substring.align_all(*zip(*pairs, strict=True))) if found)
    rng = np.random.default_rng(25)
    apart = [pa.array([rng.bytes(60) + b"a seed" + rng.bytes(60) for _ in range(200)], pa.binary()) for _ in range(2)]
    assert not substring.may_share(*apart).any()


def test_substring_tile_of_runs():
    """Places in runs of one word, most of which are near each other: the pairs are those that all pairs give."""
    rng, reach = np.random.default_rng(26), 64
    runs = [np.r_[np.repeat(rng.integers(1, 4), rng.integers(20, 64)), np.full(rng.integers(6, 60), 9), np.repeat(rng.integers(1, 4), 64)] for _ in range(60)]
    at = [int(np.flatnonzero(x == 9)[0]) for x in runs]
    words = [x[: p + reach + substring.SEED].astype("<u4").tobytes() for x, p in zip(runs, at, strict=True)]
    zeros = [0] * 60
    group = pa.table({"x": zeros, "y": zeros, "tile": zeros, "id": list(range(60)), "at": at, "start": zeros, "words": words, "low": zeros, "high": zeros, "before": zeros, "after": zeros})
    found = {(r["id"], r["ref"]) for r in substring._tile_pairs(group, reach, 50, 20.0).to_pylist()}
    for i in range(60):
        for j in range(i):
            a, b = (np.frombuffer(words[k], "<u4") for k in (i, j))
            run = substring.SEED + sum(x[0] for x in substring._equal_run(*(substring._padded([words[k]], [reach - at[k]], reach) for k in (i, j)), reach))
            if substring.align(a, b) and run < 50 + substring.WINDOW - 1:
                assert (i, j) in found
    assert 0 < len(found) < 60 * 59 / 2


def test_quality(spark, none):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(5, 200))) + "."
    bad = lambda: rng.choice([lambda: " | ".join(word() for _ in range(60)), lambda: " ".join(word() + "$$$" for _ in range(60)), lambda: " ".join([word()] * 60)])()
    rows = [(k, bad() if k % 4 == 0 else good()) for k in range(600)] + [(None, None), (900, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(600)], "doc_id long, quality int")
    network = quality.train(frame, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score(frame, network).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(scored[k] >= 0.3) == (k % 4 > 0) for k in held]) > 0.95
    assert all(0 <= x <= 1 for x in scored.values()) and quality.score(none, network).count() == 0
    assert quality.train(none, labels.limit(0)).scores([b"x"])[0] == pytest.approx(0.5)
