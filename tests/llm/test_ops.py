"""Each registered query over a small folder of tables with odd rows, column by column against plain code."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from spillway.llm import common, decontaminate, fingerprint, neardup, packing, quality, queries, sharding, substring
from tests.llm.test_llm import katz_by_hand, roots_of

#: Columns that are not the operators' own, with names that they use inside.
EXTRA = "_key string, bucket int, place int, row long, base int, spans string, shard string, hash long, _row int, length int, n int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def folder(spark, path, rows, benchmark, labels):
    filled = [(i, x, "en", "web", None if x is None else len(x), "k", 1, 2, 3, 4, "s", "t", 5, 6, 7, 8) for i, x in rows]
    spark.createDataFrame(filled, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7)))
    words = lambda n: [word() for _ in range(n)]
    texts = [" ".join(words(rng.randint(0, 120))) for _ in range(60)]
    passage = words(70)
    out = list(enumerate(texts))
    for k in range(60, 66):  # near copies of copies
        near = (texts[40] + " " + " ".join(words(100)) if k == 60 else out[-1][1]).split()
        out.append((k, " ".join(near)))
    out += [(70, " ".join(words(40) + passage + words(9))), (71, " ".join(words(11) + passage + words(30))), (72, texts[1]), (73, texts[1]), (73, texts[1]), (None, texts[2]), (None, None), (75, None), (76, ""), (77, "\t \n"), (78, " ".join(words(20000)))]
    out += [(80, "mail Bob.x@ex-a.org or +1 (555) 010-9999, card 4111 1111 1111 1111 from 10.0.0.255 and 10.0.0.256"), (81, 'key = "0123456789abcdef0123456789abcdef01234567" end'), (82, "\x00 <|endoftext|> x")]
    return out


@pytest.fixture(scope="module")
def benchmark(rows):
    texts = dict(r for r in rows if r[0] is not None)
    return [(1, " ".join(texts[5].split()[3:30])), (2, texts[70].upper()), (3, "few words"), (4, None), (4, ""), (None, texts[9][:80])]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, rows, benchmark):
    labels = [(k, int(k % 4 > 0), 0) for k in range(60)] + [(3, 0, 1), (None, 1, 0), (5, None, None)]
    return folder(spark, tmp_path_factory.mktemp("small"), rows, benchmark, labels)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), [], [], [])


def crc(i):
    return zlib.crc32(str("" if i is None else i).encode())


def run(name, spark, d):
    return queries.QUERIES[name](spark, d).collect()


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q != "op3_pii_boosting"])
def test_empty_tables(spark, empty, name):
    assert run(name, spark, empty) == []


def test_op1(spark, sf, rows):
    want, *_ = katz_by_hand(rows, 3)
    got = run("op1_katz_backoff", spark, sf)
    keys = ("n_tokens", "n_known", "train_tokens")
    mine = sorted((str(r["doc_id"]), r["held_out"], *[r[k] for k in keys], round(r["base_score"], 4), round(r["score"], 4)) for r in got)
    assert [m[:5] for m in mine] == [w[:5] for w in want]
    assert np.allclose([m[5:] for m in mine], [w[5:] for w in want], rtol=1e-6, atol=2e-4)


def test_op2(spark, sf, rows):
    got = run("op2_collinear_chains", spark, sf)
    pairs = {frozenset((r["doc_id"], r["ref_doc_id"])) for r in got}
    assert frozenset((70, 71)) in pairs
    least = min(i for i, x in rows if x == rows[1][1] and i is not None)
    copies = sorted((r["doc_id"], r["ref_doc_id"], r["copies"]) for r in got if r["start"] is None and r["doc_id"] in (1, 72, 73))
    assert copies == ([(72, least, 4), (73, least, 4), (73, least, 4)] if len(rows[1][1].split()) >= substring.LEAST_WORDS else [])
    near = [p for p in pairs if p <= set(range(60, 66))]
    assert near and all(r["equal"] >= 0.8 * (r["end"] - r["start"]) for r in got if r["start"] is not None)
    assert {i for p in pairs for i in p} <= {70, 71, 1, 72, 73, 40, *range(60, 66), 2, None}  # a row without an id copies 2


def test_op3(spark, sf, rows):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        d = [int(x) for x in re.sub("[^0-9]", "", m)]
        luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or kind == "ip" and all(int(x) < 256 for x in m.split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15

    want = []
    for i, x in rows:
        found = sorted((m.start(), rank, kind, m.end()) for rank, (kind, p) in enumerate(kinds.items()) for m in re.finditer(p, x or "") if good(kind, m[0]))
        said = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
        want.append((i, *[sum(k == kind for _, _, k, _ in found) for kind in kinds], hashlib.sha256(said.encode()).hexdigest()))
    got = run("op3_pii_boosting", spark, sf)
    same([(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got], want)
    of = {r["doc_id"]: r["spans"] for r in got}
    assert "secret:7:47" in of[81] and of[80].count(":") >= 8


def test_op4(spark, sf, rows):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, x in rows:
        ids = whole.encode(x or "", add_special_tokens=False).ids + [0]
        start, length = 0, len(ids) % 2048 or 2048
        for piece in range(-(-len(ids) // 2048)):
            want.append((i, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
            start, length = start + length, 2048
    got = run("op4_best_fit_packing", spark, sf)
    same([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], want)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= 1 + -(-sum(w[3] for w in want) // 2048)


def test_op4_needs_no_more_sequences_than_their_sum(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
    assert got.sequence_id.nunique() <= 1.01 * -(-got.length.sum() // 2048)


def test_op5(spark, sf, rows):
    got = run("op5_external_shuffle", spark, sf)
    same([(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got], [(i, len((x or "").encode()) + 1, zlib.crc32((x or "").encode()), "rows", None) for i, x in rows])
    counts = collections.Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    docs = common.table(spark, sf, "documents")
    orders = [[(r["shard"], r["slot"], r["doc_id"]) for r in sharding.shard(docs, 8, seed).orderBy("shard", "slot").collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2]
    kept = sharding.shard(docs, 8).first()
    assert (kept["bucket"], kept["place"], kept["_key"], kept["row"]) == (1, 2, "k", 3)


def test_op6(spark, sf, rows):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [] for i, _ in rows}
    for i, x in rows:
        ids[i].append(whole.encode(x or "", add_special_tokens=False).ids + [2])
    got = sorted(run("op6_content_addressed_store", spark, sf), key=lambda r: r["start"])
    said = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert said == sorted(said)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got], [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, own in ids.items() for x in own])


def simhash_by_hand(text):
    words = re.findall(r"\w+", text.lower()) or [""]
    lanes = [tuple(np.frombuffer(xxhash.xxh3_128_digest(w), "<u8").tolist()) for w in words]
    m, top = fingerprint._MIX.tolist(), (1 << 64) - 1
    terms = [list(x) for x in lanes]
    for a, b in zip(lanes, lanes[1:], strict=False):
        both = []
        for x, y in zip(a, b, strict=True):
            z = (x * m[0] & top) ^ (y * m[1] & top)
            z = (z ^ (z >> 29)) * m[2] & top
            both.append(z ^ (z >> 32))
        terms.append(both)
    counts, first = collections.Counter(t[0] for t in terms), {}
    for t in terms:
        first.setdefault(t[0], t)
    votes = np.zeros(128)
    for k, n in counts.items():
        bits = np.unpackbits(np.array(first[k], "<u8").view(np.uint8))
        votes += (1 + np.log(n)) * (2.0 * bits - 1)
    return np.packbits(votes > 1e-4).tobytes(), np.abs(votes).min()


def test_op7(spark, sf, rows):
    got = run("op7_simhash_fingerprints", spark, sf)
    assert len(got) == len(rows)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = sorted(((i is None, -(i or 0), signed(xxhash.xxh64_intdigest((x or "").encode(), 42)), i, x or "") for i, x in rows), key=lambda r: r[:3])
    want = []
    for k, (*_, i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][-1]  # after the last comes the first
        half = len(text) // 2
        made = "".join(list(text)[: len(text) - half] + list(following)[:half])
        marks = [simhash_by_hand(x) for x in (text, made, following)]
        want.append((i, len(text), hashlib.sha256(made.encode()).hexdigest(), marks))
    key = lambda r: (str(r[0]), r[1], r[2])
    mine = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r) for r in got), key=key)
    clear = 0
    for (*own, r), (*other, marks) in zip(mine, sorted(want, key=key), strict=True):
        assert own == other
        if min(m for _, m in marks) > 1e-3:  # else rounding may turn a vote
            clear += 1
            a, e, n = (int.from_bytes(x) for x, _ in marks)
            cosine = lambda x, y: max(0.0, math.cos(math.pi * (x ^ y).bit_count() / 128))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (f"{a:032x}", f"{e:032x}")
            assert r["near_edited"] == pytest.approx(cosine(a, e)) and r["near_next"] == pytest.approx(cosine(a, n))
    assert clear > len(rows) // 2
    marks = [int(r["fingerprint"], 16) for r in got]
    for r in got:
        want = sum((int(r["fingerprint"], 16) ^ m).bit_count() <= 6 for m in marks) if r["doc_id"] is not None and r["doc_id"] % 100 == 0 else None
        assert r["n_near"] == want
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 72, 73)}) == 1


def fingerprints_by_hand(rows):
    out = []
    for _, x in rows:
        w = [v for v in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c < "\x7f" else c for c in x or "")) if v]
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append(sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)))
    return out


def test_op9(spark, sf, rows):
    marks = fingerprints_by_hand(rows)
    roots = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[k]] = min(i, least.get(roots[k], i))
    same([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in run("op9_simhash_neardup", spark, sf)], [(i, f"{marks[k]:016x}", least.get(roots[k])) for k, (i, _) in enumerate(rows)])


def test_op10(spark, sf, rows):
    got = run("op10_quality_cnn", spark, sf)
    same([(r["doc_id"], r["held_out"]) for r in got], [(i, crc(i) % 5 == 0) for i, _ in rows])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    rng = np.random.default_rng(3)
    net = quality.Network(rng.normal(size=(256, 8)).astype(np.float32), rng.normal(size=(64, 24)).astype(np.float32), rng.normal(size=24).astype(np.float32), rng.normal(size=24), 0.1)
    net.embed[0] = 0
    text = bytes(rng.integers(97, 100, 3000).tolist())
    blocks = -(-len(text) // 4)
    padded = np.frombuffer(text.ljust((blocks + 1) * 4, b"\0") + bytes(4), np.uint8)
    x = net.embed[padded]
    x[:, -1] = [any(k - lag - 7 >= 0 and all(padded[k - j] == padded[k - j - lag] != 0 for j in range(8)) for lag in quality.LAGS) for k in range(len(padded))]
    windows = np.array([(x[4 * w : 4 * w + 8].reshape(-1)) @ net.filters for w in range(blocks - 1)])
    chunks = [np.maximum(windows[a : a + quality.CHUNK].max(axis=0) + net.bias, 0) for a in range(0, blocks - 1, quality.CHUNK)]
    want = 1 / (1 + np.exp(-(np.mean(chunks, axis=0) @ net.weights + net.offset)))
    assert net.scores([text])[0] == pytest.approx(want, rel=1e-4)


def test_pipeline_stages(spark, sf, rows, benchmark):
    docs = common.table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, sf)
    assert kept.columns == docs.columns
    network = quality.train(docs, common.table(spark, sf, "labels"))
    scores = {repr((r["doc_id"], r["text"])): network.scores([(r["text"] or "").encode()])[0] for r in docs.collect()}
    same([(r["doc_id"], r["text"]) for r in kept.collect()], [(i, x) for i, x in rows if scores[repr((i, x))] >= 0.3])
    kept = stages["near_duplicates"](spark, docs, sf)
    assert kept.columns == docs.columns
    marks = fingerprints_by_hand(rows)
    roots = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 2])
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        groups[roots[k]].append(r)
    left = kept.collect()
    assert len(left) == len(groups)
    same([r["doc_id"] for r in left], [min((i for i, _ in g if i is not None), default=None) for g in groups.values()])
    kept = stages["decontamination"](spark, docs, sf)
    assert kept.columns == docs.columns
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x7f" else c for c in t or "")) if w]

    def bad(x):
        w, hit = split(x), set()
        for _, t in benchmark:
            v = split(t)
            n = min(13, len(v))
            for s in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == s:
                        hit |= set(range(k, k + n))
        return bool(hit) and 20 * len(hit) >= len(w)

    same([(r["doc_id"], r["text"], r["_key"]) for r in kept.collect()], [(i, x, "k") for i, x in rows if not bad(x)])
    clean = stages["pii"](spark, docs, sf)
    assert clean.columns == docs.columns
    of = {r["doc_id"]: r for r in clean.collect()}
    assert "Bob.x" not in of[80]["text"] and "4111" not in of[80]["text"] and "10.0.0.255" not in of[80]["text"] and of[80]["n_chars"] == len(of[80]["text"])
    assert of[75]["text"] is None and of[5]["text"] == rows[5][1] and (of[5]["base"], of[5]["spans"]) == (4, "s")


def test_pipeline_run(spark, sf, empty):
    out = corpus_pipeline.run(spark, sf)
    got = out.toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    docs = common.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf), "by_hand")
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(r["doc_id"], whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    assert len(ids) > 40
    want = [(i, k, zlib.crc32(np.array(x[max(0, start) : start + 2048], "<u4").tobytes())) for i, x in ids for k, start in enumerate(range(len(x) % 2048 - 2048 if len(x) % 2048 else 0, len(x), 2048))]
    same([(None if r["doc_id"] != r["doc_id"] else int(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in got.to_dict("records")], want)
    assert corpus_pipeline.run(spark, empty).count() == 0
