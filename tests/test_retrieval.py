"""Search, trailing counts and isotonic calibration against plain loops."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spillway.models import detector
from spillway.operators import retrieval, trailing


def okapi(docs, query, top):
    words = {i: re.findall("[a-z0-9]+", (x or "").lower()) for i, x in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = collections.Counter(w for x in words.values() for w in set(x))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    usual = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: usual if v < 0 else v for w, v in idf.items()}
    out = []
    for i, own in words.items():
        tf = collections.Counter(own)
        s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(own) / mean)) for w in re.findall("[a-z0-9]+", (query or "").lower()) if tf[w])
        out.append((-round(s, 9), i))
    return [(i, -s) for s, i in sorted(out)[:top] if s < 0]


def test_search_equals_scoring_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{int(abs(rng.gauss(0, 1)) ** 2 * 40)}" for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, text(rng.randint(1, 60))) for k in range(300)] + [(300, None), (301, ""), (302, "W0, w0; W0!"), (303, "w0 w0 w0")]
    docs += [(400 + k, docs[5][1]) for k in range(4)]  # ties
    queries = [(k, text(rng.randint(1, 8))) for k in range(100)] + [(100, docs[5][1]), (101, None), (102, "nothing there"), (103, "w0 w0 w1")]
    index = retrieval.Index.build(spark.createDataFrame(docs, "k long, t string").repartition(3), "k", "t")
    asked = spark.createDataFrame(queries, "q long, t string")
    for top in (1, 3, 40):
        got = collections.defaultdict(list)
        for r in index.search(asked, "q", "t", top).orderBy("q", "rank").collect():
            got[r["q"]].append((r["id"], r["score"]))
        for q, x in queries:
            want = okapi(docs, x, top)
            assert [i for i, _ in got[q]] == [i for i, _ in want] and all(a == pytest.approx(b, abs=2e-9) for (_, a), (_, b) in zip(got[q], want, strict=True)), q
    for r in index.overlap(asked, "q", "t", 2).collect():
        wanted, own = set(re.findall("[a-z0-9]+", queries[r["q"]][1].lower())), set(re.findall("[a-z0-9]+", dict(docs)[r["id"]].lower()))
        assert r["score"] == pytest.approx(len(wanted & own) / len(wanted), abs=1e-9)


def test_search_meets_each_document_once(spark, monkeypatch):
    """Queries go to the documents, some at a time; beyond a bound postings are joined with them, with the same results."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randint(1, 30)}" for _ in range(n))
    docs = spark.createDataFrame([(f"d{k}", text(rng.randint(0, 20))) for k in range(150)], "k string, t string").union(spark.createDataFrame([(f"copy{k}", "w1 w2 w3") for k in range(20)])).repartition(5)
    asked = spark.createDataFrame([(k, text(6)) for k in range(30)] + [(30, "w1 w2"), (31, "")], "q long, t string")
    index = retrieval.Index.build(docs, "k", "t")
    found = [index.search(asked, "q", "t", 4), index.overlap(asked, "q", "t", 4)]
    assert all("Join" not in x for f in found for x in f._jdf.queryExecution().optimizedPlan().toString().split("\n") if "term" in x)
    found = [sorted((r["q"], r["rank"], r["id"], round(r["score"], 8)) for r in f.collect()) for f in found]
    monkeypatch.setattr(retrieval, "CELLS", 300)
    assert [sorted((r["q"], r["rank"], r["id"], round(r["score"], 8)) for r in f.collect()) for f in (index.search(asked, "q", "t", 4), index.overlap(asked, "q", "t", 4))] == found
    monkeypatch.setattr(retrieval, "MAX_ASKED", 0)
    assert [sorted((r["q"], r["rank"], r["id"], round(r["score"], 8)) for r in f.collect()) for f in (index.search(asked, "q", "t", 4), index.overlap(asked, "q", "t", 4))] == found


def test_search_brings_in_few_documents(spark):
    """A word that all documents have brings none in where a rarer one gives enough."""
    docs = spark.range(500).selectExpr("id", "concat('common ', CASE WHEN id < 5 THEN 'rare rare' ELSE concat('x', id) END) AS t")
    index = retrieval.Index.build(docs, "id", "t")
    found = index.search(spark.createDataFrame([(1, "rare common")], "q long, t string"), "q", "t", 3)
    assert [r["id"] for r in found.orderBy("rank").collect()] == [0, 1, 2]
    assert index.search(spark.createDataFrame([], "q long, t string"), "q", "t").count() == 0
    assert retrieval.Index.build(docs.limit(0), "id", "t").search(found.selectExpr("q", "'a' AS t"), "q", "t").count() == 0


def test_trailing_distinct_with_a_hot_entity(spark):
    rng = random.Random(3)
    rows = [(k, None if rng.random() < 0.02 else rng.randrange(400) * 500_000, "hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.choice(["x", "y", "z", None]), rng.randrange(5)) for k in range(1200)]
    df = spark.createDataFrame(rows, "i long, t long, e string, p string, q int").selectExpr("i", "timestamp_micros(t) AS ts", "e", "p", "q", "i AS row", "t AS _t").repartition(4)
    got = trailing.trailing_distinct(df, ["e"], "ts", "i", 20, {"n": None, "dp": ["p"], "dpq": ["p", "q"]}, width=7)
    assert got.columns == [*df.columns, "n", "dp", "dpq"] and got.count() == len(rows)
    for r in got.collect():
        before = [x for x in rows if r["_t"] is not None and x[1] is not None and x[2] == r["e"] and x[1] >= r["_t"] - 20_000_000 and (x[1], x[0]) < (r["_t"], r["i"])]
        assert (r["n"], r["dp"], r["dpq"]) == (len(before), len({x[3] for x in before}), len({x[3:] for x in before})), r
    assert trailing.trailing_distinct(df.limit(0), ["e"], "ts", "i", 20, {"n": None}).count() == 0


def test_trailing_distinct_orders_an_entity_once(spark, monkeypatch):
    """Crowded entities and values go by blocks, with the same counts; all counts come from one order, without a join for each."""
    from spillway.operators import blocks

    df = spark.range(900).selectExpr("id AS i", "timestamp_micros((id * 7919) % 900 * 500000) AS ts", "CASE WHEN id % 10 < 8 THEN 'hot' WHEN id % 10 = 8 THEN 'a' END AS e", "id * 31 % 7 AS p", "id % 3 AS q")
    made = lambda: trailing.trailing_distinct(df, ["e"], "ts", "i", 20, {"n": None, "dp": ["p"], "dpq": ["p", "q"]}, width=7)
    several, one = made(), trailing.trailing_distinct(df, ["e"], "ts", "i", 20, {"n": None})
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(several) == joins(one)
    whole = sorted(map(tuple, several.collect()), key=lambda r: r[0])
    monkeypatch.setattr(blocks, "ROWS_AT_ONCE", 40)
    assert sorted(map(tuple, made().collect()), key=lambda r: r[0]) == whole
    assert len(whole) == 900 and max(r[-1] for r in whole) > 7


def pooled(scored):
    """Neighbours that violate the order are pooled one after the other."""
    by = collections.defaultdict(list)
    for s, y in scored:
        by[s].append(y)
    blocks = []
    for s in sorted(by):
        blocks.append([[s], sum(by[s]), len(by[s])])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    return {s: b[1] / b[2] for b in blocks for s in b[0]}


def test_isotonic(spark):
    rng = random.Random(5)
    scored = [(s := rng.randrange(60) / 60, int(rng.random() < s**2)) for _ in range(900)]
    df = spark.createDataFrame([*scored, (None, 1), (0.5, None)], "p double, y int")
    model, want = detector.isotonic(df, "y", "p"), pooled(scored)
    asked = spark.createDataFrame([(s,) for s in want] + [(-1.0,), (2.0,)], "p double").withColumn("features", F.lit("own"))
    got = {r["p"]: r["calibrated"] for r in detector.isotonic_calibrated(model, asked, "p").collect()}
    assert all(got[s] == pytest.approx(v, abs=1e-12) for s, v in want.items()) and got[-1.0] == want[min(want)] and got[2.0] == want[max(want)]
    report = {r["method"]: r for r in detector.compared_calibrations(df, df.where("p IS NOT NULL AND y IS NOT NULL"), "y", "p").collect()}
    plain = sum((s - y) ** 2 for s, y in scored) / len(scored)
    assert report["uncalibrated"]["brier"] == pytest.approx(plain) and report["isotonic"]["brier"] < plain
    cells = collections.defaultdict(list)
    for s, y in scored:
        cells[min(int(s * 10), 9)].append((s, y))
    gaps = [(len(c), abs(sum(s - y for s, y in c)) / len(c)) for c in cells.values()]
    assert report["uncalibrated"]["ece"] == pytest.approx(sum(n * g for n, g in gaps) / 900) and report["uncalibrated"]["mce"] == pytest.approx(max(g for _, g in gaps))


def test_sequences_with_breaks_and_strides(spark):
    from collections import deque

    from spillway.operators import windows

    rng = random.Random(9)
    rows = [(k, None if rng.random() < 0.03 else rng.randrange(300) * 1_000_000, "hot" if rng.random() < 0.7 else rng.choice(["a", None]), None if rng.random() < 0.1 else float(k), float(k % 7)) for k in range(500)]
    df = spark.createDataFrame(rows, "i long, t long, e string, x double, y double").selectExpr("i", "timestamp_micros(t) AS ts", "e", "x", "y", "i AS row").repartition(4)
    for length, gap, every in ((4, 3.0, 1), (6, 2.0, 3), (1, 5.0, 2)):
        want, past = {}, {}
        known = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0]))
        for step, (i, t, e, x, y) in enumerate(known):
            own = past.setdefault(e, deque(maxlen=length))
            if own and t - own[-1][0] > gap * 1e6:
                own.clear()
            own.append((t, [x or 0.0, y]))
            if step % every == 0:
                want[i] = [[0.0, 0.0]] * (length - len(own)) + [v for _, v in own], len(own)
        got = windows.sequences(df, "e", "ts", "i", ["x", "y"], length, gap, every)
        assert got.columns == [*df.columns, "depth", "sequence"] and {r["i"]: (r["sequence"], r["depth"]) for r in got.collect()} == want
