"""Detectors, mined rules and samples against plain computations."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spillway.functions import rules
from spillway.models import detector, mining
from spillway.operators import intervals, metrics, ordered, splits


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for k in range(3000):
        y = int(k % 5 == 0)
        out.append((k, y, rng.gauss(3 * y, 1), rng.gauss(-2 * y, 1), rng.choice("ab" if not y else "bc"), None if k % 97 == 0 else float(rng.random())))
    return spark.createDataFrame(out, "row_id long, y int, a double, b double, c string, d double").repartition(4).cache()


def test_detector_finds_attacks_within_its_budget(spark, rows):
    made = detector.Detector.fit(rows, "y", "row_id", ["a", "b", "d"], ["c"], "forest", budget=0.05)
    scored = made.score(rows)
    assert [c for c in scored.columns if c in rows.columns] == rows.columns
    r = scored.agg(F.avg(F.when(F.col("y") == 1, (F.col("fired") > 0).cast("int"))).alias("tpr"), F.avg(F.when(F.col("y") == 0, (F.col("fired") > 0).cast("int"))).alias("fpr"), F.avg(F.array_contains("conformal_set", F.when(F.col("y") == 1, "ATTACK").otherwise("BENIGN")).cast("int")).alias("coverage")).first()
    assert r["tpr"] > 0.8 and r["fpr"] < 0.09 and r["coverage"] > 0.85
    moved = rows.where("y = 0").withColumn("a", F.col("a") + 1.5)
    before, after = (m.score(moved).where("fired > 0").count() for m in (made, made.rebaselined(moved, 0.05)))
    assert after < before and after <= 0.06 * moved.count()
    with pytest.raises(ValueError):
        made.score(rows.drop("d"))
    slope, offset = detector.calibrate(scored, "y")
    p = scored.select(detector.calibrated(F.col("p_attack"), slope, offset).alias("p"), "y").toPandas()
    assert abs(p.p.mean() - p.y.mean()) < 0.01
    drops = detector.permutation_importance(made, rows, "y", "row_id", ["a", "d"])
    assert drops["a"] > drops["d"] - 1e-9 and abs(drops["d"]) < 0.01


def test_distances_are_those_of_numpy(rows):
    benign = rows.where("y = 0").select("a", "b").toPandas().to_numpy()
    cov = np.cov(benign.T)
    cov = 0.9 * cov + 0.1 * np.trace(cov) / 2 * np.eye(2) + 1e-12 * np.eye(2)
    made = detector.Mahalanobis.fit(rows.where("y = 0"), ["a", "b"])
    got = rows.select("a", "b", made.score().alias("s")).toPandas()
    off = got[["a", "b"]].to_numpy() - benign.mean(axis=0)
    assert np.allclose(got.s, np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))


def test_rare_and_missing_levels_share_a_column(spark):
    df = spark.createDataFrame([(float(k), "xy"[k % 2] if k < 1995 else f"rare{k}", float("inf") if k == 0 else 1.0 * k) for k in range(2000)], "a double, c string, b double")
    made = detector.Preprocessor.fit(df, ["a", "b"], ["c"])
    assert made.categorical == {"c": ["x", "y"]}
    out = made.transform(spark.createDataFrame([(None, "new", float("nan")), (1.0, None, 1.0)], "a double, c string, b double")).collect()
    assert out[0]["features"].toArray()[2:].tolist() == out[1]["features"].toArray()[2:].tolist()


def test_mined_rules_hold(rows):
    made = detector.Preprocessor.fit(rows, ["a", "b"])
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    plain = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).withColumn("label", F.col("y").cast("double"))
    forest = RandomForestClassifier(numTrees=10, maxDepth=4, seed=1).fit(plain)
    mined = mining.paths(forest.trees, ["a", "b"], 30, 0.9)
    assert mined and made.numeric == ["a", "b"]
    held = mining.validate(rows, "y", [c for c, _, _ in mined])
    pdf = rows.toPandas()
    for r in held:
        hit = np.ones(len(pdf), bool)
        for f, op, at in r["conditions"]:
            hit &= (pdf[f] <= at) if op == "<=" else (pdf[f] > at)
        assert (r["matches"], r["false_alarms"]) == (hit.sum(), (hit & (pdf.y == 0)).sum())
    assert mining.coverage(rows, "y", [r["conditions"] for r in held])["recall"] >= max(r["recall"] for r in held)


def test_simplified_rules():
    assert rules.simplify([("s=http", ">", 0.5), ("s=ftp", "<=", 0.5), ("x", "<=", 3.0), ("x", "<=", 2.0)]) == [("s=http", ">", 0.5), ("x", "<=", 2.0)]
    assert rules.depends_on([("s=http", ">", 0.5)], {"s"}) and not rules.depends_on([("s=http", ">", 0.5)], {"t"})


def test_quantiles_and_first_of_each(spark):
    rng = random.Random(8)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(500)]
    df = spark.createDataFrame([(k, "big" if k % 10 else "small", v) for k, v in enumerate(values)], "row_id long, g string, v double").repartition(3)
    at = [0.0, 0.01, 0.33, 0.5, 0.9, 1.0]
    assert np.allclose(metrics.quantiles(df, ["v"], at)["v"], np.quantile(values, at))
    taken = splits.first_of_each(df, "g", intervals.uniform(F.col("row_id")), "row_id", F.bround(F.col("n") * 0.15))
    assert {r["g"]: r["count"] for r in taken.where("taken").groupBy("g").count().collect()} == {"big": 68, "small": 8} and taken.count() == 500
    assert splits.spaced(10, 4) == [0, 3, 6, 9] and splits.spaced(2, 5) == [0, 1] and splits.spaced(0, 3) == []
    assert ordered.positions(df, "row_id").where("pos = row_id + 1").count() == 500


def test_first_of_each_moves_the_last_part_alone(spark):
    """Ties in order and a group that is null; rows are dealt anew only where a group's count runs out."""
    rows = [(k, None if k % 4 == 0 else "a", (k * 37 % 50) / 50) for k in range(400)]
    df = spark.createDataFrame(rows, "row_id long, g string, u double").repartition(3)
    for share in (0.0, 0.3, 1.0):
        taken = splits.first_of_each(df, "g", F.col("u"), "row_id", F.bround(F.col("n") * share))
        want = {r[0] for g in (None, "a") for r in sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0]))[: round((100 if g is None else 300) * share)]}
        assert {r["row_id"] for r in taken.where("taken").collect()} == want and taken.count() == 400
        assert taken._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("robust", [False, True])
def test_features_are_made_at_once(spark, robust):
    """One vector for each row, the same as the fitted stages make, with gaps, rare and unknown levels, and the same marks of indicators."""
    rows = [(k, None if k % 9 == 0 else k * 0.37 % 5, 2.0, None if k % 11 == 0 else "abc"[k % 3]) for k in range(200)]
    df = spark.createDataFrame(rows, "i long, x double, same double, s string")
    made = detector.Preprocessor.fit(df.where("i < 150 AND s IS NOT NULL"), ["x", "same"], ["s"], robust)
    new = df.unionByName(spark.createDataFrame([(-1, float("nan"), float("inf"), "new")], df.schema))
    ours, theirs = made.transform(new), made.model.transform(made._known(new))
    assert ours.schema["features"].metadata == theirs.schema["features"].metadata
    assert [tuple(r) for r in ours.select("i", "features").orderBy("i").collect()] == [tuple(r) for r in theirs.select("i", "features").orderBy("i").collect()]
    assert ours._jdf.queryExecution().optimizedPlan().toString().count("UDF") <= 1


def test_exact_intervals():
    low, high = intervals.clopper_pearson(3, 20)
    assert (round(low, 4), round(high, 4)) == (0.0321, 0.3789)
    assert intervals.sign_test(0, 0) == 1 and intervals.sign_test(1, 9) == pytest.approx(22 / 1024)
    assert intervals.kolmogorov(0.136, 200, 200) == pytest.approx(0.0494, abs=0.002) and math.isclose(intervals.binomial_upper(0, 5, 0.2), 1)


def test_exact_intervals_of_many_rows():
    """The tails equal the sums over all counts, and an interval of millions of rows adds up few of them."""
    of = lambda k, n, p: math.fsum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
    for k, n, p in [(1, 1, 0.3), (5, 5, 0.9), (3, 20, 0.01), (3, 20, 0.15), (3, 20, 0.99), (60, 90, 0.5), (30, 90, 0.5), (6, 5, 0.5)]:
        assert intervals.binomial_upper(k, n, p) == pytest.approx(of(k, n, p), abs=1e-12), (k, n, p)
    k, n = 3_000_000, 30_000_000
    started = time.process_time()
    low, high = intervals.clopper_pearson(k, n)
    assert time.process_time() - started < 30
    assert (k / n - low) / math.sqrt(0.09 / n) == pytest.approx(1.96, abs=0.01) and (high - k / n) / math.sqrt(0.09 / n) == pytest.approx(1.96, abs=0.01)
    assert intervals.binomial_upper(k, n, low) == pytest.approx(0.025, abs=1e-9) and intervals.sign_test(15_000_000, 15_000_000) == 1


def test_coerce(spark):
    df = spark.createDataFrame([(" 1.5", "  TCP ", "x", 3), ("oops", None, "y", 4), ("inf", "\tUdp", "z", 5)], "` A` string, Proto string, other string, n int")
    got = detector.coerce(df, ["a", "n"], ["proto"])
    assert got.columns == ["a", "n", "proto"] and [tuple(r) for r in got.collect()] == [(1.5, 3.0, "tcp"), (None, 4.0, None), (None, 5.0, "udp")]
    with pytest.raises(ValueError, match="missing"):
        detector.coerce(df, ["b"])
    with pytest.raises(ValueError, match="twice"):
        detector.coerce(df.withColumn("A ", F.lit(1)), ["a"])


def test_ranked_importances(rows):
    for kind in ("forest", "logistic"):
        made = detector.Detector.fit(rows, "y", "row_id", ["a", "b", "d"], ["c"], kind, budget=0.05)
        ranked = detector.ranked_importances(made, 3)
        assert len(ranked) == 3 and ranked[0][0] in ("a", "b", "c=a", "c=c") and "d" not in [n for n, _ in ranked[:2]]
        every = detector.ranked_importances(made, 99)
        assert {"a", "b", "d", "c=a", "c=b", "c=c"} <= {n for n, _ in every} and [v for _, v in every] == sorted((v for _, v in every), reverse=True)


def test_weights_of_digits(spark):
    """Hexadecimal digits give the weight of the number that they stand for, at each bound and beside it."""
    ends = [math.ceil(at * 2**32) for at in intervals.POISSON]
    numbers = sorted({min(max(e + d, 0), 2**32 - 1) for e in [0, *ends] for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(f"{x:08x}", x / 2**32) for x in numbers], "h string, u double")
    for r in rows.select("u", intervals.poisson_weight_of(F.col("h")).alias("a"), intervals.poisson_weight(F.col("u")).alias("b")).collect():
        assert r["a"] == r["b"] == sum(at <= r["u"] for at in intervals.POISSON)


def test_places_in_groups(spark):
    """Places equal a plain sort, though no task has all rows of a group."""
    rows = [(None if k % 7 == 0 else "ab"[k % 2], k * 37 % 10 / 10, k) for k in range(500)]
    found = ordered.places(spark.createDataFrame(rows, "g string, x double, row long"), "g", [F.desc("x"), F.asc("row")], "k")
    got = {r["row"]: r["k"] for r in found.collect()}
    for g in (None, "a", "b"):
        assert [got[r] for *_, r in sorted((-x, r) for h, x, r in rows if h == g)] == list(range(1, 1 + sum(h == g for h, *_ in rows)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block" in line for line in plan.split("\n") if "row_number" in line)
