"""Novelty scores against plain code, and a detector with an ensemble and families."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spillway.models import detector, novelty


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]]) + [3, -1, 10]
    y = np.zeros(900, int)
    x[800:], y[800:] = x[800:] + [4, -4, 3], 1
    x[:800][7] = [30, 20, -40]  # planted
    made = [(k, *map(float, v), int(t), None if t == 0 else "scan" if k % 2 else "flood") for k, (v, t) in enumerate(zip(x, y, strict=True))]
    made[11] = (11, None, float("nan"), math.inf, 0, None)
    return spark.createDataFrame(made, "id long, a double, b double, c double, y int, family string").cache()


def plain(rows, columns, means):
    own = [[r[c] for c in columns] for r in rows]
    return np.array([[m if v is None or not math.isfinite(v) else v for v, m in zip(x, means, strict=True)] for x in own])


def depth_of(tree, x, at=0):
    """A recursive walk."""
    column, cut, low, high, path = (part[at] for part in tree)
    return path if column < 0 else depth_of(tree, x, low if x[column] <= cut else high)


def test_isolation_forest(spark, rows):
    benign = rows.where("y = 0")
    forest = novelty.IsolationForest.fit(benign, ["a", "b", "c"], "id", trees=30, sample=64)
    assert len(forest.trees) == 30 and all(len(t[0]) <= 127 and t[4].max() <= 6 + novelty.mean_path(64) for t in forest.trees)
    got = {r["id"]: r["s"] for r in forest.score(rows, "s").collect()}
    x = plain(rows.collect(), ["a", "b", "c"], forest.means.values())
    usual = 2 * (math.log(63) + 0.5772156649015329) - 2 * 63 / 64
    want = {r["id"]: 2 ** (-sum(depth_of(t, v) for t in forest.trees) / 30 / usual) - 0.5 for r, v in zip(rows.collect(), x, strict=True)}
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert max(got, key=got.get) == 7 and np.mean([got[k] for k in range(800, 900)]) > np.mean([got[k] for k in range(800)])
    again = novelty.IsolationForest.fit(benign.repartition(7), ["a", "b", "c"], "id", trees=30, sample=64)
    assert all(np.array_equal(a, b) for s, t in zip(forest.trees, again.trees, strict=True) for a, b in zip(s, t, strict=True))  # the hash alone decides


def test_isolation_forest_samples(spark):
    """Each tree's sample is drawn from a pool; few rows are in every tree, equal rows make one leaf."""
    many = spark.range(5000).select("id", (F.col("id") % 100).cast("double").alias("a"))
    forest = novelty.IsolationForest.fit(many, ["a"], "id", trees=4, sample=16)
    leaves = [t[4][t[0] < 0] for t in forest.trees]
    assert forest.sample == 16 and all(0 < len(p) <= 16 for p in leaves)
    few = novelty.IsolationForest.fit(many.limit(3).withColumn("a", F.lit(1.0)), ["a"], "id", trees=4, sample=16)
    assert all(len(t[0]) == 1 for t in few.trees)
    with pytest.raises(ValueError, match="no benign"):
        novelty.IsolationForest.fit(many.limit(0), ["a"], "id")


def test_reconstruction_error(spark, rows):
    benign = rows.where("y = 0")
    for kept in (1, 2, 0.9, 1.0):
        made = novelty.Reconstruction.fit(benign, ["a", "b", "c"], kept)
        got = {r["id"]: r["e"] for r in rows.select("id", made.score().alias("e")).collect()}
        raw = np.array([[np.nan if v is None or not math.isfinite(v) else v for v in (r["a"], r["b"], r["c"])] for r in benign.collect()], float)
        means, spreads = np.nanmean(raw, 0), np.nanstd(raw, 0)
        z = np.where(np.isnan(raw), 0, (raw - means) / spreads)
        values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
        order = np.argsort(-values)
        n = kept if kept > 1 or kept == 1 and isinstance(kept, int) else int(np.searchsorted(np.cumsum(values[order]) / values.sum(), 0.9) + 1) if kept < 1 else 1
        v = vectors[:, order[:n]]
        every = (plain(rows.collect(), ["a", "b", "c"], means) - means) / spreads
        want = ((every - every @ v @ v.T) ** 2).mean(1)
        assert np.allclose([got[r["id"]] for r in rows.collect()], want, atol=1e-9), kept


def test_ensemble(spark, rows):
    benign = rows.where("y = 0")
    made = novelty.Ensemble.fit(benign.where("id % 2 = 0"), ["a", "b", "c"], "id", trees=20).calibrated_on(benign.where("id % 2 = 1"))
    raw = {r["id"]: r for r in made.raw(rows).collect()}
    reference = {c: np.sort([raw[r["id"]][c] for r in benign.where("id % 2 = 1").collect()]) for c in made.NAMES}
    for how, fuse in (("mean", np.mean), ("max", np.max), ("median", np.median)):
        for r in made.score(rows, how, 0.95).collect():
            ranks = [(reference[c] < raw[r["id"]][c]).mean() for c in made.NAMES]
            assert r["novelty"] == pytest.approx(fuse(ranks)) and r["agreement"] == sum(x >= 0.95 for x in ranks)
    with pytest.raises(ValueError, match="none of"):
        made.score(rows, "sum")
    with pytest.raises(ValueError, match="already"):
        made.raw(rows.withColumn("distance", F.lit(1)))
    before, novelty.REFERENCE = novelty.REFERENCE, 100
    try:  # of many rows, quantiles
        rough = made.calibrated_on(benign)
        exact = {c: np.sort([raw[r["id"]][c] for r in benign.collect()]) for c in made.NAMES}
        assert all(np.abs(np.searchsorted(rough.reference[c], exact[c]) / novelty.QUANTILES - np.searchsorted(exact[c], exact[c]) / 800).max() < 0.004 for c in made.NAMES)
    finally:
        novelty.REFERENCE = before


def test_detector_with_an_ensemble_and_families(spark, rows):
    named = rows.withColumn("a", F.when(F.col("family") == "flood", F.col("a") + 9).otherwise(F.col("a")))
    made = detector.Detector.fit(named, "y", "id", ["a", "b", "c"], kind="logistic", budget=0.05, family="family", ensemble=True)
    scored = made.score(named)
    assert {"p_attack", "novelty", "agreement", "family_name", "fired", "conformal_set", "abstains"} <= set(scored.columns) and scored.count() == 900
    attacks = scored.where("y = 1").collect()
    assert sum(r["family_name"] == r["family"] for r in attacks) > 90
    assert sum(r["fired"] > 0 for r in attacks) > 60 and scored.where("y = 0 AND fired > 0").count() <= 0.05 * 800 + 25
    moved = made.rebaselined(named.where("y = 0").withColumn("b", F.col("b") + 50), 0.05)
    mean = lambda model: model.score(named.where("y = 0")).agg(F.avg("novelty")).first()[0]
    assert mean(moved) > mean(made) + 0.1  # what was usual is not any more
