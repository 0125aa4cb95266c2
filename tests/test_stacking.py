"""The stacked ensemble's parts against numpy, and that no row teaches its own score."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from spillway.models import stacking
from spillway.operators import intervals


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    y = (np.arange(400) % 4 == 0).astype(int)
    x = rng.normal(size=(400, 4)) * [1, 1, 5, 2] + y[:, None] * [2.5, 0, 4, 0]
    df = spark.createDataFrame([(k, int(t), [float(v) for v in r]) for k, (r, t) in enumerate(zip(x, y, strict=True))], "id long, y int, x array<double>")
    return df.select("id", "y", array_to_vector("x").alias("features")).repartition(3).cache(), x, y


def by_id(df, column="features"):
    return np.array([r["v"] for r in df.select("id", vector_to_array(column).alias("v")).orderBy("id").collect()])


def test_arms(rows):
    df, x, _ = rows
    log = np.sign(x) * np.log1p(np.abs(x))
    z = (log - log.mean(0)) / log.std(0, ddof=1)
    made = {a: by_id(stacking.fit_arm(df, a, 4, 2).transform(df)) for a in stacking.ARMS}
    assert np.allclose(made["P0"], x) and np.allclose(made["P1"], z)
    for name, base, n in (("P2", z, None), ("P3a", x, None), ("P3b", x, 2)):
        values, vectors = np.linalg.eigh(np.cov(base.T))
        share = np.cumsum(values[::-1]) / values.sum()
        n = n or int(np.searchsorted(share, 0.95) + 1)
        want = base @ vectors[:, ::-1][:, :n]
        if name != "P2":
            want = (want - want.mean(0)) / want.std(0, ddof=1)
        assert made[name].shape == want.shape and np.allclose(np.abs(made[name] * np.sign((made[name] * want).sum(0)) - want), 0, atol=1e-8), name
    with pytest.raises(ValueError, match="none of"):
        stacking.fit_arm(df, "P9", 4)
    with pytest.raises(ValueError, match="number of directions"):
        stacking.fit_arm(df, "P3b", 4)


@pytest.mark.parametrize(("kernel", "most"), [("rbf", 0.02), ("poly", 0.02)])
def test_kernel_map_is_near_the_kernel(rows, kernel, most):
    df, x, _ = rows
    z = (x - x.mean(0)) / x.std(0)
    laid = stacking.fit_arm(df, "P1", 4).transform(df)
    own = by_id(laid)
    made = stacking.KernelMap.fit(laid, "id", kernel, 120)
    assert made.gamma == pytest.approx(1 / (4 * own.var())) and len(made.landmarks) == 120
    mapped = by_id(made.transform(laid))
    gaps = ((own[:, None] - own[None]) ** 2).sum(2)
    exact = np.exp(-made.gamma * gaps) if kernel == "rbf" else (made.gamma * own @ own.T + 1) ** 2
    assert np.abs(mapped @ mapped.T - exact).mean() / exact.mean() < most and z.shape == own.shape
    with pytest.raises(ValueError, match="no rows"):
        stacking.KernelMap.fit(laid.limit(0), "id")


def test_out_of_fold_scores(spark, rows):
    df, _, y = rows
    made = stacking.Stacked.fit(df, "y", "id", landmarks=40, folds=2)
    scores = made.out_of_fold.orderBy("id").toPandas()
    assert scores.id.tolist() == list(range(400)) and set(scores["_fold"]) == {0, 1}
    # members fitted by hand on the other fold give a row the score that the combiner learnt from
    part = df.withColumn("_fold", stacking.fold_of("id", 2))
    seen = stacking.weighed(part.where("_fold <> 0"), "y")
    arms = {"tree": stacking.fit_arm(seen, "P0", 4), "machine": stacking.fit_arm(seen, "P1", 4)}
    members = {m: stacking.fit_member(arms["tree" if m == "T3" else "machine"].transform(seen), m, "id", 40) for m in ("T3", "S1")}
    by_hand = stacking.member_scores(part.where("_fold = 0"), arms, members).orderBy("id").toPandas()
    own = scores[scores["_fold"] == 0]
    assert np.allclose(own["T3"], by_hand["T3"]) and np.allclose(own["S1"], by_hand["S1"], atol=1e-3)
    scored = made.score(df).orderBy("id").toPandas()
    auc = (scored.p_attack[y == 1].to_numpy()[:, None] > scored.p_attack[y == 0].to_numpy()).mean()
    assert auc > 0.95 and scored.p_attack.between(0, 1).all() and set(stacking.MEMBERS) < set(scored.columns)
    best = stacking.chosen({"hetero": made.out_of_fold}, "y", "id", 0.05, 2)
    assert [r["combiner"] for r in best][-1] == "hard" and best[0]["recall"] >= best[1]["recall"] and all(r["roc_auc"] > 0.9 for r in best)
    votes = stacking.Combiner("hard", []).score(made.out_of_fold).orderBy("id").toPandas()
    want = np.mean([(scores[m] >= (0.5 if m in stacking.TREES else 0)) for m in stacking.MEMBERS], axis=0)
    assert np.allclose(votes.p_attack, want)
    with pytest.raises(ValueError, match="none of"):
        stacking.Combiner.fit(made.out_of_fold, "y", "sum")


def test_three_way_split(rows):
    df, _, _ = rows
    parts = stacking.three_way(df, "y", "id")
    counts = {(r["y"], r["part"]): r["count"] for r in parts.groupBy("y", "part").count().collect()}
    assert counts == {(0, "S"): 45, (0, "H"): 51, (0, "F"): 204, (1, "S"): 15, (1, "H"): 17, (1, "F"): 68} and parts.select("id").distinct().count() == 400


@pytest.mark.parametrize("block", [1, 25])
def test_paired_difference(rows, block):
    df, x, y = rows
    flagged = df.withColumn("a", vector_to_array("features")[0] > 1.5).withColumn("b", vector_to_array("features")[2] > 4)
    got = stacking.paired_difference(flagged, "id", "y", "a", "b", 300, block)
    own = np.flatnonzero(y == 1)
    a, b = x[own, 0] > 1.5, x[own, 2] > 4
    w = stacking.weights_of(own // block, 300)
    assert abs(w.mean() - 1) < 0.05 and w.min() == 0 and (block == 1 or (w[own // block == 3] == w[own // block == 3][0]).all())
    deltas = ((w * a[:, None]).sum(0) - (w * b[:, None]).sum(0)) / w.sum(0)
    assert got["difference"] == pytest.approx(a.mean() - b.mean()) and (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(deltas, [0.025, 0.975])))
    with pytest.raises(ValueError, match="no rows"):
        stacking.paired_difference(flagged.where("y = 0"), "id", "y", "a", "b")
    assert len(intervals.POISSON) > 3
