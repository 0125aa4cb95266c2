"""Neighbours, made rows and links against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spillway.models import imbalance

SCHEMA = "id long, a double, b double, n double, c string, y int"


def small(spark, count=44, seed=2):
    """Few enough that every row is compared with every other."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, 2))
    y = (np.arange(count) % 4 == 0).astype(int)
    rows = [(k, float(v[0] + t), float(v[1]), float(rng.integers(9)), "pqr"[k % 3], int(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def laid(rows, columns=(1, 2, 3)):
    x = np.array([[r[c] for c in columns] for r in rows])
    return (x - x.mean(0)) / x.std(0)


def nearest(x, k, among=None):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return [[j for j in np.lexsort((np.arange(len(x)), d[i])) if among is None or among[j]][:k] for i in range(len(x))]


@pytest.mark.parametrize("dims", [2, 5, 8])
def test_recall_of_neighbours(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(size=(900, dims)), rng.normal(size=(500, dims)) * 0.1 + 2, np.zeros((200, dims))])
    df = spark.createDataFrame([(k, [float(u) for u in v], k % 2) for k, v in enumerate(x)], "id long, _x array<double>, y int").repartition(5)
    found = imbalance.neighbours(df, "id", F.col("id") % 3 == 0, 5, "y").collect()
    assert {r["row"] for r in found} == set(range(0, 1600, 3)) and all(r["other_label"] == r["other"] % 2 and list(x[r["other"]]) == r["other_x"] for r in found)
    d = ((x[::3, None] - x[None]) ** 2).sum(2)
    d[np.arange(len(d)), np.arange(0, 1600, 3)] = np.inf
    limit = np.sort(d, axis=1)[:, 4]
    right = sum(r["distance"] <= limit[r["row"] // 3] + 1e-12 for r in found)
    assert right / (5 * len(d)) >= 0.9 and all(math.isclose(r["distance"], d[r["row"] // 3, r["other"]], abs_tol=1e-9) for r in found)


def test_smote_rows_lie_between_neighbours(spark):
    rows, df = small(spark)
    few = [r for r in rows if r[5] == 1]
    everyone = laid(rows)
    near = nearest(everyone[[r[0] for r in few]], 5)
    made = imbalance.oversampled(df, "y", "id", ["a", "b", "n"], "smotenc", [], ["n"])
    new = made.where("synthetic").collect()
    assert len(new) == 33 - 11 and made.where("NOT synthetic").count() == 44 and {r["y"] for r in new} == {1} and made.columns == [*df.columns, "synthetic"]
    for r in new:
        assert r["n"] == int(r["n"]) and r["id"] is None
        assert any(abs((r["a"] - p[1]) * (q[2] - p[2]) - (r["b"] - p[2]) * (q[1] - p[1])) < 1e-9 and min(p[1], q[1]) - 1e-9 <= r["a"] <= max(p[1], q[1]) + 1e-9 for i, p in enumerate(few) for q in (few[j] for j in near[i]))
    rough = imbalance.oversampled(df, "y", "id", ["a", "b", "n"]).where("synthetic")
    assert imbalance.impossible(rough, ["n"]).count() > 0 and imbalance.impossible(made, ["n"]).count() == 0
    named = imbalance.oversampled(df, "y", "id", ["a", "b"], "smotenc", ["c"]).where("synthetic").collect()
    assert {r["c"] for r in named} <= set("pqr") and len(named) == 22
    again = imbalance.oversampled(df.repartition(7), "y", "id", ["a", "b", "n"], "smotenc", [], ["n"]).where("synthetic").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, new))  # a hash alone decides


def test_amounts_by_what_surrounds_a_row(spark):
    rows, df = small(spark)
    y = np.array([r[5] for r in rows])
    ten, five = (nearest(laid(rows, (1, 2)), k) for k in (10, 5))
    danger = [i for i in range(44) if y[i] and 5 <= sum(1 - y[ten[i]]) < 10]
    found = imbalance.oversampled(df, "y", "id", ["a", "b"], "borderline_smote").where("synthetic")
    assert danger and found.count() == 22
    share = {i: sum(1 - y[five[i]]) / 5 for i in range(44) if y[i]}
    want = sum(round(s / sum(share.values()) * 22) for s in share.values())
    assert imbalance.oversampled(df, "y", "id", ["a", "b"], "adasyn").where("synthetic").count() == want
    one = df.where("y = 0 OR id = 0")
    assert imbalance.oversampled(one, "y", "id", ["a"]).where("synthetic").count() == 0
    with pytest.raises(ValueError, match="unknown kind"):
        imbalance.oversampled(df, "y", "id", ["a"], "other")


def test_tomek_links_and_undersampling(spark):
    rows, df = small(spark)
    first = [n[0] for n in nearest(laid(rows, (1, 2)), 1)]
    want = {(i, first[i]) for i in range(44) if first[first[i]] == i and rows[i][5] != rows[first[i]][5] and i < first[i]}
    assert want and {(r["a"], r["b"]) for r in imbalance.tomek_links(df, "y", "id", ["a", "b"]).collect()} == want
    parts = [imbalance.undersampled(df, "y", "id", member=m).collect() for m in (0, 1)]
    assert all(sum(r["y"] == v for r in p) == 11 for p in parts for v in (0, 1)) and {r["id"] for r in parts[0]} != {r["id"] for r in parts[1]}


def test_natural_shares(spark):
    _, df = small(spark)
    imbalance.check_natural(df, df, "y")
    for other in (df.where("y = 1"), df.limit(0)):
        with pytest.raises(ValueError, match="share"):
            imbalance.check_natural(other, df, "y")


def test_every_strategy(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(rng.normal() + 2 * (k % 9 == 0)), float(rng.normal()), 1.0, "pq"[k % 2], int(k % 9 == 0)) for k in range(360)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2).cache()
    train, test = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    names = ("none", "threshold_moving", "smote_tomek", "easy_ensemble")
    table = {r["strategy"]: r for r in imbalance.ablation(train, test, "y", "id", ["a", "b"], names=names, fpr=0.05)}
    assert set(table) == set(names) and all(r["roc_auc"] > 0.75 for r in table.values())
    assert table["threshold_moving"]["roc_auc"] == table["none"]["roc_auc"] and table["smote_tomek"]["recall"] > table["none"]["recall"]
    with pytest.raises(ValueError, match="none of"):
        imbalance.fit_strategy("other", train, "y", "id", ["a"])
