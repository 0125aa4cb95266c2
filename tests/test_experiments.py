"""Single columns, controls and families left out."""

import random

import pytest
from pyspark.sql import functions as F

from spillway.models import experiments


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(12), []
    for k in range(1600):
        y = int(rng.random() < 0.4)
        family = None if not y else rng.choice(["scan", "flood"])
        band = rng.uniform(4, 6) if y else rng.choice([rng.uniform(0, 4), rng.uniform(6, 10)])  # no slope, but a band
        odd = None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else rng.gauss(0.3 * y, 1)
        site = ("east" if rng.random() < 0.9 else "west") if y else rng.choice(["west", "north"])
        out.append((k, y, family, band, odd, rng.gauss(0, 1) + (6 if family == "flood" else 0), rng.gauss(0, 1) + (8 if family == "scan" else 0), site, 1.0))
    return spark.createDataFrame(out, "id long, y int, family string, band double, odd double, a double, b double, site string, same double").repartition(3).cache()


def test_single_columns(rows):
    train, test = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    ranked = experiments.solo_aucs(train, test, "y", ["band", "odd", "same"], ["site"])
    aucs = dict(ranked)
    assert [a for _, a in ranked] == sorted(aucs.values(), reverse=True) and aucs["band"] > 0.98 and 0.5 <= aucs["odd"] < 0.7 and aucs["same"] == 0.5
    rates = {r["site"]: r["m"] for r in train.groupBy("site").agg(F.avg("y").alias("m")).collect()}
    own = [(rates.get(r["site"], 0), r["y"]) for r in test.collect()]
    pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
    assert aucs["site"] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert experiments.solo_auc(train.limit(5), test, "y", "band") == 0.5 and experiments.solo_auc(train.where("y = 1"), test, "y", "band") == 0.5


def test_controls_and_audit(rows):
    dealt = experiments.relabelled(rows, "y", "id")
    assert dealt.columns == rows.columns and dealt.count() == 1600 and dealt.agg(F.sum("y")).first() == rows.agg(F.sum("y")).first()
    moved = dealt.select("id", F.col("y").alias("z")).join(rows, "id").where("y <> z").count()
    assert 500 < moved < 1000
    train, test = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    copies = train.limit(7)
    found = experiments.audit(train, test.unionByName(copies), "y", "id", ["band", "odd"], ["site"], {"band": "artifact", "odd": "signal"})
    assert found.overlap == 7 and found.controls["shuffled_label_auc"] < 0.6 and found.controls["index_only_auc"] < 0.6 and 0.5 < found.controls["majority_accuracy"] < 0.7
    assert "band" in found.candidates and found.quarantined == ["band"] and found.verdict("site") == "unresolved" and "band" not in found.unjudged
    assert experiments.without(train, ["band"]).columns == [c for c in train.columns if c != "band"]
    with pytest.raises(ValueError, match="no such"):
        experiments.without(train, ["nothing"])


def test_families_left_out(rows):
    train, test = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    found = experiments.leave_one_family_out(train, test, "y", "family", "id", ["a", "b"], budget=0.05, kind="logistic")
    assert [r["family"] for r in found] == ["flood", "scan"]
    for r in found:
        assert r["removed"] == train.where(F.col("family") == r["family"]).count() and r["rows"] == test.where(F.col("family") == r["family"]).count()
        assert r["attribution"] == 0 and r["recall_both"] > r["recall_classifier"] + 0.3 and r["novel"] > 0.3  # only the novelty head can see it
        assert r["delta"] == pytest.approx(r["recall_both"] - r["recall_classifier"]) and r["fpr_both"] < 0.12 and r["fpr_classifier"] < 0.12
