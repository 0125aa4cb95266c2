"""Stateful detectors over micro-batches against loops written here, and replay."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spillway.streaming import drift, errors, replay


def stream_of(spark, path, df, batches, schema):
    for n, part in enumerate(np.array_split(np.arange(len(df)), batches)):
        df.iloc[part].sample(frac=1, random_state=n).to_parquet(path / f"{n}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def finished(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None


def ddm_by_hand(wrongs):
    """The paper's rule: rate and deviation so far against the least of their sum."""
    out, start, best = [], 0, None
    for i in range(len(wrongs)):
        seen = wrongs[start : i + 1]
        n = len(seen)
        if n < 30:
            continue
        p = sum(seen) / n
        s = math.sqrt(p * (1 - p) / n)
        if best is None or p + s <= sum(best):
            best = p, s
        if p + s > best[0] + 3 * best[1]:
            out.append((i, "drift"))
            start, best = i + 1, None
        elif p + s > best[0] + 2 * best[1]:
            out.append((i, "warning"))
    return out


def eddm_by_hand(wrongs):
    """The paper's rule: mean and deviation of the distances between errors against the largest of their sum."""
    out, start, top = [], 0, 0.0
    for i in range(len(wrongs)):
        if not wrongs[i]:
            continue
        at = [0] + [k + 1 for k, w in enumerate(wrongs[start : i + 1]) if w]
        gaps = np.diff(at)
        level = gaps.mean() + 2 * gaps.std()
        if level > top:
            top = level
        elif len(gaps) >= 30 and level / top < 0.9:
            out.append((i, "drift"))
            start, top = i + 1, 0.0
        elif len(gaps) >= 30 and level / top < 0.95:
            out.append((i, "warning"))
    return out


@pytest.mark.parametrize(("kind", "by_hand"), [("ddm", ddm_by_hand), ("eddm", eddm_by_hand)])
def test_error_detectors_over_batches(spark, tmp_path, kind, by_hand):
    rng = random.Random(2)
    df = pd.DataFrame({"e": ["a", "b"] * 600, "i": range(1200)})
    df["wrong"] = [rng.random() < (0.2 if i < 600 or e == "b" else 0.7) for e, i in zip(df.e, df.i, strict=True)]
    want = {(e, own.i.iloc[k], said) for e, own in df.groupby("e") for k, said in by_hand(own.wrong.tolist())}
    finished(errors.monitor(stream_of(spark, tmp_path, df, 4, "e string, i long, wrong boolean"), "e", "i", "wrong", kind), kind)
    assert {(r.entity, r.at, r.said) for r in spark.table(kind).collect()} == want
    assert any(e == "a" and i >= 600 and said == "drift" for e, i, said in want)


def adwin_by_hand(xs, delta):
    """Buckets that keep their scores; means and variances from these."""
    buckets, out = [], []
    for i, x in enumerate(xs):
        buckets.append([x])
        size = 1
        while sum(len(b) == size for b in buckets) > 5:
            k = next(k for k, b in enumerate(buckets) if len(b) == size)
            buckets[k : k + 2] = [buckets[k] + buckets[k + 1]]
            size *= 2
        changed = False
        while (i + 1) % 32 == 0:
            window = [v for b in buckets for v in b]
            n, cut = len(window), False
            if n > 10:
                var, trust = np.var(window), math.log(2 * math.log(n) / delta)
                for k in range(1, len(buckets)):
                    left = sum(map(len, buckets[:k]))
                    if min(left, n - left) >= 5:
                        m = 1 / (left - 4) + 1 / (n - left - 4)
                        cut |= abs(np.mean(window[:left]) - np.mean(window[left:])) > math.sqrt(2 * m * var * trust) + 2 / 3 * trust * m
            if not cut:
                break
            changed = True
            buckets.pop(0)
        if changed:
            out.append(i)
    return out


def page_hinkley_by_hand(xs, least, delta, limit):
    out, start = [], 0
    for i in range(len(xs)):
        seen = xs[start : i + 1]
        sums = np.cumsum([x - np.mean(seen[: k + 1]) - delta for k, x in enumerate(seen)])
        if len(seen) >= least and sums[-1] - min(0.0, sums.min()) > limit:
            out.append(i)
            start = i + 1
    return out


def test_score_detectors_over_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    levels = {"a": [0.2] * 450 + [0.8] * 450, "b": [0.4] * 900, "c": [0.1] * 300 + [0.5] * 300 + [0.2] * 300}
    df = pd.DataFrame([(e, i, float(v + rng.normal() * 0.1)) for e, own in levels.items() for i, v in enumerate(own)], columns=["e", "i", "x"]).sort_values("i", kind="stable")
    want = {(e, i, "adwin") for e, own in df.groupby("e") for i in adwin_by_hand(own.x.tolist(), 0.002)}
    want |= {(e, i, "page_hinkley") for e, own in df.groupby("e") for i in page_hinkley_by_hand(own.x.tolist(), 30, 0.005, 5.0)}
    nothing = pd.DataFrame([("a", -1, float("nan"))], columns=["e", "i", "x"])
    finished(drift.monitor_scores(stream_of(spark, tmp_path, pd.concat([df, nothing]), 5, "e string, i long, x double"), "e", "i", "x", limit=5.0), "scores")
    alarms = spark.table("scores")
    assert {(r.entity, r.at, r.detector) for r in alarms.collect()} == want
    said = {(r.entity, r.detector): (r.n_alarms, r.delay, r.early) for r in drift.compared(alarms, 450).collect()}
    own = sorted(i for e, i, d in want if (e, d) == ("a", "adwin"))
    assert said["a", "adwin"] == (len(own), min(i for i in own if i >= 450) - 450, sum(i < 450 for i in own)) and ("b", "adwin") not in said
    with pytest.raises(ValueError, match="unknown"):
        drift.monitor_scores(alarms, "entity", "at", "at", ("other",))


def test_adwin_state_stays_small():
    window = drift.Adwin(0.002)
    for k in range(5000):
        window.add(0.5 + 0.01 * (k % 3))
    assert sum(b[0] for b in window.buckets) == 5000 and len(window.buckets) <= drift.BUCKETS * 13


def test_replay_and_drift(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 10 / 10.0).alias("p"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    score = lambda df: df.withColumn("verdict", F.when(F.col("p") >= 0.8, "KNOWN_ATTACK").otherwise("BENIGN"))
    history = replay.replay(spark, str(tmp_path / "in"), "k long, p double", score, str(tmp_path / "check"), str(tmp_path / "out"))
    assert len(history) == 4 and (history[-1]["KNOWN_ATTACK"], history[-1]["BENIGN"]) == (20, 80)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    mixed = replay.spliced(rows, rows.limit(5).withColumn("p", F.lit(2.0)), "k", 50)
    assert [r.k for r in mixed.where("p = 2").orderBy("k").collect()] == [50, 51, 52, 53, 54] and mixed.select("k").distinct().count() == 105
    moved = rows.select(replay.shifted(F.col("p"), F.col("k"), 2.0, 10, 20).alias("x"), "p", "k")
    assert moved.where("k >= 20 and abs(x - p - 2) > 1e-9").count() == 0 and moved.where("k < 10 and x <> p").count() == 0
