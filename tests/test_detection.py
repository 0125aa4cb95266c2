"""Rules, trailing counts and the streaming detector against plain loops."""

import numpy as np
import pandas as pd

from spillway.functions import rules
from spillway.operators import rates
from spillway.streaming import drift


def test_rules_skip_missing_values(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, 1.0)], "id int, x double")
    assert [r.id for r in df.where(rules.matches([("x", ">", 0.0), ("x", ">", 2.0)])).collect()] == [1]
    assert rules.simplify([("x", "<=", 3.0), ("x", "<=", 2.0)]) == [("x", "<=", 2.0)]


def test_trailing_count_has_ties_and_null_times(spark):
    ts = [0, 0, 30, 60, 61, 200, None]
    rows = [(i, "a", None if t is None else pd.Timestamp(t, unit="s").to_pydatetime()) for i, t in enumerate(ts)]
    out = rates.trailing_count(spark.createDataFrame(rows, "id int, e string, ts timestamp"), "e", "ts", 60)
    want = {i: 0 if t is None else sum(u is not None and t - 60 <= u <= t for u in ts) for i, t in enumerate(ts)}
    assert {r.id: r.n for r in out.collect()} == want


def test_page_hinkley_over_two_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = pd.DataFrame({"e": ["a", "b"] * 200, "i": range(400), "s": rng.random(400)})
    df.loc[(df.e == "a") & (df.i > 150), "s"] += 5
    want, states = set(), {}
    for e, i, s in df.itertuples(index=False):
        states[e], alarm = drift.step(states.get(e, drift.FRESH), s, 30, 0.005, 20.0)
        if alarm:
            want.add((e, i))
    for n, part in enumerate((df[:180], df[180:])):
        part.to_parquet(tmp_path / f"{n}.parquet")
    stream = spark.readStream.schema("e string, i long, s double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = drift.page_hinkley(stream, "e", "i", "s", limit=20.0).writeStream.format("memory").queryName("alarms").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert want and {(r.entity, r.at) for r in spark.table("alarms").collect()} == want


def test_sessions_read_their_input_once(spark, tmp_path):
    """The rows are made once, whatever makes them; gaps within and between blocks, null keys and times, equal to a plain loop."""
    import random

    from pyspark.sql import functions as F

    from spillway.operators import windows

    rng, made = random.Random(4), spark.sparkContext.accumulator(0)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, *[1_700_000_000 + 43_200 * rng.randint(0, 600) for _ in range(20)]])) for k in range(400)]

    def passed(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "row long, key string, s long").mapInArrow(passed, "row long, key string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r["row"]: r["session"] for r in windows.sessions(df, ["key"], "at", "row", "1 day").collect()}
    want = {k: 0 for k, _, s in rows if s is None}
    for key in ("a", "b", None):
        own = sorted((s, k) for k, x, s in rows if x == key and s is not None)
        n = 0
        for (before, _), (s, k) in zip([own[0], *own], own, strict=False):
            n += s - before > 86_400
            want[k] = n
    assert got == want and made.value == len(rows)
