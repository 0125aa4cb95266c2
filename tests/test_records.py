"""Commits against a dictionary: two writers, a lost one, a repeated batch, approvals."""

import random

import pytest
from pyspark.sql import functions as F

from spillway.sources import records

SCHEMA = "k string, n long, note string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(store, version=None):
    return {r["k"]: (r["n"], r["note"]) for r in store.state(version).collect()}


def test_state_equals_a_dictionary(spark, tmp_path):
    store, rng = records.Records(spark, str(tmp_path), SCHEMA, ["k"]), random.Random(4)
    want, old = {}, {}
    assert held(store) == {} and store.version() == 0
    for v in range(1, 8):
        new = {rng.choice("abcdef"): (rng.randrange(99), rng.choice(["x", None])) for _ in range(3)}
        assert store.commit(rows(spark, *[(k, *x) for k, x in new.items()])) == v
        want |= new
        old[v] = dict(want)
        if v == 4:
            assert store.compact() == 5
            break
    for v in range(6, 9):
        assert store.commit(rows(spark, ("a", v, None))) == v
        want["a"] = (v, None)
    assert held(store) == want and all(held(store, v) == old[v] for v in old) and held(store, 5) == old[4]


def test_two_writers_and_a_lost_one(spark, tmp_path):
    one, two = (records.Records(spark, str(tmp_path), SCHEMA, ["k"]) for _ in range(2))
    one.commit(rows(spark, ("a", 1, None)))
    seen = one.version()
    assert two.commit(rows(spark, ("a", 2, None)), seen) == seen + 1
    with pytest.raises(records.Conflict):
        one.commit(rows(spark, ("a", 3, None)), seen)
    assert held(one) == {"a": (2, None)}
    last = one.version()
    rows(spark, ("a", 9, None)).withColumn("_commit", F.lit(99).cast("long")).write.parquet(f"{tmp_path}/data/99-lost")  # written, never committed
    (tmp_path / "commits" / f"{last + 1:012d}").write_bytes(b"")  # numbered, never finished
    assert held(two) == {"a": (2, None)} and two.commit(rows(spark, ("b", 4, "x"))) == last + 2
    assert held(one) == {"a": (2, None), "b": (4, "x")}
    between, told = [], one.commits
    one.commits = lambda: between.pop() if between else told()  # has looked before another commit came
    between.append(told())
    two.commit(rows(spark, ("c", 5, None)))
    assert one.commit(rows(spark, ("c", 6, None))) == last + 4 and held(two)["c"] == (6, None)


def test_a_repeated_batch_counts_once(spark, tmp_path):
    store = records.Records(spark, str(tmp_path / "s"), SCHEMA, ["k"])
    assert store.commit(rows(spark, ("a", 1, None)), token="t:0") == 1
    store.commit(rows(spark, ("a", 2, None)))
    assert store.commit(rows(spark, ("a", 1, None)), token="t:0") == 1 and held(store) == {"a": (2, None)}
    for k in range(3):
        rows(spark, ("a", 10 + k, None), (f"b{k}", k, None)).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for check in ("c1", "c2"):  # the second begins anew, with the same name and numbers
        store.sink(stream, "alerts", str(tmp_path / check), lambda df: df.withColumn("note", F.lit("seen"))).trigger(availableNow=True).start().awaitTermination(120)
    found = held(store)
    assert set(found) == {"a", "b0", "b1", "b2"} and found["b1"] == (1, "seen") and found["a"][1] == "seen" and store.version() == 5


def test_verdicts_need_a_second_person(spark, tmp_path):
    store = records.Verdicts(spark, str(tmp_path))
    made = lambda *r: spark.createDataFrame([(*x, 0.5, "dos") for x in r], "target_kind string, target_id string, verdict string, actor string, recorded_at string, p_attack double, family string").withColumn("recorded_at", F.to_timestamp("recorded_at"))
    assert store.record(made(("incident", "i1", "benign", "ann", "2024-01-01"), ("incident", "i1", "attack", "ann", "2024-01-02"), ("alert", "a1", "benign", "bob", "2024-01-01"), ("alert", "a2", "attack", "cid", "2024-01-01"))).count() == 0
    asked = lambda *r: spark.createDataFrame(r, "target_kind string, target_id string, expected string")
    assert store.promote(asked(("incident", "i1", "attack"), ("alert", "a1", "attack"), ("alert", "a2", None), ("alert", "a9", None)), "cid", "2024-01-03") == 1  # a1 is another label, a2 their own
    assert store.promote(asked(("incident", "i1", "attack")), "bob", "2024-01-04") == 0
    refused = store.record(made(("incident", "i1", "benign", "ann", "2024-01-05"), ("alert", "a1", "attack", "ann", "2024-01-05")))
    assert [(r["target_id"]) for r in refused.collect()] == ["i1"]
    assert {(r["target_id"], r["verdict"], r["actor"]) for r in store.pending().collect()} == {("a1", "attack", "ann"), ("a2", "attack", "cid")}
    assert store.promote(asked(("alert", "a1", None), ("alert", "a2", "attack")), "bob", "2024-01-06") == 2
    alerts = spark.createDataFrame([("a1", "i1", "f1"), ("a3", "i1", "f3"), ("a4", "i1", None), ("a5", None, "f5")], "alert_id string, incident_id string, features string")
    assert {(r["alert_id"], r["verdict"], r["promoted_by"]) for r in store.training_rows(alerts).collect()} == {("a1", "attack", "bob"), ("a3", "attack", "cid")}


def test_an_approval_of_what_changed_meanwhile(spark, tmp_path):
    store = records.Verdicts(spark, str(tmp_path))
    made = lambda verdict: spark.createDataFrame([("alert", "a", verdict, "ann", 0.5, "dos")], "target_kind string, target_id string, verdict string, actor string, p_attack double, family string").withColumn("recorded_at", F.current_timestamp())
    store.record(made("benign"))
    state = store.records.state

    def raced(version=None):
        store.records.state = state
        found = state(version)
        records.Verdicts(spark, str(tmp_path)).record(made("attack"))  # between reading and commit
        return found

    store.records.state = raced
    asked = spark.createDataFrame([("alert", "a", "benign")], "target_kind string, target_id string, expected string")
    assert store.promote(asked, "bob", "2024-01-01") == 0 and store.pending().first()["verdict"] == "attack"
