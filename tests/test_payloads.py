"""Addresses against the standard library's parser, and payloads of any nesting."""

import ipaddress
import random

from pyspark.sql import functions as F

from spillway.functions import payloads


def known(text):
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return True


def test_addresses_as_the_parser_has_them(spark):
    rng = random.Random(5)
    texts = ["", ":", "::", ":::", "1::", "::1", "1.2.3.4", "1.2.3", "01.2.3.4", "1.2.3.400", "1.2.3.4 ", "::1.2.3.4", "1::2::3", "::ffff:10.0.0.1", "fe80::1%eth0", "1.2.3.4%eth0", "fe80::1%", "12:30:05", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::2:3:4:5:6:7:8", "12345::", "g::"]
    for _ in range(3000):
        parts = [rng.choice(["", "0", "a", "ffff", "12", "255", "256", "1.2.3.4"]) for _ in range(rng.randint(1, 9))]
        texts.append(rng.choice([":", ":", "."]).join(parts).replace("::::", "::").replace(":::", "::"))
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    got = {r["x"]: r["a"] for r in rows.select("x", payloads.is_address(F.col("x")).alias("a")).collect()}
    assert {x for x in texts if got[x] != known(x)} == set() and sum(got.values()) > 100


def test_nested_payloads(spark):
    kind = "a double, b array<struct<c: float, d: string>>, m map<string, array<double>>, n map<string, string>, k int, s struct<t: array<array<string>>>"
    nan, inf = float("nan"), float("inf")
    rows = [
        (nan, [(inf, "10.0.0.1 said"), (1.5, "x")], {"k": [1.0, -inf, None]}, {"a": "b"}, 3, ([["y"]],)),
        (2.0, [(0.5, "10.0.0.1")], None, None, None, None),
        (None, None, {"z": None}, {"::1": None}, 1, ([None, ["q", None]],)),
        (1.0, [None], {}, {}, 0, ([[], ["fe80::1"]],)),
    ]
    df = spark.createDataFrame(rows, kind).select(F.struct("*").alias("p"))
    of = df.schema["p"].dataType
    clean = df.select(payloads.finite(F.col("p"), of).alias("p"), payloads.has_raw_address(F.col("p"), of).alias("raw")).collect()
    assert [r["raw"] for r in clean] == [False, True, True, True]
    first = clean[0]["p"]
    assert first["a"] is None and first["b"][0]["c"] is None and first["b"][1]["c"] == 1.5 and first["m"] == {"k": [1.0, None, None]} and first["k"] == 3
    assert clean[1]["p"]["m"] is None and clean[2]["p"]["b"] is None and clean[3]["p"]["b"] == [None] and clean[2]["p"]["s"]["t"] == [None, ["q", None]]
    numbers = spark.createDataFrame([(1.0,)], "x double").select(F.struct("x").alias("p"))
    assert not numbers.select(payloads.has_raw_address(F.col("p"), numbers.schema["p"].dataType).alias("r")).first()["r"]
