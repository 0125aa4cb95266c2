"""Readers over files written here."""

import gzip
import json

import pytest

from spillway.sources import documents, flows


def connection(label, **own):
    row = {c: "0" for c in flows.CONNECTION_COLUMNS} | {"protocol_type": "tcp", "service": "http", "flag": "SF", "label": label} | {k: str(v) for k, v in own.items()}
    return ",".join(row[c] for c in flows.CONNECTION_COLUMNS)


def test_connections(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([connection("normal."), connection("Neptune", su_attempted=2), connection("xterm")]) + "\n")
    df = flows.connections(spark, str(tmp_path / "a.csv"), 3)
    assert sorted((r.family, r.fine_label, r.y, r.unseen, r.su_attempted) for r in df.collect()) == [("dos", "neptune", 1, False, 1.0), ("normal", "normal", 0, False, 0.0), ("u2r", "xterm", 1, True, 0.0)]
    assert "num_outbound_cmds" not in df.columns and len(df.columns) == 40 + 4
    with pytest.raises(ValueError):
        flows.connections(spark, str(tmp_path / "a.csv"), 4)
    both = flows.connection_splits(spark, {"train": str(tmp_path / "a.csv"), "test": str(tmp_path / "a.csv")})
    assert {r["split"]: r["count"] for r in both.groupBy("split").count().collect()} == {"train": 3, "test": 3}
    (tmp_path / "bad.csv").write_text(connection("never heard of") + "\n")
    with pytest.raises(Exception, match="unknown attack"):
        flows.connections(spark, str(tmp_path / "bad.csv")).collect()


def test_labelled_flows(spark, tmp_path):
    head = "﻿id, dur ,proto,service,state,attack_cat,label\n"
    (tmp_path / "u.csv").write_text(head + "1,0.5,TCP,-,FIN,,0\n2,x,udp,dns,CON, Backdoors ,1\n")
    rows = sorted(flows.labelled_flows(spark, str(tmp_path / "u.csv")).collect(), key=lambda r: r.y)
    assert [(r.proto, r.dur, r.family, r.y) for r in rows] == [("tcp", 0.5, "Normal", 0), ("udp", None, "Backdoor", 1)]
    (tmp_path / "v.csv").write_text(head + "1,0.5,TCP,-,FIN,Worms,0\n")
    with pytest.raises(Exception, match="disagree"):
        flows.labelled_flows(spark, str(tmp_path / "v.csv")).collect()


def test_days(spark, tmp_path):
    head = "Flow ID,Src IP,Src Port,Dst IP,Dst Port,Protocol,Timestamp, Rate ,Same,Rate.1,Label\n"
    for day, rows in {"mon": ["f,1.1.1.1,1,2.2.2.2,80,6,2017-07-03 09:00:01,Infinity,1,9,BENIGN"] * 2 + ["f,1.1.1.1,1,2.2.2.2,80,6,03/07/2017 09:00,2,1,9,Botnet - Attempted"], "tue": ["f,1.1.1.1,1,2.2.2.2,80,6,nonsense,3,1,9,Web Attack \x96 XSS"]}.items():
        (tmp_path / f"{day}.csv").write_bytes((head + "\n".join(rows) + "\n").encode("latin-1"))
    days = {d: flows.day(spark, str(tmp_path / f"{d}.csv"), d) for d in ("mon", "tue")}
    assert "Rate.1" not in days["mon"].columns
    train, test = flows.day_split(days, ["mon"], ["tue"])
    assert sorted((r["family"], r["y"]) for r in train.collect()) == [("BENIGN", 0), ("Botnet", 1)] and test.count() == 1
    assert [c for c in train.columns if not c.startswith("meta")] == ["family", "y", "day"]  # one finite Rate, so nothing that varies
    assert "Dst Port" not in train.columns and test.first()["meta Timestamp"] is None


def test_baseline_and_pool(spark, tmp_path):
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write("src,x\n1.1.1.1,2\n3.3.3.3,4\n")
    assert flows.sample_pool(spark, str(tmp_path / "p.csv.gz")).count() == 2
    assert [r.x for r in flows.baseline(spark, str(tmp_path / "p.csv.gz"), ["x"], "src", ["1.1.1.1"]).collect()] == [4]
    with pytest.raises(ValueError):
        flows.baseline(spark, str(tmp_path / "p.csv.gz"), ["y"], "src", [])


def test_techniques_and_lines(spark, tmp_path):
    ref = lambda k: [{"source_name": "mitre-attack", "external_id": k, "url": f"u/{k}"}]
    objects = [
        {"type": "attack-pattern", "id": "a1", "name": "Scan", "description": "One.  Two", "kill_chain_phases": [{"phase_name": "discovery"}], "external_references": ref("T1")},
        {"type": "attack-pattern", "id": "a2", "name": "Old", "revoked": True, "external_references": ref("T2")},
        {"type": "attack-pattern", "id": "a3", "name": "Sub", "x_mitre_is_subtechnique": True, "x_mitre_detection": "look", "external_references": ref("T1.1")},
        {"type": "strategy", "id": "s1", "name": "watch", "description": "count hosts"},
        {"type": "relationship", "id": "r1", "relationship_type": "detects", "source_ref": "s1", "target_ref": "a1"},
    ]
    (tmp_path / "b.json").write_text(json.dumps({"objects": objects}, indent=1))
    df = documents.techniques(spark, str(tmp_path / "b.json"))
    assert sorted((r.technique_id, r.description, r.detection, r.is_subtechnique) for r in df.collect()) == [("T1", "One. Two", "count hosts", False), ("T1.1", None, "look", True)]
    n = documents.technique_counts(df).first()
    assert (n.techniques, n.subtechniques, n.with_detection, n.tactics) == (2, 1, 2, ["discovery"])
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert documents.lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
    (tmp_path / "f.json").write_text(json.dumps({"alerts": [{"id": "x"}], "incidents": []}))
    assert [r.id for r in documents.fixture(spark, str(tmp_path / "f.json"), "alerts", "id string").collect()] == ["x"]
    documents.report(spark.createDataFrame([(1, float("nan"))], "k int, v double"), str(tmp_path / "out"))
    assert spark.read.schema("k int, v double").json(str(tmp_path / "out")).first()["v"] is None


def test_times_of_many_kinds(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from spillway.functions import fields

    said = {"2024-03-05 06:07:08.123456": datetime(2024, 3, 5, 6, 7, 8, 123456), "2024-03-05 06:07:08": datetime(2024, 3, 5, 6, 7, 8), "05/03/2024 06:07:08 PM": datetime(2024, 3, 5, 18, 7, 8), " 05/03/2024 18:07 ": datetime(2024, 3, 5, 18, 7), "2024-03-05T06:07:08Z": datetime(2024, 3, 5, 6, 7, 8), "2024-03-05T06:07:08+02:00": datetime(2024, 3, 5, 4, 7, 8), "2024-03-05 06:07": datetime(2024, 3, 5, 6, 7), "2024-03-05": datetime(2024, 3, 5), "2024-03-05T06:07:08.5": datetime(2024, 3, 5, 6, 7, 8, 500000)}
    said |= dict.fromkeys(["", "soon", "2024", "12", "2024-13-05", "today"])
    rows = spark.createDataFrame([(x,) for x in said], "x string").select("x", fields.time_of(F.col("x")).cast("timestamp_ntz").alias("t")).collect()
    assert {r["x"]: r["t"] for r in rows} == said
