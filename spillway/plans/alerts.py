"""Alerts, incidents, suppressions, verdicts and their store over the test tables, each query with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from spillway.functions import alerts as al
from spillway.functions import scoring
from spillway.operators import windows
from spillway.plans.queries import FLOWS, flows, query, read

ALERTS = f"""{FLOWS}, scored AS (SELECT row_id, l_shipdate AS seen_at, p, nov, agr, agr = 3 AS abstains, CASE l_returnflag WHEN 'R' THEN 'dos' WHEN 'A' THEN 'probe' END AS family, CASE WHEN l_suppkey % 10 > 0 THEN '10.0.0.' || l_suppkey END AS src,
 '10.1.' || (row_id % 7) || '.' || (row_id % 5) AS dst, CAST(row_id % 1000 AS INT) AS port, CASE WHEN l_suppkey % 4 < 3 THEN 'seg' || (l_suppkey % 4) END AS segment FROM flows),
 judged AS (SELECT *, CASE WHEN p >= .8 THEN 'KNOWN_ATTACK' WHEN nov >= .99 AND agr >= 1 THEN 'NOVEL_SUSPICIOUS' WHEN abstains OR p >= .4 THEN 'UNCERTAIN' ELSE 'BENIGN' END AS verdict,
 CASE WHEN p >= .9 OR nov >= .999 THEN 4 WHEN p >= .8 OR nov >= .99 THEN 3 WHEN p >= .4 THEN 2 ELSE 1 END AS sev, CAST(round_even(least(1.0, greatest(p, nov) + .04 * least(agr, 3)) * 100, 0) AS INT) AS priority FROM scored),
 alerts AS (SELECT * REPLACE (CASE WHEN verdict <> 'NOVEL_SUSPICIOUS' THEN family END AS family) FROM judged WHERE p >= .8 OR nov >= .99 OR abstains)"""


def alerts(spark, d):
    """Rows that fired or on which the conformal set abstains, as alerts; the segment stays beside them."""
    rows = flows(spark, d).withColumn("abstains", F.col("agr") == 3).where((scoring.fired(F.col("p"), F.col("nov"), 0.8, 0.99) != 0) | F.col("abstains"))
    source = F.when(F.col("l_suppkey") % 10 > 0, F.concat(F.lit("10.0.0."), F.col("l_suppkey").cast("string")))
    target = F.concat(F.lit("10.1."), (F.col("row_id") % 7).cast("string"), F.lit("."), (F.col("row_id") % 5).cast("string"))
    family = F.when(F.col("l_returnflag") == "R", "dos").when(F.col("l_returnflag") == "A", "probe")
    made = al.alert(F.col("p"), F.col("nov"), F.col("agr"), F.col("abstains"), family, source, target, (F.col("row_id") % 1000).cast("int"), F.col("l_shipdate"), F.col("row_id"))
    return rows.select(made.alias("a"), F.when(F.col("l_suppkey") % 4 < 3, F.concat(F.lit("seg"), (F.col("l_suppkey") % 4).cast("string"))).alias("segment"))


@query("x1_alerts", f"WITH {ALERTS} SELECT verdict, sev, coalesce(family, '-') AS family, count(*) AS n, sum(priority) AS priorities, count(src) AS with_source FROM alerts GROUP BY 1, 2, 3")
def built_alerts(spark, d):
    rows = alerts(spark, d).select("a.*").withColumn("sev", al.severity_rank(F.col("severity")))
    return rows.groupBy("verdict", "sev", F.coalesce("family", F.lit("-")).alias("family")).agg(F.count("*").alias("n"), F.sum("priority").alias("priorities"), F.count("src_ip").alias("with_source"))


@query("x3_network_sessions", f"""WITH {ALERTS} SELECT row_id, CAST(round_even(p * 100, 0) AS INT) AS confidence, priority AS risk, src AS threat_ip, CASE WHEN src IS NOT NULL THEN 'SrcIpAddr' END AS threat_field, coalesce(family, verdict) AS category, CAST(0 AS INT) AS problems FROM alerts""")
def network_sessions(spark, d):
    s = F.col("s")
    rows = alerts(spark, d).select(F.col("a.alert_id").alias("row_id"), al.network_session(F.col("a")).alias("s"))
    return rows.select("row_id", s["ThreatConfidence"].alias("confidence"), s["ThreatRiskLevel"].alias("risk"), s["ThreatIpAddr"].alias("threat_ip"), s["ThreatField"].alias("threat_field"), s["ThreatCategory"].alias("category"), F.size(al.network_session_problems(s)).alias("problems"))


@query("x3_session_problems", f"""WITH {ALERTS}, x AS (SELECT unnest([CASE WHEN row_id % 11 = 0 THEN 'missing Dvc' END, CASE WHEN row_id % 13 = 0 THEN 'missing EventStartTime' END, CASE WHEN row_id % 7 = 0 THEN 'ThreatConfidence out of range' END, CASE WHEN row_id % 5 = 0 THEN 'unknown EventResult' END,
 CASE WHEN row_id % 3 = 0 AND row_id % 13 <> 0 THEN 'ends before it starts' END, CASE WHEN row_id % 17 = 0 AND src IS NOT NULL THEN 'ThreatField is required' END]) AS problem FROM alerts) SELECT problem, count(*) AS n FROM x WHERE problem IS NOT NULL GROUP BY 1""")
def session_problems(spark, d):
    """What is wrong with sessions some of whose fields were spoilt, by the row's number."""
    k, own = F.col("a.alert_id"), F.col("s")
    spoilt = {"Dvc": (11, None), "EventStartTime": (13, None), "ThreatConfidence": (7, 150), "EventResult": (5, "Maybe"), "ThreatField": (17, None)}
    made = {c: F.when(k % n != 0, own[c]).otherwise(F.lit(value)) for c, (n, value) in spoilt.items()}
    made["EventEndTime"] = F.when(k % 3 == 0, own["EventEndTime"] - F.expr("interval 1 day")).otherwise(own["EventEndTime"])
    rows = alerts(spark, d).select("a", al.network_session(F.col("a")).alias("s"))
    kept = [c for c in rows.schema["s"].dataType.names if c not in made]
    rows = rows.select(F.struct(*[own[c].alias(c) for c in kept], *[c.alias(n) for n, c in made.items()]).alias("s"))
    return rows.select(F.explode(al.network_session_problems(F.col("s"))).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("x4_detection_findings", f"""WITH {ALERTS} SELECT 200401 AS type_uid, sev AS severity_id, CASE WHEN p < .34 THEN 1 WHEN p < .67 THEN 2 ELSE 3 END AS confidence_id, count(*) AS n, min(epoch_ms(seen_at)) AS first_ms, CAST(0 AS BIGINT) AS problems FROM alerts GROUP BY 2, 3""")
def detection_findings(spark, d):
    f = F.col("f")
    rows = alerts(spark, d).select(al.detection_finding(F.col("a")).alias("f"))
    return rows.groupBy(f["type_uid"].alias("type_uid"), f["severity_id"].alias("severity_id"), f["confidence_id"].alias("confidence_id")).agg(F.count("*").alias("n"), F.min(f["time"]).alias("first_ms"), F.sum(F.size(al.detection_finding_problems(f))).alias("problems"))


@query("x5_common_events", f"""WITH {ALERTS} SELECT coalesce(family, 'novelty') || ' detector' AS rule, sev AS severity, verdict = 'NOVEL_SUSPICIOUS' AS has_reason, count(*) AS n, CAST(0 AS BIGINT) AS problems FROM alerts GROUP BY 1, 2, 3""")
def common_events(spark, d):
    e = F.col("e")
    rows = alerts(spark, d).select(al.common_event(F.col("a")).alias("e"))
    return rows.groupBy(e["rule"]["name"].alias("rule"), e["event"]["severity"].alias("severity"), e["event"]["reason"].isNotNull().alias("has_reason")).agg(F.count("*").alias("n"), F.sum(F.size(al.common_event_problems(e))).alias("problems"))


def problems_of(rows, made, spoilt, found):
    """Counts of what ``found`` says of the structs ``made`` after the fields of ``spoilt`` (name: when, value) were changed."""
    rows, own = rows.select(F.col("a.alert_id").alias("k"), made(F.col("a")).alias("s")), F.col("s")
    names = rows.schema["s"].dataType.names
    changed = F.struct(*[(F.when(~spoilt[c][0], own.getField(c)).otherwise(spoilt[c][1]) if c in spoilt else own.getField(c)).alias(c) for c in names])
    rows = rows.select(changed.alias("s"))
    return rows.select(F.explode(found(F.col("s"))).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


@query("x4_finding_problems", f"""WITH {ALERTS}, x AS (SELECT unnest([CASE WHEN row_id % 13 = 0 THEN 'missing time' END, CASE WHEN row_id % 5 = 0 THEN 'type_uid does not follow' END, CASE WHEN row_id % 7 = 0 THEN 'unknown confidence' END, CASE WHEN row_id % 11 = 0 THEN 'no evidence' END, CASE WHEN row_id % 17 = 0 THEN 'missing metadata' END]) AS problem FROM alerts)
 SELECT problem, count(*) AS n FROM x WHERE problem IS NOT NULL GROUP BY 1""")
def finding_problems(spark, d):
    k, none = F.col("k"), F.lit(None)
    spoilt = {"time": (k % 13 == 0, none), "type_uid": (k % 5 == 0, F.lit(7)), "confidence_id": (k % 7 == 0, F.lit(9)), "evidences": (k % 11 == 0, F.slice(F.col("s.evidences"), 1, 0)), "metadata": (k % 17 == 0, none)}
    return problems_of(alerts(spark, d), al.detection_finding, spoilt, al.detection_finding_problems)


@query("x5_event_problems", f"""WITH {ALERTS}, x AS (SELECT unnest([CASE WHEN row_id % 13 = 0 THEN 'missing @timestamp' END, CASE WHEN row_id % 5 = 0 THEN 'kind not allowed' END, CASE WHEN row_id % 7 = 0 THEN 'unknown severity' END, CASE WHEN row_id % 11 = 0 THEN 'no category' END]) AS problem FROM alerts) SELECT problem, count(*) AS n FROM x WHERE problem IS NOT NULL GROUP BY 1""")
def event_problems(spark, d):
    k, e = F.col("k"), F.col("s").getField("event")
    event = e.withField("kind", F.when(k % 5 != 0, e["kind"]).otherwise("rumour")).withField("severity", F.when(k % 7 != 0, e["severity"]).otherwise(9)).withField("category", F.when(k % 11 != 0, e["category"]).otherwise(F.slice(e["category"], 1, 0)))
    return problems_of(alerts(spark, d), al.common_event, {"@timestamp": (k % 13 == 0, F.lit(None)), "event": (F.lit(True), event)}, al.common_event_problems)


RULES = [
    ("r1", {"family": "DOS", "dst_port": "7"}, "no printer", "2024-01-01", "2024-02-01"),
    ("r2", {"src_ip": "10.0.0.3"}, "scanner of our own", "2024-01-05", "2024-01-20"),
    ("r3", {"family": "probe"}, "all probes", "2024-01-01", "2024-01-10"),
    ("r4", {"service": "-", "protocol": "any"}, "placeholder", "2024-01-01", "2024-01-10"),
    ("r5", {"src_ip": "*"}, "everything", "2024-01-01", "2024-01-10"),
    ("r6", {"dst_ip": "10.1.1.1"}, "too long", "2024-01-01", "2024-09-01"),
    ("r7", {"dst_ip": "10.1.2.2"}, "over by now", "2023-12-01", "2024-01-02"),
    ("r8", {"colour": "red", "dst_port": "1"}, "no such field", "2024-01-02", "2024-01-02"),
]


def rules(spark):
    made = spark.createDataFrame(RULES, "rule_id string, match map<string,string>, reason string, created string, expires string")
    return made.select("rule_id", "match", "reason", F.to_timestamp("created").alias("created"), F.to_timestamp("expires").alias("expires"))


@query("p17_rule_problems", """SELECT * FROM (VALUES ('r1', ''), ('r2', ''), ('r3', 'unscoped'), ('r4', 'unscoped'), ('r5', 'wildcard'), ('r6', 'too long'), ('r7', ''), ('r8', 'unknown field,expires before it begins')) t(rule_id, problems)""")
def rule_problems(spark, d):
    return rules(spark).select("rule_id", F.array_join(al.rule_problems(F.col("match"), F.col("created"), F.col("expires")), ",").alias("problems"))


MATCHABLE = {"src_ip": "src_ip", "dst_ip": "dst_ip", "dst_port": "dst_port", "family": "family"}


def suppressed(spark, d):
    """Alerts with rule_id: of the good rules that are active on a given day, the latest created that matches."""
    good = rules(spark).where(F.size(al.rule_problems(F.col("match"), F.col("created"), F.col("expires"))) == 0)
    good = good.where(al.active(F.col("created"), F.col("expires"), F.lit("2024-01-12").cast("timestamp")))
    rows = alerts(spark, d).select("a.*", "segment").withColumn("fields", al.matchable(MATCHABLE))
    pack = good.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("created")).alias("o"), "rule_id", F.map_entries("match").alias("match")))).alias("rules"))
    hit = F.filter("rules", lambda r: al.rule_matches(F.map_from_entries(r["match"]), F.col("fields")))
    return rows.crossJoin(F.broadcast(pack)).withColumn("rule_id", F.get(hit, F.lit(0))["rule_id"]).drop("rules")  # one row that people keep


SUPPRESSED = f"{ALERTS}, sup AS (SELECT *, CASE WHEN src = '10.0.0.3' THEN 'r2' WHEN family = 'dos' AND port = 7 THEN 'r1' END AS rule_id FROM alerts)"


@query("z20_suppressed_alerts", f"""WITH {SUPPRESSED} SELECT coalesce(rule_id, '-') AS rule_id, CASE WHEN rule_id IS NOT NULL THEN 'BENIGN_BY_POLICY' ELSE verdict END AS verdict, count(*) AS n, avg(p) AS mean_p FROM sup GROUP BY 1, 2""")
def suppressed_alerts(spark, d):
    rows = suppressed(spark, d).withColumn("verdict", F.when(F.col("rule_id").isNotNull(), "BENIGN_BY_POLICY").otherwise(F.col("verdict")))
    return rows.groupBy(F.coalesce("rule_id", F.lit("-")).alias("rule_id"), "verdict").agg(F.count("*").alias("n"), F.avg("p_attack").alias("mean_p"))


@query("p18_proposed_matches", f"WITH {ALERTS} SELECT CASE WHEN src IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN family IS NOT NULL THEN 1 ELSE 0 END + 2 AS fields, count(*) AS n FROM alerts GROUP BY 1")
def proposed_matches(spark, d):
    rows = alerts(spark, d).select("a.*").withColumn("fields", al.proposed_match(al.matchable(MATCHABLE)))
    return rows.groupBy(F.cardinality("fields").alias("fields")).agg(F.count("*").alias("n"))


def grouped(spark, d, gap: str = "15 days"):
    """Actionable alerts of one source and family whose times lie no more than ``gap`` apart, as groups; only what incidents say of their alerts goes on."""
    x, v = F.col("a"), F.col("a.verdict")
    rows = alerts(spark, d).where(al.actionable(v) & F.col("a.src_ip").isNotNull())
    rows = rows.select(*[x[c].alias(c) for c in ("src_ip", "family", "at", "alert_id", "priority", "dst_ip", "dst_port", "p_attack")], al.severity_rank(x["severity"]).alias("rank"), (v == "NOVEL_SUSPICIOUS").alias("novel"), "segment")
    return windows.sessions(rows, ["src_ip", "family"], "at", "alert_id", gap).groupBy("src_ip", "family", "session")


def incidents(spark, d, gap: str = "15 days"):
    """Groups of alerts as one row each. Different targets and ports are counted as sets, one incident's in one task, so that rows are not dealt thrice for two distinct counts."""
    made = grouped(spark, d, gap).agg(
        F.max("rank").alias("sev"), F.max("priority").alias("priority"), F.count("*").alias("events"), F.size(F.collect_set("dst_ip")).cast("long").alias("targets"), F.size(F.collect_set("dst_port")).cast("long").alias("ports"), F.min("at").alias("opened"), F.max("at").alias("last_seen"),
        (2 * F.count_if("novel") > F.count("*")).alias("hunting"), F.min("alert_id").alias("first_alert"), F.min("segment").alias("_least"), F.max("segment").alias("_most"), F.max("p_attack").alias("p"),
    )
    segment = F.when(F.col("_least") == F.col("_most"), F.col("_least")).when(F.col("_least").isNotNull(), "mixed")
    return made.select("*", segment.alias("segment")).drop("_least", "_most", "session")


INCIDENTS = f"""{ALERTS}, marked AS (SELECT *, CASE WHEN seen_at > lag(seen_at) OVER w + INTERVAL 15 DAY THEN 1 ELSE 0 END AS new FROM alerts WHERE verdict <> 'BENIGN' AND src IS NOT NULL WINDOW w AS (PARTITION BY src, family ORDER BY seen_at, row_id)),
 grouped AS (SELECT *, sum(new) OVER (PARTITION BY src, family ORDER BY seen_at, row_id ROWS UNBOUNDED PRECEDING) AS session FROM marked),
 incidents AS (SELECT src AS src_ip, family, max(sev) AS sev, max(priority) AS priority, count(*) AS events, count(DISTINCT dst) AS targets, count(DISTINCT port) AS ports, min(seen_at) AS opened, max(seen_at) AS last_seen,
 2 * count(*) FILTER (verdict = 'NOVEL_SUSPICIOUS') > count(*) AS hunting, min(row_id) AS first_alert, max(p) AS p, CASE count(DISTINCT segment) WHEN 0 THEN NULL WHEN 1 THEN min(segment) ELSE 'mixed' END AS segment FROM grouped GROUP BY src, family, session)"""


@query("a41_incidents", f"WITH {INCIDENTS} SELECT * FROM incidents")
def all_incidents(spark, d):
    return incidents(spark, d)


@query("w6_compression", f"WITH {INCIDENTS} SELECT (SELECT count(*) FROM alerts WHERE verdict <> 'BENIGN') AS alerts, (SELECT count(*) FROM alerts WHERE verdict <> 'BENIGN' AND src IS NULL) AS unassigned, count(*) AS incidents, CAST(sum(events) // count(*) AS BIGINT) AS compression FROM incidents")
def compression(spark, d):
    counted = alerts(spark, d).where(al.actionable(F.col("a.verdict"))).agg(F.count("*").alias("alerts"), F.count_if(F.col("a.src_ip").isNull()).alias("unassigned"))
    return counted.crossJoin(incidents(spark, d).agg(F.count("*").alias("incidents"), F.floor(F.sum("events") / F.count("*")).alias("compression")))  # one row each


@query("t4_top_incidents", f"WITH {INCIDENTS} SELECT src_ip, family, first_alert, priority, events FROM incidents WHERE NOT hunting AND segment = 'seg1' ORDER BY priority DESC, last_seen DESC, first_alert LIMIT 20")
def top_incidents(spark, d):
    rows = incidents(spark, d).where(~F.col("hunting") & (F.col("segment") == "seg1"))
    return rows.orderBy(F.desc("priority"), F.desc("last_seen"), "first_alert").limit(20).select("src_ip", "family", "first_alert", "priority", "events")


@query("t9_largest_incidents", f"WITH {INCIDENTS} SELECT first_alert, priority, events FROM incidents ORDER BY priority DESC, events DESC, first_alert LIMIT 25")
def largest_incidents(spark, d):
    return incidents(spark, d).orderBy(F.desc("priority"), F.desc("events"), "first_alert").limit(25).select("first_alert", "priority", "events")


@query("j9_alerts_of_incidents", f"WITH {INCIDENTS} SELECT i.first_alert, count(*) AS n, max(a.row_id) AS last_alert FROM incidents i JOIN alerts a ON a.src = i.src_ip AND a.family IS NOT DISTINCT FROM i.family AND a.seen_at BETWEEN i.opened AND i.last_seen AND a.verdict <> 'BENIGN' GROUP BY 1")
def alerts_of_incidents(spark, d):
    """Times of incidents of one source and family never meet, so that the alerts within an incident's time are its own; those without a time are in none."""
    timed = F.col("at").isNotNull()
    made = grouped(spark, d).agg(F.min("alert_id").alias("first_alert"), F.count("at").alias("n"), F.max(F.when(timed, F.col("alert_id"))).alias("last_alert")).where("n > 0")
    return made.groupBy("first_alert").agg(F.sum("n").alias("n"), F.max("last_alert").alias("last_alert"))


@query("t2_hunting_overflow", f"WITH {ALERTS} SELECT strftime(seen_at, '%Y-%m-%d') AS day, greatest(0, count(*) - 2) AS overflow FROM alerts WHERE verdict = 'NOVEL_SUSPICIOUS' GROUP BY 1")
def hunting_overflow(spark, d):
    rows = alerts(spark, d).where("a.verdict = 'NOVEL_SUSPICIOUS'")
    return rows.groupBy(F.date_format("a.at", "yyyy-MM-dd").alias("day")).agg(F.greatest(F.lit(0), F.count("*") - 2).alias("overflow"))


@query("t6_response_order", f"WITH {SUPPRESSED} SELECT row_id, verdict <> 'BENIGN' AS alerting, p FROM sup ORDER BY alerting DESC, p DESC, row_id LIMIT 100")
def response_order(spark, d):
    rows = alerts(spark, d).select(F.col("a.alert_id").alias("row_id"), al.actionable(F.col("a.verdict")).alias("alerting"), F.col("a.p_attack").alias("p"))
    return rows.orderBy(F.desc("alerting"), F.desc("p"), "row_id").limit(100)


@query("a47_workbook", f"""WITH {SUPPRESSED} SELECT 'suppressed by rule' AS panel, rule_id AS key, count(*) AS n, max(seen_at) AS latest FROM sup WHERE rule_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'verdicts', verdict, count(*), max(seen_at) FROM sup GROUP BY 2
 UNION ALL SELECT 'abstentions by month', strftime(seen_at, '%Y-%m'), count(*) FILTER (abstains), max(seen_at) FROM sup GROUP BY 2 UNION ALL SELECT 'needs approval', CAST(sev = 4 AS VARCHAR), count(*), max(seen_at) FROM sup GROUP BY 2
 UNION ALL SELECT * FROM (SELECT 'top sources', src, count(*) AS n, max(seen_at) FROM sup WHERE src IS NOT NULL GROUP BY 2 ORDER BY n DESC, src LIMIT 20) UNION ALL SELECT 'segments', coalesce(segment, 'none'), count(*), max(seen_at) FROM sup GROUP BY 2""")
def workbook(spark, d):
    rows = suppressed(spark, d)
    panel = lambda name, key, n=None, of=rows: of.groupBy(F.lit(name).alias("panel"), key.alias("key")).agg((n if n is not None else F.count("*")).alias("n"), F.max("at").alias("latest"))
    parts = [
        panel("suppressed by rule", F.col("rule_id"), of=rows.where("rule_id is not null")), panel("verdicts", F.col("verdict")), panel("abstentions by month", F.date_format("at", "yyyy-MM"), F.count_if(F.col("agreement") == 3)),
        panel("needs approval", F.col("needs_approval").cast("string")), panel("top sources", F.col("src_ip"), of=rows.where("src_ip is not null")).orderBy(F.desc("n"), "key").limit(20), panel("segments", F.coalesce("segment", F.lit("none"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


VERDICTS = """verdicts AS (SELECT o_orderkey AS verdict_id, o_orderkey % 97 AS target_id, CASE WHEN o_orderkey % 3 = 0 THEN 'incident' ELSE 'alert' END AS target_kind, CASE WHEN o_orderstatus = 'F' THEN 'malicious' ELSE 'benign' END AS verdict,
 'actor' || o_custkey % 7 AS actor, o_orderdate AS seen_at, o_orderkey % 11 = 0 AS promoted FROM orders)"""


def verdicts(spark, d):
    o = F.col("o_orderkey")
    return read(spark, d, "orders").select(o.alias("verdict_id"), (o % 97).alias("target_id"), F.when(o % 3 == 0, "incident").otherwise("alert").alias("target_kind"), F.when(F.col("o_orderstatus") == "F", "malicious").otherwise("benign").alias("verdict"),
        F.concat(F.lit("actor"), (F.col("o_custkey") % 7).cast("string")).alias("actor"), F.col("o_orderdate").alias("at"), (o % 11 == 0).alias("promoted"))


@query("q3_recorded_verdicts", f"""WITH {VERDICTS}, ranked AS (SELECT *, bool_or(promoted) OVER (PARTITION BY target_kind, target_id) AS locked, row_number() OVER (PARTITION BY target_kind, target_id ORDER BY promoted DESC, CASE WHEN promoted THEN seen_at END, CASE WHEN promoted THEN verdict_id END, seen_at DESC, verdict_id DESC) AS k FROM verdicts)
 SELECT target_kind, target_id, verdict, actor, locked FROM ranked WHERE k = 1""")
def recorded_verdicts(spark, d):
    """What stands for each target: its first promoted verdict, which later ones don't replace, else its latest."""
    v = verdicts(spark, d)
    promoted = F.min(F.when(F.col("promoted"), F.struct("at", "verdict_id", "verdict", "actor")))
    latest = F.max(F.struct("at", "verdict_id", "verdict", "actor"))
    by = v.groupBy("target_kind", "target_id").agg(F.coalesce(promoted, latest).alias("x"), F.bool_or("promoted").alias("locked"))
    return by.select("target_kind", "target_id", "x.verdict", "x.actor", "locked")


@query("q4_pending_verdicts", f"WITH {VERDICTS} SELECT verdict_id, target_kind, target_id, actor FROM verdicts WHERE NOT promoted ORDER BY seen_at, verdict_id LIMIT 50")
def pending_verdicts(spark, d):
    return verdicts(spark, d).where("not promoted").orderBy("at", "verdict_id").limit(50).select("verdict_id", "target_kind", "target_id", "actor")


@query("q5_promotions", f"""WITH {VERDICTS}, asked AS (SELECT verdict_id, 'malicious' AS expected, 'actor1' AS approver FROM verdicts WHERE verdict_id % 2 = 0)
 SELECT actor, count(*) AS n, count(*) FILTER (NOT promoted AND actor <> approver AND verdict = expected) AS done, count(*) FILTER (NOT promoted AND actor = approver) AS own, count(*) FILTER (NOT promoted AND actor <> approver AND verdict <> expected) AS moved FROM verdicts JOIN asked USING (verdict_id) GROUP BY 1""")
def promotions(spark, d):
    """Verdicts that an approver may promote: not their own, and with the label that the approver saw."""
    v = verdicts(spark, d)
    asked = v.where("verdict_id % 2 = 0").select("verdict_id", F.lit("malicious").alias("expected"), F.lit("actor1").alias("approver"))
    rows, waits = v.join(asked, "verdict_id"), ~F.col("promoted")
    own, same = F.col("actor") == F.col("approver"), F.col("verdict") == F.col("expected")
    return rows.groupBy("actor").agg(F.count("*").alias("n"), F.count_if(waits & ~own & same).alias("done"), F.count_if(waits & own).alias("own"), F.count_if(waits & ~own & ~same).alias("moved"))


@query("q6_flagged_actors", f"""WITH {VERDICTS}, per AS (SELECT actor, count(*) AS n, count(*) FILTER (verdict = 'benign') AS b FROM verdicts GROUP BY 1), al AS (SELECT sum(n) AS tn, sum(b) AS tb FROM per),
 z AS (SELECT actor, n, b / n AS share, (tb - b) / (tn - n) AS peers, (b / n - (tb - b) / (tn - n)) / sqrt((tb - b) / (tn - n) * (1 - (tb - b) / (tn - n)) / n) AS z FROM per, al) SELECT actor, n, z > 1 AS lenient, z < -1 AS strict, n >= 100 AS enough FROM z""")
def flagged_actors(spark, d):
    """Flags of actors whose share of benign verdicts differs from all others' taken together."""
    by = verdicts(spark, d).groupBy("actor").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "benign").alias("b"))
    rows = by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("tn"), F.sum("b").alias("tb"))))  # one row of totals
    peers = (F.col("tb") - F.col("b")) / (F.col("tn") - F.col("n"))
    z = (F.col("b") / F.col("n") - peers) / F.sqrt(peers * (1 - peers) / F.col("n"))
    return rows.select("actor", "n", (z > 1).alias("lenient"), (z < -1).alias("strict"), (F.col("n") >= 100).alias("enough"))


@query("q7_active_suppressions", "SELECT * FROM (VALUES ('r2', 1), ('r3', 0), ('r7', 0), ('r1', 1)) t(rule_id, active) WHERE active = 1")
def active_suppressions(spark, d):
    now = F.lit("2024-01-12").cast("timestamp")
    rows = rules(spark).where(al.active(F.col("created"), F.col("expires"), now) & (F.size(al.rule_problems(F.col("match"), F.col("created"), F.col("expires"))) == 0))
    return rows.select("rule_id", F.lit(1).alias("active"))


@query("z18_revoked_suppressions", "SELECT * FROM (VALUES ('r1', TIMESTAMP '2024-01-12'), ('r2', TIMESTAMP '2024-01-12'), ('r7', TIMESTAMP '2024-01-02')) t(rule_id, expires)")
def revoked_suppressions(spark, d):
    """Rules after all were revoked on a day: they expire then, at the earliest a microsecond after they began; rows stay."""
    now = F.lit("2024-01-12").cast("timestamp")
    until = F.least("expires", F.greatest(now, F.col("created") + F.expr("interval 1 microsecond")))
    return rules(spark).where(F.size(al.rule_problems(F.col("match"), F.col("created"), F.col("expires"))) == 0).select("rule_id", until.cast("timestamp_ntz").alias("expires"))


@query("q8_exported_store", f"WITH {INCIDENTS} SELECT 'alerts' AS kind, count(*) AS n, count(family) AS with_family FROM alerts UNION ALL SELECT 'incidents', count(*), count(family) FROM incidents")
def exported_store(spark, d):
    """The store's rows as lines of JSON, read back."""
    kinds = {"alerts": alerts(spark, d).select("a.*", "segment"), "incidents": incidents(spark, d)}
    out = None
    for kind, rows in kinds.items():
        lines = rows.select(F.to_json(F.struct("*")).alias("line"))
        back = lines.select(F.from_json("line", "struct<family:string>").alias("x")).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count("x.family").alias("with_family"))
        out = back if out is None else out.unionByName(back)
    return out


@query("z17_audit_filters", """SELECT 'action' AS by, event_type AS key, count(*) AS n, max(event_id) AS latest FROM events GROUP BY 2 UNION ALL SELECT 'actor', CAST(user_id AS VARCHAR), count(*), max(event_id) FROM events WHERE user_id < 5 GROUP BY 2""")
def audit_filters(spark, d):
    e = read(spark, d, "events")
    of = lambda rows, name, key: rows.groupBy(F.lit(name).alias("by"), key.alias("key")).agg(F.count("*").alias("n"), F.max("event_id").alias("latest"))
    return of(e, "action", F.col("event_type")).unionByName(of(e.where("user_id < 5"), "actor", F.col("user_id").cast("string")))


@query("t14_audit_tail", "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def audit_tail(spark, d):
    return read(spark, d, "events").orderBy(F.desc("event_id")).limit(25).select("event_id", "user_id", "event_type")


@query("r14_grouped_incidents", """WITH m AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 5 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, min(ts) AS opened, max(ts) AS last_seen, count(*) AS n FROM g GROUP BY user_id, s""")
def grouped_incidents(spark, d):
    """Errors of a user that lie no more than five hours apart, by event-time session windows."""
    rows = read(spark, d, "events").where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    by = rows.groupBy("user_id", F.session_window("ts", "5 hours").alias("w")).agg(F.min("ts").alias("opened"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    return by.select("user_id", F.col("opened").cast("timestamp_ntz").alias("opened"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n")
