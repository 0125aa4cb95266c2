"""Queries over the test tables, each with its SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spillway.functions import scoring
from spillway.operators import intervals, metrics, ordered, splits, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def flows(spark: SparkSession, d: str) -> DataFrame:
    """Line items as labelled flows: y, p in [0, 1) and a novelty rank stand-in."""
    return read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
        (F.col("l_returnflag") == "R").cast("int").alias("y"), ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_linenumber")) % 1000 / 1000.0).alias("p"), (F.col("l_orderkey") * 7 % 1000 / 1000.0).alias("nov"), (F.col("l_linenumber") % 4).alias("agr"),
    )


FLOWS = """flows AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_suppkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
 CAST(l_returnflag = 'R' AS INT) AS y, (l_partkey * 37 + l_suppkey * 11 + l_linenumber) % 1000 / 1000.0::DOUBLE AS p, l_orderkey * 7 % 1000 / 1000.0::DOUBLE AS nov, l_linenumber % 4 AS agr FROM lineitem)"""


@query("a1_family_counts", "SELECT event_type AS family, count(*) AS n, avg(CAST(value > 50 AS INT)) AS prevalence FROM events GROUP BY 1")
def family_counts(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("n"), F.avg((F.col("value") > 50).cast("int")).alias("prevalence"))


@query("p9_verdicts", f"""WITH {FLOWS} SELECT CASE WHEN p >= .8 THEN 'KNOWN_ATTACK' WHEN nov >= .99 AND agr >= 1 THEN 'NOVEL_SUSPICIOUS' WHEN p >= .4 OR agr = 3 THEN 'UNCERTAIN' ELSE 'BENIGN' END AS verdict,
 CASE WHEN p >= .9 OR nov >= .999 THEN 'HIGH' WHEN p >= .8 OR nov >= .99 THEN 'MEDIUM' WHEN p >= .4 THEN 'LOW' ELSE 'INFORMATIONAL' END AS severity, count(*) AS n, CAST(sum(round_even(least(1.0, greatest(p, nov) + .04 * least(agr, 3)) * 100, 0)) AS BIGINT) AS priorities FROM flows GROUP BY 1, 2""")
def verdicts(spark, d):
    p, nov, agr = F.col("p"), F.col("nov"), F.col("agr")
    rows = flows(spark, d).select(scoring.verdict(p, nov, agr, agr == 3).alias("verdict"), scoring.severity(p, nov).alias("severity"), scoring.priority(p, nov, agr).alias("x"))
    return rows.groupBy("verdict", "severity").agg(F.count("*").alias("n"), F.sum("x").alias("priorities"))


@query("p13_fired", f"WITH {FLOWS} SELECT CAST(p >= .8 AS INT) + 2 * CAST(nov >= .99 AS INT) AS fired, count(*) AS n FROM flows GROUP BY 1")
def fired(spark, d):
    return flows(spark, d).groupBy(scoring.fired(F.col("p"), F.col("nov"), 0.8, 0.99).alias("fired")).agg(F.count("*").alias("n"))


@query("a3_leaky_values", f"""WITH {FLOWS}, x AS (SELECT y, 'l_linestatus' AS feature, l_linestatus AS value FROM flows UNION ALL SELECT y, 'l_returnflag', l_returnflag FROM flows),
 g AS (SELECT feature, value, count(*) AS support, avg(y) AS r FROM x GROUP BY 1, 2) SELECT feature, value, support, greatest(r, 1 - r) AS purity FROM g WHERE greatest(r, 1 - r) >= .99 AND support >= greatest(20, (SELECT CAST(floor(.01 * count(*)) AS BIGINT) FROM flows))""")
def leaky(spark, d):
    return metrics.leaky_values(flows(spark, d), "y", ["l_linestatus", "l_returnflag"])


@query("a4_duplicate_rows", "SELECT count(*) AS n, count(*) - count(DISTINCT (l_quantity, l_discount, l_tax, l_returnflag)) AS duplicates FROM lineitem")
def duplicate_rows(spark, d):
    rounded = [F.round(c, 6) for c in ("l_quantity", "l_discount", "l_tax")]
    key = F.sha2(F.to_json(F.array(*[F.coalesce(x.cast("string"), F.lit("null:")) for x in (*rounded, F.col("l_returnflag"))])), 256)  # a null keeps its place
    by = read(spark, d, "lineitem").groupBy(key.alias("k")).count()
    return by.agg(F.sum("count").alias("n"), (F.sum("count") - F.count("*")).alias("duplicates"))


@query("j2_overlap", "SELECT count(*) AS n FROM (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0) a SEMI JOIN (SELECT text FROM documents WHERE doc_id % 2 = 1) b USING (text)")
def overlap(spark, d):
    docs = read(spark, d, "documents").select((F.col("doc_id") % 2).alias("part"), F.sha2("text", 256).alias("h"))
    return docs.where("part = 0").select("h").distinct().join(docs.where("part = 1"), "h", "left_semi").agg(F.count("*").alias("n"))


@query("j3_target_rates", """WITH r AS (SELECT event_type, avg(value) AS rate FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT e.event_type, count(*) AS n, avg(coalesce(rate, (SELECT avg(value) FROM events WHERE event_id % 2 = 0))) AS encoded FROM events e LEFT JOIN r USING (event_type) WHERE event_id % 2 = 1 GROUP BY 1""")
def target_rates(spark, d):
    ev = read(spark, d, "events")
    train = ev.where("event_id % 2 = 0")
    prior = train.agg(F.avg("value")).first()[0]
    rates = train.groupBy("event_type").agg(F.avg("value").alias("rate"))
    return ev.where("event_id % 2 = 1").join(rates, "event_type", "left").groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.coalesce("rate", F.lit(prior))).alias("encoded"))


@query("a5_majority_ceiling", """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_suppkey, max(n) AS m, sum(n) AS n FROM c GROUP BY 1) SELECT count(*) AS keys, sum(m) / sum(n) AS ceiling FROM m""")
def majority_ceiling(spark, d):
    c = read(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").count().groupBy("l_suppkey").agg(F.max("count").alias("m"), F.sum("count").alias("n"))
    return c.agg(F.count("*").alias("keys"), (F.sum("m") / F.sum("n")).alias("ceiling"))


@query("a6_confusion", f"""WITH {FLOWS} SELECT *, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr, tp / (tp + fp) AS precision FROM (SELECT count(*) FILTER (p >= .8 AND y = 1) AS tp, count(*) FILTER (p >= .8 AND y = 0) AS fp, count(*) FILTER (p < .8 AND y = 0) AS tn, count(*) FILTER (p < .8 AND y = 1) AS fn, avg((p - y) ^ 2) AS brier FROM flows)""")
def confusion(spark, d):
    return metrics.confusion(flows(spark, d), "y", "p", 0.8)


@query("a9_recall_at_fpr", f"""WITH {FLOWS}, b AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM flows GROUP BY p), c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM b), t AS (SELECT sum(y) AS np, sum(1 - y) AS nn FROM flows) SELECT max(tp / np) AS recall, min(p) AS threshold FROM c, t WHERE fp / nn <= .1""")
def recall_at_fpr(spark, d):
    return metrics.recall_at_fpr(flows(spark, d), "y", "p", 0.1)


@query("a11_precision_at_k", f"WITH {FLOWS} SELECT avg(y) AS precision FROM (SELECT y FROM flows ORDER BY p DESC, row_id LIMIT 100)")
def precision_at_k(spark, d):
    return flows(spark, d).orderBy(F.desc("p"), "row_id").limit(100).agg(F.avg("y").alias("precision"))


@query("a13_roc_auc", f"""WITH {FLOWS}, b AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM flows GROUP BY p), c AS (SELECT pos, neg, sum(neg) OVER (ORDER BY p) - neg AS below FROM b) SELECT sum(pos * below + pos * neg / 2) / (sum(pos) * sum(neg)) AS roc_auc FROM c""")
def roc_auc(spark, d):
    return metrics.auc(flows(spark, d), "y", "p")


@query("a18_reliability", f"WITH {FLOWS} SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS mean_score, avg(y) AS observed FROM flows GROUP BY 1")
def reliability(spark, d):
    return metrics.reliability(flows(spark, d), "y", "p")


@query("a21_benign_threshold", f"WITH {FLOWS} SELECT quantile_cont(p, .99) AS threshold FROM flows WHERE y = 0")
def benign_threshold(spark, d):
    return spark.createDataFrame([(metrics.quantiles(flows(spark, d).where("y = 0"), ["p"], [0.99])["p"][0],)], "threshold double")


@query("a22_conformal", f"""WITH {FLOWS}, s AS (SELECT y, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM flows), r AS (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY s) AS k, count(*) OVER (PARTITION BY y) AS n FROM s) SELECT y, s AS quantile FROM r WHERE k = ceil(least(1, ceil((n + 1) * .9) / n) * (n - 1)) + 1""")
def conformal(spark, d):
    s = flows(spark, d).select("y", F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p")).alias("s"))
    at = lambda n: [math.ceil(min(1.0, math.ceil((n + 1) * 0.9) / n) * (n - 1))]
    return spark.createDataFrame([(y, metrics.order_statistics(s.where(F.col("y") == y), "s", at)[0]) for y in (0, 1)], "y int, quantile double")


@query("a24_psi", f"""WITH {FLOWS}, e AS (SELECT list_distinct(list_value(quantile_cont(p, .1), quantile_cont(p, .2), quantile_cont(p, .3), quantile_cont(p, .4), quantile_cont(p, .5), quantile_cont(p, .6), quantile_cont(p, .7), quantile_cont(p, .8), quantile_cont(p, .9))) AS e FROM flows WHERE y = 0),
 b AS (SELECT y, len(list_filter(e, lambda x: x <= p)) AS bin FROM flows, e), g AS (SELECT bin, sum(1 - y) / (SELECT sum(1 - y) FROM b) AS e, sum(y) / (SELECT sum(y) FROM b) AS a FROM b GROUP BY 1) SELECT sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6))) AS psi FROM g""")
def psi(spark, d):
    f = flows(spark, d)
    return metrics.psi(f.where("y = 0"), f.where("y = 1"), "p")


@query("a26_ks", f"""WITH {FLOWS}, b AS (SELECT l_quantity AS v, sum(1 - y) AS r, sum(y) AS c FROM flows GROUP BY 1), w AS (SELECT sum(r) OVER (ORDER BY v) AS cr, sum(c) OVER (ORDER BY v) AS cc FROM b) SELECT max(abs(cr / (SELECT sum(r) FROM b) - cc / (SELECT sum(c) FROM b))) AS statistic FROM w""")
def ks(spark, d):
    f = flows(spark, d)
    return metrics.ks(f.where("y = 0"), f.where("y = 1"), "l_quantity")


@query("a31_mcnemar", f"WITH {FLOWS} SELECT count(*) FILTER ((p >= .5) = (y = 1) AND (nov >= .5) <> (y = 1)) AS only_a, count(*) FILTER ((p >= .5) <> (y = 1) AND (nov >= .5) = (y = 1)) AS only_b FROM flows")
def mcnemar(spark, d):
    a, b = (F.col("p") >= 0.5) == (F.col("y") == 1), (F.col("nov") >= 0.5) == (F.col("y") == 1)
    return flows(spark, d).agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))


@query("a39_actor_profiles", """WITH g AS (SELECT o_custkey AS actor, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS cleared FROM orders GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(cleared) AS tc FROM g), r AS (SELECT actor, n, cleared, greatest(.5 / (tn - n), least(1 - .5 / (tn - n), (tc - cleared) / (tn - n))) AS peer FROM g, t) SELECT actor, n, cleared, peer, (cleared / n - peer) / sqrt(peer * (1 - peer) / n) AS z FROM r""")
def actor_profiles(spark, d):
    g = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("actor")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("cleared"))
    t = g.agg(F.sum("n").alias("tn"), F.sum("cleared").alias("tc"))
    rest = F.col("tn") - F.col("n")
    peer = F.greatest(0.5 / rest, F.least(1 - 0.5 / rest, (F.col("tc") - F.col("cleared")) / rest))
    out = g.crossJoin(F.broadcast(t)).withColumn("peer", peer)  # one row of totals
    return out.select("actor", "n", "cleared", "peer", ((F.col("cleared") / F.col("n") - F.col("peer")) / F.sqrt(F.col("peer") * (1 - F.col("peer")) / F.col("n"))).alias("z"))


@query("a46_scheduled_rule", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, count(DISTINCT event_type) AS kinds, max(value) AS worst FROM events WHERE value > 10 GROUP BY 1 HAVING count(*) >= 5")
def scheduled_rule(spark, d):
    g = read(spark, d, "events").where("value > 10").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.max("value").alias("worst"))
    return g.where("n >= 5")


@query("a47_by_hour", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY 1, 2")
def by_hour(spark, d):
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))


@query("w1_trailing_features", """WITH p AS (SELECT a.event_id, b.event_type AS o, b.ts FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL 60 SECOND * 60 AND (b.ts < a.ts OR b.ts = a.ts AND b.event_id < a.event_id)),
 c AS (SELECT event_id, o, count(*) AS k FROM p GROUP BY 1, 2), e AS (SELECT event_id, sum(k) AS n, count(*) AS u FROM c GROUP BY 1), h AS (SELECT c.event_id, -sum(k / n * log2(k / n)) AS h FROM c JOIN e USING (event_id) GROUP BY 1),
 g AS (SELECT event_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / nullif(count(*) - 1, 0) AS gap FROM p GROUP BY 1)
 SELECT v.event_id, coalesce(n, 0)::BIGINT AS flows, coalesce(u, 0) AS distinct_others, round(coalesce(h, 0), 9) + 0.0 AS entropy, coalesce(u / n, 0) AS fanout_ratio, coalesce(gap, 0) AS mean_gap FROM events v LEFT JOIN e USING (event_id) LEFT JOIN h USING (event_id) LEFT JOIN g USING (event_id)""")
def trailing_features(spark, d):
    ev = read(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    out = windows.trailing(ev, "user_id", "event_type", "ts", "event_id", seconds=3600)
    return out.select("event_id", "flows", "distinct_others", (F.round("entropy", 9) + 0.0).alias("entropy"), "fanout_ratio", "mean_gap")


@query("w4_trailing_hundred", """WITH p AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS pos FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY pos RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING) AS n FROM p""")
def trailing_hundred(spark, d):
    ev = read(spark, d, "events").select("event_id", "user_id")
    pos = ordered.positions(ev, "event_id")
    return pos.select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("pos").rangeBetween(-100, -1)).alias("n"))


@query("w5_incident_sessions", """WITH s AS (SELECT *, coalesce(CAST(ts > lag(ts) OVER w + INTERVAL 15 MINUTE AS INT), 0) AS b FROM events WHERE value > 10 WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS session FROM s)
 SELECT user_id, event_type, CAST(session AS BIGINT) AS session, min(ts) AS opened_at, max(ts) AS last_seen_at, count(*) AS event_count, max(value) AS worst FROM i GROUP BY 1, 2, 3""")
def incident_sessions(spark, d):
    ev = read(spark, d, "events").where("value > 10").select("event_id", "user_id", "event_type", "ts", "value")
    s = windows.sessions(ev, ["user_id", "event_type"], "ts", "event_id", "15 minutes")
    return s.groupBy("user_id", "event_type", "session").agg(F.min("ts").alias("opened_at"), F.max("ts").alias("last_seen_at"), F.count("*").alias("event_count"), F.max("value").alias("worst"))


@query("w8_benign_budget", f"""WITH {FLOWS}, r AS (SELECT y, coalesce(sum(1 - y) OVER (ORDER BY p DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM flows) SELECT count(*) AS flagged, CAST(sum(y) AS BIGINT) AS attacks FROM r WHERE b < 50""")
def benign_budget(spark, d):
    return windows.at_most_benign(flows(spark, d).select("y", "p", "row_id"), "y", "p", "row_id", 50).where("flagged").agg(F.count("*").alias("flagged"), F.sum("y").alias("attacks"))


@query("t1_lanes", f"""WITH {FLOWS}, v AS (SELECT row_id, CASE WHEN p >= .8 THEN 'known' WHEN nov >= .99 THEN 'hunting' END AS lane, p, nov FROM flows), r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY CASE WHEN lane = 'hunting' THEN nov ELSE p END DESC, row_id) AS k FROM v WHERE lane IS NOT NULL) SELECT lane, row_id, k FROM r WHERE lane = 'known' OR k <= 50""")
def lanes(spark, d):
    v = flows(spark, d).select("row_id", F.when(F.col("p") >= 0.8, "known").when(F.col("nov") >= 0.99, "hunting").alias("lane"), "p", "nov").where("lane is not null")
    v = v.withColumn("key", F.when(F.col("lane") == "hunting", F.col("nov")).otherwise(F.col("p"))).select("lane", "key", "row_id")
    return ordered.places(v, "lane", [F.desc("key"), F.asc("row_id")], "k").where("lane = 'known' or k <= 50").select("lane", "row_id", F.col("k").cast("int").alias("k"))


@query("j7_promoted_rows", """SELECT o_orderkey AS target, o_orderpriority AS verdict, count(*) AS features FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1, 2""")
def promoted_rows(spark, d):
    o = read(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority <> '5-LOW'").select("o_orderkey", "o_orderpriority")
    li = read(spark, d, "lineitem").select("l_orderkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderkey").alias("target"), F.col("o_orderpriority").alias("verdict")).agg(F.count("*").alias("features"))


@query("j14_unjudged", "SELECT c_custkey, c_mktsegment FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def unjudged(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_mktsegment")


@query("p19_segment_scope", "SELECT c_mktsegment AS segment, count(*) AS n, sum(c_acctbal) AS balance FROM customer WHERE c_mktsegment IS NULL OR c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def segment_scope(spark, d):
    c = read(spark, d, "customer").where(F.col("c_mktsegment").isNull() | F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@query("e2_frequency_encoding", "WITH f AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) AS f FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey, coalesce(f, 0) AS encoded FROM part LEFT JOIN f USING (p_brand) WHERE p_partkey % 2 = 1")
def frequency_encoding(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    train = part.where("p_partkey % 2 = 0")
    f = train.groupBy("p_brand").agg((F.count("*") / F.lit(train.count())).alias("f"))
    return part.where("p_partkey % 2 = 1").join(f, "p_brand", "left").select("p_partkey", F.coalesce("f", F.lit(0.0)).alias("encoded"))


@query("b1_bm25", """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l), f AS (SELECT doc_id, w, count(*) AS tf FROM t WHERE w IN ('the', 'that', 'token') GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM f GROUP BY 1)
 SELECT doc_id, round(sum(ln((docs - df + .5) / (df + .5) + 1) * tf * 2.5 / (tf + 1.5 * (.25 + .75 * n / mean))), 6) AS score FROM f JOIN df USING (w) JOIN l USING (doc_id), s GROUP BY 1""")
def bm25(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    docs = read(spark, d, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w"))
    docs = docs.select("doc_id", "n", F.filter("w", lambda x: x.isin("the", "that", "token")).alias("w"))
    stats = docs.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    f = docs.select("doc_id", "n", F.explode("w").alias("w")).groupBy("doc_id", "n", "w").agg(F.count("*").alias("tf"))
    df = f.groupBy("w").agg(F.count("*").alias("df"))
    part = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("n") / F.col("mean")))
    scored = f.join(F.broadcast(df), "w").crossJoin(F.broadcast(stats))  # a row for each query word; one row of totals
    return scored.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))


@query("r13_sliding_rule", """WITH w AS (SELECT user_id, value, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS s FROM events) SELECT s AS window_start, user_id, count(*) AS n, sum(value) AS total FROM w GROUP BY 1, 2 HAVING count(*) >= 2""")
def sliding_rule(spark, d):
    g = read(spark, d, "events").groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.where("n >= 2").select(F.col("w.start").alias("window_start"), "user_id", "n", "total")


@query("u9_latest_wins", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_wins(spark, d):
    c = read(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("x")).select("conv_id", "x.turn", "x.role")


@query("q11_stratified_sample", f"""WITH {FLOWS}, o AS (SELECT row_id, y, row_number() OVER (PARTITION BY y ORDER BY CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':pool'), 1, 8) AS BIGINT), row_id) AS k FROM flows) SELECT row_id, y FROM o WHERE k <= 50""")
def stratified_sample(spark, d):
    """The 50 first flows of each class by a hash (the feature is a sample)."""
    taken = splits.first_of_each(flows(spark, d), "y", intervals.uniform(F.col("row_id"), F.lit("pool")), "row_id", F.lit(50))
    return taken.where("taken").select("row_id", "y")
