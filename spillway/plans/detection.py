"""Detection, review and audit queries, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from spillway.functions import rules
from spillway.operators import metrics, ordered, rates
from spillway.plans.queries import FLOWS, ORACLE_SQL, flows, query, read

BUDGETS = [0.001, 0.005, 0.01, 0.02, 0.05, 0.1]


@query("p14_conformal_sets", f"WITH {FLOWS} SELECT concat_ws(',', CASE WHEN 1 - (1 - p) <= .7 THEN 'benign' END, CASE WHEN 1 - p <= .6 THEN 'attack' END) AS labels, count(*) AS n FROM flows GROUP BY 1")
def conformal_sets(spark, d):
    p = F.col("p")
    labels = F.concat_ws(",", F.when(1 - (1 - p) <= 0.7, "benign"), F.when(1 - p <= 0.6, "attack"))
    return flows(spark, d).groupBy(labels.alias("labels")).agg(F.count("*").alias("n"))


@query("p22_stride", "SELECT event_id, user_id FROM events QUALIFY (row_number() OVER (ORDER BY event_id) - 1) % 10 = 0")
def stride(spark, d):
    """Every tenth event (the feature is a sample)."""
    return ordered.positions(read(spark, d, "events").select("event_id", "user_id"), "event_id").where("(pos - 1) % 10 = 0").drop("pos")


#: Rules in order; the first that matches names the flow.
PACK = [("large_discounted", [("l_quantity", ">", 30.0), ("l_quantity", ">", 40.0), ("l_discount", ">", 0.05)]), ("small", [("l_quantity", "<=", 5.0)]), ("costly", [("l_extendedprice", ">", 50000.0)])]


@query("p26_rule_pack", "SELECT CASE WHEN l_quantity > 40 AND l_discount > .05 THEN 'large_discounted' WHEN l_quantity <= 5 THEN 'small' WHEN l_extendedprice > 50000 THEN 'costly' END AS rule, count(*) AS n FROM lineitem GROUP BY 1 HAVING rule IS NOT NULL")
def rule_pack(spark, d):
    named = read(spark, d, "lineitem").select(rules.first_match(PACK).alias("rule"))
    return named.where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"))


@query("j5_majority_lookup", """WITH c AS (SELECT o_custkey, o_orderpriority AS f, count(*) AS k FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), m AS (SELECT o_custkey, f FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC, f) = 1)
 SELECT count(*) AS n, count(f) AS covered, count(*) FILTER (f = o_orderpriority) AS correct FROM orders LEFT JOIN m USING (o_custkey) WHERE o_orderkey % 2 = 1""")
def majority_lookup(spark, d):
    """Test rows (odd keys) whose key was trained on (even keys), and those its majority family names."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("family"))
    k = o.where("o_orderkey % 2 = 0").groupBy("o_custkey", "family").agg(F.count("*").alias("k"))
    top = k.groupBy("o_custkey").agg(F.min(F.struct((-F.col("k")).alias("k"), "family")).alias("x")).select("o_custkey", F.col("x.family").alias("majority"))
    rows = o.where("o_orderkey % 2 = 1").join(top, "o_custkey", "left")
    return rows.agg(F.count("*").alias("n"), F.count("majority").alias("covered"), F.count_if(F.col("majority") == F.col("family")).alias("correct"))


@query("j12_shadow", """WITH a AS (SELECT event_id, least(value / 200, 1) AS p FROM events), b AS (SELECT event_id, event_id * 37 % 1000 / 1000.0::DOUBLE AS q FROM events)
 SELECT count(*) AS n, count(*) FILTER (p >= .8 AND q >= .8) AS both, count(*) FILTER (p >= .8 AND q < .8) AS only_champion, count(*) FILTER (p < .8 AND q >= .8) AS only_challenger, avg(abs(p - q)) AS mean_gap FROM a JOIN b USING (event_id)""")
def shadow(spark, d):
    """A champion's and a challenger's scores of the same events, from two frames."""
    e = read(spark, d, "events")
    champion = e.select("event_id", F.least(F.col("value") / 200, F.lit(1.0)).alias("p"))
    challenger = e.select("event_id", (F.col("event_id") * 37 % 1000 / 1000.0).alias("q"))
    a, b = F.col("p") >= 0.8, F.col("q") >= 0.8
    return champion.join(challenger, "event_id").agg(F.count("*").alias("n"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_champion"), F.count_if(~a & b).alias("only_challenger"), F.avg(F.abs(F.col("p") - F.col("q"))).alias("mean_gap"))


@query("a17_budget_curve", f"""WITH {FLOWS}, b AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM flows GROUP BY 1), w AS (SELECT sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM b), t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM b)
 SELECT target, coalesce(max(tp) FILTER (fp / t.n <= target), 0) / max(t.p) AS recall FROM w, t, (SELECT unnest({BUDGETS}::DOUBLE[]) AS target) GROUP BY 1""")
def budget_curve(spark, d):
    f = flows(spark, d)
    total = f.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    pts = metrics.roc_points(f, "y", "p").crossJoin(F.broadcast(total))  # one row of totals
    best = [F.struct(F.lit(t).alias("target"), (F.coalesce(F.max(F.when(F.col("fp") / F.col("n") <= t, F.col("tp"))), F.lit(0)) / F.max("p")).alias("recall")) for t in BUDGETS]
    return pts.agg(F.array(*best).alias("x")).select(F.inline("x"))


@query("a28_prediction_drift", f"WITH {FLOWS}, r AS (SELECT avg(CAST(p >= .8 AS INT)) FILTER (y = 1) / avg(CAST(p >= .8 AS INT)) FILTER (y = 0) AS alert_ratio, avg(p) FILTER (y = 0) AS reference_mean, avg(p) FILTER (y = 1) AS current_mean FROM flows), s AS ({ORACLE_SQL['a24_psi']}) SELECT *, alert_ratio > 2 OR alert_ratio < .5 OR psi >= .25 AS anomalous FROM r, s")
def prediction_drift(spark, d):
    f = flows(spark, d)
    side = lambda c, y: F.avg(F.when(F.col("y") == y, c))
    hit = (F.col("p") >= 0.8).cast("int")
    r = f.agg(F.try_divide(side(hit, 1), side(hit, 0)).alias("alert_ratio"), side(F.col("p"), 0).alias("reference_mean"), side(F.col("p"), 1).alias("current_mean"))
    both = r.crossJoin(metrics.psi(f.where("y = 0"), f.where("y = 1"), "p"))  # one row each
    return both.withColumn("anomalous", (F.col("alert_ratio") > 2) | (F.col("alert_ratio") < 0.5) | (F.col("psi") >= 0.25))


@query("a37_prevalence", f"""WITH {FLOWS}, r AS (SELECT avg(CAST(p >= .5 AS INT)) FILTER (y = 1) AS tpr, avg(CAST(p >= .5 AS INT)) FILTER (y = 0) AS fpr FROM flows), s AS (SELECT prevalence, 1000000 * prevalence * tpr AS tp, 1000000 * (1 - prevalence) * fpr AS fp FROM r, (SELECT unnest([.01, .001, .0001]::DOUBLE[]) AS prevalence))
 SELECT *, tp / (tp + fp) AS ppv FROM s""")
def prevalence(spark, d):
    """True and false alarms in a million flows at rarer attacks than the measured ones."""
    rate = metrics.confusion(flows(spark, d), "y", "p", 0.5).select("tpr", "fpr")
    each = rate.withColumn("prevalence", F.explode(F.array(*map(F.lit, [0.01, 0.001, 0.0001]))))
    out = each.select("prevalence", (1_000_000 * F.col("prevalence") * F.col("tpr")).alias("tp"), (1_000_000 * (1 - F.col("prevalence")) * F.col("fpr")).alias("fp"))
    return out.withColumn("ppv", F.try_divide("tp", F.col("tp") + F.col("fp")))


@query("a40_family_skew", """WITH g AS (SELECT o_custkey % 20 AS actor, coalesce(o_orderpriority, '(no family)') AS bucket, count(*) AS k, count(*) FILTER (o_orderstatus = 'F') AS hits FROM orders GROUP BY 1, 2), t AS (SELECT bucket, sum(k) AS tk, sum(hits) AS th FROM g GROUP BY 1),
 z AS (SELECT actor, bucket, k, hits, (hits / k - (th - hits) / (tk - k)) / sqrt(th / tk * (1 - th / tk) * (1 / k + 1 / (tk - k))) AS z FROM g JOIN t USING (bucket) WHERE k >= 10 AND tk > k) SELECT *, abs(z) >= 3 AS skewed FROM z""")
def family_skew(spark, d):
    """Each actor's share of closed verdicts in a family against all other actors' (totals less its own)."""
    o = read(spark, d, "orders")
    g = o.groupBy((F.col("o_custkey") % 20).alias("actor"), F.coalesce("o_orderpriority", F.lit("(no family)")).alias("bucket")).agg(F.count("*").alias("k"), F.count_if(F.col("o_orderstatus") == "F").alias("hits"))
    t = g.groupBy("bucket").agg(F.sum("k").alias("tk"), F.sum("hits").alias("th"))
    k, hits, tk, th = (F.col(c) for c in ("k", "hits", "tk", "th"))
    pool = th / tk
    z = F.try_divide(hits / k - (th - hits) / (tk - k), F.sqrt(pool * (1 - pool) * (1 / k + 1 / (tk - k))))
    return g.join(t, "bucket").where((k >= 10) & (tk > k)).select("actor", "bucket", "k", "hits", z.alias("z")).withColumn("skewed", F.abs("z") >= 3)


@query("a44_dashboard", f"WITH {FLOWS}, v AS (SELECT CASE WHEN p >= .8 THEN 'HUNT' WHEN p >= .4 THEN 'REVIEW' ELSE 'QUIET' END AS lane, l_linestatus AS status FROM flows) SELECT lane, status, count(*) AS n FROM v GROUP BY GROUPING SETS ((lane), (status), ())")
def dashboard(spark, d):
    lane = F.when(F.col("p") >= 0.8, "HUNT").when(F.col("p") >= 0.4, "REVIEW").otherwise("QUIET")
    v = flows(spark, d).select(lane.alias("lane"), F.col("l_linestatus").alias("status"))
    return v.groupingSets([["lane"], ["status"], []], "lane", "status").agg(F.count("*").alias("n")).select("lane", "status", "n")


@query("a45_trailing_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n, n > 5 AS limited FROM events")
def trailing_rate(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "ts")
    return rates.trailing_count(e, "user_id", "ts", 86400).select("event_id", "n", (F.col("n") > 5).alias("limited"))


@query("a48_nearest_rank", """WITH w AS (SELECT l_extendedprice AS v, sum(count(*)) OVER (ORDER BY l_extendedprice) AS c FROM lineitem GROUP BY 1), t AS (SELECT count(*) AS n, avg(l_extendedprice) AS mean FROM lineitem)
 SELECT max(mean) AS mean, min(v) FILTER (c >= ceil(.5::DOUBLE * n)) AS p50, min(v) FILTER (c >= ceil(.95::DOUBLE * n)) AS p95, min(v) FILTER (c >= ceil(.99::DOUBLE * n)) AS p99 FROM w, t""")
def nearest_rank(spark, d):
    by = read(spark, d, "lineitem").where("l_extendedprice IS NOT NULL").groupBy(F.col("l_extendedprice").alias("v")).agg(F.count("*").alias("k"))
    total = by.agg(F.sum("k").alias("n"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"))
    cum = ordered.running_sums(by, "v", {"c": "k"}).crossJoin(F.broadcast(total))  # one row of totals
    at = lambda q: F.min(F.when(F.col("c") >= F.ceil(F.lit(q) * F.col("n")), F.col("v")))
    return cum.agg(F.max("mean").alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("a49_audit_chain", """WITH h AS (SELECT event_id, sha256(concat(event_id, '|', user_id, '|', event_type)) AS good FROM events), c AS (SELECT event_id, good, CASE WHEN event_id % 100 = 7 THEN 'forged' ELSE good END AS own, CASE WHEN event_id = 0 THEN '' ELSE coalesce(lag(good) OVER (ORDER BY event_id), '') END AS previous FROM h)
 SELECT event_id FROM (SELECT *, lag(own) OVER (ORDER BY event_id) AS before FROM c) WHERE own <> good OR previous <> coalesce(before, '')""")
def audit_chain(spark, d):
    """A chain of events with some forged entries: the entries whose hash or link is broken."""
    good = F.sha2(F.concat_ws("|", "event_id", "user_id", "event_type"), 256)
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", good.alias("good"))
    before = e.select((F.col("event_id") + 1).alias("event_id"), F.col("good").alias("previous"))
    own = F.when(F.col("event_id") % 100 == 7, "forged").otherwise(F.col("good"))
    chain = e.drop("good").join(before, "event_id", "left").join(e.select("event_id", own.alias("own")), "event_id").fillna("", ["previous"])
    return rates.broken_links(chain, "event_id", "previous", "own", good).select("event_id")


@query("w12_detection_delay", "SELECT min(event_id) FILTER (event_id >= 500) - 500 AS delay, count(*) FILTER (event_id < 500) AS false_alarms FROM events WHERE value > 150")
def detection_delay(spark, d):
    e = read(spark, d, "events").where("value > 150")
    return e.agg((F.min(F.when(F.col("event_id") >= 500, F.col("event_id"))) - 500).alias("delay"), F.count_if(F.col("event_id") < 500).alias("false_alarms"))


@query("t3_top_alerts", f"WITH {FLOWS} SELECT row_id, p, l_shipdate FROM flows WHERE p >= .8 ORDER BY p DESC, l_shipdate DESC, row_id LIMIT 50")
def top_alerts(spark, d):
    """The fifty alerts of the highest score, the latest first (a top-k report)."""
    return flows(spark, d).where("p >= 0.8").orderBy(F.desc("p"), F.desc("l_shipdate"), "row_id").select("row_id", "p", "l_shipdate").limit(50)


@query("t5_review_queue", f"WITH {FLOWS} SELECT row_id, p, nov FROM flows WHERE row_id NOT IN (SELECT row_id FROM flows WHERE l_returnflag = 'A') ORDER BY NOT (p >= .4 AND p < .8), abs(p - .5::DOUBLE), nov DESC, row_id, p LIMIT 25")
def review_queue(spark, d):
    """The 25 unjudged rows most worth a look (a top-k report): the review lane first, then nearest to a half, then most novel."""
    f = flows(spark, d)
    left = f.join(f.where("l_returnflag = 'A'").select("row_id"), "row_id", "left_anti")
    lane = (F.col("p") >= 0.4) & (F.col("p") < 0.8)
    return left.orderBy(~lane, F.abs(F.col("p") - 0.5), F.desc("nov"), "row_id", "p").select("row_id", "p", "nov").limit(25)


@query("f1d_tokenize", "SELECT role, sum(len(regexp_extract_all(lower(text), '[a-z0-9]+')))::BIGINT AS tokens FROM conversations GROUP BY 1")
def tokenize(spark, d):
    n = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    return read(spark, d, "conversations").groupBy("role").agg(F.sum(n).alias("tokens"))


@query("f3d_fusion", f"WITH {FLOWS} SELECT agr, avg(greatest(p, nov)) AS by_max, avg(.7::DOUBLE * p + .3::DOUBLE * nov) AS weighted FROM flows GROUP BY 1")
def fusion(spark, d):
    return flows(spark, d).groupBy("agr").agg(F.avg(F.greatest("p", "nov")).alias("by_max"), F.avg(0.7 * F.col("p") + 0.3 * F.col("nov")).alias("weighted"))


@query("u5_difference", f"WITH {FLOWS} SELECT row_id FROM flows WHERE p >= .95 EXCEPT SELECT row_id FROM flows WHERE nov >= .5")
def difference(spark, d):
    f = flows(spark, d)
    return f.where("p >= 0.95").select("row_id").distinct().join(f.where("nov >= 0.5").select("row_id"), "row_id", "left_anti")
