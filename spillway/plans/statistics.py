"""Queries of scoring statistics, drift, sequences and encoders, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spillway.functions.pseudonyms import pads, pseudonym
from spillway.functions.suppression import first_match
from spillway.operators import metrics, ordered, windows
from spillway.plans.queries import FLOWS, flows, query, read

ROC = f"""{FLOWS}, b AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM flows GROUP BY p), c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM b), t AS (SELECT sum(y) AS np, sum(1 - y) AS nn FROM flows)"""
CLASSES = f"""{FLOWS}, x AS (SELECT l_returnflag AS t, CASE WHEN p < .25 THEN 'A' WHEN p < .75 THEN 'N' ELSE 'R' END AS q FROM flows), a AS (SELECT t AS label, count(*) AS support, count(*) FILTER (t = q) AS h FROM x GROUP BY 1), g AS (SELECT q AS label, count(*) AS q FROM x GROUP BY 1),
 m AS (SELECT label, support, h / support AS recall, coalesce(h / q, 0) AS precision, 2 * h / (support + coalesce(q, 0)) AS f1, support < 100 AS below_floor FROM a LEFT JOIN g USING (label))"""


def classes(spark, d):
    f = flows(spark, d).withColumn("q", F.when(F.col("p") < 0.25, "A").when(F.col("p") < 0.75, "N").otherwise("R"))
    return metrics.per_class(f, "l_returnflag", "q")


@query("a7_per_class", f"WITH {CLASSES} SELECT * FROM m")
def per_class(spark, d):
    return classes(spark, d)


@query("a8_macro_f1", f"WITH {CLASSES} SELECT avg(f1) AS macro_f1 FROM m")
def macro_f1(spark, d):
    return classes(spark, d).agg(F.avg("f1").alias("macro_f1"))


@query("a10_fpr_at_recall", f"WITH {ROC} SELECT min(fp / nn) AS fpr, max(p) AS threshold FROM c, t WHERE tp / np >= .9")
def fpr_at_recall(spark, d):
    return metrics.fpr_at_recall(flows(spark, d), "y", "p", 0.9)


@query("a13_average_precision", f"WITH {ROC} SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision FROM c")
def average_precision(spark, d):
    return metrics.average_precision(flows(spark, d), "y", "p")


@query("a15_alert_count_threshold", f"WITH {FLOWS} SELECT min(p) AS threshold FROM (SELECT p FROM flows ORDER BY p DESC LIMIT 100)")
def alert_count_threshold(spark, d):
    return flows(spark, d).select("p").orderBy(F.desc("p")).limit(100).agg(F.min("p").alias("threshold"))


@query("a19_brier_parts", f"WITH {FLOWS}, g AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS s, avg(y) AS o FROM flows GROUP BY 1), t AS (SELECT avg(y) AS base, count(*) AS total FROM flows) SELECT sum(n / total * (s - o) ^ 2) AS reliability, sum(n / total * (o - base) ^ 2) AS resolution, max(base * (1 - base)) AS uncertainty FROM g, t")
def brier_parts(spark, d):
    return metrics.brier_parts(flows(spark, d), "y", "p")


@query("a20_rank_normalise", f"WITH {FLOWS}, r AS (SELECT p, count(*) FILTER (y = 0) AS c, count(*) FILTER (y = 1) AS k FROM flows GROUP BY p), w AS (SELECT p, c, k, sum(c) OVER (ORDER BY p) - c AS below FROM r) SELECT p AS score, k AS n, below / (SELECT sum(c) FROM r) AS percentile FROM w WHERE k > 0")
def rank_normalise(spark, d):
    f = flows(spark, d)
    return metrics.rank_normalise(f.where("y = 1"), f.where("y = 0"), "p")


@query("a23_conformal_coverage", f"WITH {FLOWS}, s AS (SELECT y, CAST(1 - (1 - p) <= .9 AS INT) AS b, CAST(1 - p <= .6 AS INT) AS a FROM flows) SELECT y, count(*) AS n, avg(CASE WHEN y = 1 THEN a ELSE b END) AS coverage, avg(CAST(a + b <> 1 AS INT)) AS abstains, avg(a + b) AS mean_size FROM s GROUP BY 1")
def conformal_coverage(spark, d):
    s = flows(spark, d).select("y", (1 - (1 - F.col("p")) <= 0.9).cast("int").alias("b"), (1 - F.col("p") <= 0.6).cast("int").alias("a"))
    return s.groupBy("y").agg(F.count("*").alias("n"), F.avg(F.when(F.col("y") == 1, F.col("a")).otherwise(F.col("b"))).alias("coverage"), F.avg((F.col("a") + F.col("b") != 1).cast("int")).alias("abstains"), F.avg(F.col("a") + F.col("b")).alias("mean_size"))


@query("a25_jensen_shannon", f"""WITH {FLOWS}, r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM flows), g AS (SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19) AS INT) AS bin, count(*) FILTER (y = 0) AS e, count(*) FILTER (y = 1) AS a FROM flows, r GROUP BY 1), v AS (SELECT coalesce(e, 0) AS e, coalesce(a, 0) AS a FROM range(20) s(i) LEFT JOIN g ON bin = i),
 k AS (SELECT greatest(e / (SELECT sum(e) FROM v), 1e-6) AS e, greatest(a / (SELECT sum(a) FROM v), 1e-6) AS a FROM v), z AS (SELECT e / (SELECT sum(e) FROM k) AS e, a / (SELECT sum(a) FROM k) AS a FROM k) SELECT sqrt(greatest((sum(e * log2(2 * e / (e + a))) + sum(a * log2(2 * a / (e + a)))) / 2, 0)) AS distance FROM z""")
def jensen_shannon(spark, d):
    return metrics.jensen_shannon(flows(spark, d), "y", "l_extendedprice")


@query("a27_benjamini_hochberg", """WITH x AS (SELECT p_partkey AS feature, ((p_partkey * 7919 % 1000) ** 3 + 1) / 1000000000.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM x) SELECT feature, p, i <= coalesce((SELECT max(i) FROM r WHERE p <= .05 * i / n), 0) AS rejected FROM r""")
def benjamini_hochberg(spark, d):
    p = (F.pow(F.col("p_partkey") * 7919 % 1000, F.lit(3)) + 1) / 1000000000.0
    return metrics.benjamini_hochberg(read(spark, d, "part").select(F.col("p_partkey").alias("feature"), p.alias("p")), "p", "feature")


@query("a32_wilson", f"WITH {FLOWS}, g AS (SELECT l_linestatus AS family, count(*) AS n, CAST(sum(y) AS BIGINT) AS k, 1.959963984540054::DOUBLE AS z FROM flows GROUP BY 1) SELECT family, n, k, (k + z * z / 2) / (n + z * z) - z / (n + z * z) * sqrt(k * (n - k) / n + z * z / 4) AS low, (k + z * z / 2) / (n + z * z) + z / (n + z * z) * sqrt(k * (n - k) / n + z * z / 4) AS high FROM g")
def wilson(spark, d):
    g = flows(spark, d).groupBy(F.col("l_linestatus").alias("family")).agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    low, high = metrics.wilson(F.col("k"), F.col("n"))
    return g.select("family", "n", "k", low.alias("low"), high.alias("high"))


@query("a33_operating_report", f"WITH {FLOWS} SELECT l_linestatus AS family, count(*) FILTER (y = 1) AS n, avg(CAST(p >= .8 OR nov >= .99 AS INT)) FILTER (y = 1) AS recall, avg(CAST(p >= .8 OR nov >= .99 AS INT)) FILTER (y = 0) AS fpr FROM flows GROUP BY 1")
def operating_report(spark, d):
    hit, attack = ((F.col("p") >= 0.8) | (F.col("nov") >= 0.99)).cast("int"), F.col("y") == 1
    return flows(spark, d).groupBy(F.col("l_linestatus").alias("family")).agg(F.count_if(attack).alias("n"), F.avg(F.when(attack, hit)).alias("recall"), F.avg(F.when(~attack, hit)).alias("fpr"))


@query("a35_agreement", f"""WITH {FLOWS}, t AS (SELECT count(*) FILTER (p >= .8 AND nov >= .7)::DOUBLE AS a, count(*) FILTER (p >= .8 AND nov < .7)::DOUBLE AS b, count(*) FILTER (p < .8 AND nov >= .7)::DOUBLE AS c, count(*) FILTER (p < .8 AND nov < .7)::DOUBLE AS e, count(*)::DOUBLE AS n FROM flows), s AS (SELECT *, (a + e) / n AS same, ((a + b) * (a + c) + (e + b) * (e + c)) / n / n AS chance FROM t)
 SELECT same AS agreement, (same - chance) / (1 - chance) AS kappa, (a * e - b * c) / (a * e + b * c) AS yules_q FROM s""")
def agreement(spark, d):
    return metrics.agreement(flows(spark, d), F.col("p") >= 0.8, F.col("nov") >= 0.7)


@query("a38_cheapest_threshold", f"WITH {ROC}, k AS (SELECT p, (np - tp) * 5.0::DOUBLE + fp AS cost FROM c, t) SELECT p AS threshold, cost FROM k ORDER BY cost, p DESC LIMIT 1")
def cheapest_threshold(spark, d):
    return metrics.cheapest_threshold(flows(spark, d), "y", "p", 5.0, 1.0)


@query("a42_fan_out", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY 1")
def fan_out(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.date_trunc("day", "ts")).alias("days"))


@query("w10_tumbling_windows", "WITH p AS (SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 100 AS w FROM events) SELECT w AS number, count(*) AS n, avg(value) AS mean FROM p GROUP BY 1")
def tumbling_windows(spark, d):
    pos = ordered.positions(read(spark, d, "events").select("event_id", "value"), "event_id")
    return pos.groupBy(F.floor((F.col("pos") - 1) / 100).alias("number")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("w3_sequence_windows", "SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ',') AS roles FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def sequence_windows(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    return read(spark, d, "conversations").select("conv_id", "turn", "role").distinct().select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), ",").alias("roles"))


@query("w3_padded_sequences", """WITH o AS (SELECT event_id, user_id, epoch_us(ts) AS t, value, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events), g AS (SELECT *, coalesce(CAST(t - lag(t) OVER (PARTITION BY user_id ORDER BY pos) > 43200000000 AS INT), 0) AS fresh FROM o), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM g),
 s AS (SELECT event_id, pos, list(value) OVER (PARTITION BY user_id, run ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM r) SELECT event_id, CAST(len(v) AS INT) AS depth, array_to_string(list_transform(list_concat([0.0 FOR i IN range(5 - len(v))], v), lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS said FROM s WHERE (pos - 1) % 3 = 0""")
def padded_sequences(spark, d):
    """The last five values of a user without a break of half a day, zeros before them, for every third event in time."""
    made = windows.sequences(read(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", "ts", "event_id", ["value"], 5, 43200.0, 3)
    return made.select("event_id", "depth", F.array_join(F.transform("sequence", lambda x: F.round(x[0] * 100).cast("long").cast("string")), ",").alias("said"))


#: Rules as analysts would keep them: match fields, latest created first.
RULES = [
    {"rule_id": "r1", "created_at": "2026-01-01", "match": {"o_orderpriority": "1-urgent"}},
    {"rule_id": "r2", "created_at": "2026-01-02", "match": {"o_orderpriority": "2-HIGH", "o_orderstatus": "o"}},
    {"rule_id": "r3", "created_at": "2026-01-03", "match": {"o_orderpriority": "1-URGENT", "o_orderstatus": "F"}},
]


@query("j8_first_suppression", "SELECT CASE WHEN lower(o_orderpriority) = '1-urgent' AND lower(o_orderstatus) = 'f' THEN 'r3' WHEN lower(o_orderpriority) = '2-high' AND lower(o_orderstatus) = 'o' THEN 'r2' WHEN lower(o_orderpriority) = '1-urgent' THEN 'r1' END AS rule_id, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def first_suppression(spark, d):
    return read(spark, d, "orders").groupBy(first_match(RULES).alias("rule_id")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))


@query("e4_rare_bucket", "WITH g AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), k AS (SELECT p_type FROM g WHERE n >= .001 * (SELECT sum(n) FROM g) ORDER BY n DESC, p_type LIMIT 3) SELECT CASE WHEN p_type IN (SELECT p_type FROM k) THEN p_type ELSE '__rare__' END AS level, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1")
def rare_bucket(spark, d):
    part = read(spark, d, "part").select("p_type")
    g = part.groupBy("p_type").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    kept = g.crossJoin(F.broadcast(total)).where(F.col("n") >= 0.001 * F.col("total")).orderBy(F.desc("n"), "p_type").limit(3).select("p_type", F.col("p_type").alias("level"))
    return g.join(F.broadcast(kept), "p_type", "left").groupBy(F.coalesce("level", F.lit("__rare__")).alias("level")).agg(F.sum("n").alias("n"))


@query("f3b_signed_log", "SELECT c_custkey, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS x FROM customer")
def signed_log(spark, d):
    return read(spark, d, "customer").select("c_custkey", (F.signum("c_acctbal") * F.log1p(F.abs("c_acctbal"))).alias("x"))


KEY = b"a key of the tests"
BLOB = lambda b: "'" + "".join(f"\\x{x:02X}" for x in b) + "'::BLOB"


@query("f6_pseudonyms", f"SELECT c_custkey, 'pseudo:' || left(sha256({BLOB(pads(KEY)[1])} || unhex(sha256({BLOB(pads(KEY)[0])} || encode(c_name)))), 12) AS pseudonym FROM customer")
def pseudonyms(spark, d):
    return read(spark, d, "customer").select("c_custkey", pseudonym(F.col("c_name"), KEY).alias("pseudonym"))


@query("u2_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem")
def distinct_rows(spark, d):
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_tax").distinct()
