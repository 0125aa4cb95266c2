"""Novelty, fusion and encoders over the test tables; what SQL can express has its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from spillway.functions import fields, scoring
from spillway.models import detector
from spillway.operators import metrics
from spillway.plans.queries import FLOWS, flows, query, read


@query("m5_mahalanobis", f"""WITH {FLOWS}, b AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, .9 * var_samp(l_quantity) AS va, .9 * var_samp(l_discount) AS vb, .9 * covar_samp(l_quantity, l_discount) AS c, .1 * (var_samp(l_quantity) + var_samp(l_discount)) / 2 AS s FROM flows WHERE y = 0),
 m AS (SELECT ma, mb, va + s + 1e-12 AS va, vb + s + 1e-12 AS vb, c FROM b) SELECT row_id, round((pow(l_quantity - ma, 2) * vb - 2 * (l_quantity - ma) * (l_discount - mb) * c + pow(l_discount - mb, 2) * va) / (va * vb - c * c), 6) AS distance FROM flows, m""")
def mahalanobis(spark, d):
    rows = flows(spark, d)
    made = detector.Mahalanobis.fit(rows.where("y = 0"), ["l_quantity", "l_discount"])
    return rows.select("row_id", F.round(made.score(), 6).alias("distance"))


@query("m6_novelty_percentiles", f"""WITH {FLOWS}, r AS (SELECT l_quantity AS a FROM flows WHERE y = 0), s AS (SELECT l_quantity AS a FROM flows), n AS (SELECT count(*) AS n FROM r),
 pa AS (SELECT a, (SELECT count(*) FROM r WHERE r.a < t.a) / (SELECT n FROM n) AS q FROM (SELECT DISTINCT a FROM s) t) SELECT q AS percentile, count(*) AS n FROM s JOIN pa USING (a) GROUP BY 1""")
def novelty_percentiles(spark, d):
    """Scores as the share of benign ones strictly below them."""
    rows = flows(spark, d)
    found = metrics.rank_normalise(rows, rows.where("y = 0"), "l_quantity")
    return found.groupBy("percentile").agg(F.sum("n").alias("n"))


@query("m7_or_gate", f"""WITH {FLOWS}, q AS (SELECT quantile_cont(p, {1 - fields.head_budget(0.02, 2)!r}) AS tp, quantile_cont(nov, {1 - fields.head_budget(0.02, 2)!r}) AS tn, count(*) AS n FROM flows WHERE y = 0), o AS (SELECT tp, tn, n, (SELECT count(*) FROM flows WHERE y = 0 AND p >= tp) / n AS op, (SELECT count(*) FROM flows WHERE y = 0 AND nov >= tn) / n AS o_n FROM q),
 t AS (SELECT tp, tn, op > {fields.head_budget(0.02, 2)!r} + 1.0 / n AS sp, o_n > {fields.head_budget(0.02, 2)!r} + 1.0 / n AS sn FROM o) SELECT CAST(CASE WHEN sp THEN p > tp ELSE p >= tp END AS INT) + 2 * CAST(CASE WHEN sn THEN nov > tn ELSE nov >= tn END AS INT) AS fired, count(*) AS n FROM flows, t GROUP BY 1""")
def or_gate(spark, d):
    """Which heads fire when both together may fire on a share of benign rows."""
    rows, each = flows(spark, d), fields.head_budget(0.02, 2)
    benign = rows.where("y = 0")
    p_at, n_at = (detector.benign_threshold(benign, c, each) for c in ("p", "nov"))
    return rows.groupBy(scoring.fired(F.col("p"), F.col("nov"), p_at, n_at).alias("fired")).agg(F.count("*").alias("n"))


@query("e1_finite_values", "SELECT event_id % 4 AS k, count(*) AS n, count(*) FILTER (event_id % 4 = 3) AS finite FROM events GROUP BY 1")
def finite_values(spark, d):
    k = F.col("event_id") % 4
    odd = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    rows = detector.finite(read(spark, d, "events").withColumn("value", odd), ["value"])
    return rows.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count("value").alias("finite"))


@query("e3_scaled_numbers", """WITH f AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS v FROM events), m AS (SELECT median(v) AS m FROM f), g AS (SELECT event_id, coalesce(v, m) AS v FROM f, m), s AS (SELECT avg(v) AS a, stddev_samp(v) AS s FROM g) SELECT event_id, round((v - a) / s, 9) AS z FROM g, s""")
def scaled_numbers(spark, d):
    """Missing values as the exact median, then in standard deviations from the mean."""
    rows = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("v"))
    middle = metrics.quantiles(rows, ["v"], [0.5])["v"][0]
    filled = rows.select("event_id", F.coalesce("v", F.lit(middle)).alias("v"))
    mean, spread = filled.agg(F.avg("v"), F.stddev_samp("v")).first()
    return filled.select("event_id", F.round((F.col("v") - mean) / spread, 9).alias("z"))


@query("e4_one_hot", """WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), k AS (SELECT p_brand FROM c WHERE n >= .001 * (SELECT count(*) FROM part) ORDER BY n DESC, p_brand LIMIT 16) SELECT coalesce(k.p_brand, '__rare__') AS level, count(*) AS n FROM part LEFT JOIN k USING (p_brand) GROUP BY 1""")
def one_hot(spark, d):
    """How many rows each indicator column marks; rare and unknown levels share one."""
    rows = read(spark, d, "part")
    levels = detector.kept_levels(rows, "p_brand")
    columns = {v: (F.col("p_brand") == v).cast("int") for v in levels} | {detector.RARE: (~F.col("p_brand").isin(levels)).cast("int")}
    every = F.array(*[F.struct(F.lit(v).alias("level"), x.alias("x")) for v, x in columns.items()])
    return rows.select(F.explode(every).alias("x")).select("x.*").groupBy("level").agg(F.sum("x").alias("n")).where("n > 0")


@query("m9_detector_scores")
def detector_scores(spark, d):
    """Both heads fitted on the line items and their verdicts; no SQL, as trees have none."""
    numbers, levels = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_linestatus"]
    rows = flows(spark, d).select("row_id", "y", *numbers, *levels)
    made = detector.Detector.fit(rows, "y", "row_id", numbers, levels, "logistic", budget=0.05)
    return made.score(rows).groupBy("y", "fired", "abstains").agg(F.count("*").alias("n"))


@query("m12_isotonic", f"""WITH {FLOWS}, c AS (SELECT p, avg(y) AS m, count(*) AS n, row_number() OVER (ORDER BY p) AS i FROM flows WHERE row_id % 3 = 0 GROUP BY p), u AS (SELECT p, i, sum(m * n) OVER (ORDER BY i) AS s, sum(n) OVER (ORDER BY i) AS w, m * n AS own, n FROM c),
 ab AS (SELECT a.i AS a, b.i AS b, (b.s - a.s + a.own) / (b.w - a.w + a.n) AS m FROM u a JOIN u b ON b.i >= a.i), least_of AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM ab), fit AS (SELECT b AS i, max(m) AS q FROM least_of GROUP BY b)
 SELECT p, round(q, 9) AS calibrated, n FROM fit JOIN u USING (i)""")
def isotonic_scores(spark, d):
    """The calibrated value of each score that was learnt from."""
    rows = flows(spark, d).where("row_id % 3 = 0")
    by = rows.groupBy("p").agg(F.count("*").alias("n"))
    return detector.isotonic_calibrated(detector.isotonic(rows, "y", "p"), by, "p").select("p", F.round("calibrated", 9).alias("calibrated"), "n")
