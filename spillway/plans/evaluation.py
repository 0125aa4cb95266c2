"""Intervals, gates, matched budgets, splits and drift over the test tables, each query with its SQL for DuckDB."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from spillway.models import gates
from spillway.operators import intervals, metrics, ordered, splits, windows
from spillway.plans.queries import FLOWS, flows, query, read

U = lambda *parts: f"CAST('0x' || substr(md5({' || chr(58) || '.join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
WEIGHT = "len(list_filter([" + ", ".join(f"{x!r}" for x in intervals.POISSON) + "], lambda t: t <= u))"


@query("a29_bootstrap_recall", f"""WITH {FLOWS}, r AS (SELECT row_id, r.range AS r, CAST(p >= .8 AS INT) AS hit, {U('row_id', 'r.range')} AS u FROM flows, range(40) r WHERE y = 1), b AS (SELECT r, sum({WEIGHT} * hit) / sum({WEIGHT}) AS x FROM r GROUP BY 1) SELECT quantile_cont(x, .025) AS low, quantile_cont(x, .975) AS high, avg(x) AS mean FROM b""")
def bootstrap_recall(spark, d):
    return intervals.bootstrap_ratio(flows(spark, d), "row_id", (F.col("p") >= 0.8).cast("int"), F.col("y"), 40)


@query("a30_block_bootstrap", f"""WITH e AS (SELECT event_id + 1 AS pos, sum(CAST(value > 90 AS INT)) OVER (ORDER BY event_id) AS c FROM events), n AS (SELECT count(*) AS n FROM events), runs AS (SELECT r.range % 40 AS r, CAST(floor({U('r.range')} * (n - 200 + 1)) AS BIGINT) AS s, n FROM n, range(CAST(40 * ceil((SELECT count(*) FROM events) / 200.0) AS BIGINT)) r),
 b AS (SELECT r, sum(t.c - coalesce(f.c, 0)) / (200.0 * count(*)) AS x FROM runs LEFT JOIN e f ON f.pos = s JOIN e t ON t.pos = s + 200 GROUP BY 1) SELECT quantile_cont(x, .025) AS low, quantile_cont(x, .975) AS high, avg(x) AS mean FROM b""")
def block_bootstrap(spark, d):
    rows = ordered.positions(read(spark, d, "events").select("event_id", "value"), "event_id")
    return intervals.block_bootstrap_ratio(rows, "pos", (F.col("value") > 90).cast("int"), F.lit(1), 200, 40)


@query("a26_ks_p_value", """WITH v AS (SELECT value AS v, CAST(event_type = 'click' AS INT) AS r, CAST(event_type = 'view' AS INT) AS c FROM events WHERE event_type IN ('click', 'view')), per AS (SELECT v, sum(r) AS r, sum(c) AS c FROM v GROUP BY 1),
 cum AS (SELECT sum(r) OVER (ORDER BY v) / (SELECT sum(r) FROM v) - sum(c) OVER (ORDER BY v) / (SELECT sum(c) FROM v) AS g FROM per), s AS (SELECT max(abs(g)) AS statistic, (SELECT sum(r) FROM v) AS n, (SELECT sum(c) FROM v) AS m FROM cum)
 SELECT statistic, round(least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * statistic * statistic * n * m / (n + m))))), 9) AS p FROM s""")
def ks_p_value(spark, d):
    e = read(spark, d, "events")
    a, b = e.where("event_type = 'click'"), e.where("event_type = 'view'")
    found = metrics.ks(a, b, "value").first()["statistic"]
    return spark.createDataFrame([(found, round(intervals.kolmogorov(found, a.count(), b.count()), 9))], "statistic double, p double")


FLAGS = {"a": "p >= 0.8", "b": "nov >= 0.8", "c": "agr >= 2"}


@query("z24_pairwise_mcnemar", f"""WITH {FLOWS}, f AS (SELECT y = 1 AS t, p >= .8 AS a, nov >= .8 AS b, agr >= 2 AS c FROM flows), m AS (SELECT 'a' AS one, 'b' AS two, count(*) FILTER ((a = t) AND (b <> t)) AS k, count(*) FILTER ((a <> t) AND (b = t)) AS l FROM f UNION ALL SELECT 'a', 'c', count(*) FILTER ((a = t) AND (c <> t)), count(*) FILTER ((a <> t) AND (c = t)) FROM f
 UNION ALL SELECT 'b', 'c', count(*) FILTER ((b = t) AND (c <> t)), count(*) FILTER ((b <> t) AND (c = t)) FROM f) SELECT one, two, k AS only_one, l AS only_two, round(least(1.0, 2 * coalesce(list_sum(list_transform(range(0, least(k, l) + 1), lambda j: exp(lgamma(k + l + 1) - lgamma(j + 1) - lgamma(k + l - j + 1) - (k + l) * ln(2)))), 0)), 6) AS p FROM m""")
def pairwise_mcnemar(spark, d):
    t = F.col("y") == 1
    right = {k: F.expr(c) == t for k, c in FLAGS.items()}
    pairs = list(combinations(FLAGS, 2))
    counts = flows(spark, d).agg(*[F.count_if(right[a] & ~right[b]).alias(f"{a}{b}") for a, b in pairs], *[F.count_if(~right[a] & right[b]).alias(f"{b}{a}") for a, b in pairs]).first()
    rows = [(a, b, counts[f"{a}{b}"], counts[f"{b}{a}"], round(intervals.sign_test(counts[f"{a}{b}"], counts[f"{b}{a}"]), 6)) for a, b in pairs]
    return spark.createDataFrame(rows, "one string, two string, only_one long, only_two long, p double")


@query("a36_diversity", f"""WITH {FLOWS}, f AS (SELECT p >= .8 AS a, nov >= .8 AS b, agr >= 2 AS c FROM flows) SELECT 'a' AS one, 'b' AS two, avg(CAST(a <> b AS INT)) AS disagreement FROM f UNION ALL SELECT 'a', 'c', avg(CAST(a <> c AS INT)) FROM f UNION ALL SELECT 'b', 'c', avg(CAST(b <> c AS INT)) FROM f""")
def diversity(spark, d):
    pairs = list(combinations(FLAGS, 2))
    every = F.array(*[F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), (F.expr(FLAGS[a]) != F.expr(FLAGS[b])).cast("int").alias("x")) for a, b in pairs])
    return flows(spark, d).select(F.explode(every).alias("x")).select("x.*").groupBy("one", "two").agg(F.avg("x").alias("disagreement"))


@query("a32_clopper_pearson", "SELECT event_type, 0.025::DOUBLE AS below, 0.025::DOUBLE AS above FROM events GROUP BY 1")
def exact_intervals(spark, d):
    """The exact interval's ends, judged by the tails that they leave."""
    counts = read(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 90).alias("k"), F.count("*").alias("n")).collect()  # a row for each type
    out = []
    for r in counts:
        low, high = intervals.clopper_pearson(r["k"], r["n"])
        out.append((r["event_type"], round(intervals.binomial_upper(r["k"], r["n"], low), 9), round(1 - intervals.binomial_upper(r["k"] + 1, r["n"], high), 9)))
    return spark.createDataFrame(out, "event_type string, below double, above double")


@query("a14_evaluated_flags", f"""WITH {FLOWS} SELECT count(*) FILTER (p >= .8) AS alerts, count(*) FILTER (p >= .8 AND y = 1) AS tp, count(*) FILTER (p >= .8 AND y = 0) AS fp, count(*) FILTER (p < .8 AND y = 1) AS fn, count(*) FILTER (p >= .8 AND y = 1) / count(*) FILTER (y = 1) AS recall, count(*) FILTER (p >= .8 AND y = 0) / count(*) FILTER (y = 0) AS fpr, 1.0 / count(*)::DOUBLE AS floor FROM flows""")
def evaluated_flags(spark, d):
    """Counts and rates of a flag, and the least rate that so many rows can tell from none."""
    hit, pos = F.col("p") >= 0.8, F.col("y") == 1
    n = F.count_if
    return flows(spark, d).agg(n(hit).alias("alerts"), n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & pos).alias("fn"), F.try_divide(n(hit & pos), n(pos)).alias("recall"), F.try_divide(n(hit & ~pos), n(~pos)).alias("fpr"), F.try_divide(F.lit(1.0), F.count("*")).alias("floor"))


@query("a16_matched_budget", f"""WITH {FLOWS}, b AS (SELECT greatest(1, CAST(round_even(.02 * count(*) FILTER (y = 0), 0) AS BIGINT)) AS budget, sum(y) AS pos FROM flows), s AS (SELECT 'p' AS scorer, row_id, y, p AS s FROM flows UNION ALL SELECT 'nov', row_id, y, nov FROM flows UNION ALL SELECT 'mean', row_id, y, (p + nov) / 2 FROM flows),
 c AS (SELECT *, coalesce(sum(1 - y) OVER (PARTITION BY scorer ORDER BY s DESC, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT scorer, count(*) AS flagged, sum(y) / (SELECT pos FROM b) AS recall FROM c WHERE before < (SELECT budget FROM b) GROUP BY 1""")
def matched_budget(spark, d):
    """Recall of several scorers when each may flag equally many benign rows."""
    rows = flows(spark, d).select("row_id", "y", "p", "nov", ((F.col("p") + F.col("nov")) / 2).alias("mean"))
    totals = rows.agg(F.count_if(F.col("y") == 0).alias("n"), F.sum("y").alias("pos")).first()
    budget = max(1, round(0.02 * totals["n"]))
    out = None
    for scorer in ("p", "nov", "mean"):
        flagged = windows.at_most_benign(rows.select("row_id", "y", scorer), "y", scorer, "row_id", budget).where("flagged")
        one = flagged.agg(F.lit(scorer).alias("scorer"), F.count("*").alias("flagged"), (F.sum("y") / totals["pos"]).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a34_gate", f"""WITH {FLOWS}, f AS (SELECT *, p >= .8 AS old, p >= .82 AS new, l_linestatus AS fam FROM flows), fam AS (SELECT fam, count(*) AS n, avg(CAST(old AS INT)) AS r0, avg(CAST(new AS INT)) AS r1 FROM f WHERE y = 1 GROUP BY 1),
 a AS (SELECT avg(CAST(old AS INT)) FILTER (y = 1) - avg(CAST(new AS INT)) FILTER (y = 1) AS drop, avg(CAST(new AS INT)) FILTER (y = 0) - avg(CAST(old AS INT)) FILTER (y = 0) AS rise FROM f) SELECT drop <= .02 AS recall_held, rise <= .01 AS alarms_held, (SELECT bool_and(r0 - r1 <= .1) FROM fam WHERE n >= 20) AS families_held FROM a""")
def gate(spark, d):
    """Whether a new detector may take an old one's place: recall, false alarms, recall of each family with enough rows."""
    rows = flows(spark, d).select("y", F.col("l_linestatus").alias("fam"), (F.col("p") >= 0.8).cast("int").alias("old"), (F.col("p") >= 0.82).cast("int").alias("new"))
    rate = lambda c, y: F.avg(F.when(F.col("y") == y, F.col(c)))
    both = rows.agg((rate("old", 1) - rate("new", 1)).alias("drop"), (rate("new", 0) - rate("old", 0)).alias("rise"))
    fam = rows.where("y = 1").groupBy("fam").agg(F.count("*").alias("n"), (F.avg("old") - F.avg("new")).alias("drop")).where("n >= 20").agg(F.bool_and(F.col("drop") <= 0.1).alias("families_held"))
    return both.crossJoin(F.broadcast(fam)).select((F.col("drop") <= 0.02).alias("recall_held"), (F.col("rise") <= 0.01).alias("alarms_held"), "families_held")  # one row each


@query("a34_reports", f"""WITH {FLOWS}, f AS (SELECT y, l_linestatus AS fam, d.d AS detector, CASE d.d WHEN 'old' THEN p >= .8 WHEN 'new' THEN p >= .82 ELSE p >= .8 AND l_linestatus = 'F' END AS fired FROM flows, (VALUES ('old'), ('new'), ('half')) d(d)),
 r AS (SELECT detector, count(*) FILTER (y = 1) AS attacks, avg(CAST(fired AS INT)) FILTER (y = 1) AS recall, avg(CAST(fired AS INT)) FILTER (y = 0) AS alarms, avg(CAST(fired AS INT)) FILTER (y = 1 AND fam = 'O') AS recall_o, avg(CAST(fired AS INT)) FILTER (y = 1 AND fam = 'F') AS recall_f FROM f GROUP BY 1)
 SELECT r.detector, r.attacks, round(r.recall, 9) AS recall, round(r.alarms, 9) AS alarms, NOT (r.recall < o.recall - .02 OR r.alarms > o.alarms + .01 OR r.recall_o - o.recall_o < -.1 OR r.recall_f - o.recall_f < -.1) AS passes FROM r, r o WHERE o.detector = 'old'""")
def gate_reports(spark, d):
    """What three detectors find, and whether each may take the first one's place."""
    fired = {"old": F.col("p") >= 0.8, "new": F.col("p") >= 0.82, "half": (F.col("p") >= 0.8) & (F.col("l_linestatus") == "F")}
    found = gates.reports(flows(spark, d), "y", "l_linestatus", fired)
    return spark.createDataFrame([(n, r.attacks, round(r.recall, 9), round(r.alarms, 9), not gates.gate(found["old"], r)) for n, r in found.items()], "detector string, attacks long, recall double, alarms double, passes boolean")


@query("a52_rates_by_population", f"""WITH {FLOWS}, g AS (SELECT l_returnflag AS population, count(*) AS n, count(*) FILTER (p >= .8) AS k, stddev_samp(p) AS spread FROM flows GROUP BY 1) SELECT population, n, k, spread, (k + 1.9207294103470702) / (n + 3.8414588206941404) - 1.959963984540054 / (n + 3.8414588206941404) * sqrt(k * (n - k) / n + 0.9603647051735351) AS low FROM g""")
def rates_by_population(spark, d):
    by = flows(spark, d).groupBy(F.col("l_returnflag").alias("population")).agg(F.count("*").alias("n"), F.count_if(F.col("p") >= 0.8).alias("k"), F.stddev_samp("p").alias("spread"))
    return by.select("population", "n", "k", "spread", metrics.wilson(F.col("k"), F.col("n"))[0].alias("low"))


@query("a54_unseen_curve", f"""WITH {FLOWS}, q AS (SELECT quantile_cont(p, [.99, .98, .9]) AS a, quantile_cont(nov, [.99, .98, .9]) AS b FROM flows WHERE y = 0), t AS (SELECT x.target, a[x.k] AS tp, b[x.k] AS tn FROM q, (VALUES (.01::DOUBLE, 1), (.02::DOUBLE, 2), (.1::DOUBLE, 3)) x(target, k))
 SELECT target, avg(CAST(p >= tp AS INT)) AS known, avg(CAST(nov >= tn AS INT)) AS novel, avg(CAST(p >= tp OR nov >= tn AS INT)) AS either FROM flows, t WHERE y = 1 AND l_linestatus = 'F' GROUP BY 1""")
def unseen_curve(spark, d):
    """Recall of a family that was held out, by head, at thresholds that benign rows give for several targets."""
    targets = [0.01, 0.02, 0.1]
    at = metrics.quantiles(flows(spark, d).where("y = 0"), ["p", "nov"], [1 - t for t in targets])
    rows = flows(spark, d).where("y = 1 and l_linestatus = 'F'")
    hits = F.array(*[F.struct(F.lit(t).alias("target"), (F.col("p") >= a).cast("int").alias("k"), (F.col("nov") >= b).cast("int").alias("n")) for t, a, b in zip(targets, at["p"], at["nov"], strict=True)])
    by = rows.select(F.explode(hits).alias("x")).select("x.*").groupBy("target")
    return by.agg(F.avg("k").alias("known"), F.avg("n").alias("novel"), F.avg(F.greatest("k", "n")).alias("either"))


@query("a51_regression_gate", f"""WITH {FLOWS}, m AS (SELECT avg(p) FILTER (y = 1) AS mean_p, avg(CAST(p >= .8 AS INT)) FILTER (y = 1) AS recall FROM flows) SELECT 'mean_p' AS metric, abs(mean_p - .5) <= .02 AS held FROM m UNION ALL SELECT 'recall', abs(recall - .3) <= .02 FROM m""")
def regression_gate(spark, d):
    """Whether metrics lie within a tolerance of their recorded values; a gain is reported like a loss."""
    golden = {"mean_p": (0.5, 0.02), "recall": (0.3, 0.02)}
    found = flows(spark, d).where("y = 1").agg(F.avg("p").alias("mean_p"), F.avg((F.col("p") >= 0.8).cast("int")).alias("recall"))
    every = F.array(*[F.struct(F.lit(m).alias("metric"), (F.abs(F.col(m) - v) <= tolerance).alias("held")) for m, (v, tolerance) in golden.items()])
    return found.select(F.explode(every).alias("x")).select("x.*")


@query("w9_stratified_split", f"""WITH {FLOWS}, o AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {U('row_id')}, row_id) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM flows) SELECT l_returnflag, k <= round_even(n * .15, 0) AS taken, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM o GROUP BY 1, 2""")
def stratified_split(spark, d):
    rows = splits.first_of_each(flows(spark, d), "l_returnflag", intervals.uniform(F.col("row_id")), "row_id", F.bround(F.col("n") * 0.15))
    return rows.groupBy("l_returnflag", "taken").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("p23_spaced_rows", "SELECT event_id FROM events WHERE event_id IN (SELECT DISTINCT CAST(floor(k.range * ((SELECT count(*) FROM events) - 1) / 49.0) AS BIGINT) FROM range(50) k)")
def spaced_rows(spark, d):
    rows = ordered.positions(read(spark, d, "events").select("event_id"), "event_id")
    return rows.where((F.col("pos") - 1).isin(splits.spaced(rows.count(), 50))).select("event_id")


@query("w10_sliding_windows", "SELECT k.range AS k, count(*) AS n, avg(value) AS mean FROM events, range((SELECT count(*) FROM events) // 100 + 1) k WHERE event_id >= k.range * 100 AND event_id < k.range * 100 + 250 AND k.range * 100 + 250 <= (SELECT count(*) FROM events) GROUP BY 1")
def sliding_windows(spark, d):
    """Windows of 250 rows every 100, whole ones alone."""
    rows = ordered.positions(read(spark, d, "events").select("event_id", "value"), "event_id")
    n, at = rows.count(), F.col("pos") - 1
    first = F.greatest(F.lit(0), F.floor((at - 250) / 100) + 1)
    each = rows.select("value", F.explode(F.sequence(first, F.floor(at / 100))).alias("k")).where(F.col("k") * 100 + 250 <= n)
    return each.groupBy("k").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("w11_coverage_under_drift", """WITH w AS (SELECT event_id // 2000 AS k, value <= 120 AS b, value >= 20 AS a, event_type = 'error' AS y FROM events) SELECT k, avg(CAST(CASE WHEN y THEN a ELSE b END AS INT)) AS coverage, avg(CAST(a = b AS INT)) AS abstention, avg(CAST(CASE WHEN y THEN a ELSE b END AS INT)) - .9 < -.02 AS breach FROM w GROUP BY 1""")
def coverage_under_drift(spark, d):
    """Coverage and abstention of fixed conformal thresholds in runs of 2000 rows, and where coverage falls short."""
    rows = ordered.positions(read(spark, d, "events").select("event_id", "value", "event_type"), "event_id")
    b, a = F.col("value") <= 120, F.col("value") >= 20
    covered = F.avg(F.when(F.col("event_type") == "error", a).otherwise(b).cast("int"))
    return rows.groupBy(F.floor((F.col("pos") - 1) / 2000).alias("k")).agg(covered.alias("coverage"), F.avg((a == b).cast("int")).alias("abstention"), (covered - 0.9 < -0.02).alias("breach"))


@query("w13_gaps", """WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT user_id, avg(g) / 1000 AS mean_ms, stddev_pop(g) / 1000 AS jitter_ms FROM g GROUP BY 1""")
def gaps(spark, d):
    from pyspark.sql import Window

    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = read(spark, d, "events").withColumn("g", t - F.lag(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.groupBy("user_id").agg((F.avg("g") / 1000).alias("mean_ms"), (F.stddev_pop("g") / 1000).alias("jitter_ms"))


@query("z1_drift_report", """WITH r AS (SELECT value AS v FROM events WHERE event_id % 2 = 0), c AS (SELECT value AS v FROM events WHERE event_id % 2 = 1), e AS (SELECT list_sort(list_distinct(quantile_cont(v, [.1, .2, .3, .4, .5, .6, .7, .8, .9]))) AS e FROM r),
 b AS (SELECT len(list_filter(e, lambda x: x <= v)) AS bin, s FROM (SELECT v, 0 AS s FROM r UNION ALL SELECT v, 1 FROM c), e), k AS (SELECT bin.range AS bin, greatest(count(*) FILTER (s = 0) / (SELECT count(*) FROM r), 1e-6) AS x, greatest(count(*) FILTER (s = 1) / (SELECT count(*) FROM c), 1e-6) AS a FROM range(10) bin LEFT JOIN b ON b.bin = bin.range GROUP BY 1)
 SELECT 'value' AS feature, round(sum((a - x) * ln(a / x)), 9) AS psi, CASE WHEN sum((a - x) * ln(a / x)) < .1 THEN 'stable' WHEN sum((a - x) * ln(a / x)) < .25 THEN 'moderate' ELSE 'significant' END AS verdict, .05::DOUBLE AS expected_false FROM k""")
def drift_report(spark, d):
    """PSI of each feature over frozen edges, its verdict, and how many features would be flagged by chance."""
    e = read(spark, d, "events")
    features, alpha = ["value"], 0.05
    edges = metrics.frozen_edges(e.where("event_id % 2 = 0"), features)
    out = metrics.psi_of(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), edges)
    return out.select("feature", F.round("psi", 9).alias("psi"), metrics.psi_verdict(F.col("psi")).alias("verdict"), F.lit(alpha * len(features)).alias("expected_false"))


@query("z8_recall_by_fine_label", f"""WITH {FLOWS} SELECT l_returnflag || l_linestatus AS fine, l_linestatus = 'F' AS unseen, count(*) AS n, avg(CAST(p >= .8 AS INT)) AS recall FROM flows WHERE y = 1 GROUP BY 1, 2""")
def recall_by_fine_label(spark, d):
    rows = flows(spark, d).where("y = 1").groupBy(F.concat("l_returnflag", "l_linestatus").alias("fine"), (F.col("l_linestatus") == "F").alias("unseen"))
    return rows.agg(F.count("*").alias("n"), F.avg((F.col("p") >= 0.8).cast("int")).alias("recall"))


@query("z6_feedback_families", """WITH m AS (SELECT event_type FROM events WHERE value <= 50 GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) SELECT CASE WHEN value <= 50 THEN (SELECT event_type FROM m) WHEN event_id % 5 = 0 THEN 'confirmed_unnamed' ELSE event_type END AS family, count(*) AS n FROM events GROUP BY 1""")
def feedback_families(spark, d):
    """Families of judged rows: the commonest benign one for label 0, a name of its own where none is known."""
    e = read(spark, d, "events")
    common = e.where("value <= 50").groupBy("event_type").count().agg(F.max_by("event_type", F.struct("count", (-F.ascii("event_type")).alias("o"))).alias("common"))
    family = F.when(F.col("value") <= 50, F.col("common")).otherwise(F.coalesce(F.when(F.col("event_id") % 5 != 0, F.col("event_type")), F.lit("confirmed_unnamed")))
    return e.crossJoin(F.broadcast(common)).groupBy(family.alias("family")).agg(F.count("*").alias("n"))  # one row


@query("z34_mapped_families", "SELECT event_type AS family, count(*) AS n, event_type IN ('click', 'error') AS mapped FROM events GROUP BY 1")
def mapped_families(spark, d):
    table = spark.createDataFrame([("click", "T1204"), ("error", "T1499")], "family string, technique string")  # a table that people keep
    by = read(spark, d, "events").groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("n"))
    return by.join(F.broadcast(table), "family", "left").select("family", "n", F.col("technique").isNotNull().alias("mapped"))


@query("a2_category_aucs", f"""WITH {FLOWS}, c AS (SELECT 'l_linestatus' AS feature, l_linestatus AS v, y FROM flows UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), y FROM flows), s AS (SELECT feature, avg(y) OVER (PARTITION BY feature, v) AS s, y FROM c),
 b AS (SELECT feature, s, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1, 2), o AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY feature ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)
 SELECT feature, greatest(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 1 - sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))) AS auc FROM o GROUP BY 1""")
def category_aucs(spark, d):
    """How well a category's own rate of the label orders the rows, by feature; values far from one half are suspect."""
    rows, out = flows(spark, d), None
    for feature in ("l_linestatus", "l_suppkey"):
        rates = rows.groupBy(feature).agg(F.avg("y").alias("s"))
        found = metrics.auc(rows.select("y", feature).join(rates, feature), "y", "s").select(F.lit(feature).alias("feature"), F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("auc"))
        out = found if out is None else out.unionByName(found)
    return out
