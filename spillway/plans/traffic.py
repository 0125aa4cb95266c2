"""Flows, their surroundings, and search over the test tables, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from spillway.operators import flows, retrieval, trailing
from spillway.plans.queries import query, read

IDLE_S, ACTIVE_S = 3600.0, 7200.0
PACKETS = """k AS (SELECT event_id AS r, epoch_us(ts) AS t, user_id % 20 AS u, CASE WHEN event_type IN ('click', 'error', 'purchase') THEN 'tcp' ELSE 'udp' END AS proto, event_id % 3 = 0 AS back,
 CAST(floor(value * 10) AS BIGINT) AS size, CASE WHEN event_type = 'error' AND value > 90 THEN 4 WHEN event_type = 'purchase' AND value > 60 THEN 17 WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 18 ELSE 16 END AS flags FROM events)"""


def packets(spark, d):
    """An event as a packet between a user and a service, or back."""
    back = F.col("event_id") % 3 == 0
    user, service = F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string")), F.lit("10.0.1.1")
    either = lambda a, b: F.when(back, b).otherwise(a)
    kind, value = F.col("event_type"), F.col("value")
    flags = F.when((kind == "error") & (value > 90), flows.RST).when((kind == "purchase") & (value > 60), flows.FIN | flows.ACK).when(F.col("event_id") % 11 == 0, flows.SYN).when(F.col("event_id") % 7 == 0, flows.SYN | flows.ACK).otherwise(flows.ACK)
    return read(spark, d, "events").select(
        F.col("event_id").alias("row"), F.col("ts").cast("timestamp").alias("ts"), either(user, service).alias("src"), either(service, user).alias("dst"), either(F.lit(5000), F.lit(80)).alias("sport"), either(F.lit(80), F.lit(5000)).alias("dport"),
        F.when(kind.isin("click", "error", "purchase"), "tcp").otherwise("udp").alias("proto"), F.floor(value * 10).cast("int").alias("size"), F.lit(64).alias("ttl"), F.lit(8192).alias("window"), F.lit(0).cast("long").alias("seq"), flags.alias("flags"),
    )


@query("r6_assembled_flows", f"""WITH RECURSIVE {PACKETS},
 n AS (SELECT *, coalesce(CAST(t - lag(t) OVER w > {IDLE_S * 1e6:.0f} OR (proto = 'tcp' AND lag(flags) OVER w & 5 > 0) AS INT), 1) AS fresh FROM k WINDOW w AS (PARTITION BY u, proto ORDER BY t, r)),
 runs AS (SELECT *, sum(fresh) OVER (PARTITION BY u, proto ORDER BY t, r) AS run FROM n),
 jumps AS (SELECT *, first_value(r) OVER (PARTITION BY u, proto, run ORDER BY t RANGE BETWEEN {ACTIVE_S * 1e6 + 1:.0f} FOLLOWING AND UNBOUNDED FOLLOWING) AS jump FROM runs),
 starts AS (SELECT r, jump FROM jumps WHERE fresh = 1 UNION ALL SELECT j.r, j.jump FROM starts s JOIN jumps j ON j.r = s.jump),
 f AS (SELECT k.*, sum(CAST(s.r IS NOT NULL AS INT)) OVER (PARTITION BY u, proto ORDER BY t, k.r) AS flow FROM k LEFT JOIN starts s ON s.r = k.r),
 h AS (SELECT *, first_value(back) OVER w AS back0, first_value(t) OVER w AS t0, last_value(flags) OVER (PARTITION BY u, proto, flow ORDER BY t, r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_flags FROM f WINDOW w AS (PARTITION BY u, proto, flow ORDER BY t, r)),
 g AS (SELECT *, (t - lag(t) OVER (PARTITION BY u, proto, flow, back ORDER BY t, r)) / 1000 AS gap, back <> back0 AS reply FROM h),
 q AS (SELECT u, proto, flow, min(t0) AS t0, bool_or(back0) AS back0, (max(t) - min(t)) / 1e6 AS dur, any_value(last_flags) AS fl, count(*) FILTER (NOT reply) AS spkts, count(*) FILTER (reply) AS dpkts, coalesce(sum(size) FILTER (NOT reply), 0)::BIGINT AS sbytes, coalesce(sum(size) FILTER (reply), 0)::BIGINT AS dbytes,
  coalesce(avg(gap) FILTER (NOT reply), 0) AS sinpkt, coalesce(avg(gap) FILTER (reply), 0) AS dinpkt, CASE WHEN count(gap) FILTER (NOT reply) > 1 THEN stddev_pop(gap) FILTER (NOT reply) ELSE 0 END AS sjit,
  min(t) FILTER (proto = 'tcp' AND flags = 2) AS syn, arg_min(t, (t, r)) FILTER (proto = 'tcp' AND flags = 18) AS synack, min((t, r)) FILTER (proto = 'tcp' AND flags = 18) AS at FROM g GROUP BY 1, 2, 3),
 a AS (SELECT g.u, g.proto, g.flow, min(g.t) AS ack FROM g JOIN q USING (u, proto, flow) WHERE g.proto = 'tcp' AND g.flags & 16 > 0 AND (g.t, g.r) > q.at GROUP BY 1, 2, 3)
 SELECT CASE WHEN back0 THEN '10.0.1.1' ELSE '10.0.0.' || q.u END AS src, proto, t0, dur, CASE WHEN proto = 'tcp' AND fl & 4 > 0 THEN 'RST' WHEN proto = 'tcp' AND fl & 1 > 0 THEN 'FIN' WHEN spkts > 0 AND dpkts > 0 THEN 'CON' ELSE 'INT' END AS state, spkts, dpkts, sbytes, dbytes,
 round(sinpkt, 6) AS sinpkt, round(dinpkt, 6) AS dinpkt, round(sjit, 6) AS sjit, round(coalesce(greatest((synack - syn) / 1e6, 0), 0), 6) AS synack, round(coalesce(greatest((ack - synack) / 1e6, 0), 0), 6) AS ackdat FROM q LEFT JOIN a USING (u, proto, flow)""")
def assembled_flows(spark, d):
    """Two-way flows of the packets: idle and active limits, endings, handshakes, gaps by direction."""
    made = flows.assemble(packets(spark, d), IDLE_S, ACTIVE_S)
    numbers = [F.round(c, 6).alias(c) for c in ("sinpkt", "dinpkt", "sjit", "synack", "ackdat")]
    return made.select("src", "proto", F.unix_micros("start").alias("t0"), "dur", "state", "spkts", "dpkts", "sbytes", "dbytes", *numbers)


@query("w4_flow_context", f"""WITH {PACKETS}, p AS (SELECT *, row_number() OVER (ORDER BY r) AS n FROM k) SELECT r, count(*) OVER (PARTITION BY u, proto ORDER BY n RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING)::INTEGER AS same_service, count(*) OVER (PARTITION BY u ORDER BY n RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING)::INTEGER AS same_user FROM p""")
def flow_context(spark, d):
    """Of the hundred connections before each, those with the same user, and the same user and protocol."""
    user = F.when(F.col("src") == "10.0.1.1", F.col("dst")).otherwise(F.col("src"))
    rows = packets(spark, d).select(F.col("row").alias("r"), user.alias("src"), "proto", F.lit("").alias("dst"), F.lit(0).alias("sport"), F.lit(0).alias("dport"), F.col("row").alias("_start"), F.lit(0).alias("flow"))
    return flows.trailing_counts(rows).select("r", F.col("ct_srv_src").alias("same_service"), F.col("ct_src_ltm").alias("same_user"))


@query("w1_trailing_distinct", """WITH e AS (SELECT event_id AS r, epoch_us(ts) AS t, user_id AS s, event_type AS k, CAST(floor(value) AS BIGINT) % 7 AS p FROM events),
 a AS (SELECT x.r, count(*) AS n, count(DISTINCT y.k) AS dk, count(DISTINCT y.p) AS dp FROM e x JOIN e y ON y.s = x.s AND y.t >= x.t - 21600000000 AND (y.t, y.r) < (x.t, x.r) GROUP BY 1),
 b AS (SELECT x.r, count(*) AS n, count(DISTINCT y.s) AS ds FROM e x JOIN e y ON y.k = x.k AND y.t >= x.t - 21600000000 AND (y.t, y.r) < (x.t, x.r) GROUP BY 1),
 c AS (SELECT x.r, count(*) AS n FROM e x JOIN e y ON y.s = x.s AND y.k = x.k AND y.t >= x.t - 21600000000 AND (y.t, y.r) < (x.t, x.r) GROUP BY 1)
 SELECT e.r AS event_id, coalesce(a.n, 0) AS src_flows, coalesce(a.dk, 0) AS src_distinct_dst, coalesce(a.dp, 0) AS src_distinct_port, coalesce(b.n, 0) AS dst_flows, coalesce(b.ds, 0) AS dst_distinct_src, coalesce(c.n, 0) AS pair_flows FROM e LEFT JOIN a USING (r) LEFT JOIN b USING (r) LEFT JOIN c USING (r)""")
def trailing_distinct(spark, d):
    """Rows and different partners of source, destination and pair over six hours, by interval ends."""
    e = read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", (F.floor("value") % 7).alias("port"))
    rows = trailing.trailing_distinct(e, ["user_id"], "ts", "event_id", 21600, {"src_flows": None, "src_distinct_dst": ["event_type"], "src_distinct_port": ["port"]})
    rows = trailing.trailing_distinct(rows, ["event_type"], "ts", "event_id", 21600, {"dst_flows": None, "dst_distinct_src": ["user_id"]})
    rows = trailing.trailing_distinct(rows, ["user_id", "event_type"], "ts", "event_id", 21600, {"pair_flows": None})
    return rows.select("event_id", "src_flows", "src_distinct_dst", "src_distinct_port", "dst_flows", "dst_distinct_src", "pair_flows")


POSTINGS = """t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(n) FROM n) / (SELECT count(*) FROM documents) AS mean),
 f AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2), g AS (SELECT w, ln(docs - count(*) + .5) - ln(count(*) + .5) AS idf FROM f, s GROUP BY w, docs), v AS (SELECT w, CASE WHEN idf < 0 THEN .25 * (SELECT avg(idf) FROM g) ELSE idf END AS idf FROM g),
 q AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)"""


@query("b1_search", f"""WITH {POSTINGS}, m AS (SELECT item_id, w, count(*) AS times FROM q GROUP BY 1, 2), x AS (SELECT item_id, f.doc_id AS id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (.25 + .75 * n / mean))), 9) AS score FROM m JOIN v USING (w) JOIN f USING (w) JOIN n ON n.doc_id = f.doc_id, s GROUP BY 1, 2)
 SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM x WHERE score > 0 QUALIFY rank <= 3""")
def search(spark, d):
    """The three documents that answer each benchmark text best."""
    index = retrieval.Index.build(read(spark, d, "documents"), "doc_id", "text")
    return index.search(read(spark, d, "benchmark"), "item_id", "text").withColumn("score", F.round("score", 6))


@query("b1_overlap", f"""WITH {POSTINGS}, m AS (SELECT DISTINCT item_id, w FROM q), z AS (SELECT item_id, count(*) AS wanted FROM m GROUP BY 1), x AS (SELECT item_id, doc_id AS id, round(count(*) / any_value(wanted), 9) AS score FROM m JOIN f USING (w) JOIN z USING (item_id) GROUP BY 1, 2)
 SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank, id, score FROM x QUALIFY rank <= 3""")
def search_by_overlap(spark, d):
    index = retrieval.Index.build(read(spark, d, "documents"), "doc_id", "text")
    return index.overlap(read(spark, d, "benchmark"), "item_id", "text")
