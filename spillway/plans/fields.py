"""Single fields of the test tables through ``functions.fields``, each query with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from spillway.functions import fields, payloads, pseudonyms
from spillway.plans.queries import query, read

RAW_LABELS = """(SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type || ' - Attempted' WHEN 1 THEN 'attempted  ' || event_type WHEN 2 THEN 'Web Attack ' || chr(8211) || ' ' || event_type WHEN 3 THEN '  '
 WHEN 4 THEN event_type || '   flood ' ELSE event_type END AS raw FROM events)"""


def raw_labels(events):
    k, t = F.col("event_id") % 7, F.col("event_type")
    raw = F.when(k == 0, F.concat(t, F.lit(" - Attempted"))).when(k == 1, F.concat(F.lit("attempted  "), t)).when(k == 2, F.concat(F.lit("Web Attack – "), t)).when(k == 3, "  ").when(k == 4, F.concat(t, F.lit("   flood "))).otherwise(t)
    return events.select("event_id", raw.alias("raw"))


@query("f1_flow_labels", f"""WITH a AS (SELECT trim(regexp_replace(translate(raw, '–—', '--'), '\\s+', ' ', 'g')) AS x FROM {RAW_LABELS}), b AS (SELECT CASE WHEN starts_with(lower(x), 'attempted ') THEN substr(x, 11) ELSE x END AS x FROM a),
 c AS (SELECT CASE WHEN ends_with(lower(x), 'attempted') THEN rtrim(substr(x, 1, length(x) - 9)) END AS cut, x FROM b), d AS (SELECT translate(coalesce(CASE WHEN ends_with(cut, '-') THEN rtrim(substr(cut, 1, length(cut) - 1)) ELSE cut END, x), '\ufffd', '-') AS x FROM c)
 SELECT CASE WHEN x = '' THEN 'BENIGN' ELSE x END AS label, count(*) AS n FROM d GROUP BY 1""")
def flow_labels(spark, d):
    return raw_labels(read(spark, d, "events")).groupBy(fields.flow_label(F.col("raw")).alias("label")).agg(F.count("*").alias("n"))


@query("f1b_families", """SELECT f AS family, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'Normal' WHEN 2 THEN 'Backdoor' WHEN 3 THEN 'DoS' WHEN 4 THEN 'Reconnaissance' WHEN 5 THEN 'Backdoor' WHEN 6 THEN 'Normal' ELSE 'Worms' END AS f FROM lineitem) GROUP BY 1""")
def families(spark, d):
    spellings = F.array(*map(F.lit, ["-", "Backdoors ", " DOS", "reconnaissance", "backdoor", "", "worms"]))
    raw = F.get(spellings, F.least(F.col("l_linenumber"), F.lit(7)) - 1)
    return read(spark, d, "lineitem").groupBy(fields.family(raw).alias("family")).agg(F.count("*").alias("n"))


@query("f1c_attack_categories", """SELECT c AS category, count(*) AS n FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'dos' WHEN 2 THEN 'probe' WHEN 3 THEN 'r2l' ELSE 'u2r' END AS c FROM part) GROUP BY 1""")
def attack_categories(spark, d):
    raw = F.get(F.array(*map(F.lit, ["normal.", "Neptune", " ipsweep. ", "guess_passwd", "PERL."])), F.col("p_size") % 5)
    return read(spark, d, "part").groupBy(fields.attack_category(raw).alias("category")).agg(F.count("*").alias("n"))


@query("f1f_sentences", """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM documents), u AS (SELECT *, regexp_extract(substr(flat, 1, 200), '(?s)^(.*\\.)(\\s|$)', 1) AS w, regexp_extract(flat, '^(.*?\\.)(\\s|$)', 1) AS f FROM t)
 SELECT doc_id, md5(CASE WHEN length(flat) <= 200 THEN flat WHEN w <> '' THEN w ELSE substr(flat, 1, 200) || '…' END) AS cut, md5(CASE WHEN f = '' THEN flat ELSE f END) AS first FROM u""")
def sentences(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.md5(F.encode(fields.cut_at_sentence(t, 200), "UTF-8")).alias("cut"), F.md5(F.encode(fields.first_sentence(t), "UTF-8")).alias("first"))


@query("f1g_narratives", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_extendedprice >= 100 THEN printf('%s bytes in all', format('{:,}', CAST(round_even(l_extendedprice, 0) AS BIGINT))) END AS said FROM lineitem WHERE l_extendedprice >= 100""")
def narratives(spark, d):
    rows = read(spark, d, "lineitem").where("l_extendedprice >= 100")
    feature = F.when(F.col("l_linenumber") % 3 == 0, "unknown").otherwise("bytes")
    return rows.select("l_orderkey", "l_linenumber", fields.narrate(feature, F.col("l_extendedprice"), {"bytes": "{v} bytes in all"}).alias("said"))


@query("f1i_rule_scalars", """SELECT p_partkey, replace(p_name, ' ', '_') AS col_name, '"' || replace(replace(p_type || chr(92) || '"', chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' AS quoted FROM part""")
def rule_scalars(spark, d):
    return read(spark, d, "part").select("p_partkey", fields.column_name(F.col("p_name")).alias("col_name"), fields.quoted(F.concat("p_type", F.lit('\\"'))).alias("quoted"))


@query("f1j_network_filter", """SELECT a AS address, count(*) AS n FROM (SELECT '10.' || n_regionkey || '.0.' || n_nationkey AS a, upper(n_name) AS u FROM nation) WHERE (starts_with(a, '10.1.') OR starts_with(a, '10.3.')) AND regexp_matches(u, '(?i)(^|[^A-Za-z0-9])NATION_[0-9]+($|[^A-Za-z0-9])') GROUP BY 1""")
def network_filter(spark, d):
    rows = read(spark, d, "nation").select(F.concat(F.lit("10."), F.col("n_regionkey").cast("string"), F.lit(".0."), F.col("n_nationkey").cast("string")).alias("address"), F.upper("n_name").alias("u"))
    return rows.where(fields.in_any_network(F.col("address"), ["10.1.", "10.3."]) & fields.has_any(F.col("u"), ["nation_[0-9]+"])).groupBy("address").agg(F.count("*").alias("n"))


@query("f2_times", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN date_trunc('minute', ts) WHEN event_id % 5 = 0 THEN ts ELSE date_trunc('second', ts) END AS at, epoch_us(ts) / 1e6 AS seconds, CAST(isodow(ts) - 1 AS INT) AS weekday FROM events""")
def times(spark, d):
    ts, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    text = F.when(k == 0, F.date_format(ts, fields.TIME_FORMATS[0])).when(k == 1, F.date_format(ts, fields.TIME_FORMATS[1])).when(k == 2, F.date_format(ts, fields.TIME_FORMATS[2])).when(k == 3, F.date_format(ts, fields.TIME_FORMATS[3])).otherwise("not a time")
    return read(spark, d, "events").select("event_id", fields.time_of(text).cast("timestamp_ntz").alias("at"), fields.epoch_seconds(ts).alias("seconds"), F.weekday(ts).alias("weekday"))


@query("f2d_spaced_times", """SELECT n_nationkey, make_timestamp(epoch_us(TIMESTAMP '2024-01-01 00:00:00') + CAST(floor(n_nationkey * 86400 * 1000000.0 / 24) AS BIGINT)) AS at FROM nation""")
def spaced_times(spark, d):
    return read(spark, d, "nation").select("n_nationkey", fields.spaced_time(F.col("n_nationkey"), 25, "2024-01-01 00:00:00", 86400).cast("timestamp_ntz").alias("at"))


@query("f3_flow_ratios", """SELECT l_orderkey, l_linenumber, l_quantity * 8 / 1e6 * l_linenumber AS mbps, CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax END AS ratio, CASE WHEN l_quantity <= 31 THEN 0 ELSE 1 END AS bucket,
 (CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) * 4 + CASE WHEN l_quantity <= 31 THEN 0 ELSE 1 END AS state_ttl, round_even(l_extendedprice / 7, 2) AS rounded FROM lineitem""")
def flow_ratios(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fields.megabits(F.col("l_linenumber"), q).alias("mbps"), fields.rate(F.col("l_discount"), F.col("l_tax")).alias("ratio"), fields.ttl_bucket(q).alias("bucket"),
        fields.state_ttl(F.col("l_linestatus"), q, ["O", "F"]).alias("state_ttl"), F.bround(F.col("l_extendedprice") / 7, 2).alias("rounded"))


@query("f3e_fused_novelty", """SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax, l_quantity / 50) AS most, (l_discount + l_tax + l_quantity / 50) / 3 AS mean, list_sort([l_discount, l_tax, l_quantity / 50])[2] AS middle,
 CAST(l_discount >= .05 AS INT) + CAST(l_tax >= .05 AS INT) + CAST(l_quantity / 50 >= .05 AS INT) AS agreeing FROM lineitem""")
def fused_novelty(spark, d):
    x = F.array("l_discount", "l_tax", F.col("l_quantity") / 50)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fields.fused(x, "max").alias("most"), fields.fused(x, "mean").alias("mean"), fields.fused(x, "median").alias("middle"), fields.agreeing(x, 0.05).alias("agreeing"))


@query("f3f_attack_scores", """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey / 25.0::DOUBLE ELSE 1 - c_nationkey / 50.0::DOUBLE END AS score FROM customer""")
def attack_scores(spark, d):
    x = F.col("c_nationkey")
    probabilities = F.when(x % 2 == 0, F.array(1 - x / 25.0, x / 25.0)).otherwise(F.array(x / 50.0, 0.5 - x / 50.0, F.lit(0.5)))
    return read(spark, d, "customer").select("c_custkey", fields.attack_score(probabilities, 0).alias("score"))


@query("f3g_intensity", """SELECT event_id, CASE WHEN event_id < 2000 THEN 0.0 WHEN event_id >= 6000 THEN 3.0 ELSE 3.0 * (event_id - 2000) / 4000.0 END::DOUBLE AS at FROM events""")
def drift_intensity(spark, d):
    return read(spark, d, "events").select("event_id", fields.intensity(F.col("event_id"), 2000, 6000, 3.0).alias("at"))


@query("f3c_head_budgets", """SELECT r_regionkey, 1 - pow(1 - (r_regionkey + 1) / 100.0::DOUBLE, 1 / 3.0::DOUBLE) AS each FROM region""")
def head_budgets(spark, d):
    each = F.create_map(*[x for k in range(5) for x in (F.lit(k), F.lit(fields.head_budget((k + 1) / 100, 3)))])
    return read(spark, d, "region").select("r_regionkey", each[F.col("r_regionkey")].alias("each"))


@query("f4_conformal_members", """SELECT array_to_string(list_filter([CASE WHEN l_discount <= .07 THEN 'BENIGN' END, CASE WHEN l_tax >= .04 THEN 'ATTACK' END], lambda x: x IS NOT NULL), '+') AS members,
 CASE WHEN (l_discount <= .07) = (l_tax >= .04) THEN -1 WHEN l_tax >= .04 THEN 1 ELSE 0 END AS label, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def conformal_members(spark, d):
    members = fields.set_names(F.col("l_discount") <= 0.07, F.col("l_tax") >= 0.04)
    return read(spark, d, "lineitem").groupBy(F.array_join(members, "+").alias("members"), fields.set_label(members).alias("label")).agg(F.count("*").alias("n"))


@query("f4b_bounded_sets", """SELECT user_id, CAST(least(count(DISTINCT event_type), 3) AS INT) AS kinds, bool_or(event_type = 'error') AS has_error FROM events GROUP BY 1""")
def bounded_sets(spark, d):
    kinds = F.collect_set("event_type")
    return read(spark, d, "events").groupBy("user_id").agg(F.size(F.slice(F.array_sort(kinds), 1, 3)).alias("kinds"), F.array_contains(kinds, "error").alias("has_error"))


@query("f5_finite_payload", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS kind, event_id % 3 <> 0 AS is_finite, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def finite_payload(spark, d):
    rows = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), "props")
    payload = F.from_json(F.to_json(fields.finite_map(["value"])), "map<string,string>")
    return rows.select("event_id", "kind", payload["value"].isNotNull().alias("is_finite"), F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query("f5d_raw_addresses", """SELECT k AS kind, count(*) AS n, CAST(sum(CAST(k IN (1, 2, 4) AS INT)) AS BIGINT) AS raw FROM (SELECT event_id % 6 AS k FROM events) GROUP BY 1""")
def raw_addresses(spark, d):
    said = F.get(F.array(*map(F.lit, ["none", "from 10.1.2.3, twice", "to fe80::1:2 there", "pseudo:0123456789ab", "2001:0db8:0000:0000:0000:ff00:0042:8329", "12:30:05 and 1.2.3"])), (F.col("event_id") % 6).cast("int"))
    return read(spark, d, "events").groupBy((F.col("event_id") % 6).alias("kind")).agg(F.count("*").alias("n"), F.sum(fields.has_raw_address(said).cast("int")).alias("raw"))


@query("f5d_payload_addresses", """SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0) AS raw, count(*) FILTER (event_id % 3 <> 0) AS finite FROM events GROUP BY 1""")
def payload_addresses(spark, d):
    """Payloads with an address anywhere among their values, and with a finite number in a list of a struct."""
    k = F.col("event_id")
    hosts = F.array(F.when(k % 5 == 0, "10.1.2.3").otherwise("10.1.2.300"), F.lit("seen 10.1.2.3 twice"))
    labels = F.create_map(F.lit("peer"), F.when(k % 7 == 0, "fe80::1:2").otherwise("12:30:05"), F.when(k % 11 == 0, "::ffff:10.0.0.1").otherwise("none"), F.lit(None).cast("string"))
    payload = F.struct(F.struct(hosts.alias("hosts"), F.array(F.when(k % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))).alias("scores")).alias("net"), labels.alias("labels"))
    rows = read(spark, d, "events").select("event_type", payload.alias("p"))
    kind = rows.schema["p"].dataType
    rows = rows.select("event_type", payloads.has_raw_address(F.col("p"), kind).alias("raw"), payloads.finite(F.col("p"), kind).alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("raw").alias("raw"), F.count(F.get("p.net.scores", F.lit(0))).alias("finite"))


RULES = {"r1": [("l_quantity", ">", 45.0), ("l_discount", "<=", 0.02)], "r2": [("l_returnflag=R", ">", 0.5), ("l_tax", ">", 0.06)], "r3": [("l_linestatus=O", "<=", 0.5), ("l_discount", ">", 0.09)]}


@query("f5f_rule_pack_text", """SELECT matched_rule, count(*) AS n FROM (SELECT CASE WHEN l_quantity > 45 AND l_discount <= .02 THEN 'r1' WHEN l_returnflag = 'R' AND l_tax > .06 THEN 'r2' WHEN l_linestatus <> 'O' AND l_discount > .09 THEN 'r3' END AS matched_rule FROM lineitem) WHERE matched_rule IS NOT NULL GROUP BY 1""")
def rule_pack_text(spark, d):
    pack = fields.pack_text(RULES, "{rows}")
    return spark.sql(pack, rows=read(spark, d, "lineitem")).groupBy("matched_rule").agg(F.count("*").alias("n"))


@query("f6b_reidentified", """SELECT '10.0.' || n_regionkey || '.' || n_nationkey AS address, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def reidentified(spark, d):
    """Pseudonyms in stored rows back to addresses, under the present and the previous key."""
    keys = [b"present key", b"previous key"]
    address = F.concat(F.lit("10.0."), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string"))
    known = read(spark, d, "nation").select("n_nationkey", address.alias("address"))
    stored = read(spark, d, "customer").join(F.broadcast(known), F.col("c_nationkey") == F.col("n_nationkey"))  # a row a nation
    stored = stored.select(F.when(F.col("c_custkey") % 2 == 0, pseudonyms.pseudonym(F.col("address"), keys[0])).otherwise(pseudonyms.pseudonym(F.col("address"), keys[1])).alias("pseudonym"))
    return pseudonyms.reidentify(stored, "pseudonym", known, "address", keys).groupBy("address").agg(F.count("*").alias("n"))


@query("f6_networks", """SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1""")
def networks(spark, d):
    """Addresses of a /24 keep its pseudonym and their last part."""
    address = F.concat(F.lit("10.0."), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string"))
    kept = pseudonyms.subnet_pseudonym(address, b"present key")
    rows = read(spark, d, "nation").select("n_regionkey", F.regexp_extract(kept, r"^(.*)\.\d+$", 1).alias("net"), F.regexp_extract(kept, r"\.(\d+)$", 1).alias("host"), "n_nationkey")
    by = rows.where(F.col("host") == F.col("n_nationkey").cast("string")).groupBy("net").agg(F.min("n_regionkey").alias("region"), F.max("n_regionkey").alias("top"), F.count("*").alias("n"))
    return by.where("region = top").select("region", "n")
