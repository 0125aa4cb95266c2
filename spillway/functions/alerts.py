"""Alerts as rows: what is suppressed, what is said, and their projections onto three public event schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spillway.functions import scoring

VENDOR, PRODUCT, VERSION = "Spillway", "Spillway Detector", "1"
#: What a suppression may match on, which of it narrows it, what says nothing, what says everything.
MATCH_FIELDS = ("src_ip", "dst_ip", "dst_port", "protocol", "service", "family")
SCOPING_FIELDS = ("src_ip", "dst_ip", "dst_port", "service")
PLACEHOLDERS = ("-", "", "none", "null", "nan", "unknown")
WILDCARDS = ("*", "all", "%")
MOST_DAYS = 90
ACTIONABLE = ("KNOWN_ATTACK", "NOVEL_SUSPICIOUS", "UNCERTAIN")
SEVERITIES = ("INFORMATIONAL", "LOW", "MEDIUM", "HIGH")


#: The version of the normalised network session, the fields that it must have, and what some may hold.
SESSION_VERSION = "0.2.7"
SESSION_FIELDS = ("TimeGenerated", "EventCount", "EventStartTime", "EventEndTime", "EventType", "EventResult", "EventProduct", "EventVendor", "EventSchema", "EventSchemaVersion", "Dvc")
SESSION_VALUES = {
    "EventType": ("NetworkSession", "L2NetworkSession", "Flow", "EndpointNetworkSession", "IDS"),
    "EventResult": ("Success", "Partial", "Failure", "NA"),
    "EventSeverity": ("Informational", "Low", "Medium", "High"),
    "DvcAction": ("Allow", "Deny", "Drop", "Drop ICMP", "Reset", "Reset Source", "Reset Destination", "Encrypt", "Decrypt", "VPNroute"),
    "ThreatField": ("SrcIpAddr", "DstIpAddr"),
}


def actionable(verdict: Column) -> Column:
    return verdict.isin(*ACTIONABLE)


def severity_rank(severity: Column) -> Column:
    """1 to 4 in the order of SEVERITIES."""
    return F.array_position(F.lit(list(SEVERITIES)), severity).cast("int")


def matchable(columns: dict[str, str]) -> Column:
    """A map of MATCH_FIELDS as text from the named columns; what a row lacks is null."""
    return F.create_map(*[x for f in MATCH_FIELDS for x in (F.lit(f), F.col(columns[f]).cast("string") if f in columns else F.lit(None).cast("string"))])


def proposed_match(fields: Column) -> Column:
    """The narrowest rule for an alert: all that it has, but placeholders."""
    return F.map_filter(fields, lambda k, v: F.coalesce(~F.lower(F.trim(v)).isin(*PLACEHOLDERS), F.lit(False)))


def rule_problems(match: Column, created: Column, expires: Column) -> Column:
    """What is wrong with a suppression rule, as an array; empty for a good one."""
    real = proposed_match(match)
    wild = F.map_filter(real, lambda k, v: F.lower(v).isin(*WILDCARDS) | ((F.lower(v) == "any") & (k != "protocol")))
    unknown = F.array_except(F.map_keys(match), F.lit(list(MATCH_FIELDS)))
    scoped = F.arrays_overlap(F.map_keys(real), F.lit(list(SCOPING_FIELDS)))
    life = F.unix_micros(expires.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    return F.array_compact(
        F.array(
            F.when(F.size(unknown) > 0, "unknown field"),
            F.when(F.cardinality(wild) > 0, "wildcard"),
            F.when(~scoped, "unscoped"),
            F.when(life <= 0, "expires before it begins"),
            F.when(life > MOST_DAYS * 86_400_000_000, "too long"),
        )
    )


def active(created: Column, expires: Column, now: Column) -> Column:
    return (created <= now) & (now < expires)


def rule_matches(match: Column, fields: Column) -> Column:
    """Whether all of a rule's fields equal the alert's, whatever their case; what is missing matches nothing."""
    return F.forall(F.map_entries(match), lambda e: F.coalesce(F.lower(fields.getItem(e["key"])) == F.lower(e["value"]), F.lit(False)))


def title(verdict: Column, family: Column, source: Column) -> Column:
    novel = F.concat(F.lit("Unusual network session from "), F.coalesce(source, F.lit("an unknown source")), F.lit(" with no known attack family"))
    return F.when(verdict == "NOVEL_SUSPICIOUS", novel).otherwise(F.concat(F.coalesce(family, F.lit("Unusual")), F.lit(" network session detected")))


def suggested_action(verdict: Column, severity: Column) -> Column:
    return F.when(verdict == "NOVEL_SUSPICIOUS", "hunt: compare with the source's usual traffic").when(severity == "HIGH", "contain the source after approval").when(verdict == "UNCERTAIN", "review").otherwise("monitor")


def alert(p: Column, novelty: Column, agreement: Column, abstains: Column, family: Column, source: Column, target: Column, port: Column, at: Column, uid: Column) -> Column:
    """One alert as a struct from a row's scores; scores are clipped to 0 to 1, and a novel one has no family."""
    p, novelty = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(novelty, F.lit(0.0)), F.lit(1.0))
    verdict, severity = scoring.verdict(p, novelty, agreement, abstains), scoring.severity(p, novelty)
    family = F.when(verdict != "NOVEL_SUSPICIOUS", family)
    return F.struct(
        uid.alias("alert_id"), at.alias("at"), verdict.alias("verdict"), severity.alias("severity"), p.alias("p_attack"), novelty.alias("novelty"), scoring.priority(p, novelty, agreement).alias("priority"), family.alias("family"),
        source.alias("src_ip"), target.alias("dst_ip"), port.alias("dst_port"), agreement.alias("agreement"), title(verdict, family, source).alias("title"), suggested_action(verdict, severity).alias("action"), (severity == "HIGH").alias("needs_approval"),
    )


def network_session(a: Column) -> Column:
    """The alert as a normalised network session; whole numbers from 0 to 100 are rounded half to even."""
    has = a["src_ip"].isNotNull()
    return F.struct(
        a["at"].alias("TimeGenerated"), F.lit(1).alias("EventCount"), a["at"].alias("EventStartTime"), a["at"].alias("EventEndTime"), F.lit(SESSION_VERSION).alias("EventSchemaVersion"), F.lit(PRODUCT).alias("Dvc"), F.lit("IDS").alias("EventType"), F.lit("Success").alias("EventResult"), F.lit(PRODUCT).alias("EventProduct"), F.lit(VENDOR).alias("EventVendor"), F.lit("NetworkSession").alias("EventSchema"),
        F.initcap(a["severity"]).alias("EventSeverity"), a["alert_id"].alias("EventUid"), F.lit("Allow").alias("DvcAction"), a["title"].alias("EventMessage"), F.coalesce(a["family"], a["verdict"]).alias("ThreatCategory"),
        F.bround(a["p_attack"] * 100).cast("int").alias("ThreatConfidence"), a["priority"].alias("ThreatRiskLevel"), a["src_ip"].alias("SrcIpAddr"), F.when(has, a["src_ip"]).alias("ThreatIpAddr"), F.when(has, "SrcIpAddr").alias("ThreatField"), a["dst_ip"].alias("DstIpAddr"), a["dst_port"].alias("DstPortNumber"),
        F.to_json(F.struct(a["verdict"].alias("Verdict"), F.bround(a["novelty"], 4).alias("NoveltyPercentile"), a["agreement"].alias("DetectorAgreement"), a["needs_approval"].alias("RequiresAnalystApproval"))).alias("AdditionalFields"),
    )


def network_session_problems(s: Column) -> Column:
    required = [F.when(s[f].isNull(), f"missing {f}") for f in (*SESSION_FIELDS, "EventSeverity", "EventUid")]
    bounded = [F.when(~s[f].between(0, 100), f"{f} out of range") for f in ("ThreatConfidence", "ThreatRiskLevel")]
    known = [F.when(~s[f].isin(*values), f"unknown {f}") for f, values in SESSION_VALUES.items()]
    order = F.when(s["EventEndTime"] < s["EventStartTime"], "ends before it starts")
    return F.array_compact(F.array(*required, *bounded, *known, order, F.when(s["ThreatIpAddr"].isNotNull() & s["ThreatField"].isNull(), "ThreatField is required")))


def detection_finding(a: Column) -> Column:
    """The alert as a detection finding of the open cybersecurity schema: class 2004, confidence in three bands."""
    band = F.when(a["p_attack"] < 0.34, 1).when(a["p_attack"] < 0.67, 2).otherwise(3)
    evidence = F.struct(F.when(a["src_ip"].isNotNull(), F.struct(a["src_ip"].alias("ip"))).alias("src_endpoint"), F.when(a["dst_ip"].isNotNull(), F.struct(a["dst_ip"].alias("ip"), a["dst_port"].alias("port"))).alias("dst_endpoint"), F.when(a["src_ip"].isNull() & a["dst_ip"].isNull(), "flow features only").alias("data"))
    return F.struct(
        F.lit(2004).alias("class_uid"), F.lit(2).alias("category_uid"), F.lit(1).alias("activity_id"), F.lit(2004 * 100 + 1).alias("type_uid"), F.unix_millis(a["at"].cast("timestamp")).alias("time"), severity_rank(a["severity"]).alias("severity_id"), F.lit(1).alias("status_id"),
        band.alias("confidence_id"), F.bround(a["p_attack"] * 100).cast("int").alias("confidence_score"), F.struct(F.lit(PRODUCT).alias("product"), F.lit(VENDOR).alias("vendor_name")).alias("metadata"), F.struct(a["alert_id"].alias("uid"), a["title"].alias("title")).alias("finding_info"), F.array(evidence).alias("evidences"),
    )


def detection_finding_problems(f: Column) -> Column:
    return F.array_compact(F.array(*[F.when(f[c].isNull(), f"missing {c}") for c in ("class_uid", "time", "severity_id", "metadata", "finding_info")], F.when(f["type_uid"] != f["class_uid"] * 100 + f["activity_id"], "type_uid does not follow"), F.when(~f["confidence_id"].between(0, 3), "unknown confidence"), F.when(F.size(f["evidences"]) == 0, "no evidence")))


def common_event(a: Column) -> Column:
    """The alert as a document of the elastic common schema."""
    event = F.struct(F.lit("alert").alias("kind"), F.array(F.lit("intrusion_detection"), F.lit("network")).alias("category"), F.lit("success").alias("outcome"), severity_rank(a["severity"]).alias("severity"), a["priority"].alias("risk_score"), a["alert_id"].alias("id"), F.when(a["verdict"] == "NOVEL_SUSPICIOUS", "unlike usual traffic").alias("reason"))
    return F.struct(a["at"].alias("@timestamp"), event.alias("event"), F.struct(F.concat(F.coalesce(a["family"], F.lit("novelty")), F.lit(" detector")).alias("name"), F.lit(VERSION).alias("version")).alias("rule"), a["title"].alias("message"), F.when(a["src_ip"].isNotNull(), F.struct(a["src_ip"].alias("ip"))).alias("source"), F.when(a["dst_ip"].isNotNull(), F.struct(a["dst_ip"].alias("ip"), a["dst_port"].alias("port"))).alias("destination"))


def common_event_problems(e: Column) -> Column:
    return F.array_compact(F.array(F.when(e["@timestamp"].isNull(), "missing @timestamp"), F.when(~e["event"]["kind"].isin("alert", "event"), "kind not allowed"), F.when(~e["event"]["severity"].between(1, 4), "unknown severity"), F.when(F.size(e["event"]["category"]) == 0, "no category")))
