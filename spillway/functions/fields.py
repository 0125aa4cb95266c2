"""Column expressions over single fields: labels, times, ratios, lists, JSON, rule text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings of attack families in the flow data of 2015, and their names.
FAMILIES = {
    "analysis": "Analysis",
    "backdoor": "Backdoor",
    "backdoors": "Backdoor",
    "dos": "DoS",
    "exploits": "Exploits",
    "fuzzers": "Fuzzers",
    "generic": "Generic",
    "normal": "Normal",
    "reconnaissance": "Reconnaissance",
    "shellcode": "Shellcode",
    "worms": "Worms",
}
#: Attack names of the 1999 connection data by category.
CATEGORIES = {
    "normal": "normal",
    "dos": "apache2 back land mailbomb neptune pod processtable smurf teardrop udpstorm",
    "probe": "ipsweep mscan nmap portsweep saint satan",
    "r2l": "ftp_write guess_passwd httptunnel imap multihop named phf sendmail snmpgetattack snmpguess spy warezclient warezmaster worm xlock xsnoop",
    "u2r": "buffer_overflow loadmodule perl ps rootkit sqlattack xterm",
}
#: Time formats that are tried in this order.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy hh:mm:ss a", "dd/MM/yyyy HH:mm")
IPV4 = r"(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}($|[^0-9.])"
IPV6 = r"(^|[^0-9A-Za-z:])([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}($|[^0-9A-Za-z:])|(^|[^0-9A-Za-z:])[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{1,4}){0,6}::([0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{0,4}($|[^0-9A-Za-z:])"


def _lookup(key: Column, table: dict[str, str], what: str) -> Column:
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair]).getItem(key)
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"unknown {what}: "), key)))


def flow_label(value: Column) -> Column:
    """What a label names: single spaces, plain dashes, and no word "attempted" at either end, nor a dash that led to it; nothing left is BENIGN."""
    text = plain_space(F.translate(value, "–—", "--"))
    text = F.when(F.startswith(F.lower(text), F.lit("attempted ")), F.right(text, F.length(text) - 10)).otherwise(text)
    tried = F.endswith(F.lower(text), F.lit("attempted"))
    head = F.rtrim(F.left(text, F.length(text) - 9))
    head = F.when(F.endswith(head, F.lit("-")), F.rtrim(F.left(head, F.length(head) - 1))).otherwise(head)
    text = F.translate(F.when(tried, head).otherwise(text), "\ufffd", "-")
    return F.when(F.coalesce(text, F.lit("")) == "", "BENIGN").otherwise(text)


def family(value: Column) -> Column:
    """The family's name; none, "" and "-" are Normal, an unknown spelling is an error."""
    key = F.lower(F.trim(value))
    return F.when(value.isNull() | key.isin("", "-"), "Normal").otherwise(_lookup(key, FAMILIES, "family"))


def attack_category(value: Column) -> Column:
    """normal, dos, probe, r2l or u2r; an unknown attack is an error."""
    return _lookup(attack_name(value), {name: category for category, names in CATEGORIES.items() for name in names.split()}, "attack")


def attack_name(value: Column) -> Column:
    return F.rtrim(F.lower(F.trim(value)), F.lit("."))


def plain_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cut_at_sentence(text: Column, most: int) -> Column:
    """At most ``most`` characters, back to the last sentence's end if there is one."""
    flat = plain_space(text)
    head = F.substring(flat, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*\.)(\s|$)", 1)
    return F.when(F.length(flat) <= most, flat).when(whole != "", whole).otherwise(F.concat(head, F.lit("…")))


def first_sentence(text: Column) -> Column:
    flat = plain_space(text)
    found = F.regexp_extract(flat, r"^(.*?\.)(\s|$)", 1)
    return F.when(found == "", flat).otherwise(found)


def steps(text: Column, least: int = 30, most: int = 3) -> Column:
    """The first sentences of more than ``least`` characters."""
    parts = F.transform(F.split(plain_space(text), r"\.\s"), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: F.length(x) > least), 1, most)


def column_name(value: Column) -> Column:
    return F.translate(value, " -", "__")


def quoted(value: Column) -> Column:
    """A scalar that YAML reads as text."""
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def in_any_network(address: Column, prefixes: list[str]) -> Column:
    """Whether an address begins with one of the prefixes; with no prefixes all do."""
    return reduce(Column.__or__, [F.coalesce(F.startswith(address, F.lit(p)), F.lit(False)) for p in prefixes]) if prefixes else F.lit(True)


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in the text as whole words, whatever the case."""
    return reduce(Column.__or__, [F.rlike(text, F.lit(rf"(?i)(?<![A-Za-z0-9]){t}(?![A-Za-z0-9])")) for t in terms], F.lit(False))


def number_text(x: Column) -> Column:
    """With separators and no decimals from 100 on, else with two decimals at most."""
    return F.when(F.abs(x) >= 100, F.format_number(F.bround(x), 0)).otherwise(F.regexp_replace(F.format_number(x, 2), r"\.?0+$", ""))


def narrate(feature: Column, x: Column, templates: dict[str, str]) -> Column:
    """The feature's sentence with {v} as the number; empty for features without one."""
    template = F.create_map(*[F.lit(y) for pair in templates.items() for y in pair]).getItem(feature)
    return F.coalesce(F.replace(template, F.lit("{v}"), number_text(x)), F.lit(""))


def time_of(text: Column) -> Column:
    """A time in one of TIME_FORMATS or, failing these, in ISO 8601, with or without its parts from the right; null if none fits."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in TIME_FORMATS], F.when(F.rlike(bare, F.lit("^[0-9]{4}-[0-9]{2}")), bare.try_cast("timestamp")))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def spaced_time(k: Column, n: int, first: str, seconds: int) -> Column:
    """The ``k``-th (from 0) of ``n`` times spread evenly over ``seconds`` from ``first``."""
    return F.timestamp_micros((F.unix_micros(F.lit(first).cast("timestamp")) + F.floor(k.cast("double") * (seconds * 1_000_000) / max(n - 1, 1))).cast("long"))


def rate(a: Column, b: Column) -> Column:
    """``a`` over ``b``, 0 where that is undefined."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def head_budget(budget: float, heads: int) -> float:
    """What each of independent heads may spend so that any of them fires at ``budget``."""
    return 1 - (1 - budget) ** (1 / heads)


def fused(scores: Column, how: str = "max") -> Column:
    """One score from an array of them: max, mean or median."""
    ordered, n = F.array_sort(scores), F.size(scores)
    if how == "max":
        return F.array_max(scores)
    if how == "mean":
        return F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / n
    return (F.get(ordered, ((n - 1) / 2).cast("int")) + F.get(ordered, (n / 2).cast("int"))) / 2


def agreeing(percentiles: Column, at: float = 0.99) -> Column:
    return F.size(F.filter(percentiles, lambda x: x >= at))


def attack_score(probabilities: Column, benign: int) -> Column:
    """The second of two probabilities; of several, what the benign class leaves."""
    return F.when(F.size(probabilities) == 2, F.get(probabilities, F.lit(1))).otherwise(1 - F.get(probabilities, F.lit(benign)))


def intensity(position: Column, start: float, full: float, magnitude: float) -> Column:
    """0 before ``start``, ``magnitude`` from ``full`` on, a line between."""
    return F.when(position < start, 0.0).when(position >= full, magnitude).otherwise(magnitude * (position - start) / max(full - start, 1e-12))


def ttl_bucket(ttl: Column) -> Column:
    """0 to 3 for up to 31, 63, 127 and 255."""
    return F.when(ttl <= 31, 0).when(ttl <= 63, 1).when(ttl <= 127, 2).when(ttl <= 255, 3)


def state_ttl(state: Column, ttl: Column, states: list[str]) -> Column:
    """The state's place among the sorted ones times 4, and the bucket of ``ttl``."""
    return (F.array_position(F.lit(sorted(states)), state).cast("int") - 1) * 4 + ttl_bucket(ttl)


def megabits(flows_per_second: Column, bytes_per_flow: Column) -> Column:
    return flows_per_second * bytes_per_flow * 8 / 1e6


def set_names(benign: Column, attack: Column) -> Column:
    """The members of a conformal set."""
    return F.array_compact(F.array(F.when(benign, "BENIGN"), F.when(attack, "ATTACK")))


def set_label(members: Column) -> Column:
    """0 or 1 for a set of one member, else -1."""
    return F.when(F.size(members) != 1, -1).when(F.get(members, F.lit(0)) == "ATTACK", 1).otherwise(0)


def finite_map(columns: list[str]) -> Column:
    """A map of the columns as text; numbers that aren't finite become null."""
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c)).cast("string"))])


def has_raw_address(text: Column) -> Column:
    """Whether an IPv4 or IPv6 literal stands in the text."""
    return F.rlike(text, F.lit(IPV4)) | F.rlike(text, F.lit(IPV6))


def condition_text(feature: str, op: str, at: float, columns: dict[str, str] | None = None) -> str:
    """One condition of a rule as SQL; ``service=http`` above one half means that the column has the value."""
    name, is_value, value = feature.partition("=")
    name = (columns or {}).get(name, name.replace(" ", "_").replace("-", "_"))
    if is_value:
        return f"{name} {'=' if op == '>' else '<>'} '{value.replace(chr(39), chr(39) * 2)}'"
    return f"{name} {op} {at:g}"


def rule_text(conditions: list[tuple[str, str, float]]) -> str:
    return " AND ".join(condition_text(*c) for c in conditions)


def pack_text(rules: dict[str, list[tuple[str, str, float]]], table: str) -> str:
    """Rules as one SQL query that gives each row the name of the first rule that takes it; rows without one are left out."""
    cases = "\n".join(f"  WHEN {rule_text(c)} THEN '{name}'" for name, c in rules.items())
    return f"SELECT * FROM (SELECT *, CASE\n{cases}\n END AS matched_rule FROM {table}) WHERE matched_rule IS NOT NULL"
