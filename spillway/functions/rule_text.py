"""Mined rules as text that other systems run: query predicates of a log store, and rules of a portable format.

A rule is a list of (feature, "<=" or ">", threshold). A feature such as
``service=http`` is an indicator of a text column; the text names the column and
its value. What a rule cost on held-out rows stands beside it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from spillway.functions.rules import Condition, simplify


@dataclass(frozen=True)
class Cost:
    precision: float
    false_alarms: int
    matches: int

    def __str__(self) -> str:
        return f"held-out precision {self.precision:.3f}, {self.false_alarms} false alarms in {self.matches} matches"


UNTESTED = "not tested on held-out rows, do not enable"


def text_value(value: str) -> str:
    """A value in double quotes, whatever it holds."""
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def column_of(name: str) -> str:
    return name.replace(" ", "_").replace("-", "_")


def predicate(conditions: list[Condition]) -> str:
    """The rule as one expression; an indicator is an equality, or its contrary."""
    parts = []
    for feature, op, at in simplify(conditions):
        column, equals, value = feature.partition("=")
        parts.append(f"{column_of(column)} {'==' if op == '>' else '!='} {text_value(value)}" if equals else f"{column_of(column)} {op} {at:.6g}")
    return " and ".join(parts) or "true"


def query_text(conditions: list[Condition], table: str, cost: Cost | None = None, name: str = "rule") -> str:
    """A query for the rows of ``table`` that the rule matches."""
    return f"// {name}: {cost or UNTESTED}\n{table}\n| where {predicate(conditions)}"


def pack_query(rules: dict[str, list[Condition]], table: str, costs: dict[str, Cost]) -> str:
    """One query that gives each row of ``table`` the first rule that it matches; only rules that were tested are in it."""
    tested = {n: c for n, c in rules.items() if n in costs}
    cases = [f"    {predicate(c)}, {text_value(n)}, // {costs[n]}" for n, c in tested.items()]
    head = [f"// {len(tested)} of {len(rules)} rules were tested", table]
    return "\n".join([*head, "| extend MatchedRule = case(", *cases, '    "")', '| where MatchedRule != ""']) if tested else "\n".join([*head, "| where false"])


def portable_rule(conditions: list[Condition], fields: dict[str, str], cost: Cost | None = None, title: str = "mined rule") -> str | None:
    """The rule in the portable format, or None where it can't say the same.

    ``fields`` gives the format's name for each column; a rule that reads any
    other, that asks two values of one column, or that only rules values out has
    no such text. Values ruled out of one column are a list, none of which may be.
    """
    wanted: dict[str, str] = {}
    ruled_out: dict[str, list[str]] = {}
    for feature, op, at in simplify(conditions):
        column, equals, value = feature.partition("=")
        name = fields.get(column)
        if name is None:
            return None
        if equals and op == "<=":
            ruled_out.setdefault(name, []).append(text_value(value))
            continue
        key = name if equals else f"{name}|{'lte' if op == '<=' else 'gt'}"
        if key in wanted:
            return None
        wanted[key] = text_value(value) if equals else f"{at:.6g}"
    if not wanted:
        return None
    number = hashlib.md5(repr(simplify(conditions)).encode()).hexdigest()
    lines = [f"title: {title}", f"id: {number[:8]}-{number[8:12]}-{number[12:16]}-{number[16:20]}-{number[20:]}", "status: experimental", f"description: {text_value(str(cost or UNTESTED))}"]
    lines += ["logsource:", "    category: firewall", "detection:", "    selection:", *(f"        {k}: {v}" for k, v in wanted.items())]
    if ruled_out:
        lines += ["    filter:", *(line for k, own in ruled_out.items() for line in ([f"        {k}: {own[0]}"] if len(own) == 1 else [f"        {k}:", *(f"            - {v}" for v in own)]))]
    return "\n".join([*lines, f"    condition: selection{' and not filter' if ruled_out else ''}", "level: medium"])


def portable_pack(rules: dict[str, list[Condition]], fields: dict[str, str], costs: dict[str, Cost]) -> tuple[dict[str, str], list[str]]:
    """The texts of the tested rules that have one, and the names of those that have none."""
    made = {n: portable_rule(c, fields, costs[n], n) for n, c in rules.items() if n in costs}
    return {n: t for n, t in made.items() if t}, [n for n, t in made.items() if not t]
