"""Suppression rules: a bounded list that people keep, matched as one expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[dict]) -> Column:
    """The ``rule_id`` of the latest created rule whose ``match`` fields all equal the row's, whatever their case."""
    latest = sorted(rules, key=lambda r: r["created_at"], reverse=True)
    every = lambda m: reduce(Column.__and__, [F.lower(F.col(f)) == str(v).lower() for f, v in m.items()])
    return F.coalesce(*[F.when(every(r["match"]), r["rule_id"]) for r in latest])
