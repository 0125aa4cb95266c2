"""Mined rules: conjunctions of (feature, operator, threshold) as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Condition = tuple[str, str, float]


def simplify(conditions: list[Condition]) -> list[Condition]:
    """The tightest bound of each feature and operator, sorted; rules that are the same have the same list.

    Of indicators such as ``service=http`` one that holds says that no other of its column does.
    """
    tight: dict[tuple[str, str], float] = {}
    for feature, op, at in conditions:
        if op not in ("<=", ">"):
            raise ValueError(f"unknown operator {op!r}")
        pick = min if op == "<=" else max
        tight[feature, op] = pick(tight.get((feature, op), at), at)
    held = {f.partition("=")[0]: f for f, op in tight if "=" in f and op == ">"}
    implied = lambda f, op: "=" in f and op == "<=" and held.get(f.partition("=")[0], f) != f
    return [(*key, at) for key, at in sorted(tight.items()) if not implied(*key)]


def depends_on(conditions: list[Condition], features: set[str]) -> bool:
    """Whether a rule reads one of the features, be it as one of their indicators."""
    return any(f in features or f.partition("=")[0] in features for f, _, _ in conditions)


def matches(conditions: list[Condition]) -> Column:
    """Whether every condition holds; a missing or NaN feature never matches."""

    def one(feature: str, op: str, at: float) -> Column:
        x = F.col(feature)
        return F.coalesce(~F.isnan(x.cast("double")) & ((x <= at) if op == "<=" else (x > at)), F.lit(False))

    return reduce(Column.__and__, [one(*c) for c in simplify(conditions)], F.lit(True))


def first_match(pack: list[tuple[str, list[Condition]]]) -> Column:
    """The id of the first rule of ``pack`` that matches, else null."""
    return F.coalesce(*[F.when(matches(conditions), F.lit(name)) for name, conditions in pack])
