"""Column expressions of the detection layer: verdicts, lanes, priorities, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the verdict lattice.
KNOWN_AT, NOVEL_AT, UNCERTAIN_AT = 0.80, 0.99, 0.40


def verdict(p: Column, novelty: Column, agreement: Column, abstains: Column) -> Column:
    """First match: known, novel, uncertain, benign."""
    return (
        F.when(p >= KNOWN_AT, "KNOWN_ATTACK")
        .when((novelty >= NOVEL_AT) & (agreement >= 1), "NOVEL_SUSPICIOUS")
        .when(abstains | ((p >= UNCERTAIN_AT) & (p < KNOWN_AT)), "UNCERTAIN")
        .otherwise("BENIGN")
    )


def severity(p: Column, novelty: Column) -> Column:
    return F.when((p >= 0.90) | (novelty >= 0.999), "HIGH").when((p >= KNOWN_AT) | (novelty >= NOVEL_AT), "MEDIUM").when(p >= UNCERTAIN_AT, "LOW").otherwise("INFORMATIONAL")


def priority(p: Column, novelty: Column, agreement: Column) -> Column:
    """0 to 100, rounded half to even."""
    return F.bround(F.least(F.lit(1.0), F.greatest(p, novelty) + 0.04 * F.least(agreement, F.lit(3))) * 100).cast("int")


def fired(p: Column, novelty: Column, p_at: float, novelty_at: float) -> Column:
    """0 none, 1 the classifier, 2 novelty, 3 both."""
    return (p >= p_at).cast("int") + 2 * (novelty >= novelty_at).cast("int")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def equal_width_bin(x: Column, n: int) -> Column:
    """Bin of x in [0, 1]; the last one is closed."""
    return F.least(F.floor(x * n), F.lit(n - 1)).cast("int")


def finite_or_null(x: Column) -> Column:
    """NaN and infinities become null, so that comparisons with them are never true."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
