"""Intervals and p values: resampling as weights in aggregates, and closed forms of a few counts on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillway.operators.ordered import running_sums

#: How likely a Poisson variable of mean 1 is to be at most 0, 1, 2, ...
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def _digits(*parts: Column) -> Column:
    """Eight hexadecimal digits that the parts decide, the same on every machine."""
    return F.substring(F.md5(F.encode(F.concat_ws(":", *[p.cast("string") for p in parts]), "UTF-8")), 1, 8)


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 that the parts decide."""
    return F.conv(_digits(*parts), 16, 10).cast("long") / 4294967296


def poisson_weight(u: Column) -> Column:
    """How often a resample takes a row, from a uniform number."""
    return F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda at: at <= u))


def poisson_weight_of(digits: Column) -> Column:
    """``poisson_weight`` of the number that eight hexadecimal digits stand for; as text they are in the same order."""
    ends = [e for e in (math.ceil(at * 2**32) for at in POISSON) if e < 2**32]
    made = F.when(digits < f"{ends[0]:08x}", 0)
    for k, end in enumerate(ends[1:], 1):
        made = made.when(digits < f"{end:08x}", k)
    return made.otherwise(len(ends))


def bootstrap_ratio(df: DataFrame, row: str, part: Column, whole: Column, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """low, high, mean of sum(part) / sum(whole) over resamples of the rows.

    A row has a Poisson weight of its own in each resample, so that rows are
    neither collected nor ordered and partial sums of all resamples are added up.
    A class's rows are resampled by themselves if ``whole`` is 0 for all others.
    Resamples without a denominator are left out.
    """
    rows = df.where(whole != 0).select(F.col(row), part.alias("_a"), whole.alias("_b"))
    each = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_h", _digits(F.col(row), F.col("_r"))).withColumn("_w", poisson_weight_of(F.col("_h")))
    by = each.groupBy("_r").agg(F.sum(F.col("_w") * F.col("_a")).alias("a"), F.sum(F.col("_w") * F.col("_b")).alias("b")).where("b > 0").select((F.col("a") / F.col("b")).alias("x"))
    return interval(by, level)


def interval(values: DataFrame, level: float) -> DataFrame:
    """low, high, mean of a column ``x`` with a row for each resample."""
    ends = F.percentile("x", [(1 - level) / 2, (1 + level) / 2])
    return values.agg(ends[0].alias("low"), ends[1].alias("high"), F.avg("x").alias("mean"))


def block_bootstrap_ratio(df: DataFrame, position: str, part: Column, whole: Column, block: int = 200, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """As ``bootstrap_ratio`` for rows in time order (``position``: gapless from 1), from runs of ``block`` rows in a row.

    A run's sums are differences of running sums, so a resample reads two rows for each run.
    """
    sums = running_sums(df.select(F.col(position), part.alias("_a"), whole.alias("_b")), position, {"_to_a": "_a", "_to_b": "_b"})
    n = df.count()
    block = min(block, n)
    runs = df.sparkSession.range(replicates * -(-n // block)).select((F.col("id") % replicates).alias("_r"), F.floor(uniform(F.col("id")) * (n - block + 1)).cast("long").alias("_before"))
    ends = sums.select(F.col(position).alias("_at"), "_to_a", "_to_b")
    first = runs.join(ends.withColumnsRenamed({"_at": "_before", "_to_a": "_from_a", "_to_b": "_from_b"}), "_before", "left").fillna(0, ["_from_a", "_from_b"])
    found = first.join(ends, F.col("_before") + block == F.col("_at"))
    by = found.groupBy("_r").agg(F.sum(F.col("_to_a") - F.col("_from_a")).alias("a"), F.sum(F.col("_to_b") - F.col("_from_b")).alias("b")).where("b > 0")
    return interval(by.select((F.col("a") / F.col("b")).alias("x")), level)


def log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _falling(first: float, ratios: Iterator[float]) -> float:
    """The sum of terms that fall off, each the one before times a ratio, until they no longer add to it."""
    total = term = first
    for ratio in ratios:
        term *= ratio
        if term <= total * 1e-18:
            break
        total += term
    return total


def binomial_upper(k: int, n: int, p: float) -> float:
    """How likely ``k`` or more of ``n`` are.

    Terms are added from ``k`` away from the mean, where each is less than the one
    before: as many as some standard deviations, not as rows.
    """
    if k <= 0:
        return 1.0
    if p <= 0 or p >= 1 or k > n:
        return float(p >= 1 and k <= n)
    odds, upper = p / (1 - p), k > n * p
    at = k if upper else k - 1
    first = math.exp(log_choose(n, at) + at * math.log(p) + (n - at) * math.log1p(-p))
    if upper:
        return min(1.0, _falling(first, ((n - j) / (j + 1) * odds for j in range(at, n))))
    return max(0.0, 1.0 - _falling(first, (j / (n - j + 1) / odds for j in range(at, 0, -1))))


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """The exact interval of a share, by bisection."""

    def solve(rising, target: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if rising(mid) < target else (low, mid)
        return (low + high) / 2

    low = 0.0 if k == 0 else solve(lambda p: binomial_upper(k, n, p), alpha / 2)
    high = 1.0 if k == n else solve(lambda p: binomial_upper(k + 1, n, p), 1 - alpha / 2)
    return low, high


def sign_test(a: int, b: int) -> float:
    """The exact two-sided p value of McNemar's test for discordant counts."""
    n, least = a + b, min(a, b)
    return 1.0 if n == 0 else min(1.0, 2 * binomial_upper(n - least, n, 0.5))


def kolmogorov(d: float, n: int, m: int, terms: int = 100) -> float:
    """The asymptotic p value of a two-sample Kolmogorov-Smirnov statistic."""
    x = d * math.sqrt(n * m / (n + m))
    return 1.0 if x < 0.2 else min(1.0, max(0.0, 2 * math.fsum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, terms + 1))))
