"""Exact statistics of scored rows; each is one or two shuffles keyed by score, bin or group."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillway.operators.ordered import running_sums

#: Different values, with their counts, that the driver may put in order.
FEW = 50_000


def confusion(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    hit = F.col(score) >= threshold
    pos = F.col(label) == 1
    n = lambda c, name: F.count_if(c).alias(name)
    out = df.agg(n(hit & pos, "tp"), n(hit & ~pos, "fp"), n(~hit & ~pos, "tn"), n(~hit & pos, "fn"), F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return out.select("*", ratio("tp", "fn").alias("tpr"), ratio("fp", "tn").alias("fpr"), ratio("tp", "fp").alias("precision"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, tp, fp at each distinct threshold. Rows are counted by score before anything is ordered."""
    by = df.groupBy(F.col(score).alias("score")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    return running_sums(by.where("score is not null"), "score", {"tp": "pos", "fp": "neg"}, descending=True)


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney AUC with ties counted half."""
    pts = roc_points(df, label, score)
    total = pts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("fp") - F.col("neg")) + F.col("pos") * F.col("neg") / 2).alias("lost"))
    return total.select((1 - F.try_divide("lost", F.col("p") * F.col("n"))).alias("roc_auc"))


def recall_at_fpr(df: DataFrame, label: str, score: str, target: float) -> DataFrame:
    pts = roc_points(df, label, score)
    total = df.agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    kept = pts.crossJoin(F.broadcast(total)).where(F.col("fp") / F.col("n") <= target)  # one row of totals
    return kept.agg(F.max(F.col("tp") / F.col("p")).alias("recall"), F.min("score").alias("threshold"))


def reliability(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    from spillway.functions.scoring import equal_width_bin

    return df.groupBy(equal_width_bin(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("observed"))


def leaky_values(df: DataFrame, label: str, columns: list[str], share: float = 0.01, least: int = 20, purity: float = 0.99, most_values: int = 1000) -> DataFrame:
    """(feature, value) that nearly settle the label: support, purity of either class."""
    n = df.count()
    long = df.select(label, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(label, "x.*")
    by = long.groupBy("feature", "value").agg(F.count("*").alias("support"), F.avg(label).alias("rate"))
    few = by.groupBy("feature").count().where(F.col("count") <= most_values).select("feature")
    pure = F.greatest(F.col("rate"), 1 - F.col("rate"))
    return by.join(few, "feature", "left_semi").where((F.col("support") >= max(int(share * n), least)) & (pure >= purity)).select("feature", "value", "support", pure.alias("purity"))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index over the reference's quantiles, frozen and opened at both ends; null where a side has no values."""
    return psi_of(reference, current, frozen_edges(reference, [column], bins)).select("psi")


def ks(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic. Values are counted before they are ordered."""
    both = reference.select(F.col(column).alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).unionByName(current.select(F.col(column).alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    by = both.where("v is not null").groupBy("v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    total = by.agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))
    cum = running_sums(by, "v", {"cr": "r", "cc": "c"}).crossJoin(F.broadcast(total))  # one row of totals
    return cum.agg(F.max(F.abs(F.col("cr") / F.col("tr") - F.col("cc") / F.col("tc"))).alias("statistic"))


def fpr_at_recall(df: DataFrame, label: str, score: str, target: float) -> DataFrame:
    pts = roc_points(df, label, score)
    total = df.agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    kept = pts.crossJoin(F.broadcast(total)).where(F.col("tp") / F.col("p") >= target)  # one row of totals
    return kept.agg(F.min(F.col("fp") / F.col("n")).alias("fpr"), F.max("score").alias("threshold"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    pts = roc_points(df, label, score)
    return pts.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos")).alias("average_precision"))


def per_class(df: DataFrame, truth: str, predicted: str, least: int = 100) -> DataFrame:
    """label, support, recall, precision, f1 of each true label, and whether its support is below ``least``."""
    hit = F.col(truth).eqNullSafe(F.col(predicted)).cast("long")
    none = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    sides = F.array(F.struct(F.col(truth).alias("label"), one.alias("s"), hit.alias("h"), none.alias("q")), F.struct(F.col(predicted).alias("label"), none.alias("s"), none.alias("h"), one.alias("q")))
    by = df.select(F.explode(sides).alias("x")).select("x.*").groupBy("label").agg(F.sum("s").alias("support"), F.sum("h").alias("h"), F.sum("q").alias("q")).where("support > 0")
    return by.select("label", "support", (F.col("h") / F.col("support")).alias("recall"), F.coalesce(F.try_divide("h", "q"), F.lit(0.0)).alias("precision"), (2 * F.col("h") / (F.col("support") + F.col("q"))).alias("f1"), (F.col("support") < least).alias("below_floor"))


def brier_parts(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty over equal-width bins."""
    by = reliability(df, label, score, bins)
    total = by.agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("observed")) / F.sum("n")).alias("base"))
    part = lambda c: F.sum(F.col("n") / F.col("total") * F.pow(c, F.lit(2)))
    rows = by.crossJoin(F.broadcast(total))  # one row of totals
    return rows.agg(part(F.col("mean_score") - F.col("observed")).alias("reliability"), part(F.col("observed") - F.col("base")).alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))


def rank_normalise(df: DataFrame, reference: DataFrame, score: str) -> DataFrame:
    """score, n, percentile: for each distinct score of ``df`` the share of the reference strictly below it."""
    side = lambda d, r: d.where(F.col(score).isNotNull()).select(F.col(score).alias("score"), F.lit(r).cast("long").alias("r"), F.lit(1 - r).cast("long").alias("n"))
    by = side(reference, 1).unionByName(side(df, 0)).groupBy("score").agg(F.sum("r").alias("r"), F.sum("n").alias("n"))
    total = by.agg(F.sum("r").alias("_all"))
    cum = running_sums(by, "score", {"_upto": "r"}).crossJoin(F.broadcast(total))  # one row of totals
    return cum.where("n > 0").select("score", "n", F.try_divide(F.col("_upto") - F.col("r"), F.col("_all")).alias("percentile"))


def jensen_shannon(df: DataFrame, side: str, column: str, bins: int = 20) -> DataFrame:
    """Distance, base 2, of a column between rows with ``side`` 0 and 1, in equal-width bins over the range of both."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.col(side).alias("s"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)), F.lit(0)).cast("int")
    by = rows.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count_if(F.col("s") == 0).alias("e"), F.count_if(F.col("s") == 1).alias("a"))  # one row of ends
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(by, "bin", "left").fillna(0)
    total = every.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    kept = every.crossJoin(F.broadcast(total)).select(F.greatest(F.col("e") / F.col("te"), F.lit(1e-6)).alias("e"), F.greatest(F.col("a") / F.col("ta"), F.lit(1e-6)).alias("a"))
    again = kept.agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    e, a = F.col("e") / F.col("te"), F.col("a") / F.col("ta")
    half = lambda x: F.sum(x * F.log2(2 * x / (e + a)))
    return kept.crossJoin(F.broadcast(again)).agg(F.sqrt(F.greatest((half(e) + half(a)) / 2, F.lit(0.0))).alias("distance"))  # a row a bin


def benjamini_hochberg(df: DataFrame, p: str, name: str, alpha: float = 0.05) -> DataFrame:
    """Add ``rejected``: step-up over all p values, however many; ties need no order, as the largest passing value decides."""
    by = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    total = by.agg(F.sum("_n").alias("_all"))
    cut = running_sums(by, "_p", {"_i": "_n"}).crossJoin(F.broadcast(total)).where(F.col("_p") <= alpha * F.col("_i") / F.col("_all")).agg(F.max("_p").alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).select(name, p, F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False)).alias("rejected"))  # one row


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Both ends of the interval of a share."""
    mid, wide = (k + z * z / 2) / (n + z * z), z / (n + z * z) * F.sqrt(k * (n - k) / n + z * z / 4)
    return mid - wide, mid + wide


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Agreement, Cohen's kappa and Yule's Q of two flags."""
    n = lambda c, name: F.count_if(c).cast("double").alias(name)
    t = df.agg(n(a & b, "both"), n(a & ~b, "only_a"), n(~a & b, "only_b"), n(~a & ~b, "neither"))
    both, xa, xb, none = (F.col(c) for c in ("both", "only_a", "only_b", "neither"))
    every = both + xa + xb + none
    same, chance = (both + none) / every, ((both + xa) * (both + xb) + (none + xa) * (none + xb)) / every / every
    return t.select(same.alias("agreement"), F.try_divide(same - chance, 1 - chance).alias("kappa"), F.try_divide(both * none - xa * xb, both * none + xa * xb).alias("yules_q"))


def cheapest_threshold(df: DataFrame, label: str, score: str, miss: float, alarm: float) -> DataFrame:
    """Threshold of the least total cost, the highest one of ties, and the cost."""
    total = df.agg(F.sum(label).alias("p"))
    cost = (F.col("p") - F.col("tp")) * miss + F.col("fp") * alarm
    rows = roc_points(df, label, score).crossJoin(F.broadcast(total)).select("score", cost.alias("cost"))  # one row of totals
    return rows.agg(F.min(F.struct("cost", (-F.col("score")).alias("s"))).alias("x")).select((-F.col("x.s")).alias("threshold"), F.col("x.cost").alias("cost"))


def order_statistics(df: DataFrame, column: str, places) -> list[float | None]:
    """The values at ``places(n)`` (from 0 to n - 1, interpolated linearly) of a column's n values in order; none for no values.

    Values are counted before they are ordered. Up to FEW different ones are put in order by the driver; of more, only those around a place reach it.
    """
    by = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    few = by.limit(FEW + 1).collect()
    total = (sum(r["n"] for r in few) if len(few) <= FEW else by.agg(F.sum("n")).first()[0]) or 0
    if not total:
        return [None] * len(places(1))
    at = places(total)
    if len(few) <= FEW:
        few.sort(key=lambda r: (r["v"] != r["v"], r["v"]))  # NaN last
        values, upto = [r["v"] for r in few], list(accumulate(r["n"] for r in few))
        value = lambda k: values[bisect_right(upto, min(k, total - 1))]
        return [value(int(p)) + ((p - int(p)) * (value(int(p) + 1) - value(int(p))) if p > int(p) else 0.0) for p in at]
    wanted = sorted({min(int(p) + k, total - 1) for p in at for k in (0, 1)})
    covers = F.exists(F.lit(wanted), lambda k: (k >= F.col("upto") - F.col("n")) & (k < F.col("upto")))
    rows = sorted((r["upto"], r["v"]) for r in running_sums(by, "v", {"upto": "n"}).where(covers).select("upto", "v").collect())  # two for each place at most
    value = lambda k: next(v for upto, v in rows if k < upto)
    return [value(int(p)) + ((p - int(p)) * (value(int(p) + 1) - value(int(p))) if p > int(p) else 0.0) for p in at]


def quantiles(df: DataFrame, columns: list[str], at: list[float]) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of each column: a few numbers."""
    return {c: order_statistics(df, c, lambda n: [(n - 1) * q for q in at]) for c in columns}


def frozen_edges(reference: DataFrame, columns: list[str], bins: int = 10) -> dict[str, list[float]]:
    """Each column's inner quantiles, every value once; empty for a reference without values."""
    found = quantiles(reference, columns, [i / bins for i in range(1, bins)])
    return {c: sorted({x for x in v if x is not None}) for c, v in found.items()}


def psi_of(reference: DataFrame, current: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """feature, psi over frozen edges, open at both ends; null where a side has no values."""
    def bins(df: DataFrame, name: str) -> DataFrame:
        bin_of = lambda c, e: F.size(F.filter(F.lit(e) if e else F.array().cast("array<double>"), lambda x: x <= F.col(c)))
        every = F.array(*[F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), bin_of(c, e)).alias("bin")) for c, e in edges.items()])
        return df.select(F.explode(every).alias("x")).select("x.*").where("bin is not null").groupBy("feature", "bin").agg(F.count("*").alias(name))

    spark = reference.sparkSession
    grid = spark.createDataFrame([(c, b) for c, e in edges.items() for b in range(len(e) + 1)], "feature string, bin int")
    rows = grid.join(bins(reference, "e"), ["feature", "bin"], "left").join(bins(current, "a"), ["feature", "bin"], "left").fillna(0)  # a row for each feature and bin
    totals = rows.groupBy("feature").agg(F.sum("e").alias("te"), F.sum("a").alias("ta"))
    share = lambda c, t: F.greatest(F.try_divide(F.col(c), F.col(t)), F.lit(1e-6))
    e, a = share("e", "te"), share("a", "ta")
    known = rows.join(F.broadcast(totals), "feature")
    return known.groupBy("feature").agg(F.when(F.min(F.least("te", "ta")) > 0, F.sum((a - e) * F.log(a / e))).alias("psi"))


def psi_verdict(psi: Column) -> Column:
    return F.when(psi < 0.1, "stable").when(psi < 0.25, "moderate").when(psi.isNotNull(), "significant")
