"""Experiments that fit anew: what single columns tell, what nonsense teaches, and families that training never saw."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillway.models import detector
from spillway.operators import intervals, metrics
from spillway.operators.blocks import saved
from spillway.operators.ordered import positions

#: AUC from which one column alone is suspect.
SUSPECT = 0.9
LEAST_ROWS = 10


def _tree_scores(train: DataFrame, test: DataFrame, label: str, columns: list[str], depth: int) -> DataFrame:
    """``test``'s labels as ``y`` with ``p`` of a small tree; missing values are 0."""
    laid = lambda df: VectorAssembler(inputCols=columns, outputCol="_in").transform(detector.finite(df, columns).fillna(0.0, columns).select(F.col(label).cast("double").alias("y"), *columns))
    tree = DecisionTreeClassifier(featuresCol="_in", labelCol="y", maxDepth=depth, seed=7).fit(laid(train))
    return tree.transform(laid(test)).select(F.col("y").cast("int").alias("y"), vector_to_array("probability")[1].alias("p"))


def _either_way(auc: float | None) -> float:
    return 0.5 if auc is None or auc != auc else max(auc, 1 - auc)


def solo_auc(train: DataFrame, test: DataFrame, label: str, column: str, categorical: bool = False) -> float:
    """How well one column orders the rows of ``test``, 0.5 or more.

    A number is scored by a tree of three levels, which sees bands as well as
    slopes; a category by its share of label 1 in ``train``, unknown ones by the
    share of all. A column with under ten numbers, or one label, tells nothing.
    """
    if categorical:
        prior = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
        rates = train.groupBy(F.col(column).alias("_v")).agg(F.avg(F.col(label).cast("double")).alias("_rate"))
        found = test.join(rates, F.col(column).eqNullSafe(F.col("_v")), "left").select(F.col(label).cast("int").alias("y"), F.coalesce("_rate", F.lit(prior or 0.0)).alias("p"))
        return _either_way(metrics.auc(found, "y", "p").first()["roc_auc"])
    known = detector.finite(train, [column]).where(F.col(column).isNotNull())
    n, labels = known.agg(F.count("*"), F.count_distinct(label)).first()
    if n < LEAST_ROWS or labels < 2:
        return 0.5
    return _either_way(metrics.auc(saved(_tree_scores(known, test, label, [column], 3)), "y", "p").first()["roc_auc"])


def solo_aucs(train: DataFrame, test: DataFrame, label: str, numeric: list[str], categorical: list[str] = []) -> list[tuple[str, float]]:  # noqa: B006 - never changed
    """(column, AUC) of each column, the most telling first; ties by name."""
    found = [(c, solo_auc(train, test, label, c)) for c in numeric] + [(c, solo_auc(train, test, label, c, True)) for c in categorical]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def relabelled(df: DataFrame, label: str, row: str, salt: str = "nonsense") -> DataFrame:
    """``df`` with the labels dealt anew: those of the rows in another hashed order."""
    at = lambda name, out: positions(df.select(F.col(row).alias("_id"), label, (F.xxhash64(F.lit(name), F.col(row)) / 2.0**63).alias("_h")), "_h", out)
    mine, other = at(salt, "_at").select("_id", "_at"), at(f"{salt} too", "_at").select("_at", F.col(label).alias("_label"))
    return df.join(mine, F.col(row) == F.col("_id")).join(other, "_at").withColumn(label, F.col("_label")).select(*df.columns)


def negative_controls(df: DataFrame, label: str, row: str, numeric: list[str], folds: int = 3) -> dict[str, float]:
    """AUCs that should be one half: of labels that were dealt anew, and of the row's number alone; and how often the commoner label is right.

    Each row is scored by a tree of six levels that was fitted on the other folds.
    """
    out = {}
    place = positions(df.select(F.col(row).alias("_id"), F.col(row).cast("double").alias("_n")), "_n", "_place").select("_id", F.col("_place").cast("double").alias("_place"))
    placed = df.join(place, F.col(row) == F.col("_id")).drop("_id")
    for name, rows, columns in (("shuffled_label_auc", relabelled(df, label, row), numeric), ("index_only_auc", placed, ["_place"])):
        rows = saved(rows.withColumn("_fold", F.least(F.floor(intervals.uniform(F.col(row), F.lit("control")) * folds), F.lit(folds - 1))))
        parts = None
        for k in range(folds):
            part = _tree_scores(rows.where(F.col("_fold") != k), rows.where(F.col("_fold") == k), label, columns, 6)
            parts = part if parts is None else parts.unionByName(part)
        out[name] = _either_way(metrics.auc(saved(parts), "y", "p").first()["roc_auc"])
    share = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return out | {"majority_accuracy": max(share, 1 - share)}


@dataclass
class Audit:
    solo: list[tuple[str, float]]
    leaks: list[str]
    overlap: int
    controls: dict[str, float]
    verdicts: dict[str, str]

    @property
    def candidates(self) -> list[str]:
        """What either test points at, before anyone has judged it."""
        suspects = [c for c, auc in self.solo if auc >= SUSPECT]
        return suspects + [c for c in dict.fromkeys(self.leaks) if c not in suspects]

    def verdict(self, column: str) -> str:
        return self.verdicts.get(column, "unresolved")

    @property
    def quarantined(self) -> list[str]:
        """Columns judged to be artifacts; what is unresolved stays."""
        return sorted(c for c, v in self.verdicts.items() if v == "artifact")

    @property
    def unjudged(self) -> list[str]:
        return [c for c in self.candidates if self.verdict(c) == "unresolved"]


def audit(train: DataFrame, test: DataFrame, label: str, row: str, numeric: list[str], categorical: list[str] = [], verdicts: dict[str, str] = {}) -> Audit:  # noqa: B006
    """Single columns, single values, rows of ``test`` that ``train`` has too, and controls; ``verdicts`` are people's."""
    leaks = [r["feature"] for r in metrics.leaky_values(train, label, [*numeric, *categorical]).select("feature").distinct().orderBy("feature").collect()]  # a row for each column
    columns = [*numeric, *categorical]
    seen = train.select(F.xxhash64(*columns).alias("h"), *columns).distinct()
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in columns]
    both = test.select(F.xxhash64(*columns).alias("h"), *columns).alias("a").join(seen.alias("b"), [F.col("a.h") == F.col("b.h"), *same], "left_semi").count()
    return Audit(solo_aucs(train, test, label, numeric, categorical), leaks, both, negative_controls(train, label, row, numeric), dict(verdicts))


def without(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` without the columns; one that is not there is an error."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    return df.drop(*columns)


def leave_one_family_out(train: DataFrame, test: DataFrame, label: str, family: str, row: str, numeric: list[str], categorical: list[str] = [], families: list[str] | None = None, budget: float = 0.01, kind: str = "forest", ensemble: bool = False) -> list[dict]:  # noqa: B006
    """For each family: a detector that never saw it, and what it finds of it, with the classifier alone and with both heads at the same share of benign alarms.

    ``attribution`` is how often it is given its name, which no detector that
    never saw it can do; ``novel`` how often the novelty head alone fires.
    """
    names = families or sorted(r[0] for r in train.where(F.col(label) == 1).select(family).distinct().collect() if r[0] is not None)
    dealt = saved(train.withColumn("_held", intervals.uniform(F.col(row), F.lit("reference")) < 0.15))
    out = []
    for name in names:
        kept = dealt.where(~F.coalesce(F.col(family) == name, F.lit(False)))
        made = detector.Detector.fit(kept.where("NOT _held").drop("_held"), label, row, numeric, categorical, kind, budget, family=family, ensemble=ensemble)
        reference = kept.where("_held").drop("_held")
        made = made.rethresholded(reference, label, budget)
        alone = detector.benign_threshold(made.scores(reference.where(F.col(label) == 0)), "p_attack", budget)
        scored = saved(made.score(test).withColumn("_alone", F.col("p_attack") >= alone))
        own, benign = F.col(family).eqNullSafe(name), F.col(label) == 0
        share = lambda what, of: F.avg(F.when(of, what.cast("double")))
        fired = F.col("fired") > 0
        r = scored.agg(F.count_if(own).alias("n"), share(F.col("_alone"), own).alias("alone"), share(fired, own).alias("both"), share(F.col("family_name") == name, own).alias("named"), share(F.col("fired") == 2, own).alias("novel"), share(F.col("_alone"), benign).alias("fpr_alone"), share(fired, benign).alias("fpr_both")).first()
        removed = dealt.where(F.col(family) == name).count()
        out.append({"family": name, "removed": removed, "rows": r["n"], "recall_classifier": r["alone"], "recall_both": r["both"], "delta": r["both"] - r["alone"] if r["n"] else None, "attribution": r["named"], "novel": r["novel"], "fpr_classifier": r["fpr_alone"], "fpr_both": r["fpr_both"]})
    return out
