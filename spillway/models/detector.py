"""A detector of two heads: a classifier that knows attacks and a novelty score that knows benign rows.

Both are fitted by Spark; what is kept of them is small (trees, a mean and a
matrix, thresholds), and scoring is column expressions or Spark ML.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillway.functions import fields, scoring
from spillway.operators import intervals, metrics, splits
from spillway.operators.blocks import saved

KINDS = {"logistic": lambda: LogisticRegression(maxIter=50), "forest": lambda: RandomForestClassifier(numTrees=40, maxDepth=8, seed=7), "boosted": lambda: GBTClassifier(maxIter=20, maxDepth=5, seed=7)}
RARE = "__rare__"


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers that aren't finite become null."""
    return df.withColumns({c: scoring.finite_or_null(F.col(c).cast("double")) for c in columns})


def kept_levels(df: DataFrame, column: str, most: int = 16, least_share: float = 0.001) -> list[str]:
    """The commonest levels, those of at least a share of the rows; ties by name."""
    n = df.count()
    by = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).count().where(F.col("count") >= least_share * n)
    return [r["v"] for r in by.orderBy(F.desc("count"), "v").limit(most).collect()]  # at most `most` rows


@dataclass
class Preprocessor:
    """Sanitise, impute by medians, scale, and one-hot with a bucket for rare and unknown levels."""

    numeric: list[str]
    categorical: dict[str, list[str]]
    model: PipelineModel
    _filled: dict[str, float] | None = None

    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str], categorical: list[str] = [], robust: bool = False) -> Preprocessor:  # noqa: B006 - never changed
        levels = {c: kept_levels(df, c) for c in categorical}
        filled = [f"{c}_filled" for c in numeric]
        stages = [Imputer(inputCols=numeric, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="numbers")]
        scaler = RobustScaler(relativeError=0.0001, withCentering=True) if robust else StandardScaler(withMean=True)
        stages.append(scaler.setInputCol("numbers").setOutputCol("scaled"))
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categorical]
        stages += [OneHotEncoder(inputCols=[f"{c}_index" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], dropLast=False)] if categorical else []
        stages.append(VectorAssembler(inputCols=["scaled", *[f"{c}_hot" for c in categorical]], outputCol="features"))
        made = cls(numeric, levels, None)
        made.model = Pipeline(stages=stages).fit(made._known(df))
        return made

    def _known(self, df: DataFrame) -> DataFrame:
        df = finite(df, self.numeric)
        return df.withColumns({c: F.when(F.col(c).cast("string").isin(v), F.col(c).cast("string")).otherwise(RARE) for c, v in self.categorical.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        """``df``, its columns as they were, with ``features``; a needed column that is missing is an error."""
        missing = [c for c in [*self.numeric, *self.categorical] if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
        known = self._known(df.select(kept, *[F.col(f"`{c}`") for c in [*self.numeric, *self.categorical]]))
        kinds = self.model.transform(known).schema["features"].metadata  # which features are indicators; nothing is run
        columns = self._columns()
        out = VectorAssembler(inputCols=[f"_{k}" for k in range(len(columns))], outputCol="features").transform(known.select("_row", *[c.alias(f"_{k}") for k, c in enumerate(columns)]))
        return out.select("_row.*", F.col("features").alias("features", metadata=kinds))

    def _columns(self) -> list[Column]:
        """The features as ``model`` makes them, each a column, so that rows go into one vector and no further ones on the way."""
        imputer, _, scaler, *rest = self.model.stages
        if self._filled is None:
            self._filled = imputer.surrogateDF.first().asDict()
        middle, spread = (scaler.median, scaler.range) if hasattr(scaler, "median") else (scaler.mean, scaler.std)
        scaled = [(F.coalesce(F.col(c), F.lit(self._filled[c])) - float(m)) * (1 / float(w) if w else 0.0) for c, m, w in zip(self.numeric, middle, spread, strict=True)]
        labels = [stage.labels for stage in rest if hasattr(stage, "labels")]
        return scaled + [x.cast("double") for c, known in zip(self.categorical, labels, strict=True) for x in (*(F.col(c) == v for v in known), ~F.col(c).isin(known))]


def fit_head(df: DataFrame, label: str, kind: str = "forest", weighted: bool = True):
    """A classifier over ``features``; classes weigh alike or, if not ``weighted``, rows do."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row for each class
    if set(counts) != {0, 1}:
        raise ValueError(f"labels must be 0 and 1, both present: {sorted(counts)}")
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0])) if weighted else F.lit(1.0)
    return KINDS[kind]().setFeaturesCol("features").setLabelCol("_label").setWeightCol("_weight").fit(df.withColumn("_label", F.col(label).cast("double")).withColumn("_weight", weight))


def attack_probability(model, df: DataFrame, out: str) -> DataFrame:
    """``df`` with the probability of class 1; nothing else is made of ``features``."""
    alone = model.copy().setRawPredictionCol("").setPredictionCol("")
    return alone.transform(df).withColumn(out, fields.attack_score(vector_to_array("probability"), 0)).drop("probability")


@dataclass
class Mahalanobis:
    """Squared distance from the benign mean under a covariance that is shrunk towards its own mean variance."""

    columns: list[str]
    mean: list[float]
    precision: list[list[float]]

    @classmethod
    def fit(cls, benign: DataFrame, columns: list[str], shrink: float = 0.1) -> Mahalanobis:
        k = range(len(columns))
        x = finite(benign, columns)
        found = x.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in k for j in k if i <= j]).first()
        cov = np.array([[found[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in k] for i in k])
        cov = (1 - shrink) * cov + shrink * np.trace(cov) / len(columns) * np.eye(len(columns)) + 1e-12 * np.eye(len(columns))
        return cls(columns, [found[f"m{i}"] or 0.0 for i in k], np.linalg.inv(cov).tolist())

    def score(self) -> Column:
        """Missing values count as the mean."""
        off = [F.coalesce(scoring.finite_or_null(F.col(c).cast("double")), F.lit(m)) - m for c, m in zip(self.columns, self.mean, strict=True)]
        return sum((off[i] * off[j] * p for i, row in enumerate(self.precision) for j, p in enumerate(row)), F.lit(0.0))


    def refitted(self, benign: DataFrame) -> Mahalanobis:
        return Mahalanobis.fit(benign, self.columns)


def fit_families(attacks: DataFrame, family: str) -> PipelineModel:
    """A classifier over ``features`` that names the family of an attack; rows without a name teach nothing. Names keep their order by themselves."""
    named = attacks.where(F.col(family).isNotNull()).withColumn("_family", F.col(family).cast("string")).select("_family", "features")
    index = StringIndexer(inputCol="_family", outputCol="_index", stringOrderType="alphabetAsc").fit(named)
    head = RandomForestClassifier(featuresCol="features", labelCol="_index", predictionCol="_family_at", probabilityCol="_family_p", rawPredictionCol="_family_raw", numTrees=40, maxDepth=8, seed=7).fit(index.transform(named))
    return PipelineModel(stages=[head, IndexToString(inputCol="_family_at", outputCol="family_name", labels=index.labels)])


def benign_threshold(reference: DataFrame, score: str, budget: float) -> float:
    """The linearly interpolated quantile at 1 - budget; just above it if ties there would spend too much."""
    at = metrics.quantiles(reference, [score], [1 - budget])[score][0]
    if at is None:
        raise ValueError("no benign rows to take a threshold from")
    n, over = reference.agg(F.count(score), F.count_if(F.col(score) >= at)).first()
    return math.nextafter(at, math.inf) if over / n > budget + 1 / n else at


@dataclass
class Detector:
    """Heads, thresholds on held-out benign rows, and conformal cuts by class; ``novelty`` is a Mahalanobis distance or an ensemble of three scores."""

    before: Preprocessor
    head: object
    novelty: object
    p_at: float
    novelty_at: float
    cuts: tuple[float, float]
    families: PipelineModel | None = None

    @classmethod
    def fit(cls, df: DataFrame, label: str, row: str, numeric: list[str], categorical: list[str] = [], kind: str = "forest", budget: float = 0.01, alpha: float = 0.1, held: float = 0.3, family: str | None = None, ensemble: bool = False) -> Detector:  # noqa: B006
        """Fit on a stratified share of ``df`` (rows told apart by ``row``), thresholds on the rest; with ``family``, a column, attacks are named too."""
        df = df.select(*dict.fromkeys([label, row, *numeric, *categorical, *([family] if family else [])]))
        dealt = saved(splits.first_of_each(df, label, intervals.uniform(F.col(row), F.lit("fit")), row, F.bround(F.col("n") * held), "_held"))
        train, rest = dealt.where("not _held").drop("_held"), dealt.where("_held").drop("_held")
        before = Preprocessor.fit(train, numeric, categorical)
        head = fit_head(saved(before.transform(train).select(label, "features")), label, kind)
        benign = train.where(F.col(label) == 0)
        if ensemble:
            from spillway.models.novelty import Ensemble

            novelty = Ensemble.fit(benign, numeric, row).calibrated_on(rest.where(F.col(label) == 0))
        else:
            novelty = Mahalanobis.fit(benign, numeric)
        families = fit_families(before.transform(train.where(F.col(label) == 1)), family) if family else None
        made = cls(before, head, novelty, 1.0, math.inf, (1.0, 1.0), families)
        return made.rethresholded(rest, label, budget, alpha)

    def scores(self, df: DataFrame) -> DataFrame:
        """``df`` with p_attack, novelty and, of a detector that names families, ``family_name``; an ensemble adds its scores and their agreement."""
        scored = attack_probability(self.head, self.before.transform(df), "p_attack")
        if self.families:
            scored = self.families.transform(scored).drop("_family_at", "_family_p", "_family_raw")
        scored = scored.drop("features")
        return scored.withColumn("novelty", self.novelty.score()) if isinstance(self.novelty, Mahalanobis) else self.novelty.score(scored)

    def rethresholded(self, recent: DataFrame, label: str, budget: float = 0.01, alpha: float = 0.1) -> Detector:
        """The same heads with thresholds and cuts from other labelled rows; two heads share the budget."""
        miss = F.when(F.col(label) == 1, 1 - F.col("p_attack")).otherwise(F.col("p_attack")).alias("_miss")
        scored = saved(self.scores(recent).select(label, "p_attack", "novelty", miss))
        benign, each = scored.where(F.col(label) == 0), fields.head_budget(budget, 2)
        cuts = tuple(conformal_cut(scored.where(F.col(label) == k), "_miss", alpha) for k in (0, 1))
        return replace(self, p_at=benign_threshold(benign, "p_attack", each), novelty_at=benign_threshold(benign, "novelty", each), cuts=cuts)

    def rebaselined(self, recent_benign: DataFrame, budget: float = 0.01) -> Detector:
        """Novelty and its threshold learnt anew from benign rows of another place; the classifier stays."""
        made = replace(self, novelty=self.novelty.refitted(recent_benign))
        scored = saved(made.scores(recent_benign).select("p_attack", "novelty"))
        each = fields.head_budget(budget, 2)
        return replace(made, p_at=benign_threshold(scored, "p_attack", each), novelty_at=benign_threshold(scored, "novelty", each))

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with p_attack, novelty, fired (0 none, 1 classifier, 2 novelty, 3 both), conformal_set and abstains."""
        scored = self.scores(df)
        members = fields.set_names(F.col("p_attack") <= self.cuts[0], 1 - F.col("p_attack") <= self.cuts[1])
        return scored.withColumn("fired", scoring.fired(F.col("p_attack"), F.col("novelty"), self.p_at, self.novelty_at)).withColumn("conformal_set", members).withColumn("abstains", F.size("conformal_set") != 1)


def conformal_cut(scored: DataFrame, miss: str, alpha: float) -> float:
    """The ceil((n + 1)(1 - alpha))-th smallest of a class's misses, 1 for an empty class or one too small."""
    n = scored.count()
    k = math.ceil((n + 1) * (1 - alpha))
    return 1.0 if n == 0 or k > n else metrics.order_statistics(scored, miss, lambda _: [k - 1])[0]


def calibrate(scored: DataFrame, label: str, score: str = "p_attack"):
    """Platt scaling: (slope, offset) of the log-odds of a held-out score."""
    rows = VectorAssembler(inputCols=["_odds"], outputCol="features").transform(scored.select(F.col(label).cast("double").alias("label"), log_odds(F.col(score)).alias("_odds")))
    model = LogisticRegression(maxIter=100).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def calibrated(p: Column, slope: float, offset: float) -> Column:
    return 1 / (1 + F.exp(-(log_odds(p) * slope + offset)))


def permutation_importance(detector: Detector, df: DataFrame, label: str, row: str, columns: list[str]) -> dict[str, float]:
    """How much AUC falls when a column's values are dealt anew by a shift along a hashed order."""
    auc = lambda d: metrics.auc(detector.scores(d), label, "p_attack").first()["roc_auc"]
    whole, out = auc(df), {}
    n = df.count()
    from spillway.operators.ordered import positions

    for c in columns:
        order = positions(df.select("*", (F.xxhash64(F.lit(c), F.col(row)) / 2.0**63).alias("_h")), "_h", "_at")
        other = order.select((F.col("_at") % n + 1).alias("_at"), F.col(c).alias("_other"))
        out[c] = whole - auc(order.join(other, "_at").withColumn(c, F.col("_other")).select(*df.columns))
    return out


def isotonic(scored: DataFrame, label: str, score: str = "p_attack"):
    """A rising step function from a held-out score to the share of label 1, between whose steps is interpolated.

    Scores are counted first, so that neighbours are pooled over distinct scores
    with their rows as weights; a null score or label teaches nothing.
    """
    by = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("features")).agg(F.avg(F.col(label).cast("double")).alias("label"), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(weightCol="weight").fit(by)


def isotonic_calibrated(model, df: DataFrame, score: str = "p_attack", out: str = "calibrated") -> DataFrame:
    """``df`` with ``out``; beyond the scores that were learnt from it stays what it is at their ends."""
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    made = model.setFeaturesCol("_score").setPredictionCol("_calibrated").transform(df.select(kept, F.col(score).cast("double").alias("_score")))
    return made.select("_row.*", F.col("_calibrated").alias(out))


def compared_calibrations(held: DataFrame, test: DataFrame, label: str, score: str = "p_attack", bins: int = 10) -> DataFrame:
    """(method, brier, ece, mce) on ``test`` (no nulls) of the score itself and of both calibrations learnt from ``held``."""
    held = held.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    model, (slope, offset) = isotonic(held, label, score), calibrate(held, label, score)
    made = isotonic_calibrated(model, test.withColumn("_platt", calibrated(F.col(score), slope, offset)), score, "_isotonic")
    every = F.explode(F.array(*[F.struct(F.lit(name).alias("method"), F.col(c).alias("p")) for name, c in (("uncalibrated", score), ("isotonic", "_isotonic"), ("sigmoid", "_platt"))]))
    rows = made.select(F.col(label).cast("double").alias("y"), every.alias("m")).select("y", "m.*").withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    cells = rows.groupBy("method", "bin").agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"), F.sum((F.col("p") - F.col("y")) ** 2).alias("squares"))
    return cells.groupBy("method").agg((F.sum("squares") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def coerce(df: DataFrame, numeric: list[str], categorical: list[str] = []) -> DataFrame:  # noqa: B006
    """``df``'s needed columns as a detector takes them: numbers (null where they can't be read), texts in lower case without blanks around them; names may have other case and blanks.

    A column that is missing, or there twice, is an error; others are left out.
    """
    found: dict[str, list[str]] = {}
    for c in df.columns:
        found.setdefault(c.strip().lower(), []).append(c)
    wanted = [*numeric, *categorical]
    if bad := [c for c in wanted if len(found.get(c.strip().lower(), [])) != 1]:
        raise ValueError(f"columns missing or there twice: {bad}")
    own = lambda c: F.col(f"`{found[c.strip().lower()][0]}`")
    numbers = [scoring.finite_or_null(own(c).cast("string").try_cast("double")).alias(c) for c in numeric]
    return df.select(*numbers, *[F.lower(F.trim(F.regexp_replace(own(c).cast("string"), r"^\s+|\s+$", ""))).alias(c) for c in categorical])


def ranked_importances(made: Detector, top: int = 10) -> list[tuple[str, float]]:
    """The features that the classifier head leans on most: a tree model's shares, a linear one's absolute weights; indicators by column and level, ties by name."""
    names = list(made.before.numeric)
    for stage in made.before.model.stages:
        if hasattr(stage, "labels"):
            names += [f"{stage.getInputCol()}={v}" for v in stage.labels] + [f"{stage.getInputCol()}=?"]
    weights = made.head.featureImportances.toArray() if hasattr(made.head, "featureImportances") else np.abs(made.head.coefficients.toArray())
    return sorted(zip(names, weights.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:top]
