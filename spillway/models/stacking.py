"""Three trees and three support vector machines whose out-of-fold scores teach one combiner."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spillway.operators import intervals, metrics, splits
from spillway.operators.blocks import saved

ARMS, COMBINERS = ("P0", "P1", "P2", "P3a", "P3b"), ("stack", "soft", "hard")
TREES, MACHINES = ("T1", "T2", "T3"), ("S1", "S2", "S3")
MEMBERS = TREES + MACHINES
VARIANCE, SEED = 0.95, 7


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


class SignedLog(Transformer):
    """``features`` with the signed logarithm of each number."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(F.transform(vector_to_array("features"), signed_log)))


class Renamed(Transformer):
    def __init__(self, old: str, new: str):
        super().__init__()
        self.old, self.new = old, new

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(self.new).withColumnRenamed(self.old, self.new)


def _stage(df: DataFrame, stages: list, estimator) -> DataFrame:
    """Fit on ``df``, add what was fitted to ``stages``, and give ``df`` through it, the output as ``features``."""
    model = estimator.setInputCol("features").setOutputCol("_out").fit(df)
    stages += [model, Renamed("_out", "features")]
    return stages[-1].transform(model.transform(df))


def fit_arm(df: DataFrame, arm: str, size: int, kept: int | None = None) -> PipelineModel:
    """What an arm does to ``features`` of ``size`` numbers: P0 nothing; P1 signed logarithm and deviations from the mean; P2 also the directions of 95 % of the variance; P3a these of the raw numbers, then deviations; P3b ``kept`` of them.

    A direction's sign is not fixed by the data and matters to no member.
    """
    if arm not in ARMS:
        raise ValueError(f"{arm!r} is none of {ARMS}")
    stages: list = []
    if arm in ("P1", "P2"):
        stages.append(SignedLog())
        df = _stage(stages[0].transform(df), stages, StandardScaler(withMean=True))
    if arm in ("P2", "P3a", "P3b"):
        if arm == "P3b" and not kept:
            raise ValueError("P3b needs the number of directions")
        share = np.cumsum(PCA(k=size, inputCol="features", outputCol="_out").fit(df).explainedVariance.toArray())
        n = kept if arm == "P3b" else int(np.searchsorted(share, VARIANCE - 1e-12) + 1)
        df = _stage(df, stages, PCA(k=min(n, size)))
    if arm in ("P3a", "P3b"):
        _stage(df, stages, StandardScaler(withMean=True))
    return PipelineModel(stages)


class KernelMap(Transformer):
    """Features whose inner products come near a kernel's values: a row's kernel with landmarks, times the inverse root of the landmarks' own.

    Landmarks are the ``n`` rows first by a hash of ``row``; gamma is 1 over the number of features and the variance of all their values.
    """

    def __init__(self, kernel: str, landmarks: np.ndarray, gamma: float):
        super().__init__()
        self.kernel, self.landmarks, self.gamma = kernel, landmarks, gamma
        values, vectors = np.linalg.eigh(self.of(landmarks, landmarks))
        self.root = (vectors / np.sqrt(np.maximum(values, 1e-12))) @ vectors.T

    @classmethod
    def fit(cls, df: DataFrame, row: str, kernel: str = "rbf", n: int = 1000) -> KernelMap:
        x = df.select(vector_to_array("features").alias("x"), F.xxhash64(F.lit(SEED), F.col(row)).alias("h"))
        sums = x.select(F.size("x").alias("d"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("s"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("q")).agg(F.max("d"), F.sum("s"), F.sum("q"), F.sum("d")).first()
        if not sums[3]:
            raise ValueError("no rows to take landmarks from")
        spread = sums[2] / sums[3] - (sums[1] / sums[3]) ** 2
        first = x.orderBy("h").limit(n).collect()  # n rows
        return cls(kernel, np.array([r["x"] for r in first], float), 1 / (sums[0] * spread) if spread > 0 else 1.0)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kernel == "poly":
            return (self.gamma * (a @ b.T) + 1.0) ** 2
        return np.exp(-self.gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))

    def _transform(self, df: DataFrame) -> DataFrame:
        own = df.sparkSession.sparkContext.broadcast((self.kernel, self.landmarks, self.gamma))
        rest = [c for c in df.columns if c != "features"]
        schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c != "features"), "_mapped array<double>"])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mapped = KernelMap(*own.value)
            for batch in batches:
                x = np.array(batch.column(batch.num_columns - 1).to_pylist(), float).reshape(batch.num_rows, -1)
                z = mapped.of(x, mapped.landmarks) @ mapped.root if len(x) else np.empty((0, len(mapped.root)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*rest, "_mapped"])

        plain = df.select(*[F.col(f"`{c}`") for c in rest], vector_to_array("features").alias("_plain"))
        return plain.mapInArrow(work, schema).withColumn("features", array_to_vector("_mapped")).drop("_mapped")


def fit_member(df: DataFrame, name: str, row: str, landmarks: int, c: float = 1.0) -> PipelineModel:
    """One member on ``features``, ``_label`` and ``_weight`` (both labels weigh alike); it adds ``rawPrediction``."""
    tree = {"labelCol": "_label", "weightCol": "_weight", "seed": SEED}
    if name in TREES:
        made = {
            "T1": lambda: DecisionTreeClassifier(impurity="gini", maxDepth=20, minInstancesPerNode=5, **tree),
            "T2": lambda: RandomForestClassifier(numTrees=1, impurity="entropy", maxDepth=20, featureSubsetStrategy="sqrt", bootstrap=False, **tree),
            "T3": lambda: DecisionTreeClassifier(impurity="gini", maxDepth=12, minInstancesPerNode=20, **tree),
        }
        return PipelineModel([made[name]().fit(df)])
    stages: list = [KernelMap.fit(df, row, {"S2": "rbf", "S3": "poly"}[name], landmarks)] if name != "S1" else []
    for stage in stages:
        df = stage.transform(df)
    machine = LinearSVC(labelCol="_label", weightCol="_weight", maxIter=100, regParam=1 / (c * max(df.count(), 1)))
    return PipelineModel([*stages, machine.fit(df)])


def member_scores(df: DataFrame, arms: dict[str, PipelineModel], members: dict[str, PipelineModel]) -> DataFrame:
    """``df`` with a column for each member: a tree's probability of label 1, a machine's signed margin."""
    out = df
    for name, model in members.items():
        scored = model.transform(arms["tree" if name in TREES else "machine"].transform(out.withColumn("_kept", vector_to_array("features"))))
        value = vector_to_array("probability")[1] if name in TREES else vector_to_array("rawPrediction")[1]
        out = scored.withColumn(name, value).drop("rawPrediction", "probability", "prediction").withColumn("features", array_to_vector("_kept")).drop("_kept")
    return out


@dataclass
class Combiner:
    """From the members' scores to a probability: one regression on all, the mean of one for each, or the share of votes."""

    kind: str
    models: list

    @classmethod
    def fit(cls, scores: DataFrame, label: str, kind: str) -> Combiner:
        if kind not in COMBINERS:
            raise ValueError(f"{kind!r} is none of {COMBINERS}")
        rows = scores.withColumn("_label", F.col(label).cast("double"))
        regression = lambda: LogisticRegression(labelCol="_label", featuresCol="_scaled", maxIter=100)
        inputs = {"stack": [list(MEMBERS)], "soft": [[m] for m in MEMBERS], "hard": []}[kind]
        return cls(kind, [Pipeline(stages=[VectorAssembler(inputCols=own, outputCol="_in"), StandardScaler(inputCol="_in", outputCol="_scaled", withMean=True), regression()]).fit(rows) for own in inputs])

    def score(self, scores: DataFrame, out: str = "p_attack") -> DataFrame:
        if self.kind == "hard":
            votes = [(F.col(m) >= (0.5 if m in TREES else 0.0)).cast("double") for m in MEMBERS]
            return scores.withColumn(out, sum(votes[1:], votes[0]) / len(votes))
        parts = []
        for k, model in enumerate(self.models):
            parts.append(F.col(f"_p{k}"))
            scores = model.transform(scores).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("_in", "_scaled", "rawPrediction", "probability", "prediction")
        return scores.withColumn(out, sum(parts[1:], parts[0]) / len(parts)).drop(*[f"_p{k}" for k in range(len(parts))])


def fold_of(row: str, folds: int, salt: str = "fold") -> Column:
    return F.least(F.floor(intervals.uniform(F.col(row), F.lit(salt)) * folds), F.lit(folds - 1)).cast("int")


def weighed(df: DataFrame, label: str) -> DataFrame:
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row for each label
    if set(counts) != {0, 1}:
        raise ValueError(f"labels must be 0 and 1, both present: {sorted(counts)}")
    total = sum(counts.values())
    return df.withColumn("_label", F.col(label).cast("double")).withColumn("_weight", F.when(F.col(label) == 1, total / (2 * counts[1])).otherwise(total / (2 * counts[0])))


@dataclass
class Stacked:
    """Members fitted on all rows, and a combiner fitted on scores that each row got from members that had not seen it."""

    arms: dict[str, PipelineModel]
    members: dict[str, PipelineModel]
    combiner: Combiner
    out_of_fold: DataFrame

    @staticmethod
    def fit_members(df: DataFrame, label: str, row: str, tree_arm: str, machine_arm: str, landmarks: int, c: float = 1.0) -> tuple[dict, dict]:
        size = len(df.select("features").first()["features"])
        rows = saved(weighed(df, label).select(row, "features", "_label", "_weight"))
        arms = {"tree": fit_arm(rows, tree_arm, size), "machine": fit_arm(rows, machine_arm, size)}
        laid = {k: saved(a.transform(rows)) for k, a in arms.items()}
        return arms, {m: fit_member(laid["tree" if m in TREES else "machine"], m, row, landmarks, c) for m in MEMBERS}

    @classmethod
    def fit(cls, df: DataFrame, label: str, row: str, tree_arm: str = "P0", machine_arm: str = "P1", combiner: str = "stack", landmarks: int = 1000, folds: int = 5) -> Stacked:
        """``df`` has ``features`` (a vector); ``row``, a distinct number, decides its fold."""
        rows, parts = saved(df.select(row, label, "features").withColumn("_fold", fold_of(row, folds))), None
        for k in range(folds):
            arms, members = cls.fit_members(rows.where(F.col("_fold") != k), label, row, tree_arm, machine_arm, landmarks)
            part = member_scores(rows.where(F.col("_fold") == k), arms, members).select(row, label, "_fold", *MEMBERS)
            parts = part if parts is None else parts.unionByName(part)
        scores = saved(parts)
        arms, members = cls.fit_members(rows, label, row, tree_arm, machine_arm, landmarks)
        return cls(arms, members, Combiner.fit(scores, label, combiner), scores)

    def score(self, df: DataFrame, out: str = "p_attack") -> DataFrame:
        """``df`` with the members' scores and ``out``."""
        return self.combiner.score(member_scores(df, self.arms, self.members), out)


def chosen(scores: dict[str, DataFrame], label: str, row: str, fpr: float = 0.01, folds: int = 5) -> list[dict]:
    """For each arm (its name: held-out rows with the members' scores) and combiner, recall at ``fpr`` and AUC, best first; hard votes are listed last, as they have no threshold near a small share.

    A combiner scores held-out rows from the other folds of these.
    """
    out = []
    for arm, rows in scores.items():
        rows = saved(rows.select(row, label, *MEMBERS).withColumn("_fold", fold_of(row, folds, "held")))
        for kind in COMBINERS:
            if kind == "hard":
                found = Combiner.fit(rows, label, kind).score(rows)
            else:
                found = None
                for k in range(folds):
                    part = Combiner.fit(rows.where(F.col("_fold") != k), label, kind).score(rows.where(F.col("_fold") == k))
                    found = part if found is None else found.unionByName(part)
            found = saved(found.select(label, "p_attack"))
            out.append({"arm": arm, "combiner": kind, "recall": metrics.recall_at_fpr(found, label, "p_attack", fpr).first()["recall"] or 0.0, "roc_auc": metrics.auc(found, label, "p_attack").first()["roc_auc"]})
    return sorted(out, key=lambda r: (r["combiner"] == "hard", -r["recall"], -r["roc_auc"], r["arm"], r["combiner"]))


def three_way(df: DataFrame, group: str, row: str, calibration: float = 0.15, held: float = 0.2) -> DataFrame:
    """Add ``part``: S for the calibration share of each group, H for a share of the rest, F for what is fitted on."""
    rest = splits.first_of_each(df, group, intervals.uniform(F.col(row), F.lit("S")), row, F.bround(F.col("n") * calibration), "_s")
    other = splits.first_of_each(rest.where("NOT _s"), group, intervals.uniform(F.col(row), F.lit("H")), row, F.bround(F.col("n") * held), "_h")
    return rest.where("_s").withColumn("part", F.lit("S")).drop("_s").unionByName(other.withColumn("part", F.when(F.col("_h"), "H").otherwise("F")).drop("_s", "_h"))


def weights_of(units: np.ndarray, replicates: int, seed: int = SEED) -> np.ndarray:
    """How often each replicate (a column) takes each unit (a row): Poisson numbers of mean 1 that a hash decides."""
    with np.errstate(over="ignore"):
        x = units.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(replicates, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    return np.searchsorted(np.array(intervals.POISSON), u / 2.0**53, "right")


def paired_difference(df: DataFrame, row: str, label: str, one: str, two: str, replicates: int = 1000, block: int = 1) -> dict[str, float]:
    """How much more of label 1 the flag ``one`` finds than ``two``: the difference, and its 2.5 and 97.5 percentiles over resamples that take both flags of a row together.

    Runs of ``block`` rows by ``row`` are resampled whole. Each batch sums its
    rows for all replicates at once; nothing is made larger by their number.
    """
    names = ["replicate", "found", "other", "all"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates + 1, 3))
        for batch in batches:
            unit, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            w = np.c_[np.ones(len(unit)), weights_of(unit, replicates)]
            total += w.T @ np.stack([a, b, np.ones(len(unit))], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates + 1, dtype=np.int32)), *(pa.array(c) for c in total.T)], names=names)

    rows = df.where(F.col(label) == 1).select(F.floor(F.col(row) / block).cast("long").alias("u"), F.col(one).cast("double").alias("a"), F.col(two).cast("double").alias("b"))
    sums = rows.mapInArrow(work, "replicate int, found double, other double, all double").groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names[1:]]).toPandas()  # a row for each replicate
    sums = sums[sums["all"] > 0].set_index("replicate")
    if 0 not in sums.index:
        raise ValueError("no rows of label 1")
    delta = (sums["found"] - sums["other"]) / sums["all"]
    low, high = np.quantile(delta.drop(0), [0.025, 0.975])
    return {"difference": float(delta[0]), "low": float(low), "high": float(high)}
