"""Novelty of rows by what benign rows are like: isolation forest, reconstruction error, and their ensemble."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spillway.functions import scoring
from spillway.models.detector import Mahalanobis, finite
from spillway.operators import intervals

TREES, SAMPLE = 200, 256
#: Scores of benign rows that percentiles are read from; of more rows, so many quantiles, by which a percentile is off by about 1 / QUANTILES at most.
REFERENCE, QUANTILES = 100_000, 2000
HOW = ("mean", "max", "median")


def filled(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """Missing and non-finite values as the mean."""
    return df.withColumns({c: F.coalesce(scoring.finite_or_null(F.col(c).cast("double")), F.lit(m)) for c, m in means.items()})


def means_of(df: DataFrame, columns: list[str]) -> dict[str, float]:
    found = finite(df, columns).agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    return {c: found[f"m{k}"] or 0.0 for k, c in enumerate(columns)}


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes of a tree over the rows of ``x``: column (-1: a leaf), cut, places of the two parts, and at a leaf its mean path length."""
    rng, nodes, most = np.random.default_rng(seed), [], math.ceil(math.log2(max(len(x), 2)))
    waiting = [(np.arange(len(x)), 0)]
    nodes.append(None)
    at = 0
    while at < len(waiting):
        rows, depth = waiting[at]
        low, high = x[rows].min(0), x[rows].max(0)
        varied = np.flatnonzero(low < high)
        if depth >= most or len(rows) < 2 or not len(varied):
            nodes[at] = (-1, 0.0, at, at, depth + float(mean_path(len(rows))))
        else:
            c = int(rng.choice(varied))
            cut = float(rng.uniform(low[c], high[c]))
            left = x[rows, c] <= cut
            nodes[at] = (c, cut, len(nodes), len(nodes) + 1, 0.0)
            waiting += [(rows[left], depth + 1), (rows[~left], depth + 1)]
            nodes += [None, None]
        at += 1
    return nodes


@dataclass
class IsolationForest:
    """Trees over small random samples: rows that few cuts set apart are novel."""

    means: dict[str, float]
    trees: list[tuple[np.ndarray, ...]]
    sample: int

    @classmethod
    def fit(cls, benign: DataFrame, columns: list[str], row: str, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> IsolationForest:
        """``row`` tells rows apart. A hash of it picks a pool of rows, and of these each tree's sample, in one pass over ``benign``.

        No benign rows are an error. Fewer rows than ``sample`` are all in every tree.
        """
        n = benign.count()
        if not n:
            raise ValueError("no benign rows to fit on")
        means, wide = means_of(benign, columns), 2 * trees * sample
        pool = filled(benign, means).where(intervals.uniform(F.col(row), F.lit(f"pool {seed}")) < wide / n) if n > wide else filled(benign, means)
        held = min(n, wide)
        share = min(1.0, 2 * sample / held)
        number = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), F.col(row), t).alias("h")))
        drawn = pool.select(F.array(*[F.col(f"`{c}`") for c in columns]).alias("x"), F.explode(F.filter(number, lambda d: F.pmod(d["h"], F.lit(1 << 30)) < share * (1 << 30))).alias("d"))
        least = Window.partitionBy("d.tree").orderBy(F.pmod("d.h", F.lit(1 << 30)), "d.h")
        samples = drawn.withColumn("place", F.row_number().over(least)).where(F.col("place") <= sample).select("d.tree", "d.h", "x")

        def grown(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("h")
            nodes = grow(np.array(rows["x"].tolist(), float), seed * 100_003 + int(key[0]))
            return pd.DataFrame([(int(key[0]), k, *node) for k, node in enumerate(nodes)], columns=["tree", "node", "column", "cut", "low", "high", "path"])

        made = samples.groupBy("tree").applyInPandas(grown, "tree int, node int, column int, cut double, low int, high int, path double").toPandas()  # 2 * sample nodes a tree at most
        parts = [tuple(own.sort_values("node")[c].to_numpy() for c in ("column", "cut", "low", "high", "path")) for _, own in made.groupby("tree")]
        return cls(means, parts, min(sample, n))

    def scored(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus mean path length over that of a random search, less one half: above 0 is novel."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, cut, low, high, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while (column[at] >= 0).any():
                at = np.where(x[rows, np.maximum(column[at], 0)] <= cut[at], low[at], high[at])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(float(mean_path(self.sample)), 1.0)) - 0.5

    def score(self, df: DataFrame, out: str = "isolation") -> DataFrame:
        """``df`` with ``out``; missing values count as the mean."""
        names, model = list(self.means), df.sparkSession.sparkContext.broadcast(self)
        inputs = [f"_x{k}" for k in range(len(names))]
        schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, `{out}` double"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in inputs], 1) if batch.num_rows else np.empty((0, len(inputs)))
                kept = batch.select([k for k in range(batch.num_columns) if k < batch.num_columns - len(inputs)])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(model.value.scored(x), pa.float64())], names=[*kept.schema.names, out])

        values = [F.coalesce(scoring.finite_or_null(F.col(f"`{c}`").cast("double")), F.lit(m)).alias(x) for x, (c, m) in zip(inputs, self.means.items(), strict=True)]
        return df.select("*", *values).mapInArrow(work, schema)


@dataclass
class Reconstruction:
    """How badly a few directions of the benign rows rebuild a row: mean squared error in standard deviations."""

    means: dict[str, float]
    spreads: dict[str, float]
    directions: list[list[float]]

    @classmethod
    def fit(cls, benign: DataFrame, columns: list[str], kept: int | float = 0.95) -> Reconstruction:
        """``kept``: how many directions or, below 1, the least share of the variance that they have."""
        k = range(len(columns))
        x = finite(benign, columns)
        found = x.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        means, spreads = {c: found[f"m{i}"] or 0.0 for i, c in enumerate(columns)}, {c: found[f"s{i}"] or 1.0 for i, c in enumerate(columns)}
        z = cls(means, spreads, [])._z()
        pairs = x.select(*[c.alias(f"z{i}") for i, c in enumerate(z)]).agg(*[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i in k for j in k if i <= j]).first()
        values, vectors = np.linalg.eigh(np.array([[pairs[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in k] for i in k]))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        n = int(kept) if kept >= 1 else int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), kept - 1e-12) + 1)
        return cls(means, spreads, vectors[:, : min(n, len(columns))].T.tolist())

    def _z(self) -> list[Column]:
        return [(F.coalesce(scoring.finite_or_null(F.col(f"`{c}`").cast("double")), F.lit(m)) - m) / self.spreads[c] for c, m in self.means.items()]

    def score(self) -> Column:
        z = self._z()
        along = [sum((x * w for x, w in zip(z, d, strict=True)), F.lit(0.0)) for d in self.directions]
        left = sum((x * x for x in z), F.lit(0.0)) - sum((a * a for a in along), F.lit(0.0))
        return F.greatest(left / len(z), F.lit(0.0))


@dataclass
class Ensemble:
    """Three novelty scores as percentiles of benign rows, fused into one."""

    forest: IsolationForest
    rebuilt: Reconstruction
    distance: Mahalanobis
    row: str
    reference: dict[str, np.ndarray] = field(default_factory=dict)

    NAMES = ("isolation", "reconstruction", "distance")

    @classmethod
    def fit(cls, benign: DataFrame, columns: list[str], row: str, trees: int = TREES, seed: int = 7) -> Ensemble:
        made = cls(IsolationForest.fit(benign, columns, row, trees, seed=seed), Reconstruction.fit(benign, columns), Mahalanobis.fit(benign, columns), row)
        return made.calibrated_on(benign)

    def refitted(self, benign: DataFrame) -> Ensemble:
        return Ensemble.fit(benign, self.distance.columns, self.row, len(self.forest.trees))

    def raw(self, df: DataFrame) -> DataFrame:
        """``df`` with the three scores; columns of these names would be lost: an error."""
        if clash := set(self.NAMES) & set(df.columns):
            raise ValueError(f"columns are there already: {sorted(clash)}")
        return self.forest.score(df, "isolation").withColumn("reconstruction", self.rebuilt.score()).withColumn("distance", self.distance.score())

    def calibrated_on(self, benign: DataFrame) -> Ensemble:
        """The same detectors with percentiles by other benign rows, which they need not have seen."""
        scored = self.raw(benign).select(*self.NAMES).persist()
        n = scored.count()
        if n <= REFERENCE:
            own = scored.toPandas()
            reference = {c: np.sort(own[c].to_numpy(float)) for c in self.NAMES}
        else:
            at = [(k + 0.5) / QUANTILES for k in range(QUANTILES)]
            found = scored.agg(*[F.percentile_approx(c, at, 100 * QUANTILES).alias(c) for c in self.NAMES]).first()
            reference = {c: np.array(found[c], float) for c in self.NAMES}
        scored.unpersist()
        return replace(self, reference=reference)

    def score(self, df: DataFrame, how: str = "mean", agreed: float = 0.99) -> DataFrame:
        """``df`` with the raw scores, ``novelty`` (their fused percentiles) and ``agreement`` (how many are at ``agreed`` or above)."""
        if how not in HOW:
            raise ValueError(f"{how!r} is none of {HOW}")
        scored, reference = self.raw(df), df.sparkSession.sparkContext.broadcast(self.reference)
        schema = f"{', '.join(f'`{c}` {t}' for c, t in scored.dtypes)}, novelty double, agreement int"

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fuse = {"mean": np.mean, "max": np.max, "median": np.median}[how]
            for batch in batches:
                ranks = [np.searchsorted(reference.value[c], batch.column(c).to_numpy(zero_copy_only=False), "left") / max(len(reference.value[c]), 1) for c in Ensemble.NAMES]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fuse(ranks, axis=0), pa.float64()), pa.array((np.array(ranks) >= agreed).sum(0).astype(np.int32))], names=[*batch.schema.names, "novelty", "agreement"])

        return scored.mapInArrow(work, schema)
