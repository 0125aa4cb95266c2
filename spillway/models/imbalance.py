"""Strategies for rare classes: weights, samples, and rows made between neighbours.

Neighbours come from several curves. Each curve orders all rows by the bits of
a few random directions, taken in turns; rows that stand near each other on it
are compared exactly. A row is compared with a bounded number of others on each
curve, however many rows are alike. What is missed is measured in the tests:
recall over 0.9 for up to eight columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spillway.functions import scoring
from spillway.models import detector
from spillway.operators import intervals, metrics, splits
from spillway.operators.blocks import saved

#: Curves, directions and bits of each, and how far along a curve rows are compared.
CURVES, DIRECTIONS, BITS, NEAR = 8, 6, 10, 24
STRATEGIES = ("none", "class_weight", "threshold_moving", "smote", "smotenc", "borderline_smote", "adasyn", "smote_tomek", "undersample", "balanced_rf", "easy_ensemble")


def vectors(df: DataFrame, columns: list[str], categorical: list[str] = []) -> DataFrame:  # noqa: B006 - never changed
    """``df`` with ``_x``: columns in standard deviations from the mean (missing: the mean), and for each level of a category one half or 0."""
    known = detector.finite(df, columns)
    found = known.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(columns)]).first()
    z = [(F.coalesce(scoring.finite_or_null(F.col(c).cast("double")), F.lit(found[f"m{k}"] or 0.0)) - (found[f"m{k}"] or 0.0)) / (found[f"s{k}"] or 1.0) for k, c in enumerate(columns)]
    levels = {c: detector.kept_levels(df, c, 64, 0.0) for c in categorical}
    hot = [F.coalesce((F.col(c).cast("string") == v).cast("double"), F.lit(0.0)) / 2 for c, own in levels.items() for v in own]
    return df.withColumn("_x", F.array(*z, *hot))


def along_curve(x: np.ndarray, seed: int, curve: int) -> np.ndarray:
    """Each row's place on a curve: the bits of its places along random directions, the highest of each first."""
    rng = np.random.default_rng([seed, curve])
    turned, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
    dims = min(DIRECTIONS, x.shape[1])
    cells = np.clip((np.tanh((x @ turned[:, :dims]) / 3 + rng.uniform(-0.1, 0.1, dims)) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    for bit in range(BITS - 1, -1, -1):
        for d in range(dims):
            out = out << 1 | cells[:, d] >> bit & 1
    return out


_PAIR = "row long, other long, distance double, other_x array<double>, other_label int"


def _compared(rows: np.ndarray, asks: np.ndarray, labels: np.ndarray, x: np.ndarray, keep: np.ndarray, k: int, near: int) -> pa.RecordBatch:
    """The ``k`` nearest among those up to ``near`` places away, of the rows in ``keep`` that ask."""
    at = np.flatnonzero(asks & keep)
    steps = np.r_[-near:0, 1 : near + 1]
    other = at[:, None] + steps
    there = (other >= 0) & (other < len(x))
    other = np.where(there, other, 0)
    d = ((x[at][:, None, :] - x[other]) ** 2).sum(2)
    d = np.where(there & (rows[other] != rows[at][:, None]), d, np.inf)
    order = np.lexsort((rows[other], d), axis=1)[:, :k]
    d, other = np.take_along_axis(d, order, 1), np.take_along_axis(other, order, 1)
    i, j = np.nonzero(np.isfinite(d))
    chosen = other[i, j]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(i) + 1) * x.shape[1], x.shape[1], dtype=np.int32)), pa.array(x[chosen].ravel()))
    return pa.RecordBatch.from_arrays([pa.array(rows[at[i]]), pa.array(rows[chosen]), pa.array(d[i, j]), lists, pa.array(labels[chosen].astype(np.int32))], names=["row", "other", "distance", "other_x", "other_label"])


def neighbours(df: DataFrame, row: str, asks, k: int, label: str, seed: int = 7) -> DataFrame:
    """(row, other, distance, other_x, other_label, place): the ``k`` nearest other rows of each row for which ``asks`` holds, by squared distance of ``_x``; equal distances by row.

    ``row`` is a distinct whole number. The ends of a task's part of a curve are
    compared with the next part's by one task, which gets ``2 * NEAR`` rows of
    each part.
    """
    base = saved(df.select(F.col(row).cast("long").alias("row"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(label).cast("int").alias("label"), F.col("_x").alias("x")))
    schema = "curve int, place long, row long, asks boolean, label int, x array<double>"

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(3).to_pylist(), float)
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(along_curve(x, seed, c)), *batch.columns], names=["curve", "place", "row", "asks", "label", "x"])

    def walked(parts: Iterator[pa.RecordBatch], inner: bool) -> Iterator[tuple[pa.RecordBatch, list]]:
        """Compare along the curves; ``inner``: a part of them, whose ends are given out as well."""
        held: dict[str, np.ndarray] | None = None

        def arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            return {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("curve", "place", "row", "asks", "label")} | {"x": np.array(batch.column("x").to_pylist(), float)}

        def compare(own: dict, first: int, last: int) -> Iterator[pa.RecordBatch]:
            for c in np.unique(own["curve"]):
                mine = own["curve"] == c
                keep = (np.arange(len(mine)) >= first) & (np.arange(len(mine)) < last)
                yield _compared(*(own[n][mine] for n in ("row", "asks", "label", "x")), keep[mine], k, NEAR)

        done, start = 0, True
        ends: list[dict] = []
        for batch in parts:
            if not batch.num_rows:
                continue
            new = arrays(batch)
            held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in held}
            if start and len(held["row"]) >= 2 * NEAR:
                ends.append({n: v[: 2 * NEAR] for n, v in held.items()})
                start = False
            last = len(held["row"]) - NEAR
            if last > done + 4 * NEAR:
                yield from ((p, []) for p in compare(held, done, last))
                cut = max(0, last - NEAR)
                held, done = {n: v[cut:] for n, v in held.items()}, last - cut
        if held is not None:
            yield from ((p, []) for p in compare(held, done, len(held["row"])))
            ends.append({n: v[-2 * NEAR :] for n, v in held.items()} if not start else held)
        if inner:
            yield None, ends

    out_schema = f"{_PAIR}, curve int, at long, asks boolean, part int"
    names = [*(x.split()[0] for x in _PAIR.split(", ")), "curve", "at", "asks", "part"]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for found, ends in walked(batches, True):
            if found is not None:
                empty = [pa.nulls(found.num_rows, t) for t in (pa.int32(), pa.int64(), pa.bool_(), pa.int32())]
                yield pa.RecordBatch.from_arrays([*found.columns, *empty], names=names)
            for e in ends:
                n = len(e["row"])
                columns = [pa.array(e["row"]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(e["x"].tolist(), pa.list_(pa.float64())), pa.array(e["label"].astype(np.int32)), pa.array(e["curve"].astype(np.int32)), pa.array(e["place"]), pa.array(e["asks"].astype(bool)), pa.array(np.full(n, part, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (p for p, _ in walked(batches, False))

    dealt = base.mapInArrow(placed, schema).repartitionByRange("curve", "place", "row").sortWithinPartitions("curve", "place", "row")
    found = saved(dealt.mapInArrow(inside, out_schema))
    seams = found.where("part IS NOT NULL").select("curve", F.col("at").alias("place"), "row", "asks", F.col("other_label").alias("label"), F.col("other_x").alias("x")).distinct()
    seams = seams.coalesce(1).sortWithinPartitions("curve", "place", "row").mapInArrow(between, _PAIR)
    pairs = found.where("part IS NULL").select(*[x.split()[0] for x in _PAIR.split(", ")]).unionByName(seams).dropDuplicates(["row", "other"])
    nearest = Window.partitionBy("row").orderBy("distance", "other")
    return pairs.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k)


def between(seeds: DataFrame, near: DataFrame, amount, columns: list[str], seed: int = 7) -> DataFrame:
    """(row, copy, other, gap): ``amount`` (a column of ``seeds``) new rows from each row of ``seeds`` towards one of its neighbours, all by a hash."""
    listed = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "other"))).alias("near"))  # k of them
    each = seeds.where(amount >= 1).join(listed, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), amount.cast("int"))))
    pick = (intervals.uniform(F.col("row"), F.col("copy"), F.lit(f"pick {seed}")) * F.size("near")).cast("int")
    return each.select("row", "copy", F.get("near", pick)["other"].alias("other"), intervals.uniform(F.col("row"), F.col("copy"), F.lit(f"gap {seed}")).alias("gap"))


def oversampled(df: DataFrame, label: str, row: str, columns: list[str], kind: str = "smote", categorical: list[str] = [], integral: list[str] = [], k: int = 5, seed: int = 7) -> DataFrame:  # noqa: B006
    """``df`` and as many new rows of label 1 as make both labels equal, with ``synthetic``; of a new row other columns and ``row`` are null.

    smote: each rare row gives as many. borderline_smote: only rows of whose ten
    nearest half or more, but not all, are of label 0. adasyn: by the share of
    label 0 among the ``k`` nearest. A new row lies between a rare row and one of
    its ``k`` nearest rare ones; its categories are the commonest of these
    (ties: the smallest). ``integral`` columns are rounded. Fewer than two rare
    rows, or none that may give, make no new rows.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row for each class
    rare, wanted = counts.get(1, 0), counts.get(0, 0) - counts.get(1, 0)
    whole = df.withColumn("synthetic", F.lit(False))
    if rare < 2 or wanted <= 0:
        return whole
    laid = saved(vectors(df, columns, categorical))
    few = laid.where(F.col(label) == 1)
    near = saved(neighbours(few, row, F.lit(True), k, label, seed).select("row", "other", "place"))
    ids = few.select(F.col(row).cast("long").alias("row"))
    if kind in ("smote", "smotenc"):
        hashed = ids.withColumn("_u", intervals.uniform(F.col("row"), F.lit(f"extra {seed}")))
        givers = splits.first_of_each(hashed.withColumn("_all", F.lit(1)), "_all", F.col("_u"), "row", F.lit(wanted % rare), "_more").select("row", (F.lit(wanted // rare) + F.col("_more").cast("int")).alias("amount"))
    elif kind in ("borderline_smote", "adasyn"):
        m = 10 if kind == "borderline_smote" else k
        around = neighbours(laid, row, F.col(label) == 1, m, label, seed).groupBy("row").agg(F.count_if(F.col("other_label") == 0).alias("others"), F.count("*").alias("m"))
        if kind == "borderline_smote":
            danger = saved(around.where("2 * others >= m AND others < m").select("row"))
            n = danger.count()
            hashed = danger.withColumn("_u", intervals.uniform(F.col("row"), F.lit(f"extra {seed}"))).withColumn("_all", F.lit(1))
            givers = splits.first_of_each(hashed, "_all", F.col("_u"), "row", F.lit(wanted % n), "_more").select("row", (F.lit(wanted // n) + F.col("_more").cast("int")).alias("amount")) if n else danger.withColumn("amount", F.lit(0))
        else:
            around = saved(around.withColumn("share", F.col("others") / F.col("m")))
            total = around.agg(F.sum("share")).first()[0] or 0.0
            givers = around.select("row", F.bround(F.col("share") / (total or 1.0) * wanted).cast("int").alias("amount"))
    else:
        raise ValueError(f"unknown kind of new rows: {kind!r}")
    made = saved(between(givers, near, F.col("amount"), columns, seed))
    source = few.select(F.col(row).cast("long").alias("row"), *[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(columns)])
    target = few.select(F.col(row).cast("long").alias("other"), *[F.col(f"`{c}`").alias(f"_other{i}") for i, c in enumerate(columns)])
    joined = made.join(source, "row").join(target, "other")
    value = lambda i: F.col(f"_own{i}") + F.col("gap") * (F.col(f"_other{i}") - F.col(f"_own{i}"))
    new = {c: F.bround(value(i)) if c in integral else value(i) for i, c in enumerate(columns)}
    kept = joined.select("row", *[x.cast(df.schema[c].dataType).alias(c) for c, x in new.items()])
    if categorical:
        around = near.join(few.select(F.col(row).cast("long").alias("other"), *[F.col(c) for c in categorical]), "other")
        for c in categorical:
            by = around.groupBy("row", c).count()
            common = by.groupBy("row").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(c).alias("v"))).alias("top")).select("row", F.col("top.v").alias(c))
            kept = kept.join(common, "row")
    kept = kept.drop("row").withColumn(label, F.lit(1).cast(df.schema[label].dataType)).withColumn("synthetic", F.lit(True))
    return whole.unionByName(kept, allowMissingColumns=True)


def tomek_links(df: DataFrame, label: str, row: str, columns: list[str], seed: int = 7) -> DataFrame:
    """(a, b): rows of different labels that are each other's nearest; a < b."""
    near = saved(neighbours(vectors(df, columns), row, F.lit(True), 1, label, seed).join(df.select(F.col(row).cast("long").alias("row"), F.col(label).alias("own")), "row").select("row", "other", "own", "other_label"))
    back = near.select(F.col("row").alias("other"), F.col("other").alias("row"))
    return near.join(back, ["row", "other"]).where("own <> other_label AND row < other").select(F.col("row").alias("a"), F.col("other").alias("b"))


def undersampled(df: DataFrame, label: str, row: str, seed: int = 7, member: int = 0) -> DataFrame:
    """All rows of the rarer label and as many of the other by a hash of ``row``."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    least = min(counts.get(0, 0), counts.get(1, 0))
    return splits.first_of_each(df, label, intervals.uniform(F.col(row), F.lit(f"under {seed} {member}")), row, F.lit(least), "_taken").where("_taken").drop("_taken")


def impossible(df: DataFrame, integral: list[str]) -> DataFrame:
    """Rows with a value that is no whole number where only whole ones exist."""
    odd = [F.coalesce(F.col(c) != F.floor(F.col(c)), F.lit(False)) for c in integral]
    return df.where(sum((o.cast("int") for o in odd), F.lit(0)) > 0)


def check_natural(evaluated: DataFrame, original: DataFrame, label: str, most: float = 0.05) -> None:
    """An error if the share of label 1 differs by over ``most`` from the rows before any resampling."""
    a, b = (d.agg(F.avg(F.col(label).cast("double"))).first()[0] for d in (evaluated, original))
    if a is None or b is None or abs(a - b) > most:
        raise ValueError(f"evaluated on a share of {a} where the data have {b}")


def fit_strategy(name: str, train: DataFrame, label: str, row: str, columns: list[str], categorical: list[str] = [], integral: list[str] = [], kind: str = "logistic", members: int = 5):  # noqa: B006
    """A function that adds ``p_attack`` to rows; only ``train`` is ever resampled."""
    if name not in STRATEGIES:
        raise ValueError(f"{name!r} is none of {STRATEGIES}")
    if name in ("balanced_rf", "easy_ensemble"):
        own = {"balanced_rf": "forest", "easy_ensemble": "boosted"}[name]
        parts = [_fitted(undersampled(train, label, row, member=m), label, columns, categorical, own, True) for m in range(members)]

        def together(df: DataFrame) -> DataFrame:
            for m, score in enumerate(parts):
                df = score(df, f"_p{m}")
            return df.withColumn("p_attack", sum((F.col(f"_p{m}") for m in range(members)), F.lit(0.0)) / members).drop(*[f"_p{m}" for m in range(members)])

        return together
    rows = train
    if name in ("smote", "smotenc", "borderline_smote", "adasyn", "smote_tomek"):
        rows = oversampled(train, label, row, columns, "smote" if name == "smote_tomek" else name, categorical, integral).drop("synthetic")
        rows = rows.withColumn(row, F.monotonically_increasing_id())
        rows = saved(rows)
    if name == "smote_tomek":
        links = tomek_links(rows, label, row, columns)
        rows = rows.join(links.select(F.explode(F.array("a", "b")).alias(row)).distinct(), row, "left_anti")
    if name == "undersample":
        rows = undersampled(train, label, row)
    return _fitted(rows, label, columns, categorical, kind, name == "class_weight")


def _fitted(rows: DataFrame, label: str, columns: list[str], categorical: list[str], kind: str, weighted: bool):
    before = detector.Preprocessor.fit(rows, columns, categorical)
    head = detector.fit_head(before.transform(rows), label, kind, weighted)
    return lambda df, out="p_attack": detector.attack_probability(head, before.transform(df), out).drop("features")


def ablation(train: DataFrame, test: DataFrame, label: str, row: str, columns: list[str], categorical: list[str] = [], names: tuple[str, ...] = STRATEGIES, fpr: float = 0.01, kind: str = "logistic") -> list[dict]:  # noqa: B006
    """For each strategy the AUC on ``test``, its recall at a share ``fpr`` of benign rows, and at 0.5 recall and precision; threshold_moving takes the threshold from ``train``."""
    out = []
    for name in names:
        score = fit_strategy(name, train, label, row, columns, categorical, kind=kind)
        found = saved(score(test).select(F.col(label).alias("y"), "p_attack"))
        at = detector.benign_threshold(score(train).where(F.col(label) == 0), "p_attack", fpr) if name == "threshold_moving" else 0.5
        cells = metrics.confusion(found, "y", "p_attack", at).first()
        out.append({"strategy": name, "roc_auc": metrics.auc(found, "y", "p_attack").first()["roc_auc"], "recall_at_fpr": metrics.recall_at_fpr(found, "y", "p_attack", fpr).first()[0], "threshold": at, "recall": cells["tpr"], "precision": cells["precision"]})
    return out
