"""Running sums over all rows in one order, dealt by ranges of value so that no task sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spillway.operators.blocks import saved


def running_sums(df: DataFrame, key: str, values: dict[str, str], descending: bool = False) -> DataFrame:
    """Add for each (out: column) of ``values`` the column's sum over all rows up to each, itself included, in order of ``key``.

    Keys are numbers, distinct and not null. Rows are dealt by ranges of the key,
    as many as shuffles have partitions, and written, so that they are made once;
    a range's rows are sorted in one task and the totals of the ranges before it,
    one row each, are added.
    """
    dealt = saved(df.repartitionByRange(key).withColumn("_block", F.spark_partition_id()))
    along = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    totals = dealt.groupBy("_block").agg(*[F.sum(c).alias(f"_sum_{out}") for out, c in values.items()])
    earlier = Window.orderBy(along("_block")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.select("_block", *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_before_{out}") for out in values])
    inside = Window.partitionBy("_block").orderBy(along(key)).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.withColumns({f"_in_{out}": F.sum(c).over(inside) for out, c in values.items()})
    joined = sums.join(F.broadcast(before), "_block")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_in_{out}") + F.col(f"_before_{out}")).alias(out) for out in values])


def positions(df: DataFrame, key: str, out: str = "pos") -> DataFrame:
    """Add ``out``: each row's place, from 1, in order of ``key`` (distinct numbers)."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("long")), key, {out: "_one"}).drop("_one")


def places(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: each row's place, from 1, among those of its ``group``, in ``order`` of columns.

    Rows are dealt by ranges of both and written, so that no task sorts a whole
    group; a range's rows are put in order in one task, and the rows of the
    ranges before it, one count for each group and range, are added.
    """
    dealt = saved(df.repartitionByRange(F.asc(group), *order).withColumn("_block", F.spark_partition_id()))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = dealt.groupBy(group, "_block").agg(F.count("*").alias("_n")).select(F.col(group).alias("_group"), F.col("_block").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(group, "_block").orderBy(*order)))
    joined = rows.join(F.broadcast(before), (F.col("_block") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_place") + F.col("_before")).alias(out))
