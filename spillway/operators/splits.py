"""Stratified samples and splits, by count and not by chance, without ordering a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spillway.operators.blocks import saved

PARTS = 4096


def first_of_each(df: DataFrame, group: str, order: Column, row: str, take: Column, out: str = "taken") -> DataFrame:
    """Add ``out``: whether a row is among the first ``take`` of its group by ``order`` (from 0 to 1, evenly spread; ties by ``row``).

    ``take`` is an expression of ``n``, the group's size. Orders are cut into PARTS
    parts; a row for each group says in which part its count runs out, and only
    rows of that part are put in order. The others stay where they are.
    """
    part = F.least(F.floor(order * PARTS), F.lit(PARTS - 1))
    counts = df.select(F.col(group).alias("_of"), part.alias("_part")).groupBy("_of", "_part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)  # at most PARTS rows
    counts = counts.withColumns({"_upto": F.sum("_n").over(upto), "n": F.sum("_n").over(Window.partitionBy("_of"))}).withColumn("_take", take)
    cut = F.col("_upto") > F.col("_take")  # in the first such part the count runs out
    cuts = counts.groupBy("_of").agg(F.coalesce(F.min(F.when(cut, F.col("_part"))), F.lit(PARTS)).alias("_edge"), F.min_by(F.col("_take") - F.col("_upto") + F.col("_n"), F.when(cut, F.col("_part"))).alias("_left"))
    cuts = saved(cuts.withColumnRenamed("_of", "_group"))  # written, so that its size is known: few groups go to the rows
    known = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(group).alias("_of"), F.col(row).alias("_id"), order.alias("_order"), part.alias("_part"))
    known = known.join(cuts, F.col("_of").eqNullSafe(F.col("_group")))
    edge = F.col("_part") == F.col("_edge")
    clear = known.where(~edge).select("_row", (F.col("_part") < F.col("_edge")).alias("_taken"))
    place = F.row_number().over(Window.partitionBy("_of").orderBy("_order", "_id"))
    found = clear.unionByName(known.where(edge).select("_row", (place <= F.col("_left")).alias("_taken")))
    return found.select("_row.*", F.col("_taken").alias(out))


def spaced(n: int, keep: int) -> list[int]:
    """``keep`` places from 0 to n - 1, evenly spaced and rounded down, each once."""
    return sorted({int(k * (n - 1) / max(keep - 1, 1)) for k in range(keep)}) if n else []
