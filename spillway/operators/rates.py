"""Counts over the trailing time of an entity, with hot entities split by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_count(df: DataFrame, entity: str, ts: str, seconds: int, out: str = "n") -> DataFrame:
    """Add ``out``: the entity's rows of the last ``seconds``, both ends and the row itself included.

    Rows are dealt by entity and block of ``seconds``; each also goes, as context, to the block
    after its own, so an entity's rows share a task for two blocks only. A null time counts 0.
    """
    us = seconds * 1_000_000
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    known = df.where(F.col(ts).isNotNull()).withColumn("_t", t).withColumn("_own", F.floor(F.col("_t") / us))
    dealt = known.withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(entity, "_block").orderBy("_t").rangeBetween(-us, Window.currentRow)
    counted = dealt.withColumn(out, F.count("*").over(w)).where("_block = _own").drop("_t", "_own", "_block")
    return counted.unionByName(df.where(F.col(ts).isNull()).withColumn(out, F.lit(0).cast("long")))


def broken_links(df: DataFrame, sequence: str, previous: str, own: str, expected) -> DataFrame:
    """Rows of a hash chain whose own hash is not ``expected`` or whose link is not the hash of the row before.

    The row before is found by its sequence number, so no task orders the whole chain. The first row links to ''.
    """
    before = df.select((F.col(sequence) + 1).alias(sequence), F.col(own).alias("_before"))
    first = df.agg(F.min(sequence).alias("_first"))
    rows = df.join(before, sequence, "left").crossJoin(F.broadcast(first))  # one row
    link = F.when(F.col(sequence) == F.col("_first"), F.lit("")).otherwise(F.col("_before"))
    bad = ~F.col(own).eqNullSafe(expected) | ~F.col(previous).eqNullSafe(link)
    return rows.where(bad).select(*df.columns)
