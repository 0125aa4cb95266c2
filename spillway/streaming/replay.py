"""Replay of stored rows as a stream, and drift that is put into them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.functions import fields


def replay(spark: SparkSession, path: str, schema: str, score, checkpoint: str, out: str, files: int = 1) -> list[dict]:
    """Stream the Parquet files under ``path`` in bounded micro-batches through ``score`` (a function of a DataFrame with a
    column ``verdict``), append each batch to ``out``, and return the running counts by verdict after each batch.

    A batch that is run again overwrites its own folder, so each row is written once.
    """
    totals: dict[str, int] = {}
    history: list[dict] = []

    def sink(batch: DataFrame, number: int) -> None:
        target = f"{out}/batch={number}"
        score(batch).write.mode("overwrite").parquet(target)
        for r in spark.read.parquet(target).groupBy("verdict").count().collect():  # a row for each verdict
            totals[r["verdict"]] = totals.get(r["verdict"], 0) + r["count"]
        history.append({"batch": number, **totals})

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return history


def shifted(value: Column, position: Column, spread: float, start: float, full: float, sigmas: float = 1.0) -> Column:
    """A covariate that moves by up to ``sigmas`` standard deviations."""
    return value + fields.intensity(position, start, full, sigmas) * spread


def seasonal(value: Column, position: Column, period: float, amplitude: float) -> Column:
    return value * (1 + amplitude * F.sin(position * (2 * math.pi / period)))


def spliced(stream: DataFrame, source: DataFrame, position: str, change: int) -> DataFrame:
    """``source``'s rows put into ``stream`` at a place: later rows move back. Positions are gapless from 0 in both."""
    n = source.count()
    moved = stream.withColumn(position, F.when(F.col(position) >= change, F.col(position) + n).otherwise(F.col(position)))
    return moved.unionByName(source.withColumn(position, F.col(position) + change))
