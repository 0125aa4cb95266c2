"""What rows of a key say about each other in order of time, by blocks of time, so that no task needs all rows of a crowded key.

Rows have ``_t`` (microseconds) and ``row`` (a number that tells rows apart);
they are in order of both. A key with up to ``ROWS_AT_ONCE`` rows is ordered in
one task; of one with more, a block's rows are, and between blocks goes one row
for each key and block.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a key that are one block, however long they take.
ROWS_AT_ONCE = 100_000


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut off from what made it: written to the folder of ``spark.checkpoint.dir`` or, where that is unset, to the warehouse."""
    spark = df.sparkSession
    path = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/flows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_blocks(rows: DataFrame, keys: list[str], width: int, dense: bool) -> DataFrame:
    """``rows`` with ``_block``: their time's block of ``width`` microseconds, null for keys that are not crowded; ``dense``: all keys are taken to be."""
    if dense:
        return rows.withColumn("_block", F.floor(F.col("_t") / width))
    crowded = rows.groupBy(*keys).count().where(F.col("count") > ROWS_AT_ONCE).select(*keys, F.lit(True).alias("_crowded"))  # one for each ROWS_AT_ONCE rows at most
    return rows.join(F.broadcast(crowded), keys, "left").withColumn("_block", F.when(F.col("_crowded"), F.floor(F.col("_t") / width))).drop("_crowded")


def _before(keys: list[str], by: list[str]) -> tuple:
    return Window.partitionBy(*keys, "_block").orderBy(*by), Window.partitionBy(*keys).orderBy("_block")


def with_previous(rows: DataFrame, keys: list[str], value: Column, width: int, out: str, dense: bool = False) -> DataFrame:
    """Add ``out``: ``value`` (not null) of the row before in order of (_t, row), by blocks of ``width`` microseconds; null for the first row of ``keys``."""
    inside, across = _before(keys, ["_t", "row"])
    rows = in_blocks(rows, keys, width, dense).withColumn("_v", value)
    ends = rows.where("_block IS NOT NULL").groupBy(*keys, "_block").agg(F.max_by("_v", F.struct("_t", "row")).alias("_end"))
    ends = ends.select(*keys, "_block", F.lag("_end").over(across).alias("_carried"))
    found = rows.withColumn("_lag", F.lag("_v").over(inside)).join(ends, [*keys, "_block"], "left")
    return found.withColumn(out, F.coalesce("_lag", "_carried")).drop("_lag", "_carried", "_v", "_block")


def numbered(rows: DataFrame, keys: list[str], flag: str | dict[str, str], width: int, out: str = "", dense: bool = False) -> DataFrame:
    """Add ``out``: the sum of ``flag``, a column of numbers, over the rows of ``keys`` up to each, itself included, by blocks of ``width`` microseconds.

    With several, ``flag`` is (out: column) of each; all come from one order.
    """
    flags = flag if isinstance(flag, dict) else {out: flag}
    inside, across = _before(keys, ["_t", "row"])
    rows = in_blocks(rows, keys, width, dense)
    sums = rows.where("_block IS NOT NULL").groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in enumerate(flags.values())])
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", *[F.sum(f"_sum_{k}").over(earlier).alias(f"_upto_{k}") for k in range(len(flags))])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("*", *[F.sum(c).over(upto).alias(f"_in_{k}") for k, c in enumerate(flags.values())]).join(sums, [*keys, "_block"], "left")
    return found.withColumns({name: F.col(f"_in_{k}") + F.coalesce(f"_upto_{k}", F.lit(0)) for k, name in enumerate(flags)}).drop("_block", *[f"_{x}_{k}" for k in range(len(flags)) for x in ("in", "upto")])
