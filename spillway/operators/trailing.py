"""Exact counts over the trailing time of an entity, without lists of what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spillway.operators.blocks import numbered, saved, with_previous

_LAST = (1 << 62) - 1


def trailing_distinct(df: DataFrame, entity: list[str], ts: str, row: str, seconds: float, counts: dict[str, list[str] | None], width: float | None = None) -> DataFrame:
    """Add for each (out: columns) of ``counts`` how many different values of the columns the entity's earlier rows of the last ``seconds`` have; None counts the rows.

    Earlier is by (ts, row), ``row`` being distinct whole numbers up to 2**61. An
    occurrence of a value counts from its row on until the value's next one, and
    no longer than ``seconds``: what counts at a row is how many occurrences began
    before it less how many ended, a running sum for each count, all from one
    order by blocks of ``width`` seconds. Rows without a time count for nothing and get 0. Null entities and
    values are values like others.
    """
    us = round(seconds * 1e6)
    block = round((width or seconds) * 1e6) or 1
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(row).cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in entity]).alias("_entity"), *[F.struct(*[F.col(f"`{c}`") for c in columns or []]).alias(f"_value{k}") for k, columns in enumerate(counts.values()) if columns])
    own = own.withColumn("_entity", F.to_json("_entity", {"ignoreNullFields": "false"}))
    own = saved(own.withColumns({f"_value{k}": F.to_json(f"_value{k}", {"ignoreNullFields": "false"}) for k, columns in enumerate(counts.values()) if columns}))
    valued = [k for k, columns in enumerate(counts.values()) if columns]
    known = own.where("_at IS NOT NULL").withColumns({"_t": -F.col("_at"), "row": -F.col("_id")})
    for k in valued:
        known = with_previous(known, ["_entity", f"_value{k}"], F.struct("_at", "_id"), block, f"_next{k}").drop(f"_value{k}")
    known = saved(known) if valued else known
    expires = F.struct((F.col("_at") + us).alias("t"), F.lit(2 * _LAST).alias("row"))
    ends = {k: F.least(F.struct(F.col(f"_next{k}._at").alias("t"), (2 * F.col(f"_next{k}._id") + 1).alias("row")), expires) for k in valued}
    ends = {k: F.when(F.col(f"_next{k}").isNull(), expires).otherwise(end) for k, end in ends.items()}
    event = lambda at, steps, kept: F.struct(at["t"].alias("_t"), at["row"].alias("row"), *[steps(k).alias(f"_step{k}") for k in range(len(counts))], kept.alias("_row"))
    began = event(F.struct(F.col("_at").alias("t"), (2 * F.col("_id")).alias("row")), lambda _: F.lit(1), F.col("_row"))
    ended = [event(ends.get(n, expires), lambda k, n=n: F.lit(-int(k == n)), F.when(F.lit(False), F.col("_row"))) for n in range(len(counts))]
    events = known.select("_entity", F.explode(F.array(began, *ended)).alias("_event")).select("_entity", "_event.*")
    out = numbered(events, ["_entity"], {name: f"_step{k}" for k, name in enumerate(counts)}, block).where("_row IS NOT NULL")
    out = out.select("_row", *[(F.col(name) - 1).cast("long").alias(name) for name in counts])
    zero = own.where("_at IS NULL").select("_row", *[F.lit(0).cast("long").alias(name) for name in counts])
    return out.select("_row", *counts).unionByName(zero).select("_row.*", *counts)
