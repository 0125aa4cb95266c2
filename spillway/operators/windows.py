"""Strictly causal features and sessions over the rows of an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spillway.operators.blocks import saved
from spillway.operators.ordered import running_sums

#: Gaps in a block of a key's rows, which one task puts in order.
BLOCK_GAPS = 16


def trailing(df: DataFrame, entity: str, other: str, ts: str, row: str, seconds: int = 60, most: int = 5000) -> DataFrame:
    """Counts, distinct partners, entropy and mean gap over an entity's earlier rows of the last ``seconds``.

    Earlier is by (ts, row): of rows with one time the earlier in file order
    counts. At most the ``most`` latest rows are looked at. A null time gives
    zeros and counts for nothing.
    """
    w = Window.partitionBy(entity).orderBy(ts, row).rowsBetween(-most, -1)
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    known = df.where(F.col(ts).isNotNull()).withColumn("_t", t)
    seen = F.filter(F.collect_list(F.struct("_t", F.col(other).alias("o"))).over(w), lambda x: x["_t"] >= F.col("_t") - seconds * 1_000_000)
    rows = known.withColumn("_w", seen).withColumn("_n", F.size("_w"))
    names = F.transform("_w", lambda x: x["o"])
    distinct = F.array_distinct(names)
    share = lambda o: F.size(F.filter("_w", lambda x: x["o"] == o)) / F.col("_n")
    entropy = F.aggregate(distinct, F.lit(0.0), lambda s, o: s - share(o) * F.log2(share(o)))
    gap = (F.element_at("_w", -1)["_t"] - F.element_at("_w", 1)["_t"]) / 1e6 / (F.col("_n") - 1)
    zero = lambda c: F.when(F.col("_n") > 0, c).otherwise(F.lit(0.0))
    made = rows.withColumns({"flows": F.col("_n").cast("long"), "distinct_others": F.size(distinct).cast("long"), "entropy": zero(entropy), "fanout_ratio": zero(F.size(distinct) / F.col("_n")), "mean_gap": F.when(F.col("_n") > 1, gap).otherwise(F.lit(0.0))})
    none = df.where(F.col(ts).isNull()).withColumns({c: F.lit(0).cast("long") for c in ("flows", "distinct_others")} | {c: F.lit(0.0) for c in ("entropy", "fanout_ratio", "mean_gap")})
    return made.drop("_t", "_w", "_n").unionByName(none)


def sessions(df: DataFrame, keys: list[str], ts: str, row: str, gap: str) -> DataFrame:
    """Add ``session``: how many gaps longer than ``gap`` came before in the key's rows, in order of ``ts`` and ``row``.

    Rows are taken in blocks of ``BLOCK_GAPS`` gaps, a day at least, so that no task needs all rows of a key.
    They are written once, as they are read thrice, and dealt once by key and block; between blocks goes one row for each.
    A null key is a key like others; rows without a time are in session 0.
    """
    most = df.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {gap}) - unix_micros(TIMESTAMP '1970-01-01 00:00:00')").first()[0]
    key = F.to_json(F.struct(*[F.col(f"`{c}`") for c in keys]), {"ignoreNullFields": "false"})
    rows = saved(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), key.alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(row).alias("row")))
    known = rows.where("_t IS NOT NULL").withColumn("_block", F.floor(F.col("_t") / max(BLOCK_GAPS * most, 86_400_000_000)))
    inside, across = Window.partitionBy("_key", "_block").orderBy("_t", "row"), Window.partitionBy("_key").orderBy("_block")
    gaps = F.coalesce((F.col("_t") - F.lag("_t").over(inside) > most).cast("long"), F.lit(0))
    known = known.withColumn("_new", gaps).withColumn("_in", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = known.groupBy("_key", "_block").agg(F.min("_t").alias("_first"), F.max("_t").alias("_end"), F.sum("_new").alias("_gaps"))
    between = F.coalesce((F.col("_first") - F.lag("_end").over(across) > most).cast("long"), F.lit(0))
    blocks = blocks.withColumn("_between", between)
    upto = F.sum(F.col("_gaps") + F.col("_between")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_gaps")
    found = known.join(blocks.select("_key", "_block", upto.alias("_upto")), ["_key", "_block"]).select("_row", (F.col("_in") + F.col("_upto")).alias("session"))
    return found.unionByName(rows.where("_t IS NULL").select("_row", F.lit(0).cast("long").alias("session"))).select("_row.*", "session")


def time_order(df: DataFrame, ts: str, row: str, out: str = "_pos") -> DataFrame:
    """``df``'s rows that have a time, with ``out``: each one's place, from 1, in order of ``ts`` and then ``row``.

    Times are counted before they are ordered; rows of one time are put in order in one task.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(kept, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(row).alias("_id")).where("_t IS NOT NULL")
    times = running_sums(rows.groupBy("_t").agg(F.count("*").alias("_n")), "_t", {"_upto": "_n"}).select("_t", (F.col("_upto") - F.col("_n")).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_t").orderBy("_id"))
    return rows.join(times, "_t").select("_row", (F.col("_base") + place).alias(out)).select("_row.*", out)


def sequences(df: DataFrame, entity: str, ts: str, row: str, features: list[str], length: int = 16, gap: float = 300.0, keep_every: int = 1) -> DataFrame:
    """``df``'s rows with ``depth`` and ``sequence``: the features of up to ``length`` rows of the entity, the row itself last, zeros before them.

    A silence of over ``gap`` seconds ends what came before. Of all rows in order
    of time every ``keep_every``-th has a sequence; the others are history all
    the same. Missing features count as 0, a null entity is one like others,
    rows without a time are left out. Rows are dealt by blocks of as much time as
    a sequence may last, each also to the next block, so that a busy entity's
    rows share a task for two blocks only.
    """
    us = round(gap * 1e6)
    width = max(us * length, 1)
    laid = time_order(df, ts, row, "_pos")
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])
    rows = laid.select(kept, F.to_json(F.struct(entity), {"ignoreNullFields": "false"}).alias("_e"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), "_pos", x.alias("_x"))
    rows = rows.withColumn("_own", F.floor(F.col("_t") / width)).withColumn("_block", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    along = Window.partitionBy("_e", "_block").orderBy("_pos")
    new = F.coalesce((F.col("_t") - F.lag("_t").over(along) > us).cast("int"), F.lit(0))
    runs = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.collect_list("_x").over(Window.partitionBy("_e", "_block", "_run").orderBy("_pos").rowsBetween(1 - length, 0))
    made = runs.withColumn("_seen", seen).where("_block = _own").where((F.col("_pos") - 1) % keep_every == 0).withColumn("depth", F.size("_seen"))
    blank = F.array_repeat(F.array(*[F.lit(0.0)] * len(features)), (F.lit(length) - F.col("depth")).cast("int"))
    return made.select("_row", "depth", F.concat(blank, "_seen").alias("sequence")).select("_row.*", "depth", "sequence")


def at_most_benign(df: DataFrame, label: str, score: str, row: str, budget: int) -> DataFrame:
    """Add ``flagged``: rows in order of score while fewer than ``budget`` benign ones came before; ties in order of ``row``.

    Scores are counted first; only the rows of the one score at which the
    budget runs out are put in order.
    """
    by = df.groupBy(F.col(score).alias("_s")).agg(F.sum(1 - F.col(label)).alias("_n"))
    spent = running_sums(by, "_s", {"_upto": "_n"}, descending=True).where(F.col("_upto") >= budget)
    at = spent.agg(F.max(F.struct("_s", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("x")).first()["x"]
    if at is None:
        return df.withColumn("flagged", F.lit(True))
    clear = df.where(F.col(score) != at["_s"]).withColumn("flagged", F.col(score) > at["_s"])
    tied = df.where(F.col(score) == at["_s"]).withColumn("_b", 1 - F.col(label))
    tied = running_sums(tied, row, {"_upto": "_b"}).withColumn("flagged", F.col("_upto") - F.col("_b") + at["_before"] < budget)
    return clear.unionByName(tied.drop("_b", "_upto"))
