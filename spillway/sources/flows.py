"""Readers of flow tables in files with fixed layouts; what a file lacks or spells otherwise is an error, not a guess."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spillway.functions import fields, scoring

#: The columns of the 1999 connection data, its text columns, and the attacks that only its test split has.
CONNECTION_COLUMNS = """duration protocol_type service flag src_bytes dst_bytes land wrong_fragment urgent hot num_failed_logins logged_in num_compromised root_shell su_attempted num_root num_file_creations num_shells
num_access_files num_outbound_cmds is_host_login is_guest_login count srv_count serror_rate srv_serror_rate rerror_rate srv_rerror_rate same_srv_rate diff_srv_rate srv_diff_host_rate dst_host_count dst_host_srv_count
dst_host_same_srv_rate dst_host_diff_srv_rate dst_host_same_src_port_rate dst_host_srv_diff_host_rate dst_host_serror_rate dst_host_srv_serror_rate dst_host_rerror_rate dst_host_srv_rerror_rate label difficulty""".split()
CONNECTION_TEXT = ("protocol_type", "service", "flag", "label")
UNSEEN = "apache2 httptunnel mailbomb mscan named processtable ps saint sendmail snmpgetattack snmpguess sqlattack udpstorm worm xlock xsnoop xterm".split()
#: Columns that say nothing or tell the label.
CONNECTION_DROPPED = ("difficulty", "num_outbound_cmds")
DAY_ENTITY = ("Flow ID", "Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol", "Timestamp")
DAY_LEAKS = ("Dst Port", "Destination Port")


def expect_rows(df: DataFrame, rows: int | None) -> DataFrame:
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows where {rows} were expected")
    return df


def connections(spark: SparkSession, path: str, rows: int | None = None, drop_artifacts: bool = True) -> DataFrame:
    """A headerless split: features, y, family (normal, dos, probe, r2l, u2r), fine_label and unseen."""
    types = T.StructType([T.StructField(c, T.StringType() if c in CONNECTION_TEXT else T.DoubleType()) for c in CONNECTION_COLUMNS])
    raw = expect_rows(spark.read.schema(types).option("mode", "FAILFAST").csv(path), rows)
    fine = fields.attack_name(F.col("label"))
    made = raw.withColumn("su_attempted", F.least(F.greatest("su_attempted", F.lit(0.0)), F.lit(1.0))).withColumn("fine_label", fine).withColumn("family", fields.attack_category(F.col("label")))
    made = made.withColumn("y", (F.col("family") != "normal").cast("int")).withColumn("unseen", F.col("fine_label").isin(UNSEEN)).drop("label")
    return made.drop(*CONNECTION_DROPPED) if drop_artifacts else made


def connection_splits(spark: SparkSession, paths: dict[str, str], drop_artifacts: bool = True) -> DataFrame:
    """All splits with their name as ``split``; a split is filtered for, never mixed with another."""
    return reduce(DataFrame.unionByName, [connections(spark, p, None, drop_artifacts).withColumn("split", F.lit(name)) for name, p in paths.items()])


def labelled_flows(spark: SparkSession, path: str, rows: int | None = None, dropped: tuple[str, ...] = ("id",), text: tuple[str, ...] = ("proto", "service", "state")) -> DataFrame:
    """A CSV with header: numbers (null where they can't be read), family and y; the family and the binary label must agree."""
    raw = spark.read.option("header", True).csv(path)
    raw = expect_rows(raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns]), rows)
    missing = {"attack_cat", "label", *text} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    numbers = [c for c in raw.columns if c not in (*text, "attack_cat", "label", *dropped)]
    made = raw.select(*[F.lower(F.trim(c)).alias(c) for c in text], *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in numbers], fields.family(F.col("attack_cat")).alias("family"), F.col("label").cast("int").alias("y"))
    agree = (F.col("family") != "Normal").cast("int") == F.col("y")
    return made.withColumn("y", F.when(agree, F.col("y")).otherwise(F.raise_error(F.concat(F.lit("label and family disagree: "), F.col("family")))))


def day(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A day of flows in Latin-1: plain headers (a repeated one counts once), labels, times (null where none can be read) and the day's name."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    heads = [c.strip() for c in raw.columns]
    plain = [c for c in heads if not (c.endswith(".1") and c[:-2] in heads)]
    raw = raw.toDF(*heads).select(*[F.col(f"`{c}`") for c in plain])
    return raw.withColumn("Label", fields.flow_label(F.col("Label"))).withColumn("Timestamp", fields.time_of(F.col("Timestamp"))).withColumn("day", F.lit(name))


def day_split(days: dict[str, DataFrame], train: list[str], test: list[str], keep_leaks: bool = False, drop_duplicates: bool = True) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by day, over the columns that all days have.

    Exact duplicates go within each side, before the columns that name a flow do. Columns with one value in training go, too.
    """
    common = [c for c in days[train[0]].columns if all(c in df.columns for df in days.values())]

    def side(names: list[str]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [days[n].select(*[F.col(f"`{c}`") for c in common]) for n in names])
        return rows.dropDuplicates() if drop_duplicates else rows

    left, right = side(train), side(test)
    gone = set(DAY_ENTITY) | (set() if keep_leaks else set(DAY_LEAKS)) | {"Label", "day"}
    gone -= set(DAY_LEAKS) if keep_leaks else set()
    numbers = [c for c in common if c not in gone]
    as_number = lambda c: scoring.finite_or_null(F.expr(f"try_cast(`{c}` AS double)"))
    varied = left.agg(*[F.count_distinct(as_number(c)).alias(f"n{k}") for k, c in enumerate(numbers)]).first()  # one row
    kept = [c for k, c in enumerate(numbers) if varied[f"n{k}"] > 1]
    meta = [F.col(f"`{c}`").alias(f"meta {c}") for c in ("Src IP", "Dst IP", "Dst Port", "Timestamp") if c in common]
    shape = lambda df: df.select(*[as_number(c).alias(c) for c in kept], *meta, F.col("Label").alias("family"), (F.col("Label") != "BENIGN").cast("int").alias("y"), "day")
    return shape(left), shape(right)


def baseline(spark: SparkSession, path: str, required: list[str], address: str, excluded: list[str]) -> DataFrame:
    """Flows of one's own from Parquet or CSV, without those of the excluded addresses; a missing column is an error."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)
    missing = [c for c in [*required, address] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.where(~F.coalesce(F.col(address).isin(excluded), F.lit(False)))


def sample_pool(spark: SparkSession, path: str) -> DataFrame:
    """Rows kept as compressed CSV."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)
