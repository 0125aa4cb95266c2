"""Readers and writers of JSON: technique bundles, lines, audit logs, fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spillway.functions import fields

OBJECTS = """objects array<struct<type:string, id:string, name:string, description:string, revoked:boolean, x_mitre_deprecated:boolean, x_mitre_is_subtechnique:boolean, x_mitre_detection:string, x_mitre_platforms:array<string>,
 x_mitre_data_sources:array<string>, kill_chain_phases:array<struct<phase_name:string>>, external_references:array<struct<source_name:string, external_id:string, url:string>>, relationship_type:string, source_ref:string, target_ref:string>>"""


def techniques(spark: SparkSession, path: str, most: int = 1200) -> DataFrame:
    """Attack techniques of a bundle, one row each by id, without revoked and deprecated ones; what detects one stands with it."""
    every = spark.read.schema(OBJECTS).option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")
    live = every.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    known = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))
    found = live.where("type = 'attack-pattern'").select(
        F.col("id").alias("_id"), known["external_id"].alias("technique_id"), "name", fields.cut_at_sentence(F.col("description"), most).alias("description"), F.transform("kill_chain_phases", lambda p: p["phase_name"]).alias("tactics"),
        F.col("x_mitre_platforms").alias("platforms"), F.col("x_mitre_data_sources").alias("data_sources"), F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_subtechnique"), known["url"].alias("url"), F.col("x_mitre_detection").alias("own"),
    )
    detects = live.where("relationship_type = 'detects'").select(F.col("source_ref").alias("_by"), F.col("target_ref").alias("_id"))
    texts = live.where("type <> 'relationship'").select(F.col("id").alias("_by"), F.coalesce("description", "name").alias("said"))
    said = detects.join(texts, "_by").groupBy("_id").agg(F.array_join(F.array_sort(F.collect_set("said")), " ").alias("said"))
    return found.join(said, "_id", "left").withColumn("detection", F.coalesce(F.nullif(F.col("own"), F.lit("")), "said", F.lit(""))).where("technique_id is not null").drop("_id", "own", "said")


def technique_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("techniques"), F.count_if("is_subtechnique").alias("subtechniques"), F.count_if(F.col("detection") != "").alias("with_detection"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tactics")))).alias("tactics"))


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each line of JSON; a line that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def fixture(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """The rows under ``kind`` (alerts or incidents) of one JSON document."""
    return spark.read.schema(f"{kind} array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode(kind).alias("x")).select("x.*")


def report(df: DataFrame, path: str) -> None:
    """Write rows as lines of JSON; numbers that aren't finite become null."""
    clean = {f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    df.withColumns(clean).write.json(path)
