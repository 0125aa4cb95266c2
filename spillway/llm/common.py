"""What the operators of this subpackage share: tables, working storage, running totals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that a Python worker gets at once: texts may be long.
BATCH_ROWS = 1000


def batches_of(spark: SparkSession, rows: int) -> str:
    """Set how many rows go to a Python worker at once; returns what was set before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    return before


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches_of(spark, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as
    in tests on one machine, a temporary folder takes its place.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spillway-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/spillway/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside are freed as soon as it has ended."""
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write ``df`` as Parquet; the shuffle files behind it are freed at once."""
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path, partitionBy=list(partition_by) or None)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation beyond the
    written table.
    """
    path = new_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``save`` in as many buckets of ``key`` as shuffles have partitions, so that joins on it move only their other side."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    own = path.rpartition("/")[2].replace("-", "_")
    with shuffles_freed(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(own, format="parquet", path=path)
    return spark.table(own)


def drop_bucketed(df: DataFrame) -> None:
    """Delete a table written by ``save_bucketed``, and its entry in the catalog."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {folder.rpartition('/')[2].replace('-', '_')}")
        drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_saved(*frames: DataFrame) -> None:
    """Delete the files of tables written by ``save`` that no later step reads."""
    for df in frames:
        drop_folder(df.sparkSession, *{f.rpartition("/")[0] for f in df.inputFiles() if "/spillway/" in f})


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns: extra ones, whatever their names, stay out of the work."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Most rows of keys that go to every executor, about 24 bytes each.
MAX_BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose (doc_id, hash of text) is in ``dropped`` (doc_id, hash).

    ``dropped`` is a saved table; while its counted rows are few they go to the
    executors and no text moves, beyond that both sides are shuffled.
    """
    few = dropped.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    keys = dropped.select(F.col("doc_id").alias("_dropped_id"), F.col("hash").alias("_dropped_hash")).distinct()
    same = F.col("_own_id").eqNullSafe(F.col("_dropped_id")) & (F.col("_own_hash") == F.col("_dropped_hash"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_own_id"), text_hash().alias("_own_hash"))
    return own.join(F.broadcast(keys) if few else keys, same, "left_anti").select("_row.*")


def text_hash() -> Column:
    """64 bits of a text; a null one is not an empty one."""
    return F.xxhash64(F.col("text").cast("string"))


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows of the same ``keys`` with a smaller ``block`` or earlier in it.

    ``df`` has a column ``block`` of bounded blocks whose number gives the order
    between them. Only one row for each block and key is sorted across blocks,
    so that no key, however frequent, puts its rows into one task.
    """
    sums = df.groupBy(*keys, "block").agg(F.sum(value).alias("_sum"))
    wide = sums.withColumn("_far", F.floor(F.col("block") / 1024))
    within = Window.partitionBy(*keys, "_far").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = wide.groupBy(*keys, "_far").agg(F.sum("_sum").alias("_far_sum"))
    across = Window.partitionBy(*keys).orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    far = far.select(*keys, "_far", F.coalesce(F.sum("_far_sum").over(across), F.lit(0)).alias("_far_before"))
    before = wide.withColumn("_near_before", F.coalesce(F.sum("_sum").over(within), F.lit(0)))
    before = before.join(far, [*keys, "_far"]).select(*keys, "block", (F.col("_near_before") + F.col("_far_before")).alias("_before"))
    inside = Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(before, [*keys, "block"]).withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before")
