"""Rows that change, kept as commits of Parquet in a shared folder: alerts, incidents, verdicts.

A commit is a folder of new rows and a numbered file that names it. The file is
made only if there is none of its number, so of two writers who saw the same
state one has to look again. A token that was committed before is not committed
again: a batch that is run twice counts once. Data without a commit, as a lost
writer leaves it, are never read. The latest row of a key is what holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another commit came first."""


class Records:
    """The rows under ``path``, one for each value of ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self._stored = f"{schema}, _commit long"

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def commits(self) -> list[dict]:
        """What each commit says, in order; a file that its writer did not finish counts for nothing, but its number is taken."""
        fs, top = self._fs(f"{self.path}/commits")
        if not fs.exists(top):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(top))
        lines = {r["file"].rpartition("/")[2]: r["value"] for r in self.spark.read.text(f"{self.path}/commits").select("value", F.input_file_name().alias("file")).collect()} if names else {}  # a line for each commit
        out = []
        for name in names:
            try:
                out.append({"version": int(name), **json.loads(lines.get(name, ""))})
            except ValueError:
                out.append({"version": int(name), "data": None, "token": None, "whole": False})
        return out

    def version(self) -> int:
        return max((c["version"] for c in self.commits()), default=0)

    def state(self, version: int | None = None) -> DataFrame:
        """The latest row of each key, of all commits or those up to ``version``."""
        read = [c for c in self.commits() if version is None or c["version"] <= version]
        first = max((k for k, c in enumerate(read) if c["whole"]), default=0)  # what a snapshot says needs no older commit
        folders = [f"{self.path}/data/{c['data']}" for c in read[first:] if c["data"]]
        names = [x.split()[0] for x in self.schema.split(", ")]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self._stored).parquet(*folders)
        rest = F.struct(*[F.col(f"`{c}`") for c in names if c not in self.keys])
        return rows.groupBy(*self.keys).agg(F.max_by(rest, "_commit").alias("_row")).select(*self.keys, "_row.*").select(*names)

    def commit(self, rows: DataFrame, seen: int | None = None, token: str | None = None, whole: bool = False) -> int:
        """Add ``rows`` (of a key that comes more than once, any one) and give the version that has them.

        With ``seen`` the commit holds only if that is the last version still, else
        it is a Conflict; without it the next free number is taken. A ``token`` that
        is there already gives its version and changes nothing.
        """
        told = self.commits()
        done = next((c["version"] for c in told if token is not None and c["token"] == token), None)
        if done:
            return done
        last = max((c["version"] for c in told), default=0)
        if seen is not None and last != seen:
            raise Conflict(f"version {last} came after {seen}")
        names = [x.split()[0] for x in self.schema.split(", ")]
        once = rows.select(*[F.col(f"`{c}`") for c in names]).dropDuplicates(self.keys)
        while True:
            data = f"{last + 1}-{uuid.uuid4().hex}"
            once.withColumn("_commit", F.lit(last + 1).cast("long")).write.parquet(f"{self.path}/data/{data}")
            if self._numbered(last + 1, {"data": data, "token": token, "whole": whole}):
                return last + 1
            if seen is not None:
                raise Conflict(f"version {last + 1} came first")
            told = self.commits()
            done = next((c["version"] for c in told if token is not None and c["token"] == token), None)
            if done:
                return done
            last = max(c["version"] for c in told)

    def _numbered(self, version: int, said: dict) -> bool:
        fs, where = self._fs(f"{self.path}/commits/{version:012d}")
        try:
            out = fs.create(where, False)
        except Exception as e:  # py4j gives Java's exception in its own
            if "exists" in str(e):
                return False
            raise
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        return True

    def compact(self) -> int:
        """A commit that holds the whole state, so that readers need no older one; a Conflict if another came first."""
        last = self.version()
        return self.commit(self.state(last), seen=last, whole=True)

    def sink(self, stream: DataFrame, name: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
        """A writer of ``stream`` whose batches go through ``prepare`` and are committed once each, however often they are run."""
        put = lambda batch, number: self.commit(prepare(batch), token=f"{name}:{number}")
        return stream.writeStream.foreachBatch(lambda batch, number: put(batch, number) and None).option("checkpointLocation", checkpoint)


VERDICTS = "target_kind string, target_id string, verdict string, actor string, recorded_at timestamp, p_attack double, family string, promoted boolean, promoted_by string, promoted_at timestamp"


class Verdicts:
    """Verdicts that wait for a second person's approval before they teach."""

    def __init__(self, spark: SparkSession, path: str):
        self.records = Records(spark, path, VERDICTS, ["target_kind", "target_id"])

    def record(self, rows: DataFrame, tries: int = 5) -> DataFrame:
        """Put verdicts (the first seven columns) in the queue; gives those that were refused, as a promoted one holds.

        Of several for one target in ``rows`` the latest counts.
        """
        keys = self.records.keys
        latest = rows.groupBy(*keys).agg(F.max(F.struct("recorded_at", "actor", "verdict", "p_attack", "family")).alias("x")).select(*keys, "x.*")
        for _ in range(tries):
            seen = self.records.version()
            locked = self.records.state(seen).where("promoted").select(*keys)
            new = latest.join(locked, keys, "left_anti").withColumns({"promoted": F.lit(False), "promoted_by": F.lit(None).cast("string"), "promoted_at": F.lit(None).cast("timestamp")})
            try:
                self.records.commit(new, seen)
                return latest.join(locked, keys)
            except Conflict:
                continue
        raise Conflict(f"others came first {tries} times")

    def pending(self) -> DataFrame:
        return self.records.state().where("NOT promoted")

    def promote(self, asked: DataFrame, approver: str, at: str, tries: int = 5) -> int:
        """Promote the verdicts of ``asked`` (target_kind, target_id and the ``expected`` label that the approver saw; null: any); gives how many.

        Not promoted are verdicts of the approver's own, changed ones, and those
        that are promoted already.
        """
        keys = self.records.keys
        for _ in range(tries):
            seen = self.records.version()
            waiting = self.records.state(seen).where("NOT promoted").where(F.col("actor") != approver)
            good = waiting.join(asked.select(*keys, "expected").distinct(), keys).where(F.col("expected").isNull() | (F.col("expected") == F.col("verdict")))
            good = good.drop("expected").withColumns({"promoted": F.lit(True), "promoted_by": F.lit(approver), "promoted_at": F.lit(at).cast("timestamp")})
            n = good.dropDuplicates(keys).count()
            if not n:
                return 0
            try:
                self.records.commit(good, seen)
                return n
            except Conflict:
                continue
        raise Conflict(f"others came first {tries} times")

    def training_rows(self, alerts: DataFrame) -> DataFrame:
        """Alerts with ``verdict`` and ``promoted_by``: of each its own promoted verdict, else that of its incident.

        ``alerts`` has alert_id, incident_id and ``features`` (null: left out).
        """
        taught = self.records.state().where("promoted").select("target_kind", "target_id", "verdict", "promoted_by")
        both = alerts.where("features IS NOT NULL").select("*", F.explode(F.array(F.struct(F.lit("alert").alias("target_kind"), F.col("alert_id").alias("target_id")), F.struct(F.lit("incident").alias("target_kind"), F.col("incident_id").alias("target_id")))).alias("_of"))
        found = both.join(taught, (F.col("_of.target_kind") == F.col("target_kind")) & (F.col("_of.target_id") == F.col("target_id")))
        best = found.groupBy("alert_id").agg(F.min(F.struct("target_kind", "verdict", "promoted_by")).alias("x"))
        return alerts.join(best, "alert_id").select(alerts["*"], "x.verdict", "x.promoted_by")
