"""Versioned runs: tables of a run lie under its own folder and count once its marker is there; review events are only ever added."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPLETE, FAILED = "complete.json", "failed.json"
EVENTS = "run_id string, finding_id string, seq long, pass int, state string, status string, scan_fingerprint string, cache_key string, answer string, error string"


class RunStore:
    """Runs under one base folder of any file system that Spark reaches.

    A run writes its tables and publishes them by one renamed marker file, which
    names them with their rows and digests. Readers see published runs only, so
    a run that fails, or is still going on, never hides the one before it.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self.fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def start(self) -> str:
        """A new run's id; ids sort by time."""
        return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def folder(self, run_id: str) -> str:
        return f"{self.base}/runs/{run_id}"

    def _put(self, path: str, text: str) -> None:
        """The file with its whole text, or no file."""
        temp = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(temp)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.fs.rename(temp, self._path(path)):
            self.fs.delete(temp, False)
            raise OSError(f"{path} is there already or cannot be written")

    def _get(self, path: str) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(path).collect()))  # a marker of a few lines

    def publish(self, run_id: str, tables: dict[str, DataFrame], **facts: str) -> None:
        """Writes all tables, then the marker; an error on the way leaves a failure marker and is raised."""
        try:
            listed = {}
            for name, df in tables.items():
                path = f"{self.folder(run_id)}/{name}"
                df.write.mode("errorifexists").parquet(path)
                rows = self.spark.read.schema(df.schema).parquet(path)
                one = rows.agg(F.count("*"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
                listed[name] = {"rows": one[0], "digest": str(one[1]), "schema": df.schema.json()}
            self._put(f"{self.folder(run_id)}/{COMPLETE}", json.dumps({"run_id": run_id, "tables": listed, "facts": facts}, sort_keys=True))
        except Exception as e:
            self.fail(run_id, f"{type(e).__name__}: {str(e)[:1000]}")
            raise

    def fail(self, run_id: str, reason: str) -> None:
        """Says why a run has no result; a published run stays published."""
        if not self.fs.exists(self._path(f"{self.folder(run_id)}/{COMPLETE}")) and not self.fs.exists(self._path(f"{self.folder(run_id)}/{FAILED}")):
            self._put(f"{self.folder(run_id)}/{FAILED}", json.dumps({"run_id": run_id, "reason": reason}))

    def _ids(self, marker: str) -> list[str]:
        found = self.fs.globStatus(self._path(f"{self.base}/runs/*/{marker}"))
        return sorted(s.getPath().getParent().getName() for s in found or [])

    def runs(self) -> list[str]:
        """Published runs, oldest first."""
        return self._ids(COMPLETE)

    def failures(self) -> dict[str, str]:
        return {r: self._get(f"{self.folder(r)}/{FAILED}")["reason"] for r in self._ids(FAILED)}

    def manifest(self, run_id: str) -> dict:
        return self._get(f"{self.folder(run_id)}/{COMPLETE}")

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        """A table of the run, or of the last published one; rows other than the published ones raise."""
        ids = self.runs()
        if run_id is None and not ids:
            raise ValueError(f"{self.base}: no published run")
        run_id = run_id or ids[-1]
        if run_id not in ids:
            raise ValueError(f"run {run_id} is not published")
        listed = self.manifest(run_id)["tables"][table]
        df = self.spark.read.schema(_schema(listed["schema"])).parquet(f"{self.folder(run_id)}/{table}")
        one = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
        if (one[0], str(one[1])) != (listed["rows"], listed["digest"]):
            raise ValueError(f"{table} of run {run_id} is not what was published")
        return df

    # ---- review events

    def add_events(self, run_id: str, events: DataFrame) -> None:
        """Adds events (finding_id, seq, pass, state, status, ...) of a run; none is ever changed. Columns that are left out are null."""
        columns = [f.split()[0] for f in EVENTS.split(", ")]
        kinds = dict(f.split() for f in EVENTS.split(", "))
        rows = events.select(*((F.lit(run_id) if c == "run_id" else F.col(c) if c in events.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns))
        rows.write.mode("append").partitionBy("run_id").parquet(f"{self.base}/reviews")

    def events(self) -> DataFrame:
        if not self.fs.exists(self._path(f"{self.base}/reviews")):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(f"{self.base}/reviews")


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def review_history(events: DataFrame) -> DataFrame:
    """Every event with its place in its finding's history: run by run, within it the first pass before the second, and whether it is the last one of its pass."""
    order = [F.col(c) for c in ("run_id", "pass", "seq")]
    whole = Window.partitionBy("finding_id").orderBy(*order)
    last = F.row_number().over(Window.partitionBy("finding_id", "pass").orderBy(*[c.desc() for c in order])) == 1
    return events.withColumn("place", F.row_number().over(whole)).withColumn("last_of_pass", last)


def review_states(findings: DataFrame, events: DataFrame, second_pass: bool) -> DataFrame:
    """finding_id, state, status, n_first, n_second of every finding: its last event, the second pass before the first.

    A finding without an event is PENDING. With a second pass to come, one that
    the first has answered is AUDIT_PENDING and never counts as safe until then.
    """
    one = events.groupBy("finding_id").agg(F.max_by(F.struct("state", "status", "pass"), F.struct("pass", "run_id", "seq")).alias("x"), F.count_if(F.col("pass") == 0).alias("n_first"), F.count_if(F.col("pass") == 1).alias("n_second"))
    waits = F.lit(second_pass) & (F.col("x.pass") == 0) & F.col("x.state").isin("DONE", "FAILED")
    state = F.when(F.col("x").isNull(), "PENDING").when(waits, "AUDIT_PENDING").otherwise(F.col("x.state"))
    status = F.when(F.col("x").isNull() | waits, "NEED_MORE_CONTEXT").otherwise(F.col("x.status"))
    return findings.select("finding_id").distinct().join(one, "finding_id", "left").select("finding_id", state.alias("state"), status.alias("status"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_first", "n_second")))
