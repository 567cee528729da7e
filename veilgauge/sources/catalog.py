"""Dataset versions, analyses, audit trail and job states as append-only Parquet tables.

Nothing is updated in place: a new version is a new folder, and the current
state of a job or analysis is the latest of its appended rows.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from veilgauge.operators import sketches
from veilgauge.operators.latest import latest_per_key, newest

TABLES = {
    "datasets": "id string, name string, path string, row_count bigint, column_count int, "
                "created_at timestamp, is_demo boolean, parent_id string",
    "analyses": "id string, dataset_id string, kind string, result_json string, created_at timestamp",
    "audit_log": "id string, dataset_id string, action string, detail string, created_at timestamp",
    "jobs": "job_id string, dataset_id string, status string, created_at timestamp, updated_at timestamp, "
            "state_json string",
}
#: File a log row lies in, and files that a compacted one replaces.
FILE, REPLACES = "__file", "__replaces"
AUDIT_LIMIT = 200
JOB_LIMIT = 50


def new_id() -> str:
    return uuid.uuid4().hex[:12]


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _append(self, table: str, row: tuple) -> None:
        self.spark.createDataFrame([row], TABLES[table]).coalesce(1).write.mode("append").parquet(
            f"{self.root}/_{table}")

    def _files(self, name: str) -> DataFrame | None:
        """All rows with the file they lie in and what that file replaces; None before the first line."""
        try:
            read = self.spark.read.schema(f"{TABLES[name]}, {REPLACES} array<string>").parquet(f"{self.root}/_{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return read.withColumn(FILE, F.col("_metadata.file_name"))

    def table(self, name: str) -> DataFrame:
        rows = self._files(name)
        if rows is None:
            return self.spark.createDataFrame([], TABLES[name])
        replaced = rows.where(F.col(REPLACES).isNotNull()).select(F.explode(REPLACES).alias(FILE)).distinct()
        return rows.where(F.col(REPLACES).isNull()).join(replaced, FILE, "left_anti").drop(FILE, REPLACES)

    def compact(self, name: str) -> None:
        """Join the small files of a log table, one per line, to one file.

        The new file names those it replaces, and appears as a whole or not at all. Readers
        pass over replaced files, so a crash before they are deleted changes nothing, and a
        line appended meanwhile lies in a file that is not replaced.
        """
        found = self._files(name)
        if found is None:
            return
        files = sorted(r[0] for r in found.select(FILE).distinct().collect())
        if len(files) < 2:
            return
        gone = {r[0] for r in found.where(F.col(REPLACES).isNotNull()).select(F.explode(REPLACES)).collect()}
        kept = found.where(F.col(REPLACES).isNull() & F.col(FILE).isin([f for f in files if f not in gone])).drop(FILE)
        listed = self.spark.createDataFrame([(*[None] * (len(kept.columns) - 1), files)], kept.schema)
        kept.unionByName(listed).coalesce(1).write.mode("append").parquet(f"{self.root}/_{name}")
        self._delete(name, files)

    def _delete(self, name: str, files: list[str]) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_{name}")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for file in files:
            system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder, file), False)

    # --- versions ---
    def save(self, df: DataFrame, name: str, parent_id: str | None = None, is_demo: bool = False, profiled: bool = False) -> str:
        """Write a new version; an existing one is never overwritten. ``profiled`` keeps its mergeable profile beside it."""
        dataset_id = new_id()
        path = f"{self.root}/{dataset_id}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
        rows = seen.get["rows"]
        self._append("datasets", (dataset_id, name, path, rows, len(df.columns), _now(), is_demo, parent_id))
        self.log(dataset_id, "save", f"rows={rows}")
        if profiled:
            self._keep_profile(dataset_id, sketches.column_sketches(self.spark.read.parquet(path)))
        return dataset_id

    def _keep_profile(self, dataset_id: str, profile: DataFrame) -> None:
        profile.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/_profile/{dataset_id}")

    def profile(self, dataset_id: str) -> DataFrame:
        """The mergeable profile kept with a version."""
        try:
            return self.spark.read.parquet(f"{self.root}/_profile/{dataset_id}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise KeyError(f"no profile of {dataset_id}") from error

    def grow(self, dataset_id: str, rows: DataFrame) -> str:
        """A new version with further rows; its profile is the old state merged with the state of the new rows."""
        record = self.lookup(dataset_id).first()
        fresh = sketches.column_sketches(rows)
        grown = self.save(self.load(dataset_id).unionByName(rows), record["name"], dataset_id)
        self._keep_profile(grown, sketches.merged(self.profile(dataset_id), fresh))
        return grown

    def lookup(self, dataset_id: str) -> DataFrame:
        return self.table("datasets").where(F.col("id") == dataset_id)

    def load(self, dataset_id: str) -> DataFrame:
        record = self.lookup(dataset_id).first()
        if record is None:
            raise KeyError(f"no dataset {dataset_id}")
        return self.spark.read.parquet(record["path"])

    # --- analyses ---
    def save_analysis(self, dataset_id: str, kind: str, result: dict) -> None:
        self._append("analyses", (new_id(), dataset_id, kind, json.dumps(result), _now()))

    def latest_analyses(self) -> DataFrame:
        return latest_per_key(self.table("analyses"), ["dataset_id", "kind"], ["created_at", "id"])

    def latest_analysis(self, dataset_id: str, kind: str) -> DataFrame:
        rows = self.table("analyses").where((F.col("dataset_id") == dataset_id) & (F.col("kind") == kind))
        return newest(rows, ["created_at", "id"], 1)

    # --- audit ---
    def log(self, dataset_id: str, action: str, detail: str = "") -> None:
        """Action metadata only; never values of the data."""
        self._append("audit_log", (new_id(), dataset_id, action, detail, _now()))

    def audit_tail(self, dataset_id: str | None = None, limit: int = AUDIT_LIMIT) -> DataFrame:
        rows = self.table("audit_log")
        if dataset_id is not None:
            rows = rows.where(F.col("dataset_id") == dataset_id)
        return newest(rows, ["created_at", "id"], limit)

    # --- jobs ---
    def save_job(self, job_id: str, dataset_id: str, status: str, state: dict, created_at: datetime | None = None):
        now = _now()
        self._append("jobs", (job_id, dataset_id, status, created_at or now, now, json.dumps(state)))

    def jobs(self, limit: int = JOB_LIMIT) -> DataFrame:
        current = latest_per_key(self.table("jobs"), ["job_id"], ["updated_at", "status", "state_json"])
        return newest(current.drop("state_json"), ["created_at", "job_id"], limit)
