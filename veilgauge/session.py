"""Session settings the library relies on, and scratch tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CONFIG = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Two columns may differ only in letter case.
    "spark.sql.caseSensitive": "true",
}
# Small inputs only: keep the cores busy where stages fan out from little data.
LOCAL_CONFIG = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
SCRATCH_KEY = "spark.checkpoint.dir"
_scopes: list[str] = []


def local_session(cores: str = "8", memory: str = "8g", name: str = "veilgauge") -> SparkSession:
    """A session for tests and the local benchmark; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", cores))
    for key, value in {**CONFIG, **LOCAL_CONFIG}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session without one gets a folder of its own, gone at exit."""
    context = spark.sparkContext
    shared = spark.conf.get(SCRATCH_KEY, None) or context.getCheckpointDir()
    if not shared:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"{SCRATCH_KEY} has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="veilgauge-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        shared = context.getCheckpointDir()
    return shared.rstrip("/")


def materialise(df: DataFrame) -> tuple[DataFrame, int]:
    """Write an intermediate result once to the shared folder; return it with its row count.

    Later steps read the files, so a lost executor costs a re-read and not the
    whole lineage, and the planner knows the real size.
    """
    path = f"{_scopes[-1] if _scopes else scratch_dir(df.sparkSession)}/veilgauge-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]


def pin(df: DataFrame) -> DataFrame:
    """Turn a result with one row per column, metric or action into a local table.

    Only for frames whose row count does not depend on the data.
    """
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Within it, `materialise` writes below one folder, which is deleted at the end.

    Results computed inside have to be written or collected before it ends.
    """
    folder = f"{scratch_dir(spark)}/veilgauge-scope-{uuid.uuid4().hex}"
    _scopes.append(folder)
    try:
        yield
    finally:
        _scopes.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
