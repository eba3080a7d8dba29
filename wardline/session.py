"""Session settings the jobs rely on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession

# Safe on any cluster; sizes such as shuffle partitions stay with the submitter.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Window events join: keep the skew split even where the result feeds an aggregation.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A line that repeats a member is an event all the same; its last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Rows that a Python task receives at a time; texts can be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}
# Only possible when the session starts. Recording the call site of every column expression
# costs more than building the plans.
START_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A window summary alone has some hundred generated classes; the default cache of 100
    # would compile them anew on every run.
    "spark.sql.codegen.cache.maxEntries": "5000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wardline")
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else 8))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SESSION_CONF, **START_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set (tests)."""
    configured = (
        spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    )
    if configured is None and spark.sparkContext.master.startswith("local"):
        configured = tempfile.mkdtemp(prefix="wardline-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if configured is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for one run under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows that one task widens, and may then have to sort.
TASK_ROWS = 200_000


def fan_out(df: DataFrame, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Spread an input over the cores, and over tasks of ``task_rows``, before costly per-row work.

    Stored rows are far smaller than what is made of them, so splits of a fixed size hold too many.
    Only a scan of fewer partitions than that is moved. Counting reads the footers of the files.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, ceil(df.count() / task_rows))
    return df.repartition(tasks, *keys) if df.rdd.getNumPartitions() < tasks else df
