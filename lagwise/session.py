"""Session set-up and the one place that decides where checkpoints go."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of an input table per partition of a shuffle, at most, before adaptive execution joins small partitions again.
PARTITION_ROWS = 250_000
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: The JVM never compiles a method of more bytes; a plan whose generated method is larger runs operator by operator instead.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def build_session(app: str = "lagwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on: UTC, AQE and skew-join handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        METHOD_LIMIT[0]: METHOD_LIMIT[1],
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, so that they need no path of their own to it."""
    context = spark.sparkContext
    if getattr(context, "_lagwise_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lagwise-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = os.path.dirname(os.path.abspath(__file__))
    context.addPyFile(shutil.make_archive(f"{folder}/lagwise", "zip", os.path.dirname(package), os.path.basename(package)))
    context._lagwise_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle starts with."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(INITIAL_PARTITIONS, None) or 0))


def deal_by_rows(df: DataFrame, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Let shuffles start with enough partitions for the rows of an input table, so that a task's share does not grow with it.

    A number fixed for the session gives each task a share of the whole input. The number is only ever raised: adaptive
    execution joins partitions that turn out small.
    """
    spark = df.sparkSession
    needed = math.ceil(df.count() / partition_rows)
    if needed > shuffle_partitions(spark):
        spark.conf.set(INITIAL_PARTITIONS, str(needed))
    return df


def compiled_methods(df: DataFrame) -> DataFrame:
    """Keep generated methods small enough to be compiled, in a session that was not made here as well."""
    df.sparkSession.conf.set(*METHOD_LIMIT)
    return df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder named by ``spark.checkpoint.dir``; fall back to a temporary one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="lagwise-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write to a shared folder and read back: unlike a checkpoint, nothing of the old plan is carried
    along, which matters when a result feeds the next of many iterations."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
