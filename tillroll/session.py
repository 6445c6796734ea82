"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution does the size checks and the skew splitting that the
# plans rely on: a join side is broadcast only once its measured shuffle size
# is below the threshold, and an oversized join partition is split even when
# that costs the following aggregate one more exchange.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows of a few folders are written without a sort, and its spill; a task
    # that meets more folders than this sorts the rest of its rows.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
}


def apply_runtime_settings(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **extra: str
) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tillroll")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for name, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A machine-local folder is set up only for a local master, where driver and
    executors are the same process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tillroll-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder, so concurrent runs never collide."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


# Folders that stored() made inside the innermost scratch() block.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table below the shared folder and read it back.

    Later steps start from files that outlive any executor, instead of
    recomputing the joins above them. The files stay until the end of the
    :func:`scratch` block around the call, or, without one, until their owner
    deletes the shared folder.
    """
    path = run_folder(df.sparkSession, purpose)
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables stored inside, once the results are written.

    with scratch(spark):
        customer_segments(facts).write.parquet(target)
    """
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            remove_folder(spark, path)
        _made.reset(token)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    folder, system = _file_system(spark, path)
    system.delete(folder, True)


def move_folder(spark: SparkSession, path: str, target: str) -> None:
    """Move a folder to a place in the same file system where nothing lies."""
    folder, system = _file_system(spark, path)
    goal, _ = _file_system(spark, target)
    system.mkdirs(goal.getParent())
    if not system.rename(folder, goal):
        raise OSError(f"{path} could not be moved to {target}")


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a folder, in order; none if it does not exist."""
    folder, system = _file_system(spark, path)
    if not system.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(folder) if s.isDirectory())


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
