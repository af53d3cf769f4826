"""Session helpers: a local session for tests/bench, and the checkpoint folder."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(
    cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "trajspark", checkpoints: str = "/tmp/trajspark-checkpoints"
) -> SparkSession:
    """A local-mode session for tests and the benchmark (the UI stays off), with its own checkpoint folder."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TRAJSPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoints)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    It is never made up: an unset folder is an error, because a machine-local one
    does not survive the loss of an executor. Tests and the benchmark name their own
    (see ``local_session``).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss.

    The result keeps its partitioning and the order inside partitions. Nothing is kept
    on executors' disks beside the checkpoint files.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_written: list[str] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder; ``clean`` removes it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clean(spark: SparkSession, keep: int = 0) -> int:
    """Remove the folders that this process's jobs wrote (but for the first ``keep``), and return their number.

    Jobs that cut their lineage leave their tables in the shared folder, as results are
    read from them. Call this when the results are written or no longer needed.
    """
    gone = _written[keep:]
    del _written[keep:]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession):
    """Remove at the end what jobs inside wrote to the shared folder: ``with scratch(spark): query(...).write...``."""
    before = len(_written)
    try:
        yield
    finally:
        clean(spark, before)


def write_table(df, tag: str = "tbl"):
    """Cut lineage by writing a Parquet table into the shared checkpoint folder.

    One job (a reliable checkpoint runs the plan twice unless cached); the
    read-back has no known partitioning, so use ``cut_lineage`` where a
    later join relies on the partitioning or a partition's row order.
    """
    path = new_folder(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
