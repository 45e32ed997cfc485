"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in a single-process session without one.

    Raises ``ValueError`` on a cluster that names no folder: a machine-local one would lose data with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if configured is None and current.isDefined():
        return current.get()
    if configured is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="quernstone-")
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the driver ends in good order."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    atexit.register(_deleted, held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), held)
    return path


def _deleted(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # noqa: BLE001 - the application's JVM may be gone already
        pass


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as row files; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Stage:
    """A table in the shared folder, and what was counted while it was written."""

    df: DataFrame
    counts: dict[str, int]
    path: str

    def drop(self) -> None:
        """Deletes the table; only for stages that nothing will read again."""
        held = self.df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        _deleted(held.getFileSystem(self.df.sparkSession.sparkContext._jsc.hadoopConfiguration()), held)


def stage(df: DataFrame, **counts: Column) -> Stage:
    """``df`` computed once and kept as a Parquet table in the shared folder (columns can be pruned when it is read).

    ``counts`` are aggregates that are taken on the way, without a job of their own.
    """
    path = own_folder(df.sparkSession, "stage")
    seen = Observation()
    kept = df.observe(seen, *[c.alias(name) for name, c in counts.items()]) if counts else df
    kept.write.parquet(path)
    return Stage(df.sparkSession.read.schema(df.schema).parquet(path), dict(seen.get) if counts else {}, path)


def staged(df: DataFrame) -> DataFrame:
    """The table of ``stage``."""
    return stage(df).df
