"""Session settings used by tests, bench and scripts; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small tables are worth a task a core where tasks start at once.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.files.openCostInBytes": "65536",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session; ``conf`` takes further settings with ``__`` in place of dots."""
    n = cores or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName("quernstone")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(n), "spark.driver.memory": memory}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
