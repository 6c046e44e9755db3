"""Spark session defaults for this library."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold at any scale; sizes of partitions are left to adaptive execution.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "netloom", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one with this library's defaults."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, or, where that is unset on one machine, in a temporary folder that is set."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    path = f"{root.rstrip('/')}/{sc.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    return path if path.startswith("file:") or "://" in path else f"file://{path}"
