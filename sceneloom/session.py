"""Session factory used by tests, the bench and the command line."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sceneloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for; a running session is reused."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SCENELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def make_importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver did, whatever their working folder. On a cluster, install the package or pass it by --py-files."""
    root, environment = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, environment.get("PYTHONPATH", "")) if x)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed and cut from its lineage, in the shared folder that spark.checkpoint.dir names; one's own folder only where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not configured:
            local = context.master == "local" or context.master.startswith("local[")
            configured = "file://" + tempfile.mkdtemp(prefix="sceneloom-") if local else df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sceneloom_checkpoints"
        context.setCheckpointDir(configured)
    return df.checkpoint()
