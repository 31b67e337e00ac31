"""Session helpers shared by tests, the benchmark and the flows."""
from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "gleaner", cpus: str = "8") -> SparkSession:
    """A local session with the settings the results depend on (UTC, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data, from ``spark.checkpoint.dir``.

    Only a local master may go without: driver and executors are one process
    there, and a temporary folder serves.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage and cut its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Arrow functions are pickled by module name, so workers must be able to
    import the package wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        stem = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), root.name)
        spark.sparkContext.addPyFile(shutil.make_archive(stem, "zip", root.parent, root.name))
        _shipped.add(app)
