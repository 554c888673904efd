"""The session used by tests, the bench and the comparison tool."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ARCHIVE = "coastgrid.zip"


def local_session(cpus: str | None = None) -> SparkSession:
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("coastgrid")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # Shuffled rows are small and are exploded afterwards: keep every core busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers the library, wherever the driver was started from.

    The same as ``--py-files coastgrid.zip``; done once per application.
    """
    context = spark.sparkContext
    if any(name.endswith(ARCHIVE) for name in context.listFiles):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="coastgrid-")) / ARCHIVE
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted((root / "coastgrid").rglob("*.py")):
            archive.write(source, source.relative_to(root))
    context.addPyFile(str(target))
