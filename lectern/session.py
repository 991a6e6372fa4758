"""Session settings."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: For local sessions, where driver and tasks share a disk.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def local_session(cpus: str | int | None = None, name: str = "lectern") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    cores = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "12g"))
        .config("spark.checkpoint.dir", LOCAL_CHECKPOINTS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; only a local session may go without."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return LOCAL_CHECKPOINTS


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once for several readers, whatever executor is lost.

    Texts that overlap, as a page and its windows do, take half the disk or less with zstd.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package wherever they start: once per application, through Spark's own file server."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent
    if getattr(sc, "_lectern_shipped", False) or package.suffix == ".zip" or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._lectern_shipped = True
