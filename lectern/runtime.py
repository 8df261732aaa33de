"""Session-level helpers shared by every operator: reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A machine-local folder is set only where that setting is absent and the master is local (tests).
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def staged(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Later stages then depend on files that outlive any executor, and shared subplans run once.
    The files are removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove the staged files under ``tables``, once everything that reads them has been written itself."""
    for df in tables:
        root = shared_dir(df.sparkSession).removeprefix("file://").rstrip("/")
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            if path.removeprefix("file://").startswith(f"{root}/"):
                _remove(df.sparkSession, path)


def task_count(spark: SparkSession, floor: int = 8) -> int:
    """How many tasks a re-partitioning of small but costly rows should use."""
    return max(floor, spark.sparkContext.defaultParallelism * 2)
