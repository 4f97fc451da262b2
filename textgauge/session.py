"""Session helpers shared by tests, the bench and the entry point."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "textgauge", memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and measurements; clusters bring their own."""
    width = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", width)
        .config("spark.textgauge.spread", width)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="textgauge-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster names in spark.checkpoint.dir.

    Only a local session without the setting gets a temporary folder of its own: on a
    cluster, files written to one machine's disk would be lost with that machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/textgauge/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder once, because several steps read it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rehash a scan of one small file over the cores of a local session.

    Off unless ``spark.textgauge.spread`` holds a number of partitions, as local sessions of tests and
    measurements set it. On a cluster a scan is left as it is.
    """
    parts = df.sparkSession.conf.get("spark.textgauge.spread", None)
    return df.repartition(int(parts), *keys) if parts else df
