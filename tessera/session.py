"""Session construction and the few settings every query relies on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", cores: str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; a cluster brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))  # rows hold minutes of sound
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the workers, so that functions in it load there wherever the driver was started from. Not needed where it is installed on all nodes."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tessera-")  # read by the driver alone, which serves it
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tessera", "zip", top, "tessera"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
