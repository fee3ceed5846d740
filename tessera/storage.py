"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary one on a local master, as in tests; elsewhere an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.gettempdir()}/tessera-shared"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def saved(df: DataFrame, where: str | None = None) -> DataFrame:
    """Writes df as Parquet and reads it back: a cut in the lineage that survives lost executors."""
    where = where or shared_dir(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
