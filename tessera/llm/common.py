"""Tables, shared storage and small column helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary one on a local master, as in tests; elsewhere an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.gettempdir()}/tessera-shared"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tessera/{uuid.uuid4().hex}"


def saved(df: DataFrame, where: str) -> DataFrame:
    """Writes df as Parquet and reads it back: a cut in the lineage that survives lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in upper or lower case."""
    have = {c.lower() for c in df.columns}
    while f"_{name}" in have:
        name = f"_{name}"
    return f"_{name}"


def words(text: Column) -> Column:
    """Words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for the row."""
    return F.transform(F.array(value), body)[0]


def fixed(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """df with keep and the columns, evaluated here and once: the optimizer moves neither filters nor projections through a generator,
    so no expression is copied into a filter or, element by element, into a lambda function."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))
