"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

SCALE = 600.0


def seconds(ts):
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def seg(spark: SparkSession, d: str) -> DataFrame:
    """events as segments: user is the file, event type the speaker, ts the start, value the duration."""
    e = table(spark, d, "events")
    start = seconds(F.col("ts"))
    return e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("speaker"), start.alias("start"), (start + F.col("value") * SCALE).alias("end"), (F.col("value") / 500).alias("confidence"), "value")


#: The same in DuckDB.
SEG = f"""seg AS (SELECT user_id AS file_id, event_id AS ord, event_type AS speaker, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value * {SCALE} AS "end", value / 500 AS confidence, value FROM events)"""


def rounded(x: Column, digits: int) -> Column:
    """x rounded as the SQL does it: the scaled number to the nearest whole one, halves away from zero, and what becomes zero keeps its sign (round in Spark gives 0.0 for -0.000001)."""
    y = F.abs(x) * 10.0**digits
    near = F.rint(y)  # halves to even
    whole = F.signum(x) * F.when(y - near == 0.5, near + 1).otherwise(near) / 10.0**digits
    return F.when(F.isnan(whole) | (F.abs(whole) == float("inf")), x).otherwise(whole)


def vec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


VEC = "vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").cast("long").alias("ord"), F.col("role").alias("speaker"), F.col("text"), (F.col("turn") * 5.0).alias("start"), (F.col("turn") * 5.0 + 4).alias("end"))


TURNS = """turns AS (SELECT conv_id AS file_id, CAST(turn AS BIGINT) AS ord, role AS speaker, text, turn * 5.0 AS start, turn * 5.0 + 4 AS "end" FROM conversations)"""
