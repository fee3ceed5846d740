"""Collects the driver's queries and their SQL from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def merged(*parts: dict) -> dict:
    """One dict of all parts; a name given twice is an error."""
    out: dict = {}
    for part in parts:
        twice = out.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= part
    return out
