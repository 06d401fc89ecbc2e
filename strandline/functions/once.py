"""Expensive column functions, evaluated once for each distinct input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once_per_value(df: DataFrame, value: Column, function: Callable[[Column], Column], out: str) -> DataFrame:
    """Adds ``out``, the function of a value, computed on the distinct values and joined back; null is a value like any other.

    For functions that run in Python on columns that repeat; where values are
    all different, the function alone is cheaper.
    """
    keyed = df.withColumn("__value", value)
    distinct = keyed.select("__value").distinct()
    made = distinct.select(F.col("__value").alias("__key"), function(F.col("__value")).alias(out))
    return keyed.join(made, F.col("__value").eqNullSafe(F.col("__key"))).drop("__value", "__key")
