"""Fail-closed checks: bad input raises, rows are never skipped.

All the conditions of a table are counted in one aggregate, so a table is read
once however many things are asked of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """Input that an operator refuses."""


def require(df: DataFrame, what: str, **bad: Column) -> DataFrame:
    """The table itself, if no row meets any of the named conditions; a null condition counts as met."""
    got = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in bad.items()]).first()
    found = {k: got[k] for k in bad if got[k]}
    if found:
        raise CheckFailed(f"{what}: " + ", ".join(f"{k} in {n} rows" for k, n in found.items()))
    return df


def require_unique(df: DataFrame, what: str, *keys: str) -> DataFrame:
    """The table itself, if no two rows share the keys."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect()
    if twice:
        raise CheckFailed(f"{what}: repeated keys, such as " + ", ".join(str(tuple(r)[:-1]) for r in twice))
    return df


def require_contiguous(df: DataFrame, what: str, index: str) -> int:
    """The number of rows, if ``index`` runs over 0..n-1 without gap or repeat."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi")).first()
    if r.n and not (r.d == r.n and r.lo == 0 and r.hi == r.n - 1):
        raise CheckFailed(f"{what}: {index} does not run from 0 to {r.n - 1}")
    return r.n


def require_same_keys(left: DataFrame, right: DataFrame, what: str, *keys: str) -> None:
    """Raise unless both tables have the same keys, each once."""
    both = left.select(*keys).withColumn("__l", F.lit(1)).join(right.select(*keys).withColumn("__r", F.lit(1)), list(keys), "full_outer")
    r = both.groupBy(*keys).agg(F.count("__l").alias("l"), F.count("__r").alias("r")).agg(F.count_if(F.col("l") == 0).alias("extra"), F.count_if(F.col("r") == 0).alias("missing"), F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated")).first()
    if r.extra or r.missing or r.repeated:
        raise CheckFailed(f"{what}: {r.missing} keys missing, {r.extra} unexpected, {r.repeated} repeated")


def bounded(value: Column, low: float, high: float, what: str) -> Column:
    """The value, raising where it is outside [low, high]."""
    return F.when(value.between(low, high), value).otherwise(F.raise_error(F.concat(F.lit(f"{what} is outside [{low}, {high}]: "), value.cast("string"))).cast("double"))


def coerce_bool(value: Column, what: str) -> Column:
    """A real boolean from text that spells one; "false" is false, and anything else raises."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).when(value.isNull(), None).otherwise(F.raise_error(F.concat(F.lit(f"{what} is not a boolean: "), low)).cast("boolean"))


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that is small by nature; more than ``most`` raise, rather than some being left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise CheckFailed(f"{what}: more than {most} rows")
    return rows
