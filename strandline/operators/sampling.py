"""Deterministic prefixes, shards, splits, samples and mini-batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stride(df: DataFrame, index: str, rank: int, shards: int) -> DataFrame:
    """Rows whose index is ``rank`` modulo ``shards``."""
    return df.filter(F.pmod(F.col(index), F.lit(shards)) == rank)


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def hash_order(*cols: Column, seed: str = "") -> Column:
    """A fixed random order of rows by what is in them."""
    return F.sha2(F.concat_ws("\u0001", F.lit(seed), *[c.cast("string") for c in cols]), 256)


def sample(df: DataFrame, n: int, key: str, seed: str) -> DataFrame:
    """``n`` rows in hash order of a key: a uniform sample without replacement that any engine can repeat."""
    return df.withColumn("__h", hash_order(F.col(key), seed=seed)).orderBy("__h", key).limit(n).drop("__h")


def split_cases(cases: DataFrame, fraction: float) -> DataFrame:
    """Adds split: developer or hidden, per task, in a hash order of its cases (task_id, case_index).

    Of n cases, max(2, round(fraction * n)) but at most n - 2 are for the
    developer; of fewer than four cases one is, and of one case all are hidden.
    """
    w = Window.partitionBy("task_id")
    n = F.count(F.lit(1)).over(w)
    rank = F.row_number().over(w.orderBy(hash_order(F.col("task_id"), F.col("case_index"), seed="tests"), "case_index"))
    dev = F.when(n < 2, 0).when(n < 4, 1).otherwise(F.least(F.greatest(F.lit(2), F.bround(F.lit(fraction) * n, 0).cast("int")), n - 2))
    return cases.withColumn("split", F.when(rank <= dev, "developer").otherwise("hidden"))


#: Rows that one task numbers.
NUMBERED_ROWS = 200_000


def _above(x: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds a value is above, by halving; none for a null."""
    if not bounds:
        return F.lit(0)
    known, start = F.lit(bounds), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        right = (a["lo"] < a["hi"]) & (x > F.get(known, mid))
        return F.struct(F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(right | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, halve, lambda a: a["lo"])


def numbered(df: DataFrame, order: str, *ties: str, out: str = "n") -> DataFrame:
    """Adds a gapless number from 0 in a global order by a numeric column, with no task that sorts the whole table.

    Rows are cut into ranges at approximate quantiles; each range is numbered
    for itself and starts where the ones before it end. A null comes first.
    """
    parts = max(1, df.count() // NUMBERED_ROWS)
    bounds = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    cut = df.withColumn("__b", _above(F.col(order), bounds))
    sizes = cut.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    starts = sizes.select("__b", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy(order, *ties))
    return cut.withColumn("__r", own).join(F.broadcast(starts), "__b").withColumn(out, F.col("__s") + F.col("__r") - 1).drop("__b", "__r", "__s")


def mini_batches(steps: DataFrame, size: int, ranks: int, order: str = "row_id") -> DataFrame:
    """Adds mini_batch and rank to step rows: trajectories in order of first sight, ``size`` to a batch, dealt round-robin to ranks.

    Only one row per trajectory is numbered, by ranges of the order.
    """
    firsts = steps.groupBy("trajectory_uid").agg(F.min(order).alias("__first"))
    dealt = numbered(firsts, "__first", "trajectory_uid", out="__n").select("trajectory_uid", "__n")
    return steps.join(dealt, "trajectory_uid").withColumns({"mini_batch": F.floor(F.col("__n") / size).cast("int"), "rank": F.pmod(F.col("__n"), F.lit(ranks)).cast("int")}).drop("__n")


def batch_totals(steps: DataFrame) -> DataFrame:
    """By mini-batch: rows, trajectories, response tokens."""
    return steps.groupBy("mini_batch").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("trajectory_uid").alias("trajectories"), F.sum("response_len").alias("response_tokens"))


def by_mini_batch(steps: DataFrame, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """Adds turn: the place of a row's mini_batch among those that there are, by id or in a fixed random order.

    Only one row per mini-batch is numbered.
    """
    ids = steps.select("mini_batch").filter("mini_batch is not null").distinct()
    place = F.conv(F.substring(hash_order(F.col("mini_batch"), seed=str(seed)), 1, 15), 16, 10).cast("bigint") if shuffle else F.col("mini_batch").cast("bigint")
    turns = numbered(ids.withColumn("__place", place), "__place", "mini_batch", out="turn").drop("__place")
    return steps.join(turns, "mini_batch")


def padded(df: DataFrame, sizes: list[int], order: str, *masks: str) -> DataFrame:
    """Rows up to a multiple of all ``sizes``, with sample_mask: the first rows by ``order`` (unique) come again, as often as it needs.

    Copies have sample_mask false and nothing in their ``masks`` (numbers). They
    are fewer than the multiple, which is all that is ordered at once. An empty
    table stays empty.
    """
    multiple = math.lcm(*sizes) if sizes else 1
    rows = df.withColumn("sample_mask", F.lit(True))
    n = df.count()
    short = -n % multiple
    if not short:
        return rows
    rounds = -(-short // n)
    again = repeat_interleaved(first_n(df, min(short, n), order), rounds, "__round").orderBy("__round", order).limit(short).drop("__round")
    zero = {m: F.lit(0).cast(df.schema[m].dataType) for m in masks}
    return rows.unionByName(again.withColumns({**zero, "sample_mask": F.lit(False)}))


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows whose sample_mask is set; all rows of a table without that column."""
    return df.filter(F.col("sample_mask").cast("boolean")) if "sample_mask" in df.columns else df


def repeat_interleaved(df: DataFrame, n: int, out: str = "rollout") -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def chunks(df: DataFrame, index: str, total: int, workers: int) -> DataFrame:
    """Adds chunk: contiguous pieces of ceil(total / workers) rows."""
    size = -(-total // workers)
    return df.withColumn("chunk", F.floor(F.col(index) / size).cast("int"))
