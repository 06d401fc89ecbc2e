"""Closures of step graphs: what each step of a trajectory depends on, through any number of inputs.

Edges are (trajectory_uid, ref, input). Paths are doubled: a round knows the
pairs that paths of exactly 2^k edges join and those that shorter ones join, and
lays the two kinds end to end, so a graph of depth d takes log d rounds and a
pair of a chain is made once. Each round is written to the shared folder and
only pairs that are not known yet are added to it. A trajectory is spread over
as many tasks as its steps need. Edges may repeat, and may run in circles, in
which case a step is its own ancestor. An edge without a ref or an input is
none; a null trajectory is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import runtime

_PAIR = ["trajectory_uid", "ref", "ancestor"]


def _known(edges: DataFrame) -> DataFrame:
    return edges.filter("trajectory_uid is not null and ref is not null and input is not null").select("trajectory_uid", "ref", F.col("input").alias("ancestor")).distinct()


def _end_to_end(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs that a pair of ``first`` and one of ``second`` join."""
    behind = second.select("trajectory_uid", F.col("ref").alias("__mid"), F.col("ancestor").alias("__end"))
    return first.withColumnRenamed("ancestor", "__mid").join(behind, ["trajectory_uid", "__mid"]).select("trajectory_uid", "ref", F.col("__end").alias("ancestor"))


def _grown(edges: DataFrame, start: DataFrame, columns: list[str], step) -> DataFrame:
    """``start`` and what ``step`` (known, exact) adds to it, round after round, until a round adds nothing.

    ``exact`` are the pairs that paths of exactly 2^k edges join; ``known``
    holds what paths of fewer edges lead to. If no path of 2^k to 2^(k+1) - 1
    edges leads to anything new, none that is longer does.
    """
    spark = edges.sparkSession
    exact = runtime.materialise(_known(edges), "paths")
    parts = [runtime.materialise(start, "closure")]
    while True:
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        new = runtime.materialise(step(known, exact).distinct().join(known, columns, "left_anti"), "closure")
        if new.isEmpty():
            runtime.drop(spark, exact, new)
            return known
        parts.append(new)
        longer = runtime.materialise(_end_to_end(exact, exact).distinct(), "paths")
        runtime.drop(spark, exact)
        exact = longer


def ancestors(edges: DataFrame) -> DataFrame:
    """(trajectory_uid, ref, ancestor) of all that each step depends on."""
    none = _known(edges).limit(0)
    return _grown(edges, none, _PAIR, lambda known, exact: exact.unionByName(_end_to_end(exact, known)))


def count_ancestors(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(trajectory_uid, ref, n): how many ancestors of a step are in ``marked`` (trajectory_uid, ref); steps with none are left out."""
    given = marked.select("trajectory_uid", F.col("ref").alias("ancestor")).distinct()
    return ancestors(edges).join(given, ["trajectory_uid", "ancestor"]).groupBy("trajectory_uid", "ref").agg(F.count(F.lit(1)).alias("n"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(trajectory_uid, ref) that the starts (trajectory_uid, ref) depend on through inputs, the starts included."""
    given = starts.filter("trajectory_uid is not null and ref is not null").select("trajectory_uid", "ref").distinct()

    def step(known: DataFrame, exact: DataFrame) -> DataFrame:
        return known.join(exact, ["trajectory_uid", "ref"]).select("trajectory_uid", F.col("ancestor").alias("ref"))

    return _grown(edges, given, ["trajectory_uid", "ref"], step)
