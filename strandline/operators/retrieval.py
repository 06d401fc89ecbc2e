"""Exact vector search and the passages it leads to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import runtime

#: Vectors of the corpus, and queries, that one task of the grid holds.
BLOCK = 16_384
#: Queries and vectors that are scored at once: a task holds no more scores than these times each other.
AT_ONCE = (256, 2_048)
#: Stripes whose first blocks give each query its first bound.
LEAD_STRIPES = 3
#: Norms of one stripe differ by this factor at most.
STRIPE = 1.02
#: The stripe of vectors without length.
_FLAT = -1_000_000
#: Two sums of the same products may differ by so much of their greatest possible size.
_SLACK = 1e-9


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def blocks(corpus: DataFrame, pid: str = "pid", vector: str = "embedding") -> DataFrame:
    """The corpus as a search reads it: (pid, v, stripe, part), with stripes of like norms and parts of some ``BLOCK`` vectors. It may be written and used again.

    A null vector is left out. Rows are dealt to a stripe's parts by their
    place, so that repeated ones are spread too.
    """
    rows = corpus.select(F.col(pid).cast("bigint").alias("pid"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    norm = _length(F.col("v"))
    rows = rows.withColumn("stripe", F.when(norm > 0, F.floor(F.log(norm) / F.log(F.lit(STRIPE)))).otherwise(_FLAT).cast("int"))
    sizes = rows.groupBy("stripe").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    # a stripe for each fiftieth of a doubling of the norm: the range of doubles bounds them
    return rows.join(F.broadcast(sizes), "stripe").select("pid", "v", "stripe", F.floor(F.rand(7) * F.col("parts")).cast("int").alias("part"))


def _reach(stripe: Column) -> Column:
    """No vector of a stripe is longer."""
    return F.when(stripe == _FLAT, 0.0).otherwise(F.pow(F.lit(STRIPE), stripe + 1) * (1 + _SLACK))


def _grid(queries: DataFrame, cells: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, pid, score) of the k best of each cell (g, stripe, part) for each query of the group g that the cell can still help."""
    cells = cells.select("g", "stripe", "part", "reach")
    mine = queries.join(cells.toDF("g", "stripe", "part", "reach"), "g")
    theirs = vectors.join(cells.toDF("g", "stripe", "part", "__reach"), ["stripe", "part"]).drop("__reach")
    mine, theirs = mine.toDF(*mine.columns), theirs.toDF(*theirs.columns)

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        ids, scores, found = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        if q.num_rows and c.num_rows:
            pids, left, right = np.asarray(c.column("pid")), _matrix(q), _matrix(c)
            qids, best, room = np.asarray(q.column("qid")), np.asarray(q.column("kth")), np.asarray(q.column("norm")) * q.column("reach")[0].as_py()
            live = np.flatnonzero(room * (1 + _SLACK) >= best)
            for at in range(0, len(live), AT_ONCE[0]):
                rows = live[at : at + AT_ONCE[0]]
                least = best[rows] - _SLACK * np.maximum(1.0, room[rows])
                top_s, top_p = np.full((len(rows), 0), 0.0), np.zeros((len(rows), 0), np.int64)
                for b in range(0, len(pids), AT_ONCE[1]):
                    s = np.concatenate((top_s, left[rows] @ right[b : b + AT_ONCE[1]].T), 1)
                    p = np.concatenate((top_p, np.broadcast_to(pids[b : b + AT_ONCE[1]], (len(rows), min(AT_ONCE[1], len(pids) - b)))), 1)
                    order = np.lexsort((p, -s), axis=1)[:, :k]
                    top_s, top_p = np.take_along_axis(s, order, 1), np.take_along_axis(p, order, 1)
                ok = top_s >= least[:, None]
                ids.append(np.repeat(qids[rows], ok.sum(1)))
                scores.append(top_s[ok])
                found.append(top_p[ok])
        return pa.table([pa.array(np.concatenate(x)) for x in (ids, found, scores)], names=["qid", "pid", "score"])

    key = ["g", "stripe", "part"]
    return mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(run, "qid bigint, pid bigint, score double")


def _matrix(t: pa.Table) -> np.ndarray:
    return np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, qid: str = "qid", pid: str = "pid", vector: str = "embedding") -> DataFrame:
    """(qid, pid, score, rank) of the ``k`` greatest inner products per query, ties to the smaller pid.

    Groups of queries meet blocks of the corpus in a grid; a task holds one of
    each. An inner product is at most the product of both norms, so once a query
    has k scores from the longest vectors, stripes of shorter ones that cannot
    reach the least of these are left out: cells that no query of a group needs
    are never sent, and within a cell only queries that need it are scored.
    Nothing is collected but the bounds of stripes. Null vectors find nothing
    and are not found; of queries with one id the one with the least vector
    counts; all vectors have one length, or the product of a cell raises.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(qid).cast("bigint").alias("qid"), F.col(vector).cast("array<double>").alias("v")).filter("qid is not null and v is not null").groupBy("qid").agg(F.min("v").alias("v"))
    groups = max(1, -(-asked.count() // BLOCK))
    asked = runtime.materialise(asked.withColumns({"norm": _length(F.col("v")), "g": F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int")}), "queries")
    vectors = runtime.materialise(blocks(corpus, pid, vector), "blocks")
    stripes = vectors.groupBy("stripe").agg((F.max("part") + 1).alias("parts"), F.count(F.lit(1)).alias("n")).withColumn("reach", _reach(F.col("stripe")))
    # the first parts of the longest stripes, and of as many more as hold k vectors
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("stripe")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = stripes.withColumns({"at": F.row_number().over(Window.orderBy(F.desc("stripe"))), "before": before}).filter((F.col("at") <= LEAD_STRIPES) | (F.col("before") < k))
    every = spark.range(groups).select(F.col("id").cast("int").alias("g"))
    first = every.join(F.broadcast(lead.select("stripe", F.lit(0).alias("part"), "reach")))
    seen = _grid(asked.withColumn("kth", F.lit(float("-inf"))), first, vectors, k)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pid"))
    kth = seen.withColumn("rank", rank).filter(F.col("rank") == k).select("qid", F.col("score").alias("kth"))
    bounded = runtime.materialise(asked.join(kth, "qid", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))), "bounds")
    # what a group needs is what the least demanding of its queries needs
    need = F.when((F.col("norm") > 0) & (F.col("kth") > 0), F.col("kth") / F.col("norm")).otherwise(0.0)
    wanted = bounded.groupBy("g").agg((F.min(need) * (1 - 2 * _SLACK)).alias("need"))
    cells = wanted.join(F.broadcast(stripes), F.col("reach") >= F.col("need")).select("g", "stripe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "reach")
    out = _grid(bounded, cells, vectors, k)
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def passages(hits: DataFrame, corpus: DataFrame, pid: str = "pid") -> DataFrame:
    """Hits with their paragraphs' columns; ids that the corpus has not are dropped."""
    return hits.join(corpus, pid)


def first_seen(found: DataFrame) -> DataFrame:
    """The first sight of each passage in a trajectory, by (step_index, rank)."""
    w = Window.partitionBy("trajectory_uid", "pid").orderBy("step_index", "rank")
    return found.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def within_budget(found: DataFrame, most_chars: int, order: str = "position", text: str = "text") -> DataFrame:
    """The passages of each trajectory before the first one that would pass ``most_chars`` in all; repeats do not count."""
    seen = Window.partitionBy("trajectory_uid", "pid").orderBy(order)
    once = found.withColumn("__r", F.row_number().over(seen)).filter("__r = 1").drop("__r")
    so_far = Window.partitionBy("trajectory_uid").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # lengths only add up, so once the sum is over the limit it stays over
    return once.withColumn("used", F.sum(F.length(text)).over(so_far)).filter(F.col("used") <= most_chars)


def token_caps(steps: DataFrame, total: int, context: int, per_step: int, prompt_limit: int) -> DataFrame:
    """The cap of each step's generation and why it must stop: (trajectory_uid, step_index, prompt_len, response_len)."""
    before = Window.partitionBy("trajectory_uid").orderBy("step_index").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("response_len").over(before), F.lit(0))
    left, room = F.lit(total) - used, F.lit(context) - F.col("prompt_len")
    stop = F.when(left <= 0, "token_budget").when(F.col("prompt_len") > prompt_limit, "prompt_limit").when(room <= 0, "context_limit").when(F.col("response_len") == 0, "empty_generation")
    return steps.withColumns({"used": used, "cap": F.when(left <= 0, 0).when(room <= 0, 0).otherwise(F.least(left, room, F.lit(per_step))), "stop": stop})
