"""Importance resampling toward a target distribution, over hashed n-grams, in two passes.

First pass: each partition counts its n-grams into one vector of buckets with
``np.bincount``; a tree of reducers adds the vectors, so that the driver adds a
few and none of them grows with the data. A bucket's gain is the logarithm of
its share of the target over its share of the corpus. Second pass: the gains
are broadcast (one number a bucket) and a document's weight is their sum, by a
weighted ``np.bincount``. Perturbed weights are then ranked over ranges.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import kernels, shared

BUCKETS = 10_000
#: Levels of the tree that adds the partitions' vectors.
TREE_DEPTH = 3
#: Words that are this long are hashed one by one.
_LONG = 64

_WORD = kernels.member_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def _crc_table() -> np.ndarray:
    """Steps of the CRC-32 of zlib, for each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc_states(data: np.ndarray, first: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes [first, end) were fed to those in ``state``."""
    out, size = state.copy(), end - first
    rest, k = np.flatnonzero((size > 0) & (size < _LONG)), 0
    while len(rest):
        s = out[rest]
        out[rest] = _CRC[(s ^ data[first[rest] + k]) & 255] ^ (s >> np.uint32(8))
        k += 1
        rest = rest[size[rest] > k]
    for i in np.flatnonzero(size >= _LONG).tolist():
        out[i] = zlib.crc32(data[first[i] : end[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def features(col: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, buckets, words of every document) of all runs of r words of a column's texts, for each r up to ``longest``."""
    data, offs = kernels.text_buffer(col)
    low = kernels.LOWER[data]
    first, end = kernels.runs(_WORD[low], offs)
    lo, hi = kernels.per_document(first, offs)
    doc = np.repeat(np.arange(len(lo)), hi - lo)
    state = np.full(len(first), 0xFFFFFFFF, np.uint32)
    at = np.arange(len(first))
    for r in range(longest):
        if r:
            at = at[at + r < hi[doc[at]]]
            s = state[at]
            state[at] = _CRC[(s ^ np.uint32(32)) & 255] ^ (s >> np.uint32(8))
        state[at] = crc_states(low, first[at + r], end[at + r], state[at])
        yield doc[at], ((state[at] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), hi - lo


def bucket_counts(df: DataFrame, longest: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for s in kernels.slices(b, "text"):
                for _, bucket, _ in features(s.column("text"), longest, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])
        kernels.give_back()

    vectors = df.select(F.col(text_col).alias("text")).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    return vectors.treeReduce(np.add, TREE_DEPTH) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of each bucket's smoothed share of the target over that of the corpus."""
    n = len(corpus)
    of_corpus, of_target = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1) * of_corpus / ((s + 1) * of_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def perturbation(doc_id: int | None, seed: int) -> int:
    """Thousandths of a standard Gumbel draw that the seed and the id decide; rows without id draw alike."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id bigint, n_features bigint, n_words bigint, weight bigint, score bigint"


def scored(df: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score of each row: its features' gains added up, and perturbed."""
    held = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = held.value.astype(np.float64)
        for b in batches:
            for s in kernels.slices(b, "text"):
                n, weight, words = np.zeros(s.num_rows, np.int64), np.zeros(s.num_rows), np.zeros(s.num_rows, np.int64)
                for doc, bucket, words in features(s.column("text"), longest, len(by_bucket)):
                    n += np.bincount(doc, minlength=s.num_rows)
                    weight += np.bincount(doc, by_bucket[bucket], s.num_rows)
                ids = s.column("doc_id").to_pylist()
                total = weight.astype(np.int64)
                score = total + np.fromiter((perturbation(i, seed) for i in ids), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), *map(pa.array, (n, words, total, score))], names=["doc_id", "n_features", "n_words", "weight", "score"])
        kernels.give_back()

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SCORED)


def resample(df: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row; the drawn have ranks from 1, the others null.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred
    (rounded down) are drawn: those of the highest scores, of equal scores those
    of the least ids, a null id last. A null or wordless text has no features
    and weight 0. Repeated rows are each counted and ranked, in any order among
    themselves; an empty corpus gives an empty result, an empty target is
    smoothed like any other; extra columns are not read.
    """
    gain = gains(bucket_counts(df, longest, buckets, text_col), bucket_counts(target, longest, buckets))
    rows = shared.materialise(scored(df, gain, longest, seed, id_col, text_col), "scored")
    able = F.col("n_words") >= least_words
    drawn = (rows.filter(able).count() * percent) // 100
    # one range of scores a task; the row's place in the files comes last, so that even equal rows are spread
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("place").asc()]
    ranged = rows.withColumns({"able": able, "place": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    at = ranged.withColumns({"part": F.spark_partition_id(), "own": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).drop("place")
    at = shared.materialise(at, "ranged")
    shared.drop(df.sparkSession, rows)
    # a row for each range
    sizes = at.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    rank = F.col("start") + F.col("own") + 1
    return at.join(F.broadcast(starts), "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).alias("rank"))
