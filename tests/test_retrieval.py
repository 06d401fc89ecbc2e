"""Exact search in a grid of blocks."""

import numpy as np
import pytest

from strandline import runtime
from strandline.operators import retrieval

V = "array<double>"


def plainly(queries, corpus, k):
    out = set()
    for q, x in queries:
        s = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), p) for p, y in corpus if y is not None))
        out |= {(q, p, round(-n, 6), r) for r, (n, p) in enumerate(s[:k], 1)}
    return out


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_like_brute_force(spark, monkeypatch, spread):
    runtime.prepare(spark)
    monkeypatch.setattr(retrieval, "BLOCK", 40)
    monkeypatch.setattr(retrieval, "AT_ONCE", (7, 16))
    rng = np.random.default_rng(3)
    corpus = [(i, (rng.integers(-3, 4, 5) * 2.0 ** int(2 * spread * rng.normal())).tolist()) for i in range(400)]
    corpus += [(1_000 + i, [0.0] * 5) for i in range(50)] + [(2_000, None)]
    queries = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(100)] + [(500, [0.0] * 5)]
    q = spark.createDataFrame(queries, f"qid bigint, embedding {V}")
    c = spark.createDataFrame(corpus, f"pid bigint, embedding {V}")
    got = {(r.qid, r.pid, round(r.score, 6) + 0.0, r.rank) for r in retrieval.top_k(q, c, 5).collect()}
    assert got == {(a, b, s + 0.0, r) for a, b, s, r in plainly(queries, corpus, 5)}


def test_short_stripes_are_left_out(spark, monkeypatch):
    runtime.prepare(spark)
    sent = []
    monkeypatch.setattr(retrieval, "_grid", lambda q, cells, v, k, real=retrieval._grid: (sent.append(cells.count()), real(q, cells, v, k))[1])
    rows = [(i, [2.0 ** -(i // 10), 0.0]) for i in range(300)]
    c = spark.createDataFrame(rows, f"pid bigint, embedding {V}")
    got = retrieval.top_k(spark.createDataFrame([(1, [1.0, 0.0])], f"qid bigint, embedding {V}"), c, 5).collect()
    assert [r.pid for r in sorted(got, key=lambda r: r.rank)] == [0, 1, 2, 3, 4] and sent[1] < 5


def test_empty_and_short_tables(spark):
    runtime.prepare(spark)
    none = spark.createDataFrame([], f"pid bigint, embedding {V}")
    q = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], f"qid bigint, embedding {V}")
    assert retrieval.top_k(q, none).collect() == []
    one = spark.createDataFrame([(9, [1.0, 1.0])], f"pid bigint, embedding {V}")
    assert [tuple(r) for r in retrieval.top_k(q, one).collect()] == [(1, 9, 3.0, 1)]
    assert retrieval.top_k(q.limit(0), one).collect() == []
