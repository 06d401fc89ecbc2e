"""Groups that Python reads in order, many at a time."""

import pandas as pd
import pytest

from strandline import runtime
from strandline.operators import ordered, verification
from strandline.plans import registry


def test_groups_stay_whole_whatever_the_batches():
    keys = [None, "a", "b", "b", "b", "b", "b", "b", "b", "c", "d", "d"]
    rows = pd.DataFrame({"k": keys, "i": range(len(keys))})
    for n in range(1, 14):
        batches = [rows.iloc[a : a + n].reset_index(drop=True) for a in range(0, len(rows), n)] + [rows.iloc[:0]]
        got = [pdf.iloc[a:b] for pdf, at in ordered.whole_groups(batches, "k") for a, b in zip(at, at[1:])]
        assert [g["k"].iloc[0] for g in got] == [None, "a", "b", "c", "d"] and [g["i"].tolist() for g in got] == [[0], [1], [*range(2, 9)], [9], [10, 11]]


@pytest.fixture
def small_batches(spark):
    runtime.prepare(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(name)
    spark.conf.set(name, "5")
    yield spark
    spark.conf.set(name, had)


def test_verifiers_read_many_trajectories_a_call(small_batches):
    spark = small_batches
    said = {f"t{n}": [(i, f"Q {i * n % 4}" if (i + n) % 7 else None, (i + n) % 5 > 0) for i in range(1 + n * 5 % 23)] for n in range(60)}
    want = set()
    for uid, steps in said.items():
        seen = set()
        for i, q, ok in steps:
            new = bool(ok and q and q not in seen)
            seen |= {q} if new else set()
            want.add((uid, i, new / len(steps)))
    rows = spark.createDataFrame([(uid, *s) for uid, x in said.items() for s in reversed(x)], "trajectory_uid string, step_index int, query string, success boolean")
    made = registry.verify(rows, "novel_queries")
    assert {tuple(r) for r in made.collect()} == want
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()


def test_novelty_starts_anew_with_each_trajectory(small_batches):
    spark = small_batches
    rows = [(f"t{n}", i, "search", f"q {i % 3}", f"c {i}", [f"s{i}"], True, True, 1.0) for n in range(20) for i in range(4)]
    made = verification.novelty_credits(spark.createDataFrame(rows, "trajectory_uid string, step_index int, action string, query string, conclusion string, sources array<string>, valid boolean, coupled boolean, factor double"), 3)
    got = {(r.trajectory_uid, r.step_index): (r.novel, round(r.credit, 6), tuple(r.reasons)) for r in made.collect()}
    of = {0: (True, 0.333333, ()), 1: (True, 0.333333, ()), 2: (True, 0.333333, ()), 3: (False, 0.0, ("query_repeated", "reward_horizon_exceeded"))}
    assert got == {(f"t{n}", i): x for n in range(20) for i, x in of.items()}
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()


def test_credits_out_of_bounds_are_refused(spark):
    runtime.prepare(spark)
    registry.VERIFIERS._parts["too_much"] = lambda steps: pd.DataFrame({"step_index": steps["step_index"], "score": 0.6})
    try:
        one, two = (spark.createDataFrame([(u, i) for u in ("a", "b") for i in range(n)], "trajectory_uid string, step_index int") for n in (1, 2))
        assert registry.verify(one, "too_much").count() == 2
        with pytest.raises(Exception, match="out of bounds"):
            registry.verify(two, "too_much").collect()
    finally:
        del registry.VERIFIERS._parts["too_much"]
