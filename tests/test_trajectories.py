"""Trajectories followed in micro-batches."""

import random
import time

import pytest

from strandline import runtime
from strandline.streaming import trajectories as t

LIMITS = t.Limits(total=60, context=40, per_step=15, prompt=38, steps=7)


def plainly(steps):
    """The recursion over one trajectory's steps in order, as plain Python over whole history."""
    out, ran, stop = [], [], None
    for s in steps:
        used = min(60, sum(min(x["response_len"], x["cap"]) for x in ran))
        ledger = list(dict.fromkeys(x["artifact"] for x in ran if x["kind"] == "search" and x["artifact"]))
        gold = {x["artifact"]: x["is_gold"] for x in reversed(ran) if x["kind"] == "search" and x["artifact"]}
        covered = sum(bool(gold[a]) for a in ledger)
        if stop:
            out.append((s["step_index"], used, 0, "closed", len(ledger), False, False, covered))
            continue
        room = 40 - s["prompt_len"]
        stop = "token_budget" if used >= 60 else "prompt_limit" if s["prompt_len"] > 38 else "context_limit" if room <= 0 else None
        cap = max(0, min(60 - used, room, 15))
        covers = False
        if not stop:
            stop = "finish" if s["kind"] == "finish" and any(x["kind"] == "search" for x in ran) else "max_steps" if s["step_index"] == 6 else None
            covers = s["kind"] == "search" and bool(s["artifact"]) and s["artifact"] not in ledger and bool(s["is_gold"])
            ran.append({**s, "cap": cap})
        out.append((s["step_index"], used, cap, stop, len(ledger), s["cites"] in ledger, covers, covered + covers))
    return out


def some_steps(rng, uid):
    return [
        dict(trajectory_uid=uid, step_index=i, prompt_len=rng.randrange(1, 42), response_len=rng.randrange(0, 25), kind=rng.choice(["search"] * 5 + ["finish", "other"]), artifact=rng.choice([None, "a", "b", "c"]), is_gold=rng.choice([True, False, None]), cites=rng.choice([None, "a", "b", "z"]))
        for i in range(rng.randrange(1, 11))
    ]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def test_any_order_and_restarts_give_the_recursion(spark, folder):
    runtime.prepare(spark)
    rng = random.Random(4)
    all_of = {f"t{n}": some_steps(rng, f"t{n}") for n in range(60)}
    rows = [s for x in all_of.values() for s in x]
    rng.shuffle(rows)
    third = len(rows) // 3
    for k, part in enumerate((rows[:third], rows[third : 2 * third] + rows[:20], rows[2 * third :])):
        spark.createDataFrame(part, t.STEP).repartition(3).write.mode("append").parquet(f"{folder}/in")
        q = t.stream_followed(spark, f"{folder}/in", LIMITS, f"{folder}/out", f"{folder}/checkpoint", files=1 + k)
        q.awaitTermination()
    got = {}
    for r in spark.read.schema(t.FOLLOWED).parquet(f"{folder}/out").collect():
        got.setdefault(r.trajectory_uid, []).append(tuple(r)[1:])
    assert {u: sorted(x) for u, x in got.items()} == {u: plainly(x) for u, x in all_of.items()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("HDFSBackedStateStoreProvider") or "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


class Counted:
    """A handle of one key whose state counts how often it is asked and told."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_the_state_is_read_and_written_once_a_batch():
    rng, handle, follower = random.Random(7), Counted(), t.Follower(LIMITS)
    follower.init(handle)
    steps = [dict(trajectory_uid="x", step_index=i, prompt_len=1, response_len=1, kind="search", artifact=rng.choice("abc"), is_gold=True, cites="a") for i in range(7)]
    rows = lambda some: iter([t.Row(**s) for s in some])
    got, asked = [], []
    for some in (steps[3:], steps[3:5], steps[:2] + steps[:1], steps[:1], steps[2:3], steps):
        handle.calls = 0
        got += [tuple(r)[1:] for r in follower.handleInputRows(("x",), rows(some), None)]
        asked.append(handle.calls)
    assert got == plainly(steps)
    # what was there already changes nothing
    assert asked == [2, 1, 2, 1, 2, 1]


def test_rows_without_a_place_are_left_out_and_nulls_count_as_nothing(spark):
    rows = [(None, 0, 1, 1, "search", "a", True, None), ("x", None, 1, 1, "search", "a", True, None), ("x", -1, 1, 1, None, None, None, None), ("x", 0, None, -5, None, None, None, None)]
    got = t.known_steps(spark.createDataFrame(rows, t.STEP)).collect()
    assert [tuple(r) for r in got] == [("x", 0, 0, 0, None, None, None, None)]


def test_steps_that_wait_in_vain_are_given_out(spark, folder, tmp_path):
    runtime.prepare(spark)
    gap = [dict(trajectory_uid="g", step_index=i, prompt_len=1, response_len=1, kind="search", artifact="a", is_gold=True, cites=None) for i in (0, 2, 3)]
    spark.createDataFrame(gap, t.STEP).coalesce(1).write.parquet(f"{folder}/in")
    q = t.stream_followed(spark, f"{folder}/in", LIMITS, f"{folder}/out", f"{folder}/checkpoint", idle_ms=1)
    try:
        for _ in range(60):
            time.sleep(0.5)
            got = sorted((r.trajectory_uid, r.step_index, r.stop) for r in spark.read.schema(t.FOLLOWED).parquet(f"{folder}/out").collect()) if (tmp_path / "out" / "_spark_metadata").exists() else []
            if len(got) == 3:
                break
    finally:
        q.stop()
    assert got == [("g", 0, None), ("g", 2, "lost"), ("g", 3, "lost")]
