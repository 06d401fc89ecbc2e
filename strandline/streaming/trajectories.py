"""Trajectories followed step by step as they arrive, with state that lasts between micro-batches.

Each trajectory has a token budget, a ledger of the artifacts it has found, and
the reference evidence it has covered. What a step may use depends on all steps
before it, so steps that arrive early wait until the ones before them are there.
State is kept by key in RocksDB and in the checkpoint: a restarted query goes on
where it stopped, and a step that arrives twice counts once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

#: What a step brings: tokens of its prompt and its response, what it did ("search" or "finish"), what it found and whether that is reference evidence, and what it refers to.
STEP = "trajectory_uid string, step_index int, prompt_len int, response_len int, kind string, artifact string, is_gold boolean, cites string"

#: What is known of a step in its place: tokens used before, its cap, why the trajectory ends there, artifacts known before, whether the one it refers to was among them, whether it is the first to cover some evidence, and how many have done so.
FOLLOWED = "trajectory_uid string, step_index int, used bigint, cap bigint, stop string, available int, cite_known boolean, covers boolean, covered int"

STEP_COLUMNS = [x.split()[0] for x in STEP.split(", ")]
_Followed = Row(*(x.split()[0] for x in FOLLOWED.split(", ")))


@dataclass(frozen=True)
class Limits:
    """Tokens of a trajectory, of the model's context, of one response and of a prompt; and steps of a trajectory."""

    total: int
    context: int
    per_step: int
    prompt: int
    steps: int


class Follower(StatefulProcessor):
    """The recursion of one trajectory.

    A step stops its trajectory before it runs if the budget is used up, its
    prompt is too long or fills the context; after it ran if it finishes behind
    a search, or is the last one allowed. Steps after that are ``closed``.
    Steps of a trajectory that stays silent for ``idle_ms`` and that wait for
    one that never came are given out as ``lost``.

    A key's state is one value, read once and written once a micro-batch: each
    question to the state goes over a socket, which costs more than a step. The
    ledger and the actions have at most the steps that a trajectory may have.
    """

    def __init__(self, limits: Limits, idle_ms: int | None = None):
        self._limits, self._idle = limits, idle_ms

    def init(self, handle) -> None:
        self._handle = handle
        # waiting, ledger, actions: lists as JSON, of steps, of (artifact, step_index, gold) and of (step_index, kind, artifact)
        self._progress = handle.getValueState("progress", "next int, used bigint, searches int, covered int, stop string, waiting string, ledger string, actions string")

    def _held(self) -> tuple:
        held = self._progress.get()
        if not held:
            return 0, 0, 0, 0, None, [], [], []
        return *held[:5], *(json.loads(x) for x in held[5:])

    def _keep(self, *state) -> None:
        self._progress.update((*state[:5], *(json.dumps(x) for x in state[5:])))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at, used, searches, covered, stop, waiting, found, actions = self._held()
        before = at, len(waiting)
        ledger = {artifact: (i, gold) for artifact, i, gold in found}
        known = len(ledger)
        # what is here, by place; of a step that is repeated the first row counts
        here: dict[int, tuple] = {}
        for r in rows:
            if r.step_index >= at:
                here.setdefault(r.step_index, (r.prompt_len, r.response_len, r.kind, r.artifact, r.is_gold, r.cites))
        for i, *step in waiting:
            here[i] = tuple(step)
        out = []
        while at in here:
            prompt, response, kind, artifact, gold, cites = here.pop(at)
            if stop:
                out.append(_Followed(*key, at, used, 0, "closed", known, False, False, covered))
                at += 1
                continue
            lim = self._limits
            left, room = lim.total - used, lim.context - prompt
            halt = "token_budget" if left <= 0 else "prompt_limit" if prompt > lim.prompt else "context_limit" if room <= 0 else None
            cap = 0 if left <= 0 or room <= 0 else min(left, room, lim.per_step)
            cite = cites is not None and cites in ledger
            seen, new = known, False
            spent = used
            if halt is None:
                spent += min(response, cap)
                actions.append((at, kind, artifact))
                if kind == "finish" and searches:
                    halt = "finish"
                elif kind == "search":
                    searches += 1
                    if artifact is not None and artifact not in ledger:
                        ledger[artifact] = at, bool(gold)
                        known += 1
                        new = bool(gold)
                        covered += new
                if halt is None and at + 1 >= lim.steps:
                    halt = "max_steps"
            out.append(_Followed(*key, at, used, cap, halt, seen, cite, new, covered))
            used, stop = spent, halt
            at += 1
        if stop:  # only how many were known is asked any more
            actions = []
        if (at, len(here)) != before:  # else all that came was there already
            self._keep(at, used, searches, covered, stop, [(i, *step) for i, step in here.items()], [(a, *x) for a, x in ledger.items()], actions)
        if self._idle is not None:
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)
            if here:
                self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, used, searches, covered, stop, waiting, ledger, actions = self._held()
        steps = sorted(i for i, *_ in waiting)
        after = steps[-1] + 1 if steps else at
        self._keep(after, used, searches, covered, stop or "lost", [], ledger, actions)
        return iter([_Followed(*key, i, used, 0, "closed" if stop else "lost", len(ledger), False, False, covered) for i in steps])


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State is kept in RocksDB within this block, as state by key needs; a session's own setting comes back after it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, had)


def follow(steps: DataFrame, limits: Limits, idle_ms: int | None = None) -> DataFrame:
    """The columns of ``FOLLOWED`` for each step of a stream or a table with those of ``STEP``, once all steps before it are there.

    A row with a null trajectory or step_index is refused by the filter of
    ``known_steps``; null lengths count as 0; a null artifact is none; extra
    columns are not read.
    """
    return steps.groupBy("trajectory_uid").transformWithState(Follower(limits, idle_ms), FOLLOWED, "Append", "None" if idle_ms is None else "ProcessingTime")


def known_steps(steps: DataFrame) -> DataFrame:
    """The columns of ``STEP`` of rows that have a place, with lengths of at least 0."""
    sized = "trajectory_uid", "cast(step_index AS int) AS step_index", "coalesce(greatest(cast(prompt_len AS int), 0), 0) AS prompt_len", "coalesce(greatest(cast(response_len AS int), 0), 0) AS response_len"
    return steps.filter("trajectory_uid is not null and step_index >= 0").selectExpr(*sized, "kind", "artifact", "is_gold", "cites")


def stream_followed(spark: SparkSession, source: str, limits: Limits, out: str, checkpoint: str, files: int | None = None, idle_ms: int | None = None) -> StreamingQuery:
    """Follow the steps in parquet files as they appear, ``files`` of them a micro-batch; each followed step is written once.

    The query ends when all that is there is read. With ``idle_ms`` it goes on
    until it is stopped, as time alone may then give out steps.
    """
    reader = spark.readStream.schema(STEP)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    with rocksdb(spark):
        writer = follow(known_steps(rows), limits, idle_ms).writeStream.format("parquet").outputMode("append")
        writer = writer.option("path", out).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if idle_ms is None else writer).start()
