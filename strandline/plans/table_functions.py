"""Verifiers as table functions of SQL.

    SELECT * FROM verify_steps(TABLE(steps) PARTITION BY (trajectory_uid) ORDER BY (step_index), verifier => 'first_queries')

A verifier sees the steps of one trajectory in order and gives credits to some
of them. The contract is kept for every verifier: a credit names a step that was
seen, lies in [0, 1], and those of a trajectory are at most 1 in all; a step may
have several, which are added up. The result has the table's own columns of
trajectory and step, whatever their types, and no other columns of it, so that
columns of the table never clash with those of the result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from strandline.plans.registry import Registry

EPSILON = 1e-8
Credit = tuple[Any, float, dict]


class Verifier:
    """The steps of one trajectory: ``step`` sees each row, ``credits`` gives (step_index, score, audit) at the end. ``columns`` are those it reads."""

    columns: tuple[str, ...] = ()

    def step(self, row: Row) -> None:
        raise NotImplementedError

    def credits(self) -> Iterator[Credit]:
        raise NotImplementedError


STEP_VERIFIERS: Registry = Registry("step verifier")


@STEP_VERIFIERS.register("first_queries")
class FirstQueries(Verifier):
    """An even share for each step that succeeds with a query that no credited step asked before, blanks and case aside."""

    columns = ("query", "success")

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.fresh: list[tuple[Any, str]] = []
        self.steps = 0

    def step(self, row: Row) -> None:
        self.steps += 1
        key = " ".join((row["query"] or "").casefold().split())
        if row["success"] and key and key not in self.seen:
            self.seen.add(key)
            self.fresh.append((row["step_index"], key))

    def credits(self) -> Iterator[Credit]:
        return ((i, 1.0 / self.steps, {"query": key}) for i, key in self.fresh)


@STEP_VERIFIERS.register("given_scores")
class GivenScores(Verifier):
    """The scores that the rows bring in column ``score``; steps without one get no credit."""

    columns = ("score",)

    def __init__(self) -> None:
        self.given: list[Credit] = []

    def step(self, row: Row) -> None:
        if row["score"] is not None:
            self.given.append((row["step_index"], float(row["score"]), {}))

    def credits(self) -> Iterator[Credit]:
        return iter(self.given)


def checked(credits: Iterator[Credit], seen: set, verifier: str) -> list[Credit]:
    """Credits by step, added up, if they keep the contract."""
    by: dict[Any, tuple[float, list[dict]]] = {}
    total = 0.0
    for step, score, audit in credits:
        if not 0.0 <= score <= 1.0:  # also where it is not a number
            raise ValueError(f"{verifier} gave step {step} a credit outside [0, 1]: {score}")
        if step not in seen:
            raise ValueError(f"{verifier} gave a credit to step {step}, which is not there")
        before, audits = by.get(step, (0.0, []))
        by[step] = (before + score, [*audits, audit] if audit else audits)
        total += score
    if total > 1.0 + EPSILON:
        raise ValueError(f"{verifier} gave credits of {total} in all, more than 1")
    return [(step, score, audits) for step, (score, audits) in by.items()]


class VerifySteps:
    """One partition is one trajectory; its rows come in the order that the query names."""

    def __init__(self) -> None:
        self._part: Verifier | None = None

    @staticmethod
    def analyze(table: AnalyzeArgument, verifier: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("verify_steps takes TABLE(...) PARTITION BY (trajectory_uid) ORDER BY (step_index)")
        if not verifier.isConstantExpression or not isinstance(verifier.value, str):
            raise ValueError("the verifier is a constant name")
        need = ("trajectory_uid", "step_index", *STEP_VERIFIERS.get(verifier.value).columns)
        have = {f.name: f for f in table.dataType.fields}
        lacking = [c for c in need if c not in have]
        if lacking:
            raise ValueError(f"{verifier.value} needs columns {lacking}")
        return AnalyzeResult(StructType([have["trajectory_uid"], have["step_index"], StructField("score", DoubleType()), StructField("process_reward", DoubleType()), StructField("audit", StringType())]))

    def eval(self, table: Row, verifier: str) -> Iterator[tuple]:
        if self._part is None:
            self._part, self._name, self._seen = STEP_VERIFIERS.get(verifier)(), verifier, set()
            self._uid = table["trajectory_uid"]
        if table["trajectory_uid"] != self._uid:
            raise ValueError("a partition holds several trajectories: PARTITION BY trajectory_uid is missing")
        if table["step_index"] in self._seen:
            raise ValueError(f"step {table['step_index']} of {self._uid} is there twice")
        self._seen.add(table["step_index"])
        self._part.step(table)
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if self._part is not None:
            kept = checked(self._part.credits(), self._seen, self._name)
            reward = sum(score for _, score, _ in kept)
            for step, score, audits in kept:
                yield self._uid, step, score, reward, json.dumps(audits, sort_keys=True, separators=(",", ":")) if audits else None


def register(spark: SparkSession) -> None:
    """Make ``verify_steps`` a table function of the session. A verifier of another module is named ``module:class``."""
    spark.udtf.register("verify_steps", udtf(VerifySteps))
