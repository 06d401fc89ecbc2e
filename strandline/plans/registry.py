"""Interchangeable parts by name: rewards, verifiers, tool formats, estimators, objectives."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import Generic, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import answers, arithmetic, equations, toolcalls
from strandline.operators import advantage, losses, ordered

P = TypeVar("P")


class Registry(Generic[P]):
    """Parts by name. A name is given once; an unknown one lists what there is, and ``module:name`` is imported."""

    def __init__(self, what: str, parts: dict[str, P] | None = None):
        self._what, self._parts = what, dict(parts or {})

    def register(self, name: str) -> Callable[[P], P]:
        def put(part: P) -> P:
            if name in self._parts:
                raise ValueError(f"there is a {self._what} {name} already")
            self._parts[name] = part
            return part

        return put

    def get(self, name: str) -> P:
        if name in self._parts:
            return self._parts[name]
        module, _, attribute = name.partition(":")
        if attribute:
            return getattr(importlib.import_module(module), attribute)
        raise KeyError(f"no {self._what} {name}; there are {', '.join(sorted(self._parts))}")

    def names(self) -> list[str]:
        return sorted(self._parts)


#: reward(completion, truth) -> score in [0, 1]
REWARDS: Registry[Callable[[str | None, str], float]] = Registry("reward")
#: verifier(steps of one trajectory) -> credits (step_index, score)
VERIFIERS: Registry[Callable[[pd.DataFrame], pd.DataFrame]] = Registry("verifier")
TOOL_FORMATS = Registry("tool format", toolcalls.FORMATS)
ESTIMATORS = Registry("estimator", advantage.ESTIMATORS)
POLICY_LOSSES = Registry("policy loss", losses.POLICY_LOSSES)
#: tool(arguments) -> (observation, reward or None)
TOOLS: Registry[Callable[[dict], tuple[str, float | None]]] = Registry("tool")


@REWARDS.register("final_answer")
def final_answer_reward(text: str | None, truth: str) -> float:
    """1 if the completion's final answer equals the reference."""
    got = answers.final_answer(text)
    return float(bool(got) and arithmetic.answers_equal(got["answer"], truth))


@REWARDS.register("integer_answer")
def integer_reward(text: str | None, truth: str) -> float:
    return float(answers.score_integer(text, truth)["is_correct"])


@REWARDS.register("process")
def process_reward(text: str | None, truth: str) -> float:
    """The mean share of verified equations per graded step."""
    return equations.process_score(text)[0]


@REWARDS.register("visual_answer")
def visual_reward(text: str | None, truth: str) -> float:
    """As final_answer, but 0 for a completion that still calls tools."""
    return 0.0 if text is None or "<tool_call>" in text else final_answer_reward(text, truth)


@TOOLS.register("check_answer")
def check_answer_tool(arguments: dict) -> tuple[str, float | None]:
    """Whether an answer equals the reference that the environment was given."""
    same = arithmetic.answers_equal(str(arguments.get("answer") or ""), str(arguments.get("ground_truth") or ""))
    return ("correct" if same else "incorrect"), None


def reward_column(name: str):
    """A registered reward as a column function of (completion, truth)."""
    part = REWARDS.get(name)

    def score(texts, truths):
        return pd.Series([part(t, g) for t, g in zip(texts, truths, strict=True)], dtype="float64")

    score.__annotations__ = {"texts": pd.Series, "truths": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")


def verify(steps: DataFrame, name: str) -> DataFrame:
    """Credits (trajectory_uid, step_index, score) by a registered verifier, one trajectory at a time.

    A credit must be in [0, 1] and a trajectory's credits at most 1 in all.
    """
    part = VERIFIERS.get(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, at in ordered.whole_groups(batches, "trajectory_uid"):
            made = [part(pdf.iloc[a:b]) for a, b in pairwise(at)]
            out = pd.concat(made, ignore_index=True)
            of = np.repeat(np.arange(len(made)), [len(m) for m in made])
            if not out["score"].between(0, 1).all() or (np.bincount(of, out["score"].astype("float64")) > 1 + 1e-8).any() or (out["step_index"] < 0).any():
                raise ValueError(f"{name} gave credits out of bounds")
            yield pd.DataFrame({"trajectory_uid": pdf["trajectory_uid"].to_numpy()[np.array(at)[of]], "step_index": out["step_index"], "score": out["score"]})

    return ordered.in_order(steps, "trajectory_uid", "step_index").mapInPandas(run, "trajectory_uid string, step_index int, score double")


@VERIFIERS.register("novel_queries")
def novel_queries(steps: pd.DataFrame) -> pd.DataFrame:
    """An even share for each step whose query was not asked before by a credited step."""
    seen: set[str] = set()
    fresh = []
    for q, ok in zip(steps["query"].fillna(""), steps["success"], strict=True):
        key = " ".join(str(q).casefold().split())
        fresh.append(bool(ok) and bool(key) and key not in seen)
        if fresh[-1]:
            seen.add(key)
    return pd.DataFrame({"step_index": steps["step_index"], "score": [f / max(1, len(steps)) for f in fresh]})


def call_tools(calls: DataFrame, formats: str = "hermes") -> DataFrame:
    """Observations and summed reward (null if no tool gave one) of a completion's calls: (id, text) in."""
    read = TOOL_FORMATS.get(formats)
    tools = {n: TOOLS.get(n) for n in TOOLS.names()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"], strict=True):
                seen, rewards = [], []
                for c in read(t or ""):
                    said, reward = tools[c["name"]](c["arguments"]) if c["name"] in tools else (f"unknown tool {c['name']}", None)
                    seen.append(said)
                    rewards += [reward] if reward is not None else []
                rows.append((i, seen, sum(rewards) if rewards else None))
            yield pd.DataFrame(rows, columns=["id", "observations", "reward"])

    return calls.select("id", "text").mapInPandas(run, "id bigint, observations array<string>, reward double")
