"""Advantage estimators over step rows (uid, trajectory_uid, step_index, reward, ...).

``uid`` names the prompt, ``trajectory_uid`` one of its attempts. Every
estimator returns the step rows with ``advantage`` and ``returns`` added; ragged
trajectories stay long rows and are never padded.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6
WHITEN_EPSILON = 1e-8


def _forward():
    return Window.partitionBy("trajectory_uid").orderBy("step_index")


def trajectory_scores(steps: DataFrame) -> DataFrame:
    """uid (of the first step), trajectory_uid and the sum of its steps' rewards; a null reward is 0."""
    return steps.groupBy("trajectory_uid").agg(F.min_by("uid", "step_index").alias("uid"), F.sum(F.coalesce("reward", F.lit(0.0))).alias("score"))


def _spread(steps: DataFrame, by_trajectory: DataFrame) -> DataFrame:
    out = steps.join(by_trajectory.select("trajectory_uid", "advantage"), "trajectory_uid")
    return out.withColumn("returns", F.col("advantage"))


def with_moments(df: DataFrame, x: Column, *keys: str) -> DataFrame:
    """Adds __n, __mean and __std of each group, summed on the map side and joined back: a group of any size is split. Null keys are a group."""
    own = {k: f"__of_{k}" for k in keys}
    moments = df.groupBy(*[F.col(k).alias(o) for k, o in own.items()]).agg(F.count(F.lit(1)).alias("__n"), F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__std"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()])
    return df.join(moments, same).drop(*own.values())


def group_normalised(df: DataFrame, x: Column, keys: list[str], out: str, by_std: bool = True, single_mean_zero: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """Adds (x - mean) / (sample std + epsilon) within each group.

    A group of one has std 1, and mean 0 or, without ``single_mean_zero``, its
    own value.
    """
    alone = x if single_mean_zero else F.lit(0.0)
    off = x - F.col("__mean")
    value = F.when(F.col("__n") == 1, alone / (1 + epsilon) if by_std else alone).otherwise(off / (F.col("__std") + epsilon) if by_std else off)
    return with_moments(df, x, *keys).withColumn(out, value).drop("__n", "__mean", "__std")


def grpo_outcome(steps: DataFrame, by_std: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """Trajectory score, normalised within its prompt, on every step."""
    return _spread(steps, group_normalised(trajectory_scores(steps), F.col("score"), ["uid"], "advantage", by_std, True, epsilon))


def rloo(steps: DataFrame) -> DataFrame:
    """Score less the mean of the prompt's other trajectories; alone, the score itself."""
    n, score = F.col("__n"), F.col("score")
    adv = F.when(n > 1, (score - F.col("__mean")) * n / (n - 1)).otherwise(score)
    return _spread(steps, with_moments(trajectory_scores(steps), score, "uid").withColumn("advantage", adv))


#: Steps that are folded at once. A longer trajectory is folded by blocks, so that no array is copied for each of its steps.
BLOCK = 64


def _folded(items: Column, gamma: float) -> Column:
    """G of each (s, r) of an ordered array: r + gamma^gap * the next one's G, with the step between the two as gap."""
    start = F.struct(F.lit(0.0).alias("g"), F.lit(None).cast("bigint").alias("s"), F.array().cast("array<double>").alias("done"))

    def back(acc: Column, x: Column) -> Column:
        g = x["r"] + F.pow(F.lit(gamma), F.coalesce(acc["s"] - x["s"], F.lit(0))) * acc["g"]
        return F.struct(g.alias("g"), x["s"].alias("s"), F.concat(acc["done"], F.array(g)).alias("done"))

    return F.reverse(F.aggregate(F.reverse(items), start, back, lambda a: a["done"]))


def returns_to_go(steps: DataFrame, gamma: float = 1.0, reward: str = "reward", out: str = "returns") -> DataFrame:
    """G_s = r_s + gamma * G_{s+1}; steps that are missing count as reward 0 and still discount.

    Every row stays: rows of one index follow each other without a discount, and
    a null index comes first, at the place of the first step that has one.
    """
    r = F.coalesce(F.col(reward), F.lit(0.0))
    if gamma == 1.0:
        return steps.withColumn(out, F.sum(r).over(_forward().rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    if gamma == 0.0:
        return steps.withColumn(out, r)
    row = F.struct(*[F.col(c) for c in steps.columns if c != out])
    by = steps.groupBy("trajectory_uid").agg(F.collect_list(F.struct(F.col("step_index").cast("bigint").alias("s"), r.cast("double").alias("r"), row.alias("row"))).alias("__all"))
    ordered = by.select("__all", F.sort_array(F.transform("__all", lambda x, i: F.struct(x["s"].alias("s"), x["r"].alias("r"), i.alias("i")))).alias("__o"))
    blocks = ordered.withColumn("__b", F.transform(F.sequence(F.lit(0), F.size("__o") - 1, F.lit(BLOCK)), lambda at: F.slice("__o", at + 1, F.lit(BLOCK))))
    local = blocks.withColumn("__g", F.transform("__b", lambda b: _folded(b, gamma)))
    heads = local.withColumn("__h", F.zip_with("__b", "__g", lambda b, g: F.struct(F.get(b, F.lit(0))["s"].alias("s"), F.get(g, F.lit(0)).alias("r"))))
    carried = heads.withColumn("__c", _folded(F.col("__h"), gamma))

    def whole(b: Column, k: Column) -> Column:
        """A block's own G and what the next block's first step carries back."""
        after, then = F.get("__c", k + 1), F.get("__h", k + 1)["s"]
        return F.zip_with(b, F.get("__g", k), lambda x, g: F.struct(F.get("__all", x["i"])["row"].alias("row"), (g + F.coalesce(F.pow(F.lit(gamma), F.coalesce(then - x["s"], F.lit(0))) * after, F.lit(0.0))).alias("g")))

    return carried.select(F.inline(F.flatten(F.transform("__b", whole)))).select("row.*", F.col("g").alias(out))


def step_grpo(steps: DataFrame, gamma: float = 1.0, by_std: bool = True, epsilon: float = EPSILON) -> DataFrame:
    """Return-to-go, centred and scaled among the prompt's steps of one index; a lone step keeps its value, over 1 + epsilon."""
    return group_normalised(returns_to_go(steps, gamma), F.col("returns"), ["uid", "step_index"], "advantage", by_std, True, epsilon)


def whitened(df: DataFrame, column: str, out: str, epsilon: float = WHITEN_EPSILON) -> DataFrame:
    """(x - mean) / (sample std + epsilon) over all rows; the two moments are one row, broadcast."""
    m = df.agg(F.avg(column).alias("__mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("__std"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, (F.col(column) - F.col("__mean")) / (F.col("__std") + epsilon)).drop("__mean", "__std")


def reinforce(steps: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Return-to-go, whitened over all steps."""
    return whitened(returns_to_go(steps, gamma), "returns", "advantage")


def gae(steps: DataFrame, gamma: float = 1.0, lam: float = 1.0, whiten: bool = True) -> DataFrame:
    """delta_s = r_s + gamma V_{s+1} - V_s, A_s = delta_s + gamma lam A_{s+1}; returns = A + V; then whitened."""
    after = F.coalesce(F.lead("value").over(_forward()), F.lit(0.0))
    delta = steps.withColumn("__delta", F.coalesce("reward", F.lit(0.0)) + gamma * after - F.col("value"))
    out = returns_to_go(delta, gamma * lam, "__delta", "advantage").withColumn("returns", F.col("advantage") + F.col("value")).drop("__delta")
    return whitened(out.withColumnRenamed("advantage", "__a"), "__a", "advantage").drop("__a") if whiten else out


def token_gae(tokens: DataFrame, gamma: float = 1.0, lam: float = 1.0, whiten: bool = True) -> DataFrame:
    """GAE over tokens with mask 1 only, carried across a trajectory's steps; other tokens have advantage and return 0."""
    key = ["trajectory_uid", "step_index", "pos"]
    acting = tokens.filter("mask = 1")
    order = Window.partitionBy("trajectory_uid").orderBy("step_index", "pos")
    ranked = acting.select("trajectory_uid", F.col("step_index").alias("__step"), "pos", "reward", "value", (F.row_number().over(order) - 1).cast("int").alias("step_index"))
    made = gae(ranked, gamma, lam, whiten).select("trajectory_uid", F.col("__step").alias("step_index"), "pos", "advantage", "returns")
    return tokens.join(made, key, "left").withColumns({"advantage": F.coalesce("advantage", F.lit(0.0)), "returns": F.coalesce("returns", F.lit(0.0))})


def exact_anchor_groups(steps: DataFrame) -> DataFrame:
    """anchor_group: steps of a prompt with equal observations."""
    return steps.withColumn("anchor_group", F.sha2(F.concat_ws("\u0001", "uid", "anchor_obs"), 256))


def similar_anchor_groups(steps: DataFrame, threshold: float = 0.95) -> DataFrame:
    """anchor_group: greedy first fit against each cluster's first member, in (trajectory, step) order, by matching-blocks ratio.

    The clusters of a prompt depend on the order of its steps, so a prompt is
    one group; its distinct observations are clustered, not its rows.
    """
    from difflib import SequenceMatcher

    seen = steps.groupBy("uid", "anchor_obs").agg(F.min(F.struct("trajectory_uid", "step_index")).alias("first")).select("uid", "anchor_obs", "first.*")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["trajectory_uid", "step_index"])
        heads: list[str] = []
        groups = []
        for text in pdf["anchor_obs"].fillna(""):
            k = next((i for i, h in enumerate(heads) if SequenceMatcher(None, h, text).ratio() >= threshold), len(heads))
            if k == len(heads):
                heads.append(text)
            groups.append(k)
        return pd.DataFrame({"uid": pdf["uid"], "anchor_obs": pdf["anchor_obs"], "anchor_group": [f"{u}/{g}" for u, g in zip(pdf["uid"], groups, strict=True)]})

    made = seen.groupBy("uid").applyInPandas(cluster, "uid string, anchor_obs string, anchor_group string")
    return steps.join(made.withColumnRenamed("uid", "__u").withColumnRenamed("anchor_obs", "__a"), F.col("uid").eqNullSafe(F.col("__u")) & F.col("anchor_obs").eqNullSafe(F.col("__a"))).drop("__u", "__a")


def gigpo(steps: DataFrame, step_weight: float = 1.0, gamma: float = 1.0, by_std: bool = True, epsilon: float = EPSILON, groups: Callable[[DataFrame], DataFrame] = exact_anchor_groups) -> DataFrame:
    """Episode advantage plus ``step_weight`` times the return-to-go normalised in its anchor group; a lone anchor adds 0."""
    episode = grpo_outcome(steps, by_std, epsilon).drop("returns").withColumnRenamed("advantage", "__episode")
    both = groups(returns_to_go(episode, gamma))
    local = group_normalised(both, F.col("returns"), ["uid", "anchor_group"], "__local", by_std, False, epsilon)
    return local.withColumn("advantage", F.col("__episode") + step_weight * F.col("__local")).drop("__episode", "__local")


#: Estimators by name.
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "gae": gae,
    "token_gae": token_gae,
    "grpo": grpo_outcome,
    "step_grpo": step_grpo,
    "reinforce": reinforce,
    "rloo": rloo,
    "gigpo": gigpo,
}


def compute_advantage(rows: DataFrame, estimator: str, **options) -> DataFrame:
    """Advantages by an estimator's name; an unknown name, or one that needs a baseline rollout, raises."""
    if estimator == "remax":
        raise NotImplementedError("remax needs the score of a greedy rollout that step rows do not have")
    if estimator not in ESTIMATORS:
        raise ValueError(f"no estimator {estimator}; there are {', '.join(sorted(ESTIMATORS))}")
    return ESTIMATORS[estimator](rows, **options)

