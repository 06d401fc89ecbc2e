"""Verification credits: bounded scores of checks, their normalised weights, and rewards composed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import checks
from strandline.functions import hashing
from strandline.operators import graphs

TOLERANCE = 1e-8


def weighted_slots(slots: DataFrame) -> DataFrame:
    """The weight of each check slot (trajectory_uid, group_id, slot, score, applicable, base_weight).

    Within a group the applicable slots share 1 by base weight; the groups with
    an applicable slot share 1 evenly. Adds inner_weight, group_weight,
    effective_weight, credit. A failed check keeps its weight; a group with
    nothing applicable has none.
    """
    on = F.col("applicable")
    group, whole = Window.partitionBy("trajectory_uid", "group_id"), Window.partitionBy("trajectory_uid")
    norm = F.sum(F.when(on, F.col("base_weight")).otherwise(0.0)).over(group)
    inner = F.when(on, F.col("base_weight") / norm).otherwise(0.0)
    # groups with something applicable, counted once at their first slot
    leads = F.row_number().over(group.orderBy("slot")) == 1
    marked = slots.withColumns({"inner_weight": inner, "__live": F.max(on.cast("int")).over(group)}).withColumn("__lead", F.when(leads, F.col("__live")).otherwise(0))
    groups = F.sum("__lead").over(whole)
    weighted = marked.withColumn("group_weight", F.when(F.col("__live") == 1, 1.0 / groups).otherwise(0.0))
    return weighted.withColumn("effective_weight", F.col("inner_weight") * F.col("group_weight")).withColumn("credit", F.col("effective_weight") * F.col("score")).drop("__live", "__lead")


def check_slots(slots: DataFrame) -> DataFrame:
    """The slots, if scores are in [0, 1], weights fit, and a singleton group has one slot."""
    checks.require(
        slots,
        "check slots",
        score_out_of_range=~F.col("score").between(0, 1),
        weight_missing=F.col("base_weight") < 0,
        applicable_without_weight=F.col("applicable") & (F.col("base_weight") <= 0),
        group_unnamed=F.col("group_id") == "",
    )
    lone = slots.filter("group_kind = 'singleton_artifact'").groupBy("trajectory_uid", "group_id").agg(F.count(F.lit(1)).alias("n"))
    checks.require(lone, "singleton groups", more_than_one_slot=F.col("n") != 1)
    return slots


def group_credits(slots: DataFrame) -> DataFrame:
    """trajectory_uid, group_id, group_score, group_weight, credit of each group."""
    return weighted_slots(slots).groupBy("trajectory_uid", "group_id").agg(F.sum(F.col("inner_weight") * F.col("score")).alias("group_score"), F.max("group_weight").alias("group_weight"), F.sum("credit").alias("credit"))


def process_reward(slots: DataFrame) -> DataFrame:
    """trajectory_uid and its process reward; 0 where no check applies."""
    return weighted_slots(slots).groupBy("trajectory_uid").agg(F.sum("credit").alias("process_reward"))


def credits_by_step(credits: DataFrame) -> DataFrame:
    """trajectory_uid, step_index, score and the audits of credits at one step; a trajectory's total is at most 1."""
    by = credits.groupBy("trajectory_uid", "step_index").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("credits"))
    total = F.sum("score").over(Window.partitionBy("trajectory_uid"))
    return by.withColumn("score", F.when(total <= 1 + TOLERANCE, F.col("score")).otherwise(F.raise_error(F.lit("the credits of a trajectory are more than 1")).cast("double")))


def uniform_schedule(global_step: Column, is_validation: Column, warmup_steps: int, key: Column, namespace: str) -> Column:
    """struct(terminal_weight, process_weight, phase): terminal only in validation and warm-up, then one hash-uniform weight per prompt."""
    w = hashing.uniform_weight(namespace, global_step, key)
    fixed = is_validation | (global_step <= warmup_steps)
    return F.struct(F.when(fixed, 1.0).otherwise(w).alias("terminal_weight"), F.when(fixed, 0.0).otherwise(1 - w).alias("process_weight"), F.when(is_validation, "validation").when(global_step <= warmup_steps, "warmup").otherwise("mixed").alias("phase"))


def fixed_schedule(global_step: Column, is_validation: Column, warmup_steps: int, terminal_weight: float) -> Column:
    """As :func:`uniform_schedule`, with one fixed weight; warm-up is 0 < step <= ``warmup_steps``."""
    fixed = is_validation | ((global_step > 0) & (global_step <= warmup_steps))
    return F.struct(F.when(fixed, 1.0).otherwise(terminal_weight).alias("terminal_weight"), F.when(fixed, 0.0).otherwise(1 - terminal_weight).alias("process_weight"))


#: Terminal weight of the arms that do not draw one: fixed values.
ARM_WEIGHTS = {"A0": 1.0, "A1": 1.0, "A2": 0.0, "A7": 0.5}


def arm_schedule(arm: Column, global_step: Column, is_validation: Column, warmup_steps: int, key: Column, namespace: str) -> Column:
    """Weights of an arm: fixed for those in ARM_WEIGHTS, else drawn per prompt."""
    drawn = uniform_schedule(global_step, is_validation, warmup_steps, key, namespace)
    table = F.create_map(*[F.lit(x) for kv in ARM_WEIGHTS.items() for x in kv])
    fixed = F.try_element_at(table, arm)
    w = F.when(is_validation, 1.0).otherwise(F.coalesce(fixed, drawn["terminal_weight"]))
    return F.struct(w.alias("terminal_weight"), (1 - w).alias("process_weight"))


def compose(trajectories: DataFrame, credits: DataFrame, process_needs_submission: bool = True) -> DataFrame:
    """Reward of each step: its credits times the process weight, and at the last step the terminal part.

    ``trajectories`` has trajectory_uid, last_step, terminal_reward, gate,
    terminal_weight, process_weight. Without the gate there is no terminal part,
    and unless ``process_needs_submission`` is off no credit either. Returns
    trajectory_uid, step_index, reward, and total, which is at most 1.
    """
    terminal = F.when(F.col("gate"), F.col("terminal_weight") * checks.bounded(F.col("terminal_reward"), 0, 1, "terminal reward")).otherwise(0.0)
    open_ = F.col("gate") if process_needs_submission else F.lit(True)
    joined = credits.groupBy("trajectory_uid", "step_index").agg(F.sum("score").alias("score")).join(trajectories, "trajectory_uid")
    late = F.col("step_index") > F.col("last_step")
    part = F.when(late, F.raise_error(F.lit("a credit names a step that the trajectory has not")).cast("double")).when(open_, F.col("process_weight") * F.col("score")).otherwise(0.0)
    steps = joined.select("trajectory_uid", "step_index", part.alias("reward"))
    last = trajectories.select("trajectory_uid", F.col("last_step").alias("step_index"), terminal.alias("reward"))
    by = steps.unionByName(last).groupBy("trajectory_uid", "step_index").agg(F.sum("reward").alias("reward"))
    total = F.sum("reward").over(Window.partitionBy("trajectory_uid"))
    return by.withColumn("total", F.when(total <= 1 + TOLERANCE, total).otherwise(F.raise_error(F.lit("a composed reward is more than 1")).cast("double")))


def consistent(check_scores: Column) -> Column:
    """Whether there are checks and all are 1."""
    return (F.size(check_scores) > 0) & F.forall(check_scores, lambda x: x == 1)


def first_cover(found: DataFrame, gold: DataFrame) -> DataFrame:
    """The step at which each gold item of a trajectory is first returned: (trajectory_uid, item, step_index)."""
    hits = found.join(gold, ["trajectory_uid", "item"], "left_semi")
    return hits.groupBy("trajectory_uid", "item").agg(F.min("step_index").alias("step_index"))


def marginal_coverage(found: DataFrame, gold: DataFrame, unresolved: DataFrame | None = None) -> DataFrame:
    """Credit of each step for the gold items it is first to return, over all gold items; none for a trajectory with unresolved facts."""
    total = gold.groupBy("trajectory_uid").agg(F.countDistinct("item").alias("gold"))
    new = first_cover(found, gold).groupBy("trajectory_uid", "step_index").agg(F.count(F.lit(1)).alias("new"))
    out = new.join(total, "trajectory_uid").select("trajectory_uid", "step_index", (F.col("new") / F.col("gold")).alias("score"))
    return out.join(unresolved, "trajectory_uid", "left_anti") if unresolved is not None else out


def execution_credit(steps: DataFrame, horizon: int) -> DataFrame:
    """success/horizon for the first ``horizon`` steps of a trajectory."""
    rank = F.row_number().over(Window.partitionBy("trajectory_uid").orderBy("step_index"))
    return steps.withColumn("__r", rank).filter(F.col("__r") <= horizon).select("trajectory_uid", "step_index", (F.col("success").cast("double") / horizon).alias("score"))


def judge_credit(scored: DataFrame, max_steps: int) -> DataFrame:
    """score/max_steps; one failed judgement voids its trajectory."""
    bad = F.max(F.col("score").isNull().cast("int")).over(Window.partitionBy("trajectory_uid"))
    return scored.withColumn("__bad", bad).select("trajectory_uid", "step_index", F.when(F.col("__bad") == 1, 0.0).otherwise(F.col("score") / max_steps).alias("score"))


def evidence_metrics(returned: DataFrame, gold: DataFrame, eligible: DataFrame) -> DataFrame:
    """recall, precision and both_supports of each trajectory in ``eligible`` (trajectory_uid, eligible).

    Not eligible: all null. Eligible with nothing returned: precision 0.
    """
    got = returned.select("trajectory_uid", "item").distinct()
    want = gold.select("trajectory_uid", "item").distinct()
    hit = got.join(want, ["trajectory_uid", "item"], "left_semi").groupBy("trajectory_uid").agg(F.count(F.lit(1)).alias("hit"))
    n_got = got.groupBy("trajectory_uid").agg(F.count(F.lit(1)).alias("got"))
    n_want = want.groupBy("trajectory_uid").agg(F.count(F.lit(1)).alias("want"))
    j = eligible.join(n_got, "trajectory_uid", "left").join(n_want, "trajectory_uid", "left").join(hit, "trajectory_uid", "left").fillna(0, ["got", "want", "hit"])
    ok = F.col("eligible") & (F.col("want") > 0)
    return j.select("trajectory_uid", F.when(ok, F.col("hit") / F.col("want")).alias("recall"), F.when(ok, F.when(F.col("got") > 0, F.col("hit") / F.col("got")).otherwise(0.0)).alias("precision"), F.when(ok, F.col("hit") == F.col("want")).alias("both_supports"))


def taint(nodes: DataFrame, edges: DataFrame, gamma: float = 0.3) -> DataFrame:
    """gamma to the number of invalid ancestors, times the node's own validity; nodes are (trajectory_uid, ref, valid)."""
    n = graphs.count_ancestors(edges, nodes.filter("not valid").select("trajectory_uid", "ref")).withColumnRenamed("n", "bad")
    return nodes.join(n, ["trajectory_uid", "ref"], "left").fillna(0, ["bad"]).withColumn("weight", F.pow(F.lit(gamma), F.col("bad")) * F.col("valid").cast("double"))


def self_correction(rows: DataFrame) -> DataFrame:
    """Adds self_correction: valid now, after an earlier row of the trajectory that was not."""
    before = Window.partitionBy("trajectory_uid").orderBy("step_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("self_correction", F.col("valid") & F.coalesce(F.max((~F.col("valid")).cast("int")).over(before) == 1, F.lit(False)))
