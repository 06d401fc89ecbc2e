"""Evaluation reports over attempts, trajectories and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline import checks
from strandline.functions import text as tx
from strandline.operators.credit import consistent


def check_coverage(records: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The records, if they cover each question and sample 0..k-1 exactly once and none is correct but not eligible."""
    expected = questions.select("question_id").withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    checks.require_same_keys(records, expected, "evaluation records", "question_id", "sample_index")
    return checks.require(records, "evaluation records", correct_unknown=F.col("is_correct").isNull(), correct_but_not_eligible=F.col("is_correct") & ~F.col("terminal_eligible"))


def avg_at_k(records: DataFrame, k: int) -> DataFrame:
    """One row: questions, trajectories, correct, accuracy, valid submissions, mean tokens, spread over samples, pass@k.

    Attempts that failed stay in every denominator.
    """
    ok = F.col("is_correct").cast("int")
    # one aggregate by question, then one over questions: attempts are read once
    samples = [F.sum(F.when(F.col("sample_index") == s, ok).otherwise(0)).alias(f"s{s}") for s in range(k)]
    by = records.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.sum(ok).alias("c"), F.sum(F.col("terminal_eligible").cast("int")).alias("e"), F.sum("generated_output_tokens").alias("t"), *samples)
    one = by.agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("total_trajectories"), F.sum("c").alias("correct"), F.sum("e").alias("valid_submissions"), F.sum("t").alias("tokens"), F.count_if(F.col("c") > 0).alias("solved"), *[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)])
    acc = F.col("correct") / F.col("total_trajectories")
    spread = sum(((F.col(f"s{s}") / F.col("total") - acc) ** 2 for s in range(k)), F.lit(0.0))
    std = F.sqrt(spread / (k - 1)) if k > 1 else F.lit(None).cast("double")
    return one.select(
        "total", "total_trajectories", "correct", acc.alias("accuracy"), "valid_submissions", (F.col("total_trajectories") - F.col("valid_submissions")).alias("missing_or_invalid"),
        (F.col("tokens") / F.col("total_trajectories")).alias("mean_tokens"), std.alias("sample_std"), (std / F.sqrt(F.lit(float(k)))).alias("standard_error"), (F.col("solved") / F.col("total")).alias("pass_at_k"),
    )


def per_sample_accuracy(records: DataFrame) -> DataFrame:
    return records.groupBy("sample_index").agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def pass_at_k(records: DataFrame, *by: str) -> DataFrame:
    """Share of questions with a correct attempt, by the given columns of the question."""
    solved = records.groupBy("question_id", *by).agg(F.max(F.col("is_correct").cast("int")).alias("s"))
    return solved.groupBy(*by).agg(F.avg("s").alias("pass_at_k"), F.count(F.lit(1)).alias("questions"))


def histogram(records: DataFrame, column: str) -> DataFrame:
    """Counts by value, and each one's share of all."""
    by = records.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("__all"))
    return by.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def joint_consistency(records: DataFrame) -> DataFrame:
    """Accuracy, C_d (share with all checks 1), M_d (correct and consistent), and the number of verified successes.

    ``records`` has is_correct, terminal_eligible and verification_checks of one
    checkpoint; a correct record that is not eligible is an error, as are
    records of several checkpoints.
    """
    checks.require(records, "evaluation records", correct_but_not_eligible=F.col("is_correct") & ~F.col("terminal_eligible"))
    if "global_step" in records.columns and records.select("global_step").distinct().limit(2).count() > 1:
        raise checks.CheckFailed("evaluation records are of several checkpoints")
    c = consistent(F.col("verification_checks"))
    won = F.col("is_correct") & c
    return records.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.avg(c.cast("double")).alias("c_d"), F.avg(won.cast("double")).alias("m_d"), F.count_if(c).alias("consistent"), F.count_if(won).alias("verified_successes"))


def metric_means(records: DataFrame) -> DataFrame:
    """Mean and own denominator of each metric column; nulls leave a metric's denominator."""
    names = metric_columns(records)
    cols = [x for c in names for x in (F.avg(F.col(c).cast("double")).alias(f"{c}_mean"), F.count(c).alias(f"{c}_denominator"))]
    return records.agg(*cols) if cols else records.limit(0).select()


def metric_columns(records: DataFrame) -> list[str]:
    """Columns of numbers and booleans, by schema."""
    return [f.name for f in records.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def complete_metrics(records: DataFrame, also: tuple[str, ...] = ("pred",)) -> DataFrame:
    """The metric columns without any null, and those in ``also``; nested audits and free text go."""
    names = metric_columns(records)
    counts = records.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in names]).first()
    return records.select([c for c in records.columns if c in also or (c in names and counts["__n"] and counts[c] == counts["__n"])])


def validation_groups(records: DataFrame) -> DataFrame:
    """By data_source: mean over prompts (uid) of the mean, best and majority score of its attempts (score, pred).

    The majority answer of a prompt is the most frequent one, the first in order
    on a tie; its score is the least of its attempts' scores.
    """
    by_answer = records.groupBy("data_source", "uid", "pred").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"), F.sum("score").alias("total"), F.max("score").alias("best"))
    top = F.max_by("s", F.struct("n", F.col("pred"))).alias("maj")
    by_prompt = by_answer.groupBy("data_source", "uid").agg((F.sum("total") / F.sum("n")).alias("mean"), F.max("best").alias("best"), top, F.sum("n").alias("k"))
    return by_prompt.groupBy("data_source").agg(F.avg("mean").alias("mean_score"), F.avg("best").alias("best_score"), F.avg("maj").alias("majority_score"), F.max("k").alias("n_max"), F.count(F.lit(1)).alias("prompts"))


def trajectory_metrics(steps: DataFrame) -> DataFrame:
    """One row of means, maxima and minima over trajectories of steps, prompt and response length, and score."""
    by = steps.filter("not is_padding").groupBy("trajectory_uid").agg(F.count(F.lit(1)).alias("steps"), F.sum("prompt_len").alias("prompt_length"), F.sum("response_len").alias("response_length"), F.sum(F.coalesce("reward", F.lit(0.0))).alias("score"))
    return by.agg(*[f(c).alias(f"{c}_{n}") for c in ("steps", "prompt_length", "response_length", "score") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])


def nested_trajectories(steps: DataFrame) -> DataFrame:
    """One row per trajectory: score, num_steps, first input, last output, and its steps in order."""
    return steps.groupBy("trajectory_uid").agg(
        F.sum(F.coalesce("reward", F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("num_steps"), F.min_by("input", "step_index").alias("input"), F.max_by("output", "step_index").alias("output"),
        F.array_sort(F.collect_list(F.struct("step_index", "input", "output", F.col("reward").alias("score")))).alias("steps"),
    )


def timing(steps: DataFrame) -> DataFrame:
    """Seconds of generation and tools, by step and by trajectory: mean, least, most; and the slowest trajectory (the first of equals)."""
    by = steps.groupBy("trajectory_uid").agg(F.sum("gen_seconds").alias("gen"), F.sum("tool_seconds").alias("tool"), F.sum("gen_seconds").alias("g"), F.count(F.lit(1)).alias("n"), F.sum(F.col("prompt_len") + F.col("response_len")).alias("tokens"))
    total = F.col("gen") + F.col("tool")
    slow = F.min_by(F.struct("trajectory_uid", "tokens"), F.struct(-total, F.col("trajectory_uid")))
    out = by.agg((F.sum("gen") / F.sum("n")).alias("step_gen_mean"), (F.sum("tool") / F.sum("n")).alias("step_tool_mean"), F.min("gen").alias("gen_min"), F.max("gen").alias("gen_max"), F.avg("gen").alias("gen_mean"), F.avg("tool").alias("tool_mean"), F.avg(total).alias("total_mean"), F.max(total).alias("total_max"), slow.alias("slow"))
    return out.select("*", F.col("slow.trajectory_uid").alias("slowest"), F.col("slow.tokens").alias("slowest_tokens")).drop("slow")


def answer_kind(gold: Column) -> Column:
    """``yesno`` or ``entity``, by the normalised gold answer."""
    return F.when(tx.normalize_answer(gold).isin("yes", "no"), "yesno").otherwise("entity")


def graded_answers(rows: DataFrame, pred: str = "answer", gold: str = "ground_truth") -> DataFrame:
    """Adds kind, norm_em, alias, f1 and overlap of each answer. The texts are normalised once per row."""
    p, g = F.col(pred), F.col(gold)
    return rows.withColumns({"kind": answer_kind(g), "norm_em": (tx.normalize_answer(p) == tx.normalize_answer(g)).cast("int"), "alias": tx.is_alias(p, g).cast("int"), "f1": tx.token_f1(p, g), "overlap": tx.token_overlap(p, g)})


def fine_grained(graded: DataFrame, em: str = "score") -> DataFrame:
    """Means of the four measures by kind of answer and overall (kind ``all``), in one pass."""
    by = graded.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.avg(em).alias("em"), F.avg("norm_em").alias("norm_em"), F.avg("alias").alias("alias"), F.avg("f1").alias("f1"))
    return by.withColumn("kind", F.coalesce("kind", F.lit("all")))


def error_bucket(em: Column) -> Column:
    """Why an entity answer that was scored 0 is wrong; null for any other row."""
    wrong = (F.col("kind") == "entity") & (em == 0)
    bucket = F.when(F.col("norm_em") == 1, "normalisation").when(F.col("alias") == 1, "alias").when(F.col("overlap") >= 0.5, "partial").when(F.col("overlap") >= 0.1, "low").otherwise("none")
    return F.when(wrong, bucket)


def error_buckets(graded: DataFrame, em: str = "score") -> DataFrame:
    return histogram(graded.withColumn("bucket", error_bucket(F.col(em))).filter("bucket is not null"), "bucket")


def calibration(rows: DataFrame, group: str = "sample_key", local: str = "local_reward", terminal: str = "score", group_size: int = 8, groups: int = 64) -> DataFrame:
    """Rates of a calibration run and its gates: how often groups with one outcome still differ in local reward."""
    by = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.var_pop(terminal).alias("tv"), F.var_pop(local).alias("lv"), F.sum(local).alias("ls"), F.sum(terminal).alias("ts"), F.count_if(F.col(local) > 0).alias("pos"), F.count_if(F.col(local) >= 1 - 1e-12).alias("sat"))
    same = F.col("tv") <= 1e-12
    one = by.agg(F.sum("n").alias("trajectories"), F.count(F.lit(1)).alias("groups"), F.min(F.col("n") == group_size).alias("sizes_fit"), F.count_if(same).alias("homogeneous"), F.count_if(same & (F.col("lv") > 1e-12)).alias("variable"), (F.sum("ls") / F.sum("n")).alias("local_mean"), (F.sum("ts") / F.sum("n")).alias("terminal_mean"), (F.sum("pos") / F.sum("n")).alias("positive_rate"), (F.sum("sat") / F.sum("n")).alias("saturation"))
    rate = F.when(F.col("homogeneous") > 0, F.col("variable") / F.col("homogeneous")).otherwise(0.0)
    return one.withColumn("conditional_variance_rate", rate).withColumns({
        "gate_groups": (F.col("groups") == groups) & F.col("sizes_fit"), "gate_count": F.col("trajectories") == groups * group_size,
        "gate_positive": F.col("positive_rate").between(0.05, 0.90), "gate_variance": F.col("conditional_variance_rate") >= 0.20, "gate_saturation": F.col("saturation") < 0.90,
    })


def suite_results(cases: DataFrame) -> DataFrame:
    """By run: passed, total, all_passed (not for an empty suite), timed_out, and a digest of the outcomes in order."""
    outcome = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_index", "passed"))), lambda x: F.when(x["passed"], "1").otherwise("0")), "")
    return cases.groupBy("run_id").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), F.bool_and("passed").alias("all_passed"), F.bool_or("timed_out").alias("timed_out"), F.sha2(outcome, 256).alias("outcome_sha256"))


def equation_totals(equations: DataFrame) -> DataFrame:
    """By trajectory: graded steps, and the mean over them of verified over total equations (step_index, lhs, rhs, valid)."""
    by = equations.groupBy("trajectory_uid", "step_index").agg(F.avg(F.col("valid").cast("double")).alias("rate"))
    return by.groupBy("trajectory_uid").agg(F.count(F.lit(1)).alias("graded_steps"), F.avg("rate").alias("process_score"))


def frequent_failures(equations: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent failed equations with their first occurrence; ties by text."""
    bad = equations.filter("not valid").groupBy("lhs", "rhs").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("trajectory_uid", "step_index")).alias("first"))
    return bad.orderBy(F.desc("n"), "lhs", "rhs").limit(k).select("lhs", "rhs", "n", "first.*")


def gated_rate(counts: DataFrame, part: str, whole: str, least: float) -> DataFrame:
    """The rows of counts, if the rate of their sums reaches ``least``."""
    r = counts.agg(F.sum(part).alias("p"), F.sum(whole).alias("w")).first()
    if not r.w or r.p / r.w < least:
        raise checks.CheckFailed(f"{part}/{whole} is {r.p}/{r.w}, less than {least}")
    return counts
