import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline import checks
from strandline.operators import credit, losses, prep, reports, sampling

EVAL = "question_id string, sample_index int, is_correct boolean, terminal_eligible boolean, termination_reason string, generated_output_tokens bigint"
TFS = ["TTFT", "FFFT", "FFFF"]


def records(spark, drop=0):
    rows = [(str(q), s, c == "T", True, "done", 10) for q, x in enumerate(TFS) for s, c in enumerate(x)]
    return spark.createDataFrame(rows[drop:], EVAL)


def test_avg_at_k(spark):
    r = reports.avg_at_k(records(spark), 4).first()
    assert r.accuracy == pytest.approx(4 / 12) and r.pass_at_k == pytest.approx(2 / 3)
    assert r.sample_std == pytest.approx(math.sqrt(2 / 27)) and r.standard_error == pytest.approx(math.sqrt(2 / 27) / 2)
    assert [x.accuracy for x in reports.per_sample_accuracy(records(spark)).orderBy("sample_index").collect()] == pytest.approx([1 / 3, 1 / 3, 0, 2 / 3])


def test_missing_and_repeated_records_raise(spark):
    questions = records(spark).select("question_id").distinct()
    with pytest.raises(checks.CheckFailed):
        reports.check_coverage(records(spark, 1), questions, 4)
    with pytest.raises(checks.CheckFailed):
        reports.check_coverage(records(spark).unionByName(records(spark).limit(1)), questions, 4)
    assert reports.check_coverage(records(spark), questions, 4).count() == 12


def test_joint_consistency(spark):
    rows = [("q1", [1.0], True, True), ("q2", [0.0, 1.0], True, True), ("q3", [], False, True), ("q4", [1.0], False, False)]
    df = spark.createDataFrame(rows, "question_id string, verification_checks array<double>, is_correct boolean, terminal_eligible boolean")
    r = reports.joint_consistency(df).first()
    assert (r.accuracy, r.c_d, r.m_d, r.verified_successes) == (0.5, 0.5, 0.25, 1)
    with pytest.raises(checks.CheckFailed):
        reports.joint_consistency(df.withColumn("terminal_eligible", F.lit(False)))


def composed(spark, credits, gate, terminal=0.0, weights=(0.7, 0.3), **options):
    c = spark.createDataFrame([("t", s, x) for s, x in credits], "trajectory_uid string, step_index int, score double")
    t = spark.createDataFrame([("t", 3, terminal, gate, *weights)], "trajectory_uid string, last_step int, terminal_reward double, gate boolean, terminal_weight double, process_weight double")
    return credit.compose(t, c, **options).orderBy("step_index").collect()


def test_composed_reward(spark):
    shut = composed(spark, [(1, 0.25), (2, 0.75)], False)
    assert [r.reward for r in shut] == [0, 0, 0]
    kept = composed(spark, [(1, 0.25), (2, 0.75)], False, process_needs_submission=False)
    assert [r.reward for r in kept] == pytest.approx([0.075, 0.225, 0]) and kept[0].total == pytest.approx(0.3)
    assert composed(spark, [(1, 0.5)], True)[0].total == pytest.approx(0.15)


def test_credits_over_one_raise(spark):
    df = spark.createDataFrame([("t", 1, 0.6), ("t", 2, 0.6)], "trajectory_uid string, step_index int, score double")
    with pytest.raises(PySparkException):
        credit.credits_by_step(df).collect()
    with pytest.raises(PySparkException):
        composed(spark, [(4, 0.5)], True)


SLOT = "trajectory_uid string, group_id string, group_kind string, slot int, step_index int, score double, applicable boolean, base_weight double"


def test_group_weights(spark):
    rows = [("t", "a", "interaction_step", 0, 0, 1.0, True, 1.0), ("t", "a", "interaction_step", 1, 0, 0.0, True, 3.0), ("t", "b", "singleton_artifact", 0, 1, 1.0, True, 1.0), ("t", "c", "interaction_step", 0, 2, 1.0, False, 1.0), ("u", "c", "interaction_step", 0, 0, 1.0, False, 1.0)]
    df = credit.check_slots(spark.createDataFrame(rows, SLOT))
    assert {(r.trajectory_uid): r.process_reward for r in credit.process_reward(df).collect()} == {"t": 0.625, "u": 0.0}
    with pytest.raises(checks.CheckFailed):
        credit.check_slots(spark.createDataFrame([("t", "a", "interaction_step", 0, 0, 1.5, True, 1.0)], SLOT))


def test_metric_columns(spark):
    rows = [(0.0, False, "a", None, [1.0]), (1.0, True, "b", 1.0, [1.0])]
    df = spark.createDataFrame(rows, "reward double, acc boolean, reason string, optional double, credits array<double>")
    assert reports.complete_metrics(df).columns == ["reward", "acc"]


def test_timing(spark):
    rows = [("a", 0, 1.0, 0.5, 1, 1), ("a", 1, 2.0, 0.0, 1, 1), ("b", 0, 4.0, 1.0, 1, 1)]
    r = reports.timing(spark.createDataFrame(rows, "trajectory_uid string, step_index int, gen_seconds double, tool_seconds double, prompt_len int, response_len int")).first()
    assert (r.step_gen_mean, r.step_tool_mean, r.gen_min, r.gen_max, r.total_mean, r.slowest) == (pytest.approx(7 / 3), 0.5, 3, 4, 4.25, "b")


def test_loss_of_masked_rows_is_zero(spark):
    t = spark.createDataFrame([("t", 0, 0, 0, 1.0)], "trajectory_uid string, step_index int, pos int, mask int, x double")
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        assert losses.aggregate_loss(t, F.col("x"), mode).first().loss == 0


def test_prefix_and_length_gates(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "i int, t string")
    assert prep.prefix(df, "i", 3).count() == 3
    with pytest.raises(checks.CheckFailed):
        prep.prefix(df, "i", 9)
    with pytest.raises(checks.CheckFailed):
        prep.within_length(df, F.length("t"), 3)


def test_numbering_is_gapless_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "NUMBERED_ROWS", 10)
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "o int, k int")
    got = sampling.numbered(df, "o", "k").orderBy("o").collect()
    assert [r.n for r in got] == list(range(101))


def test_case_split_keeps_two_hidden(spark):
    df = spark.createDataFrame([(str(n), i) for n in (1, 2, 3, 4, 9) for i in range(n)], "task_id string, case_index int")
    got = {r.task_id: r.d for r in sampling.split_cases(df, 0.9).groupBy("task_id").agg(F.count_if(F.col("split") == "developer").alias("d")).collect()}
    assert got == {"1": 0, "2": 1, "3": 1, "4": 2, "9": 7}
