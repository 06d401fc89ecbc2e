import pytest
from pyspark.sql import functions as F

from strandline.operators import advantage as adv

SCHEMA = "uid string, trajectory_uid string, step_index int, reward double, value double, anchor_obs string"


def steps(spark, r1, r2):
    rows = [("q", t, i, float(r), 0.5, "a") for t, rs in (("r1", r1), ("r2", r2)) for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("trajectory_uid", "step_index").collect()]


def test_returns_are_causal(spark):
    assert column(adv.returns_to_go(steps(spark, [0, 0.5, 0], [0, 0, 0])), "returns") == [0.5, 0.5, 0, 0, 0, 0]


def test_step_grpo_centres_within_prompt_and_step(spark):
    got = adv.step_grpo(steps(spark, [0, 0, 1], [0, 0, 0]), by_std=False)
    assert column(got, "advantage") == [0.5, 0.5, 0.5, -0.5, -0.5, -0.5]


def test_unscaled_advantages_of_a_prompt_sum_to_zero(spark):
    got = adv.grpo_outcome(steps(spark, [1, 2, 3], [0, 1, 0]), by_std=False)
    assert abs(got.agg(F.sum("advantage")).first()[0]) < 1e-12


def test_a_lone_trajectory_keeps_its_score(spark):
    one = steps(spark, [1, 2, 3], []).filter("trajectory_uid = 'r1'")
    assert column(adv.rloo(one), "advantage") == [6, 6, 6]
    assert column(adv.grpo_outcome(one, by_std=False), "advantage") == [6, 6, 6]
    assert column(adv.grpo_outcome(one), "advantage") == pytest.approx([6 / (1 + 1e-6)] * 3)


def test_a_lone_anchor_adds_nothing(spark):
    one = steps(spark, [1], []).filter("trajectory_uid = 'r1'")
    assert column(adv.gigpo(one, by_std=False), "advantage") == [1]


def test_discount_counts_missing_steps(spark):
    rows = [("q", "r", 0, 1.0, 0.0, "a"), ("q", "r", 3, 8.0, 0.0, "a")]
    got = adv.returns_to_go(spark.createDataFrame(rows, SCHEMA), 0.5)
    assert column(got, "returns") == [2, 8]


def test_long_trajectories_do_not_underflow(spark):
    rows = [("q", "r", i, 1.0, 0.0, "a") for i in range(3000)]
    got = column(adv.returns_to_go(spark.createDataFrame(rows, SCHEMA), 0.5), "returns")
    assert got[0] == pytest.approx(2) and got[-1] == 1 and min(got) >= 1


def test_gae_equals_the_recursion(spark):
    got = adv.gae(steps(spark, [1, 0, 2], [0, 1, 0]), 0.9, 0.8, whiten=False)
    want = []
    for rs in ([1, 0, 2], [0, 1, 0]):
        out, a = [], 0.0
        for i in reversed(range(3)):
            delta = rs[i] + 0.9 * (0.5 if i < 2 else 0) - 0.5
            a = delta + 0.72 * a
            out.append(a)
        want += out[::-1]
    assert column(got, "advantage") == pytest.approx(want)


def test_similar_anchors_join_the_first_cluster_that_fits(spark):
    rows = [("q", "r", i, 0.0, 0.0, t) for i, t in enumerate(["abcdefghij", "abcdefghix", "zzzz"])]
    got = column(adv.similar_anchor_groups(spark.createDataFrame(rows, SCHEMA), 0.8), "anchor_group")
    assert got == ["q/0", "q/0", "q/1"]


def test_unknown_and_unsupported_estimators_raise(spark):
    one = steps(spark, [1], [1])
    with pytest.raises(ValueError):
        adv.compute_advantage(one, "none")
    with pytest.raises(NotImplementedError):
        adv.compute_advantage(one, "remax")


def test_every_row_gets_its_return_in_trajectories_of_any_length(spark):
    rows = [("q", t, i, float(i % 7), 0.0, "a") for t, n in (("r1", 1), ("r2", 64), ("r3", 65), ("r4", 1000)) for i in range(n) if i % 5 != 3]
    got = {(r.trajectory_uid, r.step_index): r.returns for r in adv.returns_to_go(spark.createDataFrame(rows, SCHEMA), 0.9).collect()}
    assert len(got) == len(rows)
    for _, t, i, *_ in rows:
        assert got[t, i] == pytest.approx(sum(r * 0.9 ** (j - i) for _, u, j, r, *_ in rows if u == t and j >= i))


def test_null_and_repeated_steps_stay_once(spark):
    rows = [("q", "r", None, 1.0, 0.0, "a"), ("q", "r", 0, 2.0, 0.0, "b"), ("q", "r", 0, 2.0, 0.0, "b"), ("q", "r", 1, 4.0, 0.0, "c"), ("q", None, 0, 3.0, 0.0, "d"), ("q", None, 1, None, 0.0, "d")]
    got = adv.returns_to_go(spark.createDataFrame(rows, SCHEMA), 0.5).collect()
    assert sorted((str(r.trajectory_uid), str(r.step_index), r.returns) for r in got) == [("None", "0", 3.0), ("None", "1", 0.0), ("r", "0", 4.0), ("r", "0", 6.0), ("r", "1", 4.0), ("r", "None", 7.0)]
    assert adv.returns_to_go(spark.createDataFrame([], SCHEMA), 0.5).count() == 0


def test_a_null_prompt_is_a_group(spark):
    rows = [(u, f"{u}{t}", 0, float(t), 0.0, "a") for u in (None, "q") for t in (0, 2)]
    got = adv.grpo_outcome(spark.createDataFrame(rows, SCHEMA), by_std=False).collect()
    assert sorted((str(r.uid), r.advantage) for r in got) == [("None", -1.0), ("None", 1.0), ("q", -1.0), ("q", 1.0)]
