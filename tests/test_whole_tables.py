"""Queries read their whole tables: every row that goes in is in the result, whatever its id or its place."""

import os
import re

import pytest

import __spark_entry__ as entry
from strandline.plans import views
from tests.test_oracles import SF, duck, table  # noqa: F401

#: Bounds on the input that the registered SQL has and the whole job has not.
BOUNDS = re.compile(r" (?:WHERE|AND) (?:step_index < (?:6|8|10|12)|event_id < 400|event_id % [39] = 0|k % 2 = 0|l_orderkey % 7 = 0|o_orderkey % 5 = 0|doc_id % 10 = 0|doc_id % 4 = 1)(?![0-9])")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def run(spark, name):
    return entry.queries()[name](spark, SF)


STEPS = "verification_group_credit process_reward composed_reward recursive_ancestors dependency_taint coupling_fixpoint credits_by_step code_artifact_credit visual_credit horizon_credit certificate_summary".split()
TOKENS = "token_gae_advantage loss_aggregation clipped_policy_loss bypass_policy_loss total_policy_loss reinforce_loss clipped_value_loss supervised_loss".split()
DOCUMENTS = ["evidence_store", "jsonl_round_trip"]
THINNED = "passage_budget case_split execution_lineage submission_certificates execution_credit".split()


@pytest.mark.parametrize("name", STEPS + TOKENS + DOCUMENTS + THINNED)
def test_result_is_that_of_the_whole_tables(spark, duck, name):  # noqa: F811
    df = run(spark, name)
    want = duck.sql(BOUNDS.sub("", entry.oracle_sql()[name]))
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(want.columns, want.fetchall())


def test_novelty_reads_all_steps(spark):
    assert run(spark, "novelty_credit").count() == views.steps(spark, SF).count()


def test_all_events_pass_through_the_sink(spark):
    events = {r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()}
    got = [r.sample_index for r in run(spark, "streaming_append").select("sample_index").collect()]
    assert len(events) > 400 and sorted(got) == sorted(events)


def test_all_steps_become_tokens(spark):
    assert views.tokens(spark, SF).count() == 3 * views.steps(spark, SF).count()
    ends = views.tokens(spark, SF).groupBy("trajectory_uid").agg({"step_index": "max"}).collect()
    assert max(r[1] for r in ends) >= 6
    gae = run(spark, "token_gae_advantage")
    assert gae.select("trajectory_uid", "step_index").distinct().count() == views.steps(spark, SF).count()


def test_losses_are_means_over_all_tokens(spark):
    t = [r for r in views.tokens(spark, SF).select("mask", "log_prob").collect() if r.mask]
    assert run(spark, "supervised_loss").first().loss == pytest.approx(-sum(r.log_prob for r in t) / len(t), abs=1e-5)
