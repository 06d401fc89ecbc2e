"""Schemas at the boundary, as DDL."""

DATASET_ROW = "data_source STRING, prompt ARRAY<STRUCT<role: STRING, content: STRING>>, ability STRING, reward_model STRUCT<style: STRING, ground_truth: STRING>, extra_info STRUCT<index: BIGINT, split: STRING, question_id: STRING, source: STRING, answers: ARRAY<STRING>>"
STEP = "uid STRING, trajectory_uid STRING, step_index INT, reward DOUBLE, value DOUBLE, anchor_obs STRING, prompt_len INT, response_len INT, gen_seconds DOUBLE, tool_seconds DOUBLE, is_padding BOOLEAN"
TOKEN = "trajectory_uid STRING, step_index INT, pos INT, mask INT, reward DOUBLE, value DOUBLE, log_prob DOUBLE, old_log_prob DOUBLE, advantage DOUBLE"
CHECK_SLOT = "trajectory_uid STRING, group_id STRING, group_kind STRING, slot INT, step_index INT, score DOUBLE, applicable BOOLEAN, base_weight DOUBLE"
EVALUATION = "question_id STRING, sample_index INT, is_correct BOOLEAN, terminal_eligible BOOLEAN, termination_reason STRING, generated_output_tokens BIGINT, verification_checks ARRAY<DOUBLE>, answer_f1 DOUBLE, global_step BIGINT"
PARAGRAPH = "pid BIGINT, title STRING, text STRING"
EMBEDDING = "pid BIGINT, embedding ARRAY<FLOAT>"
SEARCH_RECORD = "sample_index INT, sample_key STRING, question STRING, search_queries ARRAY<STRING>, answer STRING, ground_truth STRING, score DOUBLE"
