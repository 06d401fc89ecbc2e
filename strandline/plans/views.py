"""The driver's tables in the roles of the trajectory domain, as DataFrames and as DuckDB SQL.

Each view is here twice: a function that makes it with Spark, and the text of a
common table expression that makes the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step rows from events: a prompt per event type, a trajectory per type and user."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_type").alias("uid"), F.concat_ws(":", "event_type", "user_id").alias("trajectory_uid"), (F.row_number().over(w) - 1).alias("step_index"), F.col("value").alias("reward"),
        (F.pmod("event_id", F.lit(7)) / F.lit(10.0)).alias("value"), F.concat(F.lit("k"), F.pmod(k, F.lit(5)).cast("string")).alias("anchor_obs"), (F.pmod("event_id", F.lit(50)) + 1).cast("int").alias("prompt_len"), (F.pmod("event_id", F.lit(30)) + 1).cast("int").alias("response_len"),
        (F.pmod("event_id", F.lit(13)) / F.lit(4.0)).alias("gen_seconds"), (F.pmod("event_id", F.lit(11)) / F.lit(8.0)).alias("tool_seconds"), (F.pmod("event_id", F.lit(17)) == 0).alias("is_padding"), F.col("event_id").alias("row_id"), k.alias("k"),
    )


STEPS = """steps AS (
  SELECT event_type AS uid, event_type || ':' || user_id AS trajectory_uid, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS INT) AS step_index, value AS reward,
    (event_id % 7) / 10.0::DOUBLE AS value, 'k' || (k % 5) AS anchor_obs, CAST(event_id % 50 + 1 AS INT) AS prompt_len, CAST(event_id % 30 + 1 AS INT) AS response_len,
    (event_id % 13) / 4.0::DOUBLE AS gen_seconds, (event_id % 11) / 8.0::DOUBLE AS tool_seconds, event_id % 17 = 0 AS is_padding, event_id AS row_id, k
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)
)"""

K = 4


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records: a question per user, its first four events as attempts, correct if a purchase."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ranked = e.withColumn("sample_index", F.row_number().over(w) - 1).filter(F.col("sample_index") < K)
    k = F.get_json_object("props", "$.k").cast("int")
    ok = F.col("event_type") == "purchase"
    return ranked.select(
        F.col("user_id").cast("string").alias("question_id"), "sample_index", ok.alias("is_correct"), (ok | (F.pmod("event_id", F.lit(3)) > 0)).alias("terminal_eligible"), F.col("event_type").alias("termination_reason"), F.pmod("event_id", F.lit(100)).alias("generated_output_tokens"),
        F.transform(F.sequence(F.lit(1), F.pmod(k, F.lit(4))), lambda i: F.when(F.pmod(k, F.lit(3)) == 0, 1.0).otherwise(0.5)).alias("checks_raw"), k.alias("k"), (F.pmod(k, F.lit(10)) / F.lit(10.0)).alias("answer_f1"), F.pmod("user_id", F.lit(3)).cast("string").alias("data_source"),
    ).withColumn("verification_checks", F.when(F.pmod("k", F.lit(4)) == 0, F.array().cast("array<double>")).otherwise(F.col("checks_raw"))).drop("checks_raw")


ATTEMPTS = f"""attempts AS (
  SELECT CAST(user_id AS VARCHAR) AS question_id, sample_index, event_type = 'purchase' AS is_correct, event_type = 'purchase' OR event_id % 3 > 0 AS terminal_eligible, event_type AS termination_reason, event_id % 100 AS generated_output_tokens, k,
    k % 4 AS n_checks, CASE WHEN k % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS check_score, (k % 10) / 10.0::DOUBLE AS answer_f1, CAST(user_id % 3 AS VARCHAR) AS data_source
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_index FROM events) WHERE sample_index < {K}
)"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check slots from step rows: a group per parity of three steps, scored by the props number."""
    s = steps(spark, sf_dir)
    return s.select("trajectory_uid", F.concat(F.lit("g"), F.floor(F.col("step_index") / 3).cast("string")).alias("group_id"), F.lit("interaction_step").alias("group_kind"), F.pmod("step_index", F.lit(3)).alias("slot"), "step_index", (F.pmod("k", F.lit(5)) / F.lit(4.0)).alias("score"), (F.pmod("k", F.lit(3)) > 0).alias("applicable"), (F.pmod("k", F.lit(2)) + F.lit(1.0)).alias("base_weight"))


SLOTS = STEPS + """, slots AS (
  SELECT trajectory_uid, 'g' || (step_index // 3) AS group_id, step_index % 3 AS slot, step_index, (k % 5) / 4.0::DOUBLE AS score, k % 3 > 0 AS applicable, (k % 2) + 1.0::DOUBLE AS base_weight FROM steps
)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from conversations: each turn's text against the text of the turn before."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    prev = F.lag("text").over(w)
    yes = F.pmod("conv_id", F.lit(7)) == 0
    gold = F.when(yes, "Yes").when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(F.lit("The "), F.col("text"), F.lit("!"))).otherwise(F.coalesce(prev, F.col("text")))
    return c.select("conv_id", "turn", "role", F.col("text").alias("answer"), gold.alias("ground_truth"), (F.pmod("turn", F.lit(4)) == 3).cast("int").alias("score"))


ANSWERS = """answers AS (
  SELECT conv_id, turn, role, text AS answer,
    CASE WHEN conv_id % 7 = 0 THEN 'Yes' WHEN conv_id % 3 = 0 THEN 'The ' || text || '!' ELSE coalesce(prev, text) END AS ground_truth,
    CASE WHEN turn % 4 = 3 THEN 1 ELSE 0 END AS score
  FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
)"""


def norm_sql(x: str) -> str:
    """DuckDB for a normalised answer."""
    bare = f"translate(lower({x}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', '')"
    article = "'(^|[^\\pL\\pN_])(a|an|the)([^\\pL\\pN_]|$)', '\\1 \\3', 'g'"
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace({bare}, {article}), {article}), '\\s+'), lambda w: w <> ''), ' ')"


GRADED = ANSWERS + f""", normed AS (
  SELECT *, {norm_sql("answer")} AS p, {norm_sql("ground_truth")} AS g FROM answers
), toks AS (
  SELECT *, CASE WHEN p = '' THEN []::VARCHAR[] ELSE string_split(p, ' ') END AS pt, CASE WHEN g = '' THEN []::VARCHAR[] ELSE string_split(g, ' ') END AS gt FROM normed
), same AS (
  SELECT *, coalesce(list_sum(list_transform(list_distinct(pt), lambda t: least(len(list_filter(pt, lambda y: y = t)), len(list_filter(gt, lambda y: y = t))))), 0) AS same FROM toks
), graded AS (
  SELECT *, CASE WHEN g IN ('yes', 'no') THEN 'yesno' ELSE 'entity' END AS kind, CASE WHEN p = g THEN 1 ELSE 0 END AS norm_em,
    CASE WHEN p = g OR (p <> '' AND g <> '' AND (contains(p, g) OR contains(g, p)) AND list_has_any(pt, gt) AND least(len(pt), len(gt)) >= 2) THEN 1 ELSE 0 END AS alias,
    CASE WHEN len(pt) = 0 AND len(gt) = 0 THEN 1.0 WHEN len(pt) = 0 OR len(gt) = 0 OR same = 0 THEN 0.0 ELSE 2.0::DOUBLE * same / (len(pt) + len(gt)) END::DOUBLE AS f1,
    CASE WHEN len(gt) = 0 THEN 0.0 ELSE len(list_intersect(pt, gt))::DOUBLE / len(list_distinct(gt)) END::DOUBLE AS overlap
  FROM same
)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows: three per step, the first of which is not acted on, with recorded log-probabilities and values."""
    t = steps(spark, sf_dir).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2))))
    n = F.col("row_id") * 3 + F.col("pos")
    return t.select(
        "uid", "trajectory_uid", "step_index", "pos", (F.col("pos") > 0).cast("int").alias("mask"), F.when(F.col("pos") == 2, F.col("reward") / 100).otherwise(0.0).alias("reward"), (F.pmod(n, F.lit(9)) / F.lit(10.0)).alias("value"), (F.pmod(n, F.lit(8)) / F.lit(10.0)).alias("new_value"),
        (-F.pmod(n, F.lit(23)) / F.lit(10.0)).alias("log_prob"), (-F.pmod(n, F.lit(19)) / F.lit(10.0)).alias("old_log_prob"), ((F.pmod(n, F.lit(11)) - 5) / F.lit(4.0)).alias("advantage"), (F.pmod(n, F.lit(10)) / F.lit(8.0)).alias("returns"), (F.pmod(n, F.lit(5)) / F.lit(16.0)).alias("entropy"), (F.pmod(n, F.lit(3)) / F.lit(32.0)).alias("kl"), (F.pmod(n, F.lit(4)) / F.lit(2.0)).alias("weight"),
    )


TOKENS = STEPS + """, tokens AS (
  SELECT uid, trajectory_uid, step_index, pos, CASE WHEN pos > 0 THEN 1 ELSE 0 END AS mask, CASE WHEN pos = 2 THEN reward / 100 ELSE 0.0::DOUBLE END AS reward, (n % 9) / 10.0::DOUBLE AS value, (n % 8) / 10.0::DOUBLE AS new_value,
    -(n % 23) / 10.0::DOUBLE AS log_prob, -(n % 19) / 10.0::DOUBLE AS old_log_prob, (n % 11 - 5) / 4.0::DOUBLE AS advantage, (n % 10) / 8.0::DOUBLE AS returns, (n % 5) / 16.0::DOUBLE AS entropy, (n % 3) / 32.0::DOUBLE AS kl, (n % 4) / 2.0::DOUBLE AS weight
  FROM (SELECT s.*, p.pos, s.row_id * 3 + p.pos AS n FROM steps s, (SELECT unnest([0, 1, 2]) AS pos) p)
)"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero, so that engines agree to the last digit."""
    return df.select([(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
