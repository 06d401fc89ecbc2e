"""Rewards, losses and advantages by name, as functions of SQL.

Each is a formula that Catalyst inlines into the query: no user-defined function
is left in the plan, and where the name is a constant, no choice either.

    SELECT policy_loss('clipped', log_prob, old_log_prob, advantage) FROM tokens
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_RATIO = "exp(greatest(least(log_prob - old_log_prob, 20.0D), -20.0D))"
_WORDS = "trim(regexp_replace(lower({0}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))"

#: name -> (parameters, type, formula)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "policy_ratio": ("log_prob DOUBLE, old_log_prob DOUBLE", "DOUBLE", _RATIO),
    "clipped_loss": (
        "log_prob DOUBLE, old_log_prob DOUBLE, advantage DOUBLE, low DOUBLE DEFAULT 0.2, high DOUBLE DEFAULT 0.2, dual DOUBLE DEFAULT 3.0", "DOUBLE",
        f"CASE WHEN advantage < 0 THEN least(greatest(-advantage * {_RATIO}, -advantage * greatest(least({_RATIO}, 1 + high), 1 - low)), -advantage * dual) ELSE greatest(-advantage * {_RATIO}, -advantage * greatest(least({_RATIO}, 1 + high), 1 - low)) END",
    ),
    "bypass_loss": ("log_prob DOUBLE, old_log_prob DOUBLE, advantage DOUBLE", "DOUBLE", f"-advantage * {_RATIO}"),
    "reinforce_loss": ("log_prob DOUBLE, advantage DOUBLE", "DOUBLE", "-advantage * log_prob"),
    "value_loss": ("new_value DOUBLE, value DOUBLE, target DOUBLE, clip DOUBLE DEFAULT 0.5", "DOUBLE", "0.5 * greatest(pow(new_value - target, 2), pow(greatest(least(new_value, value + clip), value - clip) - target, 2))"),
    "group_advantage": (
        "estimator STRING, score DOUBLE, mean DOUBLE, sd DOUBLE, n BIGINT", "DOUBLE",
        "CASE estimator WHEN 'grpo' THEN CASE WHEN n = 1 THEN score / (1 + 1e-6D) ELSE (score - mean) / (sd + 1e-6D) END WHEN 'mean_only' THEN CASE WHEN n = 1 THEN score ELSE score - mean END WHEN 'rloo' THEN CASE WHEN n = 1 THEN score ELSE (score - mean) * n / (n - 1) END ELSE CAST(raise_error(concat('no estimator ', coalesce(estimator, 'null'))) AS DOUBLE) END",
    ),
    "answer_reward": (
        "rule STRING, answer STRING, truth STRING", "DOUBLE",
        "CASE rule WHEN 'exact' THEN CAST(coalesce(answer = truth, false) AS DOUBLE) WHEN 'same_words' THEN CAST(coalesce({a} <> '' AND {a} = {t}, false) AS DOUBLE) WHEN 'contains' THEN CAST(coalesce({t} <> '' AND contains(concat(' ', {a}, ' '), concat(' ', {t}, ' ')), false) AS DOUBLE) ELSE CAST(raise_error(concat('no rule ', coalesce(rule, 'null'))) AS DOUBLE) END".format(a=_WORDS.format("answer"), t=_WORDS.format("truth")),
    ),
}
#: Those that choose among the others by name, and so are made after them.
CHOICES: dict[str, tuple[str, str, str]] = {
    "policy_loss": (
        "objective STRING, log_prob DOUBLE, old_log_prob DOUBLE, advantage DOUBLE", "DOUBLE",
        "CASE objective WHEN 'clipped' THEN clipped_loss(log_prob, old_log_prob, advantage) WHEN 'bypass' THEN bypass_loss(log_prob, old_log_prob, advantage) WHEN 'reinforce' THEN reinforce_loss(log_prob, advantage) ELSE CAST(raise_error(concat('no objective ', coalesce(objective, 'null'))) AS DOUBLE) END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names. An own one is added by ``CREATE TEMPORARY FUNCTION`` in the same way."""
    for name, (takes, gives, formula) in (FUNCTIONS | CHOICES).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {formula}")
    return [*FUNCTIONS, *CHOICES]
