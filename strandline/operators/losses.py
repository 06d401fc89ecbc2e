"""Policy and value objectives on recorded token columns (mask, log_prob, old_log_prob, advantage, value, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQUENCE = ("trajectory_uid", "step_index")


def aggregate_loss(tokens: DataFrame, loss: Column, mode: str = "token-mean", scale: float | None = None, by: tuple[str, ...] = SEQUENCE) -> DataFrame:
    """One row ``loss``: masked tokens' mean, or the mean over sequences of their sum, their mean, or their sum over ``scale``.

    A zero denominator gives 0. Without ``scale``, the last mode divides by the
    longest sequence.
    """
    m = F.col("mask").cast("double")
    if mode == "token-mean":
        return tokens.agg(F.sum(loss * m).alias("s"), F.sum(m).alias("n")).select(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("loss"))
    seq = tokens.groupBy(*by).agg(F.sum(loss * m).alias("s"), F.sum(m).alias("n"), F.count(F.lit(1)).alias("width"))
    live = seq.filter("n > 0")
    if mode == "seq-mean-token-sum":
        out = F.avg("s")
    elif mode == "seq-mean-token-mean":
        out = F.avg(F.col("s") / F.col("n"))
    elif mode == "seq-mean-token-sum-norm":
        return seq.agg((F.sum("s") / (F.lit(float(scale)) if scale else F.max("width"))).alias("loss")).select(F.coalesce("loss", F.lit(0.0)).alias("loss"))
    else:
        raise ValueError(f"no mode {mode}")
    return live.agg(F.coalesce(out, F.lit(0.0)).alias("loss"))


def ratio(limit: float = 20.0) -> Column:
    """exp(log_prob - old_log_prob), with the difference kept in [-limit, limit]."""
    d = F.col("log_prob") - F.col("old_log_prob")
    return F.exp(F.greatest(F.least(d, F.lit(limit)), F.lit(-limit)))


def _mean(x: Column, alias: str) -> Column:
    m = F.col("mask").cast("double")
    return F.when(F.sum(m) > 0, F.sum(x * m) / F.sum(m)).otherwise(0.0).alias(alias)


def clipped_token_loss(low: float, high: float, dual: float) -> Column:
    """The clipped objective of a token, with the second bound for negative advantages."""
    a, r = F.col("advantage"), ratio()
    plain = F.greatest(-a * r, -a * F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low)))
    return F.when(a < 0, F.least(plain, -a * dual)).otherwise(plain)


def clipped_policy(tokens: DataFrame, clip: float = 0.2, low: float | None = None, high: float | None = None, dual: float = 3.0, mode: str = "token-mean", weight: str | None = None) -> DataFrame:
    """One row: loss, clip_fraction, lower_clip_fraction, approximate KL; ``weight`` is an importance-weight column."""
    low, high = clip if low is None else low, clip if high is None else high
    a, r = F.col("advantage"), ratio()
    one = clipped_token_loss(low, high, dual)
    raw, cut = -a * r, -a * F.greatest(F.least(r, F.lit(1 + high)), F.lit(1 - low))
    plain = F.greatest(raw, cut)
    stats = tokens.agg(_mean((cut > raw).cast("double"), "clip_fraction"), _mean(((plain > -a * dual) & (a < 0)).cast("double"), "lower_clip_fraction"), _mean(F.col("old_log_prob") - F.col("log_prob"), "approx_kl"))
    return aggregate_loss(tokens, one * F.col(weight) if weight else one, mode).crossJoin(stats)


def reinforce_policy(tokens: DataFrame, mode: str = "token-mean", weight: str | None = None) -> DataFrame:
    """One row: the loss -advantage * log_prob."""
    one = -F.col("advantage") * F.col("log_prob")
    return aggregate_loss(tokens, one * F.col(weight) if weight else one, mode)


def critic_mask(estimator: str) -> Column:
    """The mask of the value loss: a token's own with ``token_gae``, else that of a step's first position (``pos``) only."""
    return F.col("mask") if estimator == "token_gae" else F.when(F.col("pos") == 0, F.col("mask")).otherwise(F.lit(0))


def value_loss(tokens: DataFrame, clip: float = 0.2, mode: str = "token-mean") -> DataFrame:
    """One row: half the larger of the plain and the clipped squared error of ``new_value``, and how often it was clipped."""
    v, old, g = F.col("new_value"), F.col("value"), F.col("returns")
    kept = F.greatest(F.least(v, old + clip), old - clip)
    plain, cut = (v - g) ** 2, (kept - g) ** 2
    stats = tokens.agg(_mean((cut > plain).cast("double"), "clip_fraction"), _mean(v, "value_mean"))
    return aggregate_loss(tokens, F.greatest(plain, cut), mode).withColumn("loss", F.col("loss") * 0.5).crossJoin(stats)


def total_loss(tokens: DataFrame, entropy_weight: float = 0.0, kl_weight: float = 0.0, mode: str = "token-mean", **clip) -> DataFrame:
    """Policy loss less the weighted entropy plus the weighted KL to a reference, from columns ``entropy`` and ``kl``."""
    out = clipped_policy(tokens, mode=mode, **clip).withColumnRenamed("loss", "policy_loss")
    e = aggregate_loss(tokens, F.col("entropy"), mode).withColumnRenamed("loss", "entropy")
    k = aggregate_loss(tokens, F.col("kl"), mode).withColumnRenamed("loss", "kl")
    return out.crossJoin(e).crossJoin(k).withColumn("loss", F.col("policy_loss") - entropy_weight * F.col("entropy") + kl_weight * F.col("kl"))


def supervised_loss(tokens: DataFrame) -> DataFrame:
    """One row: minus the masked mean log-probability."""
    return aggregate_loss(tokens, -F.col("log_prob"))


#: Policy objectives by name.
POLICY_LOSSES: dict[str, Callable[..., DataFrame]] = {"vanilla": clipped_policy, "reinforce": reinforce_policy}


def policy_loss(name: str) -> Callable[..., DataFrame]:
    if name not in POLICY_LOSSES:
        raise ValueError(f"no policy loss {name}")
    return POLICY_LOSSES[name]


def bypass_policy(tokens: DataFrame, name: str, weight: str, mode: str = "token-mean") -> DataFrame:
    """An objective with importance weights that were computed elsewhere."""
    return policy_loss(name)(tokens, mode=mode, weight=weight)
