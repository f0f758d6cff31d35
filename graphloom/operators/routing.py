"""Routing assignments: from scores to soft gates over three channels (0 low-pass, 1 high-pass or middle, 2 the rest)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashing import uniform
from graphloom.functions.vectors import argmax
from graphloom.plans.ranking import quantiles
from graphloom.storage import staged

CHANNELS = 3


def _uniform() -> Column:
    return F.array(*[F.lit(1.0 / CHANNELS)] * CHANNELS)


def _one_hot(channel: Column) -> Column:
    return F.array(*[(channel == k).cast("double") for k in range(CHANNELS)])


def _terciles(scores: DataFrame, score: str) -> tuple[DataFrame, DataFrame]:
    """The scores, written as they are read several times, and one row: q (the terciles), least and most."""
    scores = staged(scores, "scores")
    low, high = quantiles(scores, score, [1 / 3, 2 / 3])
    finite = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    return scores, finite.agg(F.min(score).alias("least"), F.max(score).alias("most")).withColumn("q", F.array(F.lit(low).cast("double"), F.lit(high).cast("double")))


def bucket_by_quantile(scores: DataFrame, score: str = "score", guarded: bool = True) -> DataFrame:
    """(node_id, gates): the upper third to channel 0, the lower to 2, the rest and undefined scores to 1.

    Guarded: equal terciles give way to minimum and maximum; if those are equal too, all gates are uniform.
    """
    scores, found = _terciles(scores, score)
    bounds = found.select(F.get("q", 0).alias("lo"), F.get("q", 1).alias("hi"), "least", "most")
    if guarded:
        tied = F.col("lo") >= F.col("hi")
        bounds = bounds.select(F.when(tied, F.col("least")).otherwise(F.col("lo")).alias("lo"), F.when(tied, F.col("most")).otherwise(F.col("hi")).alias("hi"))
    value = F.col(score)
    channel = F.when(value >= F.col("hi"), 0).when(value <= F.col("lo"), 2).otherwise(1)
    gates = _one_hot(channel)
    if guarded:
        gates = F.when(F.col("lo") >= F.col("hi"), _uniform()).otherwise(gates)
    return scores.join(F.broadcast(bounds)).select("node_id", gates.alias("gates"))  # one row is broadcast


def bucket_by_homophily(scores: DataFrame, score: str = "h", low: float = 0.4, high: float = 0.6, adaptive: bool = False, gates: tuple[float, float, float] = (1.0, 0.0, 0.0)) -> DataFrame:
    """(node_id, gates): high homophily to channel 0, low to 2 (gates reversed), between to 1; undefined scores are uniform.

    Adaptive bounds are the terciles, unless they are equal: then the fixed ones hold.
    """
    if not adaptive:
        bounds = scores.sparkSession.range(1).select(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    else:
        scores, found = _terciles(scores, score)
        bounds = found.select(F.get("q", 0).alias("lo"), F.get("q", 1).alias("hi"))
        tied = F.col("lo").isNull() | (F.col("lo") >= F.col("hi"))
        bounds = bounds.select(F.when(tied, low).otherwise(F.col("lo")).alias("lo"), F.when(tied, high).otherwise(F.col("hi")).alias("hi"))
    a, b, c = map(F.lit, gates)
    chosen = F.when(F.col(score).isNull(), _uniform()).when(F.col(score) >= F.col("hi"), F.array(a, b, c)).when(F.col(score) <= F.col("lo"), F.array(c, b, a)).otherwise(F.array(b, a, c))
    return scores.join(F.broadcast(bounds)).select("node_id", chosen.alias("gates"))  # one row is broadcast


def by_regime(nodes: DataFrame, regime: str) -> DataFrame:
    return nodes.select("node_id", _one_hot(F.least(F.col(regime), F.lit(CHANNELS - 1))).alias("gates"))


def uniform_gates(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", _uniform().alias("gates"))


def with_channel(assigned: DataFrame) -> DataFrame:
    """The first of the largest gates."""
    return assigned.withColumn("channel", argmax("gates"))


def random_like(assigned: DataFrame, seed: int = 0) -> DataFrame:
    """Independent draws with the channel shares of ``assigned`` (node_id, gates)."""
    shares = with_channel(assigned).agg(*[F.avg((F.col("channel") == k).cast("double")).alias(f"s{k}") for k in range(CHANNELS)])
    u = uniform(seed, "node_id")
    channel = F.when(u < F.col("s0"), 0).when(u < F.col("s0") + F.col("s1"), 1).otherwise(2)
    return assigned.select("node_id").join(F.broadcast(shares)).select("node_id", _one_hot(channel).alias("gates"))  # one row is broadcast


def hard(assigned: DataFrame) -> DataFrame:
    return with_channel(assigned).select("node_id", _one_hot(F.col("channel")).alias("gates"))


def normalised(assigned: DataFrame) -> DataFrame:
    total = F.aggregate("gates", F.lit(0.0), lambda a, v: a + v)
    return assigned.select("node_id", F.transform("gates", lambda g: g / F.greatest(total, F.lit(1e-12))).alias("gates"))


def expert_mask(assigned: DataFrame, channel: int, share: float = 0.99) -> DataFrame:
    """Whether a node counts as the channel's: its gate is within ``share`` of its largest."""
    return assigned.select("node_id", (F.get("gates", channel) >= share * F.array_max("gates")).alias("routed"))


def usage(assigned: DataFrame) -> DataFrame:
    """One row: nodes of each channel, and whether one channel has 90 % of them."""
    counted = with_channel(assigned).agg(*[F.count_if(F.col("channel") == k).alias(f"channel_{k}") for k in range(CHANNELS)])
    counts = [F.col(f"channel_{k}") for k in range(CHANNELS)]
    return counted.withColumn("collapsed", F.greatest(*counts) >= 0.9 * (counts[0] + counts[1] + counts[2]))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: share of nodes with the same channel in both assignments."""
    both = with_channel(a).select("node_id", F.col("channel").alias("ca")).join(with_channel(b).select("node_id", F.col("channel").alias("cb")), "node_id")
    return both.agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("agreement"))


def delta_sweep(scores: DataFrame, deltas: list[float], score: str = "h") -> DataFrame:
    """(delta, node_id, channel): channels with bounds 0.5 -+ delta; undefined scores to channel 0."""
    spread = scores.withColumn("delta", F.explode(F.array(*map(F.lit, deltas))))
    channel = F.when(F.col(score).isNull() | (F.col(score) >= 0.5 + F.col("delta")), 0).when(F.col(score) <= 0.5 - F.col("delta"), 2).otherwise(1)
    return spread.select("delta", "node_id", channel.alias("channel"))


def single_gate(nodes: DataFrame) -> DataFrame:
    """(node_id, gates): one channel for all."""
    return nodes.select("node_id", F.array(F.lit(1.0)).alias("gates"))
