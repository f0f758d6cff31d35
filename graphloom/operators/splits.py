"""Stratified splits, permutations and subsamples by hash, repeatable on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashing import uniform
from graphloom.plans.ranking import global_rank, grouped_rank


def stratified_split(nodes: DataFrame, fraction: float, seed: int, label: str = "y") -> DataFrame:
    """(node_id, label, part): of each label the first max(1, round half even of fraction x size) rows by hash train, the rest test."""
    ranked = grouped_rank(nodes.select("node_id", label, uniform(seed, "node_id").alias("_u")), label, F.asc("_u"), F.asc("node_id"), name="_n")
    sizes = nodes.groupBy(label).agg(F.count("*").alias("_size"))
    part = F.when(F.col("_n") <= F.greatest(F.lit(1.0), F.rint(F.lit(fraction) * F.col("_size"))), "train").otherwise("test")
    return ranked.join(sizes, label).select("node_id", label, part.alias("part"))


def fit_router_split(split: DataFrame, fraction: float, seed: int, label: str = "y") -> DataFrame:
    """The training rows of a split as fit and router rows; ``fraction`` of each label go to the router."""
    inner = stratified_split(split.where("part = 'train'"), fraction, seed, label)
    return inner.select("node_id", label, F.when(F.col("part") == "train", "router").otherwise("fit").alias("part"))


def permute_within(rows: DataFrame, strata: str, value: str, seed: int) -> DataFrame:
    """``rows`` (node_id, strata, value) with the values of each stratum dealt anew among its nodes."""
    seats = grouped_rank(rows.select("node_id", strata), strata, F.asc("node_id"), name="_n")
    dealt = grouped_rank(rows.select(strata, F.col(value), "node_id", uniform(seed, "node_id").alias("_u")), strata, F.asc("_u"), F.asc("node_id"), name="_n").select(strata, value, "_n")
    return seats.join(dealt, [strata, "_n"]).select("node_id", strata, value)


def strided(nodes: DataFrame, n: int) -> DataFrame:
    """About ``n`` nodes at even distances in the order of their ids: places round half even of i (N - 1) / (n - 1)."""
    total = nodes.count()
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * F.lit((total - 1) / max(n - 1, 1))).cast("long") + 1)
    wanted = nodes.sparkSession.range(1).select(F.explode(F.array_distinct(places)).alias("rank"))
    return global_rank(nodes, F.asc("node_id")).join(wanted, "rank", "left_semi").drop("rank")
