"""Attention tables (passage_id, layer, query, key, p), where absent cells are 0: entropies, aggregation, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.hashing import uniform
from graphloom.graph import build_adjacency


def renormalised(attention: DataFrame) -> DataFrame:
    """Rows that sum to 1; rows without weight stay 0."""
    total = F.sum("p").over(Window.partitionBy("passage_id", "layer", "query"))
    return attention.withColumn("p", F.col("p") / F.when(total > 1e-12, total).otherwise(1.0))


def entropies(attention: DataFrame) -> DataFrame:
    """(passage_id, layer, query, entropy in nats) of each row, after normalising it."""
    p = F.greatest(F.col("p"), F.lit(1e-12))
    return renormalised(attention).groupBy("passage_id", "layer", "query").agg((-F.sum(p * F.log(p))).alias("entropy"))


def entropy_features(attention: DataFrame) -> DataFrame:
    """(passage_id, query, mean, most, std (population)) of a row's entropy over the layers."""
    return entropies(attention).groupBy("passage_id", "query").agg(F.avg("entropy").alias("mean"), F.max("entropy").alias("most"), F.stddev_pop("entropy").alias("std"))


def over_layers(attention: DataFrame, n_layers: int, how: str = "mean") -> DataFrame:
    """(passage_id, query, key, p): mean, max or median over ``n_layers``; layers without the cell count 0."""
    if how not in ("mean", "max", "median"):
        raise ValueError(f"unknown aggregation {how!r}")
    if how == "median":
        padded = F.sort_array(F.concat(F.collect_list("p"), F.array_repeat(F.lit(0.0), (F.lit(n_layers) - F.count("*")).cast("int"))))  # as many as layers
        middle = (F.get(padded, (n_layers - 1) // 2) + F.get(padded, n_layers // 2)) / 2
        return attention.groupBy("passage_id", "query", "key").agg(middle.alias("p"))
    return attention.groupBy("passage_id", "query", "key").agg((F.sum("p") / n_layers if how == "mean" else F.max("p")).alias("p"))


def top_k(attention: DataFrame, k: int) -> DataFrame:
    """Cells of each row that are no smaller than its k-th largest: ties stay."""
    order = Window.partitionBy("passage_id", "query").orderBy(F.desc("p"))
    return attention.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= k).drop("_rank")


def to_edges(attention: DataFrame, k: int | None = None) -> DataFrame:
    """Edges between positions of one passage: top k of each row, then both directions averaged. (passage_id, src, dst, w)."""
    kept = attention if k is None else top_k(attention, k)
    pair = kept.where("query <> key").select("passage_id", F.least("query", "key").alias("src"), F.greatest("query", "key").alias("dst"), F.greatest("p", F.lit(0.0)).alias("w"))
    return pair.groupBy("passage_id", "src", "dst").agg((F.sum("w") / 2).alias("w")).where("w > 0")


def synthetic_layers(edges: DataFrame, nodes: DataFrame, n_layers: int = 4, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """Noisy attention of a small graph: every cell gets its weight (1 on the diagonal) and hashed noise, rows sum to 1."""
    cells = nodes.select(F.col("node_id").alias("query")).crossJoin(nodes.select(F.col("node_id").alias("key")))
    both = edges.select(F.col("src").alias("query"), F.col("dst").alias("key"), "w").union(edges.select("dst", "src", "w"))
    base = cells.join(both, ["query", "key"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)) + (F.col("query") == F.col("key")).cast("double"))
    layered = base.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(n_layers - 1))))
    own = F.col("w") / F.sum("w").over(Window.partitionBy("layer", "query"))
    noisy = layered.withColumn("p", own + noise * uniform(seed, "layer", "query", "key")).withColumn("passage_id", F.lit(0).cast("long"))
    return renormalised(noisy.select("passage_id", "layer", "query", "key", "p"))


def adjacency(attention: DataFrame) -> DataFrame:
    return build_adjacency(attention.select(F.col("query").alias("src"), F.col("key").alias("dst"), F.col("p").alias("w")))


def digest(attention: DataFrame) -> DataFrame:
    """(passage_id, digest): a SHA-256 of each passage's cells, the same whatever the partitioning."""
    row = F.sha2(F.concat_ws(":", "layer", "query", "key", F.round("p", 9).cast("string")), 256)
    return attention.groupBy("passage_id").agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list(row))), 256).alias("digest"))
