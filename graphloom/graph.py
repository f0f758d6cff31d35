"""The graph contract: nodes, and undirected weighted edges written once with src < dst and w > 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``nodes`` (node_id, y, x: array of double, ...) and ``edges`` (src, dst, w), src < dst, no pair twice."""

    nodes: DataFrame
    edges: DataFrame

    def both_ways(self) -> DataFrame:
        """Every edge in both directions."""
        return both_ways(self.edges)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").union(edges.select(F.col("dst"), F.col("src"), F.col("w")))


def build_adjacency(cells: DataFrame) -> DataFrame:
    """Edges of a weight matrix given by its cells (src, dst, w): negative weights count 0, both directions are averaged, the diagonal goes."""
    pair = cells.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.greatest("w", F.lit(0.0)).alias("w"))
    return pair.groupBy("src", "dst").agg((F.sum("w") / 2).alias("w")).where("w > 0")


def edges_from_pairs(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected edges of weight 1: directions and repetitions are one edge, loops are none."""
    return pairs.where(F.col(src) != F.col(dst)).select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).distinct().withColumn("w", F.lit(1.0))


def degrees(graph: Graph) -> DataFrame:
    """(node_id, deg, wdeg) of every node: neighbours and total weight; 0 for isolated nodes."""
    found = graph.both_ways().groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("deg"), F.sum("w").alias("wdeg"))
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"), F.coalesce("wdeg", F.lit(0.0)).alias("wdeg"))


def laplacian(graph: Graph) -> DataFrame:
    """Non-zero cells (row, col, val) of D - W."""
    diagonal = degrees(graph).where("wdeg > 0").select(F.col("node_id").alias("row"), F.col("node_id").alias("col"), F.col("wdeg").alias("val"))
    return diagonal.union(graph.both_ways().select("src", "dst", -F.col("w")))


def normalized_adjacency(graph: Graph) -> DataFrame:
    """Cells (row, col, val) of the symmetrically normalised adjacency with a loop of weight 1 at every node."""
    scale = degrees(graph).select("node_id", (1 + F.col("wdeg")).alias("d"))
    loops = scale.select(F.col("node_id").alias("row"), F.col("node_id").alias("col"), (1 / F.col("d")).alias("val"))
    a, b = scale.select(F.col("node_id").alias("src"), F.col("d").alias("ds")), scale.select(F.col("node_id").alias("dst"), F.col("d").alias("dd"))
    return loops.union(graph.both_ways().join(a, "src").join(b, "dst").select("src", "dst", F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))))


def quadratic_form(graph: Graph, signal: DataFrame) -> DataFrame:
    """One row: the sum of w (f_i - f_j)^2 over the edges, for ``signal`` (node_id, f)."""
    a, b = signal.select(F.col("node_id").alias("src"), F.col("f").alias("fs")), signal.select(F.col("node_id").alias("dst"), F.col("f").alias("fd"))
    return graph.edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(F.col("w") * (F.col("fs") - F.col("fd")) * (F.col("fs") - F.col("fd"))), F.lit(0.0)).alias("energy"))


def induced(graph: Graph, keep: DataFrame) -> Graph:
    """The subgraph of the nodes in ``keep`` (node_id)."""
    kept = keep.select("node_id").distinct()
    edges = graph.edges.join(kept.withColumnRenamed("node_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return Graph(graph.nodes.join(kept, "node_id", "left_semi"), edges.select("src", "dst", "w"))


def contract_violations(graph: Graph) -> DataFrame:
    """One row of counts: unordered, repeated, non-positive and dangling edges. All are 0 for a graph within the contract."""
    flags = graph.edges.agg(F.count_if(F.col("src") >= F.col("dst")).alias("unordered"), F.count_if(~(F.col("w") > 0)).alias("non_positive"))
    repeated = graph.edges.groupBy("src", "dst").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().join(graph.nodes, "node_id", "left_anti").agg(F.count("*").alias("dangling"))
    key = F.lit(1).alias("key")
    return flags.select(key, "*").join(repeated.select(key, "*"), "key").join(ends.select(key, "*"), "key").drop("key")
