"""Connected components and reports on connectivity.

Components come from alternating large-star and small-star steps (Kiveris et
al., 2014): each step moves edges towards smaller nodes without adding any, and
a few rounds leave a star around each component's smallest node. A node's
smallest neighbour is a partial aggregate, so that a hub's edges meet in no
single task before the join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.storage import staged


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node itself, linked to the smallest of them. Links go from ``u`` down to ``v``."""
    lowest = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours linked to the smallest of its neighbours and itself."""
    both = links.union(links.select("v", "u"))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def link_components(links: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, int]:
    """((node, component) of every node that has a link, number of rounds). A component's name is its smallest node.

    Links may repeat, go either way or lead to the node itself; one that lacks an end is left out.
    """
    down = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, rounds, before = staged(down.distinct(), "links"), 0, None
    marks = [F.count("*"), *[F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(p))) for p in (2147483647, 2147483629)]]
    while (state := tuple(now.agg(*marks).first())) != before:
        before, rounds = state, rounds + 1
        now = staged(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    lone = links.where(F.col(a) == F.col(b)).select(F.col(a).alias("node")).distinct().join(named, "node", "left_anti")
    return staged(named.union(lone.select("node", F.col("node").alias("component"))), "components"), rounds


def connected_components(graph: Graph) -> DataFrame:
    """(node_id, component): the smallest node id of its component; a node without edges is its own."""
    named, _ = link_components(graph.edges, "src", "dst")
    named = named.select(F.col("node").alias("node_id"), "component")
    return graph.nodes.select("node_id").join(named, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def largest_component(graph: Graph) -> DataFrame:
    """(node_id) of the largest component, of the smallest name if several are as large."""
    named = connected_components(graph)
    largest = named.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return named.join(F.broadcast(largest), "component").select("node_id")


def connectivity_report(reference: Graph, other: Graph) -> DataFrame:
    """One row: components of both graphs, which are their Laplacians' zero eigenvalues, and how many the second has gained."""
    counts = [connected_components(g).agg(F.count_distinct("component").alias(name)) for g, name in ((reference, "zeros_reference"), (other, "zeros_other"))]
    joined = counts[0].join(F.broadcast(counts[1]))  # one row each
    return joined.withColumn("gained", F.greatest(F.lit(0), F.col("zeros_other") - F.col("zeros_reference")).cast("long"))
