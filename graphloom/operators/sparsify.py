"""Sparsifiers of weighted graphs. Each takes edges (src, dst, w) and returns edges of the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashing import uniform
from graphloom.graph import Graph, both_ways, degrees
from graphloom.plans.ranking import global_rank



def threshold(edges: DataFrame, tau: float) -> DataFrame:
    """Edges heavier than ``tau``, at their weights."""
    return edges.where(F.col("w") > tau)


def _count(edges: DataFrame) -> int:
    return edges.count()


def threshold_for_budget(edges: DataFrame, budget: int) -> DataFrame:
    """Edges heavier than the ``budget``-th heaviest: that one and its ties go."""
    if budget < 1:
        return edges.limit(0)
    ranked = global_rank(edges, F.desc("w"), F.asc("src"), F.asc("dst"))
    bar = ranked.where(F.col("rank") == budget).select(F.col("w").alias("_bar"))
    return edges.join(F.broadcast(bar), F.col("w") > F.col("_bar")).drop("_bar") if _count(edges) >= budget else edges


def random_edges(edges: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """``budget`` edges drawn without replacement by hash, their weights scaled to keep the expected total; all of them if that few."""
    total = _count(edges)
    if budget >= total:
        return edges
    drawn = global_rank(edges.withColumn("_u", uniform(seed, "src", "dst")), F.asc("_u"), F.asc("src"), F.asc("dst"))
    return drawn.where(F.col("rank") <= budget).select("src", "dst", (F.col("w") * (total / max(budget, 1))).alias("w"))


def degree_scores(graph: Graph) -> DataFrame:
    """Edges with ``score``, the product of both ends' weighted degrees plus 1, rounded so that no rounding error breaks a tie."""
    wdeg = degrees(graph).select("node_id", "wdeg")
    joined = graph.edges.join(wdeg.select(F.col("node_id").alias("src"), F.col("wdeg").alias("ws")), "src").join(wdeg.select(F.col("node_id").alias("dst"), F.col("wdeg").alias("wd")), "dst")
    return joined.select("src", "dst", "w", F.round((F.col("ws") + 1) * (F.col("wd") + 1), 6).alias("score"))


def top_edges(scored: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` edges of highest ``score``, ties by (src, dst)."""
    ranked = global_rank(scored, F.desc("score"), F.asc("src"), F.asc("dst"))
    return ranked.where(F.col("rank") <= budget).select("src", "dst", "w")


def degree_edges(graph: Graph, budget: int) -> DataFrame:
    return top_edges(degree_scores(graph), budget)


def importance(edges: DataFrame, n_nodes: int, budget: int, epsilon: float, rule: Column | None = None, least: float = 0.0) -> DataFrame:
    """``q``, an edge's keeping probability from its resistance ``r``: min(1, C w r ln n / eps^2), 0 where ``rule`` is below ``least``."""
    import math

    log_n = math.log(n_nodes)
    scale = budget / (n_nodes * (log_n + 1e-12))
    q = F.least(F.lit(1.0), scale * F.col("w") * F.col("r") * log_n / (epsilon**2 + 1e-12))
    return edges.withColumn("q", q if rule is None else F.when(rule >= least, q).otherwise(0.0))


def spectral_edges(edges: DataFrame, n_nodes: int, budget: int, epsilon: float = 0.1, sample: bool = False, seed: int = 0, rule: Column | None = None, least: float = 0.0) -> DataFrame:
    """Edges by effective resistance (column ``r``): all with q > 0 if they are within the budget, else the highest q, ties by (src, dst).

    With ``sample`` each edge is drawn by hash with probability q; if more than the budget are drawn, the choice is as
    without. A kept edge's weight is divided by its q. A budget of no edges gives none, one of all edges changes nothing.
    """
    if budget < 1:
        return edges.select("src", "dst", "w").limit(0)
    if rule is None and budget >= _count(edges):
        return edges.select("src", "dst", "w")
    scored = importance(edges, n_nodes, budget, epsilon, rule, least).where("q > 0")
    chosen = scored.where(uniform(seed, "src", "dst") < F.col("q")) if sample else scored
    if _count(chosen) > budget:
        ranked = global_rank(scored.withColumn("_q", F.round("q", 12)), F.desc("_q"), F.asc("src"), F.asc("dst"))
        chosen = ranked.where(F.col("rank") <= budget)
    return chosen.select("src", "dst", (F.col("w") / F.greatest("q", F.lit(1e-8))).alias("w"))


def mass_match(sparse: DataFrame, full: DataFrame) -> DataFrame:
    """``sparse`` with weights scaled so that their total is that of ``full``."""
    total = full.agg(F.sum("w").alias("_full")).join(F.broadcast(sparse.agg(F.sum("w").alias("_own"))))  # one row each
    return sparse.join(F.broadcast(total)).select("src", "dst", F.when(F.col("_own") > 0, F.col("w") * F.col("_full") / F.col("_own")).otherwise(F.col("w")).alias("w"))


def retention_grid(graph: Graph, retentions: list[float], seed: int = 0, methods: tuple[str, ...] = ("random", "degree", "weight")) -> DataFrame:
    """(method, retention, src, dst, w) of the methods at all retentions: random, degree, weight and er (``resistance_grid``).

    Each method ranks the edges once; a point is a comparison with its budget, so that a grid costs no more shuffles
    than a single point. Budgets round half to even.
    """
    total = _count(graph.edges)
    points = [(r, int(round(r * total))) for r in retentions]
    grid = F.array(*[F.struct(F.lit(r).alias("retention"), F.lit(b).alias("budget")) for r, b in points])

    def at_points(ranked: DataFrame, method: str, scale: bool) -> DataFrame:
        rows = ranked.withColumn("p", F.explode(grid)).where(F.col("rank") <= F.col("p.budget"))
        factor = F.when(F.col("p.budget") < total, F.lit(float(total)) / F.col("p.budget")).otherwise(1.0) if scale else F.lit(1.0)
        return rows.select(F.lit(method).alias("method"), F.col("p.retention").alias("retention"), "src", "dst", (F.col("w") * factor).alias("w"))

    ranked = {
        "random": lambda: global_rank(graph.edges.withColumn("_u", uniform(seed, "src", "dst")), F.asc("_u"), F.asc("src"), F.asc("dst")),
        "degree": lambda: global_rank(degree_scores(graph), F.desc("score"), F.asc("src"), F.asc("dst")),
        "weight": lambda: global_rank(graph.edges, F.desc("w"), F.asc("src"), F.asc("dst")),
    }
    if unknown := set(methods) - {*ranked, "er"}:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    out = None
    for method in methods:
        part = resistance_grid(graph, retentions, seed) if method == "er" else at_points(ranked[method](), method, method == "random")
        out = part if out is None else out.union(part)
    return out


def resistance_edges(graph: Graph, budget: int, seed: int = 0, epsilon: float = 0.1) -> DataFrame:
    """``budget`` edges by effective resistance, drawn with ``spectral_edges``' probabilities; resistances are projected ones (``iterative``)."""
    from graphloom.operators.iterative import sketched_resistance

    return spectral_edges(sketched_resistance(graph, seed=seed), graph.nodes.count(), budget, epsilon, sample=True, seed=seed)


def resistance_grid(graph: Graph, retentions: list[float], seed: int = 0, epsilon: float = 0.1) -> DataFrame:
    """(method, retention, src, dst, w) of the resistance method (``er``) at all retentions; resistances are worked out once.

    An edge's probability depends on the budget, so that each point draws for itself. Budgets round half to even.
    """
    from graphloom.operators.iterative import sketched_resistance

    scored = sketched_resistance(graph, seed=seed)
    total, nodes = _count(scored), graph.nodes.count()
    points = [spectral_edges(scored, nodes, int(round(r * total)), epsilon, sample=True, seed=seed).select(F.lit("er").alias("method"), F.lit(r).alias("retention"), "src", "dst", "w") for r in retentions]
    out = points[0]
    for point in points[1:]:
        out = out.union(point)
    return out


def frobenius_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the Frobenius norm of the difference of two graphs' Laplacians, from their edges alone."""
    both = a.select("src", "dst", F.col("w").alias("wa")).join(b.select("src", "dst", F.col("w").alias("wb")), ["src", "dst"], "full").select("src", "dst", (F.coalesce("wa", F.lit(0.0)) - F.coalesce("wb", F.lit(0.0))).alias("w"))
    off = both.agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0)).alias("off"))
    diagonal = both_ways(both).groupBy("src").agg(F.sum("w").alias("d")).agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0.0)).alias("diag"))
    return diagonal.join(F.broadcast(off)).select(F.sqrt(F.col("diag") + 2 * F.col("off")).alias("frobenius"))  # one row each


METHODS: dict[str, Callable[[Graph, int, int], DataFrame]] = {
    "random": lambda g, budget, seed: random_edges(g.edges, budget, seed),
    "degree": lambda g, budget, seed: degree_edges(g, budget),
    "er": lambda g, budget, seed: resistance_edges(g, budget, seed),
    "threshold": lambda g, budget, seed: threshold_for_budget(g.edges, budget),
}
