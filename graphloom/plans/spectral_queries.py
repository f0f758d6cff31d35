"""Queries on spectra, resistances and experts. Spectra are those of the parts' graph, whole or of its strong edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import graph as G
from graphloom.graph import Graph
from graphloom.operators import components as C
from graphloom.operators import experts as E
from graphloom.operators import iterative as I  # noqa: E741
from graphloom.operators import label_free as L
from graphloom.operators import routing as R
from graphloom.operators import scores as S
from graphloom.operators import sparsify as X
from graphloom.operators import spectral as K
from graphloom.operators import splits as P
from graphloom.operators import stats as T
from graphloom.plans.graph_queries import NAMED, RETENTIONS, STRONG, D, r, rounded, sql
from graphloom.plans.register import query
from graphloom.sources.tables import part_graph
from graphloom.storage import staged


def _strong(spark, folder) -> Graph:
    g = part_graph(spark, folder)
    return Graph(g.nodes, X.threshold(g.edges, 0.6))


@query("trace_identity", sql(f"SELECT {r('(SELECT sum(w) * 2 FROM strong)', 'trace')}, {r('(SELECT sum(d * d) FROM (SELECT src, sum(w) AS d FROM (SELECT src, w FROM strong UNION ALL SELECT dst, w FROM strong) GROUP BY src)) + 2 * (SELECT sum(w * w) FROM strong)', 'trace_square')}, ((SELECT count(*) FROM nodes) - (SELECT count(DISTINCT component) FROM named))::BIGINT AS resistance_energy, (SELECT count(DISTINCT component) FROM named)::BIGINT AS zeros", STRONG, recursive=True))
def trace_identity(spark, folder):
    return rounded(K.identities(_strong(spark, folder)))


@query("spectral_ratio_identity", sql(f"SELECT node_id, {r('wdeg', 'energy')}, {r('wdeg / ((SELECT max(wdeg) FROM deg) + 1e-12)', 'ratio')} FROM deg"))
def spectral_ratio_identity(spark, folder):
    return rounded(K.spectral_ratio(part_graph(spark, folder)))


def _whole(spark, folder) -> Graph:
    g = part_graph(spark, folder)
    return Graph(g.nodes, staged(g.edges, "edges"))


@query("spectrum_traces", sql(f"SELECT {r('(SELECT sum(w) * 2 FROM strong)', 'trace')}, {r('(SELECT sum(d * d) FROM (SELECT src, sum(w) AS d FROM (SELECT src, w FROM strong UNION ALL SELECT dst, w FROM strong) GROUP BY src)) + 2 * (SELECT sum(w * w) FROM strong)', 'trace_square')}, (SELECT count(DISTINCT component) FROM named)::BIGINT AS zeros", STRONG, recursive=True))
def spectrum_traces(spark, folder):
    """The eigenvalues, summed: they have to give the closed forms, exactly on components of up to ``EXACT_NODES`` nodes, which all are at small scale factors."""
    v, w = F.col("eigenvalue"), F.col("weight")
    found = K.spectrum(_strong(spark, folder))
    zero = F.count_distinct(F.when((v < 1e-8) | (w != 1), F.struct("component")))
    return rounded(found.agg(F.sum(v * w).alias("trace"), F.sum(v * v * w).alias("trace_square"), zero.alias("zeros")))


@query("resistance_energy", sql("SELECT ((SELECT count(*) FROM nodes) - (SELECT count(DISTINCT component) FROM named))::DOUBLE AS energy", STRONG, recursive=True))
def resistance_energy(spark, folder):
    """Exact resistances: the sum of w r is the nodes less the components."""
    return rounded(K.effective_resistance(_strong(spark, folder)).agg(F.sum(F.col("w") * F.col("r")).alias("energy")), 5)


@query("resistance_sketch_energy", sql("SELECT ((SELECT count(*) FROM nodes) - (SELECT count(DISTINCT component) FROM named))::BIGINT AS energy, true AS within", ", strong AS (SELECT * FROM edges)" + NAMED, recursive=True))
def resistance_sketch_energy(spark, folder):
    """Whether the projected resistances of the whole graph sum to the nodes less the components within 2 %."""
    g = _whole(spark, folder)
    known = K.identities(g).select(F.col("resistance_energy").alias("energy"))
    found = I.sketched_resistance(g).agg(F.sum(F.col("w") * F.col("r")).alias("found"))
    return known.join(F.broadcast(found)).select("energy", (F.abs(F.col("found") - F.col("energy")) <= 0.02 * F.col("energy")).alias("within"))  # one row each


@query("resistance_sketch_errors")
def resistance_sketch_errors(spark, folder):
    """Errors of projected resistances against exact ones, over the edges of components that have them."""
    return K.sketch_errors(_whole(spark, folder))


@query("smallest_modes")
def smallest_modes(spark, folder):
    """The 16 smallest eigenvalues after 0 of the largest component's Laplacian, and whether their residuals are below a millionth."""
    g = _whole(spark, folder)
    part = G.induced(g, C.largest_component(g))
    _, values, residuals = I.extreme_modes(part, 16, tolerance=2e-8)
    rows = [(i, round(v, 6) + 0.0, r < 1e-6) for i, (v, r) in enumerate(zip(values, residuals, strict=True))]
    return spark.createDataFrame(rows, "idx int, eigenvalue double, converged boolean")


@query("largest_modes")
def largest_modes(spark, folder):
    """The 8 largest eigenvalues of the whole graph's Laplacian."""
    _, values, _ = I.extreme_modes(_whole(spark, folder), 8, largest=True)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(values)], "idx int, eigenvalue double")


@query("spectral_density")
def spectral_density(spark, folder):
    """How many eigenvalues of the whole graph lie below each sixteenth of the interval that holds them all, estimated."""
    g = _whole(spark, folder)
    values, weights = I.quadrature(g)
    top = 2 * G.degrees(g).agg(F.max("wdeg")).first()[0]
    rows = [(i, float(weights[values <= top * i / 16].sum())) for i in range(1, 17)]
    return spark.createDataFrame(rows, "sixteenths int, nodes double")


@query("spectrum_small")
def spectrum_small(spark, folder):
    return rounded(K.spectrum(_strong(spark, folder)))


@query("fiedler_gap")
def fiedler_gap(spark, folder):
    return K.eigengap(_strong(spark, folder))


@query("effective_resistance_topk")
def effective_resistance_topk(spark, folder):
    return K.effective_resistance(_whole(spark, folder), k=16)


@query("resistance_rel_errors")
def resistance_rel_errors(spark, folder):
    g = _whole(spark, folder)
    return K.resistance_errors(K.effective_resistance(g), K.effective_resistance(g, k=32))


@query("sparsify_leverage")
def sparsify_leverage(spark, folder):
    """Half of the edges, by resistance."""
    g = _whole(spark, folder)
    return X.spectral_edges(K.effective_resistance(g), g.nodes.count(), g.edges.count() // 2, epsilon=1.0)


@query("sparsify_er_ladder")
def sparsify_er_ladder(spark, folder):
    """Edges kept and their weight at each retention, drawn by resistances of the projection."""
    kept = X.resistance_grid(_whole(spark, folder), RETENTIONS)
    return kept.groupBy("method", "retention").agg(F.count("*").alias("n_edges"), F.round(F.sum("w"), 6).alias("weight"))


@query("distortion_report")
def distortion_report(spark, folder):
    g = _whole(spark, folder)
    return K.distortion_report(g, Graph(g.nodes, X.degree_edges(g, g.edges.count() // 2)))


@query("mode_scores")
def mode_scores(spark, folder):
    g = _whole(spark, folder)
    modes = staged(K.modes(g, 8), "modes")
    return K.mode_similarity(g, modes, 8).join(K.mode_centrality(modes, 8), "node_id").join(K.resistance_scores(g, K.effective_resistance(g)), "node_id")


@query("resistances_dispatched", sql("SELECT ((SELECT count(*) FROM nodes) - (SELECT count(DISTINCT component) FROM named))::DOUBLE AS energy", STRONG, recursive=True))
def resistances_dispatched(spark, folder):
    return rounded(K.resistances(_strong(spark, folder)).agg(F.sum(F.col("w") * F.col("r")).alias("energy")), 5)


@query("fiedler_neighbours")
def fiedler_neighbours(spark, folder):
    g = _whole(spark, folder)
    return K.fiedler_neighbours(g, staged(K.modes(g, 1), "modes"))


@query("sparsify_leverage_unclipped")
def sparsify_leverage_unclipped(spark, folder):
    """Half of the edges, of highest w r, without the clip at 1 that makes edges tie."""
    from graphloom.plans.ranking import global_rank

    g = _whole(spark, folder)
    scored = K.effective_resistance(g).withColumn("score", F.round(F.col("w") * F.col("r"), 9))
    return global_rank(scored, F.desc("score"), F.asc("src"), F.asc("dst")).where(F.col("rank") <= g.edges.count() // 2).select("src", "dst", "score")


@query("mode_scores_all")
def mode_scores_all(spark, folder):
    """Similarity and centrality for 2, 8, 32 and 128 modes, signed and absolute."""
    g = _whole(spark, folder)
    modes = staged(K.modes(g, 128), "modes")
    out = g.nodes.select("node_id")
    for k in (2, 8, 32, 128):
        for absolute in (False, True):
            out = out.join(K.mode_similarity(g, modes, k, absolute).withColumnRenamed("sim", f"{'abs_' if absolute else ''}sim_{k}"), "node_id")
        out = out.join(K.mode_centrality(modes, k).withColumnRenamed("centrality", f"centrality_{k}"), "node_id")
    return out


@query("kmeans_pool")
def kmeans_pool(spark, folder):
    """A pool that never sees labels: clusters of the features as they are."""
    return E.kmeans_gates(part_graph(spark, folder).nodes.select("node_id", "x"), "0", scaled=False)


@query("label_free_kmeans")
def label_free_kmeans(spark, folder):
    return L.assigned(L.structural_features(part_graph(spark, folder), D), "kmeans")


def _pool(spark, folder):
    """Experts on terciles of label homophily over the parts' graph: nodes, predictions, and the graph and the experts' channels."""
    g = _whole(spark, folder)
    one = S.propagate(g, g.nodes.select("node_id", "x"), D).withColumnRenamed("x", "x1")
    nodes = staged(g.nodes.join(one, "node_id").select("node_id", F.col("y").cast("int").alias("y"), F.concat("x", "x1").alias("x")), "nodes")
    splits = None
    for split in range(3):
        part = P.stratified_split(nodes, 0.5, split).select(F.lit(split).alias("split"), F.lit(0).alias("seed"), "node_id", "part")
        splits = part if splits is None else splits.union(part)
    oracle = staged(R.bucket_by_homophily(S.label_homophily(g), adaptive=True), "oracle")
    return nodes, staged(E.fit_pool(nodes, staged(splits, "splits"), oracle, 5), "predictions"), g, oracle


def _cells(spark, folder):
    nodes, predictions, g, oracle = _pool(spark, folder)
    free = staged(R.bucket_by_quantile(S.feature_homophily(g, D).withColumnRenamed("hx", "score")), "free")
    gates = {"oracle": oracle, "label_free": free, "uniform": R.uniform_gates(nodes), "random": R.random_like(oracle)}
    conditions = None
    for name, routed in gates.items():
        part = R.with_channel(routed).select(F.lit(name).alias("cond"), "node_id", "channel")
        conditions = part if conditions is None else conditions.union(part)
    return E.mixture_cells(predictions, nodes, conditions)


@query("protocol_b_cells")
def protocol_b_cells(spark, folder):
    return _cells(spark, folder)


@query("d2_table")
def d2_table(spark, folder):
    return T.holm(T.comparisons(T.paired(_cells(spark, folder), T.RULES)), "p_wilcoxon")


@query("ensemble_soft_vote")
def ensemble_soft_vote(spark, folder):
    nodes, predictions, _, _ = _pool(spark, folder)
    return E.soft_vote(predictions, nodes, 5)


@query("router_targets")
def router_targets(spark, folder):
    nodes, predictions, _, _ = _pool(spark, folder)
    return E.router_targets(predictions, nodes)
