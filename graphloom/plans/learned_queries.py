"""Queries on learned gates, graph experts and frozen gates, over the embeddings' neighbour graph, and on reports of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import experts as E
from graphloom.operators import learned as N
from graphloom.operators import reports as R
from graphloom.operators import routing as G
from graphloom.operators import scores as S
from graphloom.operators import splits as L
from graphloom.plans.graph_queries import r, rounded
from graphloom.plans.register import query
from graphloom.plans.result_queries import CELLS, RUNS, _cells_of, _runs
from graphloom.sources.tables import embedding_graph, joined_passages, table
from graphloom.storage import staged

CLASSES, WIDTH, ORDER, SPLITS = 10, 64, 3, 2


def _graph(spark, folder):
    g = embedding_graph(spark, folder)
    return type(g)(staged(g.nodes.withColumn("y", F.col("y").cast("int")), "nodes"), staged(g.edges, "edges"))


def _splits(g):
    """Half of each class trains the experts and the router (a third of it), the rest tests."""
    out = None
    for split in range(SPLITS):
        whole = L.stratified_split(g.nodes, 0.5, split)
        inner = L.fit_router_split(whole, 1 / 3, split).select("node_id", F.when(F.col("part") == "fit", "train").otherwise("router").alias("part"))
        part = inner.union(whole.where("part = 'test'").select("node_id", "part")).select(F.lit(split).alias("split"), F.lit(0).alias("seed"), "node_id", "part")
        out = part if out is None else out.union(part)
    return staged(out, "splits")


def _pool(g, splits):
    """Experts on the terciles of feature homophily, and how a node is routed by them."""
    gates = staged(G.bucket_by_quantile(S.feature_homophily(g, WIDTH).withColumnRenamed("hx", "score")), "gates")
    return staged(E.fit_pool(g.nodes, splits, gates, CLASSES), "predictions"), gates


def _learned(g, splits, predictions, kind):
    known = splits.where("part = 'router'").select("split", "seed", "node_id")
    targets = E.router_targets(predictions, g.nodes).join(known, ["split", "seed", "node_id"])
    rows = splits.select("split", "seed", "node_id").join(N.with_neighbours(g), "node_id").join(targets, ["split", "seed", "node_id"], "left")
    return staged(N.learned_gates(rows, kind, epochs=100), "learned")


def _router_query(kind):
    def run(spark, folder):
        g = _graph(spark, folder)
        splits = _splits(g)
        predictions, _ = _pool(g, splits)
        gates = _learned(g, splits, predictions, kind).select(F.lit(kind).alias("cond"), "*")
        test = splits.where("part = 'test'").select("split", "seed", "node_id")
        return N.gated_cells(predictions.join(test, ["split", "seed", "node_id"]), gates, g.nodes, CLASSES)

    return run


for _kind in N.GATES:
    query(f"router_{_kind}_cells")(_router_query(_kind))


@query("selective_router")
def selective_router(spark, folder):
    g = _graph(spark, folder)
    splits = _splits(g)
    predictions, _ = _pool(g, splits)
    learned = _learned(g, splits, predictions, "mlp").select(F.lit("routed").alias("cond"), "*")
    single = learned.select(F.lit("single").alias("cond"), "split", "seed", "node_id", F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("gates"))
    cells = {}
    for part in ("router", "test"):
        rows = splits.where(F.col("part") == part).select("split", "seed", "node_id")
        cells[part] = N.gated_cells(predictions.join(rows, ["split", "seed", "node_id"]), learned.union(single), g.nodes, CLASSES)
    return N.selective(cells["router"], cells["test"], "routed", "single")


@query("frozen_gates")
def frozen_gates(spark, folder):
    g = _graph(spark, folder)
    splits = _splits(g)
    predictions, pool = _pool(g, splits)
    strata = g.nodes.select("node_id", F.col("y").alias("stratum"))
    conditions = N.interventions(_learned(g, splits, predictions, "mlp"), pool, strata)
    test = splits.where("part = 'test'").select("split", "seed", "node_id")
    return N.gated_cells(predictions.join(test, ["split", "seed", "node_id"]), conditions, g.nodes, CLASSES)


def _accuracy(predictions, splits, g):
    test = splits.where("part = 'test'").select("split", "seed", "node_id")
    return N.saturation(predictions.join(test, ["split", "seed", "node_id"]), g.nodes)


@query("graph_expert_cells")
def graph_expert_cells(spark, folder):
    g = _graph(spark, folder)
    splits = _splits(g)
    return _accuracy(N.graph_expert(g, splits, WIDTH, CLASSES), splits, g)


@query("chebyshev_expert_cells")
def chebyshev_expert_cells(spark, folder):
    g = _graph(spark, folder)
    splits, terms = _splits(g), staged(S.chebyshev(g, WIDTH, ORDER), "terms")
    return _accuracy(N.cheb_expert(terms, g.nodes, splits, ORDER, CLASSES), splits, g)


@query("node_mixture_cells")
def node_mixture_cells(spark, folder):
    g = _graph(spark, folder)
    splits, terms = _splits(g), staged(S.chebyshev(g, WIDTH, ORDER), "terms")
    out = None
    for gate in ("graph", "uniform"):
        part = _accuracy(N.node_mixture(terms, g, splits, ORDER, CLASSES, gate), splits, g).select(F.lit(gate).alias("gate"), "*")
        out = part if out is None else out.union(part)
    return out


@query("single_gate", "SELECT p_partkey AS node_id, [1.0::DOUBLE] AS gates FROM part")
def single_gate(spark, folder):
    return G.single_gate(table(spark, folder, "part").select(F.col("p_partkey").alias("node_id")))


@query("finite_scores", "WITH s AS (SELECT event_type AS candidate, event_id, CASE WHEN value > 0 OR event_type <> 'view' THEN value ELSE NULL END AS score FROM events) SELECT candidate, event_id, score FROM s WHERE candidate IN (SELECT candidate FROM s GROUP BY candidate HAVING bool_and(score IS NOT NULL AND isfinite(score)))")
def finite_scores(spark, folder):
    score = F.when((F.col("value") > 0) | (F.col("event_type") != "view"), F.col("value"))
    return R.finite_scores(table(spark, folder, "events").select(F.col("event_type").alias("candidate"), "event_id", score.alias("score")))


@query("clean_points", CELLS + RUNS + "SELECT method, n, budget, seed FROM runs WHERE gap <= 0.5::DOUBLE")
def clean_points(spark, folder):
    return R.clean_points(_runs(spark, folder).withColumn("router_collapse_seeds", (F.col("gap") > 0.5).cast("int"))).select("method", "n", "budget", "seed")


@query("field_summary", CELLS + RUNS + f", long AS (SELECT method, 'err' AS field, err AS value FROM runs UNION ALL SELECT method, 'gap', gap FROM runs) SELECT method, field, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')} FROM long GROUP BY ALL")
def field_summary(spark, folder):
    return rounded(R.field_summary(_runs(spark, folder), "method", ["err", "gap"]))


@query("order_invariance", CELLS + "SELECT 0.0::DOUBLE AS most, count(*)::BIGINT AS n, true AS invariant FROM cells WHERE cond = 'oracle'")
def order_invariance(spark, folder):
    """Cells of the orders as they are stored against cells of the same orders from the last to the first."""
    orders = table(spark, folder, "orders")
    turned = orders.repartitionByRange(F.desc("o_orderkey")).sortWithinPartitions(F.desc("o_orderkey"))
    one, other = (_cells_of(t).where("cond = 'oracle'") for t in (orders, turned))
    both = one.withColumn("cond", F.lit("forward")).union(other.withColumn("cond", F.lit("backward")))
    return R.order_invariance(both, "forward", "backward")


@query("interpretation", CELLS + RUNS + ", d AS (SELECT method, n, budget, avg(gap) - 0.35::DOUBLE AS o, 0.25::DOUBLE - avg(err) AS u FROM runs GROUP BY ALL) SELECT method, n, budget, o > 0.1::DOUBLE AND u < -0.05::DOUBLE AS passed FROM d")
def interpretation(spark, folder):
    deltas = _runs(spark, folder).groupBy("method", "n", "budget").agg((F.avg("gap") - 0.35).alias("o"), (0.25 - F.avg("err")).alias("u"))
    return R.interpretation(deltas, "o", "u").select("method", "n", "budget", "passed")


@query("joined_passages", """WITH a AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations),
s AS (SELECT conv_id, max(greatest(turn, after)) + 1 AS n FROM a WHERE after IS NOT NULL GROUP BY conv_id), o AS (SELECT conv_id, coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT (before + turn)::BIGINT AS src, (before + after)::BIGINT AS dst, 1.0::DOUBLE AS w, conv_id AS passage FROM a JOIN o USING (conv_id) WHERE after IS NOT NULL""")
def joined(spark, folder):
    """Turns of conversations as tokens of passages, each linked to the next."""
    from pyspark.sql import Window

    after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("passage_id"), F.col("turn").alias("query"), after.alias("key"), F.lit(1.0).alias("p")).where("key IS NOT NULL")
    return joined_passages(turns)


@query("stride_correlation", f"WITH o AS (SELECT o_totalprice AS x, o_custkey::DOUBLE AS y, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders), s AS (SELECT x, y FROM o WHERE i % greatest(1, (SELECT ceil(count(*) / 2000.0) FROM o)) = 0), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM s) SELECT {r('corr(rx, ry)', 'rho')}, count(*)::BIGINT AS n FROM k")
def stride_correlation(spark, folder):
    """Sampling is the feature: a rank correlation on rows at even distances, 2,000 at most here."""
    from graphloom.operators import stats

    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return rounded(stats.strided_spearman(rows, "o_orderkey", "x", "y", 2000))
