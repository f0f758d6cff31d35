"""Per-node scores from a node's neighbours. Isolated nodes have a null homophily and 0 in all other scores, unless stated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.vectors import dot, norm, unit, vector_sum
from graphloom.graph import Graph, degrees
from graphloom.storage import staged


def _with_neighbours(graph: Graph, columns: list[str]) -> DataFrame:
    """(node_id, nb, w, and each named column of both, the neighbour's as nb_...)."""
    near = graph.nodes.select(F.col("node_id").alias("nb"), *[F.col(c).alias(f"nb_{c}") for c in columns])
    own = graph.nodes.select("node_id", *columns)
    return graph.both_ways().select(F.col("src").alias("node_id"), F.col("dst").alias("nb"), "w").join(own, "node_id").join(near, "nb")


def _every_node(graph: Graph, found: DataFrame, name: str, missing: float | None = 0.0) -> DataFrame:
    value = F.col(name) if missing is None else F.coalesce(name, F.lit(missing))
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", value.alias(name))


def label_homophily(graph: Graph) -> DataFrame:
    """Share of neighbours, each counted once, with the node's label; null for isolated nodes."""
    found = _with_neighbours(graph, ["y"]).groupBy("node_id").agg(F.avg((F.col("y") == F.col("nb_y")).cast("double")).alias("h"))
    return _every_node(graph, found, "h", None)


def mean_homophily(graph: Graph) -> DataFrame:
    return label_homophily(graph).agg(F.avg("h").alias("mean_h"), F.count("h").alias("n_defined"))


def feature_homophily(graph: Graph, width: int) -> DataFrame:
    """Mean cosine of a node's features with its neighbours': one sum of unit vectors, then one product."""
    units = graph.nodes.withColumn("u", unit("x")).select("node_id", "u")
    near = graph.both_ways().join(units.select(F.col("node_id").alias("dst"), "u"), "dst")
    summed = near.groupBy(F.col("src").alias("node_id")).agg(vector_sum("u", width).alias("total"), F.count("*").alias("deg"))
    found = summed.join(units, "node_id").select("node_id", (dot("u", "total") / F.col("deg")).alias("hx"))
    return _every_node(graph, found, "hx")


def boundary_score(graph: Graph, community: str) -> DataFrame:
    """Neighbours of another community over the weighted degree, which counts 1 at least."""
    found = _with_neighbours(graph, [community]).groupBy("node_id").agg((F.count_if(F.col(community) != F.col(f"nb_{community}")) / F.greatest(F.sum("w"), F.lit(1.0))).alias("boundary"))
    return _every_node(graph, found, "boundary")


def budget_homophily(graph: Graph, top_k: int) -> DataFrame:
    """Same-label neighbours over what the label allows: min(top_k, class size - 1), 1 at least; null for isolated nodes."""
    sizes = graph.nodes.groupBy("y").agg(F.count("*").alias("size"))
    same = _with_neighbours(graph, ["y"]).groupBy("node_id", "y").agg(F.count_if(F.col("y") == F.col("nb_y")).alias("same"))
    found = same.join(sizes, "y").select("node_id", (F.col("same") / F.greatest(F.lit(1), F.least(F.lit(top_k), F.col("size") - 1))).alias("hn"))
    return _every_node(graph, found, "hn", None)


def feature_anomaly(graph: Graph, width: int) -> DataFrame:
    """Minus the distance of a node's features from their mean."""
    mean = graph.nodes.agg(*[F.avg(F.get("x", i)).alias(f"m{i}") for i in range(width)])
    square = sum(((F.get("x", i) - F.col(f"m{i}")) * (F.get("x", i) - F.col(f"m{i}")) for i in range(width)), F.lit(0.0))
    return graph.nodes.join(F.broadcast(mean)).select("node_id", (-F.sqrt(square)).alias("feat_anomaly"))  # one row is broadcast


def neighbour_feature_variance(graph: Graph, width: int) -> DataFrame:
    """Variance of the neighbours' unit features, averaged over the dimensions; 0 with fewer than two neighbours."""
    units = graph.nodes.select(F.col("node_id").alias("dst"), unit("x").alias("u"))
    near = graph.both_ways().join(units, "dst").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("deg"), *[F.var_pop(F.get("u", i)).alias(f"v{i}") for i in range(width)])
    mean = sum((F.col(f"v{i}") for i in range(width)), F.lit(0.0)) / width
    return _every_node(graph, near.select("node_id", F.when(F.col("deg") > 1, mean).otherwise(0.0).alias("feat_var")), "feat_var")


def degree_family(graph: Graph) -> DataFrame:
    """degree, neigh_degree, log_degree, neigh_deg_dissimilarity, inv_walk2_mixing, degree_proxy of every node."""
    deg = degrees(graph)
    near = deg.select(F.col("node_id").alias("dst"), F.col("deg").alias("nb_deg"))
    own = deg.select(F.col("node_id").alias("src"), "deg")
    total = deg.agg(F.sum("deg").alias("total"))
    found = graph.both_ways().join(own, "src").join(near, "dst").groupBy(F.col("src").alias("node_id")).agg(
        F.avg(F.col("nb_deg").cast("double")).alias("neigh_degree"),
        (-F.avg(F.abs(F.col("nb_deg") - F.col("deg")).cast("double"))).alias("neigh_deg_dissimilarity"),
        F.sum((F.col("nb_deg") * F.col("nb_deg")).cast("double")).alias("squares"),
    )
    joined = deg.join(found, "node_id", "left").join(F.broadcast(total))  # one row is broadcast
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "node_id", F.col("deg").cast("double").alias("degree"), zero(F.col("neigh_degree")).alias("neigh_degree"), F.log1p(F.col("deg")).alias("log_degree"), zero(F.col("neigh_deg_dissimilarity")).alias("neigh_deg_dissimilarity"),
        zero(-F.col("squares") / F.col("total") / F.col("deg")).alias("inv_walk2_mixing"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("wdeg") - 2) / (F.col("wdeg") + 1))).alias("degree_proxy"),
    )


def triangles(graph: Graph) -> DataFrame:
    """triangles, triangle_support (neighbours that share a neighbour with the node) and local clustering of every node.

    Edges are directed from the end of lower degree to the other, so that no node has more than the square root of
    twice the edges to combine: the paths that are joined stay few, also around hubs.
    """
    deg = degrees(graph).select("node_id", "deg")
    ranked = graph.edges.join(deg.select(F.col("node_id").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("node_id").alias("dst"), F.col("deg").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    out = ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
    wedges = out.select("a", F.col("b").alias("p")).join(out.select("a", F.col("b").alias("q")), "a").where("p < q")
    found = wedges.join(graph.edges.select(F.col("src").alias("p"), F.col("dst").alias("q")), ["p", "q"])
    counted = found.select(F.explode(F.array("a", "p", "q")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("triangles"))
    sides = found.select(F.explode(F.array(*[F.struct(F.col(u).alias("node_id"), F.col(v).alias("nb")) for u in "apq" for v in "apq" if u != v])).alias("s")).select("s.*").distinct()
    support = sides.groupBy("node_id").agg(F.count("*").alias("triangle_support"))
    joined = deg.join(counted, "node_id", "left").join(support, "node_id", "left")
    t, s = F.coalesce("triangles", F.lit(0)), F.coalesce("triangle_support", F.lit(0))
    return joined.select("node_id", t.alias("triangles"), s.alias("triangle_support"), F.when(F.col("deg") > 1, s / (F.col("deg") * (F.col("deg") - 1))).otherwise(0.0).alias("local_clustering"))


def propagate(graph: Graph, state: DataFrame, width: int, normalise: bool = True) -> DataFrame:
    """(node_id, x): the normalised adjacency (with loops), or else the neighbours' weighted sum, applied to ``state``."""
    if not normalise:
        near = graph.both_ways().join(state.select(F.col("node_id").alias("dst"), "x"), "dst").select(F.col("src").alias("node_id"), F.transform("x", lambda v: v * F.col("w")).alias("x"))
        found = near.groupBy("node_id").agg(vector_sum("x", width).alias("x"))
        return state.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("x", F.array_repeat(F.lit(0.0), width)).alias("x"))
    scaled = state.join(degrees(graph).select("node_id", F.sqrt(1 + F.col("wdeg")).alias("d")), "node_id").select("node_id", "d", F.transform("x", lambda v: v / F.col("d")).alias("x"))
    near = graph.both_ways().join(scaled.select(F.col("node_id").alias("dst"), "x"), "dst").select(F.col("src").alias("node_id"), F.transform("x", lambda v: v * F.col("w")).alias("x"))
    found = near.union(scaled.select("node_id", "x")).groupBy("node_id").agg(vector_sum("x", width).alias("x"))
    return found.join(scaled.select("node_id", "d"), "node_id").select("node_id", F.transform("x", lambda v: v / F.col("d")).alias("x"))


def router_features(graph: Graph, width: int) -> DataFrame:
    """(node_id, gate): features, and how far one and two propagations move them."""
    one = propagate(graph, graph.nodes.select("node_id", "x"), width)
    two = propagate(graph, one, width)
    joined = graph.nodes.select("node_id", "x").join(one.select("node_id", F.col("x").alias("x1")), "node_id").join(two.select("node_id", F.col("x").alias("x2")), "node_id")
    away = lambda c: F.zip_with(F.col(c), F.col("x"), lambda a, b: F.abs(a - b))
    return joined.select("node_id", F.concat("x", away("x1"), away("x2")).alias("gate"))


def signal_preservation(graph: Graph, width: int, depths: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Smallest cosine, within [-1, 1], of a node's features with their propagations to the given depths."""
    state, joined = graph.nodes.select("node_id", "x"), graph.nodes.select("node_id", "x")
    for depth in range(1, max(depths) + 1):
        state = propagate(graph, state, width)
        if depth in depths:
            joined = joined.join(state.select("node_id", F.col("x").alias(f"x{depth}")), "node_id")
    cosine = lambda c: dot("x", c) / F.greatest(norm("x") * norm(c), F.lit(1e-8))
    values = [F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(f"x{d}"))) for d in depths]
    return joined.select("node_id", (values[0] if len(values) == 1 else F.least(*values)).alias("spf"))


def chebyshev(graph: Graph, width: int, order: int) -> DataFrame:
    """(node_id, t0, ..., t_order): the polynomials of the negated normalised adjacency applied to the features."""
    terms = [graph.nodes.select("node_id", "x")]
    for k in range(1, order + 1):
        moved = propagate(graph, terms[-1], width).select("node_id", F.transform("x", lambda v: -v).alias("x"))
        if k > 1:
            moved = moved.join(terms[-2].select("node_id", F.col("x").alias("before")), "node_id").select("node_id", F.zip_with("x", "before", lambda a, b: 2 * a - b).alias("x"))
        terms.append(moved)
    joined = graph.nodes.select("node_id")
    for k, term in enumerate(terms):
        joined = joined.join(term.select("node_id", F.col("x").alias(f"t{k}")), "node_id")
    return joined


def pagerank(graph: Graph, damping: float = 0.85, rounds: int = 100) -> DataFrame:
    """(node_id, rank) after a fixed number of rounds; what isolated nodes hold is not handed on."""
    deg = degrees(graph).select("node_id", "deg")
    n = graph.nodes.agg(F.count("*").cast("double").alias("n"))
    links = graph.both_ways().select("src", "dst").join(deg.select(F.col("node_id").alias("src"), "deg"), "src")
    state = deg.select("node_id").join(F.broadcast(n)).select("node_id", "n", (1 / F.col("n")).alias("rank"))  # one row is broadcast
    for i in range(rounds):
        sent = links.join(state.select(F.col("node_id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        state = state.drop("rank").join(sent, "node_id", "left").select("node_id", "n", ((1 - damping) / F.col("n") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 4 and i + 1 < rounds:
            state = staged(state, "pagerank")
    return state.select("node_id", "rank")
