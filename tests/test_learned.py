"""Learned gates, graph experts and frozen gates: gradients against differences, and what they can learn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import experts as E
from graphloom.operators import generators as B
from graphloom.operators import learned as N
from graphloom.operators import reports as R
from graphloom.operators import scores as S
from graphloom.operators import spectral as K
from graphloom.operators.components import link_components
from graphloom.plans.ranking import average_rank, grouped_rank
from graphloom.sources import tables


def ring(n):
    return N.Neighbours([np.array([(i - 1) % n, (i + 1) % n]) for i in range(n)])


def slopes(values, loss, step=1e-6):
    out = []
    for x in values:
        g = np.zeros_like(x)
        for i in np.ndindex(x.shape):
            x[i] += step
            up = loss()
            x[i] -= 2 * step
            g[i] = (up - loss()) / (2 * step)
            x[i] += step
        out.append(g)
    return out


@pytest.mark.parametrize("norm", [False, True])
@pytest.mark.parametrize("near", [None, ring(9)])
def test_gate_gradients(near, norm):
    rng = np.random.default_rng(0)
    x, target = rng.standard_normal((9, 4)), rng.dirichlet(np.ones(3), 9)
    gate = N.Sage(4, 3, near, width=5, norm=norm)
    wanted = slopes(gate.p, lambda: -(target * np.log(gate.forward(x))).sum())
    for a, b in zip(gate.gradients(gate.forward(x) - target), wanted, strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_chebyshev_gradients_and_interpolation():
    at, matrix = N.interpolation(4)
    polynomial = np.array([0.3, -0.2, 0.5, 0.1, 0.4])  # a filter of the order is met exactly
    values = sum(c * np.cos(k * np.arccos(at)) for k, c in enumerate(polynomial))
    assert np.allclose(matrix @ values, polynomial)
    rng = np.random.default_rng(1)
    terms, y = rng.standard_normal((12, 4, 3)), rng.integers(0, 2, 12)
    made = N.Cheb(3, 3, 2, "low")
    made.p[0] += 0.3
    wanted = slopes(made.p, lambda: -np.log(made.forward(terms)[np.arange(12), y]).sum())
    for a, b in zip(made.gradients(made.forward(terms) - np.eye(2)[y]), wanted, strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_mixture_gradients():
    rng = np.random.default_rng(4)
    x, terms, y, rows = rng.standard_normal((9, 3)), rng.standard_normal((9, 3, 3)), rng.integers(0, 2, 9), np.arange(9) < 6
    made = N.NodeMixture(2, 3, 2, ring(9), smooth=0.3)
    for expert in made.experts:
        expert.p[0] += 0.2
    by_expert, by_gate = made.gradients(x, terms, y, rows)
    loss = lambda: made.loss(x, terms, y, rows)
    for found, values in [*zip(by_expert, [e.p for e in made.experts], strict=True), (by_gate, made.gate.p)]:
        for a, b in zip(found, slopes(values, loss), strict=True):
            assert np.allclose(a, b, atol=1e-4)


def test_mixture_learns_more_than_its_start():
    rng = np.random.default_rng(2)
    n = 400
    x = rng.standard_normal((n, 4))
    terms = np.stack([x, np.roll(x, 1, 0) + np.roll(x, -1, 0)], 1)
    y = (terms[:, 1, 0] + x[:, 0] > 0).astype(int)  # the neighbours know most; a filter without negative values cannot leave a node itself out
    rows = np.arange(n) % 2 == 0
    for gate in ("graph", "plain", "uniform"):
        made = N.NodeMixture(1, 4, 2, ring(n), gate=gate).train(x, terms, y, rows, 150)
        mixed, gates = made.forward(x, terms)
        assert (mixed.argmax(1) == y)[~rows].mean() > 0.85 and np.allclose(gates.sum(1), 1)


def test_graph_gate_learns_from_neighbours(spark):
    n = 90
    edges = spark.range(n).select("id", ((F.col("id") + 1) % n).alias("to")).select(F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst"), F.lit(1.0).alias("w"))
    nodes = spark.range(n).select(F.col("id").alias("node_id"), (F.col("id") % 2).cast("int").alias("y"), F.array((F.hash("id") % 7).cast("double"), ((F.col("id") + 1) % 2).cast("double")).alias("x"))
    rows = N.with_neighbours(Graph(nodes, edges)).withColumn("split", F.lit(0)).withColumn("seed", F.lit(0))
    target = F.when(F.col("node_id") % 3 > 0, F.array(F.col("y").cast("double"), 1 - F.col("y").cast("double"), F.lit(0.0)))
    for kind in N.GATES:
        found = N.learned_gates(rows.withColumn("target", target), kind, epochs=150).join(nodes, "node_id").collect()
        assert np.mean([int(np.argmax(r["gates"])) == 1 - r["y"] for r in found if r["node_id"] % 3 == 0]) > 0.9
    none = N.learned_gates(rows.withColumn("target", F.lit(None).cast("array<double>"))).collect()
    assert all(np.allclose(r["gates"], 1 / 3) for r in none)


def test_interventions_keep_what_they_say(spark):
    gates = spark.range(60).select(F.lit(0).alias("split"), F.lit(1).alias("seed"), F.col("id").alias("node_id"), F.array(F.col("id").cast("double"), F.lit(0.0), F.lit(1.0)).alias("gates"))
    strata = spark.range(60).select(F.col("id").alias("node_id"), (F.col("id") % 3).alias("stratum"))
    found = N.interventions(gates, gates.select("node_id", "gates"), strata, permutations=2).collect()
    by = {}
    for r in found:
        by.setdefault(r["cond"], {})[r["node_id"]] = r["gates"]
    assert set(by) == {"learned", "oracle", "equal", "global_mean", "node_shuffled_0", "node_shuffled_1", "within_0", "within_1"}
    assert by["oracle"] == by["learned"] and by["global_mean"][7] == [29.5, 0.0, 1.0]
    for cond in ("node_shuffled_0", "within_1"):
        assert sorted(g[0] for g in by[cond].values()) == list(range(60)) and by[cond] != by["learned"]
    assert all(int(g[0]) % 3 == n % 3 for n, g in by["within_0"].items())


def test_selective_routing(spark):
    cells = lambda a, b: spark.createDataFrame([("routed", 0, 0, a), ("single", 0, 0, b)], "cond string, split int, seed int, acc double")
    assert N.selective(cells(0.6, 0.5), cells(0.7, 0.4), "routed", "single").first()["acc"] == 0.7
    row = N.selective(cells(0.505, 0.5), cells(0.7, 0.4), "routed", "single").first()
    assert not row["routes"] and row["acc"] == 0.4


def test_components_of_a_random_graph(spark):
    links = spark.range(100_000).select(F.pmod(F.xxhash64("id"), F.lit(60_000)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60_000)).alias("b"))
    named, rounds = link_components(links)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links.collect():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {r["node"]: r["component"] for r in named.collect()} == {x: root(x) for x in list(parent)}
    assert rounds <= 8


def test_ranks_in_groups(spark):
    rows = spark.createDataFrame([("a", 3, 1), ("a", 3, 2), ("a", 1, 3), ("b", 9, 4), (None, 5, 5), (None, None, 6)], "g string, v int, id int")
    assert {r["id"]: r["rank"] for r in grouped_rank(rows, "g", F.desc("v"), F.asc("id")).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1, 6: 2}
    assert {r["id"]: r["k"] for r in average_rank(rows, "g", "v", "k").collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: 1.0, 5: 2.0, 6: 1.0}


def test_resistances_of_trees_and_cycles(spark):
    edges = [(0, 1, 2.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 4.0), (3, 4, 0.5), (5, 6, 1.0)]
    g = Graph(spark.range(8).select(F.col("id").alias("node_id"), F.lit(0).alias("y"), F.array(F.lit(1.0)).alias("x")), spark.createDataFrame(edges, "src long, dst long, w double"))
    found = {(r["src"], r["dst"]): r["r"] for r in K.effective_resistance(g).collect()}
    assert found == pytest.approx({(0, 1): 1 / 2.5, (1, 2): 1 / (1 + 2 / 3), (0, 2): 1 / (1 + 2 / 3), (2, 3): 0.25, (3, 4): 2.0, (5, 6): 1.0})
    assert K.resistances(g).count() == 6


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "k int, method string, v double")
    R.write_csv(rows, str(tmp_path / "c"), ["v", "k"])
    assert tables.read_points(spark, str(tmp_path / "c"), "csv").columns == ["v", "k"]
    for k in (1, 2):
        R.append_points(rows.where(F.col("k") == k), str(tmp_path / "p"), ["method", "k"])
    back = tables.read_points(spark, str(tmp_path / "p"))
    assert back.count() == 2 and R.remaining(rows.select("method", "k"), back, ["method", "k"]).count() == 0
    R.write_record(rows, str(tmp_path / "r"))
    assert tables.read_points(spark, str(tmp_path / "r")).count() == 2
    assert tables.merged_settings({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 1}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}
    assert "textbackslash" in R.latex_table(spark.createDataFrame([("a\\b",)], "t string"), ["t"])


def test_generators_by_rules(spark):
    g = B.erp_fraud(spark, 300)
    assert g.edges.join(g.nodes.select(F.col("node_id").alias("src"), "role"), "src").count() == g.edges.count() > 0
    assert {(r["role"], r["regime"]) for r in g.nodes.select("role", "regime").distinct().collect()} == set(B.ERP_REGIME.items())
    with pytest.raises(ValueError):
        B.erp_fraud(spark, 10, classes=5, d=4)
    q = B.orthogonal_basis(6)
    assert np.allclose(q @ q.T, np.eye(6)) and B.prototypes(3, 5).sum() == 3
    half, whole = B.halved_sbm(spark, 40, 2).edges, B.sbm(spark, 40, 2).edges
    assert half.agg(F.sum("w")).first()[0] == pytest.approx(whole.agg(F.sum("w")).first()[0] / 2)


def test_preserved_signal_of_a_sample(spark):
    g = B.planted_regimes(spark, 90, d=8, seed=1)
    part = tables.largest_sample(g, 20)
    assert part.nodes.count() >= 2 and part.nodes.agg(F.count_distinct("y")).first()[0] > 1
    assert S.signal_preservation(part, 8).count() == part.nodes.count()
    assert tables.labelled_block(g, 30).nodes.count() == 60


def _small_groups(spark, n=36):
    """Two groups on one graph with a node without neighbours, and their features."""
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(n - 1) for j in range(i + 1, n - 1) if rng.random() < 0.15], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i, int(rng.integers(3)), rng.standard_normal(4).tolist()) for i in range(n)], "node_id long, y int, x array<double>")
    return Graph(nodes, edges), spark.range(n).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("split"), F.lit(2).alias("seed"), F.col("id").alias("node_id"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("part"))


def test_gates_by_rounds_are_those_of_one_task(spark):
    graph, splits = _small_groups(spark)
    target = F.when((F.col("node_id") + F.col("split")) % 3 > 0, F.transform(F.array(*[F.lit(k) for k in range(3)]), lambda k: (k == F.col("y")).cast("double")))
    rows = splits.join(N.with_neighbours(graph), "node_id").withColumn("target", target)
    for kind in N.GATES:
        one, rounds = ({(r["split"], r["node_id"]): r["gates"] for r in N.learned_gates(rows, kind, epochs=4, limit=limit).collect()} for limit in (50, 10))
        assert len(one) == 72 and all(np.allclose(rounds[k], v, atol=1e-9) for k, v in one.items()), kind


def test_mixtures_by_rounds_are_those_of_one_task(spark):
    graph, splits = _small_groups(spark)
    terms = S.chebyshev(graph, 4, 2)
    for gate in ("graph", "plain", "uniform"):
        one, rounds = ({(r["split"], r["node_id"]): (r["pred"], r["proba"], r["gates"]) for r in N.node_mixture(terms, graph, splits, 2, 3, gate, 3, limit).collect()} for limit in (50, 10))
        assert len(one) == 36 and set(one) == set(rounds)
        assert all(a[0] == rounds[k][0] and np.allclose(a[1], rounds[k][1], atol=1e-9) and np.allclose(a[2], rounds[k][2], atol=1e-9) for k, a in one.items()), gate


def test_experts_by_passes_are_those_of_one_task(spark):
    graph, splits = _small_groups(spark)
    terms = S.chebyshev(graph, 4, 2)
    held = sorted(terms.join(graph.nodes.select("node_id", "y"), "node_id").collect(), key=lambda r: r["node_id"])
    t, y, train = np.array([[r["t0"], r["t1"], r["t2"]] for r in held]), np.array([r["y"] for r in held]), np.arange(36) % 2 == 0
    wanted = N.Cheb(2, 4, 3, "low", seed=2).train(t, y, train, 4).forward(t)
    cheb = N.cheb_expert(terms, graph.nodes, splits, 2, 3, epochs=4)
    assert "FlatMapGroups" not in cheb._jdf.queryExecution().optimizedPlan().toString()
    found = cheb.collect()
    assert len(found) == 36 and all(np.allclose(r["proba"], wanted[r["node_id"]], atol=1e-9) for r in found)
    moved = {r["node_id"]: r["x"] for r in S.propagate(graph, graph.nodes.select("node_id", "x"), 4).collect()}
    x = np.array([[*r["x"], *moved[r["node_id"]]] for r in sorted(graph.nodes.collect(), key=lambda r: r["node_id"])])
    count = np.bincount(y[train], minlength=3)
    weight = train.sum() / (3 * count)
    wanted = E.Logistic(3).fit(x[train], y[train], weight[y[train]]).predict_proba(x)
    found = N.graph_expert(graph, splits, 4, 3).collect()
    assert len(found) == 36 and all(np.allclose(r["proba"], wanted[r["node_id"]], atol=1e-4) for r in found)
