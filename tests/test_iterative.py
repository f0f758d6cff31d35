"""The iterative solvers against dense matrices, on graphs with ties, several components and lone nodes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import iterative as I  # noqa: E741
from graphloom.operators import sparsify as X
from graphloom.operators import spectral as K


def graph(spark, n, edges):
    nodes = spark.createDataFrame([(i, 0, [1.0]) for i in range(n)], "node_id long, y int, x array<double>")
    return Graph(nodes, spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, w double"))


def random_edges(seed, n, m):
    rng = np.random.default_rng(seed)
    pairs = {(i, int(rng.integers(0, i))) for i in range(1, n)} | {tuple(sorted(map(int, rng.choice(n, 2, replace=False)), reverse=True)) for _ in range(m)}
    return [(b, a, rng.lognormal()) for a, b in sorted(pairs)]


def laplacian(n, edges):
    out = np.zeros((n, n))
    for a, b, w in edges:
        out[a, b] -= w
        out[b, a] -= w
    out[np.diag_indices(n)] = -out.sum(1)
    return out


@pytest.fixture(scope="module")
def dense():
    edges = random_edges(1, 150, 350)
    return edges, laplacian(150, edges)


@pytest.fixture(scope="module")
def few():
    """Small, as each round of a solver is a job."""
    return random_edges(4, 40, 70)


def vectors(table):
    rows = sorted(table.collect(), key=lambda r: r["node_id"])
    return np.array([r["v"] for r in rows])


@pytest.mark.parametrize("largest", [False, True])
def test_modes_against_dense(spark, dense, largest):
    edges, lap = dense
    wanted = np.linalg.eigvalsh(lap)
    wanted = wanted[::-1][:6] if largest else wanted[1:7]
    table, values, residuals = I.extreme_modes(graph(spark, 150, edges), 6, largest)
    v = vectors(table)
    assert values == pytest.approx(wanted, abs=1e-8) and max(residuals) < 1e-4
    assert np.abs(lap @ v - v * values).max() < 1e-4 and v.T @ v == pytest.approx(np.eye(6), abs=1e-6)
    assert np.abs(v.sum(0)).max() < 1e-6


def test_modes_of_components_ties_and_few_nodes(spark):
    ring = [(i, (i + 1) % 12, 1.0) if i < 11 else (0, 11, 1.0) for i in range(12)]  # eigenvalues in pairs
    _, values, _ = I.extreme_modes(graph(spark, 12, ring), 5)
    assert values == pytest.approx(sorted(2 - 2 * math.cos(2 * math.pi * i / 12) for i in range(1, 12))[:5], abs=1e-7)
    apart = graph(spark, 6, [(0, 1, 1.0), (2, 3, 2.0)])
    assert I.extreme_modes(apart, 10)[1] == pytest.approx([0, 0, 0, 2, 4], abs=1e-7)
    table, values, _ = I.extreme_modes(graph(spark, 1, []), 3)
    assert values == [] and table.first()["v"] == []
    assert I.extreme_modes(graph(spark, 0, []), 3)[1] == []


def test_solutions(spark, dense):
    edges, lap = dense
    both = edges + [(a + 150, b + 150, w) for a, b, w in random_edges(2, 40, 60)]
    whole = laplacian(191, both)  # and a lone node
    b = np.random.default_rng(3).standard_normal((191, 3))
    b[:150] -= b[:150].mean(0)
    b[150:190] -= b[150:190].mean(0)
    b[190] = 0
    right = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(b)], "node_id long, b array<double>")
    found = vectors(I.solve(graph(spark, 191, both), right, 3, tolerance=1e-8).withColumnRenamed("x", "v"))
    assert whole @ found == pytest.approx(b, abs=1e-6)


def test_projected_resistances(spark, dense):
    edges, lap = dense
    inverse = np.linalg.pinv(lap)
    exact = {(a, b): inverse[a, a] + inverse[b, b] - 2 * inverse[a, b] for a, b, _ in edges}
    found = I.sketched_resistance(graph(spark, 150, edges), width=256).collect()
    off = np.array([r["r"] / exact[r["src"], r["dst"]] - 1 for r in found])
    assert len(found) == len(edges) and np.sqrt((off**2).mean()) < 1.5 * math.sqrt(2 / 256)
    assert sum(r["w"] * r["r"] for r in found) == pytest.approx(149, rel=0.05)


def test_quadrature(spark, dense):
    edges, lap = dense
    true = np.linalg.eigvalsh(lap)
    values, weights = I.quadrature(graph(spark, 150, edges), probes=64, steps=12)
    assert weights.sum() == pytest.approx(150) and (weights * values).sum() == pytest.approx(true.sum(), rel=0.05)
    for bar in np.quantile(true, [0.1, 0.5, 0.9]):
        assert abs(weights[values <= bar].sum() - (true <= bar).sum()) < 20
    lone = I.quadrature(graph(spark, 5, []), probes=4)
    assert lone[1].sum() == pytest.approx(5) and lone[0].max() == 0


def test_large_components_agree_with_dense_kernels(spark, few):
    """The same graph through both paths, by the limit that sends a component to one of them; components of other sizes beside it."""
    g = graph(spark, 46, [*few, (40, 41, 1.0), (41, 42, 2.0), (43, 44, 1.0)])
    exact, large = K.modes(g, 3), K.modes(g, 3, limit=20)
    a, b = (vectors(t.select("node_id", "v")) for t in (exact, large))
    assert a == pytest.approx(b, abs=1e-4)
    key = lambda t: {(r["src"], r["dst"]): r["r"] for r in t.collect()}
    one, other = key(K.effective_resistance(g, k=3)), key(K.effective_resistance(g, k=3, limit=20))
    assert set(one) == set(other) and all(one[e] == pytest.approx(other[e], abs=1e-4) for e in one)
    near = key(K.effective_resistance(g, limit=20, width=128))
    assert all(near[e] == pytest.approx(r, rel=0.8) for e, r in key(K.effective_resistance(g)).items())
    gap = {r["component"]: r["fiedler"] for r in K.eigengap(g).collect()}
    assert {r["component"]: r["fiedler"] for r in K.eigengap(g, limit=20).collect()} == pytest.approx(gap, abs=1e-6)


def test_distortion_of_large_graphs(spark, few):
    g = graph(spark, 40, few)
    other = Graph(g.nodes, X.threshold(g.edges, 0.5))
    exact = {r["measure"]: r["value"] for r in K.distortion_report(g, other).collect()}
    found = {r["measure"]: r["value"] for r in K.distortion_report(g, other, limit=20, low=6, top=8, probes=32, steps=8).collect()}
    low = {r["measure"]: r["value"] for r in K.distortion_report(g, other, low=6).collect()}
    for name in ("rank_top1", "rank_top8"):
        assert found[name] == pytest.approx(exact[name], abs=1e-3), name
    for name in ("low_freq_mean", "low_freq_median", "low_freq_p90", "low_freq_max", "low_freq_gap", "survival"):
        assert found[name] == pytest.approx(low[name], abs=1e-3), name
    for name in ("zeros", "zeros_other", "isolated", "positive", "positive_other"):
        assert found[name] == exact[name]
    assert found["sd_p50"] == pytest.approx(exact["sd_p50"], abs=0.2) and found["min_gap"] is None


def test_resistance_method(spark, few):
    edges = few
    g = graph(spark, 40, edges)
    assert X.METHODS["er"](g, 20, 1).count() == 20
    kept = {r["retention"]: r["n"] for r in X.retention_grid(g, [0.2, 0.5, 1.0], methods=("er", "weight")).where("method = 'er'").groupBy("retention").agg(F.count("*").alias("n")).collect()}
    assert kept == {0.2: round(0.2 * len(edges)), 0.5: round(0.5 * len(edges)), 1.0: len(edges)}
    with pytest.raises(ValueError):
        X.retention_grid(g, [0.5], methods=("nothing",))


def test_estimated_resistances_sum_to_what_is_known(spark):
    rng = np.random.default_rng(8)
    edges = [(base + i, base + (i + 1) % n, float(rng.uniform(0.5, 2))) for base, n in ((0, 40), (100, 60), (200, 5)) for i in range(n)]
    edges += [(base, base + k, 1.0) for base in (0, 100) for k in (7, 19, 23)]
    g = graph(spark, 260, [(min(a, b), max(a, b), w) for a, b, w in edges])
    found = K.effective_resistance(g, limit=20, width=16).collect()
    sums = [sum(r["w"] * r["r"] for r in found if low <= r["src"] < low + 100) for low in (0, 100, 200)]
    assert len(found) == len(edges) and sums == pytest.approx([39, 59, 4], abs=1e-9)


def test_sketch_errors_solve_no_more_than_they_compare(spark, few, monkeypatch):
    """Beside a component above the limit and many lone nodes: neither is solved, and none of them reaches a dense kernel."""
    ring = [(100 + i, 100 + (i + 1) % 8, 1.0 + i / 8) for i in range(8)]
    small = [(min(a, b), max(a, b), w) for a, b, w in ring] + [(120, 121, 2.0)]
    g = graph(spark, 400, [*few, *small])
    seen = []

    def noted(part, width):
        seen.append(part.nodes.count())
        return I.sketched_resistance(part, width)

    monkeypatch.setattr(K, "sketched_resistance", noted)
    found = K.sketch_errors(g, limit=20, width=256).first()
    assert seen == [10] and 0 < found["mean"] < 0.3
    parts = K.parted(g, 20)
    assert parts.linked().count() == len(small) and parts.lone().count() == 400 - 40 - 10


def test_right_sides_of_a_projection_are_summed_after_the_shuffle(spark):
    edges = [(i, j, 1.0 + (i * j) % 5) for i in range(12) for j in range(i + 1, 12) if (i + j) % 3]
    graph = Graph(spark.range(12).withColumnRenamed("id", "node_id"), spark.createDataFrame(edges, "src long, dst long, w double"))
    right = I.projected(graph, 70, 4)
    plan = right._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    moved = [i for i, line in enumerate(plan) if "Exchange" in line]
    assert len(moved) == 1 and moved[0] > max(i for i, line in enumerate(plan) if "Aggregate" in line)  # a plan's lowest line runs first
    drawn = {(r["src"], r["dst"]): np.array(r["s"]) for r in graph.edges.select("src", "dst", I.signs(70, 4, "src", "dst").alias("s")).collect()}
    wanted = np.zeros((12, 70))
    for src, dst, w in edges:
        wanted[src] += drawn[src, dst] * np.sqrt(w / 70)
        wanted[dst] -= drawn[src, dst] * np.sqrt(w / 70)
    found = {r["node_id"]: r["b"] for r in right.collect()}
    assert np.allclose([found[i] for i in range(12)], wanted)


def test_resistances_are_exact_whichever_way_a_component_goes(spark, few):
    """Trees, chains, a ring, parallel chains and a dense core: through the inverse of one task, the columns of several, and rounds."""
    from graphloom.operators.resistance import exact_resistances

    ring = [(100 + min(i, (i + 1) % 30), 100 + max(i, (i + 1) % 30), 1.0 + i / 8) for i in range(30)]
    chains = [(0, 50, 2.0), (50, 51, 0.5), (51, 52, 3.0), (9, 52, 1.0), (3, 60, 1.0), (9, 60, 2.0), (60, 61, 0.25)]
    edges = [*few, *chains, *ring]
    g = graph(spark, 130, edges)
    wanted = np.linalg.pinv(laplacian(130, edges), hermitian=True)
    right = {(a, b): wanted[a, a] + wanted[b, b] - 2 * wanted[a, b] for a, b, _ in edges}
    key = lambda t: {(r["src"], r["dst"]): r["r"] for r in t.collect()}
    for found in (K.effective_resistance(g), K.effective_resistance(g, limit=20), K.resistances(g, limit=3)):
        assert key(found) == pytest.approx(right, rel=1e-8)
    tiny = [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 0.5), (2, 3, 1.0), (1, 3, 4.0), (3, 4, 0.5)]
    named = spark.createDataFrame([(0, a, b, w) for a, b, w in tiny], "component long, src long, dst long, w double")
    alone = np.linalg.pinv(laplacian(5, tiny), hermitian=True)
    by_rounds = key(exact_resistances(named, 2, width=3, task_nodes=4))
    assert by_rounds == pytest.approx({(a, b): alone[a, a] + alone[b, b] - 2 * alone[a, b] for a, b, _ in tiny}, rel=1e-8)


def test_columns_of_a_component_are_dealt_and_joined():
    from graphloom.operators import resistance as Z

    src, dst, w = (np.array(x) for x in zip(*random_edges(5, 60, 200)))
    edges = Z.placed(src * 7, dst * 7, w)
    lap = np.linalg.pinv(laplacian(60, list(zip(src, dst, w))), hermitian=True)
    wanted = lap[src, src] + lap[dst, dst] - 2 * lap[src, dst]
    dealt = [Z.columns(edges, Z.solved(edges)[part::3], 7) for part in range(3)]
    assert Z.joined(edges, *(np.concatenate(x) for x in zip(*dealt))) == pytest.approx(wanted, rel=1e-8)
    steps, left = Z.core(edges)
    assert left.n < 60 and Z.back(steps, Z.dense(left)) == pytest.approx(wanted, rel=1e-8)


def test_blocks_are_not_broadcast(spark, few, monkeypatch):
    """However small a plan takes them to be: an array counts as one number there."""
    plans = []

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return staged(df, name)

    staged = I.staged
    monkeypatch.setattr(I, "staged", noted)
    I.sketched_resistance(graph(spark, 40, few), width=8)
    I.extreme_modes(graph(spark, 40, few), 2, rounds=1)
    wide = [plan for name, plan in plans if name in ("block", "resistances")]
    assert len(wide) > 3 and not any("Broadcast" in plan for plan in wide)
