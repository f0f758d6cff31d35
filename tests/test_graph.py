"""Known values of the golden graph, identities, and monotone behaviour."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import graph as G
from graphloom.functions.hashing import uniform_array
from graphloom.operators import attention as A
from graphloom.operators import components as C
from graphloom.operators import generators as B
from graphloom.operators import passages as P
from graphloom.operators import routing as R
from graphloom.operators import scores as S
from graphloom.operators import sparsify as X
from graphloom.operators import spectral as K
from graphloom.operators import splits as L


@pytest.fixture(scope="module")
def golden(spark):
    return B.golden(spark)


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def make(spark, labels, edges, features=None):
    nodes = spark.createDataFrame([(i, y, (features or {}).get(i, [1.0, 0.0])) for i, y in enumerate(labels)], "node_id long, y int, x array<double>")
    return G.Graph(nodes, spark.createDataFrame([(*e, 1.0) if len(e) == 2 else e for e in edges], "src long, dst long, w double"))


def test_golden_degrees_and_energy(golden, spark):
    assert values(G.degrees(golden), "node_id", "wdeg") == pytest.approx({0: 1.7, 1: 1.9, 2: 1.6, 3: 0.6})
    signal = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 5.0), (3, 1.0)], "node_id long, f double")
    half = G.Graph(golden.nodes, X.threshold(golden.edges, 0.5))
    assert G.quadratic_form(half, signal).first()["energy"] == pytest.approx(24.0)
    assert sum(r["val"] for r in G.laplacian(golden).collect()) == pytest.approx(0)
    assert G.contract_violations(golden).first().asDict() == {"unordered": 0, "non_positive": 0, "repeated": 0, "dangling": 0}


def test_adjacency_averages_and_drops(spark):
    cells = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.5), (2, 2, 9.0), (1, 2, -1.0)], "src long, dst long, w double")
    assert [tuple(r) for r in G.build_adjacency(cells).collect()] == [(0, 1, 0.75)]


def test_golden_spectrum_and_resistance(golden):
    spec = sorted(r["eigenvalue"] for r in K.spectrum(golden).collect())
    assert spec == pytest.approx([0, 0.781832, 2.266461, 2.751707], abs=1e-5)
    known = K.identities(golden).first()
    assert (known["trace"], known["trace_square"], known["resistance_energy"], known["zeros"]) == (pytest.approx(5.8), pytest.approx(13.32), 3, 1)
    exact = K.effective_resistance(golden)
    assert exact.agg(F.sum(F.col("w") * F.col("r"))).first()[0] == pytest.approx(3.0)
    assert all(r["r"] > 1.8 for r in exact.where("dst = 3").collect())
    low = values(K.effective_resistance(golden, k=1), "src", "r")
    assert all(low[r["src"]] <= r["r"] + 1e-9 for r in exact.orderBy("dst").collect() if r["src"] in low and r["dst"] == 3)


def test_golden_threshold_distortion(golden):
    half = G.Graph(golden.nodes, X.threshold(golden.edges, 0.5))
    assert X.frobenius_delta(golden.edges, half.edges).first()[0] == pytest.approx(0.883176, abs=1e-6)
    found = values(K.distortion_report(golden, half), "measure", "value")
    assert found["sd"] == pytest.approx(1.0) and found["min_gap"] == pytest.approx(0.485247, abs=1e-6) and found["fragility"] == pytest.approx(2.060808, abs=1e-5)
    assert found["isolated"] == 1
    assert C.connectivity_report(golden, half).first().asDict() == {"zeros_reference": 1, "zeros_other": 2, "gained": 1}


def test_golden_spectral_budget(golden):
    kept = X.spectral_edges(K.effective_resistance(golden), 4, 5, epsilon=0.1)
    assert sorted((r["src"], r["dst"]) for r in kept.collect()) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]
    sd = values(K.distortion_report(golden, G.Graph(golden.nodes, kept)), "measure", "value")["sd"]
    assert sd == pytest.approx(0.1975, abs=1e-4)


@pytest.mark.parametrize("method", ["random", "degree"])
def test_exact_budgets(golden, method):
    assert X.METHODS[method](golden, 4, 1).count() == 4
    assert X.METHODS[method](golden, 99, 1).count() == 6


def test_random_keeps_scaled_weights(golden):
    kept = X.random_edges(golden.edges, 3, 7).join(golden.edges.withColumnRenamed("w", "was"), ["src", "dst"])
    assert all(r["w"] == pytest.approx(2 * r["was"]) for r in kept.collect())


def test_mass_match(golden):
    assert X.mass_match(X.threshold(golden.edges, 0.5), golden.edges).agg(F.sum("w")).first()[0] == pytest.approx(2.9)


def test_homophily(spark):
    ring = make(spark, [0, 0, 1, 1], [(0, 1), (1, 2), (2, 3), (0, 3)])
    assert values(S.label_homophily(ring), "node_id", "h") == {i: 0.5 for i in range(4)}
    lone = make(spark, [0, 1, 2], [(0, 1)])
    assert values(S.label_homophily(lone), "node_id", "h") == {0: 0.0, 1: 0.0, 2: None}
    near = make(spark, [0, 0, 0], [(0, 1)], {0: [1.0, 0.0], 1: [1.0, 0.1], 2: [0.0, 1.0]})
    found = values(S.feature_homophily(near, 2), "node_id", "hx")
    assert found[0] > 0.9 and found[2] == 0.0
    pairs = make(spark, [0, 0, 1, 1], [(0, 1), (2, 3)])
    assert values(S.budget_homophily(pairs, 4), "node_id", "hn")[0] == 1


def test_triangles(spark):
    found = values(S.triangles(make(spark, [0] * 5, [(0, 1), (0, 2), (1, 2), (2, 3), (1, 3)])), "node_id", "triangles")
    assert found == {0: 1, 1: 2, 2: 2, 3: 1, 4: 0}


def test_energy_is_degree(golden):
    import pandas as pd

    _, lap = K.dense_laplacian(pd.DataFrame(B.GOLDEN, columns=["src", "dst", "w"]))
    values_, vectors = np.linalg.eigh(lap)
    assert (vectors**2 @ values_) == pytest.approx([1.7, 1.9, 1.6, 0.6])
    assert [r["energy"] for r in K.spectral_ratio(golden).orderBy("node_id").collect()] == pytest.approx([1.7, 1.9, 1.6, 0.6])


def test_components_on_long_path(spark):
    path = make(spark, [0] * 60, [(i, i + 1) for i in range(39)])
    named = values(C.connected_components(path), "node_id", "component")
    assert all(named[i] == 0 for i in range(40)) and all(named[i] == i for i in range(40, 60))
    assert C.largest_component(path).count() == 40


def test_buckets(spark):
    scores = spark.createDataFrame([(i, float(i)) for i in range(99)], "node_id long, score double")
    channel = values(R.with_channel(R.bucket_by_quantile(scores)), "node_id", "channel")
    assert channel[98] == 0 and channel[0] == 2 and channel[49] == 1
    same = spark.createDataFrame([(i, 0.0) for i in range(10)], "node_id long, score double")
    assert R.bucket_by_quantile(same).first()["gates"] == pytest.approx([1 / 3] * 3)
    gates = R.bucket_by_homophily(spark.createDataFrame([(0, 0.9), (1, 0.1), (2, None), (3, 0.5)], "node_id long, h double"), gates=(0.8, 0.1, 0.1))
    assert values(gates, "node_id", "gates") == {0: [0.8, 0.1, 0.1], 1: [0.1, 0.1, 0.8], 2: pytest.approx([1 / 3] * 3), 3: [0.1, 0.8, 0.1]}


def test_splits_and_permutations(spark):
    nodes = spark.createDataFrame([(i, i % 3) for i in range(61)], "node_id long, y int")
    parts = L.stratified_split(nodes, 0.5, 1)
    assert {r["y"]: r["n"] for r in parts.where("part = 'train'").groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 10, 1: 10, 2: 10}
    moved = L.permute_within(nodes.withColumn("v", F.col("node_id")), "y", "v", 3)
    assert moved.where("v % 3 <> y").count() == 0 and moved.select("v").distinct().count() == 61
    assert L.strided(nodes, 7).count() == 7


def test_dilution_is_nested(spark):
    base = B.planted_regimes(spark, 100, seed=2)
    order = values(B.conversion_order(base.nodes, 2), "node_id", "place")
    assert sorted(order.values()) == list(range(1, 101))
    assert {tuple(r) for r in B.dilute(base, 0.0, 0.2, 2).edges.collect()} == {tuple(r) for r in base.edges.collect()}
    full = B.dilute(base, 1.0, 0.2, 2)
    y = values(base.nodes, "node_id", "y")
    assert all(y[r["src"]] == y[r["dst"]] for r in full.edges.collect())


def test_links_of_blocks(spark):
    """As many links as chances say, within blocks as rules say, and of the order that a rule asks for."""
    nodes = spark.range(300).select(F.col("id").alias("node_id"), (F.col("id") % 3).cast("int").alias("block"))
    links = B.block_links(nodes, [(0, 0, 0, 0.3, 1.0, 2.0), (0, 1, 1, 0.5, 3.0, 3.0), (0, 1, -1, 0.1, 4.0, 4.0), (2, 2, 0, 0.9, 5.0, 5.0)], 7).collect()
    assert len({(r["src"], r["dst"]) for r in links}) == len(links) and all(r["src"] < r["dst"] for r in links)
    counted = {k: sum(f(r) for r in links) for k, f in {"own": lambda r: 1 <= r["w"] < 2, "up": lambda r: r["w"] == 3, "down": lambda r: r["w"] == 4, "dense": lambda r: r["w"] == 5}.items()}
    assert sum(counted.values()) == len(links)
    for name, pairs, chance in (("own", 4950, 0.3), ("up", 5050, 0.5), ("down", 4950, 0.1), ("dense", 4950, 0.9)):
        assert abs(counted[name] - pairs * chance) < 5 * math.sqrt(pairs * chance * (1 - chance)), name
    assert all((r["src"] % 3, r["dst"] % 3) == ((0, 1) if r["w"] == 3 else (1, 0)) for r in links if r["w"] in (3, 4))
    assert B.block_links(nodes.limit(0), [(0, 0, 0, 0.3, 1.0, 2.0)]).count() == 0


def test_roles_are_connected(spark):
    assert C.connected_components(B.roles(spark, 60)).select("component").distinct().count() == 1


def test_attention(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 0.5), (0, 0, 0, 1, 1.5), (0, 0, 1, 0, 0.0)], "passage_id long, layer int, query long, key long, p double")
    assert [r["p"] for r in A.renormalised(rows).orderBy("query", "key").collect()] == [0.25, 0.75, 0.0]
    assert values(A.entropies(rows), "query", "entropy")[0] == pytest.approx(-(0.25 * math.log(0.25) + 0.75 * math.log(0.75)))
    with pytest.raises(ValueError):
        A.over_layers(rows, 1, "nothing")


def test_passages_and_sentences(spark):
    lines = spark.createDataFrame([(1, "\n".join(["line number i of the corpus"] * 20)), (2, None), (3, " \n ")], "id long, text string")
    packed = P.pack_lines(lines, "id", "text", 15).collect()
    assert len(packed) == 10 and max(r["n_words"] for r in packed) == 12
    text = spark.createDataFrame([(1, "Alpha here. Beta there! Gamma?")], "id long, text string")
    tokens = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 6, 12, 17, 24, 29])], "id long, pos int, start int")
    found = values(P.sentence_ids(tokens, text, "id", "text"), "pos", "sentence_id")
    assert [found[i] for i in range(6)] == [0, 0, 1, 1, 2, 2]
    blocks = values(P.equal_blocks(spark.createDataFrame([(1, 100)], "id long, n long"), "id", "n"), "pos", "block")
    assert sorted(set(blocks.values())) == [0, 1, 2]
    explicit = P.blocks_of_lengths(spark.createDataFrame([(1, [2, 3])], "id long, n array<long>"), "id", "n")
    assert values(explicit, "pos", "block") == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}


def test_matrix_bounds():
    rng = np.random.default_rng(0)
    a = rng.random((6, 6))
    a = a + a.T
    b = a.copy()
    b[0, 1] = b[1, 0] = 0
    found = K.bounds(a, b)
    assert found["weyl"] and found["interlacing"]


def test_arrays_of_uniform_numbers():
    import hashlib

    x, y = np.array([0, 5, -7, 10, 99, 100, 12345678901234, -1000, 2**60]), np.arange(9) * 37
    wanted = [int(hashlib.md5(f"3:w:{a}:{b}:-1".encode()).hexdigest()[:8], 16) / 2**32 for a, b in zip(x, y, strict=True)]
    assert uniform_array(3, "w", x, y, -1).tolist() == wanted


def test_links_of_pages_are_those_of_points_and_no_link_is_shuffled(spark):
    nodes = spark.range(2700).select(F.col("id").alias("node_id"), F.when(F.col("id") < 2200, 0).otherwise(1).alias("block"))
    rules = [(0, 0, 0, 0.02, 0.5, 1.0), (0, 1, 1, 0.3, 1.0, 1.0), (0, 1, -1, 0.01, 2.0, 3.0)]
    placed = nodes.withColumn("place", F.when(F.col("block") == 0, F.col("node_id")).otherwise(F.col("node_id") - 2200))
    cells = spark.createDataFrame(B.chunked(rules), "a int, b int, ord int, size long, cdf array<double>, low double, high double").withColumn("na", F.lit(2200).cast("long"))
    points = B._links_of_points(placed, cells.withColumn("nb", F.when(F.col("b") == 0, 2200).otherwise(500).cast("long")), 5)
    found = B.block_links(nodes, rules, 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, points.collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")
    linked = {(r["src"], r["dst"]): r["w"] for r in B.linked_along_path(nodes, [(0, 0, 0, 0.02, 0.05, 0.5)], 5).collect()}
    place = sorted(range(2700), key=lambda i: (_hashed(f"5:b:{i}"), i))
    path = {(min(p), max(p)) for p in zip(place, place[1:], strict=False)}
    plain = {(r["src"], r["dst"]): r["w"] for r in B.block_links(nodes, [(0, 0, 0, 0.02, 0.05, 0.5)], 5).collect()}
    assert linked == plain | {p: max(0.3, plain.get(p, 0)) for p in path}


def _hashed(text):
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def test_points_outside_a_rules_order_are_not_hashed(spark, monkeypatch):
    hashed = []
    plain = B.uniform_array
    monkeypatch.setattr(B, "uniform_array", lambda *parts: hashed.append(max(len(p) for p in parts if isinstance(p, np.ndarray))) or plain(*parts))
    made = {}
    for order in (1, -1, 0):
        _, _, _, size, cdf, low, high = B.chunked([(0, 1, order, 0.3, 1.0, 1.0)])[0]
        for shift in (0, 32, 64):
            row = {"a": 0, "b": 1, "ord": order, "size": size, "cdf": np.array(cdf), "nb": 64, "low": low, "high": high, "page_a": 0, "page_b": 0, "ids_a": np.arange(64) * 2 + 1, "ids_b": (np.arange(64) + 64 - shift) * 2}
            hashed.clear()
            links = [pair for src, dst, _ in B._page_links(row, 3, None) for pair in zip(src.tolist(), dst.tolist(), strict=True)]
            made[order, shift] = (sum(hashed), len(links))
            assert not order or all((s % 2 == 1) == (order > 0) for s, _ in links)
    assert made[-1, 0] == (0, 0) and made[1, 0][1] > 1000  # no pair of these pages is of order -1
    assert 0 < made[-1, 32][0] < 0.25 * made[0, 32][0]  # an eighth of the pairs
    assert 0.35 * made[0, 64][0] < made[1, 64][0] < 0.65 * made[0, 64][0]  # half of the pairs


def test_links_do_not_depend_on_the_length_of_pages(spark, monkeypatch):
    """Longer pages are sent less often, as soon as enough pairs of them meet."""
    nodes = spark.range(2700).select(F.col("id").alias("node_id"), F.when(F.col("id") < 2200, 0).otherwise(1).alias("block"))
    rules = [(0, 0, 0, 0.02, 0.5, 1.0), (0, 1, 1, 0.3, 1.0, 1.0), (0, 1, -1, 0.01, 2.0, 3.0)]
    made = []
    for page in (1024, 2048):
        monkeypatch.setattr(B, "page_length", lambda *_, page=page: page)
        made.append([sorted(map(tuple, links.collect())) for links in (B.block_links(nodes, rules, 5), B.linked_along_path(nodes, rules, 5))])
    assert made[0] == made[1] and len(made[0][0]) > 100_000
    monkeypatch.undo()
    lengths = [B.page_length([(0, 0), (0, 1)], {0: n, 1: n}, 100) for n in (1000, 40_000, 10**6)]
    assert lengths == [1024, 4096, 16384]


def test_arrays_of_uniform_numbers_of_mixed_forms():
    import hashlib

    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 10 ** rng.integers(1, 17, 3000)), rng.integers(-(10**6), 10**9, 3000)
    for parts in (("0", "w", x, y), (x, "c", y), (5, "n", 10, 11, -1, x), (0, "w", np.arange(3000) + 5000, np.arange(3000) + 70_000)):
        rows = zip(*[p if isinstance(p, np.ndarray) else [p] * 3000 for p in parts], strict=True)
        assert uniform_array(*parts).tolist() == [_hashed(":".join(map(str, row))) / 2**32 for row in rows]
    assert len(uniform_array(0, np.zeros(0, np.int64))) == 0
    with pytest.raises(ValueError):
        uniform_array("x" * 60, x)


def test_weights_of_links_are_rounded_without_decimals(spark):
    from graphloom.plans.graph_queries import rounded, rounded_links

    links = spark.range(100_000).select(F.col("id").alias("src"), (0.05 + 0.95 * F.rand(1)).alias("w")).union(spark.createDataFrame([(0, 1.0), (1, 0.3), (2, 0.05), (3, 0.0000004), (4, 0.1234565)], "src long, w double"))
    links = links.persist()
    assert rounded_links(links).exceptAll(rounded(links)).count() == 0
    assert "round(" not in rounded_links(links)._jdf.queryExecution().optimizedPlan().toString()


def test_links_of_regimes_do_not_wait_for_features(spark, monkeypatch):
    written = []
    monkeypatch.setattr(B, "staged", lambda df, name, plain=B.staged: written.append((name, df.columns)) or plain(df, name))
    graphs = B.planted_regimes(spark, 40), B.erp_fraud(spark, 40)
    assert [c for name, columns in written if name == "nodes" for c in columns if c == "x"] == []
    assert all(len(r["x"]) == 16 for g in graphs for r in g.nodes.collect())
