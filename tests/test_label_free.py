"""Gates without labels: fields against their definitions, and a gate that gives its channels back and routes another graph."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import label_free as L
from graphloom.operators import learned as N
from graphloom.operators import routing as R
from tests.test_iterative import graph, laplacian, random_edges


@pytest.fixture(scope="module")
def fields(spark):
    edges = random_edges(6, 60, 120)
    return edges, L.structural_features(graph(spark, 60, edges), 1, k=4).persist()


def test_structural_fields(fields):
    edges, found = fields
    lap = laplacian(60, edges)
    near = -(lap - np.diag(np.diag(lap)))
    v = np.linalg.eigh(lap)[1][:, 1:5]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = unit @ unit.T
    degree = near.sum(1)
    rows = sorted(found.collect(), key=lambda r: r["node_id"])
    for i, r in enumerate(rows):
        assert r["eig_nb_sim"] == pytest.approx(cosine[i][near[i] > 0].mean(), abs=1e-6)
        assert r["hx"] == pytest.approx(1.0)  # all features are alike
        assert r["spectral_ratio"] == pytest.approx(degree[i] / degree.max()) and r["log_degree"] == pytest.approx(math.log1p(degree[i]))
        assert r["degree_proxy"] == pytest.approx(min(1, max(0, (degree[i] - 2) / (degree[i] + 1))))


@pytest.mark.parametrize("strategy", L.STRATEGIES)
def test_a_gate_gives_its_channels_back(spark, fields, strategy):
    _, found = fields
    gates = L.assigned(found, strategy).persist()
    table = L.fit_gate(found, gates)
    assert [r["field"] for r in table.collect()] == [*L.FIELDS, "bias"]
    made = L.apply_gate(found, table).persist()
    assert made.where(F.abs(F.aggregate("gates", F.lit(0.0), lambda s, g: s + g) - 1) > 1e-9).count() == 0
    both = R.with_channel(gates).select("node_id", F.col("channel").alias("wanted")).join(R.with_channel(made), "node_id")
    assert both.where("wanted = channel").count() >= 48
    path = L.structural_features(graph(spark, 5, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 2.0)]), 1, k=2)  # another graph, with a lone node
    assert L.apply_gate(path, table).count() == 5


def test_unknown_strategy(fields):
    with pytest.raises(ValueError):
        L.assigned(fields[1], "nothing")


def test_filters_are_interpolated(spark):
    """On the nodes of the interpolation a filter is met exactly."""
    order = 5
    at, _ = N.interpolation(order)
    terms = spark.createDataFrame([(i, *[[math.cos(k * math.acos(t))] for k in range(order + 1)]) for i, t in enumerate(at.tolist())], ["node_id", *[f"t{k}" for k in range(order + 1)]])
    for kind, f in N.FILTERS.items():
        assert [r["x"][0] for r in N.filtered(terms, kind, order).orderBy("node_id").collect()] == pytest.approx(f(at).tolist())
