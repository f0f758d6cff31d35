"""Containers, nested records and streams of points."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import experts as E
from graphloom.operators import fitting
from graphloom.sources import containers, nested, tables
from graphloom.streaming import points


@pytest.mark.parametrize("kind", ["npz", "mat"])
def test_columns_come_back(spark, tmp_path, kind):
    rows = spark.range(0, 1000, 1, 4).select("id", (F.col("id") * 7 - 3000).alias("k"), F.sqrt("id").alias("w"))
    path = f"file://{tmp_path}/{kind}"
    containers.write_columns(rows, path, kind)
    back = containers.read_columns(spark, path, kind, rows=100)
    assert back.dtypes == rows.dtypes and back.rdd.getNumPartitions() >= 10
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert containers.read_columns(spark, path, kind, ["w"]).columns == ["w"]
    with pytest.raises(Exception, match="no variables"):
        containers.read_columns(spark, path, kind, ["nothing"]).count()


def test_mat_variables():
    """Big and little ends, small elements, matrices and sparse ones, beside variables of other kinds."""

    def element(order, kind, content):
        if len(content) <= 4:
            return struct.pack(f"{order}I", len(content) << 16 | kind) + content.ljust(4, b"\0")
        return struct.pack(f"{order}II", kind, len(content)) + content + bytes(-len(content) % 8)

    for order, mark in (("<", b"IM"), (">", b"MI")):
        def matrix(name, klass, shape, *parts, order=order):
            body = element(order, 6, struct.pack(f"{order}II", klass, 0)) + element(order, 5, struct.pack(f"{order}ii", *shape)) + element(order, 1, name) + b"".join(element(order, k, c) for k, c in parts)
            return element(order, 14, body)

        numbers = lambda kind, values, order=order: np.array(values, kind).astype(np.dtype(kind).newbyteorder(order)).tobytes()
        data = b"x".ljust(124) + struct.pack(f"{order}H", 0x0100) + mark
        data += matrix(b"label", 6, (3, 1), (2, bytes([1, 0, 1])))  # doubles stored as bytes
        data += matrix(b"text", 4, (1, 2), (4, numbers("u2", [65, 66])))
        data += matrix(b"full", 6, (2, 2), (9, numbers("f8", [1, 2, 3, 4])))
        data += matrix(b"net", 5, (3, 3), (5, numbers("i4", [1, 2, 0])), (5, numbers("i4", [0, 2, 2, 3])), (9, numbers("f8", [0.5, 1.5, 2.5])))
        found = containers.mat_variables(data)
        assert set(found) == {"label", "full", "net"}
        assert found["label"].tolist() == [[1], [0], [1]] and found["full"].tolist() == [[1, 3], [2, 4]]
        rows, columns, values, shape = found["net"]
        assert (rows.tolist(), columns.tolist(), values.tolist(), shape) == ([1, 2, 0], [0, 0, 2], [0.5, 1.5, 2.5], (3, 3))
        assert list(containers.columns_of(data, "mat", ["net"])) == ["row", "col", "val"]
        assert list(containers.columns_of(data, "mat", ["full"])) == ["full_0", "full_1"]
        with pytest.raises(ValueError):
            containers.columns_of(data, "mat", ["full", "net"])


def walked(value, path="$"):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in walked(v, f"{path}.{k}" if k.isidentifier() else f'{path}."{k}"')]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in walked(v, f"{path}[{i}]")]
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
    text = None if value is None else json.dumps(value) if not isinstance(value, str) else value
    return [(path, kinds.get(type(value), "number"), text)]


def test_leaves_of_any_depth(spark):
    rng = random.Random(4)

    def value(depth):
        if depth and rng.random() < 0.7:
            return {rng.choice(["a", "b", "c d", "e.f"]): value(depth - 1) for _ in range(3)} if rng.random() < 0.5 else [value(depth - 1) for _ in range(rng.randrange(3))]
        return rng.choice([1, -7, 2.5, "x", 'q"q', "", True, None, {}, []])

    records = [value(5) for _ in range(40)]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, None), (99, "{no json")]
    found = nested.leaves(spark.createDataFrame(rows, "id long, text string"), "text", "id").collect()
    assert sorted(map(str, ((r["id"], r["path"], r["type"], r["value"]) for r in found))) == sorted(str((i, *leaf)) for i, r in enumerate(records) for leaf in walked(r))
    picked = nested.flattened(spark.createDataFrame([(1, '{"a": {"b": [5, 6]}}'), (2, "no")], "id long, text string"), "text", {"x": "$.a.b[1]"}, "id")
    assert {r["id"]: r["x"] for r in picked.collect()} == {1: "6", 2: None}


def test_a_point_counts_once_after_a_failure(spark, tmp_path):
    """The second of four batches is written and then fails; the next call writes it again and goes on."""
    source, out, marks = str(tmp_path / "in"), f"file://{tmp_path}/out", f"file://{tmp_path}/marks"
    for i in range(4):
        spark.range(i * 10, i * 10 + 10, 1, 1).select("id", (F.col("id") * 2).alias("v")).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    calls = []

    def failing(batch):
        calls.append(1)
        if len(calls) == 2:
            batch.write.mode("overwrite").parquet(f"{out}/batch=1")  # some of it is there already
            raise RuntimeError("lost")
        return batch

    stream = lambda: points.stream_of(spark, source, schema, 1)
    with pytest.raises(Exception, match="lost"):
        points.add_points(stream(), out, marks, failing)
    grid = spark.range(40)
    assert points.remaining(grid, spark, out, ["id"]).count() < 40
    points.add_points(stream(), out, marks, lambda batch: batch)
    points.add_points(stream(), out, marks, lambda batch: batch)  # nothing is left to do
    found = spark.read.parquet(out)
    assert found.count() == 40 and points.remaining(grid, spark, out, ["id"]).count() == 0
    assert {r["id"]: r["v"] for r in points.read_points(spark, out, ["id"]).collect()} == {i: 2 * i for i in range(40)}


def test_fits_over_tasks_equal_fits_in_one_place(spark):
    """Models with rows of their own, classes that one of them never sees, and one of a single class."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(240, 3)), rng.integers(0, 3, 240)
    x[np.arange(240), y] += 1.5
    use = np.stack([np.ones(240), rng.integers(0, 2, 240), y < 2, y == 2], axis=1).astype(float)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), use[i].tolist()) for i in range(240)], "node_id long, x array<double>, y int, use array<double>").repartition(3)
    counts = fitting.class_counts(rows, 4, 4)
    assert counts.sum() == use.sum() and (counts[3] > 0).tolist() == [False, False, True, False]
    weights = fitting.fit_logistic(rows, counts > 0, 3)
    for j in range(4):
        at = use[:, j] > 0
        wanted = E.Logistic(4).fit(x[at], y[at]).predict_proba(x)
        assert E._linear(weights[j], counts[j] > 0, x) == pytest.approx(wanted, abs=1e-4)


def test_lbfgs_minimises_several_functions():
    matrices = [np.diag([1.0, 10.0, 100.0]), np.diag([3.0, 2.0, 1.0])]
    aims = np.array([[1.0, 2.0, 3.0], [-1.0, 0.0, 5.0]])

    def evaluate(points_):
        off = points_ - aims
        return np.array([0.5 * o @ m @ o for o, m in zip(off, matrices, strict=True)]), np.array([m @ o for o, m in zip(off, matrices, strict=True)])

    assert fitting.lbfgs(evaluate, np.zeros((2, 3)), 1e-9) == pytest.approx(aims, abs=1e-6)


def test_cosines_of_a_small_file_are_the_work_of_all_tasks(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.standard_normal((1300, 3)), 1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").coalesce(1)
    found = tables.cosines(rows, "id", "v", 4)
    assert found.rdd.getNumPartitions() > 1
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    p = np.round(unit @ unit.T, 9)
    np.fill_diagonal(p, -np.inf)
    wanted = {(i, j) for i in range(1300) for j in np.flatnonzero(p[i] >= np.sort(p[i])[-4])}  # ties stay
    made = {(r["query"], r["key"]): r["p"] for r in found.collect()}
    assert wanted <= set(made) and all(abs(made[k] - p[k]) < 2e-9 for k in wanted)
