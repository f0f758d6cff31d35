"""The networks of ``learned`` over any number of nodes: every epoch is a few rounds over the rows of all (split, seed) groups.

A layer over neighbours' hidden values is linear, so that what a node sends is already multiplied by the weights: a number for
each channel, not for each hidden unit. Errors go back the same way. Wide rows are written once, bucketed by node, and never
shuffled again; only parameters and sums of their gradients meet on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.iterative import _arrays, totals, with_neighbours
from graphloom.operators.learned import GATES, NodeMixture, Sage, softmax
from graphloom.storage import discard, new_path, staged

Arrays = dict[str, np.ndarray]


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written in as many buckets as a shuffle has partitions: joins by ``key`` leave it where it is."""
    spark = df.sparkSession
    tasks, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"graphloom_{uuid.uuid4().hex}"
    df.repartition(tasks, key).write.bucketBy(tasks, key).option("path", new_path(spark, "buckets")).saveAsTable(name)
    return spark.table(name)


def _applied(df: DataFrame, kernel: Callable[[Arrays], Arrays], names: tuple[str, ...]) -> DataFrame:
    """(node_id, names): a row of numbers for each row and name."""
    schema = T.StructType([T.StructField("node_id", T.LongType()), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                made, ends = kernel(_arrays(batch)), np.arange(len(batch) + 1, dtype=np.int32)
                columns = [pa.ListArray.from_arrays(ends * made[n].shape[1], pa.array(np.ascontiguousarray(made[n], np.float64).reshape(-1))) for n in names]
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), *columns], schema.names)

    return df.mapInArrow(run, schema)


def _numbered(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``rows`` with their group's number ``g`` and an id for each (node, group) in place of the node's, and the groups."""
    cells = [(r["split"], r["seed"]) for r in rows.select("split", "seed").distinct().orderBy("split", "seed").collect()]  # few, as a protocol has
    table = rows.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(cells)], "split int, seed int, g int")
    key = lambda node: node * len(cells) + F.col("g")
    placed = rows.join(F.broadcast(table), ["split", "seed"])
    return placed.withColumn("near", F.transform("near", key)).withColumn("node_id", key(F.col("node_id"))), cells


def _named(df: DataFrame, cells: list[tuple[int, int]]) -> DataFrame:
    table = df.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(cells)], "split int, seed int, g int")
    split = df.withColumn("g", F.pmod("node_id", F.lit(len(cells))).cast("int")).withColumn("node_id", F.expr(f"(node_id - pmod(node_id, {len(cells)})) div {len(cells)}"))
    return split.join(F.broadcast(table), "g").drop("g")


def _with_mean(rows: DataFrame, both: DataFrame, width: int) -> DataFrame:
    """``rows`` whose ``x`` goes on with the neighbours' mean."""
    summed = with_neighbours(rows.select("node_id", "x", "deg"), both, "x", width)
    means = summed.select("node_id", F.transform("near", lambda v: v / F.greatest(F.col("deg"), F.lit(1.0))).alias("_mean"))
    return rows.join(means, "node_id").withColumn("x", F.concat("x", "_mean")).drop("_mean")


def _by_group(b: Arrays, many: int) -> Iterator[tuple[int, np.ndarray]]:
    for j in range(many):
        if len(at := np.flatnonzero(b["g"] == j)):
            yield j, at


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.reshape(-1) for a in arrays])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([a.size for a in like])
    return [part.reshape(a.shape) for part, a in zip(np.split(flat, ends[:-1]), like, strict=True)]


def _sent(model: Sage, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hidden values, a node's own part of the last layer's sums, and what it sends to its neighbours."""
    h = model.hidden(x)
    width = h.shape[1]
    own = h @ model.p[2][:width] + model.p[3]
    return h, own, h @ model.p[2][width:] if len(model.p[2]) > width else np.zeros_like(own)


def _gate_gradients(model: Sage, x: np.ndarray, error: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
    """Gradients from the errors of the nodes and those that came back from their neighbours."""
    h = model.hidden(x)
    width = h.shape[1]
    if len(model.p[2]) == width:
        return [*model.hidden_gradients(error @ model.p[2].T), h.T @ error, error.sum(0)]
    first = model.hidden_gradients(error @ model.p[2][:width].T + back @ model.p[2][width:].T)
    return [*first, np.vstack([h.T @ error, h.T @ back]), error.sum(0)]


def _first_round(rows: DataFrame, both: DataFrame, models: list[Sage], k: int, more: Callable[[int, Arrays, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(node_id, own, more, sent, near): the gates' last sums less the neighbours' part, and that part's sum."""

    def kernel(b: Arrays) -> Arrays:
        n = len(b["g"])
        out = {"own": np.zeros((n, k)), "sent": np.zeros((n, k)), "more": np.zeros((n, k if more else 1))}
        for j, at in _by_group(b, len(models)):
            _, out["own"][at], out["sent"][at] = _sent(models[j], b["x"][at])
            if more:
                out["more"][at] = more(j, b, at)
        return out

    return with_neighbours(_applied(rows, kernel, ("own", "more", "sent")), both, "sent", k)


def _probabilities(b: Arrays) -> np.ndarray:
    return softmax(b["own"] + b["near"] / np.maximum(b["deg"], 1)[:, None])


def _edges(rows: DataFrame) -> DataFrame:
    return _bucketed(rows.select(F.col("node_id").alias("src"), F.explode("near").alias("dst"), F.lit(1.0).alias("w")), "dst")


def gates(rows: DataFrame, kind: str, channels: int, epochs: int) -> DataFrame:
    """``learned.learned_gates`` of groups of any size."""
    rows, cells = _numbered(rows)
    known = F.col("target").isNotNull()
    rows = staged(rows.select("node_id", "g", "x", "near", F.size("near").cast("double").alias("deg"), known.cast("double").alias("use"), F.coalesce("target", F.array_repeat(F.lit(0.0), channels)).alias("target")), "rows")
    width = rows.select(F.size("x").alias("n")).first()["n"]
    models = [GATES[kind](width, channels, None if kind == "mlp" else _ONE, seed) for _, seed in cells]
    for model in models:
        model.near = None

    def moments(b: Arrays) -> np.ndarray:
        out = np.zeros((len(cells), 2 + 2 * width))
        for j, at in _by_group(b, len(cells)):
            x = b["x"][at]
            out[j] = np.concatenate([[len(at), b["use"][at].sum()], x.sum(0), (x * x).sum(0)])
        return out.reshape(-1)

    found = totals(rows.select("g", "x", "use"), moments, len(cells) * (2 + 2 * width)).reshape(len(cells), -1)
    n, total = np.maximum(found[:, :1], 1), np.maximum(found[:, 1], 1)
    trained = found[:, 1] > 0
    mean = found[:, 2 : 2 + width] / n
    scale = np.sqrt(np.maximum(found[:, 2 + width :] / n - mean**2, 0)) + 1e-8

    def standard(b: Arrays) -> Arrays:
        g = b["g"].astype(int)
        return {"x": (b["x"] - mean[g]) / scale[g]}

    keep = rows.select("node_id", "g", "deg", "use", "target")
    scaled = _applied(rows.select("node_id", "g", "x"), standard, ("x",)).join(keep, "node_id")
    sizes = [sum(p.size for p in m.p) for m in models]
    ends = np.cumsum([0, *sizes])
    if kind == "mlp":
        wide = staged(scaled, "scaled")

        def plain(b: Arrays) -> np.ndarray:
            out = np.zeros(ends[-1])
            for j, at in _by_group(b, len(models)):
                if trained[j] and len(at := at[b["use"][at] > 0]):
                    out[ends[j] : ends[j + 1]] = _flat(models[j].gradients((models[j].forward(b["x"][at]) - b["target"][at]) / total[j]))
            return out

        learn = wide.where("use > 0").select("g", "x", "use", "target")
        for _ in range(epochs):
            summed = totals(learn, plain, ends[-1])
            for j, m in enumerate(models):
                m.adam.step(_shaped(summed[ends[j] : ends[j + 1]], m.p))

        def proba(b: Arrays) -> Arrays:
            out = np.full((len(b["g"]), channels), 1 / channels)
            for j, at in _by_group(b, len(models)):
                if trained[j]:
                    out[at] = models[j].forward(b["x"][at])
            return {"gates": out}

        return _named(_applied(wide.select("node_id", "g", "x"), proba, ("gates",)), cells).select("split", "seed", "node_id", "gates")

    both = _edges(rows)
    wide = _bucketed(_with_mean(scaled, both, width).select("node_id", "g", "x"), "node_id")
    narrow = _bucketed(keep, "node_id")

    def errors(b: Arrays) -> Arrays:
        error = (_probabilities(b) - b["target"]) * (b["use"] / total[b["g"].astype(int)])[:, None]
        return {"error": error, "sent": error / np.maximum(b["deg"], 1)[:, None]}

    def sums(b: Arrays) -> np.ndarray:
        out = np.zeros(ends[-1])
        for j, at in _by_group(b, len(models)):
            out[ends[j] : ends[j + 1]] = _flat(_gate_gradients(models[j], b["x"][at], b["error"][at], b["near"][at]))
        return out

    for _ in range(epochs):
        found = staged(_applied(_first_round(wide, both, models, channels).join(narrow, "node_id"), errors, ("error", "sent")), "errors")
        summed = totals(wide.join(with_neighbours(found, both, "sent", channels), "node_id").select("g", "x", "error", "near"), sums, ends[-1])
        discard(found)
        for j, m in enumerate(models):
            if trained[j]:
                m.adam.step(_shaped(summed[ends[j] : ends[j + 1]], m.p))

    def last(b: Arrays) -> Arrays:
        out = _probabilities(b)
        out[~trained[b["g"].astype(int)]] = 1 / channels
        return {"gates": out}

    return _named(_applied(_first_round(wide, both, models, channels).join(narrow, "node_id"), last, ("gates",)), cells).select("split", "seed", "node_id", "gates")


class _Any:
    """Stands for neighbours where only the shapes of a network's arrays are made."""


_ONE = _Any()


def mixture(rows: DataFrame, order: int, n_classes: int, gate: str, epochs: int) -> DataFrame:
    """``learned.node_mixture`` of groups of any size."""
    rows, cells = _numbered(rows)
    terms = F.concat(*[f"t{k}" for k in range(order + 1)])
    train = (F.col("part") == "train").cast("double")
    rows = staged(rows.select("node_id", "g", "x", "near", "y", terms.alias("terms"), F.size("near").cast("double").alias("deg"), train.alias("use")), "rows")
    width, long = rows.select(F.size("x").alias("n"), F.size("terms").alias("m")).first()
    models = [NodeMixture(order, long // (order + 1), n_classes, _ONE, gate=gate, seed=seed) for _, seed in cells]
    experts = len(models[0].experts)
    for model in models:
        model.near = None
        if model.gate is not None:
            model.gate.near = None
    counted = totals(rows.select("g", "use", "deg"), lambda b: np.concatenate([np.bincount(b["g"].astype(int), b[c], len(cells)) for c in ("use", "deg")]), 2 * len(cells))
    total, links = np.maximum(counted[: len(cells)], 1), np.maximum(counted[len(cells) :], 1)
    wanted = [[p for e in m.experts for p in e.p] + (m.gate.p if m.gate is not None else []) for m in models]
    ends = np.cumsum([0, *[sum(p.size for p in w) for w in wanted]])

    def parts(j: int, b: Arrays, at: np.ndarray) -> np.ndarray:
        t = b["terms"][at].reshape(len(at), order + 1, -1)
        return np.stack([e.forward(t) for e in models[j].experts], 1)

    def expert_gradients(j: int, b: Arrays, at: np.ndarray, gates: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """From each node's gates and the slope of the loss by its mixed probability of its own class."""
        out, p = [], parts(j, b, at)
        one = np.eye(n_classes)[b["y"][at].astype(int)] * slope[:, None]
        for i, expert in enumerate(models[j].experts):
            own = one * gates[:, [i]]
            out += expert.gradients(p[:, i] * (own - (own * p[:, i]).sum(1, keepdims=True)))
        return out

    def slopes(mixed: np.ndarray, b: Arrays) -> np.ndarray:
        return -b["use"] / np.maximum(mixed, 1e-9) / total[b["g"].astype(int)]

    def step(summed: np.ndarray) -> None:
        for j, m in enumerate(models):
            found = _shaped(summed[ends[j] : ends[j + 1]], wanted[j])
            for i, expert in enumerate(m.experts):
                expert.adam.step(found[3 * i : 3 * i + 3])
            if m.gate is not None:
                m.gate.adam.step(found[3 * experts :])

    if gate == "uniform":

        def plain(b: Arrays) -> np.ndarray:
            out = np.zeros(ends[-1])
            for j, at in _by_group(b, len(models)):
                own = {k: v[at] for k, v in b.items()}
                gates = np.full((len(at), experts), 1 / experts)
                mixed = parts(j, b, at).mean(1)[np.arange(len(at)), own["y"].astype(int)]
                out[ends[j] : ends[j + 1]] = _flat(expert_gradients(j, b, at, gates, slopes(mixed, own)))
            return out

        learn = rows.where("use > 0").select("g", "terms", "y", "use")
        for _ in range(epochs):
            step(totals(learn, plain, ends[-1]))
        done = rows.withColumn("gates", F.array_repeat(F.lit(1 / experts), experts))
    else:
        both = _edges(rows)
        wide = _bucketed((_with_mean(rows, both, width) if gate == "graph" else rows).select("node_id", "g", "x", "terms", "y"), "node_id")
        narrow = _bucketed(rows.select("node_id", "g", "deg", "use"), "node_id")
        gate_models = [m.gate for m in models]

        def of_class(j: int, b: Arrays, at: np.ndarray) -> np.ndarray:
            return np.take_along_axis(parts(j, b, at), b["y"][at].astype(int)[:, None, None], 2)[:, :, 0]

        def gated(b: Arrays) -> Arrays:
            return {"gates": _probabilities(b), "more": b["more"]}

        def errors(b: Arrays) -> Arrays:
            g, p, cell = b["gates"], b["more"], b["g"].astype(int)
            slope = slopes((g * p).sum(1), b)
            by_gate = slope[:, None] * p + (4 * models[0].smooth / links[cell])[:, None] * (b["deg"][:, None] * g - b["near"])
            error = g * (by_gate - (by_gate * g).sum(1, keepdims=True))
            return {"error": error, "sent": error / np.maximum(b["deg"], 1)[:, None], "gates": g, "slope": slope[:, None]}

        def sums(b: Arrays) -> np.ndarray:
            out = np.zeros(ends[-1])
            for j, at in _by_group(b, len(models)):
                own = expert_gradients(j, b, at, b["gates"][at], b["slope"][at, 0])
                out[ends[j] : ends[j + 1]] = _flat([*own, *_gate_gradients(gate_models[j], b["x"][at], b["error"][at], b["near"][at])])
            return out

        for _ in range(epochs):
            first = staged(_applied(_first_round(wide, both, gate_models, experts, of_class).join(narrow, "node_id"), gated, ("gates", "more")), "gates")
            second = staged(_applied(with_neighbours(first, both, "gates", experts).join(narrow, "node_id"), errors, ("error", "sent", "gates", "slope")), "errors")
            step(totals(wide.join(with_neighbours(second, both, "sent", experts), "node_id").select("g", "x", "terms", "y", "error", "near", "gates", "slope"), sums, ends[-1]))
            discard(first)
            discard(second)
        last = _applied(_first_round(wide, both, gate_models, experts).join(narrow, "node_id"), lambda b: {"gates": _probabilities(b)}, ("gates",))
        done = rows.join(last, "node_id")

    def mixed(b: Arrays) -> Arrays:
        out = np.zeros((len(b["g"]), n_classes))
        for j, at in _by_group(b, len(models)):
            out[at] = np.einsum("nm,nmc->nc", b["gates"][at], parts(j, b, at))
        return {"proba": out, "gates": b["gates"]}

    from graphloom.functions.vectors import argmax

    test = _applied(done.where("use = 0").select("node_id", "g", "terms", "gates"), mixed, ("proba", "gates"))
    return _named(test, cells).select("split", "seed", "node_id", argmax("proba").cast("int").alias("pred"), "proba", "gates")
