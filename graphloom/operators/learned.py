"""Learned gates, graph experts and mixtures, trained in numpy on one graph a task.

Tasks are the (split, seed) groups of up to ``MAX_NODES`` nodes. What a graph
gives a layer is computed before, by joins (propagations, Chebyshev terms); only
layers over hidden values need the neighbours inside a task, which get them as a
list a node. Larger groups are trained by the rounds of ``learned_rounds``, with
the same steps, wherever their rows are.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashing import uniform
from graphloom.functions.vectors import argmax
from graphloom.graph import Graph
from graphloom.operators import fitting
from graphloom.operators.experts import _linear
from graphloom.operators.iterative import totals
from graphloom.operators.scores import propagate
from graphloom.plans.ranking import grouped_rank
from graphloom.storage import staged

MAX_NODES = 50_000


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class Adam:
    """Steps of a list of arrays, with decay and clipping of the gradients' common norm on request."""

    def __init__(self, values: list[np.ndarray], rate: float = 1e-2, decay: float = 0.0, clip: float | None = None) -> None:
        self.values, self.rate, self.decay, self.clip, self.t = values, rate, decay, clip, 0
        self.m, self.v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        gradients = [g + self.decay * x for g, x in zip(gradients, self.values, strict=True)]
        if self.clip is not None and (norm := np.sqrt(sum((g * g).sum() for g in gradients))) > self.clip:
            gradients = [g * (self.clip / norm) for g in gradients]
        for x, m, v, g in zip(self.values, self.m, self.v, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class Neighbours:
    """Means over neighbours, and the transposed map; a node without neighbours gets zeros."""

    def __init__(self, near: list[np.ndarray]) -> None:
        self.n = len(near)
        size = np.array([len(x) for x in near])
        self.to, self.of = np.repeat(np.arange(self.n), size), np.concatenate([*near, np.zeros(0)]).astype(np.int64)
        self.weight = 1.0 / np.maximum(size, 1)[self.to]

    def _sum(self, into: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(into, values[:, j], self.n) for j in range(values.shape[1])], 1)

    def mean(self, h: np.ndarray) -> np.ndarray:
        return self._sum(self.to, h[self.of] * self.weight[:, None])

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._sum(self.of, g[self.to] * self.weight[:, None])


class Sage:
    """Two layers over a node's own values and its neighbours' mean; ``near`` None makes it a plain two-layer network.

    Trained on soft targets by cross-entropy, which is the Kullback-Leibler divergence up to a constant. ``norm``
    normalises the hidden layer of each node.
    """

    def __init__(self, inputs: int, outputs: int, near: Neighbours | None, width: int = 32, norm: bool = False, rate: float = 1e-2, decay: float = 0.0, clip: float | None = None, seed: int = 0) -> None:
        rng, wide = np.random.default_rng(seed), 1 if near is None else 2
        self.near, self.norm = near, norm
        self.p = [rng.normal(0, np.sqrt(2 / (wide * inputs)), (wide * inputs, width)), np.zeros(width), rng.normal(0, np.sqrt(1 / (wide * width)), (wide * width, outputs)), np.zeros(outputs)]
        self.adam = Adam(self.p, rate, decay, clip)

    def _with_mean(self, h: np.ndarray) -> np.ndarray:
        return h if self.near is None else np.hstack([h, self.near.mean(h)])

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.h = self._with_mean(self.hidden(self._with_mean(x)))
        return softmax(self.h @ self.p[2] + self.p[3])

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """The hidden layer's values from a node's own and its neighbours' mean ones."""
        self.x = x
        z = self.x @ self.p[0] + self.p[1]
        if self.norm:
            self.scale = np.sqrt(z.var(1, keepdims=True) + 1e-5)
            z = (z - z.mean(1, keepdims=True)) / self.scale
        self.z = z
        return np.maximum(z, 0)

    def gradients(self, error: np.ndarray) -> list[np.ndarray]:
        """Gradients from those of the last layer's sums."""
        back = error @ self.p[2].T
        width = self.z.shape[1]
        hidden = back[:, :width] + (0 if self.near is None else self.near.back(back[:, width:]))
        return [*self.hidden_gradients(hidden), self.h.T @ error, error.sum(0)]

    def hidden_gradients(self, hidden: np.ndarray) -> list[np.ndarray]:
        """Gradients of the first layer from those of the hidden values."""
        hidden = hidden * (self.z > 0)
        if self.norm:
            hidden = (hidden - hidden.mean(1, keepdims=True) - self.z * (hidden * self.z).mean(1, keepdims=True)) / self.scale
        return [self.x.T @ hidden, hidden.sum(0)]

    def train(self, x: np.ndarray, target: np.ndarray, rows: np.ndarray, epochs: int = 200) -> Sage:
        for _ in range(epochs):
            error = np.zeros_like(target)
            error[rows] = (self.forward(x)[rows] - target[rows]) / max(int(rows.sum()), 1)
            self.adam.step(self.gradients(error))
        return self


def interpolation(order: int) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev's nodes, and the matrix that turns a filter's values at them into its coefficients."""
    at = np.cos((np.arange(order + 1) + 0.5) * np.pi / (order + 1))
    basis = np.cos(np.arange(order + 1)[:, None] * np.arccos(at)[None, :])
    out = 2.0 / (order + 1) * basis
    out[0] /= 2
    return at, out


#: What a filter is before training, as a function of the node in [-1, 1], where -1 is the lowest frequency.
FILTERS = {
    "low": lambda t: (1 - t) / 2, "high": lambda t: (1 + t) / 2, "band": lambda t: np.exp(-4 * t * t), "band_reject": lambda t: 1 - np.exp(-4 * t * t),
    "comb": lambda t: 0.5 + 0.5 * np.cos(2 * np.pi * t), "all": lambda t: np.ones_like(t),
}


def _times(weight: float):
    return lambda v: v * weight


def filtered(terms: DataFrame, kind: str, order: int, name: str = "x") -> DataFrame:
    """(node_id, name): a filter of ``FILTERS``, interpolated at Chebyshev's nodes, applied to the terms (node_id, t0, t1 and so on) of ``scores.chebyshev``."""
    at, matrix = interpolation(order)
    weights = (matrix @ FILTERS[kind](at)).tolist()
    out = F.transform("t0", lambda v: v * weights[0])
    for term, weight in zip(range(1, order + 1), weights[1:], strict=True):
        out = F.zip_with(out, F.transform(f"t{term}", _times(weight)), lambda a, b: a + b)
    return terms.select("node_id", out.alias(name))


class Cheb:
    """A filter by interpolation with non-negative values at Chebyshev's nodes, and a linear layer on what it leaves."""

    def __init__(self, order: int, inputs: int, outputs: int, kind: str = "low", rate: float = 1e-2, seed: int = 0) -> None:
        at, self.matrix = interpolation(order)
        self.p = [FILTERS[kind](at), np.random.default_rng(seed).normal(0, 0.1, (inputs, outputs)), np.zeros(outputs)]
        self.adam = Adam(self.p, rate, 1e-4)

    def forward(self, terms: np.ndarray) -> np.ndarray:
        """Probabilities from the terms (n x order + 1 x inputs)."""
        self.terms = terms
        self.z = np.einsum("nkd,k->nd", terms, self.matrix @ np.maximum(self.p[0], 0))
        return softmax(self.z @ self.p[1] + self.p[2])

    def gradients(self, error: np.ndarray) -> list[np.ndarray]:
        change = np.einsum("nkd,nd->k", self.terms, error @ self.p[1].T)
        return [(self.matrix.T @ change) * (self.p[0] > 0), self.z.T @ error, error.sum(0)]

    def train(self, terms: np.ndarray, y: np.ndarray, rows: np.ndarray, epochs: int = 200) -> Cheb:
        one = np.eye(len(self.p[2]))[y]
        for _ in range(epochs):
            error = np.zeros_like(one)
            error[rows] = (self.forward(terms)[rows] - one[rows]) / max(int(rows.sum()), 1)
            self.adam.step(self.gradients(error))
        return self


class NodeMixture:
    """Chebyshev experts of different first filters under a gate over the graph, trained together.

    The loss is that of the mixed probabilities, plus ``smooth`` times the mean square difference of neighbours' gates.
    ``gate`` may be "uniform": then only the experts learn.
    """

    def __init__(self, order: int, inputs: int, outputs: int, near: Neighbours, kinds: tuple[str, ...] = ("low", "band", "high"), gate: str = "graph", smooth: float = 0.1, seed: int = 0) -> None:
        self.experts = [Cheb(order, inputs, outputs, kind, seed=seed + i) for i, kind in enumerate(kinds)]
        self.gate = Sage(inputs, len(kinds), near if gate == "graph" else None, norm=True, decay=1e-4, clip=1.0, seed=seed) if gate != "uniform" else None
        self.near, self.smooth = near, smooth

    def forward(self, x: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.parts = np.stack([e.forward(terms) for e in self.experts], 1)
        gates = np.full((len(x), len(self.experts)), 1 / len(self.experts)) if self.gate is None else self.gate.forward(x)
        return np.einsum("nm,nmc->nc", gates, self.parts), gates

    def loss(self, x: np.ndarray, terms: np.ndarray, y: np.ndarray, rows: np.ndarray) -> float:
        mixed, gates = self.forward(x, terms)
        apart = gates[self.near.to] - gates[self.near.of]
        return float(-np.log(np.maximum(mixed[rows, y[rows]], 1e-9)).mean() + (self.smooth * (apart**2).sum(1).mean() if len(apart) and self.gate is not None else 0))

    def gradients(self, x: np.ndarray, terms: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
        """Gradients of the loss by each expert's values and by the gate's."""
        at = np.flatnonzero(rows)
        mixed, gates = self.forward(x, terms)
        slope = np.zeros_like(mixed)  # of the loss by the mixed probabilities
        slope[at, y[at]] = -1.0 / np.maximum(mixed[at, y[at]], 1e-9) / max(len(at), 1)
        by_expert = []
        for i, expert in enumerate(self.experts):
            p, own = self.parts[:, i], slope * gates[:, [i]]
            by_expert.append(expert.gradients(p * (own - (own * p).sum(1, keepdims=True))))
        if self.gate is None:
            return by_expert, []
        by_gate = np.einsum("nc,nmc->nm", slope, self.parts)
        if self.smooth and len(self.near.to):
            apart = gates[self.near.to] - gates[self.near.of]
            by_gate = by_gate + 2 * self.smooth / len(apart) * (self.near._sum(self.near.to, apart) - self.near._sum(self.near.of, apart))
        return by_expert, self.gate.gradients(gates * (by_gate - (by_gate * gates).sum(1, keepdims=True)))

    def train(self, x: np.ndarray, terms: np.ndarray, y: np.ndarray, rows: np.ndarray, epochs: int = 150) -> NodeMixture:
        for _ in range(epochs):
            by_expert, by_gate = self.gradients(x, terms, y, rows)
            for expert, g in zip(self.experts, by_expert, strict=True):
                expert.adam.step(g)
            if self.gate is not None:
                self.gate.adam.step(by_gate)
        return self


def with_neighbours(graph: Graph) -> DataFrame:
    """(node_id, x, y, near): each node with its neighbours' ids, ascending."""
    near = graph.both_ways().groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("dst")).alias("near"))
    return graph.nodes.select("node_id", "x", "y").join(near, "node_id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<bigint>")))


def _group(part: pd.DataFrame) -> tuple[pd.DataFrame, Neighbours, np.ndarray]:
    part = part.sort_values("node_id").reset_index(drop=True)
    ids = part["node_id"].to_numpy()
    return part, Neighbours([np.searchsorted(ids, np.asarray(x, np.int64)) for x in part["near"]]), np.stack(part["x"])


#: Gates by name: over features alone, over the graph, and over the graph with a normalised hidden layer, decay and clipping.
GATES = {
    "mlp": lambda d, k, near, seed: Sage(d, k, None, seed=seed),
    "graph": lambda d, k, near, seed: Sage(d, k, near, seed=seed),
    "message": lambda d, k, near, seed: Sage(d, k, near, norm=True, rate=5e-3, decay=5e-4, clip=1.0, seed=seed),
}


def _large(rows: DataFrame, limit: int) -> bool:
    """Whether a (split, seed) group has more than ``limit`` rows."""
    return rows.groupBy("split", "seed").count().where(F.col("count") > limit).limit(1).count() > 0


def learned_gates(rows: DataFrame, kind: str = "mlp", channels: int = 3, epochs: int = 200, limit: int = MAX_NODES) -> DataFrame:
    """(split, seed, node_id, gates) of every node.

    ``rows`` has (split, seed, node_id, x, near, target); the gate learns where ``target`` (a number for each channel) is
    not null. Without any target all gates are uniform. Groups of more than ``limit`` nodes are trained by rounds.
    """
    from graphloom.operators import learned_rounds

    rows = rows.select("split", "seed", "node_id", "x", "near", "target")
    if _large(rows, limit):
        return learned_rounds.gates(rows, kind, channels, epochs)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part, near, x = _group(part)
        known = part["target"].notna().to_numpy()
        target = np.stack([t if ok else np.zeros(channels) for t, ok in zip(part["target"], known, strict=True)])
        gates = np.full((len(part), channels), 1 / channels)
        if known.any():
            x = (x - x.mean(0)) / (x.std(0) + 1e-8)
            gates = GATES[kind](x.shape[1], channels, near, int(part["seed"].iloc[0])).train(x, target, known, epochs).forward(x)
        return pd.DataFrame({"split": part["split"], "seed": part["seed"], "node_id": part["node_id"], "gates": list(gates)})

    return rows.groupBy("split", "seed").applyInPandas(fit, "split int, seed int, node_id long, gates array<double>")


def _by_model(nodes: DataFrame, splits: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``nodes`` with ``use`` and ``test``, a 1 for each (split, seed) that trains on the node or tests it, and the (split, seed), of which a protocol has few."""
    cells = [(r["split"], r["seed"]) for r in splits.select("split", "seed").distinct().orderBy("split", "seed").collect()]
    here = [(F.col("split") == a) & (F.col("seed") == b) for a, b in cells]
    flags = lambda part: F.array(*[F.max((part & h).cast("double")) for h in here])
    parts = splits.groupBy("node_id").agg(flags(F.col("part") == "train").alias("use"), flags(F.col("part") != "train").alias("test"))
    return nodes.join(parts, "node_id"), cells


def _predicted(rows: DataFrame, cells: list[tuple[int, int]], made: list) -> DataFrame:
    found = fitting.predicted(rows, [(*c, 0) for c in cells], made)
    return found.select("split", "seed", "node_id", "pred", "proba")


def graph_expert(graph: Graph, splits: DataFrame, width: int, n_classes: int) -> DataFrame:
    """(split, seed, node_id, pred, proba) of all nodes but the training ones: logistic on features and their propagation, classes weighing alike.

    Fitted for all (split, seed) by passes over the nodes.
    """
    moved = propagate(graph, graph.nodes.select("node_id", "x"), width).withColumnRenamed("x", "x1")
    nodes = graph.nodes.select("node_id", "x", "y").join(moved, "node_id").select("node_id", "y", F.concat("x", "x1").alias("x"))
    rows, cells = _by_model(nodes, splits)
    rows = staged(rows, "rows")
    count = fitting.class_counts(rows, len(cells), n_classes)
    weight = count.sum(1, keepdims=True) / (np.maximum((count > 0).sum(1, keepdims=True), 1) * np.maximum(count, 1))
    weights = F.array(*[F.get("use", j) * F.get(F.array(*map(F.lit, weight[j].tolist())), F.col("y").cast("int")) for j in range(len(cells))])
    rows = rows.withColumn("use", weights)
    first = rows.select(F.size("x").alias("n")).first()
    fitted = fitting.fit_logistic(rows, count > 0, first["n"] if first else 0)
    return _predicted(rows, cells, [partial(_linear, fitted[j], count[j] > 0) for j in range(len(cells))])


def _terms(part: pd.DataFrame, order: int) -> np.ndarray:
    return np.stack([np.stack(part[f"t{k}"]) for k in range(order + 1)], 1)


def _filtered_proba(model: Cheb, order: int, x: np.ndarray) -> np.ndarray:
    return model.forward(x.reshape(len(x), order + 1, -1))


def cheb_expert(terms: DataFrame, nodes: DataFrame, splits: DataFrame, order: int, n_classes: int, kind: str = "low", epochs: int = 200) -> DataFrame:
    """(split, seed, node_id, pred, proba) of all nodes but the training ones, from Chebyshev terms (node_id, t0, ...).

    Trained for all (split, seed) side by side, an epoch being a pass over the rows.
    """
    whole = terms.select("node_id", F.concat(*[f"t{k}" for k in range(order + 1)]).alias("x")).join(nodes.select("node_id", "y"), "node_id")
    rows, cells = _by_model(whole, splits)
    rows = staged(rows, "rows")
    first = rows.select(F.size("x").alias("n")).first()
    models = [Cheb(order, (first["n"] if first else 0) // (order + 1), n_classes, kind, seed=seed) for _, seed in cells]
    total = np.maximum(fitting.class_counts(rows, len(cells), n_classes).sum(1), 1)
    size = sum(p.size for p in models[0].p) if models else 0

    def sums(b: dict[str, np.ndarray]) -> np.ndarray:
        out, one = np.zeros((len(models), size)), np.eye(n_classes)[b["y"].astype(int)]
        for j, model in enumerate(models):
            if len(at := np.flatnonzero(b["use"][:, j])):
                error = (_filtered_proba(model, order, b["x"][at]) - one[at]) / total[j]
                out[j] = np.concatenate([g.reshape(-1) for g in model.gradients(error)])
        return out.reshape(-1)

    for _ in range(epochs):
        for model, found in zip(models, totals(rows.select("x", "y", "use"), sums, len(models) * size).reshape(len(models), -1), strict=True):
            ends = np.cumsum([p.size for p in model.p])[:-1]
            model.adam.step([g.reshape(p.shape) for g, p in zip(np.split(found, ends), model.p, strict=True)])
    return _predicted(rows, cells, [partial(_filtered_proba, model, order) for model in models])


def node_mixture(terms: DataFrame, graph: Graph, splits: DataFrame, order: int, n_classes: int, gate: str = "graph", epochs: int = 150, limit: int = MAX_NODES) -> DataFrame:
    """(split, seed, node_id, pred, proba, gates) of all nodes but the training ones. Groups of more than ``limit`` nodes are trained by rounds."""
    from graphloom.operators import learned_rounds

    rows = splits.join(terms, "node_id").join(with_neighbours(graph), "node_id")
    if _large(splits, limit):
        return learned_rounds.mixture(rows, order, n_classes, gate, epochs)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part, near, x = _group(part)
        train, t, y = (part["part"] == "train").to_numpy(), _terms(part, order), part["y"].to_numpy()
        made = NodeMixture(order, t.shape[2], n_classes, near, gate=gate, seed=int(part["seed"].iloc[0])).train(x, t, y, train, epochs)
        proba, gates = made.forward(x, t)
        test = part.loc[~train]
        return pd.DataFrame({"split": test["split"], "seed": test["seed"], "node_id": test["node_id"], "pred": proba[~train].argmax(1).astype(np.int32), "proba": list(proba[~train]), "gates": list(gates[~train])})

    return rows.groupBy("split", "seed").applyInPandas(fit, "split int, seed int, node_id long, pred int, proba array<double>, gates array<double>")


def gated_cells(predictions: DataFrame, gates: DataFrame, nodes: DataFrame, n_classes: int) -> DataFrame:
    """(cond, split, seed, acc): accuracy of the experts' probabilities mixed by gates (cond, split, seed, node_id, gates)."""
    joined = predictions.select("split", "seed", "node_id", "expert", "proba").join(gates, ["split", "seed", "node_id"])
    weighted = joined.groupBy("cond", "split", "seed", "node_id").agg(*[F.sum(F.get("gates", F.col("expert")) * F.get("proba", c)).alias(f"p{c}") for c in range(n_classes)])
    mixed = weighted.select("cond", "split", "seed", "node_id", F.array(*[F.round(f"p{c}", 12) for c in range(n_classes)]).alias("mixed"))
    return mixed.join(nodes.select("node_id", "y"), "node_id").groupBy("cond", "split", "seed").agg(F.avg((argmax("mixed") == F.col("y")).cast("double")).alias("acc"))


def interventions(gates: DataFrame, oracle: DataFrame, strata: DataFrame, permutations: int = 3, channels: int = 3) -> DataFrame:
    """(cond, split, seed, node_id, gates): learned gates, frozen, and what takes their place.

    oracle (``oracle``: node_id, gates), equal, global_mean of each (split, seed), and, ``permutations`` times each, the
    learned gates dealt anew among all nodes (node_shuffled_i) or among those of one stratum (``strata``: node_id,
    stratum; within_i).
    """
    base = gates.select("split", "seed", "node_id", "gates")
    means = base.groupBy("split", "seed").agg(F.array(*[F.avg(F.get("gates", k)) for k in range(channels)]).alias("gates"))
    named = [
        base.select(F.lit("learned").alias("cond"), "*"),
        base.drop("gates").join(oracle.select("node_id", "gates"), "node_id").select(F.lit("oracle").alias("cond"), "split", "seed", "node_id", "gates"),
        base.select(F.lit("equal").alias("cond"), "split", "seed", "node_id", F.array_repeat(F.lit(1.0 / channels), channels).alias("gates")),
        base.drop("gates").join(means, ["split", "seed"]).select(F.lit("global_mean").alias("cond"), "split", "seed", "node_id", "gates"),
    ]
    placed = base.join(strata.select("node_id", "stratum"), "node_id")
    for kind, group in (("node_shuffled", F.concat_ws("|", "split", "seed")), ("within", F.concat_ws("|", "split", "seed", "stratum"))):
        spread = placed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn("_of", F.concat_ws("|", F.col("i"), group))
        seats = grouped_rank(spread.select("i", "split", "seed", "node_id", "_of"), "_of", F.asc("node_id"), name="_n")
        dealt = grouped_rank(spread.select("_of", "gates", "node_id", uniform(F.lit(kind), "i", "split", "seed", "node_id").alias("_u")), "_of", F.asc("_u"), F.asc("node_id"), name="_n").select("_of", "_n", "gates")
        named.append(seats.join(dealt, ["_of", "_n"]).select(F.concat(F.lit(f"{kind}_"), "i").alias("cond"), "split", "seed", "node_id", "gates"))
    out = named[0]
    for part in named[1:]:
        out = out.unionByName(part)
    return out


def selective(cells_router: DataFrame, cells_test: DataFrame, routed: str, single: str, margin: float = 0.01) -> DataFrame:
    """(split, seed, gain, routes, acc): routing where it gained more than ``margin`` on the rows kept for the router, else the single expert."""
    pick = lambda cells, cond, name: cells.where(F.col("cond") == cond).select("split", "seed", F.col("acc").alias(name))
    gain = pick(cells_router, routed, "a").join(pick(cells_router, single, "b"), ["split", "seed"]).select("split", "seed", (F.col("a") - F.col("b")).alias("gain"))
    test = pick(cells_test, routed, "acc_routed").join(pick(cells_test, single, "acc_single"), ["split", "seed"])
    routes = F.col("gain") > margin
    return gain.join(test, ["split", "seed"]).select("split", "seed", "gain", routes.alias("routes"), F.when(routes, F.col("acc_routed")).otherwise(F.col("acc_single")).alias("acc"))


def saturation(predictions: DataFrame, nodes: DataFrame, low: float = 0.3, high: float = 0.98) -> DataFrame:
    """(split, seed, acc, saturated): whether a single expert's accuracy leaves no room for routing, or has nothing to route."""
    cells = predictions.join(nodes.select("node_id", "y"), "node_id").groupBy("split", "seed").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("acc"))
    return cells.withColumn("saturated", (F.col("acc") <= low) | (F.col("acc") >= high))
