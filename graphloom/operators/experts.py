"""Experts on routed nodes, and the mixtures' accuracies.

Experts of all (split, seed) are fitted side by side, by passes over the nodes.
A condition is then a join of its channels with the experts' predictions: any
number of routings costs no further fit.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import fitting
from graphloom.storage import staged

MIN_ROWS = 10


class Logistic:
    """Multinomial logistic regression with an L2 penalty (C = 1), by Newton steps; one class gives that class always."""

    def __init__(self, n_classes: int, c: float = 1.0, steps: int = 25) -> None:
        self.n_classes, self.c, self.steps = n_classes, c, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        """Rows weigh 1, or as ``weight`` says."""
        each = np.ones(len(x)) if weight is None else weight
        self.classes = np.unique(y)
        if len(self.classes) < 2:
            return self
        one = (y[:, None] == self.classes[None, :]).astype(float)
        xb = np.hstack([x, np.ones((len(x), 1))])
        penalty = np.append(np.full(x.shape[1], 1.0 / self.c), 1e-8)
        d, m = xb.shape[1], len(self.classes)
        self.w = np.zeros((d, m))
        for _ in range(self.steps):
            p = self._proba(xb)
            gradient = xb.T @ ((p - one) * each[:, None]) + penalty[:, None] * self.w
            if np.abs(gradient).max() < 1e-8:
                break
            hessian = np.zeros((d * m, d * m))
            for i in range(m):
                for j in range(i, m):
                    curve = each * p[:, i] * ((i == j) - p[:, j])
                    block = (xb * curve[:, None]).T @ xb
                    hessian[i * d : (i + 1) * d, j * d : (j + 1) * d] = hessian[j * d : (j + 1) * d, i * d : (i + 1) * d] = block
            hessian[np.diag_indices(d * m)] += np.tile(penalty, m) + 1e-9
            self.w -= np.linalg.solve(hessian, gradient.T.reshape(-1)).reshape(m, d).T
        return self

    def _proba(self, xb: np.ndarray) -> np.ndarray:
        z = xb @ self.w
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.n_classes))
        out[:, self.classes] = 1.0 if len(self.classes) < 2 else self._proba(np.hstack([x, np.ones((len(x), 1))]))
        return out


class Mlp:
    """One hidden layer of ReLU units, trained by Adam on all rows; deterministic by seed."""

    def __init__(self, n_classes: int, width: int = 64, alpha: float = 1e-3, epochs: int = 200, rate: float = 1e-2, seed: int = 0) -> None:
        self.n_classes, self.width, self.alpha, self.epochs, self.rate, self.seed = n_classes, width, alpha, epochs, rate, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Mlp:
        rng = np.random.default_rng(self.seed)
        sizes = [x.shape[1], self.width, self.n_classes]
        self.p = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)] + [np.zeros(b) for b in sizes[1:]]
        one, moments = np.eye(self.n_classes)[y], [(np.zeros_like(p), np.zeros_like(p)) for p in self.p]
        for t in range(1, self.epochs + 1):
            hidden = np.maximum(x @ self.p[0] + self.p[2], 0)
            error = (self._softmax(hidden @ self.p[1] + self.p[3]) - one) / len(x)
            back = (error @ self.p[1].T) * (hidden > 0)
            grads = [x.T @ back + self.alpha * self.p[0] / len(x), hidden.T @ error + self.alpha * self.p[1] / len(x), back.sum(0), error.sum(0)]
            for i, g in enumerate(grads):
                m, v = 0.9 * moments[i][0] + 0.1 * g, 0.999 * moments[i][1] + 0.001 * g * g
                moments[i] = (m, v)
                self.p[i] -= self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(x @ self.p[0] + self.p[2], 0) @ self.p[1] + self.p[3])


#: Widths of the networks' hidden layers by head; ``dendrites`` gives each expert another one.
WIDTHS = {"mlp": [64], "mlp_wide": [128], "dendrites": [16, 64, 128]}


def fit_pool(nodes: DataFrame, splits: DataFrame, pool: DataFrame, n_classes: int, n_channels: int = 3, head: str = "logistic") -> DataFrame:
    """(split, seed, expert, node_id, pred, proba) of every expert on every node that it was not trained on.

    ``splits`` has (split, seed, node_id, part), ``pool`` (node_id, gates). An expert trains on nodes whose gate is 0.01
    at least; with fewer than ``MIN_ROWS`` of them on all, so that no expert is missing. All experts of all (split, seed),
    of which a protocol has few, are fitted side by side by passes over the nodes, wherever they are (``fitting``).
    Heads: logistic, or a network of ``WIDTHS``. An expert that has seen one class only always says that class.
    """
    cells = [(r["split"], r["seed"]) for r in splits.select("split", "seed").distinct().orderBy("split", "seed").collect()]
    models = [(split, seed, k) for split, seed in cells for k in range(n_channels)]
    part = lambda name, cell: F.max(((F.col("part") == name) & (F.col("split") == cell[0]) & (F.col("seed") == cell[1])).cast("int"))
    other = lambda cell: F.max(((F.col("part") != "train") & (F.col("split") == cell[0]) & (F.col("seed") == cell[1])).cast("int"))
    parts = splits.groupBy("node_id").agg(F.array(*[part("train", c) for c in cells]).alias("train"), F.array(*[other(c) for c in cells]).alias("other"))
    rows = nodes.select("node_id", "x", "y").join(parts, "node_id").join(pool.select("node_id", "gates"), "node_id")
    train = [F.get("train", cells.index(m[:2])).cast("double") for m in models]
    routed = [t * (F.get("gates", m[2]) >= 0.01).cast("double") for t, m in zip(train, models, strict=True)]
    rows = staged(rows.select("node_id", "x", "y", F.array(*routed).alias("routed"), F.array(*train).alias("train"), F.array(*[F.get("other", cells.index(m[:2])).cast("double") for m in models]).alias("test")), "rows")
    few = fitting.class_counts(rows.select("y", F.col("routed").alias("use")), len(models), n_classes).sum(1) < MIN_ROWS
    used = F.array(*[F.get("train" if small else "routed", j) for j, small in enumerate(few.tolist())])
    rows = staged(rows.select("node_id", "x", "y", used.alias("use"), "test"), "rows")
    counts = fitting.class_counts(rows, len(models), n_classes)
    first = rows.select(F.size("x").alias("n")).first()
    width = first["n"] if first else 0
    if head == "logistic":
        weights = fitting.fit_logistic(rows, counts > 0, width)
        made = [partial(_linear, weights[j], counts[j] > 0) for j in range(len(models))]
    else:
        hidden = [WIDTHS[head][m[2] % len(WIDTHS[head])] for m in models]
        made = [partial(_network, p) for p in fitting.fit_mlp(rows, counts, width, hidden, [m[1] for m in models])]
    return fitting.predicted(rows, models, made)


def _linear(w: np.ndarray, seen: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not seen.any():
        return np.full((len(x), len(seen)), 1.0 / len(seen))
    return fitting.softmax(np.where(seen, x @ w[:-1] + w[-1], -np.inf))


def _network(p: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return fitting.softmax(np.maximum(x @ p[0] + p[2], 0) @ p[1] + p[3])


def mixture_cells(predictions: DataFrame, nodes: DataFrame, conditions: DataFrame) -> DataFrame:
    """(cond, split, seed, acc): each condition's (cond, node_id, channel) accuracy with the expert of each node's channel."""
    routed = predictions.join(conditions.withColumnRenamed("channel", "expert"), ["node_id", "expert"]).join(nodes.select("node_id", "y"), "node_id")
    return routed.groupBy("cond", "split", "seed").agg(F.avg((F.col("pred") == F.col("y")).cast("double")).alias("acc"))


def soft_vote(predictions: DataFrame, nodes: DataFrame, n_classes: int) -> DataFrame:
    """(split, seed, acc) of the mean of all experts' probabilities."""
    from graphloom.functions.vectors import argmax, vector_sum

    voted = predictions.groupBy("split", "seed", "node_id").agg(vector_sum("proba", n_classes).alias("votes")).join(nodes.select("node_id", "y"), "node_id")
    return voted.groupBy("split", "seed").agg(F.avg((argmax("votes") == F.col("y")).cast("double")).alias("acc"))


def router_targets(predictions: DataFrame, nodes: DataFrame, n_channels: int = 3) -> DataFrame:
    """(split, seed, node_id, target): equal mass on the experts that are right, on all if none is."""
    right = predictions.join(nodes.select("node_id", "y"), "node_id").groupBy("split", "seed", "node_id").agg(*[F.max(F.when(F.col("expert") == k, (F.col("pred") == F.col("y")).cast("double"))).alias(f"r{k}") for k in range(n_channels)])
    total = sum((F.col(f"r{k}") for k in range(n_channels)), F.lit(0.0))
    return right.select("split", "seed", "node_id", F.array(*[F.when(total > 0, F.col(f"r{k}") / total).otherwise(1.0 / n_channels) for k in range(n_channels)]).alias("target"))


def kmeans_gates(features: DataFrame, order: str, k: int = 3, tries: int = 10, seed: int = 0, scaled: bool = True) -> DataFrame:
    """(node_id, gates): k-means on the fields (node_id, x), standardised or as they are, clusters named by falling mean of field ``order``; best of ``tries``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    features = staged(features, "fields")
    first = features.select(F.size("x").alias("n")).first()
    if first is None:
        return features.select("node_id", F.array(*[F.lit(0.0)] * k).alias("gates"))
    width = first["n"]
    moments = features.agg(*[f(F.get("x", i)).alias(f"{n}{i}") for i in range(width) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    field = lambda i: (F.get("x", i) - F.col(f"m{i}")) / (F.col(f"s{i}") + 1e-8) if scaled else F.get("x", i)
    scaled_rows = features.join(F.broadcast(moments)).select("node_id", "x", array_to_vector(F.array(*[field(i) for i in range(width)])).alias("features"))  # one row is broadcast
    fitted = [KMeans(k=k, seed=seed + i, maxIter=50).fit(scaled_rows) for i in range(tries)]
    best = min(fitted, key=lambda m: m.summary.trainingCost)
    named = best.transform(scaled_rows)
    means = sorted(named.groupBy("prediction").agg(F.avg(F.get("x", int(order))).alias("m")).collect(), key=lambda r: -r["m"])
    place = {r["prediction"]: i for i, r in enumerate(means)}
    channel = F.element_at(F.create_map(*[F.lit(v) for pair in place.items() for v in pair]), F.col("prediction"))
    return named.select("node_id", F.array(*[(channel == i).cast("double") for i in range(k)]).alias("gates"))
