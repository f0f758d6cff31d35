"""Fits of many small models at once over rows of any number: each pass sums all models' losses and gradients where the rows are.

Only parameters, losses and gradients are on the driver: their size is that of the models, not of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.operators.iterative import totals

Evaluate = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def lbfgs(evaluate: Evaluate, start: np.ndarray, tolerance: float = 1e-6, passes: int = 400, memory: int = 10) -> np.ndarray:
    """Minima of several smooth functions side by side: ``evaluate`` gives the losses and gradients (a row each) at a row of points each.

    Each function has its own history and step. One whose step lowers its loss enough goes on in the next pass, another one
    halves its step, so that none waits for others. A function is done when no entry of its gradient is above ``tolerance``.
    """
    x = start.copy()
    loss, slope = evaluate(x)
    many = len(x)
    history: list[list[tuple[np.ndarray, np.ndarray, float]]] = [[] for _ in range(many)]
    way, step = -slope, 1.0 / np.maximum(np.abs(slope).sum(1), 1.0)
    open_ = np.abs(slope).max(1, initial=0.0) > tolerance
    for _ in range(passes):
        if not open_.any():
            break
        tried = np.where(open_[:, None], x + step[:, None] * way, x)
        found, found_slope = evaluate(tried)
        for j in np.flatnonzero(open_).tolist():
            if not found[j] <= loss[j] + 1e-4 * step[j] * (slope[j] @ way[j]) + 1e-13 * abs(loss[j]):
                step[j] /= 2
                open_[j] = step[j] > 1e-12
                continue
            s, y = tried[j] - x[j], found_slope[j] - slope[j]
            if s @ y > 1e-12 * (y @ y):
                history[j] = [*history[j][1 - memory :], (s, y, 1.0 / (s @ y))]
            x[j], loss[j], slope[j] = tried[j], found[j], found_slope[j]
            open_[j] = np.abs(slope[j]).max() > tolerance
            q, parts = slope[j].copy(), []
            for s, y, inverse in reversed(history[j]):
                parts.append(inverse * (s @ q))
                q -= parts[-1] * y
            if history[j]:
                s, y, inverse = history[j][-1]
                q /= inverse * (y @ y)
            for (s, y, inverse), a in zip(history[j], reversed(parts), strict=True):
                q += (a - inverse * (y @ q)) * s
            way[j], step[j] = (-q, 1.0) if slope[j] @ q > 0 else (-slope[j], 1.0 / max(np.abs(slope[j]).sum(), 1.0))
    return x


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def class_counts(rows: DataFrame, models: int, n_classes: int) -> np.ndarray:
    """How many rows of each class each model is fitted on; ``rows`` have y and use, an array of 1 for each model that a row belongs to."""

    def count(b: dict[str, np.ndarray]) -> np.ndarray:
        return (b["use"].T @ np.eye(n_classes)[b["y"].astype(int)]).reshape(-1)

    return totals(rows.select("use", "y"), count, models * n_classes).reshape(models, n_classes)


def _logits(x: np.ndarray, w: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Of all classes; those that a model has not seen cannot be chosen."""
    return np.where(seen, x @ w[:-1] + w[-1], -np.inf)


def fit_logistic(rows: DataFrame, seen: np.ndarray, width: int, c: float = 1.0, tolerance: float = 1e-6) -> np.ndarray:
    """Weights (models x (width + 1) x classes) of multinomial logistic regressions with an L2 penalty, the last row being intercepts.

    ``rows`` have x, y and use, what a row weighs in each model; ``seen`` says which classes each model has.
    """
    models, n_classes = seen.shape
    size = (width + 1) * n_classes
    penalty = np.append(np.full(width, 1.0 / c), 1e-8)[:, None]

    def evaluate(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = points.reshape(models, width + 1, n_classes)

        def sums(b: dict[str, np.ndarray]) -> np.ndarray:
            out, y = np.zeros((models, size + 1)), b["y"].astype(int)
            for j in range(models):
                at = np.flatnonzero(b["use"][:, j])
                if not len(at) or seen[j].sum() < 2:
                    continue
                x = b["x"][at]
                p = softmax(_logits(x, weights[j], seen[j]))
                each = b["use"][at, j]
                out[j, 0] = -(each * np.log(np.maximum(p[np.arange(len(at)), y[at]], 1e-300))).sum()
                p[np.arange(len(at)), y[at]] -= 1
                p *= each[:, None]
                out[j, 1:] = np.vstack([x.T @ p, p.sum(0)]).reshape(-1)
            return out.reshape(-1)

        found = totals(rows.select("x", "y", "use"), sums, models * (size + 1)).reshape(models, size + 1)
        return found[:, 0] + 0.5 * (penalty * weights**2).sum((1, 2)), found[:, 1:] + (penalty * weights).reshape(models, size)

    return lbfgs(evaluate, np.zeros((models, size)), tolerance).reshape(models, width + 1, n_classes)


def fit_mlp(rows: DataFrame, counts: np.ndarray, inputs: int, hidden: list[int], seeds: list[int], alpha: float = 1e-3, epochs: int = 200, rate: float = 1e-2) -> list[list[np.ndarray]]:
    """Parameters of networks with one hidden layer of ReLU units each, by Adam on the mean gradient over all rows of a model.

    Each model has its own width and seed; ``counts`` has its rows by class. An epoch is one pass for all models.
    """
    n_classes, models = counts.shape[1], len(hidden)
    total = np.maximum(counts.sum(1), 1)
    params = []
    for width, seed in zip(hidden, seeds, strict=True):
        rng, sizes = np.random.default_rng(seed), [inputs, width, n_classes]
        params.append([rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)] + [np.zeros(b) for b in sizes[1:]])
    ends = np.cumsum([0] + [sum(p.size for p in model) for model in params])

    def gradients(params: list[list[np.ndarray]]) -> np.ndarray:
        def sums(b: dict[str, np.ndarray]) -> np.ndarray:
            out, y = np.zeros(ends[-1]), b["y"].astype(int)
            for j in range(models):
                at = np.flatnonzero(b["use"][:, j])
                if not len(at):
                    continue
                x, (first, second, shift, last) = b["x"][at], params[j]
                inner = np.maximum(x @ first + shift, 0)
                error = (softmax(inner @ second + last) - np.eye(n_classes)[y[at]]) / total[j]
                back = (error @ second.T) * (inner > 0)
                out[ends[j] : ends[j + 1]] = np.concatenate([g.reshape(-1) for g in (x.T @ back, inner.T @ error, back.sum(0), error.sum(0))])
            return out

        return totals(rows.select("x", "y", "use"), sums, int(ends[-1]))

    moments = [np.zeros(ends[-1]), np.zeros(ends[-1])]
    for t in range(1, epochs + 1):
        g = gradients(params)
        decay = np.concatenate([np.concatenate([alpha / total[j] * p.reshape(-1) if i < 2 else np.zeros(p.size) for i, p in enumerate(model)]) for j, model in enumerate(params)])
        g = g + decay
        moments = [0.9 * moments[0] + 0.1 * g, 0.999 * moments[1] + 0.001 * g * g]
        move = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        at, after = 0, []
        for model in params:
            new = []
            for p in model:
                new.append(p - move[at : at + p.size].reshape(p.shape))
                at += p.size
            after.append(new)
        params = after
    return params


def predicted(rows: DataFrame, models: list[tuple[int, int, int]], probabilities: list[Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """(split, seed, expert, node_id, pred, proba) of every row (node_id, x, test) for each model whose test row it is; ``test`` is like use."""
    schema = T.StructType([T.StructField(n, T.IntegerType()) for n in ("split", "seed", "expert")] + [T.StructField("node_id", T.LongType()), T.StructField("pred", T.IntegerType()), T.StructField("proba", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, test = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for i in (1, 2))
            for j, names in enumerate(models):
                at = np.flatnonzero(test[:, j])
                if not len(at):
                    continue
                p = probabilities[j](x[at])
                ends = np.arange(len(at) + 1, dtype=np.int32) * p.shape[1]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(at), n, np.int32)) for n in names], batch.column(0).take(pa.array(at)), pa.array(p.argmax(1).astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(p.reshape(-1)))], schema.names)

    return rows.select("node_id", "x", "test").mapInArrow(run, schema)
