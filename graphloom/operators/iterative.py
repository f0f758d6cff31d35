"""Solvers on the Laplacian of a graph of any size, for blocks of vectors at once.

A block is a table of one row for each node, with an array for each vector
block. A round is one map over the rows (numpy on Arrow batches), one product
with the weights (a join with the edges and a sum, combined before its shuffle),
written to the shared folder, and one pass of sums. Only matrices of the
block's width meet on the driver: no round's cost or memory on one machine
depends on the number of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import Graph
from graphloom.storage import discard, staged

#: Columns of a block that one aggregation sums; wider blocks take several.
WIDE = 64


def signs(width: int, seed: int, *keys: str) -> Column:
    """An array of ``width`` signs (1 or -1) that depend on the seed and the keys only."""
    words = [F.xxhash64(*[F.col(k) for k in keys], F.lit(seed), F.lit(i)) for i in range(-(-width // 64))]
    return F.array(*[(1 - 2 * F.shiftright(words[i // 64], i % 64).bitwiseAND(F.lit(1))).cast("double") for i in range(width)])


def with_neighbours(state: DataFrame, both: DataFrame, name: str, width: int) -> DataFrame:
    """``state`` with ``near``, the weighted sum of the neighbours' blocks ``name``; ``both`` has each edge in both directions.

    Blocks are never broadcast: a plan's estimate takes arrays to have one number, so that the driver would gather blocks of any size.
    """
    parts = []
    for at in range(0, width, WIDE):
        sent = state.select(F.col("node_id").alias("dst"), F.slice(name, at + 1, WIDE).alias("x"))
        sums = [F.sum(F.get("x", i) * F.col("w")) for i in range(min(WIDE, width - at))]
        parts.append(both.join(sent.hint("merge"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.array(*sums).alias(f"near{at}")))
    for part in parts:
        state = state.join(part.hint("merge"), "node_id", "left")
    whole = [F.coalesce(f"near{at}", F.array_repeat(F.lit(0.0), min(WIDE, width - at))) for at in range(0, width, WIDE)]
    return state.withColumn("near", F.concat(*whole)).drop(*[f"near{at}" for at in range(0, width, WIDE)])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A column of arrays of numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _arrays(batch: pa.RecordBatch, kept: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """The columns of a batch: numbers as they are, arrays as matrices, and the blocks ``kept`` that column ``kept`` holds as bytes."""
    out, rows = {}, len(batch)
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if name == "kept":
            _, ends, data = column.buffers()
            at = np.frombuffer(ends, np.int32)[column.offset : column.offset + rows + 1]
            whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.float64).reshape(rows, len(kept), -1)
            out |= {block: whole[:, i] for i, block in enumerate(kept)}
        else:
            out[name] = _matrix(column, rows) if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False)
    return out


def mapped(df: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], before: tuple[str, ...], kept: tuple[str, ...], sent: str) -> DataFrame:
    """(node_id, d, kept, sent): what ``kernel`` makes of the rows, batch by batch. Block ``sent`` is an array, as it is summed in
    Spark; the blocks ``kept``, of its width, are bytes, as ``before`` were in ``df``."""
    schema = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("kept", T.BinaryType()), T.StructField(sent, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            made, rows = kernel(_arrays(batch, before)), len(batch)
            flat = np.ascontiguousarray(np.stack([made[b] for b in kept], axis=1), np.float64).reshape(rows, -1)
            ends = np.arange(rows + 1, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends * flat.shape[1] * 8), pa.py_buffer(flat.reshape(-1))])
            array = pa.ListArray.from_arrays(ends * made[sent].shape[1], pa.array(made[sent].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), batch.column("d"), packed, array], schema.names)

    return df.mapInArrow(run, schema)


def totals(df: DataFrame, kernel: Callable[[dict[str, np.ndarray]], np.ndarray], cells: int, kept: tuple[str, ...] = ()) -> np.ndarray:
    """The sum over all batches of what ``kernel`` gives for each, an array of ``cells`` numbers; ``kept`` as in ``mapped``.

    Each task sums its own, fewer tasks sum theirs, and the driver sums what is left: about the square root of the tasks.
    """
    schema = T.StructType([T.StructField("sums", T.BinaryType())])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(cells)
        for batch in batches:
            if len(batch):
                whole += kernel(_arrays(batch, kept))
        yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], schema.names)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(cells)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                whole += np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], schema.names)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.mapInArrow(one, schema).repartition(max(1, int(tasks**0.5))).mapInArrow(all_of, schema).collect()
    return np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0) if rows else np.zeros(cells)


class Laplacian:
    """A graph's written edges and weighted degrees, for many products."""

    def __init__(self, graph: Graph) -> None:
        ways = F.explode(F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
        tasks = int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # also where adaptive execution would take fewer: each edge is work in every round
        self.both = staged(graph.edges.select(ways.alias("e")).select("e.*").repartition(tasks, "dst"), "both")
        found = self.both.groupBy(F.col("src").alias("node_id")).agg(F.sum("w").alias("d"))
        self.nodes = staged(graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("d", F.lit(0.0)).alias("d")), "degrees")
        self.n, self.most = self.nodes.agg(F.count("*"), F.coalesce(F.max("d"), F.lit(0.0))).first()

    def next(self, state: DataFrame, sent: str, width: int, before: DataFrame | None = None) -> DataFrame:
        """``state`` with the neighbours' sums of block ``sent``, written; the table of the round before goes."""
        now = staged(with_neighbours(state, self.both, sent, width), "block")
        if before is not None:
            discard(before)
        return now


def _ritz(gram: np.ndarray, form: np.ndarray, k: int, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k extreme values of the form over the space that the Gram matrix's vectors span, and their coefficients."""
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    gram, form = gram / np.outer(size, size), form / np.outer(size, size)
    v, u = np.linalg.eigh((gram + gram.T) / 2)
    keep = v > 1e-10 * max(v[-1], 1e-300)
    basis = u[:, keep] / np.sqrt(v[keep])
    values, turned = np.linalg.eigh(basis.T @ ((form + form.T) / 2) @ basis)
    chosen = np.argsort(-values if largest else values, kind="stable")[:k]
    return values[chosen], (basis @ turned[:, chosen]) / size[:, None]


def extreme_modes(graph: Graph, k: int, largest: bool = False, guard: int = 8, tolerance: float = 1e-7, rounds: int = 300, seed: int = 0) -> tuple[DataFrame, list[float], list[float]]:
    """((node_id, v) with a node's entries of k modes, their eigenvalues, their residuals): the Laplacian's smallest or largest modes.

    The constant mode of eigenvalue 0 is left out. By locally optimal block gradients, with the degrees as preconditioner for the smallest:
    each round looks for the best vectors in the space of the block, its scaled residuals and its last step. ``guard`` vectors more
    than asked for run along. It ends when all residuals are below ``tolerance`` times twice the largest degree, or after
    ``rounds``; residuals say which. Modes of equal eigenvalues are any basis of theirs. With fewer nodes there are fewer modes.
    """
    lap = Laplacian(graph)
    k = max(0, min(k, lap.n - 1))
    if not k:
        return lap.nodes.select("node_id", F.array().cast("array<double>").alias("v")), [], []
    width, n = min(k + guard, lap.n - 1), lap.n
    bar = tolerance * 2 * max(lap.most, 1e-300)
    values = np.zeros(0)

    def space(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        moved = x["d"][:, None] * x["w"] - x["near"]
        return np.hstack([x[b] for b in ("x", "w", "p") if b in x]), np.hstack([x["lx"], moved, x["lp"]] if "lx" in x else [moved])

    def sums(values: np.ndarray) -> Callable[[dict[str, np.ndarray]], np.ndarray]:
        def kernel(x: dict[str, np.ndarray]) -> np.ndarray:
            s, ls = space(x)
            off = x["lx"] - x["x"] * values if "lx" in x else np.zeros((1, 0))
            return np.concatenate([(s.T @ s).reshape(-1), (s.T @ ls).reshape(-1), s.sum(0), (off * off).sum(0)])

        return kernel

    state = lap.nodes.select("*", signs(width, seed, "node_id").alias("w"))
    now, dims, held, blocks = lap.next(state, "w", width), width, (), ("x", "lx", "p", "lp")
    for turn in range(rounds + 1):
        found = totals(now, sums(values), 2 * dims * dims + dims + len(values), held)
        residuals = np.sqrt(found[2 * dims * dims + dims :])
        if len(values) and ((residuals[:k] <= bar).all() or turn == rounds):
            break
        s = found[2 * dims * dims :][:dims]
        gram = found[: dims * dims].reshape(dims, dims) - np.outer(s, s) / n  # of the vectors less their means
        values, mixed = _ritz(gram, found[dims * dims :][: dims * dims].reshape(dims, dims), width, largest)
        step = mixed.copy()
        step[: width if dims > width else 0] = 0
        shift, step_shift = s @ mixed / n, s @ step / n

        def move(x: dict[str, np.ndarray], mixed=mixed, step=step, shift=shift, step_shift=step_shift, values=values) -> dict[str, np.ndarray]:
            s, ls = space(x)
            best, moved = s @ mixed - shift, ls @ mixed
            away = moved - best * values
            if not largest:
                away = away / np.where(x["d"] > 0, x["d"], 1.0)[:, None]
            return {"x": best, "lx": moved, "p": s @ step - step_shift, "lp": ls @ step, "w": away}

        now, dims, held = lap.next(mapped(now, move, held, blocks, "w"), "w", width, now), 3 * width, blocks
    return _unpacked(now, held, "x", k, "v"), values[:k].tolist(), residuals[:k].tolist()


def _unpacked(now: DataFrame, kept: tuple[str, ...], block: str, width: int, name: str) -> DataFrame:
    """(node_id, name): the first ``width`` columns of one of the blocks ``kept``, as arrays."""
    schema = T.StructType([T.StructField("node_id", T.LongType()), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.ascontiguousarray(_arrays(batch, kept)[block][:, :width])
                yield pa.RecordBatch.from_arrays([batch.column("node_id"), pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * width, pa.array(x.reshape(-1)))], schema.names)

    return now.select("node_id", "kept").mapInArrow(run, schema)


def solve(graph: Graph, right: DataFrame, width: int, tolerance: float = 1e-6, rounds: int = 500) -> DataFrame:
    """(node_id, x): solutions of L x = b for the ``width`` vectors of ``right`` (node_id, b), which sum to 0 on every component.

    By conjugate gradients with the degrees as preconditioner, one pass of sums a round for all vectors together,
    until each residual is below ``tolerance`` of its right side. A solution is right up to a constant on each component.
    """
    lap = Laplacian(graph)

    def scaled(r: np.ndarray, d: np.ndarray) -> np.ndarray:
        return r / np.where(d > 0, d, 1.0)[:, None]

    def begin(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        zero = np.zeros_like(x["b"])
        return {"x": zero, "r": x["b"], "p": zero, "s": zero, "u": scaled(x["b"], x["d"])}

    def sums(x: dict[str, np.ndarray]) -> np.ndarray:
        r, u = x["r"], x["u"]
        return np.concatenate([(r * u).sum(0), (u * (x["d"][:, None] * u - x["near"])).sum(0), (r * r).sum(0)])

    given = lap.nodes.join(right.hint("merge"), "node_id", "left").select("node_id", "d", F.coalesce("b", F.array_repeat(F.lit(0.0), width)).alias("b"))
    blocks = ("x", "r", "p", "s")
    now = lap.next(mapped(given, begin, (), blocks, "u"), "u", width)
    first = gamma = alpha = None
    for turn in range(rounds + 1):
        ru, uu, rr = totals(now, sums, 3 * width, blocks).reshape(3, width)
        first = rr if first is None else first
        if turn == rounds or (rr <= tolerance**2 * first).all():
            break
        beta = np.zeros(width) if gamma is None else np.where(gamma > 0, ru / np.where(gamma > 0, gamma, 1), 0)
        below = uu if gamma is None else uu - beta * ru / np.where(alpha != 0, alpha, 1)
        open_ = (rr > tolerance**2 * first) & (below > 0)  # a vector that is done moves no more
        alpha, gamma = np.where(open_, ru / np.where(below > 0, below, 1), 0.0), ru

        def move(x: dict[str, np.ndarray], alpha=alpha, beta=beta) -> dict[str, np.ndarray]:
            p = x["u"] + beta * x["p"]
            s = x["d"][:, None] * x["u"] - x["near"] + beta * x["s"]
            r = x["r"] - alpha * s
            return {"x": x["x"] + alpha * p, "r": r, "p": p, "s": s, "u": scaled(r, x["d"])}

        now = lap.next(mapped(now, move, blocks, blocks, "u"), "u", width, now)
    return _unpacked(now, blocks, "x", width, "x")


def projected(graph: Graph, width: int, seed: int) -> DataFrame:
    """(node_id, b): the edges' root weights over ``width`` with random signs, added at their lower ends and taken off at their upper ones.

    Edges meet at their ends before their signs are made: a node's sums never leave its task.
    """
    tasks = int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # also where adaptive execution would take fewer: a short row is work for many signs
    ways = F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(1.0).alias("to")), F.struct(F.col("dst").alias("node_id"), F.lit(-1.0).alias("to"))))
    ends = graph.edges.select("src", "dst", "w", ways.alias("e")).select("e.*", "src", "dst", "w").repartition(tasks, "node_id")
    flow = ends.select("node_id", "to", F.transform(signs(width, seed, "src", "dst"), lambda s: s * F.sqrt(F.col("w") / width)).alias("q"))
    parts = [F.sum(F.get("q", i) * F.col("to")) for i in range(width)]
    right = flow.groupBy("node_id").agg(*[F.array(*parts[i : i + WIDE]).alias(f"b{i}") for i in range(0, width, WIDE)])
    return right.select("node_id", F.concat(*[f"b{i}" for i in range(0, width, WIDE)]).alias("b"))


def sketched_resistance(graph: Graph, width: int = 64, tolerance: float = 1e-2, seed: int = 0) -> DataFrame:
    """(src, dst, w, r): effective resistances by a random projection onto ``width`` dimensions (Spielman and Srivastava, 2008).

    The edges' root weights with random signs, summed at their ends, are the right sides of ``width`` Laplacian systems; a
    resistance is the squared distance of two ends' solutions. Its standard error is about sqrt(2 / width) of it, far above that of
    the systems at the default ``tolerance``; that of the weighted sum over all edges is smaller, as errors of different edges cancel.
    """
    place = solve(graph, projected(graph, width, seed), width, tolerance)
    a, b = place.select(F.col("node_id").alias("src"), F.col("x").alias("xs")), place.select(F.col("node_id").alias("dst"), F.col("x").alias("xd"))
    apart = F.aggregate(F.zip_with("xs", "xd", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return staged(graph.edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select("src", "dst", "w", apart.alias("r")), "resistances")


def quadrature(graph: Graph, probes: int = 32, steps: int = 24, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, weights): few points that stand for the Laplacian's whole spectrum; the weights sum to the number of nodes.

    By stochastic Lanczos quadrature: from each of ``probes`` vectors of random signs, ``steps`` products give a small
    tridiagonal matrix, whose eigenvalues and first entries are the points. Weighted sums of smooth functions of the eigenvalues,
    such as their powers, are right up to about 1 / sqrt(nodes x probes); ends of the spectrum are found exactly first.
    """
    lap = Laplacian(graph)
    n = lap.n
    if not n:
        return np.zeros(0), np.zeros(0)
    steps = min(steps, n)

    def sums(x: dict[str, np.ndarray]) -> np.ndarray:
        moved = x["d"][:, None] * x["v"] - x["near"]
        return np.concatenate([(x["v"] * moved).sum(0), (moved * moved).sum(0)])

    state = lap.nodes.select("*", F.transform(signs(probes, seed, "node_id"), lambda s: s / F.lit(float(np.sqrt(n)))).alias("v"))
    now, held, alphas, betas, beta = lap.next(state, "v", probes), (), [], [], np.zeros(probes)
    for turn in range(steps):
        alpha, square = totals(now, sums, 2 * probes, held).reshape(2, probes)
        alphas.append(alpha)
        after = np.sqrt(np.maximum(square - alpha * alpha - beta * beta, 0.0))
        after[after < 1e-7 * max(lap.most, 1e-300)] = 0.0  # this probe's space is exhausted
        betas.append(after)
        if turn + 1 == steps or not after.any():
            break

        def move(x: dict[str, np.ndarray], alpha=alpha, beta=beta, after=after) -> dict[str, np.ndarray]:
            on = (x["d"][:, None] - alpha) * x["v"] - x["near"] - (beta * x["u"] if "u" in x else 0.0)
            return {"v": np.where(after > 0, on / np.where(after > 0, after, 1), 0.0), "u": x["v"]}

        now, held, beta = lap.next(mapped(now, move, held, ("u",), "v"), "v", probes, now), ("u",), after
    discard(now)
    points, weights = [], []
    for j in range(probes):
        a, b = np.array([x[j] for x in alphas]), np.array([x[j] for x in betas])
        m = int(np.argmax(b == 0)) + 1 if (b == 0).any() else len(a)
        values, vectors = np.linalg.eigh(np.diag(a[:m]) + np.diag(b[: m - 1], 1) + np.diag(b[: m - 1], -1))
        points.append(np.maximum(values, 0.0))
        weights.append(vectors[0] ** 2 * n / probes)
    order = np.argsort(np.concatenate(points), kind="stable")
    return np.concatenate(points)[order], np.concatenate(weights)[order]
