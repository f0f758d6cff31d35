"""Spectra, modes and resistances of graphs.

Components of up to ``EXACT_NODES`` nodes are solved by dense kernels, one task
each; larger ones by the solvers of ``iterative`` and ``resistance``, whose work
is spread over all tasks. What has a closed form is in ``identities``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, degrees, induced
from graphloom.operators.components import connected_components
from graphloom.operators.iterative import extreme_modes, quadrature, sketched_resistance
from graphloom.operators.resistance import exact_resistances
from graphloom.storage import staged

#: A dense matrix of a component has 8 bytes a cell: 32 MB at this size.
EXACT_NODES = 2000
EPS = 1e-8


@dataclass(frozen=True)
class Parts:
    """A graph by the size of its components: ``small`` has (component, src, dst, w), with a row of null ends for each lone node;
    ``names`` are the large components, of which there are fewer than nodes / ``limit``; ``named`` has every node's component."""

    graph: Graph
    small: DataFrame
    named: DataFrame
    names: list[int]

    def linked(self) -> DataFrame:
        """The edges of the small components."""
        return self.small.where("src IS NOT NULL")

    def lone(self) -> DataFrame:
        """(component): nodes without edges, which are named after themselves. There may be as many as nodes: what they give is known."""
        return self.small.where("src IS NULL").select("component")

    def large(self, name: int | None = None) -> Graph:
        """A large component, or all of them."""
        chosen = self.named.where(F.col("component").isin(self.names if name is None else [name]))
        return induced(self.graph, chosen)


def parted(graph: Graph, limit: int = EXACT_NODES) -> Parts:
    graph = Graph(graph.nodes, staged(graph.edges, "edges"))
    named = staged(connected_components(graph), "named")
    sizes = named.groupBy("component").agg(F.count("*").alias("n"))
    names = [r["component"] for r in sizes.where(F.col("n") > limit).select("component").collect()]
    few = named.join(sizes.where(F.col("n") <= limit), "component")
    edges = graph.edges.join(few.select(F.col("node_id").alias("src"), "component"), "src").select("component", "src", "dst", "w")
    alone = sizes.where((F.col("n") == 1) & (F.col("n") <= limit)).select("component", F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("w"))
    return Parts(graph, edges.union(alone), named, names)


def dense_laplacian(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A component's node ids, ascending, and its Laplacian."""
    ids = np.unique(np.concatenate([part["src"], part["dst"]])).astype(np.int64)
    a, b = np.searchsorted(ids, part["src"]), np.searchsorted(ids, part["dst"])
    out = np.zeros((len(ids), len(ids)))
    np.add.at(out, (a, b), -part["w"].to_numpy())
    np.add.at(out, (b, a), -part["w"].to_numpy())
    out[np.diag_indices(len(ids))] = -out.sum(1)
    return ids, out


def _dense_spectrum(parts: Parts) -> DataFrame:
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        _, lap = dense_laplacian(part)
        values = np.linalg.eigvalsh(lap)
        return pd.DataFrame({"component": part["component"].iloc[0], "idx": np.arange(len(values), dtype=np.int32), "eigenvalue": np.maximum(values, 0), "weight": 1.0})

    lone = parts.lone().select("component", F.lit(0).alias("idx"), F.lit(0.0).alias("eigenvalue"), F.lit(1.0).alias("weight"))
    return parts.linked().groupBy("component").applyInPandas(solve, "component long, idx int, eigenvalue double, weight double").union(lone)


def spectrum(graph: Graph, limit: int = EXACT_NODES, probes: int = 32, steps: int = 24) -> DataFrame:
    """(component, idx, eigenvalue, weight) of the Laplacian, ascending within each component.

    All eigenvalues of components of up to ``limit`` nodes, each of weight 1. A larger component has the points of a
    quadrature instead, whose weights sum to its number of nodes.
    """
    parts = parted(graph, limit)
    found = _dense_spectrum(parts)
    for name in parts.names:
        values, weights = quadrature(parts.large(name), probes, steps)
        rows = [(name, i, float(v), float(w)) for i, (v, w) in enumerate(zip(values, weights, strict=True))]
        found = found.union(graph.edges.sparkSession.createDataFrame(rows, found.schema))
    return found


def modes(graph: Graph, k: int, limit: int = EXACT_NODES) -> DataFrame:
    """(node_id, component, v): entries of the component's k eigenvectors after the constant one; the largest entry of each is positive.

    A component of fewer nodes has zeros in the places of modes that it lacks.
    """

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        ids, lap = dense_laplacian(part)
        vectors = np.linalg.eigh(lap)[1][:, 1 : k + 1]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        vectors = np.pad(vectors, ((0, 0), (0, k - vectors.shape[1])))
        return pd.DataFrame({"node_id": ids, "component": part["component"].iloc[0], "v": list(vectors)})

    parts = parted(graph, limit)
    lone = parts.lone().select(F.col("component").alias("node_id"), "component", F.array_repeat(F.lit(0.0), k).alias("v"))
    found = parts.linked().groupBy("component").applyInPandas(solve, "node_id long, component long, v array<double>").union(lone)
    for name in parts.names:
        vectors, values, _ = extreme_modes(parts.large(name), k)
        entry = [F.get("v", i) for i in range(len(values))]
        turned = vectors.agg(F.array(*[F.signum(F.max_by(e, F.struct(F.round(F.abs(e), 9), -F.col("node_id")))) for e in entry]).alias("turn"))
        right = vectors.join(F.broadcast(turned)).select("node_id", F.lit(name).cast("long").alias("component"), F.zip_with("v", "turn", lambda x, s: x * s).alias("v"))  # one row is broadcast
        found = found.union(right.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), k - len(values)))))
    return found


def _on_cycles(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which edges are left when nodes with one edge are taken off again and again: resistances of the others are 1 / w."""
    keep = np.ones(len(src), bool)
    _, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = ends[: len(src)], ends[len(src) :]
    while True:
        degree = np.bincount(np.concatenate([a[keep], b[keep]]), minlength=ends.max(initial=0) + 1)
        leaf = keep & ((degree[a] == 1) | (degree[b] == 1))
        if not leaf.any():
            return keep
        keep &= ~leaf


def resistances(graph: Graph, limit: int = EXACT_NODES) -> DataFrame:
    """``effective_resistance``, exact on components of any size."""
    return effective_resistance(graph, limit=limit)


def effective_resistance(graph: Graph, k: int | None = None, limit: int = EXACT_NODES, width: int = 32) -> DataFrame:
    """(src, dst, w, r) of every edge, or with ``k`` a lower bound of it from the k smallest positive modes.

    Without ``k``, all components get the exact value: those of up to ``limit`` nodes from a dense inverse, larger ones from
    ``exact_resistances``, which solves ``width`` columns at a time. The limit and the width change no result beyond rounding.
    """
    return _resistances(parted(graph, limit), k, limit, width)


def _resistances(parts: Parts, k: int | None, limit: int, width: int) -> DataFrame:
    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.astype({"src": "int64", "dst": "int64"})
        if k is not None and k < part[["src", "dst"]].stack().nunique() - 1:
            ids, lap = dense_laplacian(part)
            a, b = np.searchsorted(ids, part["src"]), np.searchsorted(ids, part["dst"])
            values, vectors = np.linalg.eigh(lap)
            keep = np.flatnonzero(values > 1e-10)[:k]
            z = vectors[:, keep] / np.sqrt(values[keep])
            r = ((z[a] - z[b]) ** 2).sum(1)
        else:
            r = 1.0 / part["w"].to_numpy()  # right for edges of trees that hang on the core
            core = part[_on_cycles(part["src"].to_numpy(), part["dst"].to_numpy())]
            if len(core):
                ids, lap = dense_laplacian(core)
                inverse = np.linalg.inv(lap + 1.0 / len(ids))  # the core is connected, as the component is
                a, b = np.searchsorted(ids, core["src"]), np.searchsorted(ids, core["dst"])
                r[part.index.get_indexer(core.index)] = inverse[a, a] + inverse[b, b] - 2 * inverse[a, b]
        return part[["src", "dst", "w"]].assign(r=np.maximum(r, 0.0))

    found = parts.linked().groupBy("component").applyInPandas(solve, "src long, dst long, w double, r double")
    if parts.names and k is None:
        named = parts.named.where(F.col("component").isin(parts.names)).select(F.col("node_id").alias("src"), "component")
        return found.union(exact_resistances(parts.graph.edges.join(named, "src"), limit, width))
    for name in parts.names:
        part = parts.large(name)
        vectors, values, _ = extreme_modes(part, k)
        root = F.array(*[F.lit(float(1 / np.sqrt(v)) if v > 1e-10 else 0.0) for v in values])
        place = staged(vectors.select("node_id", F.zip_with("v", root, lambda x, s: x * s).alias("z")), "places")
        a, b = place.select(F.col("node_id").alias("src"), F.col("z").alias("zs")), place.select(F.col("node_id").alias("dst"), F.col("z").alias("zd"))
        apart = F.aggregate(F.zip_with("zs", "zd", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
        found = found.union(part.edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select("src", "dst", "w", apart.alias("r")))
    return found


def resistance_errors(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """One row: relative Frobenius, mean and largest error of the approximate resistances."""
    both = exact.select("src", "dst", F.col("r").alias("re")).join(approximate.select("src", "dst", F.col("r").alias("ra")), ["src", "dst"])
    off = F.col("re") - F.col("ra")
    return both.agg((F.sqrt(F.sum(off * off)) / F.sqrt(F.sum(F.col("re") * F.col("re")))).alias("frobenius"), F.avg(F.abs(off) / F.greatest("re", F.lit(1e-12))).alias("mean"), F.max(F.abs(off) / F.greatest("re", F.lit(1e-12))).alias("largest"))


def sketch_errors(graph: Graph, limit: int = EXACT_NODES, width: int = 64) -> DataFrame:
    """``resistance_errors`` of projected resistances over the edges of components of up to ``limit`` nodes, which alone have exact ones.

    Systems fall apart by component, so that larger ones, whose edges are compared with nothing, are not solved.
    """
    edges = staged(parted(graph, limit).linked().select("src", "dst", "w"), "small")
    small = Graph(edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), edges)
    return resistance_errors(effective_resistance(small, limit=limit), sketched_resistance(small, width))


def identities(graph: Graph) -> DataFrame:
    """One row of closed forms: the sum of eigenvalues, of their squares, and of w r over the edges (nodes less components)."""
    deg = degrees(graph).agg(F.sum("wdeg").alias("trace"), F.sum(F.col("wdeg") * F.col("wdeg")).alias("_dd"), F.count("*").alias("_n"))
    w = graph.edges.agg(F.sum(F.col("w") * F.col("w")).alias("_ww"))
    zero = connected_components(graph).agg(F.count_distinct("component").alias("zeros"))
    joined = deg.join(F.broadcast(w)).join(F.broadcast(zero))  # one row each
    return joined.select("trace", (F.col("_dd") + 2 * F.col("_ww")).alias("trace_square"), (F.col("_n") - F.col("zeros")).alias("resistance_energy"), "zeros")


def spectral_ratio(graph: Graph) -> DataFrame:
    """(node_id, energy, ratio): with all modes a node's spectral energy is its weighted degree; the ratio is to the largest."""
    deg = degrees(graph)
    top = deg.agg(F.max("wdeg").alias("_top"))
    return deg.join(F.broadcast(top)).select("node_id", F.col("wdeg").alias("energy"), (F.col("wdeg") / (F.col("_top") + 1e-12)).alias("ratio"))  # one row is broadcast


def eigengap(graph: Graph, limit: int = EXACT_NODES) -> DataFrame:
    """(component, min_gap, fiedler, zeros) of each component.

    The smallest gap is that of the whole spectrum, which only components of up to ``limit`` nodes have; larger ones have null there.
    """

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(part["eigenvalue"].to_numpy())
        return pd.DataFrame([{"component": part["component"].iloc[0], "min_gap": float(np.diff(v).min()) if len(v) > 1 else None, "fiedler": max(float(v[1]), 0.0) if len(v) > 1 else 0.0, "zeros": int((v < 1e-8).sum())}])

    parts = parted(graph, limit)
    found = _dense_spectrum(parts).groupBy("component").applyInPandas(solve, "component long, min_gap double, fiedler double, zeros int")
    rows = [(name, None, max(extreme_modes(parts.large(name), 1)[1][0], 0.0), 1) for name in parts.names]
    return found.union(graph.edges.sparkSession.createDataFrame(rows, found.schema)) if rows else found


@dataclass(frozen=True)
class Ends:
    """What is known of a spectrum of ``n`` eigenvalues: the largest, falling; the smallest positive, rising; the number of zeros; and
    points with weights that stand for the rest. All of it is of bounded size."""

    n: int
    top: np.ndarray
    low: np.ndarray
    zeros: int
    points: np.ndarray
    weights: np.ndarray

    def at(self, rank: np.ndarray) -> np.ndarray:
        """The eigenvalues of these ranks, from 0 for the smallest."""
        upto = np.cumsum(self.weights) * (self.n / max(self.weights.sum(), 1e-300))
        out = self.points[np.minimum(np.searchsorted(upto, rank + 0.5), len(self.points) - 1)]
        above, below = self.n - 1 - rank, rank - self.zeros
        if len(self.top):
            out = np.where(above < len(self.top), self.top[np.clip(above, 0, len(self.top) - 1)], np.minimum(out, self.top[-1]))
        if len(self.low):
            out = np.where((below >= 0) & (below < len(self.low)), self.low[np.clip(below, 0, len(self.low) - 1)], np.where(below >= len(self.low), np.maximum(out, self.low[-1]), out))
        return np.where(below < 0, 0.0, out)


def ends_of_spectrum(graph: Graph, low: int = 32, top: int = 128, limit: int = EXACT_NODES, probes: int = 32, steps: int = 24) -> Ends:
    """The ends of a graph's spectrum: dense on small components, by block gradients on large ones; the rest by quadrature."""
    parts = parted(graph, limit)
    n = graph.nodes.count()
    exact = staged(_dense_spectrum(parts).select("eigenvalue"), "eigenvalues")
    tol = F.lit(EPS)
    first = [r[0] for r in exact.where(F.col("eigenvalue") > tol).orderBy("eigenvalue").limit(low).collect()]
    last = [r[0] for r in exact.orderBy(F.desc("eigenvalue")).limit(top).collect()]
    for name in parts.names:
        part = parts.large(name)
        first += extreme_modes(part, low)[1]
        last += extreme_modes(part, top, largest=True, tolerance=1e-5)[1]
    first, last = np.sort([v for v in first if v > EPS])[:low], np.sort(last)[::-1][:top]
    zeros = exact.where(F.col("eigenvalue") <= tol).count() + len(parts.names)
    return Ends(n, last, first, zeros, *quadrature(parts.graph, probes, steps))


def distortion(reference: Ends, other: Ends, grid: int = 1 << 14) -> dict[str, float | None]:
    """Measures of how far one spectrum has moved from another of the same length.

    Pairs by rank from below are those of all ranks, or of ``grid`` ranks of a longer spectrum; those by rank from above and of
    the positive eigenvalues are the ends'. What needs every eigenvalue, as the smallest gap does, is null for a longer spectrum.
    """
    if reference.n != other.n:
        raise ValueError(f"spectra of {reference.n} and {other.n} eigenvalues")
    n, top = reference.n, max(float(reference.top[0]), 0.0) if reference.n else 0.0
    whole = n <= len(reference.points) and bool((reference.weights == 1).all())
    ranks = np.arange(n) if n <= grid else np.unique(np.linspace(0, n - 1, grid).round().astype(np.int64))
    a, b = reference.at(ranks), other.at(ranks)
    paired = np.abs(a - b) / (np.abs(a) + EPS)
    paired[0] = 0.0
    sd, worst = float(paired.max()), int(ranks[paired.argmax()])
    gap = (float(np.diff(a).min()) if n > 1 else float("inf")) if whole else None
    at_low = np.arange(1, min(n, 33))
    low_a, low_b = reference.at(at_low), other.at(at_low)
    out = {"sd": sd, "sd_at": float(worst), "sd_p50": float(np.quantile(paired, 0.5)), "sd_p90": float(np.quantile(paired, 0.9)), "sd_p99": float(np.quantile(paired, 0.99)), "low_mode_mean": float((np.abs(low_a - low_b) / (np.abs(low_a) + EPS)).mean()) if n > 1 else 0.0}
    out |= {"retention": max(0.0, 1 - sd), "min_gap": gap, "fragility": None if gap is None else sd / (gap + EPS), "largest": top, "largest_other": float(other.top[0])}
    for k in (1, 8, 32, 128):
        if k <= n:
            m = min(k, len(reference.top), len(other.top))
            out[f"rank_top{k}"] = float((np.abs(reference.top[:m] - other.top[:m]) / (reference.top[:m] + EPS)).max())
    m = min(len(reference.low), len(other.low))
    error = np.abs(reference.low[:m] - other.low[:m]) / (top + EPS) if m else np.ones(1)
    out |= {"low_freq_k": float(m), "low_freq_mean": float(error.mean()), "low_freq_median": float(np.median(error)), "low_freq_p90": float(np.quantile(error, 0.9)), "low_freq_max": float(error.max()), "low_freq_gap": (float(np.diff(reference.low[:m]).min()) if m > 1 else float("inf")) if m else 0.0}
    isolated = max(0, other.zeros - reference.zeros)
    out |= {"positive": float(n - reference.zeros), "positive_other": float(n - other.zeros), "zeros": float(reference.zeros), "zeros_other": float(other.zeros), "isolated": float(isolated)}
    out["survival"] = max(0.0, (1 - min(max(out["low_freq_mean"], 0.0), 1.0)) * (1 - isolated / max(n, 1)))
    return out


def whole_ends(values: np.ndarray, low: int = 32) -> Ends:
    """A spectrum of which every eigenvalue is known."""
    values = np.sort(np.asarray(values, float))
    tol = max(EPS, 1e-10 * float(values[-1])) if len(values) else EPS
    return Ends(len(values), values[::-1], values[values > tol][:low], int((values <= tol).sum()), values, np.ones(len(values)))


def distortion_report(reference: Graph, other: Graph, limit: int = EXACT_NODES, low: int = 32, **options) -> DataFrame:
    """(measure, value) of two graphs on the same nodes: from all eigenvalues if there are up to ``limit``, else from the ends of the spectra."""
    spark = reference.edges.sparkSession
    if reference.nodes.count() <= limit:
        sides = [whole_ends([r["eigenvalue"] for r in _dense_spectrum(parted(g, limit)).collect()], low) for g in (reference, other)]
    else:
        sides = [ends_of_spectrum(g, low, limit=limit, **options) for g in (reference, other)]
    return spark.createDataFrame(list(distortion(*sides).items()), "measure string, value double")


def mode_similarity(graph: Graph, mode_table: DataFrame, k: int, absolute: bool = False) -> DataFrame:
    """(node_id, sim): mean cosine of a node's k mode entries with its neighbours'; 0 for isolated nodes."""
    from graphloom.functions.vectors import dot, unit, vector_sum

    v = F.slice("v", 1, k)
    units = mode_table.select("node_id", unit(F.transform(v, F.abs) if absolute else v).alias("u"))
    summed = graph.both_ways().join(units.select(F.col("node_id").alias("dst"), "u").hint("merge"), "dst").groupBy(F.col("src").alias("node_id")).agg(vector_sum("u", k).alias("t"), F.count("*").alias("n"))
    found = summed.join(units.hint("merge"), "node_id").select("node_id", (dot("u", "t") / F.col("n")).alias("sim"))
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("sim", F.lit(0.0)).alias("sim"))


def mode_centrality(mode_table: DataFrame, k: int) -> DataFrame:
    return mode_table.select("node_id", F.aggregate(F.slice("v", 1, k), F.lit(0.0), lambda a, x: a + F.abs(x)).alias("centrality"))


def resistance_scores(graph: Graph, resistances: DataFrame) -> DataFrame:
    """(node_id, inv_mean_res, inv_min_res) over a node's own edges; 0 for isolated nodes."""
    both = resistances.select(F.col("src").alias("node_id"), "r").union(resistances.select("dst", "r"))
    found = both.groupBy("node_id").agg((-F.avg("r")).alias("inv_mean_res"), (-F.min("r")).alias("inv_min_res"))
    return graph.nodes.select("node_id").join(found, "node_id", "left").na.fill(0.0, ["inv_mean_res", "inv_min_res"])


def bounds(reference: np.ndarray, other: np.ndarray) -> dict[str, bool | float]:
    """Weyl's, Davis and Kahan's and Cauchy's bounds on two symmetric matrices of one size, and whether they hold."""
    a, b = np.linalg.eigvalsh(reference), np.linalg.eigvalsh(other)
    change = float(np.linalg.norm(reference - other, 2))
    gap = float(np.diff(a).min()) if len(a) > 1 else 0.0
    inner = np.linalg.eigvalsh(reference[:-1, :-1])
    return {
        "weyl": bool((np.abs(a - b) <= change + 1e-9).all()), "davis_kahan": 2 * float(np.linalg.norm(reference - other)) / (gap + EPS),
        "interlacing": bool((a[:-1] <= inner + 1e-9).all() and (inner <= a[1:] + 1e-9).all()), "change": change,
    }


def retention(distortion: Column) -> Column:
    """What is left of the spectrum: 1 less the distortion, not below 0."""
    return F.greatest(F.lit(0.0), 1 - distortion)


def davis_kahan(frobenius: Column, gap: Column) -> Column:
    """The bound on how far eigenvectors turn."""
    return 2 * frobenius / (gap + EPS)


def fiedler_neighbours(graph: Graph, mode_table: DataFrame) -> DataFrame:
    """(node_id, sim): the mean of the neighbours' entries of the first mode, whose largest entry is positive; 0 for isolated nodes."""
    first = mode_table.select(F.col("node_id").alias("dst"), F.get("v", 0).alias("v"))
    found = graph.both_ways().join(first, "dst").groupBy(F.col("src").alias("node_id")).agg(F.avg("v").alias("sim"))
    return graph.nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("sim", F.lit(0.0)).alias("sim"))
