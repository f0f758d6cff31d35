"""Paired statistics, rank correlations and decision rules over tables of cells (cond, split, seed, acc)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.hashing import uniform
from graphloom.operators.iterative import totals
from graphloom.plans.ranking import average_rank, global_rank
from graphloom.storage import discard, staged


def seed_means(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cond", "split").agg(F.avg("acc").alias("acc"))


def paired(cells: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(name, split, d): differences of seed means a - b over the splits that both conditions have."""
    means = seed_means(cells)
    table = cells.sparkSession.createDataFrame(pairs, "name string, a string, b string")
    a = means.select(F.col("cond").alias("a"), "split", F.col("acc").alias("acc_a"))
    b = means.select(F.col("cond").alias("b"), "split", F.col("acc").alias("acc_b"))
    return F.broadcast(table).join(a, "a").join(b, ["b", "split"]).select("name", "split", (F.col("acc_a") - F.col("acc_b")).alias("d"))


def wilcoxon_p(d: np.ndarray) -> float:
    """Two-sided signed-rank p-value; differences within 1e-12 of 0 do not count, none left gives 1.

    Exact below 15 differences, by all sign patterns of the (average) ranks; else the normal approximation with
    correction for ties.
    """
    d = d[np.abs(d) > 1e-12]
    n = len(d)
    if not n:
        return 1.0
    size = np.round(np.abs(d), 12)
    ranks = pd.Series(size).rank().to_numpy()
    plus = ranks[d > 0].sum()
    if n < 15:
        sums = np.array([0.0])
        for r in ranks:
            sums = np.concatenate([sums, sums + r])
        low = min(plus, ranks.sum() - plus)
        return float(min(1.0, 2 * (sums <= low + 1e-9).mean()))
    ties = pd.Series(size).value_counts().to_numpy()
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48)
    z = (min(plus, ranks.sum() - plus) - n * (n + 1) / 4) / spread
    return float(min(1.0, math.erfc(-z / math.sqrt(2)) if z < 0 else 1.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_quantile(p: float, df: float) -> float:
    """The t that is exceeded with probability 1 - p (p > 0.5), by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) / 2 > 1 - p else (low, mid)
    return (low + high) / 2


def paired_t_p(d: np.ndarray) -> float:
    if len(d) < 2 or d.std(ddof=1) < 1e-12:
        return 1.0
    return t_two_sided(d.mean() / (d.std(ddof=1) / math.sqrt(len(d))), len(d) - 1)


def comparisons(differences: DataFrame, level: float = 0.95) -> DataFrame:
    """(name, mean_diff, ci_low, ci_high, p_wilcoxon, p_paired_t, effect_size_dz, n_pairs) of each named set of differences."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        d = group.sort_values("split")["d"].to_numpy()
        half = t_quantile(0.5 + level / 2, len(d) - 1) * d.std(ddof=1) / math.sqrt(len(d)) if len(d) > 1 else 0.0
        spread = d.std()
        return pd.DataFrame([{"name": group["name"].iloc[0], "mean_diff": d.mean(), "ci_low": d.mean() - half, "ci_high": d.mean() + half, "p_wilcoxon": wilcoxon_p(d), "p_paired_t": paired_t_p(d), "effect_size_dz": d.mean() / spread if spread > 1e-12 else 0.0, "n_pairs": len(d)}])

    return differences.groupBy("name").applyInPandas(one, "name string, mean_diff double, ci_low double, ci_high double, p_wilcoxon double, p_paired_t double, effect_size_dz double, n_pairs int")


def effect_sizes(differences: DataFrame) -> DataFrame:
    """(name, mean_diff, dz, n_pairs) without Python: mean over population deviation, 0 without spread."""
    spread = F.stddev_pop("d")
    return differences.groupBy("name").agg(F.avg("d").alias("mean_diff"), F.when(spread > 1e-12, F.avg("d") / spread).otherwise(0.0).alias("dz"), F.count("*").alias("n_pairs"))


def mean_ci(differences: DataFrame, t_star: float) -> DataFrame:
    """(name, mean_diff, ci_low, ci_high) with the sample deviation and a given t."""
    half = F.coalesce(t_star * F.stddev_samp("d") / F.sqrt(F.count("*")), F.lit(0.0))
    return differences.groupBy("name").agg(F.avg("d").alias("mean_diff"), (F.avg("d") - half).alias("ci_low"), (F.avg("d") + half).alias("ci_high"))


def holm(tests: DataFrame, p: str = "p", family: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """``tests`` with Holm's threshold, adjusted p-value and decision, within each family; null p-values take no part."""
    keys = family or []
    counted = tests.where(F.col(p).isNotNull())
    order = Window.partitionBy(*keys).orderBy(p, *[c for c in tests.columns if c not in [*keys, p]][:1])
    k, n = F.row_number().over(order), F.count("*").over(Window.partitionBy(*keys))
    ranked = counted.withColumn("_left", (n - k + 1).cast("double"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = F.least(F.lit(1.0), F.max(F.col("_left") * F.col(p)).over(running))
    return ranked.withColumn("threshold", F.lit(alpha) / F.col("_left")).withColumn("p_holm", adjusted).withColumn("rejected", F.col("p_holm") <= alpha).drop("_left")


def _corr(x: str, y: str) -> Column:
    """Aggregate: Pearson's correlation; null if either is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def spearman(rows: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """(group, rho, n) of each group."""
    ranked = average_rank(average_rank(rows.select(group, x, y), group, x, "_rx"), group, y, "_ry")
    return ranked.groupBy(group).agg(_corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def strided_spearman(rows: DataFrame, order: str, x: str, y: str, most: int = 200_000) -> DataFrame:
    """(rho, n) on every k-th row in the given order, k so that ``most`` rows are used at most."""
    stride = max(1, -(-rows.count() // most))
    drawn = global_rank(rows, F.asc(order), name="_row").where(F.col("_row") % stride == 0)
    return spearman(drawn.select(F.lit(1).alias("_all"), x, y), x, y, "_all").select("rho", "n")


def partial_spearman(rows: DataFrame, x: str, y: str, z: str, group: str) -> DataFrame:
    """(group, rho) of x and y given z, from the three pairwise correlations of ranks; null with fewer than 4 rows or a constant."""
    ranked = rows.select(group, x, y, z)
    for i, c in enumerate((x, y, z)):
        ranked = average_rank(ranked, group, c, f"_r{i}")
    r = ranked.groupBy(group).agg(_corr("_r0", "_r1").alias("xy"), _corr("_r0", "_r2").alias("xz"), _corr("_r1", "_r2").alias("yz"), F.count("*").alias("n"))
    below = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    return r.select(group, F.when((F.col("n") >= 4) & (below > 0), (F.col("xy") - F.col("xz") * F.col("yz")) / below).alias("rho"))


#: Chances that a Poisson variable of mean 1 is at most 0, 1, 2 and so on.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def poisson_weight(*parts: Column | str | int) -> Column:
    """How often a draw takes a cluster: a Poisson number of mean 1 from the parts' hash."""
    hashed = F.array(uniform(*parts))  # bound once, as a lambda would hash again for each chance
    return F.get(F.transform(hashed, lambda u: F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda p: p <= u)).cast("double")), 0)


def _weighted_ranks(held: DataFrame, value: str, draws: int, weights: list[Column] | None = None) -> DataFrame:
    """(value, rank) of each distinct value: its average rank among all rows, in each draw, rows counting as often as they weigh.

    Weights are ``w``, or the given columns. They are summed by value, and summed up along the sorted values (null first): within a task,
    then over the tasks before.
    """
    weights = weights or [F.get("w", i) for i in range(draws)]
    schema = T.StructType([T.StructField(value, held.schema[value].dataType), T.StructField("part", T.IntegerType()), T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("upto", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), np.zeros(draws)
        for batch in batches:
            if not len(batch):
                continue
            w = batch.column(1).flatten().to_numpy().reshape(len(batch), draws)
            upto = before + np.cumsum(w, axis=0)
            before = upto[-1].copy()
            ends = np.arange(len(batch) + 1, dtype=np.int32) * draws
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(batch), part, np.int32)), *[pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))) for x in (w, upto)]], schema.names)

    summed = held.groupBy(value).agg(F.array(*[F.sum(w) for w in weights]).alias("w"))
    along = staged(summed.repartitionByRange(value).sortWithinPartitions(value).mapInArrow(run, schema), "along")
    parts = {r["part"]: np.array(r["w"]) for r in along.groupBy("part").agg(F.array(*[F.sum(F.get("w", i)) for i in range(draws)]).alias("w")).collect()}  # one row a task
    rows, total = [], np.zeros(draws)
    for part in sorted(parts):
        rows.append((part, total.tolist()))
        total = total + parts[part]
    before = held.sparkSession.createDataFrame(rows, "part int, before array<double>")
    whole = along.join(F.broadcast(before), "part")
    return whole.select(value, F.transform(F.arrays_zip("w", "upto", "before"), lambda t: t["before"] + t["upto"] - t["w"] + (t["w"] + 1) / 2).alias(f"rank_{value}"))


#: Rows of a bucket of neighbouring values, about; columns of draws that a task has as doubles at once.
BUCKET, COLUMNS = 25_000, 16


def _cuts(held: DataFrame, value: str, rows: int) -> np.ndarray:
    """Ascending values, each the largest of a bucket of about ``BUCKET`` rows; a value that fills a bucket has one to itself."""
    many = max(8, rows // BUCKET)
    found = np.array(held.agg(F.approx_percentile(value, F.array(*[F.lit(i / many) for i in range(1, many + 1)]), F.lit(10 * many))).first()[0])
    often = found[1:][found[1:] == found[:-1]]
    return np.unique(np.concatenate([found, np.nextafter(often, -np.inf), [np.inf]]))


def _bucket(cuts: np.ndarray, values: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """Each value's bucket, and a key that its rows may meet by: buckets of one value are dealt by ``spread`` too, as they are not ranked within."""
    alone = np.append(False, cuts[:-1] == np.nextafter(cuts[1:], -np.inf))
    at = np.searchsorted(cuts, values)
    return at, at + np.where(alone[at], len(cuts) * spread, 0)


def _inner_ranks(values: np.ndarray, w: np.ndarray, total: np.ndarray, alone: bool) -> np.ndarray:
    """Twice the average rank of each row in its bucket, by draw; ``total`` is the bucket's weight, which a bucket of one value needs only."""
    if alone:
        return np.broadcast_to(total.astype(np.int64) + 1, w.shape)
    order = np.argsort(values, kind="stable")
    upto = np.vstack([np.zeros((1, w.shape[1]), np.int64), np.cumsum(w[order], axis=0, dtype=np.int64)])
    first = np.flatnonzero(np.append(True, np.diff(values[order]) != 0))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(values))))
    out = np.empty(w.shape, np.int64)
    out[order] = (upto[first] + upto[np.append(first[1:], len(values))] + 1)[run]
    return out


def _packed(rows: np.ndarray) -> pa.Array:
    """A row of bytes of each row of a matrix."""
    rows = np.ascontiguousarray(rows).reshape(len(rows), -1).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.py_buffer(rows.reshape(-1))])


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of a column of equally long rows."""
    return np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in column.chunks if len(c)])


def _weighted_moments(drawn: DataFrame, cuts: dict[str, np.ndarray], draws: int) -> np.ndarray:
    """Rows: weights, and sums of squares and products of the average ranks of x and y less their means, in each draw.

    Ranks are a bucket's weight below it and the rank inside. The first come from one pass over the rows, the second where
    the rows of a bucket of x meet; they go on as bytes, sorted by their weight so that what is 0 packs well, to where the
    rows of a bucket of y meet. A task has one bucket at a time.
    """
    spark, shape = drawn.sparkSession, {c: (len(cuts[c]), draws) for c in ("x", "y")}

    def weigh(b: dict[str, np.ndarray]) -> np.ndarray:
        out = []
        for c in ("x", "y"):
            at, sums = np.searchsorted(cuts[c], b[c]), np.zeros(shape[c])
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
            sums[at[order][first]] = np.add.reduceat(b["w"][order], first, axis=0, dtype=np.float64)
            out.append(sums.reshape(-1))
        return np.concatenate(out)

    found = totals(drawn, weigh, sum(a * b for a, b in shape.values()))
    inside = {"x": found[: shape["x"][0] * draws].reshape(shape["x"]), "y": found[shape["x"][0] * draws :].reshape(shape["y"])}
    whole = inside["x"].sum(0)
    sent = spark.sparkContext.broadcast((cuts, inside, {c: np.cumsum(v, axis=0) - v for c, v in inside.items()}))  # a row for each bucket

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            if len(batch):
                w = batch.column(2).flatten().to_numpy().reshape(len(batch), draws)
                _, key = _bucket(sent.value[0]["x"], batch.column(0).to_numpy(), 1 + part + (i << 20))
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1), _packed(w)], ["key", "x", "y", "w"])

    def ranked(values: np.ndarray, w: np.ndarray, side: str) -> Iterator[tuple[slice, int, np.ndarray]]:
        cuts, inside, _ = sent.value
        at = int(np.searchsorted(cuts[side], values[0]))
        alone = at > 0 and cuts[side][at - 1] == np.nextafter(cuts[side][at], -np.inf)
        for j in range(0, draws, COLUMNS):
            some = slice(j, j + COLUMNS)
            yield some, at, _inner_ranks(values, w[:, some], inside[side][at, some], alone)

    def by_x(rows: pa.Table) -> pa.Table:
        x, y, w = rows["x"].to_numpy(), rows["y"].to_numpy(), _unpacked(rows["w"])
        planes, at = np.empty((len(x), 4, draws), np.uint8), 0
        for some, at, inner in ranked(x, w, "x"):
            planes[:, :, some] = np.ascontiguousarray(inner, "<i4").view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1)
        _, key = _bucket(sent.value[0]["y"], y, 1 + at)
        return pa.table([pa.array(key), pa.array(np.full(len(x), at, np.int32)), pa.array(y), _packed(w), _packed(planes)], ["key", "at", "y", "w", "p"])

    def by_y(rows: pa.Table) -> pa.Table:
        at, y, w = rows["at"].to_numpy(), rows["y"].to_numpy(), _unpacked(rows["w"])
        planes, below, out = _unpacked(rows["p"]).reshape(len(y), 4, draws), sent.value[2], np.zeros((3, draws))
        for some, mine, inner in ranked(y, w, "y"):
            p = np.ascontiguousarray(planes[:, :, some].transpose(0, 2, 1)).view("<i4")[:, :, 0] / 2 + below["x"][at, some] - (whole[some] + 1) / 2
            q, v = inner / 2 + below["y"][mine, some] - (whole[some] + 1) / 2, w[:, some]
            out[:, some] = (v * p * p).sum(0), (v * q * q).sum(0), (v * p * q).sum(0)
        return pa.table([pa.array([out.reshape(-1).tolist()], pa.list_(pa.float64()))], ["sums"])

    met = drawn.mapInArrow(deal, "key long, x double, y double, w binary").groupBy("key").applyInArrow(by_x, "key long, at int, y double, w binary, p binary")
    sums = met.groupBy("key").applyInArrow(by_y, "sums array<double>")
    out = totals(sums, lambda b: b["sums"].sum(0), 3 * draws).reshape(3, draws)
    sent.destroy()
    return np.vstack([whole, out])


def bootstrap_spearman(rows: DataFrame, x: str, y: str, cluster: str, draws: int = 2000, seed: int = 0, level: float = 0.95, at_once: int = 256) -> DataFrame:
    """One row: Spearman's rho, its percentile interval and p-value over ``draws`` Poisson draws of clusters.

    In a draw every cluster counts as often as a Poisson number of mean 1 says, which depends on (seed, cluster, draw) only; ranks
    are of the rows so counted. ``at_once`` draws share one pass. Rows without x or y take no part, null clusters are one.
    A draw in which either side is constant, or that is empty, does not count; without any, interval and p are null.
    """
    held = staged(rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("c")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"), "rows")
    schema = "rho double, ci_low double, ci_high double, p double"
    many = held.count()
    if not many:
        return held.sparkSession.createDataFrame([], schema)
    cuts = {c: _cuts(held, c, many) for c in ("x", "y")}
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # also where adaptive execution would take fewer: a cluster is a hash for each draw
    found: list[float] = []
    for at in range(0, draws + 1, at_once):  # the first draw takes every row once
        part = range(at, min(at + at_once, draws + 1))
        weights = F.transform(F.sequence(F.lit(part[0] - 1), F.lit(part[-1] - 1)), lambda i: F.when(i < 0, 1.0).otherwise(poisson_weight(seed, "c", i)).cast("byte"))
        weighed = held.select("c").repartition(tasks, "c").distinct().select("c", weights.alias("w"))
        drawn = staged(held.join(weighed, "c").select("x", "y", "w"), "drawn")
        n, pp, qq, pq = _weighted_moments(drawn, cuts, len(part))
        discard(drawn)
        below = pp * qq / np.maximum(n, 1) ** 2
        rhos = np.where(below > 1e-9, pq / np.sqrt(np.where(below > 1e-9, pp * qq, 1)), np.nan)
        found += rhos.tolist()
    whole, found = found[0], [v for v in found[1:] if not math.isnan(v)]
    low, high = np.quantile(found, [(1 - level) / 2, (1 + level) / 2]).tolist() if found else (None, None)
    p = float(min(1.0, 2 * min(np.mean(np.array(found) <= 0), np.mean(np.array(found) >= 0)))) if found else None
    return held.sparkSession.createDataFrame([(None if math.isnan(whole) else whole, low, high, p)], schema)


def leave_one_out(rows: DataFrame, x: str, y: str, group: str, at_once: int = 32) -> DataFrame:
    """(left_out, rho): Spearman's rho of the pooled rows of all groups but one.

    No row is copied for a group: ranks without a group are ranks in which its rows weigh 0, and those of ``at_once`` groups share
    a pass. Rows without a group take no part; null values come first; a constant side gives null.
    """
    held = staged(rows.select(F.col(group).alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).where("g IS NOT NULL"), "rows")
    sizes = [(r["g"], r["count"]) for r in held.groupBy("g").count().orderBy("g").collect()]  # one row a group
    whole, found = sum(n for _, n in sizes), []
    for at in range(0, len(sizes) if len(sizes) > 1 else 0, at_once):
        some = sizes[at : at + at_once]
        placed = held.select((F.array_position(F.array(*[F.lit(g) for g, _ in some]), F.col("g")) - 1).cast("int").alias("k"), "x", "y")
        weights = [(F.col("k") != i).cast("double") for i in range(len(some))]
        ranks = {c: _weighted_ranks(placed, c, len(some), weights).withColumnRenamed(c, f"of_{c}") for c in ("x", "y")}
        ranked = placed.join(ranks["x"], F.col("x").eqNullSafe(F.col("of_x"))).join(ranks["y"], F.col("y").eqNullSafe(F.col("of_y")))
        left = np.array([whole - n for _, n in some], float)

        def sums(b: dict[str, np.ndarray], left: np.ndarray = left) -> np.ndarray:
            w = b["k"][:, None] != np.arange(len(left))
            p, q = (np.where(w, b[c] - (left + 1) / 2, 0.0) for c in ("rank_x", "rank_y"))
            return np.concatenate([(p * p).sum(0), (q * q).sum(0), (p * q).sum(0)])

        pp, qq, pq = totals(ranked.select("k", "rank_x", "rank_y"), sums, 3 * len(some)).reshape(3, -1)
        found += [(g, float(c / np.sqrt(a) / np.sqrt(b)) if a > 0 and b > 0 else None) for (g, _), a, b, c in zip(some, pp, qq, pq, strict=True)]
    return rows.sparkSession.createDataFrame(found, T.StructType([T.StructField("left_out", rows.schema[group].dataType), T.StructField("rho", T.DoubleType())]))


def monotone(rows: DataFrame, method: str, order: str, value: str) -> DataFrame:
    """(method, monotone): whether the value never falls as ``order`` falls."""
    before = F.lag(value).over(Window.partitionBy(method).orderBy(F.desc(order)))
    return rows.withColumn("_up", (before <= F.col(value)) | before.isNull()).groupBy(method).agg(F.bool_and("_up").alias("monotone"))


#: What the rules compare: alternative and baseline.
RULES = [("D1", "oracle", "uniform"), ("D2", "label_free", "random"), ("D3", "oracle", "random")]


def decisions(compared: DataFrame, control: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """One row: D1 (the signal exists: oracle against uniform), D2 (a router finds it: label-free against random), D3 (it is not capacity:
    oracle against random), D4 (the control's D1), each rule's own p-value, and a verdict.

    A rule holds if its difference is positive and its p-value stands after Holm's correction over the rules that are
    there; one that is not there is null. All four have to hold, else the verdict names those that don't. ``compared`` and
    ``control`` have (name, mean_diff, p).
    """
    rules = compared.where(F.col("name").isin("D1", "D2", "D3")).select("name", "mean_diff", "p")
    if control is not None:
        rules = rules.union(control.where("name = 'D1'").select(F.lit("D4"), "mean_diff", "p"))
    judged = holm(rules, "p", alpha=alpha).withColumn("ok", F.col("rejected") & (F.col("mean_diff") > 0))
    names = ("D1", "D2", "D3", "D4")
    wide = judged.agg(*[f(F.when(F.col("name") == d, F.col(c))).alias(n) for d in names for f, c, n in ((F.bool_or, "ok", d), (F.max, "p", f"{d}_p"))])
    failed = F.concat_ws(", ", *[F.when(~F.coalesce(d, F.lit(False)), d) for d in names])
    return wide.withColumn("verdict", F.when(failed == "", "supported").otherwise(F.concat(F.lit("not supported: "), failed)))


def leave_one_split_k(rows: DataFrame) -> DataFrame:
    """(split, k, acc): for each split the k with the best mean over the other splits, smallest if tied, and its result there; rows (k, split, acc)."""
    per_k = Window.partitionBy("k")
    others = rows.withColumn("rest", F.round((F.sum("acc").over(per_k) - F.col("acc")) / (F.count("*").over(per_k) - 1), 9))
    best = Window.partitionBy("split").orderBy(F.desc("rest"), "k")
    return others.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("split", "k", "acc")


def first_thresholds(rows: DataFrame, at: str, existence: str, deployable: str) -> DataFrame:
    """One row: the smallest ``at`` where each of two conditions holds, null if nowhere."""
    return rows.agg(F.min(F.when(F.col(existence), F.col(at))).alias("existence"), F.min(F.when(F.col(deployable), F.col(at))).alias("deployable"))


def grouped_cells(rows: DataFrame, cond: Column, split: Column, seed: Column, value: Column) -> DataFrame:
    """Cells of measured rows: the mean of ``value`` for each condition, split and seed; rows without a condition take no part."""
    named = rows.select(cond.alias("cond"), split.cast("int").alias("split"), seed.cast("int").alias("seed"), value.alias("v")).where("cond IS NOT NULL")
    return named.groupBy("cond", "split", "seed").agg(F.round(F.avg("v"), 9).alias("acc"))


def hash_cells(spark, conditions: dict[str, float], splits: int = 10, seeds: int = 3, spread: float = 0.02) -> DataFrame:
    """Cells of known means with hashed noise, for checks of everything above."""
    base = spark.createDataFrame(sorted(conditions.items()), "cond string, mean double")
    grid = base.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return grid.select("cond", "split", "seed", F.round(F.col("mean") + spread * (uniform("cond", "split", "seed") - 0.5), 6).alias("acc"))


