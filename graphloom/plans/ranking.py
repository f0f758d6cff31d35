"""Ranks over a whole table without sending it, or a group of it, to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import staged


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with its row number (from 1) in the given order; rows that tie get theirs in any order.

    Rows are range-partitioned and sorted where they are; a row's number is its place in its partition plus the rows
    of the partitions before, of which there is one count each. The sorted rows are written, so that every use, also
    one after a lost executor, sees the same partitions.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    ordered = staged(ordered, "ranked")
    sizes = sorted((r["_part"], r["count"]) for r in ordered.groupBy("_part").count().collect())  # one row a partition
    before, upto = [], 0
    for part, n in sizes:
        before.append((part, upto))
        upto += n
    offsets = df.sparkSession.createDataFrame(before or [(0, 0)], "_part int, _before long")
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def running_total(df: DataFrame, value: str, *order: Column, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each in the given order: along each range partition, then over those before."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    ordered = staged(ordered, "ordered")
    sums = sorted((r["_part"], r["total"]) for r in ordered.groupBy("_part").agg(F.sum(value).alias("total")).collect())  # one row a partition
    rows, upto = [], 0
    for part, total in sums:
        rows.append((part, upto))
        upto += total or 0
    kind = "double" if isinstance(upto, float) else "long"
    offsets = df.sparkSession.createDataFrame(rows, f"_part int, _before {kind}")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_at", "_inside", "_before")


def grouped_rank(df: DataFrame, group: str, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with each row's number (from 1) within its group; a group of any size is spread over all tasks."""
    ranked = global_rank(df, F.asc(group), *order, name=name)
    firsts = ranked.groupBy(F.col(group).alias("_group")).agg(F.min(name).alias("_first"))
    return ranked.join(firsts, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_group", "_first")


def average_rank(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` with the rank of ``value`` within the group, ties sharing their mean rank; null values come first."""
    ranked = grouped_rank(df, group, F.asc(value), name="_row")
    shared = ranked.groupBy(F.col(group).alias("_group"), F.col(value).alias("_value")).agg(F.avg("_row").alias(name))
    return ranked.join(shared, F.col(group).eqNullSafe(F.col("_group")) & F.col(value).eqNullSafe(F.col("_value"))).drop("_row", "_group", "_value")


def order_statistics(df: DataFrame, value: str, ranks: list[int], few: int = 10_000) -> list[float | None]:
    """The values of these ranks (from 0) among the values that are neither null nor NaN; null for a rank that there is not.

    Each round brackets every rank between two approximate percentiles of what its bracket still holds and counts exactly
    what lies below and inside, until a bracket is one value or holds ``few`` distinct ones at most, which are counted.
    State is of bounded size on every machine, and no round sorts or shuffles the rows.
    """
    v = F.col(value).cast("double")
    held = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    v = F.col("v")
    n, least, most = held.agg(F.count("*"), F.min("v"), F.max("v")).first()
    found: dict[int, float | None] = {r: None for r in ranks if not 0 <= r < n}
    brackets = {r: (least, most, 0, n) for r in ranks if 0 <= r < n}  # bounds, rows below, rows inside
    while brackets:
        for r, (lo, hi, below, _) in list(brackets.items()):
            if lo == hi:
                found[r] = lo
                del brackets[r]
        if small := {r: b for r, b in brackets.items() if b[3] <= few}:
            for r, (lo, hi, below, _) in small.items():
                counts = held.where((v >= lo) & (v <= hi)).groupBy("v").count().collect()
                for row in sorted(counts, key=lambda x: x["v"]):
                    below += row["count"]
                    if r < below:
                        found[r] = row["v"]
                        break
                del brackets[r]
        if not brackets:
            break
        inner = []
        for r, (lo, hi, below, inside) in brackets.items():
            at, reach = (r - below) / inside, 1 / 500
            chosen = F.when((v >= lo) & (v <= hi), v)
            inner.append(F.approx_percentile(chosen, F.array(F.lit(max(0.0, at - reach)), F.lit(min(1.0, at + reach))), 10_000))
        bounds = held.agg(*[c.alias(f"b{i}") for i, c in enumerate(inner)]).first()
        cuts = [tuple(bounds[f"b{i}"]) for i in range(len(inner))]
        counted = held.agg(*[F.count_if(v < a).alias(f"l{i}") for i, (a, _) in enumerate(cuts)], *[F.count_if(v <= b).alias(f"u{i}") for i, (_, b) in enumerate(cuts)], *[F.max(F.when(v < a, v)).alias(f"p{i}") for i, (a, _) in enumerate(cuts)], *[F.min(F.when(v > b, v)).alias(f"s{i}") for i, (_, b) in enumerate(cuts)]).first()
        for i, (r, (lo, hi, below, inside)) in enumerate(list(brackets.items())):
            under, upto = counted[f"l{i}"], counted[f"u{i}"]
            if r < under:  # the bracket missed it: what is known exactly tells the side
                brackets[r] = (lo, counted[f"p{i}"], below, under - below)
            elif r >= upto:
                brackets[r] = (counted[f"s{i}"], hi, upto, below + inside - upto)
            else:
                brackets[r] = (*cuts[i], under, upto - under)
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, value: str, at: list[float]) -> list[float | None]:
    """Exact quantiles, with linear interpolation between the two nearest values; null without values."""
    v = F.col(value).cast("double")
    n = df.where(v.isNotNull() & ~F.isnan(v)).count()
    if not n:
        return [None] * len(at)
    places = [p * (n - 1) for p in at]
    ranks = sorted({int(x) for x in places} | {min(int(x) + 1, n - 1) for x in places})
    values = dict(zip(ranks, order_statistics(df, value, ranks), strict=True))
    return [values[int(x)] + (x - int(x)) * (values[min(int(x) + 1, n - 1)] - values[int(x)]) for x in places]
