"""Bands, pivots and tables over results of grids of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bands(rows: DataFrame, keys: list[str], method: str, metrics: list[str]) -> DataFrame:
    """(keys..., method, metric, mean, std (population), least, most, n) over the runs of each grid point."""
    long = rows.unpivot([*keys, method], metrics, "metric", "value")
    return long.groupBy(*keys, method, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))


def check_bands(rows: DataFrame, keys: list[str], method: str, metric: str, own: str, others: list[str]) -> DataFrame:
    """(keys..., below_<other>..., below_all): whether ``own``'s mean is below each of the others'."""
    wide = rows.groupBy(*keys).pivot(method, [own, *others]).agg(F.round(F.avg(metric), 9))
    below = [(F.col(own) < F.col(o)).alias(f"below_{o}") for o in others]
    every = F.lit(True)
    for o in others:
        every = every & (F.col(own) < F.col(o))
    return wide.select(*keys, *below, every.alias("below_all"))


def win_counts(checked: DataFrame, flags: list[str]) -> DataFrame:
    """One row: grid points, how many meet each flag, the share that meets the last, and whether all do."""
    last = flags[-1]
    return checked.agg(F.count("*").alias("points"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags], F.avg(F.col(last).cast("double")).alias("share"), F.bool_and(last).alias("everywhere"))


def rung_summary(rows: DataFrame, rung: str, value: str) -> DataFrame:
    """(rung, mean, std (sample, 0 for one run)) over a ladder's runs."""
    return rows.groupBy(rung).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def mean_gain(cells: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the mean of a - b over the (split, seed) that both conditions have."""
    left = cells.where(F.col("cond") == a).select("split", "seed", F.col("acc").alias("acc_a"))
    right = cells.where(F.col("cond") == b).select("split", "seed", F.col("acc").alias("acc_b"))
    return left.join(right, ["split", "seed"]).agg(F.avg(F.col("acc_a") - F.col("acc_b")).alias("gain"), F.count("*").alias("n"))


def wide_table(rows: DataFrame, index: list[str], column: str, columns: list[str], value: str) -> DataFrame:
    """Means by index and column, a column each."""
    return rows.groupBy(*index).pivot(column, columns).agg(F.avg(value))


def distinct_rounded(rows: DataFrame, value: str, places: int = 6) -> DataFrame:
    return rows.agg(F.count_distinct(F.round(value, places)).alias("n_distinct"))


def purity_mapping(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, column, n, purity): the column that most of a group's rows have, the lowest if tied."""
    counted = rows.groupBy(group, column).agg(F.count("*").alias("n"))
    best = counted.groupBy(group).agg(F.max(F.struct(F.col("n"), (-F.col(column)).alias("low"))).alias("best"), F.sum("n").alias("size"))
    return best.select(group, (-F.col("best.low")).alias(column), F.col("best.n").alias("n"), (F.col("best.n") / F.col("size")).alias("purity"))


def remaining(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Grid points without a result yet: what a resumed ladder has to run."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def pooled_and_each(rows: DataFrame, group: str, aggregate, name: str) -> DataFrame:
    """An aggregate of each group and, under the group 'all', of the pooled rows."""
    return rows.select(F.explode(F.array(F.col(group), F.lit("all"))).alias(group), *[c for c in rows.columns if c != group]).groupBy(group).agg(aggregate.alias(name))


def latex_table(rows: DataFrame, columns: list[str], caption: str | None = None) -> str:
    """A LaTeX table of a (small) report, in a float of its own if it has a caption."""
    special = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$", "{": r"\{", "}": r"\}"}
    tex = lambda v: "".join(special.get(c, c) for c in (f"{v:.4f}" if isinstance(v, float) else str(v)))
    body = [" & ".join(map(tex, r)) + r" \\" for r in rows.select(*columns).collect()]
    table = [rf"\begin{{tabular}}{{{'l' * len(columns)}}}", " & ".join(map(tex, columns)) + r" \\ \hline", *body, r"\end{tabular}"]
    return "\n".join(table if caption is None else [r"\begin{table}", *table, rf"\caption{{{tex(caption)}}}", r"\end{table}"])


def markdown_table(rows: DataFrame, columns: list[str]) -> str:
    """A Markdown table of a (small) report; bars and line ends in values do not break its cells."""
    show = lambda v: (f"{v:.4f}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(map(show, columns)) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(map(show, r)) + " |" for r in rows.select(*columns).collect()]])


def finite_scores(scores: DataFrame, candidate: str = "candidate", score: str = "score") -> DataFrame:
    """The rows of candidates all of whose scores are finite."""
    good = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) < float("inf"))
    whole = scores.groupBy(candidate).agg(F.bool_and(good).alias("_good")).where("_good").select(candidate)
    return scores.join(whole, candidate, "left_semi")


def clean_points(rows: DataFrame, collapsed: str = "router_collapse_seeds") -> DataFrame:
    """The rows without a seed whose router sent all nodes one way."""
    return rows.where(F.coalesce(F.col(collapsed), F.lit(0)) <= 0)


def field_summary(rows: DataFrame, method: str, fields: list[str]) -> DataFrame:
    """(method, field, mean, std (population)) of each numeric field."""
    return rows.unpivot([method], fields, "field", "value").groupBy(method, "field").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def order_invariance(cells: DataFrame, forward: str, backward: str) -> DataFrame:
    """One row: how far accuracies of two conditions that differ in the experts' order alone are apart at most, and whether they are equal."""
    a = cells.where(F.col("cond") == forward).select("split", "seed", F.col("acc").alias("a"))
    b = cells.where(F.col("cond") == backward).select("split", "seed", F.col("acc").alias("b"))
    return a.join(b, ["split", "seed"]).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("most"), F.count("*").alias("n")).withColumn("invariant", F.col("most") <= 1e-12)


def interpretation(deltas: DataFrame, oracle: str, random: str, margin: float = 0.1, loss: float = 0.05) -> DataFrame:
    """``deltas`` with a verdict from how far the oracle is above the global expert and random routing below it."""
    passed = (F.col(oracle) > margin) & (F.col(random) < -loss)
    verdict = F.when(passed, F.format_string("routing pays: oracle %+.3f, random %+.3f", oracle, random)).when(F.col(oracle) > margin, "the oracle pays, random routing does no harm").otherwise("routing does not pay here")
    return deltas.withColumn("passed", passed).withColumn("verdict", verdict)


def write_record(rows: DataFrame, path: str) -> None:
    """A report as one JSON file in a folder; a report has few rows."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def append_points(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Points of a grid added to a folder of JSON lines by their keys: what is written stays if a later point fails."""
    rows.write.mode("append").partitionBy(*keys).json(path)


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """A report as CSV with a head line and its fields in the given order."""
    rows.select(*fields).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
