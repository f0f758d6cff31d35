"""Queries on tables of results: statistics, decisions, bands, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.hashing import sql_uniform
from graphloom.operators import reports as R
from graphloom.operators import stats as S
from graphloom.plans.graph_queries import r, rounded
from graphloom.plans.register import query
from graphloom.sources.tables import table

PRIORITY = {"1-URGENT": "oracle", "2-HIGH": "label_free", "3-MEDIUM": "random", "4-NOT SPECIFIED": "uniform", "5-LOW": "control"}
CELLS = f"""
WITH cells AS (
  SELECT cond, split, seed, round(avg(v), 9) AS acc
  FROM (SELECT CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY.items())} END AS cond, (o_custkey % 10)::INTEGER AS split, (o_orderkey % 3)::INTEGER AS seed, o_totalprice / 500000.0::DOUBLE AS v FROM orders)
  WHERE cond IS NOT NULL GROUP BY ALL
), means AS (SELECT cond, split, avg(acc) AS acc FROM cells GROUP BY ALL),
diffs AS (
  SELECT name, a.split, a.acc - b.acc AS d
  FROM (VALUES {', '.join(map(str, S.RULES))}) p(name, ca, cb)
  JOIN means a ON a.cond = ca JOIN means b ON b.cond = cb AND b.split = a.split
), control AS (SELECT a.split, a.acc - b.acc AS d FROM means a JOIN means b ON a.cond = 'control' AND b.cond = 'uniform' AND a.split = b.split)"""


def _cells_of(orders):
    """The mean price of orders as a result: the priority names the condition, keys name split and seed."""
    cond = F.when(F.lit(False), "")
    for priority, name in PRIORITY.items():
        cond = cond.when(F.col("o_orderpriority") == priority, name)
    return S.grouped_cells(orders, cond, F.col("o_custkey") % 10, F.col("o_orderkey") % 3, F.col("o_totalprice") / 500000.0)


def _cells(spark, folder):
    return _cells_of(table(spark, folder, "orders"))


@query("seed_split_means", CELLS + f"SELECT cond, split, {r('acc', 'acc')} FROM means")
def seed_split_means(spark, folder):
    return rounded(S.seed_means(_cells(spark, folder)))


@query("paired_differences", CELLS + f"SELECT name, split, {r('d', 'd')} FROM diffs")
def paired_differences(spark, folder):
    return rounded(S.paired(_cells(spark, folder), S.RULES))


@query("paired_effect_size", CELLS + f"SELECT name, {r('avg(d)', 'mean_diff')}, round(CASE WHEN stddev_pop(d) > 1e-12 THEN avg(d) / stddev_pop(d) ELSE 0 END, 3) + 0.0 AS dz, count(*)::BIGINT AS n_pairs FROM diffs GROUP BY name")
def paired_effect_size(spark, folder):
    return rounded(S.effect_sizes(S.paired(_cells(spark, folder), S.RULES))).withColumn("dz", F.round("dz", 3))


@query("mean_ci95", CELLS + f"SELECT name, {r('avg(d)', 'mean_diff')}, {r('avg(d) - 2.262157::DOUBLE * stddev_samp(d) / sqrt(count(*))', 'ci_low')}, {r('avg(d) + 2.262157::DOUBLE * stddev_samp(d) / sqrt(count(*))', 'ci_high')} FROM diffs GROUP BY name")
def mean_ci95(spark, folder):
    return rounded(S.mean_ci(S.paired(_cells(spark, folder), S.RULES), 2.262157))


# All sign patterns of 10 distinct ranks: the share with a rank sum no larger than the smaller of the two, doubled.
WILCOXON = CELLS + """, ranked AS (SELECT name, d, rank() OVER (PARTITION BY name ORDER BY round(abs(d), 12)) + (count(*) OVER (PARTITION BY name, round(abs(d), 12)) - 1) / 2.0::DOUBLE AS k, row_number() OVER (PARTITION BY name ORDER BY round(abs(d), 12), split) AS i FROM diffs WHERE abs(d) > 1e-12),
low AS (SELECT name, least(sum(k) FILTER (d > 0), sum(k) - coalesce(sum(k) FILTER (d > 0), 0)) AS low FROM ranked GROUP BY name),
patterns AS (SELECT unnest(range(0, 1024)) AS m),
sums AS (SELECT name, m, sum(CASE WHEN (m >> (i - 1)::INTEGER) & 1 = 1 THEN k ELSE 0 END) AS s FROM ranked, patterns GROUP BY ALL)"""


@query("wilcoxon_exact", WILCOXON + """
SELECT name, round(least(1, 2 * avg((s <= coalesce(low, 0) + 1e-9)::INTEGER::DOUBLE)), 9) + 0.0 AS p_wilcoxon FROM sums JOIN low USING (name) GROUP BY name""")
def wilcoxon_exact(spark, folder):
    return rounded(S.comparisons(S.paired(_cells(spark, folder), S.RULES)).select("name", "p_wilcoxon"), 9)


# Student's t with 9 degrees of freedom has a closed form; 2.2621571627409915 is its 97.5 % point.
COMPARED = WILCOXON + """, pw AS (SELECT name, least(1, 2 * avg((s <= coalesce(low, 0) + 1e-9)::INTEGER::DOUBLE)) AS p FROM sums JOIN low USING (name) GROUP BY name),
t AS (SELECT name, avg(d) AS m, stddev_samp(d) / sqrt(count(*)) AS se, stddev_pop(d) AS s0, count(*) AS n, atan(abs(avg(d)) / (stddev_samp(d) / sqrt(count(*))) / 3) AS th FROM diffs GROUP BY name)"""


def _holm_sql(source: str) -> str:
    return f", h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)::DOUBLE AS k FROM {source}), adj AS (SELECT *, least(1, max(k * p) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING)) AS p_holm FROM h)"


@query("protocol_table", COMPARED + _holm_sql("pw") + """
SELECT name, round(m, 9) + 0.0 AS mean_diff, round(m - 2.2621571627409915::DOUBLE * se, 9) + 0.0 AS ci_low, round(m + 2.2621571627409915::DOUBLE * se, 9) + 0.0 AS ci_high, round(p, 9) + 0.0 AS p_wilcoxon,
  round(1 - 2 / pi() * (th + sin(th) * (cos(th) + 2 / 3::DOUBLE * pow(cos(th), 3) + 8 / 15::DOUBLE * pow(cos(th), 5) + 16 / 35::DOUBLE * pow(cos(th), 7))), 9) + 0.0 AS p_paired_t,
  round(CASE WHEN s0 > 1e-12 THEN m / s0 ELSE 0 END, 3) + 0.0 AS effect_size_dz, n::INTEGER AS n_pairs, round(0.05::DOUBLE / k, 9) + 0.0 AS threshold, round(p_holm, 9) + 0.0 AS p_holm, p_holm <= 0.05::DOUBLE AS rejected
FROM adj JOIN t USING (name)""")
def protocol_table(spark, folder):
    return rounded(S.holm(S.comparisons(S.paired(_cells(spark, folder), S.RULES)), "p_wilcoxon"), 9).withColumn("effect_size_dz", F.round("effect_size_dz", 3))


TESTS = ", tests AS (SELECT c_name AS name, c_mktsegment AS fam, CASE WHEN c_custkey % 7 = 6 THEN NULL ELSE round(abs(c_acctbal) / 100000.0::DOUBLE, 9) END AS p FROM customer)"


def _tests(spark, folder):
    """A p-value for each customer, of their balance; some have none."""
    return table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("fam"), F.when(F.col("c_custkey") % 7 != 6, F.round(F.abs("c_acctbal") / 100000.0, 9)).alias("p"))


HOLM = TESTS + ", ranked AS (SELECT *, (count(*) OVER (PARTITION BY fam) - row_number() OVER (PARTITION BY fam ORDER BY p, name) + 1)::DOUBLE AS k FROM tests WHERE p IS NOT NULL), adj AS (SELECT *, least(1, max(k * p) OVER (PARTITION BY fam ORDER BY p, name ROWS UNBOUNDED PRECEDING)) AS p_holm FROM ranked)"


@query("holm_adjust", CELLS + HOLM + f"SELECT name, fam, round(p, 9) AS p, round(0.05::DOUBLE / k, 9) AS threshold, round(p_holm, 9) AS p_holm, p_holm <= 0.05::DOUBLE AS rejected FROM adj")
def holm_adjust(spark, folder):
    return rounded(S.holm(_tests(spark, folder), "p", ["fam"]), 9)


RULED = ", ".join(f"bool_or(ok) FILTER (name = '{d}') AS \"{d}\", round(max(p) FILTER (name = '{d}'), 6) + 0.0 AS \"{d}_p\"" for d in ("D1", "D2", "D3", "D4"))
FAILED = ", ".join(f"CASE WHEN NOT \"{d}\" THEN '{d}' END" for d in ("D1", "D2", "D3", "D4"))


@query("decision_rules", CELLS.replace("diffs AS (", "diffs AS (SELECT 'D4' AS name, a.split, a.acc - b.acc AS d FROM means a JOIN means b ON a.cond = 'control' AND b.cond = 'uniform' AND a.split = b.split UNION ALL ") + COMPARED.removeprefix(CELLS) + ", u AS (SELECT name, p, m FROM pw JOIN t USING (name))" + _holm_sql("u") + f""", w AS (SELECT {RULED} FROM (SELECT *, p_holm <= 0.05::DOUBLE AND m > 0 AS ok FROM adj))
SELECT *, CASE WHEN "D1" AND "D2" AND "D3" AND "D4" THEN 'supported' ELSE 'not supported: ' || concat_ws(', ', {FAILED}) END AS verdict FROM w""")
def decision_rules(spark, folder):
    cells = _cells(spark, folder)
    judge = lambda pairs: S.comparisons(S.paired(cells, pairs)).select("name", "mean_diff", F.col("p_wilcoxon").alias("p"))
    return rounded(S.decisions(judge(S.RULES), judge([("D1", "control", "uniform")])))


ORDERS = """
WITH o AS (SELECT o_orderpriority AS g, o_totalprice AS x, o_custkey::DOUBLE AS y, (o_orderkey % 97)::DOUBLE AS z FROM orders),
k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0::DOUBLE AS ry, rank() OVER (PARTITION BY g ORDER BY z) + (count(*) OVER (PARTITION BY g, z) - 1) / 2.0::DOUBLE AS rz FROM o)"""


def _orders(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), (F.col("o_orderkey") % 97).cast("double").alias("z"))


@query("spearman", ORDERS + f"SELECT g, {r('corr(rx, ry)', 'rho')}, count(*)::BIGINT AS n FROM k GROUP BY g")
def spearman(spark, folder):
    return rounded(S.spearman(_orders(spark, folder), "x", "y", "g"))


@query("partial_spearman", ORDERS + f"SELECT g, {r('(corr(rx, ry) - corr(rx, rz) * corr(ry, rz)) / sqrt((1 - corr(rx, rz) * corr(rx, rz)) * (1 - corr(ry, rz) * corr(ry, rz)))', 'rho')} FROM k GROUP BY g")
def partial_spearman(spark, folder):
    return rounded(S.partial_spearman(_orders(spark, folder), "x", "y", "z", "g"))


@query("loo_correlation", ORDERS.split(",\nk AS")[0] + f""", f AS (SELECT a.g AS left_out, o.x, o.y FROM (SELECT DISTINCT g FROM o) a JOIN o ON o.g <> a.g),
kf AS (SELECT left_out, rank() OVER (PARTITION BY left_out ORDER BY x) + (count(*) OVER (PARTITION BY left_out, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY left_out ORDER BY y) + (count(*) OVER (PARTITION BY left_out, y) - 1) / 2.0::DOUBLE AS ry FROM f)
SELECT left_out, {r('corr(rx, ry)', 'rho')} FROM kf GROUP BY left_out""")
def loo_correlation(spark, folder):
    return rounded(S.leave_one_out(_orders(spark, folder), "x", "y", "g"))


DRAWS = 200
WEIGHT = " + ".join(f"(u >= {p!r}::DOUBLE)::INTEGER" for p in S.POISSON)
BOOTSTRAP = f"""
WITH o AS (SELECT o_totalprice::DOUBLE AS x, o_custkey::DOUBLE AS y, o_custkey AS c FROM orders),
w AS (SELECT c, b, ({WEIGHT})::DOUBLE AS w FROM (SELECT c, b, {sql_uniform("'0'", 'c', 'b')} AS u FROM (SELECT DISTINCT c FROM o), (SELECT unnest(range(0, {DRAWS})) AS b))),
d AS (SELECT x, y, b, w FROM o JOIN w USING (c) WHERE w > 0),
vx AS (SELECT b, x, sum(s) OVER (PARTITION BY b ORDER BY x) - s + (s + 1) / 2 AS rx FROM (SELECT b, x, sum(w) AS s FROM d GROUP BY ALL)),
vy AS (SELECT b, y, sum(s) OVER (PARTITION BY b ORDER BY y) - s + (s + 1) / 2 AS ry FROM (SELECT b, y, sum(w) AS s FROM d GROUP BY ALL)),
m AS (SELECT b, sum(w) AS n, sum(w * rx) / sum(w) AS p, sum(w * ry) / sum(w) AS q, sum(w * rx * rx) / sum(w) AS pp, sum(w * ry * ry) / sum(w) AS qq, sum(w * rx * ry) / sum(w) AS pq FROM d JOIN vx USING (b, x) JOIN vy USING (b, y) GROUP BY b),
f AS (SELECT (pq - p * q) / sqrt((pp - p * p) * (qq - q * q)) AS rho FROM m),
k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM o)
SELECT (SELECT {r('corr(rx, ry)', 'rho').removesuffix(' AS rho')} FROM k) AS rho, {r('quantile_cont(rho, 0.025)', 'ci_low')}, {r('quantile_cont(rho, 0.975)', 'ci_high')},
  {r('least(1, 2 * least(avg((rho <= 0)::INTEGER::DOUBLE), avg((rho >= 0)::INTEGER::DOUBLE)))', 'p')} FROM f"""


@query("bootstrap_ci", BOOTSTRAP)
def bootstrap_ci(spark, folder):
    """Price against customer number over all orders, customers drawn as clusters."""
    rows = table(spark, folder, "orders").select(F.col("o_totalprice").cast("double").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.col("o_custkey").alias("c"))
    return rounded(S.bootstrap_spearman(rows, "x", "y", "c", draws=DRAWS))


FLAGS = {"A": "spectral", "N": "degree", "R": "random"}
RUNS = f""", runs AS (
  SELECT method, n, budget, seed, round(avg(l_discount), 9) AS err, round(avg(l_quantity) / 50.0::DOUBLE, 9) AS gap
  FROM (SELECT *, CASE l_returnflag {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FLAGS.items())} END AS method, (64 << (l_linenumber % 3)::INTEGER)::INTEGER AS n, (l_suppkey % 2 * 2 + 2)::DOUBLE AS budget, (l_orderkey % 5)::INTEGER AS seed FROM lineitem)
  WHERE method IS NOT NULL GROUP BY ALL)"""


def _runs(spark, folder):
    """Mean discounts and quantities of lines as a ladder's results: the flag names the method, keys name size, budget and seed."""
    method = F.when(F.lit(False), "")
    for flag, name in FLAGS.items():
        method = method.when(F.col("l_returnflag") == flag, name)
    rows = table(spark, folder, "lineitem").select(method.alias("method"), F.lit(64).cast("int").alias("base"), "l_linenumber", ((F.col("l_suppkey") % 2) * 2 + 2).cast("double").alias("budget"), (F.col("l_orderkey") % 5).cast("int").alias("seed"), "l_discount", "l_quantity")
    rows = rows.withColumn("n", F.expr("shiftleft(base, CAST(l_linenumber % 3 AS INT))")).where("method IS NOT NULL")
    return rows.groupBy("method", "n", "budget", "seed").agg(F.round(F.avg("l_discount"), 9).alias("err"), F.round(F.avg("l_quantity") / 50.0, 9).alias("gap"))


@query("bands", CELLS + RUNS + f", long AS (SELECT n, budget, method, 'err' AS metric, err AS value FROM runs UNION ALL SELECT n, budget, method, 'gap', gap FROM runs) SELECT n, budget, method, metric, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')}, {r('min(value)', 'least')}, {r('max(value)', 'most')}, count(value)::BIGINT AS n_1 FROM long GROUP BY n, budget, method, metric")
def bands(spark, folder):
    found = R.bands(_runs(spark, folder).withColumnRenamed("n", "size"), ["size", "budget"], "method", ["err", "gap"])
    return rounded(found.withColumnRenamed("n", "n_1").withColumnRenamed("size", "n"))


@query("check_bands_pivot", CELLS + RUNS + ", m AS (SELECT n, budget, round(avg(err) FILTER (method = 'spectral'), 9) AS s, round(avg(err) FILTER (method = 'degree'), 9) AS d, round(avg(err) FILTER (method = 'random'), 9) AS u FROM runs GROUP BY ALL) SELECT n, budget, s < d AS below_degree, s < u AS below_random, s < d AND s < u AS below_all FROM m")
def check_bands_pivot(spark, folder):
    return R.check_bands(_runs(spark, folder), ["n", "budget"], "method", "err", "spectral", ["degree", "random"])


@query("win_counts", CELLS + RUNS + f", m AS (SELECT n, budget, avg(err) FILTER (method = 'spectral') AS s, avg(err) FILTER (method = 'degree') AS d, avg(err) FILTER (method = 'random') AS u FROM runs GROUP BY ALL) SELECT count(*)::BIGINT AS points, count(*) FILTER (s < d)::BIGINT AS n_below_degree, count(*) FILTER (s < d AND s < u)::BIGINT AS n_below_all, {r('avg((s < d AND s < u)::INTEGER::DOUBLE)', 'share')}, bool_and(s < d AND s < u) AS everywhere FROM m")
def win_counts(spark, folder):
    checked = R.check_bands(_runs(spark, folder), ["n", "budget"], "method", "err", "spectral", ["degree", "random"])
    return rounded(R.win_counts(checked, ["below_degree", "below_all"]))


@query("rung_summary", CELLS + RUNS + f"SELECT budget, {r('avg(err)', 'mean')}, {r('stddev_samp(err)', 'std')} FROM runs GROUP BY budget")
def rung_summary(spark, folder):
    return rounded(R.rung_summary(_runs(spark, folder), "budget", "err"))


@query("table2_wide", CELLS + RUNS + f"SELECT n, {r('''avg(err) FILTER (method = 'degree')''', 'degree')}, {r('''avg(err) FILTER (method = 'random')''', 'random')}, {r('''avg(err) FILTER (method = 'spectral')''', 'spectral')} FROM runs GROUP BY n")
def table2_wide(spark, folder):
    return rounded(R.wide_table(_runs(spark, folder), ["n"], "method", ["degree", "random", "spectral"], "err"))


@query("monotone_by_method", CELLS + RUNS + ", m AS (SELECT method, n, avg(err) AS e FROM runs GROUP BY ALL), l AS (SELECT method, lag(e) OVER (PARTITION BY method ORDER BY n DESC) <= e OR lag(e) OVER (PARTITION BY method ORDER BY n DESC) IS NULL AS up FROM m) SELECT method, bool_and(up) AS monotone FROM l GROUP BY method")
def monotone_by_method(spark, folder):
    return S.monotone(_runs(spark, folder).groupBy("method", "n").agg(F.avg("err").alias("e")), "method", "n", "e")


@query("mean_gain", CELLS + f"SELECT {r('avg(a.acc - b.acc)', 'gain')}, count(*)::BIGINT AS n FROM cells a JOIN cells b USING (split, seed) WHERE a.cond = 'oracle' AND b.cond = 'uniform'")
def mean_gain(spark, folder):
    return rounded(R.mean_gain(_cells(spark, folder), "oracle", "uniform"))


@query("loo_k_selection", CELLS + RUNS + ", kr AS (SELECT n AS k, seed AS split, avg(err) AS acc FROM runs GROUP BY ALL), o AS (SELECT *, round((sum(acc) OVER (PARTITION BY k) - acc) / (count(*) OVER (PARTITION BY k) - 1), 9) AS rest FROM kr) SELECT split, k, round(acc, 6) + 0.0 AS acc FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY rest DESC, k) AS i FROM o) WHERE i = 1")
def loo_k_selection(spark, folder):
    rows = _runs(spark, folder).groupBy(F.col("n").alias("k"), F.col("seed").alias("split")).agg(F.avg("err").alias("acc"))
    return rounded(S.leave_one_split_k(rows))


@query("thresholds_existence", CELLS + RUNS + "SELECT min(n) FILTER (gap > 0.51::DOUBLE)::INTEGER AS existence, min(n) FILTER (gap > 0.53::DOUBLE)::INTEGER AS deployable FROM runs")
def thresholds_existence(spark, folder):
    return S.first_thresholds(_runs(spark, folder).withColumn("a", F.col("gap") > 0.51).withColumn("b", F.col("gap") > 0.53), "n", "a", "b")


@query("ladder_resume", CELLS + RUNS + "SELECT DISTINCT method, n, budget FROM runs WHERE NOT (method = 'degree' AND n < 200)")
def ladder_resume(spark, folder):
    grid = _runs(spark, folder).select("method", "n", "budget").distinct()
    return R.remaining(grid, grid.where("method = 'degree' AND n < 200"), ["method", "n", "budget"])


@query("distinct_rounded", "SELECT count(DISTINCT round(l_discount * l_tax, 3))::BIGINT AS n_distinct FROM lineitem")
def distinct_rounded(spark, folder):
    return R.distinct_rounded(table(spark, folder, "lineitem").select((F.col("l_discount") * F.col("l_tax")).alias("v")), "v", 3)


@query("purity_mapping", f"WITH c AS (SELECT o_orderstatus AS grp, (o_custkey % 4)::INTEGER AS col, count(*) AS n FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, col) AS i, sum(n) OVER (PARTITION BY grp) AS size FROM c) SELECT grp, col, n::BIGINT AS n, {r('n / size::DOUBLE', 'purity')} FROM k WHERE i = 1")
def purity_mapping(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("grp"), (F.col("o_custkey") % 4).cast("int").alias("col"))
    return rounded(R.purity_mapping(rows, "grp", "col"))


@query("pooled_and_each", f"SELECT coalesce(c_mktsegment, 'all') AS segment, {r('avg(c_acctbal)', 'mean')} FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())")
def pooled_and_each(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return rounded(R.pooled_and_each(rows, "segment", F.avg("c_acctbal"), "mean"))


@query("json_fields", "SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce(props->>'$.none', '-') AS missing FROM events")
def json_fields(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("-")).alias("missing"))
