"""Queries on graphs: contract, scores, sparsifiers, routing, splits, components, attention, generators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import graph as G
from graphloom.functions.hashing import sql_uniform
from graphloom.operators import attention as A
from graphloom.operators import components as C
from graphloom.operators import generators as B
from graphloom.operators import passages as P
from graphloom.operators import routing as R
from graphloom.operators import scores as S
from graphloom.operators import sparsify as X
from graphloom.operators import splits as L
from graphloom.plans.register import query
from graphloom.sources.tables import activity, embedding_graph, part_graph, table

D, RETENTIONS = 3, [0.2, 0.5, 0.8]
BASE = """
nodes AS (
  SELECT p_partkey AS node_id, (replace(p_brand, 'Brand#', '')::INTEGER % 5)::INTEGER AS y,
         [p_size / 50.0::DOUBLE, (p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE, replace(p_brand, 'Brand#', '')::INTEGER / 25.0::DOUBLE] AS x
  FROM part
), part_lines AS (
  SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL
), edges AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst, sum(a.q * b.q) / 2500.0::DOUBLE AS w
  FROM part_lines a JOIN part_lines b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL
), sym AS (
  SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges
), deg AS (
  SELECT node_id, coalesce(deg, 0)::BIGINT AS deg, coalesce(wdeg, 0)::DOUBLE AS wdeg
  FROM nodes LEFT JOIN (SELECT src AS node_id, count(*) AS deg, sum(w) AS wdeg FROM sym GROUP BY src) USING (node_id)
)"""
HOM = """, hom AS (
  SELECT n.node_id, h.h FROM nodes n LEFT JOIN (
    SELECT s.src AS node_id, avg((a.y = b.y)::INTEGER::DOUBLE) AS h
    FROM sym s JOIN nodes a ON a.node_id = s.src JOIN nodes b ON b.node_id = s.dst GROUP BY s.src) h USING (node_id)
)"""


def sql(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE}{''.join(ctes)} {select}"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, also inside arrays, so that the order of sums doesn't show."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append((F.round(name, places) + F.lit(0.0)).alias(name))
        elif kind == "array<double>":
            out.append(F.transform(name, lambda v: F.round(v, places) + F.lit(0.0)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


EMB = """
WITH e AS (SELECT vec_id AS node_id, label AS y, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
pairs AS (
  SELECT a.node_id AS query, b.node_id AS key,
         round(list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))), 9) AS p
  FROM e a JOIN e b ON a.node_id <> b.node_id
), kept AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY p DESC) AS k FROM pairs) WHERE k <= 8),
edges AS (
  SELECT least(query, key) AS src, greatest(query, key) AS dst, sum(greatest(p, 0)) / 2 AS w FROM kept GROUP BY ALL HAVING sum(greatest(p, 0)) > 0
), sym AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)"""
EMB_HOM = EMB + """, hom AS (
  SELECT n.node_id, round(h.h, 9) AS h FROM e n LEFT JOIN (
    SELECT s.src AS node_id, avg((a.y = b.y)::INTEGER::DOUBLE) AS h FROM sym s JOIN e a ON a.node_id = s.src JOIN e b ON b.node_id = s.dst GROUP BY s.src) h USING (node_id)
), q AS (SELECT quantile_cont(h, 1.0/3) AS lo, quantile_cont(h, 2.0/3) AS hi FROM hom),
b AS (SELECT CASE WHEN lo IS NULL OR lo >= hi THEN 0.4 ELSE lo END::DOUBLE AS lo, CASE WHEN lo IS NULL OR lo >= hi THEN 0.6 ELSE hi END::DOUBLE AS hi FROM q)"""


def _fixed(df: DataFrame, name: str = "h") -> DataFrame:
    """Scores rounded before they are bucketed, so that rounding errors cross no bound."""
    return df.withColumn(name, F.round(name, 9))


@query("emb_homophily_route", EMB_HOM + "SELECT node_id, h, CASE WHEN h IS NULL THEN 0 WHEN h >= hi THEN 0 WHEN h <= lo THEN 2 ELSE 1 END::INTEGER AS channel FROM hom, b")
def emb_homophily_route(spark, folder):
    h = _fixed(S.label_homophily(embedding_graph(spark, folder)))
    return h.join(R.with_channel(R.bucket_by_homophily(h, adaptive=True)), "node_id").select("node_id", "h", "channel")


@query("graph_adjacency", EMB + f"SELECT src, dst, {r('w', 'w')} FROM edges")
def graph_adjacency(spark, folder):
    return rounded(embedding_graph(spark, folder).edges)


@query("graph_edges", sql(f"SELECT src, dst, {r('w', 'w')} FROM edges"))
def graph_edges(spark, folder):
    return rounded(part_graph(spark, folder).edges)


@query("graph_degree", sql(f"SELECT node_id, deg, {r('wdeg', 'wdeg')} FROM deg"))
def graph_degree(spark, folder):
    return rounded(G.degrees(part_graph(spark, folder)))


@query("graph_laplacian", sql(f"SELECT node_id AS row, node_id AS col, {r('wdeg', 'val')} FROM deg WHERE wdeg > 0 UNION ALL SELECT src, dst, {r('-w', 'val')} FROM sym"))
def graph_laplacian(spark, folder):
    return rounded(G.laplacian(part_graph(spark, folder)))


@query("graph_norm_adj", sql(f"SELECT node_id AS row, node_id AS col, {r('1 / (1 + wdeg)', 'val')} FROM deg UNION ALL SELECT s.src, s.dst, {r('s.w / sqrt((1 + a.wdeg) * (1 + b.wdeg))', 'val')} FROM sym s JOIN deg a ON a.node_id = s.src JOIN deg b ON b.node_id = s.dst"))
def graph_norm_adj(spark, folder):
    return rounded(G.normalized_adjacency(part_graph(spark, folder)))


@query("quadratic_form", sql(f"SELECT {r('sum(e.w * (a.y - b.y) * (a.y - b.y))', 'energy')} FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst"))
def quadratic_form(spark, folder):
    g = part_graph(spark, folder)
    return rounded(G.quadratic_form(g, g.nodes.select("node_id", F.col("y").cast("double").alias("f"))))


@query("contract_check", sql("SELECT count(*) FILTER (src >= dst)::BIGINT AS unordered, count(*) FILTER (NOT w > 0)::BIGINT AS non_positive, (SELECT count(*) FROM (SELECT src, dst FROM edges GROUP BY ALL HAVING count(*) > 1))::BIGINT AS repeated, (SELECT count(*) FROM (SELECT DISTINCT src FROM sym) WHERE src NOT IN (SELECT node_id FROM nodes))::BIGINT AS dangling FROM edges"))
def contract_check(spark, folder):
    return G.contract_violations(part_graph(spark, folder))


@query("induced_subgraph", sql(f"SELECT src, dst, {r('w', 'w')} FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE y < 3) AND dst IN (SELECT node_id FROM nodes WHERE y < 3)"))
def induced_subgraph(spark, folder):
    g = part_graph(spark, folder)
    return rounded(G.induced(g, g.nodes.where("y < 3")).edges)


@query("pairs_to_edges", "SELECT DISTINCT least(user_id, event_id % 150) AS src, greatest(user_id, event_id % 150) AS dst, 1.0::DOUBLE AS w FROM events WHERE user_id <> event_id % 150")
def pairs_to_edges(spark, folder):
    return G.edges_from_pairs(table(spark, folder, "events").select("user_id", (F.col("event_id") % 150).alias("other")), "user_id", "other")


@query("label_homophily", sql(f"SELECT node_id, {r('h', 'h')} FROM hom", HOM))
def label_homophily(spark, folder):
    return rounded(S.label_homophily(part_graph(spark, folder)))


@query("mean_homophily", sql(f"SELECT {r('avg(h)', 'mean_h')}, count(h)::BIGINT AS n_defined FROM hom", HOM))
def mean_homophily(spark, folder):
    return rounded(S.mean_homophily(part_graph(spark, folder)))


UNITS = """, units AS (
  SELECT node_id, list_transform(x, lambda v: v / greatest(sqrt(list_dot_product(x, x)), 1e-8)) AS u FROM nodes
)"""


@query("feature_homophily", sql(f"SELECT n.node_id, {r('coalesce(h.hx, 0)', 'hx')} FROM nodes n LEFT JOIN (SELECT s.src AS node_id, avg(list_dot_product(a.u, b.u)) AS hx FROM sym s JOIN units a ON a.node_id = s.src JOIN units b ON b.node_id = s.dst GROUP BY s.src) h USING (node_id)", UNITS))
def feature_homophily(spark, folder):
    return rounded(S.feature_homophily(part_graph(spark, folder), D))


@query("boundary_score", sql(f"SELECT n.node_id, {r('coalesce(h.b, 0)', 'boundary')} FROM nodes n LEFT JOIN (SELECT s.src AS node_id, count(*) FILTER (a.y <> b.y) / greatest(sum(s.w), 1) AS b FROM sym s JOIN nodes a ON a.node_id = s.src JOIN nodes b ON b.node_id = s.dst GROUP BY s.src) h USING (node_id)"))
def boundary_score(spark, folder):
    return rounded(S.boundary_score(part_graph(spark, folder), "y"))


@query("budget_homophily", sql(f"SELECT n.node_id, {r('h.hn', 'hn')} FROM nodes n LEFT JOIN (SELECT s.src AS node_id, count(*) FILTER (a.y = b.y) / greatest(1, least(4, any_value(c.size) - 1))::DOUBLE AS hn FROM sym s JOIN nodes a ON a.node_id = s.src JOIN nodes b ON b.node_id = s.dst JOIN (SELECT y, count(*) AS size FROM nodes GROUP BY y) c ON c.y = a.y GROUP BY s.src) h USING (node_id)"))
def budget_homophily(spark, folder):
    return rounded(S.budget_homophily(part_graph(spark, folder), 4))


MEANS = ", m AS (SELECT avg(x[1]) AS m1, avg(x[2]) AS m2, avg(x[3]) AS m3 FROM nodes)"


@query("score_feat_anomaly", sql(f"SELECT node_id, {r('-sqrt((x[1]-m1)*(x[1]-m1) + (x[2]-m2)*(x[2]-m2) + (x[3]-m3)*(x[3]-m3))', 'feat_anomaly')} FROM nodes, m", MEANS))
def score_feat_anomaly(spark, folder):
    return rounded(S.feature_anomaly(part_graph(spark, folder), D))


@query("score_feat_var", sql(f"SELECT n.node_id, {r('coalesce(v, 0)', 'feat_var')} FROM nodes n LEFT JOIN (SELECT s.src AS node_id, CASE WHEN count(*) > 1 THEN (var_pop(u[1]) + var_pop(u[2]) + var_pop(u[3])) / 3 ELSE 0 END AS v FROM sym s JOIN units b ON b.node_id = s.dst GROUP BY s.src) h USING (node_id)", UNITS))
def score_feat_var(spark, folder):
    return rounded(S.neighbour_feature_variance(part_graph(spark, folder), D))


@query("score_degree_family", sql(f"""SELECT d.node_id, d.deg::DOUBLE AS degree, {r('coalesce(nd, 0)', 'neigh_degree')}, {r('ln(1 + d.deg)', 'log_degree')}, {r('coalesce(dis, 0)', 'neigh_deg_dissimilarity')},
  {r('coalesce(-sq / t.total / d.deg, 0)', 'inv_walk2_mixing')}, {r('greatest(0, least(1, (d.wdeg - 2) / (d.wdeg + 1)))', 'degree_proxy')}
  FROM deg d CROSS JOIN (SELECT sum(deg) AS total FROM deg) t LEFT JOIN (SELECT s.src AS node_id, avg(b.deg::DOUBLE) AS nd, -avg(abs(b.deg - a.deg)::DOUBLE) AS dis, sum(b.deg * b.deg)::DOUBLE AS sq FROM sym s JOIN deg a ON a.node_id = s.src JOIN deg b ON b.node_id = s.dst GROUP BY s.src) h ON h.node_id = d.node_id"""))
def score_degree_family(spark, folder):
    return rounded(S.degree_family(part_graph(spark, folder)))


TRIANGLES = """, tri AS (
  SELECT a.src AS i, a.dst AS j, b.dst AS k FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst
), corner AS (SELECT i AS node_id, i, j, k FROM tri UNION ALL SELECT j, i, j, k FROM tri UNION ALL SELECT k, i, j, k FROM tri),
side AS (SELECT DISTINCT node_id, nb FROM (SELECT node_id, unnest([i, j, k]) AS nb FROM corner) WHERE nb <> node_id)"""


@query("score_triangles", sql(f"""SELECT d.node_id, coalesce(t.n, 0)::BIGINT AS triangles, coalesce(s.n, 0)::BIGINT AS triangle_support, {r('CASE WHEN d.deg > 1 THEN coalesce(s.n, 0) / (d.deg * (d.deg - 1))::DOUBLE ELSE 0 END', 'local_clustering')}
  FROM deg d LEFT JOIN (SELECT node_id, count(*) AS n FROM corner GROUP BY node_id) t USING (node_id) LEFT JOIN (SELECT node_id, count(*) AS n FROM side GROUP BY node_id) s USING (node_id)""", TRIANGLES))
def score_triangles(spark, folder):
    return rounded(S.triangles(part_graph(spark, folder)))


def _step(name: str, before: str) -> str:
    return f""", {name} AS (
  SELECT node_id, [sum(v[1]), sum(v[2]), sum(v[3])] AS x FROM (
    SELECT s.src AS node_id, list_transform(p.x, lambda v: v * s.w / sqrt((1 + a.wdeg) * (1 + b.wdeg))) AS v
    FROM sym s JOIN {before} p ON p.node_id = s.dst JOIN deg a ON a.node_id = s.src JOIN deg b ON b.node_id = s.dst
    UNION ALL SELECT p.node_id, list_transform(p.x, lambda v: v / (1 + d.wdeg)) FROM {before} p JOIN deg d USING (node_id)
  ) GROUP BY node_id
)"""


ROUND = "list_transform({}, lambda v: round(v, 6) + 0.0)"


@query("propagate_1hop", sql(f"SELECT node_id, {ROUND.format('x')} AS x FROM p1", _step("p1", "nodes")))
def propagate_1hop(spark, folder):
    g = part_graph(spark, folder)
    return rounded(S.propagate(g, g.nodes.select("node_id", "x"), D))


GATE = "list_concat(n.x, list_concat(list_transform(list_zip(a.x, n.x), lambda z: abs(z[1] - z[2])), list_transform(list_zip(b.x, n.x), lambda z: abs(z[1] - z[2]))))"


@query("router_gate_features", sql(f"SELECT n.node_id, {ROUND.format(GATE)} AS gate FROM nodes n JOIN p1 a USING (node_id) JOIN p2 b USING (node_id)", _step("p1", "nodes"), _step("p2", "p1")))
def router_gate_features(spark, folder):
    return rounded(S.router_features(part_graph(spark, folder), D))


def _cos(p: str) -> str:
    return f"greatest(-1, least(1, list_dot_product(n.x, {p}.x) / greatest(sqrt(list_dot_product(n.x, n.x)) * sqrt(list_dot_product({p}.x, {p}.x)), 1e-8)))"


@query("signal_preservation", sql(f"SELECT n.node_id, {r(f'least({_cos("a")}, {_cos("b")})', 'spf')} FROM nodes n JOIN p1 a USING (node_id) JOIN p2 b USING (node_id)", _step("p1", "nodes"), _step("p2", "p1")))
def signal_preservation(spark, folder):
    return rounded(S.signal_preservation(part_graph(spark, folder), D))


@query("cheb_basis_k2", sql(f"SELECT n.node_id, {ROUND.format('n.x')} AS t0, {ROUND.format('list_transform(a.x, lambda v: -v)')} AS t1, {ROUND.format('list_transform(list_zip(b.x, n.x), lambda z: 2 * z[1] - z[2])')} AS t2 FROM nodes n JOIN p1 a USING (node_id) JOIN p2 b USING (node_id)", _step("p1", "nodes"), _step("p2", "p1")))
def cheb_basis_k2(spark, folder):
    return rounded(S.chebyshev(part_graph(spark, folder), D, 2))


def _pagerank_sql(rounds: int) -> str:
    out = ", total AS (SELECT count(*)::DOUBLE AS n FROM nodes), k0 AS MATERIALIZED (SELECT node_id, 1 / n AS rank FROM nodes, total)"
    for i in range(1, rounds + 1):
        out += f", k{i} AS MATERIALIZED (SELECT d.node_id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM deg d CROSS JOIN total LEFT JOIN (SELECT s.dst AS node_id, sum(k.rank / a.deg) AS got FROM sym s JOIN k{i - 1} k ON k.node_id = s.src JOIN deg a ON a.node_id = s.src GROUP BY s.dst) g ON g.node_id = d.node_id)"
    return out


@query("pagerank_10", sql("SELECT node_id, round(rank, 9) + 0.0 AS rank FROM k10", _pagerank_sql(10)))
def pagerank_10(spark, folder):
    return rounded(S.pagerank(part_graph(spark, folder), rounds=10), 9)


NAMED = """, both_ways AS (SELECT src, dst FROM strong UNION ALL SELECT dst, src FROM strong),
reach AS (SELECT node_id, node_id AS root FROM nodes UNION SELECT b.dst, r.root FROM reach r JOIN both_ways b ON b.src = r.node_id WHERE r.root < b.dst),
named AS (SELECT node_id, min(root) AS component FROM reach GROUP BY node_id)"""
STRONG = ", strong AS (SELECT * FROM edges WHERE w > 0.6::DOUBLE)" + NAMED


def _strong(spark, folder) -> G.Graph:
    g = part_graph(spark, folder)
    return G.Graph(g.nodes, X.threshold(g.edges, 0.6))


@query("connected_components", sql("SELECT node_id, component FROM named", STRONG, recursive=True))
def connected_components(spark, folder):
    return C.connected_components(_strong(spark, folder))


@query("largest_component", sql("SELECT node_id FROM named WHERE component = (SELECT component FROM named GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)", STRONG, recursive=True))
def largest_component(spark, folder):
    return C.largest_component(_strong(spark, folder))


@query("connectivity_report", sql("SELECT (SELECT count(DISTINCT component) FROM named)::BIGINT AS zeros_reference, (SELECT count(*) FROM nodes)::BIGINT AS zeros_other, ((SELECT count(*) FROM nodes) - (SELECT count(DISTINCT component) FROM named))::BIGINT AS gained", STRONG, recursive=True))
def connectivity_report(spark, folder):
    g = _strong(spark, folder)
    return C.connectivity_report(g, G.Graph(g.nodes, g.edges.limit(0)))


EDGE = f"src, dst, {r('w', 'w')}"


@query("sparsify_threshold", sql(f"SELECT {EDGE} FROM edges WHERE w > 0.5::DOUBLE"))
def sparsify_threshold(spark, folder):
    return rounded(X.threshold(part_graph(spark, folder).edges, 0.5))


@query("sparsify_tau_budget", sql(f"SELECT {EDGE} FROM edges WHERE w > (SELECT w FROM edges ORDER BY w DESC, src, dst LIMIT 1 OFFSET 999)"))
def sparsify_tau_budget(spark, folder):
    return rounded(X.threshold_for_budget(part_graph(spark, folder).edges, 1000))


BY_HASH = f", hashed AS (SELECT src, dst, w, row_number() OVER (ORDER BY {sql_uniform('0', 'src', 'dst')}, src, dst) AS k, count(*) OVER () AS n FROM edges)"
BY_DEGREE = ", scored AS (SELECT e.src, e.dst, e.w, row_number() OVER (ORDER BY round((a.wdeg + 1) * (b.wdeg + 1), 6) DESC, e.src, e.dst) AS k, count(*) OVER () AS n FROM edges e JOIN deg a ON a.node_id = e.src JOIN deg b ON b.node_id = e.dst)"
BY_WEIGHT = ", heavy AS (SELECT src, dst, w, row_number() OVER (ORDER BY w DESC, src, dst) AS k, count(*) OVER () AS n FROM edges)"


@query("sparsify_random", sql(f"SELECT src, dst, {r('w * (n / 1000.0::DOUBLE)', 'w')} FROM hashed WHERE k <= 1000", BY_HASH))
def sparsify_random(spark, folder):
    return rounded(X.random_edges(part_graph(spark, folder).edges, 1000))


@query("sparsify_degree", sql(f"SELECT {EDGE} FROM scored WHERE k <= 1000", BY_DEGREE))
def sparsify_degree(spark, folder):
    return rounded(X.degree_edges(part_graph(spark, folder), 1000))


@query("sparsify_business_rule", sql(f"SELECT {EDGE} FROM edges WHERE 1.0::DOUBLE / (1 + abs(src - dst) % 7) >= 0.3::DOUBLE"))
def sparsify_business_rule(spark, folder):
    edges = part_graph(spark, folder).edges.withColumn("r", F.lit(1e9))  # all q are 1 but where the rule forbids
    rule = 1.0 / (1 + F.abs(F.col("src") - F.col("dst")) % 7)
    return rounded(X.spectral_edges(edges, 1000, 10**9, rule=rule, least=0.3))


@query("mass_match", sql(f"SELECT src, dst, {r('w * (SELECT sum(w) FROM edges) / (SELECT sum(w) FROM edges WHERE w > 0.5::DOUBLE)', 'w')} FROM edges WHERE w > 0.5::DOUBLE"))
def mass_match(spark, folder):
    edges = part_graph(spark, folder).edges
    return rounded(X.mass_match(X.threshold(edges, 0.5), edges))


GRID = ", points AS (SELECT unnest([0.2, 0.5, 0.8])::DOUBLE AS retention), budgets AS (SELECT retention, round_even(retention * (SELECT count(*) FROM edges), 0) AS b FROM points)"


@query("retention_grid", sql(f"""SELECT 'random' AS method, retention, src, dst, {r('w * (n / b)', 'w')} FROM hashed, budgets WHERE k <= b
  UNION ALL SELECT 'degree', retention, src, dst, {r('w', 'w')} FROM scored, budgets WHERE k <= b
  UNION ALL SELECT 'weight', retention, src, dst, {r('w', 'w')} FROM heavy, budgets WHERE k <= b""", BY_HASH, BY_DEGREE, BY_WEIGHT, GRID))
def retention_grid(spark, folder):
    return rounded(X.retention_grid(part_graph(spark, folder), RETENTIONS))


@query("edges_kept_summary", sql(f"""SELECT method, retention, count(*)::BIGINT AS n_kept, {r('sum(w)', 'mass')} FROM (SELECT 'random' AS method, retention, w * (n / b) AS w FROM hashed, budgets WHERE k <= b
  UNION ALL SELECT 'degree', retention, w FROM scored, budgets WHERE k <= b UNION ALL SELECT 'weight', retention, w FROM heavy, budgets WHERE k <= b) GROUP BY ALL""", BY_HASH, BY_DEGREE, BY_WEIGHT, GRID))
def edges_kept_summary(spark, folder):
    grid = X.retention_grid(part_graph(spark, folder), RETENTIONS)
    return rounded(grid.groupBy("method", "retention").agg(F.count("*").alias("n_kept"), F.sum("w").alias("mass")))


@query("frobenius_delta", sql(f"SELECT {r('sqrt((SELECT sum(d * d) FROM (SELECT src, sum(w) AS d FROM sym WHERE w <= 0.5::DOUBLE GROUP BY src)) + 2 * (SELECT sum(w * w) FROM edges WHERE w <= 0.5::DOUBLE))', 'frobenius')}"))
def frobenius_delta(spark, folder):
    edges = part_graph(spark, folder).edges
    return rounded(X.frobenius_delta(edges, X.threshold(edges, 0.5)))


ROUTED = HOM.replace("SELECT n.node_id, h.h FROM", "SELECT n.node_id, round(h.h, 9) AS h FROM") + """, qh AS (SELECT quantile_cont(h, 1.0/3) AS lo, quantile_cont(h, 2.0/3) AS hi, min(h) AS mn, max(h) AS mx FROM hom),
bq AS (SELECT CASE WHEN lo >= hi THEN mn ELSE lo END AS lo, CASE WHEN lo >= hi THEN mx ELSE hi END AS hi FROM qh),
quant AS (SELECT node_id, CASE WHEN lo >= hi THEN 0 WHEN h >= hi THEN 0 WHEN h <= lo THEN 2 ELSE 1 END AS channel FROM hom, bq),
fixed AS (SELECT node_id, CASE WHEN h IS NULL THEN 0 WHEN h >= 0.6::DOUBLE THEN 0 WHEN h <= 0.4::DOUBLE THEN 2 ELSE 1 END AS channel FROM hom)"""


def _scores(spark, folder) -> DataFrame:
    return _fixed(S.label_homophily(part_graph(spark, folder)))


@query("assign_quantile", sql("SELECT node_id, channel::INTEGER AS channel FROM quant", ROUTED))
def assign_quantile(spark, folder):
    return R.with_channel(R.bucket_by_quantile(_scores(spark, folder), "h")).select("node_id", "channel")


@query("assign_quantile_unguarded", sql("SELECT node_id, CASE WHEN h >= hi THEN 0 WHEN h <= lo THEN 2 ELSE 1 END::INTEGER AS channel FROM (SELECT node_id, round(h, 9) AS h FROM hom), (SELECT quantile_cont(round(h, 9), 1.0/3) AS lo, quantile_cont(round(h, 9), 2.0/3) AS hi FROM hom WHERE h IS NOT NULL)", HOM))
def assign_quantile_unguarded(spark, folder):
    return R.with_channel(R.bucket_by_quantile(_scores(spark, folder), "h", guarded=False)).select("node_id", "channel")


@query("assign_fixed", sql("SELECT node_id, channel::INTEGER AS channel FROM fixed", ROUTED))
def assign_fixed(spark, folder):
    return R.with_channel(R.bucket_by_homophily(_scores(spark, folder))).select("node_id", "channel")


@query("assign_regime", sql("SELECT node_id, [(least(y, 2) = 0)::INTEGER::DOUBLE, (least(y, 2) = 1)::INTEGER::DOUBLE, (least(y, 2) = 2)::INTEGER::DOUBLE] AS gates FROM nodes"))
def assign_regime(spark, folder):
    return R.by_regime(part_graph(spark, folder).nodes, "y")


@query("assign_uniform", sql("SELECT node_id, [round(1.0::DOUBLE / 3, 6), round(1.0::DOUBLE / 3, 6), round(1.0::DOUBLE / 3, 6)] AS gates, 0::INTEGER AS channel FROM nodes"))
def assign_uniform(spark, folder):
    return rounded(R.with_channel(R.uniform_gates(part_graph(spark, folder).nodes)))


SHARES = ", sh AS (SELECT avg((channel = 0)::INTEGER::DOUBLE) AS s0, avg((channel = 1)::INTEGER::DOUBLE) AS s1 FROM quant)"
DRAWN = f", drawn AS (SELECT node_id, CASE WHEN {sql_uniform('0', 'node_id')} < s0 THEN 0 WHEN {sql_uniform('0', 'node_id')} < s0 + s1 THEN 1 ELSE 2 END AS channel FROM nodes, sh)"


@query("assign_random_usage", sql("SELECT node_id, channel::INTEGER AS channel FROM drawn", ROUTED, SHARES, DRAWN))
def assign_random_usage(spark, folder):
    return R.with_channel(R.random_like(R.bucket_by_quantile(_scores(spark, folder), "h"))).select("node_id", "channel")


@query("assign_ad_gnn", sql(f"SELECT node_id, CASE WHEN lo >= hi THEN 0 WHEN s >= hi THEN 0 WHEN s <= lo THEN 2 ELSE 1 END::INTEGER AS channel FROM sp, (SELECT CASE WHEN lo >= hi THEN mn ELSE lo END AS lo, CASE WHEN lo >= hi THEN mx ELSE hi END AS hi FROM (SELECT quantile_cont(s, 1.0/3) AS lo, quantile_cont(s, 2.0/3) AS hi, min(s) AS mn, max(s) AS mx FROM sp))", _step("p1", "nodes"), _step("p2", "p1"), f", sp AS (SELECT n.node_id, round(least({_cos('a')}, {_cos('b')}), 9) AS s FROM nodes n JOIN p1 a USING (node_id) JOIN p2 b USING (node_id))"))
def assign_ad_gnn(spark, folder):
    spf = _fixed(S.signal_preservation(part_graph(spark, folder), D), "spf")
    return R.with_channel(R.bucket_by_quantile(spf, "spf")).select("node_id", "channel")


@query("assign_delta_sweep", sql("SELECT delta, node_id, CASE WHEN h IS NULL OR h >= 0.5 + delta THEN 0 WHEN h <= 0.5 - delta THEN 2 ELSE 1 END::INTEGER AS channel FROM hom, (SELECT unnest([0.05, 0.1, 0.3])::DOUBLE AS delta)", ROUTED.split(", qh AS")[0]))
def assign_delta_sweep(spark, folder):
    return R.delta_sweep(_scores(spark, folder), [0.05, 0.1, 0.3])


USAGE = "count(*) FILTER (channel = 0)::BIGINT AS channel_0, count(*) FILTER (channel = 1)::BIGINT AS channel_1, count(*) FILTER (channel = 2)::BIGINT AS channel_2"


@query("channel_usage", sql(f"SELECT *, greatest(channel_0, channel_1, channel_2) >= 0.9::DOUBLE * (channel_0 + channel_1 + channel_2) AS collapsed FROM (SELECT {USAGE} FROM fixed)", ROUTED))
def channel_usage(spark, folder):
    return R.usage(R.bucket_by_homophily(_scores(spark, folder)))


@query("assignment_agreement", sql(f"SELECT {r('avg((a.channel = b.channel)::INTEGER::DOUBLE)', 'agreement')} FROM quant a JOIN fixed b USING (node_id)", ROUTED))
def assignment_agreement(spark, folder):
    h = _scores(spark, folder)
    return rounded(R.agreement(R.bucket_by_quantile(h, "h"), R.bucket_by_homophily(h)))


@query("hard_gates", sql("SELECT node_id, [(channel = 0)::INTEGER::DOUBLE, (channel = 1)::INTEGER::DOUBLE, (channel = 2)::INTEGER::DOUBLE] AS gates FROM fixed", ROUTED))
def hard_gates(spark, folder):
    return R.hard(R.bucket_by_homophily(_scores(spark, folder)))


@query("normalised_gates", sql("SELECT node_id, [round(x[1] / greatest(s, 1e-12), 6) + 0.0, round(x[2] / greatest(s, 1e-12), 6) + 0.0, round(x[3] / greatest(s, 1e-12), 6) + 0.0] AS gates FROM (SELECT node_id, x, x[1] + x[2] + x[3] AS s FROM nodes)"))
def normalised_gates(spark, folder):
    return rounded(R.normalised(part_graph(spark, folder).nodes.select("node_id", F.col("x").alias("gates"))))


@query("expert_mask", sql("SELECT q.node_id, q.channel = 1 OR (SELECT lo >= hi FROM bq) AS routed FROM quant q", ROUTED))
def expert_mask(spark, folder):
    return R.expert_mask(R.bucket_by_quantile(_scores(spark, folder), "h"), 1)


def _split_sql(source: str, name: str, fraction: float, seed: int, hit: str, miss: str) -> str:
    return f""", {name} AS (SELECT node_id, y, CASE WHEN k <= greatest(1, round_even({fraction}::DOUBLE * n, 0)) THEN '{hit}' ELSE '{miss}' END AS part
  FROM (SELECT node_id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_uniform(str(seed), 'node_id')}, node_id) AS k, count(*) OVER (PARTITION BY y) AS n FROM {source}))"""


@query("split_train_test", sql("SELECT node_id, y, part FROM s1", _split_sql("nodes", "s1", 0.5, 3, "train", "test")))
def split_train_test(spark, folder):
    return L.stratified_split(part_graph(spark, folder).nodes, 0.5, 3)


@query("split_fit_router", sql("SELECT node_id, y, part FROM s2", _split_sql("nodes", "s1", 0.5, 3, "train", "test"), _split_sql("(SELECT * FROM s1 WHERE part = 'train')", "s2", 0.35, 4, "router", "fit")))
def split_fit_router(spark, folder):
    return L.fit_router_split(L.stratified_split(part_graph(spark, folder).nodes, 0.5, 3), 0.35, 4)


@query("permute_within_strata", sql(f"SELECT a.node_id, a.y, b.deg FROM (SELECT node_id, y, row_number() OVER (PARTITION BY y ORDER BY node_id) AS k FROM nodes) a JOIN (SELECT y, deg, row_number() OVER (PARTITION BY y ORDER BY {sql_uniform('5', 'node_id')}, node_id) AS k FROM nodes JOIN deg USING (node_id)) b ON a.y = b.y AND a.k = b.k"))
def permute_within_strata(spark, folder):
    g = part_graph(spark, folder)
    return L.permute_within(g.nodes.join(G.degrees(g), "node_id").select("node_id", "y", "deg"), "y", "deg", 5)


@query("strided_subsample", sql("SELECT node_id, y FROM (SELECT node_id, y, row_number() OVER (ORDER BY node_id) AS k, count(*) OVER () AS n FROM nodes) JOIN (SELECT DISTINCT round_even(i * ((SELECT count(*) FROM nodes) - 1) / 76.0::DOUBLE, 0) + 1 AS k FROM (SELECT unnest(range(0, 77)) AS i)) USING (k)"))
def strided_subsample(spark, folder):
    return L.strided(part_graph(spark, folder).nodes.select("node_id", "y"), 77)


ACT = """WITH act AS (
  SELECT (day(ts) % 4)::INTEGER AS layer, user_id AS query, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::BIGINT AS key, count(*)::DOUBLE AS p
  FROM events GROUP BY ALL
), norm AS (SELECT layer, query, key, p / sum(p) OVER (PARTITION BY layer, query) AS p FROM act),
ent AS (SELECT layer, query, -sum(p * ln(p)) AS entropy FROM norm GROUP BY ALL)"""


@query("attention_renormalize", ACT + f"SELECT layer, query, key, {r('p', 'p')} FROM norm")
def attention_renormalize(spark, folder):
    return rounded(A.renormalised(activity(spark, folder)).select("layer", "query", F.col("key").cast("long").alias("key"), "p"))


@query("attention_entropy", ACT + f"SELECT layer, query, {r('entropy', 'entropy')} FROM ent")
def attention_entropy(spark, folder):
    return rounded(A.entropies(activity(spark, folder)).drop("passage_id"))


@query("entropy_features", ACT + f"SELECT query, {r('avg(entropy)', 'mean')}, {r('max(entropy)', 'most')}, {r('stddev_pop(entropy)', 'std')} FROM ent GROUP BY query")
def entropy_features(spark, folder):
    return rounded(A.entropy_features(activity(spark, folder)).drop("passage_id"))


for _how, _expr in (("mean", "sum(p) / 4"), ("max", "max(p)"), ("median", "(list_sort(list_concat(list(p), list_resize([0.0::DOUBLE], 4 - count(*), 0.0)))[2] + list_sort(list_concat(list(p), list_resize([0.0::DOUBLE], 4 - count(*), 0.0)))[3]) / 2")):
    query(f"attention_over_layers_{_how}", ACT + f"SELECT query, key, {r(_expr, 'p')} FROM act GROUP BY query, key")(
        lambda spark, folder, how=_how: rounded(A.over_layers(activity(spark, folder), 4, how).select("query", F.col("key").cast("long").alias("key"), "p"))
    )


@query("attention_topk", ACT + f"SELECT query, key, {r('p', 'p')} FROM (SELECT *, rank() OVER (PARTITION BY query ORDER BY p DESC) AS k FROM (SELECT query, key, sum(p) / 4 AS p FROM act GROUP BY ALL)) WHERE k <= 2")
def attention_topk(spark, folder):
    return rounded(A.top_k(A.over_layers(activity(spark, folder), 4), 2).select("query", F.col("key").cast("long").alias("key"), "p"))


@query("attention_digest")
def attention_digest(spark, folder):
    return A.digest(activity(spark, folder))


@query("synthetic_attention", f"""WITH n AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS y FROM nation), base AS (
  SELECT l.layer, a.id AS query, b.id AS key, ((a.y = b.y AND a.id <> b.id)::INTEGER + (a.id = b.id)::INTEGER)::DOUBLE AS w FROM n a, n b, (SELECT unnest(range(0, 4))::INTEGER AS layer) l
), noisy AS (SELECT layer, query, key, w / sum(w) OVER (PARTITION BY layer, query) + 0.1::DOUBLE * {sql_uniform('0', 'layer', 'query', 'key')} AS p FROM base)
SELECT layer, query, key, {r('p / sum(p) OVER (PARTITION BY layer, query)', 'p')} FROM noisy""")
def synthetic_attention(spark, folder):
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_regionkey").alias("y"))
    other = nation.select(F.col("node_id").alias("dst"), F.col("y").alias("yd"))
    edges = nation.select(F.col("node_id").alias("src"), "y").join(other, (F.col("y") == F.col("yd")) & (F.col("src") < F.col("dst"))).select("src", "dst", F.lit(1.0).alias("w"))
    return rounded(A.synthetic_layers(edges, nation).drop("passage_id"))


@query("text_passages")
def text_passages(spark, folder):
    return P.pack_lines(table(spark, folder, "documents"), "doc_id", "text", 480)


@query("word_tokens", r"""WITH w AS (SELECT conv_id * 1000 + turn AS text_id, regexp_extract_all(text, '\s*\S+') AS m FROM conversations), u AS (SELECT text_id, m, unnest(range(1, len(m) + 1)) AS i FROM w)
SELECT text_id, (i - 1)::INTEGER AS pos, regexp_extract(m[i], '\S+') AS token, (coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length(m[i]) - length(regexp_extract(m[i], '\S+')))::INTEGER AS start FROM u""")
def word_tokens(spark, folder):
    texts = table(spark, folder, "conversations").withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn"))
    return P.word_tokens(texts, "text_id", "text")


SENTENCES = r"""WITH t AS (SELECT conv_id * 1000 + turn AS text_id, text FROM conversations), w AS (SELECT text_id, regexp_extract_all(text, '\s*\S+') AS m FROM t), u AS (SELECT text_id, m, unnest(range(1, len(m) + 1)) AS i FROM w),
k AS (SELECT text_id, (i - 1)::INTEGER AS pos, regexp_extract(m[i], '\S+') AS token, (coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length(m[i]) - length(regexp_extract(m[i], '\S+')))::INTEGER AS start FROM u),
p AS (SELECT text_id, regexp_extract_all(text, '(?s).*?(?:[.!?]+\s+|[.!?]+$|\n[ \t]*\n|\z)') AS m FROM t), q AS (SELECT text_id, m, unnest(range(1, len(m) + 1)) AS i FROM p),
e AS (SELECT text_id, coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) + length(regexp_replace(m[i], '\s+$', '')) - CASE WHEN regexp_matches(m[i], '(?s)\n[ \t]*\n$') AND NOT regexp_matches(m[i], '(?s)[.!?]\s+$') THEN 0 ELSE 1 END AS place FROM q WHERE length(m[i]) > 0),
b AS (SELECT text_id, list(DISTINCT place) AS ends FROM (SELECT * FROM e UNION ALL SELECT text_id, length(text) FROM t) GROUP BY text_id)
SELECT k.*, len(list_filter(ends, lambda x: x < start))::INTEGER AS sentence_id FROM k JOIN b USING (text_id)"""


@query("sentence_ids", SENTENCES)
def sentence_ids(spark, folder):
    texts = table(spark, folder, "conversations").withColumn("text_id", F.col("conv_id") * 1000 + F.col("turn"))
    return P.sentence_ids(P.word_tokens(texts, "text_id", "text"), texts, "text_id", "text")


@query("equal_blocks", "SELECT doc_id, pos, (((pos + 1) * k - 1) // n)::INTEGER AS block FROM (SELECT doc_id, n, ceil(n / 48.0::DOUBLE)::BIGINT AS k, unnest(range(0, n)) AS pos FROM (SELECT doc_id, n_chars // 10 AS n FROM documents))")
def equal_blocks(spark, folder):
    return P.equal_blocks(table(spark, folder, "documents").select("doc_id", F.floor(F.col("n_chars") / 10).alias("n")), "doc_id", "n")


def rounded_links(links: DataFrame) -> DataFrame:
    """``rounded`` for positive weights of very many links: by whole numbers, as ``F.round`` makes a decimal of each."""
    return links.withColumn("w", F.floor(F.col("w") * 1e6 + 0.5) / F.lit(1e6))


def links_sql(rules: list[tuple], nodes: str, seed: int = 0) -> str:
    """CTEs that end with links (src, dst, w): the rows of ``generators.block_links`` over the blocks of CTE ``nodes`` (id, block)."""
    rows = ", ".join(f"({a}, {b}, {order}, {size}, {[float(p) for p in cdf]}, {low!r}::DOUBLE, {high!r}::DOUBLE)" for a, b, order, size, cdf, low, high in B.chunked(rules))
    return f""", rules(a, b, ord, size, cdf, low, high) AS (VALUES {rows}),
stood AS (SELECT id, block, row_number() OVER (PARTITION BY block ORDER BY id) - 1 AS place FROM {nodes}), sizes AS (SELECT block, count(*) AS n FROM {nodes} GROUP BY block),
cells AS (SELECT r.*, y.n AS nb, x.n * y.n AS total FROM rules r JOIN sizes x ON x.block = a JOIN sizes y ON y.block = b),
chunks AS (SELECT *, unnest(range(0, ((total + size - 1) // size)::BIGINT)) AS chunk FROM cells),
counted AS (SELECT *, {sql_uniform(str(seed), "'n'", 'a', 'b', 'ord', 'chunk')} AS u FROM chunks),
points AS (SELECT *, unnest(range(1, len(list_filter(cdf, lambda p: p::DOUBLE <= u)) + 1)) AS i FROM counted),
hit AS (SELECT DISTINCT a, b, ord, low, high, nb, total, chunk * size + floor({sql_uniform(str(seed), "'c'", 'a', 'b', 'ord', 'chunk', 'i')} * size)::BIGINT AS cell FROM points),
ends AS (SELECT x.id AS ia, y.id AS ib, ord, low, high FROM hit JOIN stood x ON x.block = a AND x.place = cell // nb JOIN stood y ON y.block = b AND y.place = cell % nb WHERE cell < total AND (a <> b OR cell // nb < cell % nb)),
pairs AS (SELECT least(ia, ib) AS src, greatest(ia, ib) AS dst, low, high FROM ends WHERE ord = 0 OR (ord = 1 AND ia < ib) OR (ord = -1 AND ia > ib)),
links AS (SELECT src, dst, low + (high - low) * {sql_uniform(str(seed), "'w'", 'src', 'dst')} AS w FROM pairs)"""


def _customers(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").cast("long").alias("id"))


CUSTOMERS = "WITH c AS (SELECT c_custkey::BIGINT AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS m FROM customer)"
SBM = CUSTOMERS + ", n AS (SELECT id, floor(i * 3 / m::DOUBLE)::INTEGER AS block FROM c)" + links_sql([(i, j, 0, 0.5 if i == j else 0.05, 0.05, 1.0) for i in range(3) for j in range(i, 3)], "n")


@query("gen_sbm", SBM + f" SELECT src, dst, {r('w', 'w')} FROM links")
def gen_sbm(spark, folder):
    return rounded_links(B.sbm(spark, 0, 3, ids=_customers(spark, folder)).edges)


PLANTED = f"""WITH g AS (SELECT c_custkey::BIGINT AS id, floor({sql_uniform('1', "'y'", 'c_custkey')} * 5)::INTEGER AS y, {sql_uniform('1', "'g'", 'c_custkey')} AS u FROM customer),
n AS (SELECT id, y, ((CASE WHEN u < 0.4::DOUBLE THEN 0 WHEN u < 0.8::DOUBLE THEN 1 ELSE 2 END) * 5 + y)::INTEGER AS block FROM g)"""
PLANTED_LINKS = PLANTED + links_sql(B.planted_rules(), "n", 1)


def _planted(spark, folder):
    return B.planted_regimes(spark, 0, seed=1, ids=_customers(spark, folder))


@query("gen_planted_regimes", PLANTED_LINKS + " SELECT src, dst, w FROM links")
def gen_planted_regimes(spark, folder):
    return _planted(spark, folder).edges


@query("planted_label_counts", PLANTED + " SELECT y, count(*)::BIGINT AS n FROM n GROUP BY y")
def planted_label_counts(spark, folder):
    return _planted(spark, folder).nodes.groupBy("y").agg(F.count("*").alias("n"))


ORDERED = f", o AS (SELECT id, y, row_number() OVER (ORDER BY k, y) AS place FROM (SELECT id, y, row_number() OVER (PARTITION BY y ORDER BY {sql_uniform('1', chr(39) + 'd' + chr(39), 'id')}, id) AS k FROM n)), cv AS (SELECT id, y FROM o WHERE place <= (SELECT round_even(count(*) / 2.0::DOUBLE, 0) FROM n))"
REDRAWN = ", q AS (SELECT n.id, (n.y + CASE WHEN cv.id IS NULL THEN 5 ELSE 0 END)::INTEGER AS block FROM n LEFT JOIN cv ON cv.id = n.id)" + links_sql([rule for y in range(5) for rule in ((y, y, 0, 0.2, 1.0, 1.0), (y, 5 + y, 0, 0.2, 1.0, 1.0))], "q", 1)


@query("dilution_ladder", f"WITH e AS ({PLANTED_LINKS} SELECT src, dst, w FROM links), {PLANTED.removeprefix('WITH ')}{ORDERED}{REDRAWN} SELECT src, dst, w FROM e WHERE src NOT IN (SELECT id FROM cv) AND dst NOT IN (SELECT id FROM cv) UNION ALL SELECT src, dst, w FROM links")
def dilution_ladder(spark, folder):
    return B.dilute(_planted(spark, folder), 0.5, 0.2, 1).edges


def _normal_sql(seed: str, tag: str, key: str) -> str:
    return f"sqrt(-2 * ln({sql_uniform(seed, tag, key, chr(39) + 'a' + chr(39))} + pow(2.0::DOUBLE, -33))) * cos(6.283185307179586::DOUBLE * {sql_uniform(seed, tag, key, chr(39) + 'b' + chr(39))})"


CONTROL = f"""WITH f AS (SELECT c_custkey::BIGINT AS id, (c_custkey % 3)::INTEGER AS block, {_normal_sql("0", "'f0'", "c_custkey")} AS f0, {_normal_sql("0", "'f1'", "c_custkey")} AS f1, {_normal_sql("0", "'f2'", "c_custkey")} AS f2 FROM customer)"""
OWN = "CASE block WHEN 0 THEN f0 + f1 WHEN 1 THEN f1 - f2 ELSE f2 - f0 END"
GROUPED = "block AS grp, [round(f0, 6) + 0.0, round(f1, 6) + 0.0, round(f2, 6) + 0.0, CASE block WHEN 0 THEN 5.0 WHEN 1 THEN -5.0 ELSE 0.0 END::DOUBLE] AS x FROM f"


@query("gen_positive_control", f"{CONTROL} SELECT id AS node_id, ({OWN} > 0)::INTEGER AS y, {GROUPED}")
def gen_positive_control(spark, folder):
    return rounded(B.positive_control(spark, 0, ids=_customers(spark, folder)))


@query("gen_separable", f"{CONTROL} SELECT id AS node_id, (0.4::DOUBLE * (f0 + f1) + 0.6::DOUBLE * {OWN} > 0)::INTEGER AS y, {GROUPED}")
def gen_separable(spark, folder):
    return rounded(B.separable(spark, 0, 0.6, ids=_customers(spark, folder)))


@query("gen_control_links", CONTROL + links_sql([(i, j, 0, 0.02 if i == j else 0.005, 1.0, 1.0) for i in range(3) for j in range(i, 3)], "f") + f" SELECT src, dst, {r('w', 'w')} FROM links")
def gen_control_links(spark, folder):
    """Links within the groups of the control, and fewer across them."""
    return rounded_links(B.group_links(B.positive_control(spark, 0, ids=_customers(spark, folder)), 0.02, 0.005))


ROLES = "WITH c AS (SELECT c_custkey::BIGINT AS id, row_number() OVER (ORDER BY c_custkey) AS i, greatest(1, floor(0.2::DOUBLE * count(*) OVER ())) AS s, greatest(1, floor(0.35::DOUBLE * count(*) OVER ())) AS v, greatest(1, floor(0.05::DOUBLE * count(*) OVER ())) AS h FROM customer), n AS (SELECT id, (CASE WHEN i <= s THEN 0 WHEN i <= s + v THEN 1 WHEN i <= s + v + h THEN 2 ELSE 3 END)::INTEGER AS block FROM c)"
PATH = f""", ranked AS (SELECT id, row_number() OVER (ORDER BY {sql_uniform('0', "'b'", 'id')}, id) AS place FROM n),
path AS (SELECT least(l.id, m.id) AS src, greatest(l.id, m.id) AS dst, 0.3::DOUBLE AS w FROM ranked l JOIN ranked m ON m.place = l.place + 1)
SELECT src, dst, {r('max(w)', 'w')} FROM (SELECT * FROM links UNION ALL SELECT * FROM path) GROUP BY src, dst"""


@query("gen_roles", ROLES + links_sql([(a, b, 0, p, low, high) for a, b, p, low, high in B.ROLE_RULES], "n") + PATH)
def gen_roles(spark, folder):
    return rounded_links(B.roles(spark, 0, ids=_customers(spark, folder)).edges)


ERP = ROLES + f""", n0 AS (SELECT id, block AS role, floor({sql_uniform('0', "'y'", 'id')} * 5)::INTEGER AS y FROM n),
g AS (SELECT id, y, role, (role * 5 + y)::INTEGER AS block, (CASE role WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END)::INTEGER AS regime, (role = 2)::INTEGER AS fraud FROM n0)"""


@query("gen_erp_nodes", ERP + " SELECT id AS node_id, y, role, regime, fraud FROM g")
def gen_erp_nodes(spark, folder):
    return B.erp_fraud(spark, 0, ids=_customers(spark, folder)).nodes.select("node_id", "y", "role", "regime", "fraud")


@query("gen_erp_edges", ERP + links_sql(B.erp_rules(), "g") + PATH)
def gen_erp_edges(spark, folder):
    return rounded_links(B.erp_fraud(spark, 0, ids=_customers(spark, folder)).edges)


BLOCKS = [[0.3, 0.02, 0.05], [0.02, 0.1, 0.1], [0.05, 0.1, 0.02]]


@query("gen_homophily_range", "WITH n AS (SELECT c_custkey::BIGINT AS id, (c_custkey % 3)::INTEGER AS block FROM customer)" + links_sql([(i, j, 0, BLOCKS[i][j], 1.0, 1.0) for i in range(3) for j in range(i, 3)], "n") + " SELECT src, dst, w FROM links")
def gen_homophily_range(spark, folder):
    return B.homophily_range(spark, 0, BLOCKS, ids=_customers(spark, folder)).edges


@query("gen_sbm_halved", SBM + f" SELECT src, dst, {r('w / 2', 'w')} FROM links")
def gen_sbm_halved(spark, folder):
    return rounded_links(B.halved_sbm(spark, 0, 3, ids=_customers(spark, folder)).edges)


@query("labelled_block", sql("SELECT src, dst, round(w, 6) + 0.0 AS w FROM edges WHERE src >= 500 AND dst >= 500"))
def labelled_block(spark, folder):
    from graphloom.sources.tables import labelled_block as block

    return rounded(block(part_graph(spark, folder), 500).edges)


@query("largest_sample")
def largest_sample(spark, folder):
    from graphloom.sources.tables import largest_sample as sample

    return sample(part_graph(spark, folder), 300).nodes.select("node_id", "y")
