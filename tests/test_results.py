"""Statistics, reports and experts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.operators import experts as E
from graphloom.operators import generators as B
from graphloom.operators import reports as P
from graphloom.operators import routing as R
from graphloom.operators import splits as L
from graphloom.operators import stats as S
from graphloom.plans import ranking
from graphloom.storage import staged


def test_p_values():
    assert S.wilcoxon_p(np.full(10, 0.1) + np.arange(10) * 1e-3) == pytest.approx(2 / 1024)
    assert S.wilcoxon_p(np.zeros(8)) == 1.0
    assert S.wilcoxon_p(np.full(8, 0.1)) < 0.05
    assert S.t_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert S.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5)
    assert S.paired_t_p(np.full(5, 0.3)) == 1.0


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.3), ("d", None)], "name string, p double")
    found = {r["name"]: r for r in S.holm(rows).collect()}
    assert set(found) == {"a", "b", "c"}
    assert found["a"]["threshold"] == pytest.approx(0.05 / 3) and found["a"]["p_holm"] == pytest.approx(0.03) and found["a"]["rejected"]
    assert found["b"]["p_holm"] == pytest.approx(0.08) and not found["b"]["rejected"]


def test_protocol_and_decisions(spark):
    cells = S.hash_cells(spark, {"oracle": 0.9, "uniform": 0.6, "label_free": 0.8, "random": 0.6})
    compared = S.comparisons(S.paired(cells, S.RULES)).select("name", "mean_diff", F.col("p_wilcoxon").alias("p"))
    control = S.comparisons(S.paired(S.hash_cells(spark, {"oracle": 0.9, "uniform": 0.5}), S.RULES)).select("name", "mean_diff", F.col("p_wilcoxon").alias("p"))
    rules = S.decisions(compared, control).first()
    assert rules["D1"] and rules["D2"] and rules["D3"] and rules["D4"] and rules["verdict"] == "supported"
    assert rules["D1_p"] == pytest.approx(2 / 1024)  # the test's own p-value, not the corrected one
    without = S.decisions(compared).first()
    assert without["D4"] is None and without["verdict"] == "not supported: D4"
    weak = S.decisions(compared.where("name <> 'D3'"), control.withColumn("mean_diff", -F.col("mean_diff"))).first()
    assert weak["D3"] is None and weak["D4"] is False and weak["verdict"] == "not supported: D3, D4"


def test_quantiles_are_exact(spark):
    import random

    rng = random.Random(1)
    for values in ([rng.gauss(0, 1) for _ in range(3000)], [rng.choice([1.0, 2.0, 5.0]) for _ in range(2000)], [10.0 ** rng.uniform(-200, 200) for _ in range(2500)], [7.0], [3.0] * 500):
        table = spark.createDataFrame([(v,) for v in values + [None, float("nan")]], "v double")
        at = [0.0, 0.025, 1 / 3, 0.5, 2 / 3, 1.0]
        assert ranking.quantiles(table, "v", at) == pytest.approx(np.quantile(values, at).tolist())
        ranks = [0, len(values) // 3, len(values) - 1, len(values)]
        assert ranking.order_statistics(table, "v", ranks, few=20) == [*(sorted(values)[r] for r in ranks[:3]), None]
    assert ranking.quantiles(table.limit(0), "v", [0.5]) == [None]


def test_running_total(spark):
    rows = spark.createDataFrame([(i, (i * 7) % 5) for i in range(50)], "k long, n long")
    found = {r["k"]: r["before"] for r in ranking.running_total(rows, "n", F.asc("k")).collect()}
    assert found == {i: sum((j * 7) % 5 for j in range(i)) for i in range(50)}


def test_bootstrap_against_repeated_rows(spark):
    """Each draw is Spearman's rho of the rows repeated as often as their cluster's weight says."""
    rng = np.random.default_rng(2)
    data = [(float(rng.integers(0, 9)), float(rng.integers(0, 9)) + 0.3 * i, f"c{i % 7}") for i in range(40)] + [(None, 1.0, "c1"), (1.0, 2.0, None)]
    rows = spark.createDataFrame(data, "x double, y double, c string")
    weights = {(r["c"], r["b"]): int(r["w"]) for r in rows.select(F.coalesce("c", F.lit("")).alias("c")).distinct().crossJoin(spark.range(30).withColumnRenamed("id", "b")).select("c", "b", S.poisson_weight(5, "c", "b").alias("w")).collect()}
    rhos = []
    for b in range(30):
        part = np.array([(x, y) for x, y, c in data if x is not None for _ in range(weights[c or "", b])]).reshape(-1, 2)
        rx, ry = (pd.Series(part[:, i]).rank() for i in (0, 1))
        if len(part) and rx.std() > 0 and ry.std() > 0:
            rhos.append(rx.corr(ry))
    found = S.bootstrap_spearman(rows, "x", "y", "c", draws=30, seed=5, at_once=7).first()
    assert (found["ci_low"], found["ci_high"]) == pytest.approx(tuple(np.quantile(rhos, [0.025, 0.975])))
    assert found["p"] == pytest.approx(min(1, 2 * min(np.mean(np.array(rhos) <= 0), np.mean(np.array(rhos) >= 0))))
    assert np.mean(list(weights.values())) == pytest.approx(1, abs=0.2)
    assert S.bootstrap_spearman(rows.limit(0), "x", "y", "c", draws=5).count() == 0


def test_bootstrap_ranks_by_buckets(spark, monkeypatch):
    """Buckets of a few rows, values that fill several of them, and ranks that go on as integers: as of the repeated rows."""
    monkeypatch.setattr(S, "BUCKET", 5)
    monkeypatch.setattr(S, "COLUMNS", 3)
    rng = np.random.default_rng(4)
    x = np.where(rng.random(300) < 0.4, 2.0, rng.normal(size=300))
    y = np.where(rng.random(300) < 0.3, -0.5, np.round(x + rng.normal(size=300), 1))
    held = spark.createDataFrame([(float(a), float(b), i % 90) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, c long")
    cuts = {c: S._cuts(held, c, 300) for c in ("x", "y")}
    assert len(cuts["x"]) > 20 and 2.0 in cuts["x"] and np.nextafter(2.0, 0) in cuts["x"]
    weights = rng.poisson(1, (90, 8))
    drawn = spark.createDataFrame([(r["x"], r["y"], weights[r["c"]].tolist()) for r in held.collect()], "x double, y double, w array<tinyint>")
    found = S._weighted_moments(drawn.repartition(3), cuts, 8)
    for d in range(8):
        times = weights[np.arange(300) % 90, d]
        p, q = (pd.Series(np.repeat(v, times)).rank().to_numpy() - (times.sum() + 1) / 2 for v in (x, y))
        assert found[:, d] == pytest.approx([times.sum(), p @ p, q @ q, p @ q])


def test_partial_spearman_edges(spark):
    few = spark.createDataFrame([("g", 1.0, 2.0, 3.0)] * 3, "g string, x double, y double, z double")
    assert S.partial_spearman(few, "x", "y", "z", "g").first()["rho"] is None


def test_reports(spark):
    rows = spark.createDataFrame([("p", 1, 0.2), ("p", 1, 0.4), ("q", 1, 0.5)], "method string, n int, err double")
    checked = P.check_bands(rows, ["n"], "method", "err", "p", ["q"])
    assert checked.first()["below_all"]
    assert P.purity_mapping(spark.createDataFrame([("a", 1), ("a", 0)], "g string, c int"), "g", "c").first()["c"] == 0
    assert "\\_" in P.latex_table(spark.createDataFrame([("a_b", 0.5)], "name string, v double"), ["name", "v"])
    assert P.markdown_table(rows.limit(1), ["method", "err"]).count("\n") == 2
    odd = spark.createDataFrame([("a|b", 0.5)], "name string, v double")
    assert "a\\|b" in P.markdown_table(odd, ["name", "v"])
    assert P.latex_table(odd, ["name", "v"], "50 % of a_b").endswith("\\caption{50 \\% of a\\_b}\n\\end{table}")


@pytest.fixture(scope="module")
def control(spark):
    return B.positive_control(spark, 900).persist()


def test_right_routing_pays(spark, control):
    """With a linear rule of its own in each group, routing by group beats one expert, and random routing does not."""
    splits = L.stratified_split(control, 0.5, 1).select(F.lit(0).alias("split"), F.lit(0).alias("seed"), "node_id", "part")
    oracle = R.by_regime(control, "grp")

    def accuracy(gates):
        predictions = E.fit_pool(control, splits, gates, 2)
        conditions = R.with_channel(gates).select(F.lit("c").alias("cond"), "node_id", "channel")
        return E.mixture_cells(predictions, control, conditions).first()["acc"]

    own, one, drawn = accuracy(oracle), accuracy(R.uniform_gates(control)), accuracy(R.random_like(oracle))
    assert own > one + 0.1 and drawn < own - 0.05


def test_underpopulated_channels_have_experts(spark, control):
    splits = L.stratified_split(control, 0.5, 1).select(F.lit(0).alias("split"), F.lit(0).alias("seed"), "node_id", "part")
    alone = R.by_regime(control.withColumn("one", F.lit(0)), "one")
    predictions = E.fit_pool(control, splits, alone, 2).persist()
    assert predictions.groupBy("expert").count().count() == 3
    targets = E.router_targets(predictions, control)
    assert targets.where("abs(target[0] + target[1] + target[2] - 1) > 1e-9").count() == 0
    assert E.soft_vote(predictions, control, 2).count() == 1


def test_heads_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    assert (E.Mlp(2).fit(x, y).predict_proba(x).argmax(1) == y).mean() > 0.9
    line = (x[:, 0] > 0).astype(int)
    assert (E.Logistic(2).fit(x, line).predict_proba(x).argmax(1) == line).mean() > 0.95
    assert E.Logistic(3).fit(x, np.full(300, 2)).predict_proba(x).argmax(1).tolist() == [2] * 300


def test_leave_one_out_copies_no_rows(spark, monkeypatch):
    """Every rank table is of the rows at most, whatever the number of groups; ties, null values and null groups as before."""
    rng = np.random.default_rng(9)
    data = pd.DataFrame({"g": rng.integers(0, 12, 300), "x": rng.integers(0, 40, 300).astype(float), "y": rng.normal(size=300).round(1)})
    data["y"] += data["x"] / 30 * (data["g"] > 5)
    plain = [(None if i % 50 == 7 else int(g), None if i % 60 == 3 else float(x), float(y)) for i, (g, x, y) in enumerate(data.itertuples(index=False))]
    rows = spark.createDataFrame(plain, "g int, x double, y double")
    written = []

    def counted(df, name):
        out = staged(df, name)
        written.append(out.count())
        return out

    for module in (S, ranking):
        monkeypatch.setattr(module, "staged", counted)
    found = {r["left_out"]: r["rho"] for r in S.leave_one_out(rows, "x", "y", "g", at_once=5).collect()}
    kept = pd.DataFrame([(g, -1.0 if x is None else x, y) for g, x, y in plain if g is not None], columns=["g", "x", "y"])
    wanted = {g: kept[kept.g != g].x.rank().corr(kept[kept.g != g].y.rank()) for g in range(12)}
    assert found == pytest.approx(wanted, abs=1e-12) and max(written) <= len(rows.collect())
    one = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0)], "g string, x double, y double")
    assert S.leave_one_out(one, "x", "y", "g").count() == 0
    two = one.union(spark.createDataFrame([("b", 1.0, 5.0), ("b", 2.0, 5.0)], one.schema))
    assert {r["left_out"]: r["rho"] for r in S.leave_one_out(two, "x", "y", "g").collect()} == {"a": None, "b": pytest.approx(-1)}


def test_pool_makes_no_routing_that_its_callers_do_not_compare(spark, monkeypatch):
    from graphloom.plans import spectral_queries as Q

    def refused(*args, **options):
        raise AssertionError("a routing of another query")

    monkeypatch.setattr(Q, "_whole", lambda spark, folder: Q.Graph(spark.createDataFrame([(i, i % 2, [float(i)] * Q.D) for i in range(12)], "node_id long, y int, x array<double>"), spark.createDataFrame([(i, i + 1, 1.0) for i in range(11)], "src long, dst long, w double")))
    monkeypatch.setattr(Q.E, "fit_pool", lambda nodes, splits, oracle, n: nodes)
    monkeypatch.setattr(Q.S, "feature_homophily", refused)
    monkeypatch.setattr(Q.R, "random_like", refused)
    nodes, predictions, _, oracle = Q._pool(spark, "")
    assert nodes.count() == predictions.count() == oracle.count() == 12
