"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from graphloom import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SOME = ["emb_homophily_route", "graph_norm_adj", "label_homophily", "score_triangles", "router_gate_features", "connected_components", "sparsify_degree", "assign_quantile", "split_fit_router", "attention_topk", "equal_blocks", "dilution_ladder", "wilcoxon_exact", "holm_adjust", "partial_spearman", "bands", "purity_mapping", "protocol_table", "decision_rules", "gen_erp_edges", "edges_through_mat", "event_leaves", "streamed_points", "filter_responses"]


def plain(v):
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(FOLDER):
        db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    relation = db.sql(catalog.ORACLE_SQL[name])
    frame = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(relation.columns)
    assert columns == sorted(frame.columns)
    at = [relation.columns.index(c) for c in columns]
    wanted = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=str)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    assert found == wanted


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
