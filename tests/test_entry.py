"""Driver contract: every registered query has a DuckDB twin or is a known
rows-only model query, and each twin returns the same column names and row
count as Spark (sf0.001)."""

import duckdb

import __spark_entry__ as E
from cinderwell.plans.catalog import QUERIES

SMOKE = "/root/testdata/sf0.001"
ROWS_ONLY = {"rf_regression", "rf_importance_matrix", "rf_classifier", "impact_ranking",
             "impact_by_change", "rf_class_report",
             "model_summary", "mixed_effects"}


def test_every_query_has_a_twin_or_is_a_model():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and set(QUERIES) <= set(q)
    assert set(QUERIES) - set(sql) == ROWS_ONLY


def test_twins_match_columns_and_counts(spark):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    bad = {}
    for name, sql in E.oracle_sql().items():
        if name not in QUERIES:
            continue
        rel = con.execute(sql)
        cols = sorted(d[0] for d in rel.description)
        n = len(rel.fetchall())
        df = E.queries()[name](spark, SMOKE)
        if sorted(df.columns) != cols or df.count() != n:
            bad[name] = (sorted(df.columns), cols, df.count(), n)
    assert bad == {}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns[:3] == ["scenario", "Fire", "GIS_Acres"]
