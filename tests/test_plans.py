"""Plan-quality guard: registered relational queries keep hash aggregation,
no cartesian products, no nested-loop joins, and scans read only the
columns they need."""

import re

from cinderwell.plans.catalog import QUERIES

SMOKE = "/root/testdata/sf0.001"
MODEL_QUERIES = {"rf_regression", "rf_importance_matrix", "rf_classifier", "impact_ranking",
                 "impact_by_change", "rf_class_report", "gam_results", "gam_curve",
                 "model_summary", "mixed_effects"}
BAD = re.compile(r"SortAggregate|CartesianProduct|BroadcastNestedLoopJoin")


def test_no_sort_aggregate_or_cross_products(spark):
    bad = {}
    for name, fn in QUERIES.items():
        if name in MODEL_QUERIES:
            continue
        plan = fn(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
        hits = sorted(set(BAD.findall(plan)))
        if hits:
            bad[name] = hits
    assert bad == {}


def test_event_study_scan_is_pruned(spark):
    plan = QUERIES["fire_results_long"](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and plan.count("Exchange") == 1
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan) or re.findall(r"struct<([^>]*)>", plan)
    assert all("StationName" not in r for r in read)  # only the study's columns are read


def test_master_reads_the_readings_once(spark):
    """One pass over lineitem, no join of the readings with themselves, partial
    sums before the first exchange."""
    from cinderwell.operators.reshape import master_wide
    from cinderwell.sources import bindings
    df = master_wide(bindings.readings_long(spark, SMOKE), bindings.BINDING_ANALYTES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2
    assert "SortMergeJoin" not in plan and plan.count("HashAggregate") == 2
