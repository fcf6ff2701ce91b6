"""Registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through the binding) over whole
tables. Outputs are normalised for hash comparison: doubles rounded to
``ROUND_DIGITS``, event timestamps as TIMESTAMP_NTZ (wall-clock UTC).
"""

from __future__ import annotations

import threading
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderwell.functions.dates import parse_date, parse_utc_timestamp
from cinderwell.functions.geometry import AlbersParams, albers_inverse, side, wkt_point
from cinderwell.functions.labels import lookup, short_label
from cinderwell.operators import events as ev
from cinderwell.operators import gam as gam_ops
from cinderwell.operators import ml, stats, study, trees
from cinderwell.operators.reshape import add_surrogate_id, analytes_found, preview, units_reference
from cinderwell.operators.spatial import spatial_join
from cinderwell.plans.stages import _binding_key, binding_joined, binding_master
from cinderwell.plans.workflow import published_order
from cinderwell.session import checkpoint_dir, delete_on_exit, passes_over
from cinderwell.sources import bindings
from cinderwell.sources.files import head_per_group, read_csv_text, read_readings, union_by_name, write_if_nonempty, write_table
from cinderwell.sources.schema import META_COLS, MODEL_FEATURES, READINGS_SCHEMA, q, typed_from_text

ROUND_DIGITS = 6
A = sorted(bindings.BINDING_ANALYTES)
MASTER_COLS = ["StationCode", "StationName", "TargetLatitude", "TargetLongitude", "Region", "SampleDate"]
JOINED_TAIL = ["SampleYear", "index_right", "FIRE_NAME", "ALARM_DATE", "FireYear", "GIS_ACRES"]


def normalise(df: DataFrame, digits: int = ROUND_DIGITS) -> DataFrame:
    tz = df.sparkSession.conf.get("spark.sql.session.timeZone")
    out = []
    for f in df.schema.fields:
        c = q(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.TimestampType):
            # UTC wall clock, whatever the session time zone
            c = F.convert_timezone(F.lit(tz), F.lit("UTC"), c.cast("timestamp_ntz"))
        out.append(c.alias(f.name))
    return df.select(*out)


def _joined(spark, d, **kw):
    return binding_joined(spark, d, **kw)


def _joined_cols(df, extra=()):
    return df.select(*[q(c) for c in MASTER_COLS + A + JOINED_TAIL + list(extra)])


# ---------------------------------------------------------------- stage A
def q_units_reference(spark, d):
    return units_reference(bindings.readings_long(spark, d))


def q_analytes_found(spark, d):
    return analytes_found(bindings.readings_long(spark, d))


def q_master_wide(spark, d):
    return normalise(binding_master(spark, d))


def q_surrogate_id(spark, d):
    return normalise(binding_master(spark, d, with_id=True))


def q_file_head_n(spark, d):
    """The reduction step's first 1000 rows of each analyte; the limit is
    the feature."""
    long = bindings.readings_long(spark, d)
    return normalise(head_per_group(long, "Analyte", [F.col("ord")], 1000))


def _csv_folder(spark, what):
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def q_readings_csv(spark, d):
    """S1 + S2 + S5 + S6 + P5: the readings written as CSV files, dates in two
    layouts and one analyte's files without units, and read back strictly."""
    long = bindings.readings_long(spark, d)
    date = F.when(F.col("ord") % 2 == 0, F.date_format("SampleDate", "M/d/yyyy")).otherwise(F.col("SampleDate").cast("string"))
    text = long.withColumn("SampleDate", date).select(*[f.name for f in READINGS_SCHEMA.fields])
    folder, with_unit = _csv_folder(spark, "readings-csv"), ~F.col("Analyte").startswith("R")
    parts = {f"{folder}/units": text.where(with_unit), f"{folder}/none": text.where(~with_unit).drop("Unit")}
    written = [path for path, part in parts.items() if write_if_nonempty(part, path, "csv")]
    back = read_readings(spark, written, with_order=False, strict=True)
    return normalise(back.withColumn("SampleDate", parse_date("SampleDate")))


def q_fires_csv(spark, d):
    """S2 + S5 + P8: perimeter attributes through CSV, alarm times with their
    offset."""
    path = _csv_folder(spark, "fires-csv")
    fires = bindings.fires(spark, d).select("fire_id", "FIRE_NAME", F.date_format("ALARM_DATE", "yyyy-MM-dd HH:mm:ssxxx").alias("ALARM_DATE"), "GIS_ACRES")
    write_table(fires, path, "csv")
    schema = T.StructType([T.StructField("fire_id", T.LongType()), T.StructField("FIRE_NAME", T.StringType()),
                           T.StructField("ALARM_DATE", T.StringType()), T.StructField("GIS_ACRES", T.DoubleType())])
    back = typed_from_text(read_csv_text(spark, path), schema, strict=True)
    return normalise(back.withColumn("ALARM_DATE", parse_utc_timestamp("ALARM_DATE")))


def q_union_by_name(spark, d):
    long = bindings.readings_long(spark, d)
    a = long.where(F.col("Analyte").startswith("A")).select("StationCode", "SampleDate", "Analyte", "Result")
    b = long.where(~F.col("Analyte").startswith("A")).select("Analyte", "Unit", "StationCode", "SampleDate")
    return normalise(union_by_name([a, b]))


def q_station_fire_join(spark, d, method="rings"):
    sup = bindings.table(spark, d, "supplier")
    pts = sup.select(F.col("s_suppkey").alias("station_key"),
                     bindings.station_lon(F.col("s_suppkey")).alias("TargetLongitude"),
                     bindings.station_lat(F.col("s_suppkey")).alias("TargetLatitude"))
    j = spatial_join(pts, bindings.fires(spark, d), fire_cols=("FIRE_NAME",), method=method)
    return normalise(j)


def q_station_fire_join_edges(spark, d):
    """The same join through the edge-band test that the stage tables use."""
    return q_station_fire_join(spark, d, "edges")


def q_station_fire_join_cells(spark, d):
    """The same join through the quadtree of each perimeter."""
    return q_station_fire_join(spark, d, "cells")


def q_edge_sides(spark, d):
    """Points a millionth of a degree beside, or on, slanted lines drawn from the
    keys of orders: the exact side of each."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    u, v, m = 1 + F.pmod(k * 7, F.lit(97)), 1 + F.pmod(c * 13, F.lit(89)), 1000 + F.pmod(k, F.lit(500))
    ax, ay = F.pmod(k * 7919, F.lit(10000000)) - 124000000, F.pmod(k * 104729, F.lit(10000000)) + 32000000
    j = F.pmod(c * 31, m)
    whole = (ax, ay, ax + m * u, ay + m * v, ax + j * u + F.pmod(k, F.lit(3)) - 1, ay + j * v)
    return bindings.table(spark, d, "orders").select(k, side(*(x.cast("double") / 1e6 for x in whole)).alias("side"))


def q_same_year_matches(spark, d):
    return normalise(_joined_cols(ev.same_year(_joined(spark, d, with_days=False))))


def q_same_year_sorted(spark, d):
    """O1: the same-year matches with the place that each has in the table as it
    is written, in the order of the master's ids and of the perimeters."""
    return add_surrogate_id(q_same_year_matches(spark, d), [*META_COLS, "index_right"], "position")


def q_days_since_event(spark, d):
    j = ev.matched(_joined(spark, d))
    return normalise(j.select("StationCode", "SampleDate", "index_right", "FIRE_NAME",
                              "ALARM_DATE", "days_since_fire"))


def _one_month(spark, d):
    return ev.day_window(ev.matched(_joined(spark, d)), 0, 30)


def q_impacted_one_month(spark, d):
    return normalise(_joined_cols(_one_month(spark, d), ["days_since_fire"]))


def q_impacted_counts(spark, d):
    return ev.value_counts(_one_month(spark, d), "FIRE_NAME")


def q_impacted_range(spark, d):
    return ev.date_range(_one_month(spark, d), "SampleDate")


def q_impacted_preview(spark, d):
    p = preview(_one_month(spark, d), ["StationCode", "SampleDate", "index_right"], 10)
    return normalise(p.select("StationName", "SampleDate", "FIRE_NAME", "GIS_ACRES", q(A[0])))


def q_impacted_wkt(spark, d):
    j = ev.day_window(ev.matched(_joined(spark, d, fire_cols=("FIRE_NAME", "ALARM_DATE", "GIS_ACRES", "CONT_DATE"))), 0, 30)
    out = j.select(*[q(c) for c in MASTER_COLS + A],
                   wkt_point("TargetLongitude", "TargetLatitude").alias("geometry"),
                   "index_right", "FIRE_NAME", "ALARM_DATE", "CONT_DATE", "GIS_ACRES", "days_since_fire")
    return normalise(out)


# ---------------------------------------------------------------- stage B
def _results(spark, d, scenarios=study.SCENARIOS):
    j = _joined(spark, d)
    order = "row_ord" if "row_ord" in j.columns else study.DEFAULT_ORDER
    return study.fire_results(j, A, scenarios, order_cols=order)


def _wide(spark, d, scenarios, name):
    r = _results(spark, d, scenarios)
    w = study.fire_results_wide(r, A, labels={a: a for a in A}).where(F.col("scenario") == name)
    return normalise(w.drop("scenario"))


def q_fire_paired_1yr(spark, d):
    return _wide(spark, d, study.SECTION1, "1yr")


def _scenario_query(name):
    only = tuple(s for s in study.SCENARIOS if s[0] == name)
    return lambda spark, d: _wide(spark, d, only, name)


def q_fire_results_long(spark, d):
    return normalise(_results(spark, d))


def q_mean_change(spark, d):
    return normalise(study.mean_change(_results(spark, d)))


def q_paired_ttest(spark, d):
    t = study.paired_ttest(_results(spark, d))
    return normalise(t.select("scenario", "Analyte", "n_pairs", "mean_diff", "sd_diff",
                              "t_stat", "p_value", "significant"))


def q_scenario_summary(spark, d):
    return normalise(study.scenario_summary(_results(spark, d)))


def q_scenario_matrix(spark, d):
    return normalise(study.scenario_matrix(_results(spark, d), A))


def q_paired_means(spark, d):
    return normalise(study.paired_means(_results(spark, d, study.SECTION1)))


def q_short_labels(spark, d):
    a = analytes_found(bindings.readings_long(spark, d))
    return a.select("Analyte", short_label("Analyte").alias("short_label"))


QUERIES = {
    "units_reference": q_units_reference,
    "analytes_found": q_analytes_found,
    "master_wide": q_master_wide,
    "surrogate_id": q_surrogate_id,
    "file_head_n": q_file_head_n,
    "union_by_name": q_union_by_name,
    "readings_csv": q_readings_csv,
    "fires_csv": q_fires_csv,
    "station_fire_join": q_station_fire_join,
    "station_fire_join_edges": q_station_fire_join_edges,
    "station_fire_join_cells": q_station_fire_join_cells,
    "edge_sides": q_edge_sides,
    "same_year_matches": q_same_year_matches,
    "same_year_sorted": q_same_year_sorted,
    "days_since_event": q_days_since_event,
    "impacted_one_month": q_impacted_one_month,
    "impacted_counts": q_impacted_counts,
    "impacted_range": q_impacted_range,
    "impacted_preview": q_impacted_preview,
    "impacted_wkt": q_impacted_wkt,
    "fire_paired_1yr": q_fire_paired_1yr,
    "fire_results_1yr_all": _scenario_query("1yr_all"),
    "fire_results_5yr_all": _scenario_query("5yr_all"),
    "fire_results_1yr_large": _scenario_query("1yr_large"),
    "fire_results_5yr_large": _scenario_query("5yr_large"),
    "fire_results_long": q_fire_results_long,
    "mean_change": q_mean_change,
    "paired_ttest": q_paired_ttest,
    "scenario_summary": q_scenario_summary,
    "scenario_matrix": q_scenario_matrix,
    "paired_means": q_paired_means,
    "short_labels": q_short_labels,
}


# ---------------------------------------------------------------- stage C

KEYS = ["StationCode", "SampleDate", "index_right"]
# Display words of the binding's flag letters.
FLAG_WORDS = {"A": "Accepted", "N": "None", "R": "Returned", "F": "Filled", "O": "Open"}
BINDING_DISPLAY = {a: f"{FLAG_WORDS[a[0]]} {FLAG_WORDS[a[-1]]}" for a in A}
CLF_MIN_PRESENT = 3


def _model(spark, d):
    return ev.model_frame(_joined(spark, d))


MODEL_COLS = KEYS + ["FIRE_NAME", "days_since_fire", "post_fire", "log_acres", "month", "season_num",
                     "TargetLatitude", "TargetLongitude", "Region"]


def _model_frozen(spark, d):
    """The model frame for the fitting loops. It reads the materialised
    joined stage table, so their many passes never re-run the pipeline."""
    return _model(spark, d).select(*MODEL_COLS, *[q(a) for a in A])


def q_model_frame(spark, d):
    m = _model(spark, d)
    return normalise(m.select(*KEYS, "FIRE_NAME", "days_since_fire", "post_fire", "log_acres",
                              "month", "season_num", "TargetLatitude", "TargetLongitude", "Region",
                              *[q(a) for a in A]))


def q_row_counts(spark, d):
    j = _joined(spark, d)
    m_rows = binding_master(spark, d).count()
    days, name = F.col("days_since_fire"), F.col("FIRE_NAME")
    in_window = days.between(-1825, 1825)
    r = j.agg(F.count(F.lit(1)).alias("joined_rows"),
              F.count_if(name.isNotNull()).alias("matched_rows"),
              F.count_if(name.isNotNull() & (F.col("SampleYear") == F.col("FireYear"))).alias("same_year_rows"),
              F.count_if(name.isNotNull() & days.between(0, 30)).alias("one_month_rows"),
              F.count_if(in_window).alias("window_rows"),
              F.count_if(in_window & (days < 0)).alias("pre_fire_rows"),
              F.count_if(in_window & (days >= 0)).alias("post_fire_rows"))
    pairs = F.array(F.struct(F.lit("master_rows").alias("name"), F.lit(m_rows).cast("long").alias("n")),
                    *[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in r.columns])
    return r.select(F.explode(pairs).alias("p")).select("p.*")


def _clf_base(spark, d):
    return ml.classifier_frame(_model(spark, d), A, "post_fire", CLF_MIN_PRESENT, KEYS)


def q_class_balance(spark, d):
    return ev.normalized_counts(_clf_base(spark, d), "post_fire", 2)


def q_display_names(spark, d):
    a = analytes_found(bindings.readings_long(spark, d))
    return a.select("Analyte", lookup("Analyte", BINDING_DISPLAY).alias("display_name"))


ALBERS = AlbersParams()


def q_reproject_points(spark, d):
    sup = bindings.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    x = (F.pmod(k * 7919, F.lit(1000)) * 1000 - 500000).cast("double")
    y = (F.pmod(k * 104729, F.lit(1000)) * 1000 - 300000).cast("double")
    p = albers_inverse(x, y, ALBERS)
    return normalise(sup.select(k.alias("station_key"), x.alias("x"), y.alias("y"),
                                p["x"].alias("lon"), p["y"].alias("lat")))


def q_complete_cases(spark, d):
    m = _model(spark, d)

    def complete(a):
        return reduce(lambda x, y: x & y, [q(c).isNotNull() for c in list(MODEL_FEATURES) + [a]])
    r = m.agg(*[F.count_if(complete(a)).alias(f"_{i}") for i, a in enumerate(A)])
    pairs = F.array(*[F.struct(F.lit(a).alias("Analyte"), F.col(f"_{i}").cast("long").alias("n"))
                      for i, a in enumerate(A)])
    return r.select(F.explode(pairs).alias("p")).select("p.*")


def q_min_non_null(spark, d):
    return normalise(_clf_base(spark, d))


def _imputed(spark, d):
    return stats.median_impute(_clf_base(spark, d), A)


def q_median_impute(spark, d):
    return normalise(_imputed(spark, d))


def q_standardize(spark, d):
    return normalise(stats.standardize(_imputed(spark, d), A))


def q_balanced_weights(spark, d):
    b = _clf_base(spark, d)
    w = stats.balanced_weights(b, "post_fire", "weight")
    return normalise(w.groupBy("post_fire", "weight").agg(F.count(F.lit(1)).alias("n")))


def q_class_change(spark, d):
    c = stats.class_means(_imputed(spark, d), A, "post_fire")
    return c.select("Analyte", F.bround("before", 3).alias("before"), F.bround("after", 3).alias("after"),
                    F.bround("pct_change", 1).alias("pct_change"), "direction")


def q_hash_split(spark, d):
    s = ml.hash_split(_model(spark, d).select(*KEYS), KEYS, 0.2)
    return s.select(*KEYS, "is_test")


def q_stratified_split(spark, d):
    s = ml.hash_split(_clf_base(spark, d).select(*KEYS, "post_fire"), KEYS, 0.2, label_col="post_fire")
    return s.select(*KEYS, "post_fire", "is_test")


def q_capped_sample(spark, d):
    """The bounded training sample; the limit is the feature."""
    return ml.capped_sample(_model(spark, d).select(*KEYS, "days_since_fire"), KEYS, 5000)


def _rule_predictions(spark, d):
    # deterministic rule standing in for a model: late-year samples -> class 1
    m = _model(spark, d)
    return m.select("post_fire", (F.col("month") >= 7).cast("int").alias("prediction"))


def q_confusion_report(spark, d):
    cm = stats.confusion(_rule_predictions(spark, d), "post_fire", "prediction")
    return normalise(stats.class_report(cm))


def q_weighted_metrics(spark, d):
    cm = stats.confusion(_rule_predictions(spark, d), "post_fire", "prediction")
    return normalise(stats.weighted_metrics(cm))


def q_r2(spark, d):
    m = ev.complete_cases(_model(spark, d), ["season_num", A[0]])
    means = m.groupBy("season_num").agg(F.avg(q(A[0])).alias("prediction"))
    p = m.join(F.broadcast(means), "season_num")
    return normalise(stats.r2_score(p, A[0], "prediction"))


RF_TREES, RF_DEPTH = 20, 10
CLF_TREES = 100
_FITS: dict = {}
_FIT_LOCK = threading.RLock()


def _fitted(spark, d, what, fit):
    """A fit is made once per session and input version; its results are a
    handful of rows, shared by the queries that report on it."""
    key = (spark.sparkContext.applicationId, what, _binding_key(spark, d))
    with _FIT_LOCK:
        if key not in _FITS:
            _FITS[key] = fit()
        return _FITS[key]


def _forests(spark, d):
    return _fitted(spark, d, "forests", lambda: ml.rf_regression(_model_frozen(spark, d), A, num_trees=RF_TREES, max_depth=RF_DEPTH))


def q_rf_regression(spark, d):
    return _forests(spark, d)[0].orderBy(F.desc_nulls_last("r2"), "Analyte")


def q_rf_importance_matrix(spark, d):
    imp = _forests(spark, d)[1]
    return imp.groupBy("Analyte").pivot("feature", list(MODEL_FEATURES)).agg(F.first("importance"))


def _clf(spark, d):
    return _fitted(spark, d, "classifier", lambda: ml.rf_classifier(
        _model_frozen(spark, d), A, BINDING_DISPLAY, num_trees=CLF_TREES, min_present=CLF_MIN_PRESENT))


def q_rf_classifier(spark, d):
    out = _clf(spark, d)
    m = out["metrics"].first()
    rows = [(r["actual"], r["predicted"], r["n"], m["accuracy"], m["precision"], m["recall"], m["f1"])
            for r in out["confusion"].collect()]
    return spark.createDataFrame(rows, "actual int, predicted int, n long, accuracy double, "
                                       "precision double, recall double, f1 double")


def q_impact_ranking(spark, d):
    return _clf(spark, d)["ranking"]


def q_impact_by_change(spark, d):
    """The impact ranking ordered by percent change, ascending."""
    return _clf(spark, d)["ranking"].orderBy("pct_change", "Analyte")


def q_rf_class_report(spark, d):
    """A19 on the forest's held-out predictions."""
    return stats.class_report(_clf(spark, d)["confusion"])


#: features with many values, which the trees see in bins of equal counts
TREE_BINNED = ("days_since_fire", "log_acres", "TargetLatitude", "TargetLongitude")


def _tree_rows(spark, d):
    """Rows of the regression trees, with ``is_test``: the exact-size hash split
    of the model frame, features in bins."""
    m = _model_frozen(spark, d)
    seen = trees.binned(m, trees.quantile_cuts(m, TREE_BINNED))
    return trees.long_rows(ml.hash_split(seen, KEYS, 0.2), A, MODEL_FEATURES, beside=["is_test"])


def _tree(spark, d):
    def fit():
        with passes_over(_tree_rows(spark, d)) as rows:
            tree = trees.grow(rows.where(~F.col("is_test")), kept=True)
            return tree, ml._local(trees.r2_by_target(trees.predict(rows.where("is_test"), tree)))
    return _fitted(spark, d, "tree", fit)


def q_rf_tree_splits(spark, d):
    """M3: the regression tree of each analyte, node by node."""
    return normalise(_tree(spark, d)[0].drop("weight"), 4)


def q_rf_tree_importances(spark, d):
    """M4: each feature's share of a tree's gains."""
    return normalise(trees.importances(_tree(spark, d)[0], MODEL_FEATURES).withColumnRenamed("target", "Analyte"))


def q_rf_tree_results(spark, d):
    """M3 + O6: held-out R2, rows and the most important feature (ties to the
    earlier one)."""
    tree, r2 = _tree(spark, d)
    names = F.array(*[F.lit(f) for f in MODEL_FEATURES])
    # one number orders by importance, then by place: the greatest is the first of the greatest
    key = F.round(F.col("importance") * 1e9).cast("long") * 64 + 64 - F.array_position(names, F.col("feature"))
    top = trees.importances(tree, MODEL_FEATURES).groupBy("target").agg(F.max(key).alias("k")) \
        .select("target", F.get(names, 63 - F.pmod("k", F.lit(64)).cast("int")).alias("top_feature"))
    return normalise(r2.join(top, "target").select(F.col("target").alias("Analyte"), "r2", "top_feature", F.col("n").alias("n_test")), 4)


def _clf_tree(spark, d):
    def fit():
        imputed = _imputed(spark, d)
        split = ml.hash_split(imputed, KEYS, 0.2, label_col="post_fire")
        train = stats.balanced_weights(split.where(~F.col("is_test")), "post_fire", "weight")
        tree = trees.grow(trees.long_rows(train, ["post_fire"], A, F.col("weight")))
        voted = trees.predict(trees.long_rows(split.where("is_test"), ["post_fire"], A), tree)
        cm = ml._local(stats.confusion(voted.withColumn("vote", (F.col("prediction") > 0.5).cast("int")), "y", "vote"))
        return tree, cm, ml._local(stats.class_means(imputed, A, "post_fire"))
    return _fitted(spark, d, "clf_tree", fit)


def q_clf_tree_splits(spark, d):
    """Splits by Gini impurity with balanced class weights; ``value`` is
    the weighted share of rows after the event."""
    return normalise(_clf_tree(spark, d)[0], 4)


def q_clf_tree_confusion(spark, d):
    """A18 on held-out rows, soft votes of the tree."""
    return _clf_tree(spark, d)[1]


def q_clf_tree_ranking(spark, d):
    """M18 + M19 + J4: change of each analyte beside its importance."""
    tree, _, change = _clf_tree(spark, d)
    imp = trees.importances(tree, A).select(F.col("feature").alias("Analyte"), "importance")
    return change.join(F.broadcast(imp), "Analyte").select(
        lookup("Analyte", BINDING_DISPLAY).alias("Analyte"), F.bround("before", 3).alias("Before"), F.bround("after", 3).alias("After"),
        F.bround("pct_change", 1).alias("pct_change"), F.col("direction").alias("Direction"), F.bround("importance", 4).alias("Importance"))


def q_ranking_sorted(spark, d):
    """O3: the ranking with each row's place in the written table."""
    return add_surrogate_id(q_clf_tree_ranking(spark, d), published_order("analyte_impact_ranking"), "position")


def q_rf_tree_results_sorted(spark, d):
    """O3: the regression results with each row's place in the written table."""
    return add_surrogate_id(q_rf_tree_results(spark, d), published_order("random_forest_results"), "position")


def q_gam_basis_ranges(spark, d):
    return normalise(gam_ops.basis_ranges(_model(spark, d), A).drop("mean"))


def q_gam_gram(spark, d):
    """The sums the additive models are solved from, cell by cell."""
    cells = gam_ops.gram_cells(_model_frozen(spark, d), A, min_rows=1)
    return cells.select("target", "i", "j", F.round("value", 4).alias("value")).where("value <> 0")


def _gam(spark, d):
    return _fitted(spark, d, "gam", lambda: gam_ops.gam_results(_model_frozen(spark, d), A, labels={a: a for a in A}))


def q_gam_results(spark, d):
    return _gam(spark, d)[0]


def q_gam_coefficients(spark, d):
    """The additive models' coefficients, solved in the engine from the sums
    of ``gam_gram``; index 0 is the intercept."""
    ok = _gam(spark, d)[2].where("status = 'ok'")
    return ok.select("target", F.posexplode("beta").alias("i", "_b")).select("target", "i", F.round("_b", 5).alias("beta"))


def q_gam_curve(spark, d):
    c = _gam(spark, d)[1]
    return c.select("Analyte", "i", *[F.round(x, 5).alias(x) for x in ("x", "effect", "lower", "upper")])


def q_model_summary(spark, d):
    rf, g = _forests(spark, d)[0], _gam(spark, d)[0]
    return (rf.select("Analyte", F.col("r2").alias("rf_r2"), "top_feature")
              .join(g.select("Analyte", F.col("r2").alias("gam_r2"), "post_fire_change", "Direction"),
                    "Analyte", "full"))


QUERIES.update({
    "model_frame": q_model_frame,
    "row_counts": q_row_counts,
    "class_balance": q_class_balance,
    "display_names": q_display_names,
    "reproject_points": q_reproject_points,
    "complete_cases": q_complete_cases,
    "min_non_null": q_min_non_null,
    "median_impute": q_median_impute,
    "standardize": q_standardize,
    "balanced_weights": q_balanced_weights,
    "class_change": q_class_change,
    "hash_split": q_hash_split,
    "stratified_split": q_stratified_split,
    "capped_sample": q_capped_sample,
    "confusion_report": q_confusion_report,
    "weighted_metrics": q_weighted_metrics,
    "r2": q_r2,
    "rf_regression": q_rf_regression,
    "rf_importance_matrix": q_rf_importance_matrix,
    "rf_classifier": q_rf_classifier,
    "impact_ranking": q_impact_ranking,
    "impact_by_change": q_impact_by_change,
    "rf_class_report": q_rf_class_report,
    "rf_tree_splits": q_rf_tree_splits,
    "rf_tree_importances": q_rf_tree_importances,
    "rf_tree_results": q_rf_tree_results,
    "clf_tree_splits": q_clf_tree_splits,
    "clf_tree_confusion": q_clf_tree_confusion,
    "clf_tree_ranking": q_clf_tree_ranking,
    "ranking_sorted": q_ranking_sorted,
    "rf_tree_results_sorted": q_rf_tree_results_sorted,
    "gam_basis_ranges": q_gam_basis_ranges,
    "gam_gram": q_gam_gram,
    "gam_results": q_gam_results,
    "gam_coefficients": q_gam_coefficients,
    "gam_curve": q_gam_curve,
    "model_summary": q_model_summary,
})


def q_mixed_effects(spark, d):
    from cinderwell.operators.mixed import mixed_effects
    return mixed_effects(_model(spark, d), A, "post_fire", "StationCode")


QUERIES["mixed_effects"] = q_mixed_effects


def q_mixed_station_stats(spark, d):
    from cinderwell.operators.mixed import station_stats
    s = station_stats(_model(spark, d), A, "post_fire", "StationCode")
    return normalise(s.withColumnRenamed("g", "StationCode").withColumn("n", F.col("n").cast("long")))


QUERIES["mixed_station_stats"] = q_mixed_station_stats


MIXED_RATIOS = (0.0, 0.01, 0.1, 1.0, 10.0)


def q_mixed_grid_sums(spark, d):
    """The sums of the mixed model's profiled likelihood at fixed variance
    ratios."""
    from cinderwell.operators.mixed import grid_sums, station_stats
    return normalise(grid_sums(station_stats(_model(spark, d), A, "post_fire", "StationCode"), {a: MIXED_RATIOS for a in A}), 4)


QUERIES["mixed_grid_sums"] = q_mixed_grid_sums
