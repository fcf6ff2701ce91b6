"""The three stages on domain inputs: analyte CSV files and perimeter layers.

A user of the original scripts calls these with their own paths:

* ``build_master(spark, analyte_files)`` -> (master, units): stack, units,
  pivot, metadata join, dense WaterQualityID (stage 1).
* ``build_spatial_join(master, fires)`` -> joined: SampleYear, index_right,
  fire attributes, FireYear; ``same_year(joined)`` for the same-year subset.
* ``event_study(joined)`` -> dict of the stage-2 tables; ``run_models(joined)``
  -> dict of the stage-3 tables; ``run_all(...)`` writes them all.

The master and the joined table are written once below the checkpoint folder
and read back by all that follows; a fixed-width row order makes the event
study one hash aggregation. ``run_all`` writes the published tables, ordered
and with the published headers, with ``write_table`` (CSV with header or
Parquet).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.functions.dates import parse_date
from cinderwell.functions.labels import DISPLAY_NAMES, short_label, short_label_py
from cinderwell.operators import events as ev
from cinderwell.operators import gam, ml, study
from cinderwell.operators.mixed import mixed_effects
from cinderwell.operators.reshape import add_surrogate_id, master_wide, units_reference
from cinderwell.operators.spatial import spatial_join
from cinderwell.plans.stages import with_row_order
from cinderwell.session import written_table
from cinderwell.sources.files import (BLOCK_COL, FILE_COL, SEQ_COL, read_readings, write_if_nonempty,
                                      write_table)
from cinderwell.sources.schema import (CLASSIFIER_ANALYTES, DOMAIN_ANALYTES, META_COLS, STUDY_ANALYTES, q)

FIRE_COLS = ("FIRE_NAME", "ALARM_DATE", "GIS_ACRES")


def load_readings(spark: SparkSession, analyte_files, multi_line: bool = False, strict: bool = True) -> DataFrame:
    """S1 + P5: typed long readings with a file-order key ``ord``. Numbers and
    dates that cannot be read raise, or are NULL without ``strict``."""
    r = read_readings(spark, analyte_files, multi_line=multi_line, strict=strict)
    raw, date = F.col("SampleDate"), parse_date(F.col("SampleDate"))
    if strict:
        date = F.when(raw.isNotNull() & date.isNull(), F.raise_error(F.concat(F.lit("SampleDate: cannot read "), raw))).otherwise(date)
    return r.withColumn("SampleDate", date) \
            .withColumn("ord", F.struct(F.col(FILE_COL), F.col(BLOCK_COL), F.col(SEQ_COL)))


def build_master(spark: SparkSession, analyte_files, analytes=None, **reading):
    """Stage 1a: (master, units). ``analytes`` defaults to the analytes found
    in the files (A1), which fixes the wide schema in one small job. The master
    is written once, in order (``add_surrogate_id``)."""
    long = load_readings(spark, analyte_files, **reading)
    if analytes is None:
        analytes = sorted(r[0] for r in long.select("Analyte").where(F.col("Analyte").isNotNull())
                          .distinct().collect())
    units = units_reference(long, ("StationCode", "SampleDate", "ord"))
    master = add_surrogate_id(master_wide(long, analytes), list(META_COLS))
    return master, units


def build_spatial_join(master: DataFrame, fires: DataFrame, cell: float = 0.25) -> DataFrame:
    """Stage 1b (J2): readings x perimeters, left, with years; written once,
    with the row order ``row_ord`` as the last column."""
    j = spatial_join(master, ev.add_fire_year(fires), fire_cols=[*FIRE_COLS, "FireYear"], cell=cell)
    j = j.withColumn("SampleYear", F.year("SampleDate").cast("int"))
    tail = ["SampleYear", "index_right", "FIRE_NAME", "ALARM_DATE", "FireYear", "GIS_ACRES"]
    j = j.select(*[q(c) for c in master.columns + tail])
    if "WaterQualityID" in j.columns:
        j = with_row_order(j, fires)
    return written_table(j, "joined")


def same_year(joined: DataFrame) -> DataFrame:
    return ev.same_year(joined)


def _present(df: DataFrame, names) -> list[str]:
    return [a for a in names if a in df.columns]


def event_study(joined: DataFrame, analytes=STUDY_ANALYTES, large_acres: float = 50_000.0) -> dict:
    """Stage 2: per-fire 1-year table, the four scenarios (with their
    summaries and matrix), and the one-month impact rows."""
    timed = ev.add_event_time(ev.matched(joined))
    analytes = _present(timed, analytes)
    order = "row_ord" if "row_ord" in timed.columns else \
        ("WaterQualityID", "index_right") if "WaterQualityID" in timed.columns else study.DEFAULT_ORDER
    labels = {a: short_label_py(a) for a in analytes}
    s1 = study.fire_results(timed, analytes, study.SECTION1, order_cols=order)
    scen = tuple((n, d, m if m == 0 else large_acres) for n, d, m in study.SCENARIOS)
    res = study.fire_results(timed, analytes, scen, order_cols=order)
    return {
        "fire_paired_results": study.fire_results_wide(s1, analytes, labels).drop("scenario"),
        "paired_ttest_1yr": study.paired_ttest(s1),
        "scenario_results": res,
        "scenario_summary": study.scenario_summary(res),
        "scenario_matrix": study.scenario_matrix(res, analytes, scen),
        "large_fires_5yr_results": study.fire_results_wide(res.where(F.col("scenario") == "5yr_large"),
                                                           analytes, labels).drop("scenario"),
        "impacted_within_1month": ev.day_window(timed, 0, 30).drop("row_ord"),
    }


def run_models(joined: DataFrame, analytes=DOMAIN_ANALYTES, clf_analytes=CLASSIFIER_ANALYTES) -> dict:
    """Stage 3: forests (regression, importances, classifier ranking), the
    additive models, and the random-intercept summary."""
    model = ev.model_frame(ev.add_event_time(joined))
    keys = ("StationCode", "SampleDate", "index_right")
    analytes = _present(model, analytes)
    clf_analytes = _present(model, clf_analytes)
    labels = {a: short_label_py(a) for a in analytes}
    rf, imp = ml.rf_regression(model, analytes, key_cols=keys, isolate=True)
    g_res, g_curves, _ = gam.gam_results(model, analytes, labels=labels)
    out = {"random_forest_results": rf.withColumn("Analyte", F.substring_index("Analyte", ",", 1)),
           "rf_feature_importance": imp,
           "gam_results": g_res.withColumn("Analyte", F.substring_index("Analyte", ",", 1)),
           "gam_effects": g_curves,
           "mixed_effects_results": mixed_effects(model, analytes, labels=labels)}
    if clf_analytes:
        clf = ml.rf_classifier(model, clf_analytes, {a: DISPLAY_NAMES.get(a, a) for a in clf_analytes},
                               key_cols=keys)
        out["analyte_impact_ranking"] = clf["ranking"]
        out["classifier_confusion"] = clf["confusion"]
        out["classifier_metrics"] = clf["metrics"]
    return out


#: fixed values: headers of the published tables, by column here
HEADERS = {
    "random_forest_results": {"Analyte": "Analyte", "r2": "R²", "top_feature": "top_feature", "n": "n"},
    "gam_results": {"Analyte": "Analyte", "r2": "R²", "post_fire_change": "Post-fire change", "Direction": "Direction", "Accuracy": "Accuracy",
                    "Precision": "Precision", "Recall": "Recall", "F1": "F1", "n": "n"},
    "analyte_impact_ranking": {"Analyte": "Analyte", "Before": "Before", "After": "After", "pct_change": "% Change", "Direction": "Direction", "Importance": "Importance"},
    "mixed_effects_results": {"Analyte": "Analyte", "Coefficient": "Coefficient", "p_value": "p-value", "Significant": "Significant", "Direction": "Direction",
                              "n_readings": "n_readings", "n_stations": "n_stations"},
    "scenario_summary": {"scenario": "scenario", "Analyte": "Analyte", "mean_change": "Mean Change", "p_value": "p-value", "n_fires": "n_fires"},
}

def published_order(name: str) -> list:
    """What a result table is published by; nothing for one without an order."""
    return {
        "analyte_units_reference": ["Analyte"], "water_quality_allinfo_master": ["WaterQualityID"],
        "all_stations_fire_joined": ["WaterQualityID", "index_right"], "stations_within_fires_sameyear": ["WaterQualityID", "index_right"],
        "impacted_within_1month": ["WaterQualityID", "index_right"], "fire_paired_results": ["Fire"], "large_fires_5yr_results": ["Fire"],
        "random_forest_results": [F.desc_nulls_last("r2"), "Analyte"], "gam_results": [F.desc_nulls_last("post_fire_change"), "Analyte"],
        "analyte_impact_ranking": [F.desc("Importance"), "Analyte"], "scenario_summary": ["scenario", "Analyte"],
    }.get(name, [])


def published(name: str, df: DataFrame) -> DataFrame:
    """A result table in its published order, with its published headers."""
    order = published_order(name)
    df = df.orderBy(*order) if order else df
    if name == "scenario_summary":
        df = df.withColumn("Analyte", short_label("Analyte"))
    headers = HEADERS.get(name)
    return df.select(*[q(c).alias(h) for c, h in headers.items()]) if headers else df


def run_all(spark: SparkSession, analyte_files, fires: DataFrame, out_dir: str, fmt: str = "csv", **reading) -> dict:
    """All three stages; every table written under ``out_dir/<name>``. Analytes
    that a model did not fit are in ``model_status``, with the reason."""
    master, units = build_master(spark, analyte_files, **reading)
    joined = build_spatial_join(master, fires)
    plain = joined.drop("row_ord")
    tables = {"analyte_units_reference": units, "water_quality_allinfo_master": master,
              "all_stations_fire_joined": plain, "stations_within_fires_sameyear": same_year(plain)}
    tables.update(event_study(joined))
    models = run_models(joined)
    rows = {"random_forest_results": "n", "gam_results": "n", "mixed_effects_results": "n_readings"}
    tables["model_status"] = reduce(DataFrame.unionByName, [
        models[t].select(F.lit(t).alias("table"), "Analyte", F.col(n).alias("n"), "status") for t, n in rows.items()])
    tables.update({n: t.where("status = 'ok'") if "status" in t.columns else t for n, t in models.items()})
    tables = {n: published(n, t) for n, t in tables.items()}
    for name, df in tables.items():
        if name == "gam_results":
            write_if_nonempty(df, f"{out_dir.rstrip('/')}/{name}", fmt)
        else:
            write_table(df, f"{out_dir.rstrip('/')}/{name}", fmt)
    return tables
