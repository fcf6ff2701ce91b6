"""Before/after event study.

All scenarios (after-window length x minimum size) run in ONE aggregation:
each row is expanded to the scenarios it can belong to by a generator in the
map stage, then a single ``groupBy(scenario, event)`` with conditional
aggregates and map-side partial aggregation replaces the per-event loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderwell.functions.labels import UP_DOWN_ARROWS, direction, short_label_py
from cinderwell.functions.tdist import t_two_sided_p
from cinderwell.sources.schema import q

# The four published scenarios (name, after-window days, min acres).
SCENARIOS = (
    ("1yr_all", 365, 0.0),
    ("5yr_all", 1825, 0.0),
    ("1yr_large", 365, 50_000.0),
    ("5yr_large", 1825, 50_000.0),
)
# Section-1 study: 1-year window with no size filter (NULL sizes kept).
SECTION1 = (("1yr", 365, None),)

DEFAULT_ORDER = ("StationCode", "SampleDate", "StationName", "TargetLatitude",
                 "TargetLongitude", "Region", "index_right")


def _scenario_array(scenarios) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(int(d)).alias("after_days"),
                              F.lit(None if m is None else float(m)).cast("double").alias("min_acres"))
                     for n, d, m in scenarios])


def fire_results(joined: DataFrame, analytes, scenarios=SCENARIOS, name_col="FIRE_NAME",
                 days_col="days_since_fire", acres_col="GIS_ACRES",
                 order_cols=DEFAULT_ORDER) -> DataFrame:
    """A5/A6 in long form, one row per (scenario, event, analyte):

    scenario, Fire, GIS_Acres, n_before, n_after, Analyte, n_b, n_a,
    before, after, change.

    * before = days < 0 (no lower bound); after = 0 <= days <= after_days;
    * an event is kept only with >= 1 row on each side (rows, whatever the
      analyte values, F11);
    * before/after/change are NULL unless both sides have a value (F12);
    * GIS_Acres is the size on the event's first row in reading order,
      NULL kept (A22); ``min_acres`` drops NULL sizes, ``None`` keeps them.
    """
    d, acres = F.col(days_col), F.col(acres_col)
    if isinstance(order_cols, str):
        order = q(order_cols)  # a single fixed-width key keeps the aggregate hash-based
    else:
        order = F.struct(*[q(c) for c in order_cols if c in joined.columns])
    base = (joined.where(F.col(name_col).isNotNull() & d.isNotNull())
                  .select(F.col(name_col).alias("Fire"), d.alias("_d"), acres.alias("_acres"),
                          order.alias("_ord"), *[q(a) for a in analytes],
                          F.explode(_scenario_array(scenarios)).alias("_s")))
    keep = F.col("_s.min_acres").isNull() | (F.col("_acres") >= F.col("_s.min_acres"))
    base = base.where(keep)
    is_b = F.col("_d") < 0
    is_a = (F.col("_d") >= 0) & (F.col("_d") <= F.col("_s.after_days"))
    aggs = [F.count_if(is_b).alias("n_before"), F.count_if(is_a).alias("n_after"),
            F.min_by("_acres", "_ord").alias("GIS_Acres")]
    for i, a in enumerate(analytes):
        v = q(a)
        aggs += [F.avg(F.when(is_b, v)).alias(f"_b{i}"), F.avg(F.when(is_a, v)).alias(f"_a{i}"),
                 F.count(F.when(is_b, v)).alias(f"_nb{i}"), F.count(F.when(is_a, v)).alias(f"_na{i}")]
    per_fire = (base.groupBy(F.col("_s.scenario").alias("scenario"), "Fire").agg(*aggs)
                    .where((F.col("n_before") > 0) & (F.col("n_after") > 0)))
    cells = []
    for i, a in enumerate(analytes):
        ok = (F.col(f"_nb{i}") > 0) & (F.col(f"_na{i}") > 0)
        b, af = F.when(ok, F.col(f"_b{i}")), F.when(ok, F.col(f"_a{i}"))
        cells.append(F.struct(F.lit(a).alias("Analyte"), F.col(f"_nb{i}").alias("n_b"),
                              F.col(f"_na{i}").alias("n_a"), b.alias("before"),
                              af.alias("after"), (af - b).alias("change")))
    return (per_fire.select("scenario", "Fire", "GIS_Acres", "n_before", "n_after",
                            F.explode(F.array(*cells)).alias("_c"))
                    .select("scenario", "Fire", "GIS_Acres", "n_before", "n_after", "_c.*"))


def fire_results_wide(results: DataFrame, analytes, labels: dict | None = None) -> DataFrame:
    """Per-event table in the published shape: Fire, GIS_Acres, n_before,
    n_after, then <label>_before/_after/_change per analyte. Labels default
    to the text before the first comma and must be unique."""
    labels = labels or {a: short_label_py(a) for a in analytes}
    if len(set(labels[a] for a in analytes)) != len(analytes):
        raise ValueError("analyte labels collide; pass explicit labels")
    aggs = []
    for a in analytes:
        is_a = F.col("Analyte") == a
        for part in ("before", "after", "change"):
            aggs.append(F.max(F.when(is_a, F.col(part))).alias(f"{labels[a]}_{part}"))
    return results.groupBy("scenario", "Fire", "GIS_Acres", "n_before", "n_after").agg(*aggs)


def mean_change(results: DataFrame) -> DataFrame:
    """Mean change per (scenario, analyte) over events with a change."""
    return (results.where(F.col("change").isNotNull())
                   .groupBy("scenario", "Analyte")
                   .agg(F.avg("change").alias("mean_change"), F.count("change").alias("n_fires"))
                   .withColumn("direction", direction("mean_change", ("↑ increased", "↓ decreased"))))


def paired_ttest(results: DataFrame, min_pairs: int = 2) -> DataFrame:
    """Two-sided paired t-test of before vs after across events, per
    (scenario, analyte). d = before - after, t = mean(d) / (sd(d)/sqrt(n)),
    v = n - 1. sd = 0: p NULL when mean(d) = 0, else 0. Fewer than
    ``min_pairs`` pairs: no row (F13)."""
    d = F.col("before") - F.col("after")
    pairs = results.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    s = (pairs.groupBy("scenario", "Analyte")
              .agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(d).alias("mean_diff"),
                   F.stddev_samp(d).alias("sd_diff"), F.avg("change").alias("mean_change"),
                   F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"))
              .where(F.col("n_pairs") >= min_pairs))
    sd, m, n = F.col("sd_diff"), F.col("mean_diff"), F.col("n_pairs")
    t = F.when(sd > 0, m / (sd / F.sqrt(n.cast("double"))))
    p = (F.when(sd > 0, t_two_sided_p(t, n - 1))
          .when(m == 0, F.lit(None).cast("double")).otherwise(F.lit(0.0)))
    return s.withColumn("t_stat", t).withColumn("p_value", p) \
            .withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def scenario_summary(results: DataFrame, min_pairs: int = 2) -> DataFrame:
    """Analyte, mean change, p-value, n_fires per scenario, only for
    analytes with at least two complete pairs."""
    tt = paired_ttest(results, min_pairs)
    return tt.select("scenario", "Analyte", F.col("mean_change"), "p_value",
                     F.col("n_pairs").alias("n_fires"),
                     direction("mean_change", UP_DOWN_ARROWS).alias("direction"))


def scenario_matrix(results: DataFrame, analytes, scenarios=SCENARIOS) -> DataFrame:
    """A10: mean change for every (analyte, scenario) cell, 0 where the
    scenario has no value (grid of literal size, left-joined)."""
    grid = (results.sparkSession.range(1)
            .select(F.explode(F.array(*[F.lit(s[0]) for s in scenarios])).alias("scenario"))
            .select("scenario", F.explode(F.array(*[F.lit(a) for a in analytes])).alias("Analyte")))
    means = mean_change(results).select("scenario", "Analyte", "mean_change")
    return (grid.join(F.broadcast(means), ["scenario", "Analyte"], "left")
                .select("scenario", "Analyte",
                        F.coalesce("mean_change", F.lit(0.0)).alias("mean_change"))
                .withColumn("direction", F.when(F.col("mean_change") >= 0, "up").otherwise("down")))


def paired_means(results: DataFrame) -> DataFrame:
    """Means of before and of after over complete pairs (line-chart
    data), per (scenario, analyte)."""
    pairs = results.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    return pairs.groupBy("scenario", "Analyte").agg(
        F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"),
        F.count(F.lit(1)).alias("n_pairs"))
