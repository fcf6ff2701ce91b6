"""Event time, windows and the event study (FIXTURES §3)."""

import math
import datetime as dt

from pyspark.sql import functions as F

from cinderwell.functions.dates import days_between, season_of_month

from cinderwell.operators import study

SCHEMA = ("FIRE_NAME string, days_since_fire int, GIS_ACRES double, StationCode string, "
          "SampleDate date, x double")


def test_days_floor(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), dt.datetime(2020, 1, 1, 12, 0))], "s date, a timestamp")
    assert df.select(days_between("s", "a").alias("d")).first()["d"] == -1


def test_season(spark):
    df = spark.createDataFrame([(m,) for m in (12, 1, 2, 3, 6, 9, 11)], "m int")
    assert [r["s"] for r in df.select(season_of_month("m").alias("s")).collect()] == [0, 0, 0, 1, 2, 3, 3]


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_windows_and_guards(spark):
    d = dt.date(2020, 1, 1)
    rows = [("F", -1, 10.0, "a", d, 1.0), ("F", 0, 10.0, "b", d, None), ("F", 365, 10.0, "c", d, None),
            ("F", 366, 10.0, "d", d, 9.0),            # outside the 1-year window
            ("ONLY_BEFORE", -5, 10.0, "a", d, 1.0)]  # no after rows -> absent
    r = study.fire_results(_rows(spark, rows), ["x"], study.SECTION1,
                           order_cols=("StationCode", "SampleDate")).collect()
    assert len(r) == 1
    row = r[0]
    assert (row["Fire"], row["n_before"], row["n_after"]) == ("F", 1, 2)
    # the analyte has a before value but no after value -> cell is NULL
    assert row["before"] is None and row["after"] is None and row["change"] is None


def test_min_acres_and_first_acres(spark):
    d = dt.date(2020, 1, 1)
    rows = [("N", -1, None, "a", d, 1.0), ("N", 1, 5.0, "b", d, 2.0),        # first acres NULL
            ("L", -1, 50000.0, "a", d, 1.0), ("L", 1, 50000.0, "b", d, 3.0),
            ("S", -1, 49999.99, "a", d, 1.0), ("S", 1, 49999.99, "b", d, 3.0)]
    scen = (("s1", 365, None), ("all", 365, 0.0), ("large", 365, 50000.0))
    r = study.fire_results(_rows(spark, rows), ["x"], scen, order_cols=("StationCode", "SampleDate"))
    got = {(x["scenario"], x["Fire"]): x["GIS_Acres"] for x in r.collect()}
    assert got[("s1", "N")] is None                 # first row's NULL acres kept
    assert ("all", "N") not in got                  # NULL acres drop even with min 0
    assert ("large", "L") in got and ("large", "S") not in got


def test_names_not_trimmed(spark):
    d = dt.date(2020, 1, 1)
    rows = [("CARR ", -1, 1.0, "a", d, 1.0), ("CARR ", 1, 1.0, "a", d, 2.0),
            ("CARR", -1, 1.0, "a", d, 1.0), ("CARR", 1, 1.0, "a", d, 2.0)]
    r = study.fire_results(_rows(spark, rows), ["x"], study.SECTION1, order_cols=("StationCode",))
    assert sorted(x["Fire"] for x in r.collect()) == ["CARR", "CARR "]


def _results(spark, pairs):
    return spark.createDataFrame([("s", f"F{i}", "x", b, a, a - b) for i, (b, a) in enumerate(pairs)],
                                 "scenario string, Fire string, Analyte string, before double, after double, change double")


def test_ttest_cases(spark):
    assert study.paired_ttest(_results(spark, [(1.0, 2.0)])).count() == 0           # n = 1
    same = study.paired_ttest(_results(spark, [(1.0, 1.0), (2.0, 2.0)])).first()
    assert same["p_value"] is None                                                   # sd 0, mean 0
    const = study.paired_ttest(_results(spark, [(1.0, 2.0), (3.0, 4.0)])).first()
    assert const["p_value"] == 0.0                                                   # sd 0, mean != 0
    pairs = [(1.0, 2.5), (2.0, 2.0), (3.0, 5.0), (1.5, 1.0), (4.0, 6.5)]
    got = study.paired_ttest(_results(spark, pairs)).first()
    import statistics
    d = [b - a for b, a in pairs]
    t = statistics.mean(d) / (statistics.stdev(d) / len(d) ** 0.5)
    assert abs(got["t_stat"] - t) < 1e-12
    assert abs(got["p_value"] - t_sf_python(t, len(d) - 1)) < 1e-12


def test_published_pvalues():
    # paired tests recomputed from the published per-fire tables
    for n, t, p in [(29, -0.931301, 0.359659), (23, -0.566593, 0.576726), (9, -0.166404, 0.871968),
                    (27, -0.935951, 0.357911), (19, -1.709947, 0.104457), (33, -1.870866, 0.070533),
                    (26, -1.620022, 0.117775), (24, -1.744823, 0.094365)]:
        assert abs(t_sf_python(t, n - 1) - p) < 2e-6


def test_pvalue_sql_equals_python(spark):
    from cinderwell.functions.tdist import t_two_sided_p
    cases = [(t, v) for v in (1, 2, 3, 4, 7, 10, 11, 24, 33, 101) for t in (0.0, 0.3, -1.2, 2.5, 8.0)]
    df = spark.createDataFrame(cases, "t double, v int")
    for r in df.select("t", "v", t_two_sided_p("t", "v").alias("p")).collect():
        assert abs(r["p"] - t_sf_python(r["t"], r["v"])) < 1e-12


def test_four_scenarios_equal_separate_runs(spark):
    d = dt.date(2020, 1, 1)
    rows = [(f"F{i % 3}", (i * 37) % 900 - 300, float((i % 4) * 30000), f"s{i}", d, float(i % 11))
            for i in range(120)]
    df = _rows(spark, rows)
    together = {(r["scenario"], r["Fire"], r["Analyte"]): r["change"]
                for r in study.fire_results(df, ["x"], study.SCENARIOS, order_cols=("StationCode",)).collect()}
    for sc in study.SCENARIOS:
        alone = study.fire_results(df, ["x"], (sc,), order_cols=("StationCode",)).collect()
        for r in alone:
            assert together[(r["scenario"], r["Fire"], r["Analyte"])] == r["change"]


def test_same_name_two_alarm_dates(spark):
    """T5: one group per name; each row classified by its own alarm date."""
    from cinderwell.operators.events import add_event_time
    rows = [("X", dt.date(2020, 1, 10), dt.datetime(2020, 1, 1), 1.0, "a", 1.0),   # +9 -> after
            ("X", dt.date(2020, 1, 10), dt.datetime(2021, 1, 1), 1.0, "b", 3.0),   # -357 -> before
            ("X", dt.date(2019, 6, 1), dt.datetime(2020, 1, 1), 1.0, "c", 5.0)]    # before
    df = spark.createDataFrame(rows, "FIRE_NAME string, SampleDate date, ALARM_DATE timestamp, "
                                     "GIS_ACRES double, StationCode string, x double")
    r = study.fire_results(add_event_time(df), ["x"], study.SECTION1, order_cols=("StationCode",)).collect()
    assert len(r) == 1
    assert (r[0]["n_before"], r[0]["n_after"], r[0]["before"], r[0]["after"]) == (2, 1, 4.0, 1.0)


def test_nan_is_missing(spark):
    """NaN read from text is NULL before any comparison or mean."""
    from cinderwell.sources.schema import READINGS_SCHEMA, typed_from_text
    raw = spark.createDataFrame([("NaN",), ("nan",), ("2.5",), ("-0.005",)], "Result string")
    got = [r["Result"] for r in typed_from_text(raw, READINGS_SCHEMA).collect()]
    assert got == [None, None, 2.5, -0.005]


def t_sf_python(t: float, v: int) -> float:
    """The two-sided p-value by Simpson's rule on the density."""
    log_k = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)
    n, b = 20_000, abs(t)
    f = lambda x: math.exp(log_k - (v + 1) / 2 * math.log1p(x * x / v))
    h = b / n
    area = sum((1 if i in (0, n) else 4 if i % 2 else 2) * f(i * h) for i in range(n + 1)) * h / 3
    return 1 - 2 * area


def test_far_tail_keeps_its_digits(spark):
    from pyspark.sql import functions as F

    from cinderwell.functions.tdist import t_two_sided_p
    rows = [(t, v) for t in (1.5, 3.0, 9.0, 20.0, 1e6) for v in (1, 2, 4, 60, 100)]
    got = {(r["t"], r["v"]): r["p"] for r in spark.createDataFrame(rows, "t double, v int").withColumn("p", t_two_sided_p("t", "v")).collect()}
    for t in (1.5, 9.0, 1e6):
        assert math.isclose(got[t, 1], 2 / math.pi * math.atan(1 / t), rel_tol=1e-9)
        r = t / math.sqrt(2 + t * t)
        assert math.isclose(got[t, 2], 2 / (2 + t * t) / (1 + r), rel_tol=1e-9)
    assert 0 < got[20.0, 100] < 1e-30 and 0 < got[9.0, 60] < 2e-12 and got[1e6, 100] == 0.0
    for t, v in ((1.5, 60), (3.0, 4), (3.0, 100)):
        assert math.isclose(got[t, v], t_sf_python(t, v), rel_tol=1e-7)
