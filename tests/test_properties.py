"""Property tests: pivot/unpivot round trip and invariance under
repartitioning (SURVEY §5 (c), (d))."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinderwell.operators import study
from cinderwell.operators.reshape import pivot_wide

ANALYTES = ["a, x", "b", "pH"]


def _long_rows(seed, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((f"S{rnd.randint(0, 9)}", dt.date(2020, 1, 1 + rnd.randint(0, 20)),
                     rnd.choice(ANALYTES), rnd.choice([None, float(rnd.randint(0, 50))]), i))
    return rows


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_pivot_unpivot_round_trip(spark, seed):
    rows = _long_rows(seed)
    df = spark.createDataFrame(rows, "StationCode string, SampleDate date, Analyte string, Result double, ord long")
    wide = pivot_wide(df, ANALYTES)
    back = wide.select("StationCode", "SampleDate", F.explode(F.array(*[
        F.struct(F.lit(a).alias("Analyte"), F.col(f"`{a}`").alias("Result")) for a in ANALYTES])).alias("x")) \
        .select("StationCode", "SampleDate", "x.*").where("Result is not null")
    # expected: first non-null result per (station, date, analyte) in ord order
    first = {}
    for s, d, a, r, o in sorted(rows, key=lambda x: x[4]):
        if r is not None and (s, d, a) not in first:
            first[(s, d, a)] = r
    got = {(r["StationCode"], r["SampleDate"], r["Analyte"]): r["Result"] for r in back.collect()}
    assert got == first


def test_event_study_invariant_under_repartition(spark):
    rnd = random.Random(11)
    rows = [(f"F{rnd.randint(0, 4)}", rnd.randint(-900, 900), float(rnd.choice([0, 20000, 60000])),
             i, float(rnd.randint(0, 30))) for i in range(2000)]
    df = spark.createDataFrame(rows, "FIRE_NAME string, days_since_fire int, GIS_ACRES double, "
                                     "row_ord long, x double")
    outs = []
    for parts in (1, 13):
        r = study.fire_results(df.repartition(parts), ["x"], study.SCENARIOS, order_cols="row_ord")
        outs.append(sorted((x["scenario"], x["Fire"], x["n_before"], x["n_after"], x["GIS_Acres"],
                            round(x["change"], 9) if x["change"] is not None else None)
                           for x in r.collect()))
    assert outs[0] == outs[1]
