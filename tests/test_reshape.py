"""Pivot, metadata fan-out, units, surrogate ids (FIXTURES §3)."""

import datetime as dt

import pytest

from cinderwell.operators.reshape import (_crowded, _part_count, add_surrogate_id, master_sorted, master_wide,
                                          pivot_wide, units_reference, with_file_order_id)
from cinderwell.session import written_table
from cinderwell.sources.schema import KEY_COLS

D1, D2 = dt.date(2020, 1, 1), dt.date(2020, 1, 2)
SCHEMA = ("StationCode string, SampleDate date, StationName string, TargetLatitude double, "
          "TargetLongitude double, Region int, Analyte string, Result double, Unit string, ord long")


def long(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_first_non_null_in_file_order(spark):
    df = long(spark, [("S", D1, "n", 1.0, 2.0, 1, "pH", None, "none", 1),
                      ("S", D1, "n", 1.0, 2.0, 1, "pH", 2.0, "none", 2),
                      ("S", D1, "n", 1.0, 2.0, 1, "pH", 3.0, "none", 3)])
    out = pivot_wide(df, ["pH"]).collect()
    assert len(out) == 1 and out[0]["pH"] == 2.0


def test_all_null_key_and_null_station_vanish(spark):
    df = long(spark, [("S", D1, "n", 1.0, 2.0, 1, "pH", None, "none", 1),
                      (None, D2, "n", 1.0, 2.0, 1, "pH", 5.0, "none", 2),
                      ("T", D2, "n", 1.0, 2.0, 1, "pH", 7.0, "none", 3)])
    out = pivot_wide(df, ["pH"]).collect()
    assert [(r["StationCode"], r["pH"]) for r in out] == [("T", 7.0)]


def test_metadata_variants_fan_out(spark):
    df = long(spark, [("S", D1, "a", 1.0, 2.0, 1, "pH", 7.0, "none", 1),
                      ("S", D1, "b", 1.0, 2.0, 1, "Turbidity, Total", 3.0, "NTU", 2)])
    out = master_wide(df, ["pH", "Turbidity, Total"]).orderBy("StationName").collect()
    assert [r["StationName"] for r in out] == ["a", "b"]
    assert all(r["pH"] == 7.0 and r["Turbidity, Total"] == 3.0 for r in out)
    # analytes in byte order, pH last
    assert master_wide(df, ["pH", "Turbidity, Total"]).columns[-2:] == ["Turbidity, Total", "pH"]


def test_units_first_non_null_and_all_null(spark):
    df = long(spark, [("S", D1, "n", 1.0, 2.0, 1, "pH", 1.0, None, 1),
                      ("S", D2, "n", 1.0, 2.0, 1, "pH", 1.0, "none", 2),
                      ("S", D1, "n", 1.0, 2.0, 1, "X", 1.0, None, 3),
                      ("T", D1, "n", 1.0, 2.0, 1, "Y", 1.0, "b", 4),     # two units: order decides
                      ("S", D2, "n", 1.0, 2.0, 1, "Y", 1.0, "c", 5),
                      ("S", D2, "n", 1.0, 2.0, 1, "Y", 1.0, "a", 6)])
    got = {r["Analyte"]: r["Unit"] for r in units_reference(df).collect()}
    assert got == {"pH": "none", "X": None, "Y": "c"}


def test_surrogate_id_dense_and_ordered(spark):
    rows = [(f"S{i % 7}", dt.date(2020, 1, 1 + i % 28), "n", 1.0, 2.0, 1, "pH", float(i), "none", i)
            for i in range(200)]
    wide = master_wide(long(spark, rows).repartition(5), ["pH"])
    out = add_surrogate_id(wide, ["StationCode", "SampleDate"]).collect()
    ids = [r["WaterQualityID"] for r in out]
    assert sorted(ids) == list(range(1, len(out) + 1))
    by_id = sorted(out, key=lambda r: r["WaterQualityID"])
    keys = [(r["StationCode"], r["SampleDate"]) for r in by_id]
    assert keys == sorted(keys)


def test_stage_table_ids_dense_and_ordered(spark):
    from cinderwell.plans.stages import stage_table_with_id
    rows = [(f"S{(i * 7919) % 37}", dt.date(2020, 1 + i % 12, 1 + i % 27), float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "StationCode string, SampleDate date, v double").repartition(7)
    out = stage_table_with_id(spark, "ids-test", "k1", lambda: df, ["StationCode", "SampleDate", "v"],
                              "rid").collect()
    ids = [r["rid"] for r in out]
    assert sorted(ids) == list(range(1, 501))
    keys = [(r["StationCode"], r["SampleDate"], r["v"]) for r in sorted(out, key=lambda r: r["rid"])]
    assert keys == sorted(keys)


def test_struct_order_pivot_equals_long_order(spark):
    """Composite (file, split, row) order: conflict path == ordered min_by."""
    import random
    from pyspark.sql import functions as F
    rnd = random.Random(9)
    rows = [(f"S{rnd.randint(0, 3)}", D1 if rnd.random() < 0.5 else D2, "n", 1.0, 2.0, 1,
             rnd.choice(["pH", "X"]), rnd.choice([None, 1.0, 2.0, 3.0]), "u", i) for i in range(300)]
    df = long(spark, rows)
    a = {(r["StationCode"], r["SampleDate"]): (r["pH"], r["X"]) for r in pivot_wide(df, ["pH", "X"]).collect()}
    s = df.withColumn("o2", F.struct(F.lit("f"), F.col("ord")))
    b = {(r["StationCode"], r["SampleDate"]): (r["pH"], r["X"])
         for r in pivot_wide(s, ["pH", "X"], order_col="o2").collect()}
    assert a == b


def test_metadata_variant_without_values_and_null_metadata(spark):
    """A variant seen only on a row without a value still fans out; a key whose
    values are all NULL does not appear; NULL metadata is a variant like others."""
    df = long(spark, [("S", D1, "a", 1.0, 2.0, 1, "pH", 7.0, "none", 5), ("S", D1, "b", 1.0, 2.0, 1, "pH", None, "none", 1),
                      ("S", D1, None, None, None, None, "pH", 6.0, "none", 2), ("S", D1, None, None, None, None, "pH", 5.0, "none", 3),
                      ("T", D1, "c", 1.0, 2.0, 1, "pH", None, "none", 4), ("S", None, "a", 1.0, 2.0, 1, "pH", 1.0, "none", 0)])
    got = sorted((str(r["StationName"]), r["pH"]) for r in master_wide(df, ["pH"]).collect())
    assert got == [("None", 6.0), ("a", 6.0), ("b", 6.0)]
    from pyspark.sql import functions as F
    s = df.withColumn("o2", F.struct(F.lit("f"), F.col("ord")))
    assert sorted((str(r["StationName"]), r["pH"]) for r in master_wide(s, ["pH"], order_col="o2").collect()) == got


def test_master_sorted_gives_the_rows_of_master_wide_in_order(spark):
    """Parts of two readings, a crowded key with two metadata variants, nulls."""
    rows = [(s, dt.date(2020, 1, 1 + i % 3), "n", 1.0, 2.0, 1, a, float(i), "none", i)
            for i, (s, a) in enumerate((f"S{k}", x) for k in range(12) for x in ("pH", "Turbidity, Total", "pH"))]
    rows += [("H", D1, "ab"[i % 2], 1.0, None, 1, ("pH", "Turbidity, Total")[i % 3 == 0], None if i < 4 else float(i), "none", 1000 - i) for i in range(60)]
    rows += [(None, D1, "n", 1.0, 2.0, 1, "pH", 5.0, "none", 1), ("Z", D2, "n", 1.0, 2.0, 1, "pH", None, "none", 2)]
    df = long(spark, rows).repartition(3)
    analytes = ["pH", "Turbidity, Total"]
    assert _crowded(df.dropna(subset=["StationCode"]), KEY_COLS, 2)[1]
    got = master_sorted(df, analytes, rows_a_part=2)
    assert got.columns == master_wide(df, analytes).columns
    key = lambda r: (r["StationCode"], r["SampleDate"], r["StationName"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, master_wide(df, analytes).collect()), key=str)
    assert [key(r) for r in got.collect()] == sorted(key(r) for r in got.collect())


def test_master_sorted_moves_the_readings_once(spark):
    """One exchange without crowded keys, parts by the number of rows."""
    df = long(spark, [(f"S{i}", D1, "n", 1.0, 2.0, 1, "pH", 1.0, "none", i) for i in range(400)])
    out = master_sorted(df, ["pH"], rows_a_part=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
    assert out.rdd.getNumPartitions() == 20


def test_master_sorted_streams_its_map_output(spark):
    """Above 200 parts a map task would hold and sort its whole split: parts of up
    to three times the rows instead; still larger tables get more parts."""
    df = long(spark, [(f"S{i:03d}", D1, "n", 1.0, 2.0, 1, "pH", 1.0, "none", i) for i in range(600)]).repartition(3)
    out = master_sorted(df, ["pH"], rows_a_part=1)
    assert out.rdd.getNumPartitions() == 200
    assert [r["StationCode"] for r in out.collect()] == [f"S{i:03d}" for i in range(600)]
    assert [_part_count(spark, n, 10) for n in (1990, 2001, 6000, 6001)] == [199, 200, 200, 601]


def test_file_order_ids_broadcast_the_offsets(spark):
    """However large the table, its rows are not shuffled to learn their file's offset."""
    stored = written_table(long(spark, [(f"S{i}", D1, "n", 1.0, 2.0, 1, "pH", 1.0, "none", i) for i in range(20)]), "offsets-test")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = with_file_order_id(stored, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_file_order_ids_find_the_part_number_once_a_file(spark):
    """Rows are counted by file name; its part number is not searched for in every row."""
    stored = written_table(long(spark, [(f"S{i}", D1, "n", 1.0, 2.0, 1, "pH", 1.0, "none", i) for i in range(20)]).repartition(3), "parts-test")
    out = with_file_order_id(stored, "id")
    counted = out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[1]
    grouped, _, results_and_rows = counted.partition("], [")
    assert "regexp_extract" not in grouped and "regexp_extract" not in "".join(results_and_rows.splitlines()[1:])
    assert sorted(r["id"] for r in out.collect()) == list(range(1, 21))


@pytest.mark.parametrize("varied", [None, ("S3", D1), ("S3", D2)])
def test_master_sorted_needs_a_window_only_where_metadata_vary(spark, varied):
    """Stations with one set of metadata, one of them null, repeated cells; then
    one station with another name at one of its keys, or at another key."""
    rows = [(f"S{k}", d, None if k == 2 else "n", 1.0, None if k == 4 else 2.0, 1, a, None if k + i == 5 else float(k + i), "none", 100 * i + k)
            for k in range(8) for i, (d, a) in enumerate((d, a) for d in (D1, D1) for a in ("pH", "Turbidity, Total", "pH"))]
    if varied:
        rows.append((*varied, "other", 1.0, 2.0, 1, "Turbidity, Total", 7.0, "none", -1))
    df = long(spark, rows).repartition(3)
    analytes = ["pH", "Turbidity, Total"]
    got = master_sorted(df, analytes)
    assert ("Window" in got._jdf.queryExecution().executedPlan().toString()) == (varied is not None)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, master_wide(df, analytes).collect()), key=str)
