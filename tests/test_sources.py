"""CSV ingest with null tokens, union by name, per-file head, GeoJSON."""

import json
import os

import pytest

from cinderwell.sources.files import head_per_file, read_readings, write_if_nonempty
from cinderwell.sources.polygons import read_geojson_polygons

HEADER = "StationCode,SampleDate,StationName,TargetLatitude,TargetLongitude,Region,Analyte,Result,Unit"


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_null_tokens_and_none_unit(spark, tmp_dir):
    p = os.path.join(tmp_dir, "ph.csv")
    _write(p, [HEADER, 'S1,1/2/2020,n,34.5,-120.1,3,pH,NaN,none', 'S1,1/3/2020,n,34.5,-120.1,3,pH,,none',
               'S1,1/4/2020,n,34.5,-120.1,3,pH,NA,none', 'S1,1/5/2020,n,34.5,-120.1,3,"Nitrogen, Total, Total",-0.005,mg/L'])
    rows = read_readings(spark, [p]).orderBy("_seq").collect()
    assert [r["Result"] for r in rows] == [None, None, None, -0.005]
    assert rows[0]["Unit"] == "none"
    assert rows[3]["Analyte"] == "Nitrogen, Total, Total"


def test_union_by_name_and_head(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "b.csv")
    _write(a, [HEADER] + [f"S{i},1/1/2020,n,1,2,3,pH,{i},none" for i in range(5)])
    _write(b, ["Analyte,Result,StationCode,SampleDate"] + [f"X,{i},T{i},1/2/2020" for i in range(4)])
    df = read_readings(spark, [a, b])
    assert df.count() == 9
    assert df.where("Analyte = 'X'").where("Unit is null and StationName is null").count() == 4
    head = head_per_file(df, 2).collect()
    assert sorted((os.path.basename(r["_file"]), r["Result"]) for r in head) == [
        ("a.csv", 0.0), ("a.csv", 1.0), ("b.csv", 0.0), ("b.csv", 1.0)]


def test_empty_input_raises(spark):
    with pytest.raises(ValueError):
        read_readings(spark, [])


def test_geojson_polygon_and_multipolygon(spark, tmp_dir):
    p = os.path.join(tmp_dir, "fires.geojsonl")
    poly = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    multi = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]],
                                                     [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}
    feats = [{"type": "Feature", "properties": {"FIRE_NAME": "A", "ALARM_DATE": "2017-08-10 00:00:00+00:00",
                                                 "GIS_ACRES": "12.5", "fire_id": "7"}, "geometry": poly},
             {"type": "Feature", "properties": {"FIRE_NAME": "B", "ALARM_DATE": "2018-01-02",
                                                 "GIS_ACRES": "NaN", "fire_id": "9"}, "geometry": multi}]
    with open(p, "w") as f:
        f.write("\n".join(json.dumps(x) for x in feats) + "\n")
    rows = {r["FIRE_NAME"]: r for r in read_geojson_polygons(spark, p).collect()}
    assert rows["A"]["fire_id"] == 7 and rows["A"]["GIS_ACRES"] == 12.5 and len(rows["A"]["rings"]) == 1
    assert rows["A"]["ALARM_DATE"].year == 2017
    assert rows["B"]["GIS_ACRES"] is None and len(rows["B"]["rings"]) == 2


def test_write_if_nonempty(spark, tmp_dir):
    empty = spark.createDataFrame([], "a int")
    assert not write_if_nonempty(empty, os.path.join(tmp_dir, "x"))
    assert write_if_nonempty(spark.range(3), os.path.join(tmp_dir, "y"), "csv")


def _feature(name, fid=None, geometry=None):
    props = {"FIRE_NAME": name, "ALARM_DATE": "2017-08-10"} | ({"fire_id": fid} if fid is not None else {})
    return {"type": "Feature", "properties": props,
            "geometry": geometry or {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}


def test_feature_collections(spark, tmp_dir):
    features = [_feature("A", "1"), _feature("B", "2")]
    for indent, multi in ((None, False), (2, True)):
        p = os.path.join(tmp_dir, f"c{indent}.geojson")
        with open(p, "w") as f:
            json.dump({"type": "FeatureCollection", "name": "x", "features": features}, f, indent=indent)
        rows = read_geojson_polygons(spark, p, multi_line=multi).collect()
        assert sorted((r["fire_id"], r["FIRE_NAME"], len(r["rings"])) for r in rows) == [(1, "A", 1), (2, "B", 1)]


def test_missing_or_repeated_ids_number_the_layer(spark, tmp_dir):
    for ids in ((None, "0"), ("7", "7"), (None, None)):
        p = os.path.join(tmp_dir, f"ids{ids}.geojsonl")
        _write(p, [json.dumps(_feature(n, i)) for n, i in zip(("NOID", "ZERO"), ids)])
        assert sorted((r["fire_id"], r["FIRE_NAME"]) for r in read_geojson_polygons(spark, p).collect()) == [(0, "NOID"), (1, "ZERO")]


@pytest.mark.parametrize("line", ['{"type": "Feature", "properties": {"FIRE_NAME": "A"}, "geometry": {"type": "Poly', '{"a": 1}',
                                  json.dumps(_feature("P", geometry={"type": "Point", "coordinates": [1, 2]}))])
def test_bad_perimeters_raise(spark, tmp_dir, line):
    p = os.path.join(tmp_dir, "bad.geojsonl")
    _write(p, [json.dumps(_feature("A", "1")), line])
    with pytest.raises(Exception, match="MALFORMED|not a"):
        read_geojson_polygons(spark, p).collect()


def test_unreadable_values_and_quoted_line_ends(spark, tmp_dir):
    from cinderwell.sources.files import read_csv_text
    from cinderwell.sources.schema import READINGS_SCHEMA, reject_counts
    p = os.path.join(tmp_dir, "q.csv")
    _write(p, [HEADER, 'S1,1/2/2020,"two\nlines",34.5,-120.1,3,pH,<0.5,none', 'S2,1/2/2020,n,NA,-120.1,x,pH,7,none'])
    rows = read_readings(spark, [p], multi_line=True).orderBy("StationCode").collect()
    assert [(r["StationCode"], r["StationName"], r["Result"]) for r in rows] == [("S1", "two\nlines", None), ("S2", "n", 7.0)]
    counts = {r["column"]: r["n"] for r in reject_counts(read_csv_text(spark, [p], multi_line=True), READINGS_SCHEMA).collect()}
    assert counts == {"TargetLatitude": 0, "TargetLongitude": 0, "Region": 1, "Result": 1}
    with pytest.raises(Exception, match="cannot read"):
        read_readings(spark, [p], multi_line=True, strict=True).collect()
