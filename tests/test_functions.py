"""Scalar helpers: date parsing, reprojection, labels."""

import datetime as dt

from pyspark.sql import functions as F

from cinderwell.functions.dates import parse_date, parse_utc_timestamp
from cinderwell.functions.geometry import AlbersParams, albers_inverse, wkt_point
from cinderwell.functions.labels import DISPLAY_NAMES, direction, lookup, short_label


def test_parse_dates(spark):
    df = spark.createDataFrame([("7/11/2017",), ("2017-07-11",), ("junk",), (None,)], "s string")
    got = [r["d"] for r in df.select(parse_date("s").alias("d")).collect()]
    assert got == [dt.date(2017, 7, 11), dt.date(2017, 7, 11), None, None]


def test_parse_utc_timestamp_offsets(spark):
    df = spark.createDataFrame([("2017-08-10 00:00:00+00:00",), ("2017-08-10 02:00:00+02:00",)], "s string")
    micros = [r["m"] for r in df.select(F.unix_micros(parse_utc_timestamp("s")).alias("m")).collect()]
    assert micros[0] == micros[1]


def test_albers_round_trip(spark):
    p = AlbersParams()
    pts = [(-120.5, 34.5), (-123.16, 41.99), (-116.0, 33.0), (-120.0, 37.0)]
    xy = [p.forward(lon, lat) for lon, lat in pts]
    df = spark.createDataFrame(xy, "x double, y double")
    back = df.select(albers_inverse("x", "y", p).alias("p")).collect()
    for (lon, lat), r in zip(pts, back):
        assert abs(r["p"]["x"] - lon) < 1e-7 and abs(r["p"]["y"] - lat) < 1e-7


def test_labels(spark):
    df = spark.createDataFrame([("Phosphorus as P, Total", 0.0, 2.0, 0.0), ("pH", 1.0, 0.5, -1.0)],
                               "a string, b double, af double, ch double")
    r = df.select(short_label("a").alias("s"), lookup("a", DISPLAY_NAMES).alias("n"),
                  direction("ch").alias("d")).collect()
    assert [x["s"] for x in r] == ["Phosphorus as P", "pH"]
    assert [x["n"] for x in r] == ["Phosphorus", "pH"]
    assert [x["d"] for x in r] == ["↓", "↓"]


def test_wkt(spark):
    df = spark.createDataFrame([(-120.498226, 34.51217198)], "lon double, lat double")
    assert df.select(wkt_point("lon", "lat").alias("w")).first()["w"] == "POINT (-120.498226 34.51217198)"
