"""Binding of the domain onto the driver's TPC-H-like tables.

The driver tables carry no stations or perimeters, so the domain objects are
derived from them by integer arithmetic (identical in Spark and DuckDB):

* readings  <- lineitem: station = supplier key, date = ship date,
  analyte = "<returnflag>, <linestatus>", result = quantity,
  file order = orderkey * 10 + linenumber.
* stations  <- supplier: region = nation key, longitude/latitude from the key.
* fires     <- nation: a concave L-shaped perimeter per nation on a 5x5
  lattice (neighbours overlap), alarm date every 90 days from 1995-06-01,
  acres NULL for every 7th nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.functions.dates import utc_midnight
from cinderwell.sources.schema import nan_to_null

# Fixed values of the binding.
BINDING_ANALYTES = ("A, F", "A, O", "N, F", "N, O", "R, F", "R, O")
BINDING_UNITS = {"A": "mg/L", "N": "NTU", "R": "none"}
LARGE_FIRE_ACRES = 50_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def station_lon(key) -> F.Column:
    return F.lit(-124.0) + F.pmod(key * F.lit(7919), F.lit(1000)).cast("double") / F.lit(100.0)


def station_lat(key) -> F.Column:
    return F.lit(32.0) + F.pmod(key * F.lit(104729), F.lit(1000)).cast("double") / F.lit(100.0)


def readings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long readings with their station metadata and a file-order key ``ord``.

    The supplier side is left to Catalyst: broadcast while its statistics say
    it is small, a shuffle join once it is not.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate",
        "l_returnflag", "l_linestatus", "l_quantity")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    r = li.join(su, li.l_suppkey == su.s_suppkey, "left")
    flag = F.col("l_returnflag")
    unit = F.when(flag == "A", F.lit(BINDING_UNITS["A"])) \
            .when(flag == "N", F.lit(BINDING_UNITS["N"])) \
            .when(flag == "R", F.lit(BINDING_UNITS["R"]))
    return r.select(
        F.col("l_suppkey").cast("string").alias("StationCode"),
        F.col("l_shipdate").cast("date").alias("SampleDate"),
        F.col("s_name").alias("StationName"),
        station_lat(F.col("s_suppkey")).alias("TargetLatitude"),
        station_lon(F.col("s_suppkey")).alias("TargetLongitude"),
        F.col("s_nationkey").cast("int").alias("Region"),
        F.concat(flag, F.lit(", "), F.col("l_linestatus")).alias("Analyte"),
        nan_to_null(F.col("l_quantity")).alias("Result"),
        unit.alias("Unit"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perimeters: fire_id, FIRE_NAME, ALARM_DATE, CONT_DATE, GIS_ACRES, rings."""
    n = F.col("n_nationkey")
    x0 = F.lit(-124.0) + (F.pmod(n, F.lit(5)) * 2).cast("double")
    y0 = F.lit(32.0) + (F.floor(n / F.lit(5)) * 2).cast("double")

    def pt(dx, dy):
        return F.struct((x0 + F.lit(dx)).alias("x"), (y0 + F.lit(dy)).alias("y"))
    ring = F.array(pt(0.0, 0.0), pt(2.5, 0.0), pt(2.5, 1.5), pt(1.5, 1.5),
                   pt(1.5, 2.5), pt(0.0, 2.5), pt(0.0, 0.0))
    alarm = utc_midnight(F.date_add(F.lit("1995-06-01").cast("date"), n * 90))
    acres = F.when(F.pmod(n, F.lit(7)) == 0, F.lit(None).cast("double")) \
             .otherwise((F.pmod(n * n, F.lit(150)) * 1000).cast("double"))
    return table(spark, sf_dir, "nation").select(
        n.cast("long").alias("fire_id"),
        F.col("n_name").alias("FIRE_NAME"),
        alarm.alias("ALARM_DATE"),
        utc_midnight(F.date_add(F.lit("1995-06-01").cast("date"), n * 90 + 30)).alias("CONT_DATE"),
        acres.alias("GIS_ACRES"),
        F.array(ring).alias("rings"),
    )
