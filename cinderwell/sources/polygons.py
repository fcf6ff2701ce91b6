"""S3: polygon layers (event perimeters).

Re-aimed from a binary geodatabase reader to GeoJSON (Polygon or
MultiPolygon): one Feature or FeatureCollection per line, or with
``multi_line`` one per file. Parsing is ``from_json`` on the executors.
Malformed JSON, other geometry types and records that are no features raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderwell.functions.dates import parse_utc_timestamp
from cinderwell.functions.geometry import AlbersParams, reproject_rings
from cinderwell.operators.reshape import with_file_order_id
from cinderwell.session import written_table
from cinderwell.sources.schema import nan_to_null

_FEATURE = T.StructType([
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),   # raw JSON, typed below
    ])),
])
_RECORD = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(_FEATURE)), *_FEATURE.fields])

_POLY = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def _ring_structs(ring):
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def geojson_rings(geom_type, coords_json):
    """Polygon/MultiPolygon coordinates text -> rings (parts flattened)."""
    poly = F.from_json(coords_json, _POLY)
    multi = F.from_json(coords_json, _MULTI)
    return (F.when(geom_type == "Polygon", F.transform(poly, _ring_structs))
             .when(geom_type == "MultiPolygon",
                   F.flatten(F.transform(multi, lambda part: F.transform(part, _ring_structs)))))


def read_geojson_polygons(spark: SparkSession, paths, *, name_prop="FIRE_NAME",
                          alarm_prop="ALARM_DATE", acres_prop="GIS_ACRES",
                          cont_prop="CONT_DATE", id_prop="fire_id",
                          albers: AlbersParams | None = None, multi_line: bool = False) -> DataFrame:
    """Event perimeters with FIRE_NAME, ALARM_DATE (UTC), CONT_DATE,
    GIS_ACRES, fire_id and rings (optionally reprojected from Albers, P16).

    ``fire_id`` is the features' own id if every feature has one and all
    differ; otherwise the whole layer is numbered from 0 in file order."""
    raw = spark.read.schema(_RECORD).option("mode", "FAILFAST").option("multiLine", multi_line).json(paths)
    one = F.array(F.struct("properties", "geometry"))
    known = F.col("type").isin("Feature", "FeatureCollection")
    features = F.when(F.coalesce(known, F.lit(False)), F.coalesce("features", one)).otherwise(
        F.raise_error(F.concat(F.lit("not a GeoJSON feature: type "), F.coalesce("type", F.lit("missing")))))
    flat = raw.select(F.inline(features))
    props, kind, text = F.col("properties"), F.col("geometry.type"), F.col("geometry.coordinates")
    rings = F.coalesce(geojson_rings(kind, text), F.when(F.col("geometry").isNotNull(), F.raise_error(
        F.concat(F.lit("not a polygon: "), F.coalesce(kind, F.lit("no type")), F.lit(" "), F.coalesce(F.substring(text, 1, 80), F.lit(""))))))
    layer = flat.select(
        props[id_prop].try_cast("long").alias("fire_id"),
        props[name_prop].alias("FIRE_NAME"),
        parse_utc_timestamp(props[alarm_prop]).alias("ALARM_DATE"),
        parse_utc_timestamp(props[cont_prop]).alias("CONT_DATE"),
        nan_to_null(props[acres_prop].try_cast("double")).alias("GIS_ACRES"),
        reproject_rings(rings, albers).alias("rings"),
    )
    n = layer.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("fire_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        return layer
    numbered = with_file_order_id(written_table(layer.drop("fire_id"), "perimeters"), "fire_id")
    return numbered.withColumn("fire_id", F.col("fire_id") - 1)
