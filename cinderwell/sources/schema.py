"""Schemas and the null/NaN discipline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text tokens read as missing (the common pandas reader list).
# Lower-case "none" is deliberately absent: it is a real unit (pH).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Raw long-format readings (one row per station, date and analyte).
READINGS_SCHEMA = T.StructType([
    T.StructField("StationCode", T.StringType()),
    T.StructField("SampleDate", T.StringType()),
    T.StructField("StationName", T.StringType()),
    T.StructField("TargetLatitude", T.DoubleType()),
    T.StructField("TargetLongitude", T.DoubleType()),
    T.StructField("Region", T.IntegerType()),
    T.StructField("Analyte", T.StringType()),
    T.StructField("Result", T.DoubleType()),
    T.StructField("Unit", T.StringType()),
])

KEY_COLS = ("StationCode", "SampleDate")
META_COLS = ("StationCode", "SampleDate", "StationName", "TargetLatitude",
             "TargetLongitude", "Region")

# The nine domain analytes and their units.
DOMAIN_UNITS = {
    "Arsenic, Total": "mg/Kg dw",
    "Cadmium, Total": "mg/Kg dw",
    "Chromium, Total": "mg/Kg dw",
    "Nitrogen, Total, Total": "mg/L",
    "Oxygen, Dissolved, Total": "mg/L",
    "Phosphorus as P, Total": "mg/L",
    "Total Organic Carbon, Total": "mg/L",
    "Turbidity, Total": "NTU",
    "pH": "none",
}
DOMAIN_ANALYTES = tuple(DOMAIN_UNITS)
# Analytes of the event study (in study order) and the
# classifier inputs.
STUDY_ANALYTES = (
    "Oxygen, Dissolved, Total", "Turbidity, Total", "Nitrogen, Total, Total",
    "pH", "Phosphorus as P, Total", "Total Organic Carbon, Total",
)
CLASSIFIER_ANALYTES = STUDY_ANALYTES
# Model features in term order.
MODEL_FEATURES = ("days_since_fire", "log_acres", "season_num",
                  "TargetLatitude", "TargetLongitude", "Region")


def q(name: str) -> Column:
    """Column reference safe for names with commas, blanks and dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def null_tokens_to_null(c: Column, tokens=NULL_TOKENS) -> Column:
    """Missing-value tokens (after no trimming) become NULL."""
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def nan_to_null(c: Column) -> Column:
    """Spark keeps NaN as a value (NaN >= 0 is true, avg(NaN) is NaN);
    the analyses treat it as missing, so it is turned into NULL once."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def typed_from_text(df: DataFrame, schema: T.StructType, keep=(), strict: bool = False) -> DataFrame:
    """Cast an all-text frame to ``schema`` by name: tokens -> NULL, NaN ->
    NULL. A value that fails to parse is NULL, or with ``strict`` an error.
    Columns absent from the input come out NULL; ``keep`` columns pass through
    unchanged."""
    cols = []
    present = set(df.columns)
    for f in schema.fields:
        if f.name not in present:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        raw = null_tokens_to_null(q(f.name).cast("string"))
        if isinstance(f.dataType, T.StringType):
            v = raw
        else:
            v = raw.try_cast(f.dataType)
            if strict:
                v = F.when(raw.isNotNull() & v.isNull(), F.raise_error(F.concat(F.lit(f"{f.name}: cannot read "), raw))).otherwise(v)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                v = nan_to_null(v)
        cols.append(v.alias(f.name))
    return df.select(*cols, *[q(k) for k in keep])


def reject_counts(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Values of an all-text frame that are neither missing nor readable as
    ``schema`` says: column, n (a row for each typed column)."""
    names = [f for f in schema.fields if f.name in df.columns and not isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n long")
    bad = [F.count_if(null_tokens_to_null(q(f.name).cast("string")).isNotNull() & q(f.name).cast("string").try_cast(f.dataType).isNull()).alias(f"n{i}")
           for i, f in enumerate(names)]
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"n{i}").alias("n")) for i, f in enumerate(names)])
    return df.agg(*bad).select(F.inline(pairs))
