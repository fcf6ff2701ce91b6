"""Event-relative time axis, window filters and simple summaries
(P6–P12, F1–F9, A12–A15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderwell.functions.dates import days_between, flag, season_of_month


def add_years(df: DataFrame, sample_col="SampleDate", alarm_col="ALARM_DATE") -> DataFrame:
    """SampleYear and FireYear (NULL without a fire)."""
    return add_fire_year(df.withColumn("SampleYear", F.year(sample_col).cast("int")), alarm_col)


def add_fire_year(df: DataFrame, alarm_col="ALARM_DATE") -> DataFrame:
    """FireYear of each event or reading. Changing zones is dear: ask it of the
    events, before they are joined to many readings."""
    a = F.col(alarm_col)
    if not isinstance(df.schema[alarm_col].dataType, T.DateType):
        a = F.to_date(F.convert_timezone(F.lit(_session_tz(df)), F.lit("UTC"), a.cast("timestamp_ntz")))
    return df.withColumn("FireYear", F.year(a).cast("int"))


def _session_tz(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def add_event_time(df: DataFrame, sample_col="SampleDate", alarm_col="ALARM_DATE",
                   out="days_since_fire") -> DataFrame:
    """P8 + P9: signed whole days since the row's own event (floor)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumn(out, days_between(F.col(sample_col), F.col(alarm_col),
                                           isinstance(types[sample_col], T.DateType),
                                           isinstance(types[alarm_col], T.DateType)))


def matched(df: DataFrame, name_col="FIRE_NAME") -> DataFrame:
    """rows matched to a named event."""
    return df.where(F.col(name_col).isNotNull())


def same_year(df: DataFrame, name_col="FIRE_NAME") -> DataFrame:
    """matched and sampled in the event's calendar year (includes rows
    before the alarm)."""
    return df.where(F.col(name_col).isNotNull() & (F.col("SampleYear") == F.col("FireYear")))


def day_window(df: DataFrame, lo: int | None, hi: int | None, days_col="days_since_fire") -> DataFrame:
    """``lo <= days <= hi`` (either bound optional, both
    inclusive)."""
    d = F.col(days_col)
    cond = d.isNotNull()
    if lo is not None:
        cond = cond & (d >= lo)
    if hi is not None:
        cond = cond & (d <= hi)
    return df.where(cond)


def model_frame(joined: DataFrame, window_days: int = 1825, days_col="days_since_fire",
                acres_col="GIS_ACRES", sample_col="SampleDate") -> DataFrame:
    """M0: +/- window, post_fire flag, log1p(acres), month, season."""
    d = F.col(days_col)
    return (day_window(joined, -window_days, window_days, days_col)
            .withColumns({"post_fire": flag(d >= 0),
                          "log_acres": F.log1p(F.col(acres_col)),
                          "month": F.month(sample_col).cast("int")})
            .withColumn("season_num", season_of_month(F.col("month"))))


def complete_cases(df: DataFrame, cols) -> DataFrame:
    """F8: every listed column non-NULL."""
    return df.dropna(how="any", subset=list(cols))


def min_non_null(df: DataFrame, cols, k: int) -> DataFrame:
    """at least ``k`` of the listed columns non-NULL."""
    return df.dropna(thresh=k, subset=list(cols))


def value_counts(df: DataFrame, col: str, out="count") -> DataFrame:
    """Counts per value, NULL excluded, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias(out))
              .orderBy(F.desc(out), F.asc(col)))


def normalized_counts(df: DataFrame, col: str, digits: int = 2, out="share") -> DataFrame:
    """Count ``n`` and half-even rounded share of each value, NULL
    excluded. One aggregation; the total is summed over its rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over a row for each value
    return counts.select(col, F.bround(F.col("n") / total, digits).alias(out), "n")


def date_range(df: DataFrame, col: str) -> DataFrame:
    """Earliest and latest value."""
    return df.agg(F.min(col).alias(f"min_{col}"), F.max(col).alias(f"max_{col}"))
