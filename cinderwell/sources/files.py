"""File sources and sinks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderwell.sources.schema import READINGS_SCHEMA, typed_from_text

FILE_COL, BLOCK_COL, SEQ_COL = "_file", "_block", "_seq"


def _paths(paths) -> list[str]:
    if isinstance(paths, str):
        paths = [paths]
    paths = list(paths)
    if not paths:
        # Empty input is an error, not an empty result.
        raise ValueError("no input files given")
    return paths


def read_csv_text(spark: SparkSession, paths, *, with_order: bool = False, multi_line: bool = False) -> DataFrame:
    """Header CSV read as text (no inference), quote/escape as written by
    common CSV writers. ``multi_line`` allows line ends inside quotes; a file is
    then one task. ``with_order`` adds the file path, the split start and
    a read sequence, which together give file order (T3)."""
    df = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
          .option("multiLine", multi_line).option("inferSchema", False).csv(_paths(paths)))
    if with_order:
        df = df.select("*", F.col("_metadata.file_path").alias(FILE_COL),
                       F.col("_metadata.file_block_start").alias(BLOCK_COL),
                       F.monotonically_increasing_id().alias(SEQ_COL))
    return df


def list_files(spark: SparkSession, paths) -> list[str]:
    """The files behind paths, directories or globs (one row per file; the
    binary-file source lists without reading content when only ``path``
    is selected)."""
    return sorted(r["path"] for r in spark.read.format("binaryFile").load(_paths(paths))
                  .select("path").collect())


def file_headers(spark: SparkSession, paths) -> dict[str, tuple[str, ...]]:
    """Header of every file: the CSV reader's schema inference parses only
    the first line of each file; the small jobs run concurrently."""
    files = list_files(spark, paths)
    if not files:
        raise ValueError("no input files found")

    def header(f):
        return f, tuple(spark.read.option("header", True).option("inferSchema", False)
                        .option("quote", '"').option("escape", '"').csv(f).columns)
    with ThreadPoolExecutor(max_workers=max(1, min(len(files), 16))) as pool:
        return dict(pool.map(header, files))


def union_by_name(frames) -> DataFrame:
    """Bag union by column name; columns missing on one side are NULL."""
    frames = list(frames)
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_readings(spark: SparkSession, paths, schema: T.StructType = READINGS_SCHEMA,
                  *, with_order: bool = True, multi_line: bool = False, strict: bool = False) -> DataFrame:
    """All analyte files, union by column name, typed with the null-token
    and NaN rules; ``strict`` raises on values that cannot be read. Files with the same header are read by one scan; only
    differing header groups are unioned."""
    paths = _paths(paths)
    groups: dict[tuple, list[str]] = {}
    for f, header in file_headers(spark, paths).items():
        groups.setdefault(header, []).append(f)
    keep = (FILE_COL, BLOCK_COL, SEQ_COL) if with_order else ()
    frames = [typed_from_text(read_csv_text(spark, files, with_order=with_order, multi_line=multi_line), schema, keep, strict)
              for files in groups.values()]
    return union_by_name(frames)


def head_per_group(df: DataFrame, group_col: str, order_cols, n: int) -> DataFrame:
    """First ``n`` rows of every group in the given order.

    ``row_number() <= n`` lets Spark place a partial group limit before the
    shuffle (WindowGroupLimit), so each map task ships at most ``n`` rows per
    group: a group holding a third of the data never lands whole in one task.
    """
    w = Window.partitionBy(group_col).orderBy(*order_cols)
    return (df.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= F.lit(n)).drop("_rn"))


def head_per_file(df: DataFrame, n: int) -> DataFrame:
    """S7 on a frame read with ``with_order=True``."""
    return head_per_group(df, FILE_COL, [F.col(BLOCK_COL), F.col(SEQ_COL)], n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", *, header: bool = True,
                partition_by=None, mode: str = "overwrite") -> None:
    """Sink. CSV gets a header row; Parquet is the default format."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", header).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def write_if_nonempty(df: DataFrame, path: str, fmt: str = "parquet", **kw) -> bool:
    """Write only when the result has at least one row."""
    if df.isEmpty():
        return False
    write_table(df, path, fmt, **kw)
    return True
