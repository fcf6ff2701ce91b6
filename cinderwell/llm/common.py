"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.session import checkpoint_dir, delete_on_exit

#: a word is a run of anything but these white-space characters
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: one white-space character of that set
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def or_empty(c: Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would also fold other letters, and some
    of those fold into ASCII."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(or_empty(text), F.lit(WORD), F.lit(0))).cast("long")


def packed(df: DataFrame, *derived: Column, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``df`` (those in ``keep``, or all) in one struct ``row``
    beside the derived ones, so that no name of the caller's can clash with a
    working column."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in (df.columns if keep is None else keep)]).alias("row"), *derived)


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared checkpoint folder, which goes when the
    application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


#: rows of whole texts in an Arrow batch at most
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame, in a session that sends at most ``BATCH_ROWS`` rows to a
    Python worker at once. Rows of whole texts are wide; Spark's 10,000 of them
    would hold hundreds of megabytes on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df
