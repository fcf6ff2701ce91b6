"""Long -> wide reshaping and the master table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderwell.session import stable_checkpoint, written_table
from cinderwell.sources.schema import KEY_COLS, META_COLS, q


def _order(order_cols) -> Column:
    cols = [order_cols] if isinstance(order_cols, (str, Column)) else list(order_cols)
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return cols[0] if len(cols) == 1 else F.struct(*cols)


def analytes_found(long: DataFrame, analyte_col: str = "Analyte") -> DataFrame:
    """A1: distinct analyte names (NULL excluded)."""
    return long.select(analyte_col).where(F.col(analyte_col).isNotNull()).distinct()


def units_reference(long: DataFrame, order_cols=("StationCode", "SampleDate", "ord"),
                    analyte_col="Analyte", unit_col="Unit") -> DataFrame:
    """A2: first non-NULL unit per analyte in (station, date, file) order; an
    analyte whose units are all NULL still gets a row (NULL unit).

    An analyte with a single distinct unit needs no order, so the full pass is
    one hash aggregation on (analyte, unit), whose few rows are written and
    reread; only analytes with differing units are resolved by an ordered
    ``min_by`` over their rows (deterministic, where ``first`` after a shuffle
    is not)."""
    a, u = F.col(analyte_col), F.col(unit_col)
    base = long.where(a.isNotNull())
    pairs = stable_checkpoint(base.groupBy(analyte_col, unit_col).agg(F.count(F.lit(1)).alias("_n")))
    sets = pairs.groupBy(analyte_col).agg(F.collect_set(unit_col).alias("_us"))
    single = sets.where(F.size("_us") <= 1).select(analyte_col, F.get("_us", F.lit(0)).alias(unit_col))
    multi = sets.where(F.size("_us") > 1).select(analyte_col)
    if multi.isEmpty():
        return single
    key = F.when(u.isNotNull(), _order(order_cols))
    resolved = base.join(multi, analyte_col, "left_semi").groupBy(analyte_col).agg(F.min_by(u, key).alias(unit_col))
    return single.unionByName(resolved)


def station_metadata(long: DataFrame, cols=META_COLS) -> DataFrame:
    """A3: de-duplicated metadata rows (NULLs compare equal)."""
    return long.select(*cols).dropDuplicates()


#: readings a part of a sorted master takes, and hash buckets that tell crowded keys
ROWS_A_PART, KEY_BUCKETS = 500_000, 1 << 16

FIXED_WIDTH = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
               T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def pivot_wide(long: DataFrame, analytes, keys=KEY_COLS, pivot_col="Analyte",
               value_col="Result", order_col="ord") -> DataFrame:
    """A4: first non-NULL value per (keys, analyte) as one column per analyte.

    With a fixed-width order key this is conditional ``min_by`` aggregates
    under a single ``groupBy``: one shuffle with map-side partial
    aggregation (a hot key is collapsed in each map task before it moves),
    instead of the two aggregations a ``pivot()`` plans. Rows with NULL keys
    or NULL values are dropped first, so a key whose values are all NULL
    produces no row. Other order keys go through ``_pivot_by_conflicts``.
    """
    p, v, o = F.col(pivot_col), F.col(value_col), _order(order_col)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    base = long.where(cond & v.isNotNull() & p.isin(*analytes))
    if not isinstance(base.select(o.alias("_o")).schema[0].dataType, FIXED_WIDTH):
        return _pivot_by_conflicts(base.withColumn("_o", o), analytes, keys, pivot_col, value_col)
    aggs = [F.min_by(F.when(p == a, v), F.when(p == a, o)).alias(a) for a in analytes]
    return base.groupBy(*keys).agg(*aggs)


def _pivot_by_conflicts(base: DataFrame, analytes, keys, pivot_col, value_col) -> DataFrame:
    """The same pivot for a composite order key (e.g. file, split, row)
    while keeping every large aggregation hash-based: a cell whose non-NULL
    values all agree needs no order; only cells with differing values are
    resolved by the ordered ``min_by``, over their own rows."""
    p, v = F.col(pivot_col), F.col(value_col)
    cell_keys = list(keys) + [pivot_col]
    cells = base.groupBy(*cell_keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    clear = cells.where(F.col("_lo") == F.col("_hi")).select(*cell_keys, F.col("_lo").alias("_v"))
    conflict = cells.where(F.col("_lo") != F.col("_hi")).select(*cell_keys)
    resolved = (base.join(conflict, cell_keys, "left_semi")
                    .groupBy(*cell_keys).agg(F.min_by(v, F.col("_o")).alias("_v")))
    clear = clear.unionByName(resolved)
    return clear.groupBy(*keys).agg(*[F.max(F.when(p == a, F.col("_v"))).alias(a) for a in analytes])


def master_wide(long: DataFrame, analytes, keys=KEY_COLS, meta_cols=META_COLS,
                order_col="ord", value_col="Result", pivot_col="Analyte") -> DataFrame:
    """A4 + J1 + P2: the wide table, metadata first, analytes in byte order.

    A key with several metadata variants fans out to one row per variant (the
    metadata may differ between the files of one key). With a fixed-width order
    key the readings are read once and there is no join: they are collapsed by
    key and metadata with map-side partial sums, and the few rows of a key then
    share the first value of each analyte through a window."""
    analytes = sorted(analytes)
    o = _order(order_col)
    if not isinstance(long.select(o.alias("_o")).schema[0].dataType, FIXED_WIDTH):
        wide = pivot_wide(long, analytes, keys, pivot_col, value_col, order_col)
        joined = wide.join(station_metadata(long, meta_cols), list(keys), "left")
        return joined.select(*[q(c) for c in _shown(meta_cols) + analytes])
    return _widened(long.dropna(subset=list(keys)), analytes, Window.partitionBy(*keys), meta_cols, o, value_col, pivot_col)


def _shown(meta_cols) -> list[str]:
    lead = [c for c in ("StationCode", "StationName", "TargetLatitude", "TargetLongitude",
                        "Region", "SampleDate") if c in meta_cols]
    return lead + [c for c in meta_cols if c not in lead]


def _widened(long: DataFrame, analytes, of_key, meta_cols, o: Column, value_col, pivot_col) -> DataFrame:
    """Readings collapsed by key and metadata; ``of_key`` is the window over a
    key's rows, which share the first value of each analyte (None: a key has one
    row)."""
    p, v = F.col(pivot_col), F.col(value_col)
    aggs = []
    for i, a in enumerate(analytes):
        mine = (p == a) & v.isNotNull()
        aggs.append(F.min_by(F.when(mine, v), F.when(mine, o)).alias(f"_v{i}"))
        if of_key is not None:
            aggs.append(F.min(F.when(mine, o)).alias(f"_o{i}"))
    per_variant = long.groupBy(*meta_cols).agg(*aggs)
    first = [F.col(f"_v{i}") if of_key is None else F.min_by(f"_v{i}", f"_o{i}").over(of_key) for i in range(len(analytes))]
    out = per_variant.select(*[q(c) for c in _shown(meta_cols)], *[c.alias(a) for c, a in zip(first, analytes)])
    return out.dropna(how="all", subset=[f"`{a}`" if "." in a else a for a in analytes])


def _first_key_facts(long: DataFrame, first_key: str, rest) -> tuple[int, int, bool]:
    """Rows, the most that share the first key (a whole key has no more), and
    whether the metadata of one differ. Counts of each first key and metadata are
    few beside the readings, and only their sums reach the driver."""
    variants = long.groupBy(q(first_key), *[q(c) for c in rest]).agg(F.count(F.lit(1)).alias("_n"))
    each = variants.groupBy(q(first_key)).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    r = each.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most"), F.max("_k").alias("k")).first()
    return r["rows"] or 0, r["most"] or 0, (r["k"] or 0) > 1


def _crowded(long: DataFrame, keys, rows_a_part: int) -> tuple[int, list[int]]:
    """Rows with a key, and those of ``KEY_BUCKETS`` hash buckets of keys that
    would fill half a part and hold four times their share."""
    bucket = _key_bucket(keys).alias("b")
    counts = {r["b"]: r["n"] for r in long.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = sum(counts.values())
    return rows, sorted(b for b, n in counts.items() if n > max(rows_a_part / 2, 4 * rows / KEY_BUCKETS))


def _key_bucket(keys) -> Column:
    return F.pmod(F.xxhash64(*[q(k) for k in keys]), F.lit(KEY_BUCKETS)).cast("int")


def _part_count(spark: SparkSession, rows: int, rows_a_part: int) -> int:
    """Parts of ``rows_a_part`` rows; of up to three times as many where that keeps
    their number within ``spark.shuffle.sort.bypassMergeThreshold``. Above it a map
    task holds and sorts all rows of its split before it writes them."""
    sc = spark.sparkContext
    streamed = int(sc.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    n = -(-rows // rows_a_part)
    if n > streamed and rows <= 3 * rows_a_part * streamed:
        n = streamed
    return max(sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), n)


def master_sorted(long: DataFrame, analytes, keys=KEY_COLS, meta_cols=META_COLS, order_col="ord",
                  value_col="Result", pivot_col="Analyte", rows_a_part: int = ROWS_A_PART) -> DataFrame:
    """The rows of ``master_wide`` range-partitioned by key and sorted by
    ``meta_cols`` (which begin with the keys), for tables written in this order.

    The readings move once, as they are: parts hold about ``rows_a_part`` of
    them (see ``_part_count``), so collapsing, window and sort stay in memory however large the input
    and its splits are. With nearly as many keys as readings, a partial sum in
    the map stage would save nothing and spill. Keys that crowd a bucket are
    the exception: their readings (a few keys, many rows) are first reduced to
    the first one of each metadata variant and analyte, with partial sums. They
    are looked for if the first key column crowds a part. Where it tells the
    metadata, a key has one row, and the window that shares values is left out."""
    if not isinstance(long.select(_order(order_col).alias("_o")).schema[0].dataType, FIXED_WIDTH):
        raise ValueError("master_sorted needs a fixed-width order column")
    rest = [c for c in meta_cols if c not in keys]
    if list(meta_cols) != [*keys, *rest]:
        raise ValueError("the metadata columns begin with the keys")
    analytes = sorted(analytes)
    named = long.dropna(subset=list(keys))
    rows, most, varies = _first_key_facts(named, keys[0], rest)
    crowded = _crowded(named, keys, rows_a_part)[1] if most > rows_a_part / 2 else []
    p, v = F.col(pivot_col), F.col(value_col)
    narrow = named.select(*[q(c) for c in meta_cols], p.alias("_p"), v.alias("_v"), _order(order_col).alias("_o"))
    if crowded:
        inside = _key_bucket(keys).isin(crowded)
        o = F.when(F.col("_v").isNotNull(), F.col("_o"))
        few = narrow.where(inside).groupBy(*[q(c) for c in meta_cols], "_p").agg(F.min_by("_v", o).alias("_v"), F.min(o).alias("_o"))
        narrow = narrow.where(~inside).unionByName(few)
    parted = narrow.repartitionByRange(_part_count(long.sparkSession, rows, rows_a_part), *[q(k) for k in keys])
    of_key = Window.partitionBy(*keys).orderBy(*[q(c) for c in rest]).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing) if varies else None
    out = _widened(parted, analytes, of_key, meta_cols, F.col("_o"), "_v", "_p")
    return out.sortWithinPartitions(*[q(c) for c in meta_cols])


def add_surrogate_id(df: DataFrame, order_cols, id_col: str = "WaterQualityID") -> DataFrame:
    """Dense 1..n id in the given order, first column.

    The frame is written once, range-partitioned and sorted (each task writes
    one file, in order), and read back: the id is the number of rows in earlier
    files plus the row's place in its file, from the part number in the file
    name and Parquet's row index. One sort, one write, one count per file.
    """
    cols = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order_cols]
    stored = written_table(df.repartitionByRange(*cols).sortWithinPartitions(*cols), "ids")
    return with_file_order_id(stored, id_col)


def with_file_order_id(stored: DataFrame, id_col: str) -> DataFrame:
    """``stored`` is read from Parquet files whose part numbers are in order."""
    names = stored.columns
    tagged = stored.select("*", F.col("_metadata.file_name").alias("_f"), F.col("_metadata.row_index").alias("_ri"))
    counts = tagged.groupBy("_f").agg(F.count(F.lit(1)).alias("_n"))
    part = F.regexp_extract("_f", r"part-(\d+)", 1).cast("long")  # of a file, not of each row
    before = Window.orderBy(part, "_f").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    offsets = counts.select("_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # unhinted, the rows would be shuffled by file before the join turns out small
    out = tagged.join(F.broadcast(offsets), "_f").withColumn(id_col, (F.col("_off") + F.col("_ri") + 1).cast("long"))
    return out.select(id_col, *[q(c) for c in names])


def preview(df: DataFrame, order_cols, n: int = 5) -> DataFrame:
    """O2: first ``n`` rows in key order (TakeOrderedAndProject: each task
    keeps ``n`` rows)."""
    return df.orderBy(*order_cols).limit(n)
