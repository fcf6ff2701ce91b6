"""Stage A: readings -> wide master table -> spatially joined fact table."""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderwell.operators.events import add_event_time, add_fire_year
from cinderwell.operators.reshape import add_surrogate_id, master_sorted, master_wide, with_file_order_id
from cinderwell.operators.spatial import spatial_join
from cinderwell.session import checkpoint_dir, delete_on_exit
from cinderwell.sources import bindings
from cinderwell.sources.schema import META_COLS

FIRE_COLS = ("FIRE_NAME", "ALARM_DATE", "GIS_ACRES")


def build_master(long: DataFrame, analytes, with_id: bool = False) -> DataFrame:
    m = master_wide(long, analytes)
    if with_id:
        m = add_surrogate_id(m, list(META_COLS))
    return m


def build_joined(master: DataFrame, fires: DataFrame, coords: DataFrame | None = None,
                 cell: float = 0.25, fire_cols=FIRE_COLS) -> DataFrame:
    """Master rows x matching perimeters (left), with SampleYear,
    index_right, fire attributes and FireYear, in the published column order."""
    attrs = list(dict.fromkeys([*fire_cols, "FireYear"]))
    j = spatial_join(master, add_fire_year(fires), fire_cols=attrs, coords=coords, cell=cell)
    j = j.withColumn("SampleYear", F.year("SampleDate").cast("int"))
    lead = [c for c in master.columns]  # WaterQualityID first when present
    tail = ["SampleYear", "index_right", "FIRE_NAME", "ALARM_DATE", "FireYear", "GIS_ACRES"]
    extra = [c for c in fire_cols if c not in tail]
    return j.select(*[F.col(f"`{c}`") for c in lead + tail + extra])


_STAGE_LOCK = threading.RLock()
_WRITTEN: set = set()


def input_version(spark: SparkSession, paths) -> str:
    """Changes when an input file is added, removed or rewritten. Files are
    listed, not read: one that is named itself by its status alone, those of
    folders by a job of which only a sum reaches the driver."""
    told, folders = [], []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        status = p.getFileSystem(conf).getFileStatus(p)
        if status.isFile():
            told.append(f"{path}:{status.getLen()}:{status.getModificationTime()}")
        else:
            folders.append(path)
    if folders:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders)
        r = files.agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s")).first()
        told.append(f"{r['n']}:{r['s']}")
    return "|".join(told)


def _ranged(df: DataFrame, cols) -> DataFrame:
    """Sorted by range into a file for each core at least: adaptive execution
    would merge small ones, and every later pass would read them with as few
    tasks."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(f"`{c}`") for c in cols]
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def stage_table(spark: SparkSession, name: str, key: str, build) -> DataFrame:
    """A stage output written once per session as a Parquet table under
    the session's checkpoint folder, then re-read by every later stage (the
    hand-off the reference makes with files between its scripts). Cuts
    lineage and survives executor loss. ``key`` names the inputs, their version
    and the parameters of the build. The folder goes with the application."""
    base = checkpoint_dir(spark).rstrip("/")
    app = spark.sparkContext.applicationId
    digest = hashlib.sha1(key.encode()).hexdigest()[:12]
    path = f"{base}/cinderwell-stages/{app}/{name}-{digest}"
    with _STAGE_LOCK:
        if path not in _WRITTEN:
            build().write.mode("overwrite").parquet(path)
            delete_on_exit(spark, path)
            _WRITTEN.add(path)
    return spark.read.parquet(path)


def stage_table_with_id(spark: SparkSession, name: str, key: str, build, order_cols,
                        id_col: str = "WaterQualityID") -> DataFrame:
    """A stage table written once in ``order_cols`` order, read back with a
    dense 1..n id in that order (see ``with_file_order_id``)."""
    return with_file_order_id(stage_table(spark, name, key, lambda: _ranged(build(), order_cols)), id_col)


def _binding_key(spark: SparkSession, sf_dir: str) -> str:
    paths = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("lineitem", "supplier", "nation")]
    return f"{sf_dir}|{input_version(spark, paths)}|{bindings.BINDING_ANALYTES}"


def binding_master(spark: SparkSession, sf_dir: str, with_id: bool = False,
                   materialized: bool = True) -> DataFrame:
    """Master table; the stored stage carries WaterQualityID (dense, in
    reading order), which later stages use as a fixed-width row order."""
    long = bindings.readings_long(spark, sf_dir)
    if materialized:
        stored = stage_table(spark, "master", _binding_key(spark, sf_dir), lambda: master_sorted(long, bindings.BINDING_ANALYTES))
        return with_file_order_id(stored, "WaterQualityID") if with_id else stored  # the stored rows are enough
    m = add_surrogate_id(build_master(long, bindings.BINDING_ANALYTES), list(META_COLS))
    return m if with_id else m.drop("WaterQualityID")


def binding_joined(spark: SparkSession, sf_dir: str, with_days: bool = True,
                   fire_cols=FIRE_COLS, materialized: bool = True) -> DataFrame:
    """The joined fact table on the driver tables. Station coordinates for
    the match table come from the (small) station dimension."""
    def build():
        master = binding_master(spark, sf_dir, with_id=True, materialized=materialized)
        sup = bindings.table(spark, sf_dir, "supplier")
        coords = sup.select(bindings.station_lon(F.col("s_suppkey")).alias("TargetLongitude"),
                            bindings.station_lat(F.col("s_suppkey")).alias("TargetLatitude"))
        cols = tuple(dict.fromkeys(tuple(FIRE_COLS) + ("CONT_DATE",)))
        fires = bindings.fires(spark, sf_dir)
        j = add_event_time(build_joined(master, fires, coords=coords, fire_cols=cols))
        return with_row_order(j, fires, n_rows=binding_master(spark, sf_dir).count() if materialized else None)
    j = stage_table(spark, "joined", _binding_key(spark, sf_dir), build) if materialized else build()
    hidden = {"CONT_DATE": "CONT_DATE" in fire_cols, "days_since_fire": with_days}
    keep = [c for c in j.columns if hidden.get(c, True)]
    return j.select(*[F.col(f"`{c}`") for c in keep])


def with_row_order(joined: DataFrame, fires: DataFrame, id_col="fire_id",
                   n_rows: int | None = None) -> DataFrame:
    """``row_ord``: one LONG giving the joined table's row order (reading id,
    then perimeter id), so "first row of a group" is a fixed-width
    ``min_by`` that Spark hash-aggregates. Without a safe encoding (the
    product would overflow) the column is left out and callers fall back to
    a struct order."""
    r = fires.agg(F.max(id_col).alias("f"), F.min(id_col).alias("lo")).first()
    n = n_rows if n_rows is not None else (joined.agg(F.max("WaterQualityID").alias("n")).first()["n"] or 0)
    f_max, f_min = (r["f"] or 0), (r["lo"] or 0)
    width = f_max + 2
    if f_min < 0 or (n + 1) * width >= 2 ** 62:
        return joined
    return joined.withColumn("row_ord", F.col("WaterQualityID") * F.lit(width)
                             + F.coalesce(F.col("index_right") + 1, F.lit(0)))
