"""Model preparation, deterministic splits and MLlib forests
(M0–M4, M14–M19, O6, O7, J4–J6).

Splits and samples are keyed on a content hash of each row's natural key, so
they are reproducible, identical in SQL engines that have ``md5``, and need
no global sort: exact-size splits find the k-th smallest hash by distributed
selection (``select_ranks``) and then filter.
"""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderwell.operators.stats import (select_ranks, balanced_weights, class_means,
                                        column_medians, confusion, median_impute, r2_score,
                                        standardize, weighted_metrics)
from cinderwell.session import checkpoint_dir, passes_over
from cinderwell.sources.schema import MODEL_FEATURES, q

SEED = 42
# Forest training: more tree nodes per pass over the data (fewer passes) and
# cached node ids (no re-descent of every tree per row and level).
TRAIN_OPTS = {"maxMemoryInMB": 1024, "cacheNodeIds": True}
#: rows that concurrent forests hold together; a larger one is fitted alone
ROWS_AT_ONCE = 10_000_000
HASH_HEX_DIGITS = 13  # 52 bits: exact in a double, so selection on it is exact


def row_key(cols) -> Column:
    """Text key of a row; a NULL part differs from every text."""
    return F.concat_ws("|", *[F.coalesce(q(c).cast("string"), F.lit("\0")) for c in cols])


def key_hash(key: Column, seed: int = SEED) -> Column:
    """Deterministic 52-bit hash of a text key (md5 based). Keys may tie."""
    h = F.md5(F.concat(key, F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, HASH_HEX_DIGITS), 16, 10).cast("long")


def _smallest(df: DataFrame, want, out: str) -> DataFrame:
    """Flags exactly ``want(n)`` of each group's n rows, those with the smallest
    hash. ``df`` has ``_g`` and ``_h``. The limit is found by distributed
    selection. Only rows at a group's limit can tie; if they would overshoot,
    these few are numbered in the order of their columns, the others are told
    by a filter."""
    with passes_over(df.select(F.col("_g"), F.col("_h").cast("double").alias("_v"))) as data:
        limits, counts = select_ranks(data, lambda n: [want(n) - 1] if want(n) >= 1 else [])
        cut = {g: int(limits[(g, want(n) - 1)]) for g, n in counts.items() if want(n) >= 1}
        key = F.coalesce(F.col("_g").cast("string"), F.lit("\0"))
        text = lambda g: "\0" if g is None else str(g).lower() if isinstance(g, bool) else str(g)
        at = lambda m: F.create_map(*[x for g, k in m.items() for x in (F.lit(text(g)), F.lit(k))])[key] if m else F.lit(None).cast("long")
        low = data.where(F.col("_v") <= at(cut)).groupBy("_g").agg(
            F.count_if(F.col("_v") < at(cut)).alias("under"), F.count(F.lit(1)).alias("upto")).collect()
    need = {r["_g"]: want(counts[r["_g"]]) - r["under"] for r in low if r["upto"] > want(counts[r["_g"]])}
    flagged = df.withColumn(out, F.coalesce(F.col("_h") <= at(cut), F.lit(False)))
    if not need:
        return flagged
    tied = F.coalesce((F.col("_h") == at(cut)) & at(need).isNotNull(), F.lit(False))
    order = [F.col(f"`{c}`") for c in df.columns if c not in ("_g", "_h")]
    place = F.row_number().over(Window.partitionBy("_g").orderBy(*order))
    return flagged.where(~tied).unionByName(
        df.where(tied).withColumn(out, place <= at(need)).select(*flagged.columns))


def hash_split(df: DataFrame, key_cols, test_size: float = 0.2, seed: int = SEED,
               label_col: str | None = None, out="is_test") -> DataFrame:
    """M1/M2: exact-size split. Test rows are the ceil(test_size * n) rows
    with the smallest key hash — per class when ``label_col`` is given
    (stratified). Rows may repeat their key."""
    g = F.col(label_col) if label_col else F.lit(None).cast("string")
    hh = df.withColumn("_h", key_hash(row_key(key_cols), seed)).withColumn("_g", g)
    return _smallest(hh, lambda n: math.ceil(test_size * n), out).drop("_h", "_g")


def capped_sample(df: DataFrame, key_cols, n: int, seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows chosen by key hash. The limit is the
    feature; it becomes a threshold on the hash, so nothing is sorted and no
    task gathers the sample."""
    hh = df.withColumn("_h", key_hash(row_key(key_cols), seed)).withColumn("_g", F.lit(None).cast("string"))
    return _smallest(hh, lambda rows: min(n, rows), "_in").where("_in").drop("_h", "_g", "_in")


def _training_ready(spark) -> None:
    """Node-id caching checkpoints every 10 iterations into the session's
    checkpoint folder, so a lost executor does not restart a deep fit."""
    checkpoint_dir(spark)


def _assemble(df: DataFrame, features, out="features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def rf_regression(model_df: DataFrame, analytes, features=MODEL_FEATURES,
                  key_cols=("StationCode", "SampleDate", "index_right"), num_trees: int = 20,
                  max_depth: int = 10, max_bins: int = 32, min_rows: int = 100,
                  seed: int = SEED, parallel: int = 8, isolate: bool = False):
    """M3 + M4: one forest per analyte on complete cases.

    Returns (results, importances): results Analyte, r2, top_feature, n, status
    (n counted before the split); importances Analyte, feature, importance.
    An analyte with fewer than ``min_rows`` complete rows is not fitted; its row
    says so. A fit that fails, fails the call; with ``isolate`` (M12) its row has
    the kind of error instead, its jobs are cancelled and the others go on, but
    if all fits fail, the first error is raised. Above ``ROWS_AT_ONCE`` rows fewer
    fits run side by side and ``model_df`` is read for each: it should be stored.
    """
    spark = model_df.sparkSession
    _training_ready(spark)
    base = model_df.select(*[q(c) for c in key_cols],
                           *[q(c).cast("double").alias(c) for c in list(features) + list(analytes)]) \
                   .withColumn("_h", key_hash(row_key(key_cols), seed)).withColumn("_g", F.lit(None).cast("string"))

    def complete(a):
        cond = F.lit(True)
        for c in list(features) + [a]:
            cond = cond & F.col(f"`{c}`").isNotNull()
        return cond

    def one(d, a, n):
        # the fit and the evaluation each pass over the shared frame
        cols = list(features) + [a]
        d = d.where(complete(a)).select(*[q(c) for c in key_cols], *[q(c) for c in cols], "_h", "_g")
        with passes_over(_smallest(d, lambda rows: math.ceil(0.2 * rows), "is_test")) as d:
            rf = RandomForestRegressor(featuresCol="features", labelCol=a, numTrees=num_trees,
                                       maxDepth=max_depth, maxBins=max_bins, seed=seed,
                                       featureSubsetStrategy="all", **TRAIN_OPTS)
            model = rf.fit(_assemble(d.where(~F.col("is_test")), features))
            pred = model.transform(_assemble(d.where(F.col("is_test")), features))
            r2 = r2_score(pred, a, "prediction").first()["r2"]
        fi = model.featureImportances.toArray()
        top = list(features)[int(fi.argmax())]
        return ((a, None if r2 is None else float(round(r2, 4)), top, int(n), "ok"),
                [(a, f, float(v)) for f, v in zip(features, fi)])

    errors = {}

    def attempt(a, n):
        group = f"forest-{uuid.uuid4().hex}"
        spark.sparkContext.setJobGroup(group, f"forest of {a}", interruptOnCancel=True)
        try:
            return one(shared, a, n)
        except Exception as error:
            if not isolate:
                raise
            spark.sparkContext.cancelJobGroup(group)
            errors[a] = error
            return (a, None, None, int(n), f"failed: {type(error).__name__}"), []

    # independent fits run as concurrent Spark jobs (the scheduler shares the
    # executors between them) while their rows, which each fit keeps in several
    # forms, fit together; each job is itself distributed. The frame beside them
    # is kept only if it is small, too
    sizes = base.agg(*[F.count_if(complete(a)).alias(f"n{i}") for i, a in enumerate(analytes)]).first()
    rows = {a: sizes[i] for i, a in enumerate(analytes)}
    fitted = [a for a in analytes if rows[a] >= min_rows]
    with passes_over(base) if sum(rows.values()) <= ROWS_AT_ONCE else nullcontext(base) as shared:
        room = ROWS_AT_ONCE // max([rows[a] for a in fitted], default=1)
        with ThreadPoolExecutor(max_workers=max(1, min(len(fitted), parallel, room))) as pool:
            outs = dict(zip(fitted, pool.map(lambda a: attempt(a, rows[a]), fitted)))
    if errors and len(errors) == len(fitted):
        raise errors[fitted[0]]
    res = [outs[a][0] if a in outs else (a, None, None, int(rows[a]), f"fewer than {min_rows} complete rows") for a in analytes]
    imp = [x for a in fitted for x in outs[a][1]]
    results = spark.createDataFrame(res, "Analyte string, r2 double, top_feature string, n long, status string")
    importances = spark.createDataFrame(imp, "Analyte string, feature string, importance double")
    return results, importances


def classifier_frame(model_df: DataFrame, analytes, label_col="post_fire", min_present: int = 3,
                     key_cols=("StationCode", "SampleDate", "index_right")) -> DataFrame:
    """M14 (first half): analytes + label, rows with at least ``min_present``
    analytes (F9)."""
    d = model_df.select(*[q(c) for c in key_cols], *[q(a) for a in analytes],
                        F.col(label_col).cast("int").alias(label_col))
    return d.dropna(thresh=min_present, subset=list(analytes))


def rf_classifier(model_df: DataFrame, analytes, display: dict | None = None, label_col="post_fire",
                  key_cols=("StationCode", "SampleDate", "index_right"), num_trees: int = 100,
                  max_depth: int = 10, min_present: int = 3, train_cap: int | None = None,
                  seed: int = SEED):
    """Filter, exact-median impute, standardise (population sd),
    stratified split, class-balanced forest.

    Returns dict of DataFrames: confusion, metrics, importances (display
    names, descending), ranking (Analyte, Before, After, pct_change,
    Direction, Importance — sorted by importance).
    """
    spark = model_df.sparkSession
    _training_ready(spark)
    display = display or {a: a for a in analytes}
    base = classifier_frame(model_df, analytes, label_col, min_present, key_cols)
    with passes_over(base) as base:
        med = column_medians(base, analytes)
        imputed = median_impute(base, analytes, med)
        scaled = standardize(imputed, analytes)
        split = hash_split(scaled, key_cols, 0.2, seed, label_col=label_col)
        train = split.where(~F.col("is_test"))
        if train_cap:
            train = capped_sample(train, key_cols, train_cap, seed)
        train = balanced_weights(train, label_col, "weight")
        clf = RandomForestClassifier(featuresCol="features", labelCol=label_col, weightCol="weight",
                                     numTrees=num_trees, maxDepth=max_depth, seed=seed,
                                     featureSubsetStrategy="sqrt", **TRAIN_OPTS)
        model = clf.fit(_assemble(train, analytes))
        pred = model.transform(_assemble(split.where(F.col("is_test")), analytes))
        cm = _local(confusion(pred, label_col, "prediction"))
        fi = model.featureImportances.toArray()
        imp = spark.createDataFrame([(a, display[a], float(v)) for a, v in zip(analytes, fi)],
                                    "Analyte string, display string, importance double")
        ranking = _local(class_means(imputed, analytes, label_col)
                         .join(F.broadcast(imp), "Analyte")
                         .select(F.col("display").alias("Analyte"),
                                 F.bround("before", 3).alias("Before"), F.bround("after", 3).alias("After"),
                                 F.bround("pct_change", 1).alias("pct_change"),
                                 F.col("direction").alias("Direction"),
                                 F.bround("importance", 4).alias("Importance")))
    return {"confusion": cm, "metrics": _local(weighted_metrics(cm)),
            "importances": imp.orderBy(F.desc("importance")),
            "ranking": ranking.orderBy(F.desc("Importance"), "Analyte")}


def _local(df: DataFrame) -> DataFrame:
    """A model-sized result (a handful of rows) as a local relation, so it
    outlives the working frames it was computed from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
