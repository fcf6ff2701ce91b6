"""Decision trees grown level by level.

A tree is grown for all targets at once, one pass over the rows a level. Every
row finds its node by the splits above, at most 2^depth a target, which go to
all tasks. A task sums the weights, and the statistics of the label, of each
(target, node, feature, value) of its rows, ``ROWS`` at a time in arrays; Spark
adds up these partial histograms, so what moves follows the number of distinct
values and not the rows. A window over each (node, feature) turns the sums into
those left of a cut, the gain of every cut follows in closed form, and the best
one is an arg-max with ties to the earlier feature and the smaller cut. The last
level has leaves only and sums one feature. The tree is a table of nodes.

Cuts fall on observed values ("value <= cut" goes left), so the bins are exact.
Features with many values are first put in ``BINS`` bins of equal counts
(``quantile_cuts``, ``binned``), which bounds the histogram. Nothing is drawn at
random: the same rows give the same tree, in any engine that can add. The
forests in ``ml`` remain for averages over many trees.

Regression splits by variance, classification by weighted Gini impurity with a
weight for each class ("balanced": n / (k n_c)); class 0/1 labels have the same
closed form, since the impurity of a 0/1 label is twice its variance.
"""

from __future__ import annotations

import math
from contextlib import nullcontext
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderwell.operators.stats import select_ranks
from cinderwell.session import passes_over
from cinderwell.sources.schema import q

DEPTH, MIN_LEAF, BINS = 4, 20, 64
#: rows that a task sums at a time
ROWS = 500_000
#: gains are compared at these digits, so that equal ones tie in any engine
GAIN_DIGITS = 6

SPLITS = ("target string, node long, depth int, n long, weight double, value double, gain double, "
          "feature int, cut double")


def long_rows(df: DataFrame, targets, features, weight: Column | None = None, beside=()) -> DataFrame:
    """(target, y, w, xs): a row for each target that a row has, features as an
    array of doubles; columns ``beside`` follow. Rows that lack a feature are
    left out (complete cases)."""
    xs = [q(f).cast("double") for f in features]
    complete = reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])
    ys = F.array(*[F.struct(F.lit(t).alias("target"), q(t).cast("double").alias("y")) for t in targets])
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return df.where(complete).select(F.array(*xs).alias("xs"), w.alias("w"), *[q(c) for c in beside], F.explode(ys).alias("_t")) \
        .select("_t.target", "_t.y", "w", "xs", *[q(c) for c in beside]).where("y IS NOT NULL AND w > 0")


def quantile_cuts(df: DataFrame, features, bins: int = BINS) -> dict[str, list[float]]:
    """For each feature the distinct values at ranks n/bins, 2n/bins, ... of its
    n values, exact by distributed selection."""
    values = F.array(*[F.struct(F.lit(f).alias("_g"), q(f).cast("double").alias("_v")) for f in features])
    ranks = lambda n: sorted({n * k // bins for k in range(1, bins)}) if n else []
    with passes_over(df.select(F.explode(values).alias("_x")).select("_x._g", "_x._v").where("_v IS NOT NULL")) as data:
        got, counts = select_ranks(data, ranks)
    return {f: sorted({got[(f, k)] for k in ranks(counts.get(f, 0))}) for f in features}


def binned(df: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """Each feature that has cuts is replaced by the smallest cut at or above
    its value; larger values share the bin behind the last cut."""
    inf = float("inf")
    # the buckets of Bucketizer are closed below: those of the negated values are what is wanted
    finite = {c: [x for x in sorted(set(cuts[c])) if math.isfinite(x)] for c in df.columns if cuts.get(c)}
    found = [c for c in finite if finite[c]]
    x = {c: q(c).cast("double") for c in finite}
    taken = df.select("*", *[(F.lit(0.0) - x[c]).alias(f"_x{i}") for i, c in enumerate(found)])
    if found:
        taken = Bucketizer(splitsArray=[[-inf, *(0.0 - v for v in reversed(finite[c])), inf] for c in found], handleInvalid="keep",
                           inputCols=[f"_x{i}" for i in range(len(found))], outputCols=[f"_b{i}" for i in range(len(found))]).transform(taken)

    def at(c):
        # one more for NaN, which is larger than all cuts
        above = F.get(F.array(*[F.lit(v) for v in (inf, *reversed(finite[c]), inf)]), F.col(f"_b{found.index(c)}").cast("int")) if finite[c] else F.lit(inf)
        low = F.when(x[c] == -inf, -inf).otherwise(above) if -inf in cuts[c] else above
        return F.when(x[c].isNotNull(), low).alias(c)
    return taken.select(*[at(c) if c in finite else q(c) for c in df.columns])


def _score(w: Column, s: Column) -> Column:
    """What a node of weight w and label sum s takes off the squared error."""
    return F.try_divide(s * s, w)


def _descent(nodes):
    """How rows find their nodes: target -> (feature of each node, -1 at a leaf;
    its cut)."""
    top = max((r["node"] for r in nodes), default=0) + 1
    out: dict = {}
    for r in nodes:
        feature, cut = out.setdefault(r["target"], (np.full(top, -1), np.zeros(top)))
        if r["feature"] is not None:
            feature[r["node"]], cut[r["node"]] = r["feature"], r["cut"]
    return out


def _beyond(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """x > cut as Spark has it: NaN is the largest."""
    return (x > cut) | (np.isnan(x) & ~np.isnan(cut))


def _features(batch) -> np.ndarray:
    return batch.column("xs").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _targets(batch):
    """(name, places of its rows) of each target in a batch."""
    named = batch.column("target").dictionary_encode()
    code = named.indices.to_numpy(zero_copy_only=False)
    return [(name, np.flatnonzero(code == i)) for i, name in enumerate(named.dictionary.to_pylist())]


_SUMS = "target string, node long, feature int, x double, n long, w double, s double"


def _cells(name, node, y, w, xs):
    """Sums of the rows of one target by (node, feature, x)."""
    nodes, at = np.unique(node, return_inverse=True)
    for f in range(xs.shape[1]):
        cell, values = pd.factorize(np.ascontiguousarray(xs[:, f]), use_na_sentinel=False)
        cell = cell + at * len(values)
        cells = np.arange(len(nodes) * len(values))
        if len(cells) > len(cell):
            cells, cell = np.unique(cell, return_inverse=True)
        n, sw, sy = (np.bincount(cell, v, len(cells)) for v in (None, w, w * y))
        some = np.flatnonzero(n)
        at_node, at_value = np.divmod(cells[some], len(values))
        yield pa.RecordBatch.from_arrays([
            pa.array([name] * len(some), pa.string()), pa.array(nodes[at_node], pa.int64()), pa.array(np.full(len(some), f), pa.int32()),
            pa.array(values[at_value]), pa.array(n[some], pa.int64()), pa.array(sw[some]), pa.array(sy[some])], names=["target", "node", "feature", "x", "n", "w", "s"])


def _sums(splits, depth: int, first_only: bool):
    """What a task sums of the rows at ``depth``, some ``ROWS`` at a time; rows
    that end in a leaf above it are left out."""
    descent = _descent(splits)

    def each(batches):
        held, n = {}, 0
        for batch in batches:
            ys, ws, all_xs = (batch.column("y").to_numpy(), batch.column("w").to_numpy(), _features(batch))
            for name, rows in _targets(batch):
                feature, cut = descent.get(name, (np.full(2, -1), np.zeros(2)))
                node = np.ones(len(rows), np.int64)
                for _ in range(depth):
                    on = feature[node] >= 0
                    rows, node = rows[on], node[on]
                    node = 2 * node + _beyond(all_xs[rows, feature[node]], cut[node])
                held.setdefault(name, []).append((node, ys[rows], ws[rows], all_xs[rows][:, :1] if first_only else all_xs[rows]))
                n += len(rows)
            if n >= ROWS:
                for name, parts in held.items():
                    yield from _cells(name, *map(np.concatenate, zip(*parts)))
                held, n = {}, 0
        for name, parts in held.items():
            yield from _cells(name, *map(np.concatenate, zip(*parts)))
    return each


def best_splits(rows: DataFrame, depth: int, min_leaf: int = MIN_LEAF, splits=(), leaves: bool = False) -> DataFrame:
    """For each (target, node) that ``rows`` (``long_rows``) reach at ``depth`` by
    the ``splits`` above its size, mean and best split, one row (``SPLITS``);
    feature and cut are null where no cut gains anything or leaves ``min_leaf``
    rows on both sides, and with ``leaves`` everywhere."""
    sums = rows.select("target", "y", "w", "xs").mapInArrow(_sums(splits, depth, leaves), _SUMS) \
        .groupBy("target", "node", "feature", "x") \
        .agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("s").alias("s"))
    cell = Window.partitionBy("target", "node", "feature")
    left = cell.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = sums.select("target", "node", "feature", "x",
                    *[F.sum(c).over(left).alias(f"l{c}") for c in ("n", "w", "s")], *[F.sum(c).over(cell).alias(f"a{c}") for c in ("n", "w", "s")])
    gain = _score(F.col("lw"), F.col("ls")) + _score(F.col("aw") - F.col("lw"), F.col("as") - F.col("ls")) - _score(F.col("aw"), F.col("as"))
    fits = F.lit(not leaves) & (F.col("ln") >= min_leaf) & (F.col("an") - F.col("ln") >= min_leaf)
    d = d.withColumn("gain", F.when(fits, F.round(gain, GAIN_DIGITS)))
    # greatest gain, then the first feature, then the smallest cut
    first = -F.col("feature")
    out = d.groupBy("target", "node").agg(
        F.max("an").alias("n"), F.max_by("aw", first).alias("weight"), F.max_by(F.try_divide("as", "aw"), first).alias("value"),
        F.max_by(F.struct("gain", "feature", "x"), F.struct(F.col("gain"), first, -F.col("x"))).alias("b"))
    good = lambda c: F.when(F.col("b.gain") > 0, F.col(f"b.{c}"))
    return out.select("target", "node", F.lit(depth).alias("depth"), "n", "weight", "value", good("gain").alias("gain"),
                      good("feature").alias("feature"), good("x").alias("cut"))


def grow(rows: DataFrame, max_depth: int = DEPTH, min_leaf: int = MIN_LEAF, kept: bool = False) -> DataFrame:
    """The nodes (``SPLITS``) of one tree for each target of ``rows``
    (``long_rows``): at most 2^(max_depth + 1) rows a target, a local table.
    ``kept`` rows are persisted by the caller."""
    spark = rows.sparkSession
    every: list = []
    with nullcontext(rows) if kept else passes_over(rows) as base:
        for depth in range(max_depth + 1):
            level = best_splits(base, depth, min_leaf, every, depth == max_depth).collect()
            every += level
            if not any(r["feature"] is not None for r in level):
                break
    return spark.createDataFrame(sorted(every, key=lambda r: (r["target"], r["node"])), SPLITS)


def importances(tree: DataFrame, features) -> DataFrame:
    """(target, feature, importance): each feature's share of the gains (M4);
    all zero for a tree without a split. ``O6`` is its arg-max."""
    names = F.array(*[F.lit(f) for f in features])
    total = F.coalesce(F.sum("gain"), F.lit(0.0))
    parts = [F.coalesce(F.sum(F.when(F.col("feature") == i, F.col("gain"))), F.lit(0.0)).alias(f"g{i}") for i in range(len(features))]
    wide = tree.groupBy("target").agg(total.alias("total"), *parts)
    return wide.select("target", "total", F.posexplode(F.array(*[f"g{i}" for i in range(len(features))])).alias("i", "g")) \
        .select("target", F.get(names, F.col("i")).alias("feature"), F.coalesce(F.try_divide("g", "total"), F.lit(0.0)).alias("importance"))


def _leaves(nodes):
    descent, means = _descent(nodes), {}
    for r in nodes:
        means.setdefault(r["target"], {})[r["node"]] = r["value"]

    def each(batches):
        for batch in batches:
            xs = _features(batch)
            known, node, mean = np.zeros(batch.num_rows, bool), np.ones(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for name, rows in _targets(batch):
                if name not in descent:
                    continue
                feature, cut = descent[name]
                at, going = node[rows], np.arange(len(rows))
                while len(going := going[at[going] < len(feature)]) and len(going := going[feature[at[going]] >= 0]):
                    now = at[going]
                    at[going] = 2 * now + _beyond(xs[rows[going], feature[now]], cut[now])
                value = np.array([means[name].get(i, np.nan) for i in range(2 * len(feature))])
                node[rows], mean[rows] = at, value[at]
                known[rows] = np.isin(at, list(means[name]))
            told = batch.append_column("node", pa.array(node)).append_column("prediction", pa.array(mean))
            yield told.filter(pa.array(known))
    return each


def predict(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """``rows`` (``long_rows``) with ``node``, the leaf that each reaches, and
    ``prediction``, its mean. Rows of a target without a tree are left out."""
    kind = T.StructType([*rows.schema.fields, T.StructField("node", T.LongType()), T.StructField("prediction", T.DoubleType())])
    return rows.mapInArrow(_leaves(tree.collect()), kind)


def r2_by_target(predicted: DataFrame) -> DataFrame:
    """(target, n, r2) of predictions."""
    e = F.col("y") - F.col("prediction")
    return predicted.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.var_pop("y").alias("v")) \
        .select("target", "n", F.when(F.col("v") > 0, 1 - F.col("sse") / (F.col("n") * F.col("v"))).alias("r2"))
