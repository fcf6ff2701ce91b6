"""Statistics over DataFrames.

Exact quantiles are computed by distributed selection, never by gathering a
column into one task: each pass is one aggregation that histograms the values
still in contention into ``buckets`` bins; the bin holding the wanted rank
becomes the next bracket. Only bin counts (and, at the very end, at most
``max_collect`` values per target) reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderwell.session import passes_over
from cinderwell.sources.schema import q


def _finite(c):
    return c.isNotNull() & ~F.isnan(c) & (c > float("-inf")) & (c < float("inf"))


def select_ranks(data: DataFrame, wanted, buckets: int = 1024, max_collect: int = 20_000) -> tuple[dict, dict]:
    """Exact k-th smallest values (0-based ranks) of ``_v`` in each group ``_g``.

    ``wanted`` maps a group's row count to its ranks. Returns ({(group, rank):
    value}, {group: rows}). Infinities are end ranks and never enter a
    bracket. Every pass is one aggregation of the values still in contention,
    each counted once however many ranks its bracket holds; brackets are
    gathered to the driver only while they hold at most ``max_collect`` values
    together, and each pass must shrink the others.
    """
    v, inf = F.col("_v"), float("inf")
    finite = F.when(_finite(v), v)
    first = data.groupBy("_g").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count("_v").alias("n"),
                                   F.count_if(v == -inf).alias("below"), F.count_if(v == inf).alias("above")).collect()
    counts = {r["_g"]: r["n"] for r in first}
    # (group, rank) -> [lo, hi, values below lo, values in [lo, hi], bracket]
    state, result = {}, {}
    for i, r in enumerate(first):
        for k in wanted(r["n"]):
            if k < r["below"]:
                result[(r["_g"], k)] = -inf
            elif k >= r["n"] - r["above"]:
                result[(r["_g"], k)] = inf
            else:
                state[(r["_g"], k)] = [r["lo"], r["hi"], r["below"], r["n"] - r["below"] - r["above"], i]

    # Targets that share a bracket share its rows: a row lies in one bracket of its group at most
    spark, lo, hi = data.sparkSession, F.col("lo"), F.col("hi")
    group = data.schema["_g"].dataType.simpleString()
    held = spark.createDataFrame([(r["_g"], i, r["lo"], r["hi"]) for i, r in enumerate(first)], f"_k {group}, id int, lo double, hi double")
    x = data.where(_finite(v)).join(F.broadcast(held), F.col("_g").eqNullSafe(F.col("_k"))).select("_v", "id", "lo", "hi")
    # halves first: hi - lo may overflow
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    bin_of = F.coalesce(F.least(F.floor(share * F.lit(float(buckets))), F.lit(buckets - 1)), F.lit(0)).cast("int")
    while state:
        for t, s in list(state.items()):
            if s[0] == s[1]:
                result[t] = s[0]
                del state[t]
        # the smallest brackets that together hold at most max_collect values
        small, room = [], max_collect
        for n, i in sorted({(s[3], s[4]) for s in state.values()}):
            if n <= room:
                small.append(i)
                room -= n
        if small:
            got: dict = {}
            for r in x.where(F.col("id").isin(small)).select("id", "_v").collect():
                got.setdefault(r["id"], []).append(r["_v"])
            got = {i: sorted(values) for i, values in got.items()}
            for t, s in list(state.items()):
                if s[4] in got:
                    result[t] = got[s[4]][t[1] - s[2]]
                    del state[t]
        if not state:
            break
        binned = x.where(F.col("id").isin(sorted({s[4] for s in state.values()}))).withColumn("b", bin_of)
        by_bracket: dict = {}
        for r in binned.groupBy("id", "b").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("mn"), F.max("_v").alias("mx")).collect():
            by_bracket.setdefault(r["id"], []).append((r["b"], r["n"], r["mn"], r["mx"]))
        nxt: dict = {}  # (bracket, bin) -> new bracket
        for t, s in state.items():
            below = s[2]
            for b, n, mn, mx in sorted(by_bracket.get(s[4], [])):
                if below + n > t[1]:
                    # values in [mn, mx] are exactly this bin's values (bins are monotone)
                    if mn != mx and n == s[3]:
                        raise RuntimeError("a pass of the exact selection did not shrink its bracket")
                    at = nxt.setdefault((s[4], b), (len(nxt), mn, mx))
                    state[t] = [mn, mx, below, n, at[0]]
                    break
                below += n
        held = spark.createDataFrame([(i, b, *at) for (i, b), at in nxt.items()], "id int, b int, _id int, _lo double, _hi double")
        x = binned.join(F.broadcast(held), ["id", "b"]).select("_v", F.col("_id").alias("id"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))
    return result, counts


def exact_quantile(df: DataFrame, value_col: str, p: float = 0.5, group_col: str | None = None,
                   buckets: int = 1024, max_collect: int = 20_000) -> dict:
    """Exact quantile with linear interpolation (the pandas/numpy
    default), NULL/NaN skipped; {group: value} (group None without groups)."""
    g = F.col(group_col) if group_col else F.lit(None).cast("string")
    narrow = df.select(g.alias("_g"), F.col(value_col).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))

    def around(n):
        return sorted({math.floor((n - 1) * p), math.ceil((n - 1) * p)}) if n else []
    with passes_over(narrow) as data:
        got, counts = select_ranks(data, around, buckets, max_collect)
    out = {}
    for grp, n in counts.items():
        if n:
            h = (n - 1) * p
            lo, hi = got[(grp, math.floor(h))], got[(grp, math.ceil(h))]
            out[grp] = lo if lo == hi else lo + (hi - lo) * (h - math.floor(h))
    return out


def column_medians(df: DataFrame, cols) -> dict:
    """Exact median of several columns in shared passes (one unpivot)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("_name"), q(c).cast("double").alias("_val")) for c in cols])).alias("_x")
    ).select("_x._name", "_x._val")
    return exact_quantile(long, "_val", 0.5, group_col="_name")


def median_impute(df: DataFrame, cols, medians: dict | None = None) -> DataFrame:
    """NULLs replaced by the column's exact median (computed on
    the frame itself unless given). The medians enter as literals."""
    medians = medians if medians is not None else column_medians(df, cols)
    return df.select(*[F.coalesce(q(c), F.lit(medians.get(c))).alias(c) if c in cols else q(c)
                       for c in df.columns])


def standardize(df: DataFrame, cols) -> DataFrame:
    """(x - mean) / population sd; a constant column divides by 1.
    Fit (one aggregate row) then transform with the fitted literals."""
    st = df.agg(*[F.avg(q(c)).alias(f"_m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(q(c)).alias(f"_s{i}") for i, c in enumerate(cols)]).first()
    out = []
    for c in df.columns:
        if c in cols:
            i = list(cols).index(c)
            mu, sd = st[f"_m{i}"], st[f"_s{i}"]
            scale = 1.0 if sd is None or sd == 0 else float(sd)
            out.append(((q(c) - F.lit(mu).cast("double")) / F.lit(scale)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def balanced_weights(df: DataFrame, label_col: str, out="weight") -> DataFrame:
    """N / (k * n_class) per row (k = number of classes present). The
    per-class counts (one row per class) become a literal map."""
    counts = {r[0]: r[1] for r in df.groupBy(label_col).agg(F.count(F.lit(1))).collect()}
    n, k = sum(counts.values()), len(counts)
    w = F.create_map(*[x for c, nc in counts.items() for x in (F.lit(c), F.lit(n / (k * nc)))])
    return df.withColumn(out, w[F.col(label_col)])


def confusion(df: DataFrame, label_col="label", pred_col="prediction", classes=(0, 1)) -> DataFrame:
    """The full class x class grid of counts (zeros included)."""
    grid = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in classes])).alias("actual")).select(
        "actual", F.explode(F.array(*[F.lit(c) for c in classes])).alias("predicted"))
    counts = (df.groupBy(F.col(label_col).cast("int").alias("actual"),
                         F.col(pred_col).cast("int").alias("predicted"))
                .agg(F.count(F.lit(1)).alias("n")))
    return (grid.join(F.broadcast(counts), ["actual", "predicted"], "left")
                .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def _grid(cm: DataFrame) -> dict:
    """The confusion grid (classes^2 cells) as {(actual, predicted): n}."""
    return {(r["actual"], r["predicted"]): r["n"] for r in cm.collect()}


def report_rows(cells: dict):
    classes = sorted({a for a, _ in cells} | {p for _, p in cells})
    rows = []
    for c in classes:
        tp = cells.get((c, c), 0)
        support = sum(n for (a, _), n in cells.items() if a == c)
        pred_pos = sum(n for (_, p), n in cells.items() if p == c)
        prec = tp / pred_pos if pred_pos else 0.0
        rec = tp / support if support else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        rows.append((int(c), float(prec), float(rec), float(f1), int(support)))
    return rows


def class_report(cm: DataFrame) -> DataFrame:
    """Per-class precision, recall, F1 and support from a confusion grid,
    then the accuracy, macro-average and weighted-average rows; zero division
    gives 0."""
    cells = _grid(cm)
    rows = report_rows(cells)
    total = sum(r[4] for r in rows)
    correct = sum(n for (a, p), n in cells.items() if a == p)
    mean = lambda i: sum(r[i] for r in rows) / len(rows) if rows else 0.0
    w = lambda i: sum(r[i] * r[4] for r in rows) / total if total else 0.0
    out = [(str(r[0]), *r[1:]) for r in rows]
    out += [("accuracy", None, None, correct / total if total else 0.0, total),
            ("macro avg", mean(1), mean(2), mean(3), total), ("weighted avg", w(1), w(2), w(3), total)]
    return cm.sparkSession.createDataFrame(
        out, "cls string, precision double, recall double, f1 double, support long")


def weighted_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    cells = _grid(cm)
    rows = report_rows(cells)
    total = sum(cells.values())
    correct = sum(n for (a, p), n in cells.items() if a == p)
    w = lambda i: sum(r[i] * r[4] for r in rows) / total if total else 0.0
    return cm.sparkSession.createDataFrame(
        [(correct / total if total else 0.0, w(1), w(2), w(3), int(total))],
        "accuracy double, precision double, recall double, f1 double, n long")


def r2_score(df: DataFrame, label_col="label", pred_col="prediction") -> DataFrame:
    """1 - SSE/SST in one pass; SST from the running variance, which
    keeps its digits however far the values are from zero."""
    y, p = F.col(label_col), F.col(pred_col)
    s = df.agg(F.count(y).alias("n"), F.var_pop(y).alias("var"),
               F.sum((y - p) * (y - p)).alias("sse"))
    sst = F.col("n") * F.col("var")
    return s.select(F.when(sst > 0, 1 - F.col("sse") / sst).alias("r2"), "n")


def class_means(df: DataFrame, cols, label_col="post_fire") -> DataFrame:
    """A17 + P18 + P19: mean of each column per class (0 = before,
    1 = after), percent change and direction; one aggregation, unpivoted."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.when(F.col(label_col) == 0, q(c))).alias(f"_b{i}"),
                 F.avg(F.when(F.col(label_col) == 1, q(c))).alias(f"_a{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("Analyte"), F.col(f"_b{i}").alias("before"),
                              F.col(f"_a{i}").alias("after")) for i, c in enumerate(cols)])
    out = wide.select(F.explode(rows).alias("_r")).select("_r.*")
    pct = F.try_divide(F.col("after") - F.col("before"), F.col("before")) * 100
    return out.withColumn("pct_change", pct).withColumn(
        "direction", F.when(F.col("pct_change") > 0, "↑").otherwise("↓"))
