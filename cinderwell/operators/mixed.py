"""Random-intercept model per analyte (M21): y = b0 + b1 * x + u_station + e.

The reference publishes only this model's output; the model form is inferred
from its columns (coefficient of the post-event flag, p-value, readings and
stations counts). Estimation by REML, profiled over the variance ratio
g = var(u) / var(e):

* per (analyte, station) sufficient statistics n, Sx, Sy, Sxx, Sxy, Syy —
  one ``groupBy`` with partial aggregation;
* for a grid of g values, ONE aggregation over (station statistics x grid)
  yields every sum the profiled likelihood needs; the driver evaluates the
  2x2 algebra per grid point and narrows the grid around the best value.

No per-station data reaches the driver, whatever the number of stations.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderwell.sources.schema import q

GRID = 41
ROUNDS = 3


def station_stats(df: DataFrame, targets, x_col="post_fire", group_col="StationCode") -> DataFrame:
    """Per (analyte, group) sufficient statistics over rows with x and y."""
    long = df.select(q(group_col).alias("g"), F.col(x_col).cast("double").alias("x"),
                     F.explode(F.array(*[F.struct(F.lit(t).alias("Analyte"), q(t).cast("double").alias("y"))
                                         for t in targets])).alias("_t")) \
             .select("g", "x", "_t.Analyte", "_t.y") \
             .where(F.col("y").isNotNull() & F.col("x").isNotNull() & F.col("g").isNotNull())
    x, y = F.col("x"), F.col("y")
    return long.groupBy("Analyte", "g").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))


def grid_sums(stats: DataFrame, grids: dict) -> DataFrame:
    """A row of sums for every grid value of every analyte, one pass. The grid
    (some forty values an analyte) is the only broadcast side."""
    spark = stats.sparkSession
    rows = [(a, float(g)) for a, gs in grids.items() for g in gs]
    grid = spark.createDataFrame(rows, "Analyte string, gamma double")
    j = stats.join(F.broadcast(grid), "Analyte")
    w = F.col("gamma") / (1 + F.col("n") * F.col("gamma"))
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    agg = j.groupBy("Analyte", "gamma").agg(
        F.sum(n - w * n * n).alias("a00"), F.sum(sx - w * n * sx).alias("a01"),
        F.sum(sxx - w * sx * sx).alias("a11"), F.sum(sy - w * n * sy).alias("b0"),
        F.sum(sxy - w * sx * sy).alias("b1"), F.sum(syy - w * sy * sy).alias("c"),
        F.sum(F.log1p(n * F.col("gamma"))).alias("logdet"), F.sum(n).alias("N"),
        F.count(F.lit(1)).alias("groups"))
    return agg


def _reml(s: dict):
    a = np.array([[s["a00"], s["a01"]], [s["a01"], s["a11"]]])
    b = np.array([s["b0"], s["b1"]])
    nn, p = s["N"], 2
    det = np.linalg.det(a)
    if nn <= p or det <= 0:
        return None
    ainv = np.linalg.inv(a)
    beta = ainv @ b
    qf = s["c"] - b @ beta
    if qf <= 0:
        return None
    sigma2 = qf / (nn - p)
    ll = -0.5 * ((nn - p) * math.log(sigma2) + s["logdet"] + math.log(det) + (nn - p))
    return ll, beta, sigma2, ainv


def mixed_effects(df: DataFrame, targets, x_col="post_fire", group_col="StationCode",
                  labels: dict | None = None) -> DataFrame:
    """Analyte, Coefficient, p_value, Significant, Direction, n_readings,
    n_stations (coefficient of ``x_col``; two-sided z-test, as mixed-model
    summaries report), status. A target whose likelihood has no maximum to
    report (too few readings, a flag or a target that does not vary) has its
    counts and a status that says so."""
    spark = df.sparkSession
    labels = labels or {t: t for t in targets}
    # a shift of y moves only the intercept; centred sums keep their digits
    means = df.where(F.col(x_col).isNotNull() & q(group_col).isNotNull()).agg(
        *[F.avg(q(t).cast("double")).alias(f"m{i}") for i, t in enumerate(targets)]).first()
    centred = df.select(q(group_col), q(x_col), *[(q(t).cast("double") - F.lit(means[i]).cast("double")).alias(t) for i, t in enumerate(targets)])
    stats = station_stats(centred, targets, x_col, group_col)
    stats = stats.persist()
    try:
        grids = {t: np.concatenate([[0.0], np.logspace(-6, 4, GRID)]) for t in targets}
        best: dict = {}
        sizes: dict = {}
        for _ in range(ROUNDS):
            sums = {(r["Analyte"], r["gamma"]): r.asDict() for r in grid_sums(stats, grids).collect()}
            sizes |= {a: (int(s["N"]), int(s["groups"])) for (a, _), s in sums.items()}
            for t in targets:
                cands = sorted(g for (a, g) in sums if a == t)
                fits = [(g, _reml(sums[(t, g)])) for g in cands]
                fits = [(g, f) for g, f in fits if f is not None]
                if not fits:
                    continue
                g_best, f_best = max(fits, key=lambda gf: gf[1][0])
                best[t] = (g_best, f_best, sums[(t, g_best)])
                i = cands.index(g_best)
                lo = cands[max(i - 1, 0)]
                hi = cands[min(i + 1, len(cands) - 1)]
                lo = lo if lo > 0 else hi * 1e-3
                grids[t] = np.unique(np.concatenate([[0.0], np.geomspace(max(lo, 1e-12), max(hi, 1e-12), 21)]))
    finally:
        stats.unpersist()
    rows = []
    for t in targets:
        if t not in best:
            rows.append((labels[t], None, None, None, None, *sizes.get(t, (0, 0)), "not fitted: too few readings or nothing varies"))
            continue
        _, (ll, beta, sigma2, ainv), s = best[t]
        se = math.sqrt(max(sigma2 * ainv[1, 1], 0.0))
        coef = float(beta[1])
        p = math.erfc(abs(coef / se) / math.sqrt(2)) if se > 0 else None
        rows.append((labels[t], round(coef, 4), None if p is None else round(p, 4),
                     bool(p is not None and p < 0.05), "↑ increases" if coef > 0 else "↓ decreases",
                     int(s["N"]), int(s["groups"]), "ok"))
    return spark.createDataFrame(rows, "Analyte string, Coefficient double, p_value double, "
                                       "Significant boolean, Direction string, n_readings long, "
                                       "n_stations long, status string")
