"""Additive model with one penalised spline per feature.

The sums come from one pass over the data, for all targets at once:

* per Arrow batch (``mapInPandas``) build the B-spline design of the rows that
  are complete for a target and add up the partial sufficient statistics
  [X y]^T [X y] (upper triangle), y centred on the target's mean;
* the partial vectors of all tasks are summed per target in two levels, first
  by a salt, so that no task receives a vector from every other.

Everything after that is Spark expressions on one row a target. The penalised
system is solved by Gauss-Jordan elimination in place, a fold over the pivots,
which leaves the inverse and the coefficients; both sides of the model, fitted
values and effect curves, are closed-form spline expressions.

Each term is held to a mean of zero over the fitted rows (the intercept takes
the level), by a penalty on that mean: it costs nothing in fit, so it changes no
fitted value and no difference of effects, and it keeps the system well
conditioned where the bases of all terms add up to the same constant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderwell.functions.splines import basis_np, place, second_difference_penalty, spline_value, spline_variance
from cinderwell.operators.stats import exact_quantile, report_rows
from cinderwell.session import passes_over
from cinderwell.sources.schema import MODEL_FEATURES, q

N_BASIS = 20          # basis functions per term
LAM = 0.6             # second-difference penalty weight per term
RIDGE = 1e-6          # tiny ridge: what neither data nor penalty tell, is zero
PREDICTION_DIGITS = 9  # fitted values are compared with their median at these digits
GRID = 200            # effect-curve points
SALTS = 64            # first-level groups when partial sums of all tasks meet
Z975 = 1.959963984540054  # fixed value: standard normal 97.5% quantile


def _design(pdf: pd.DataFrame, features, ranges) -> np.ndarray:
    blocks = [np.ones((len(pdf), 1))]
    for f in features:
        lo, hi = ranges[f]
        blocks.append(basis_np(pdf[f].to_numpy(dtype=float), lo, hi, N_BASIS))
    return np.hstack(blocks)


def _gram_fn(features, targets, ranges_by_target, centres, label_col):
    p = 1 + N_BASIS * len(features)
    iu = np.triu_indices(p + 1)

    def fn(batches):
        acc = {t: np.zeros(len(iu[0])) for t in targets}
        seen = {t: 0 for t in targets}
        for pdf in batches:
            for ti, t in enumerate(targets):
                cols = list(features) + [f"_y{ti}", label_col]
                sub = pdf[cols].dropna()
                if sub.empty:
                    continue
                x = _design(sub, features, ranges_by_target[t])
                xy = np.hstack([x, sub[[f"_y{ti}"]].to_numpy(dtype=float) - centres[t]])
                acc[t] += (xy.T @ xy)[iu]
                seen[t] += len(sub)
        rows = [(t, acc[t].tolist()) for t in targets if seen[t]]
        yield pd.DataFrame(rows, columns=["target", "stats"])
    return fn


def basis_ranges(model_df: DataFrame, targets, features=MODEL_FEATURES,
                 label_col="post_fire") -> DataFrame:
    """M5/M6 preprocessing: per target, the rows complete for it and the
    range of every feature over them (the knots of its spline basis), in
    one aggregation. Long form: target, feature, n, lo, hi, mean (of the
    target)."""
    aggs, cells = [], []
    for ti, t in enumerate(targets):
        ok = F.lit(True)
        for c in list(features) + [t, label_col]:
            ok = ok & q(c).isNotNull()
        aggs += [F.count_if(ok).alias(f"n{ti}"), F.avg(F.when(ok, q(t).cast("double"))).alias(f"mean{ti}")]
        for fi, f in enumerate(features):
            aggs += [F.min(F.when(ok, q(f).cast("double"))).alias(f"lo{ti}_{fi}"),
                     F.max(F.when(ok, q(f).cast("double"))).alias(f"hi{ti}_{fi}")]
            cells.append(F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"),
                                  F.col(f"n{ti}").alias("n"), F.col(f"lo{ti}_{fi}").alias("lo"),
                                  F.col(f"hi{ti}_{fi}").alias("hi"), F.col(f"mean{ti}").alias("mean")))
    return model_df.agg(*aggs).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def gram_sums(model_df: DataFrame, targets, features=MODEL_FEATURES, label_col="post_fire",
              min_rows: int = 100) -> tuple[DataFrame, dict]:
    """(target, s) with the summed upper triangle of [X y]^T [X y] of each
    target that has ``min_rows`` complete rows, and {target: (n, mean, ranges)}
    of all targets."""
    features, targets = list(features), list(targets)
    facts: dict = {}
    for r in basis_ranges(model_df, targets, features, label_col).collect():
        facts.setdefault(r["target"], (r["n"], r["mean"], {}))[2][r["feature"]] = (r["lo"], r["hi"])
    keep = [t for t in targets if facts[t][0] >= max(min_rows, 1)]
    d = model_df.select(*[q(c).cast("double").alias(c) for c in features],
                        *[q(t).cast("double").alias(f"_y{i}") for i, t in enumerate(keep)],
                        q(label_col).cast("double").alias(label_col))
    fn = _gram_fn(features, keep, {t: facts[t][2] for t in keep}, {t: facts[t][1] for t in keep}, label_col)
    parts = d.mapInPandas(fn, "target string, stats array<double>") \
        .select("target", array_to_vector("stats").alias("v"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    partial = parts.groupBy("target", "salt").agg(Summarizer.sum(F.col("v")).alias("v"))
    return partial.groupBy("target").agg(Summarizer.sum(F.col("v")).alias("s")), facts


def gram_cells(model_df: DataFrame, targets, features=MODEL_FEATURES, label_col="post_fire",
               min_rows: int = 100) -> DataFrame:
    """The summed statistics in long form: target, i, j, value for i <= j; index
    0 is the intercept, the last index the centred target."""
    sums, _ = gram_sums(model_df, targets, features, label_col, min_rows)
    p = 1 + N_BASIS * len(list(features))
    i, j = (F.array(*[F.lit(int(x)) for x in side]) for side in np.triu_indices(p + 1))
    cells = sums.select("target", F.posexplode(vector_to_array("s")).alias("k", "value"))
    return cells.select("target", F.get(i, F.col("k")).alias("i"), F.get(j, F.col("k")).alias("j"), "value")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _computed(df: DataFrame, keep, **columns) -> DataFrame:
    """``keep`` and new columns. The generator keeps the optimizer from putting
    a column's expression into the lambda that uses it for each element."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in keep], *[c.alias(n) for n, c in columns.items()]))))


def _square(triangle: Column, size: int) -> Column:
    """Symmetric matrix by rows, from its upper triangle by rows."""
    index = F.sequence(F.lit(0), F.lit(size - 1))

    def at(i, j):
        lo, hi = F.least(i, j), F.greatest(i, j)
        return F.get(triangle, (lo * (2 * size - lo - 1) / 2).cast("int") + hi)
    return F.transform(index, lambda i: F.transform(index, lambda j: at(i, j)))


def _penalised(gram: Column, terms: int, lam: float) -> Column:
    """The normal equations with the smoothness of each term, its mean and a
    tiny ridge penalised; the target's row and column stay as they are."""
    p = 1 + N_BASIS * terms
    smooth = F.array(*[F.array(*[F.lit(float(lam * v)) for v in row]) for row in second_difference_penalty(N_BASIS)])
    sums = gram[0]  # column sums of the design

    def cell(v, i, j):
        one_term = (i > 0) & (j > 0) & (i < p) & (j < p) & (F.floor((i - 1) / N_BASIS) == F.floor((j - 1) / N_BASIS))
        held = F.get(F.get(smooth, F.pmod(i - 1, F.lit(N_BASIS))), F.pmod(j - 1, F.lit(N_BASIS))) + F.get(sums, i) * F.get(sums, j) / sums[0]
        return v + F.when(one_term, held).otherwise(0.0) + F.when((i == j) & (i < p), RIDGE).otherwise(0.0)
    return F.transform(gram, lambda row, i: F.transform(row, lambda v, j: cell(v, i, j)))


def _eliminated(matrix: Column, pivots: int) -> Column:
    """Gauss-Jordan elimination in place on the first ``pivots`` rows: these
    hold the inverse of their block, and behind it the solutions. The block is
    positive definite, so no pivot is chosen."""
    def step(m, k):
        row = F.get(m, k)
        d = F.get(row, k)
        return F.transform(m, lambda r, i: F.when(
            i == k, F.transform(r, lambda v, j: F.when(j == k, 1 / d).otherwise(v / d))).otherwise(
            F.transform(r, lambda v, j: F.when(j == k, -v / d).otherwise(v - F.get(r, k) * F.get(row, j) / d))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(pivots - 1)), matrix, step)


def solved(sums: DataFrame, facts: DataFrame, terms: int, lam: float = LAM) -> DataFrame:
    """A row for each target of ``sums`` (target, s) with its fit: coefficients
    ``beta``, a covariance matrix for each term, edof, scale, the ratio of model
    to null log-likelihood at the model scale (``mcfadden``) and explained
    deviance. ``facts`` has target, n, mean and the features' ranges lo, hi."""
    p = 1 + N_BASIS * terms
    own = F.sequence(F.lit(0), F.lit(p - 1))
    rows = lambda m: F.transform(F.slice(m, 1, p), lambda r: F.slice(r, 1, p))
    last = lambda m: F.transform(own, lambda i: F.get(F.get(m, i), F.lit(p)))
    base = ["target", "n", "mean", "lo", "hi"]
    # Summarizer.sum is mean x weight: the count is taken from the facts
    d = _computed(sums.join(facts, "target"), base, s=vector_to_array("s"))
    d = _computed(d, base, g=_square(F.col("s"), p + 1))
    d = _computed(d, [*base, "g"], m=_penalised(F.col("g"), terms, lam))
    d = _computed(d, [*base, "g"], e=_eliminated(F.col("m"), p))
    d = _computed(d, base, x=rows(F.col("g")), inv=rows(F.col("e")), beta=last(F.col("e")), xy=last(F.col("g")), yy=F.col("g")[p][p])
    n, rss, rss0 = F.col("n").cast("double"), F.col("rss"), F.col("rss0")
    d = _computed(d, [*base, "x", "inv", "beta", "xy", "yy"], edof=_total(F.zip_with("inv", "x", _dot)),
                  fit=_total(F.zip_with("x", "beta", lambda r, b: b * _dot(r, F.col("beta")))))
    d = _computed(d, [*base, "x", "inv", "beta", "edof"],
                  rss=F.greatest(F.col("yy") - 2 * _dot(F.col("beta"), F.col("xy")) + F.col("fit"), F.lit(0.0)),
                  rss0=F.greatest(F.col("yy") - F.col("xy")[0] * F.col("xy")[0] / n, F.lit(0.0)))
    d = _computed(d, [*base, "x", "inv", "beta", "edof", "rss", "rss0"], scale=rss / F.greatest(n - F.col("edof"), F.lit(1.0)))
    # the inverse alone explodes in the directions that only the ridge holds, which X'X has not
    blocks = [F.slice("inv", 2 + k * N_BASIS, N_BASIS) for k in range(terms)]
    times_x = lambda block: F.transform(block, lambda r: F.transform(F.col("x"), lambda c: _dot(r, c)))
    d = _computed(d, [*base, "inv", "beta", "edof", "rss", "rss0", "scale"], half=F.array(*map(times_x, blocks)))

    def covariance(k):
        return F.transform(F.get("half", F.lit(k)), lambda h: F.transform(blocks[k], lambda r: F.col("scale") * _dot(h, r)))
    level = n * F.log(2 * np.pi * F.col("scale"))
    return _computed(
        d, ["target", "n", "lo", "hi", "edof", "scale"],
        beta=F.transform("beta", lambda b, i: b + F.when(i == 0, F.col("mean")).otherwise(0.0)), cov=F.array(*map(covariance, range(terms))),
        mcfadden=F.when(F.col("scale") > 0, F.try_divide(level + rss / F.col("scale"), level + rss0 / F.col("scale"))),
        explained_deviance=F.when(rss0 > 0, 1 - rss / rss0))


FIT_SCHEMA = ("target string, n long, status string, lo array<double>, hi array<double>, beta array<double>, "
              "cov array<array<array<double>>>, edof double, scale double, mcfadden double, explained_deviance double")


def fit_gam(model_df: DataFrame, targets, features=MODEL_FEATURES, label_col="post_fire",
            min_rows: int = 100, lam: float = LAM) -> DataFrame:
    """One additive model per target, a row each (``FIT_SCHEMA``); features
    keep their order in ``lo``, ``hi``, ``cov`` and in the coefficients behind
    the intercept.

    ``status`` is "ok", or says that a target has too few rows or that its
    system could not be solved (M12); such a row has n alone. The result is
    model-sized and local, so it outlives the frames it was computed from.
    """
    features, targets = list(features), list(targets)
    spark = model_df.sparkSession
    sums, facts = gram_sums(model_df, targets, features, label_col, min_rows)
    keep = [t for t in targets if facts[t][0] >= max(min_rows, 1)]
    known = spark.createDataFrame(
        [(t, int(facts[t][0]), float(facts[t][1]), *([float(facts[t][2][f][k]) for f in features] for k in (0, 1))) for t in keep],
        "target string, n long, mean double, lo array<double>, hi array<double>")
    got = {r["target"]: r for r in solved(sums, known, len(features), lam).collect()} if keep else {}
    names = [c.split()[0] for c in FIT_SCHEMA.split(", ")]
    rows = []
    for t in targets:
        r = got.get(t)
        ok = r is not None and all(np.isfinite([*r["beta"], r["scale"], r["edof"]]))
        status = "ok" if ok else f"fewer than {min_rows} complete rows" if t not in keep else "not solved: the system is singular"
        rows.append(tuple({"target": t, "n": int(facts[t][0]), "status": status}.get(c, r[c] if ok and c != "status" else None) for c in names))
    return spark.createDataFrame(rows, FIT_SCHEMA)


def score_all(model_df: DataFrame, fits: DataFrame, features=MODEL_FEATURES, label_col="post_fire") -> DataFrame:
    """Fitted values of every target on its own complete rows, in one pass
    without a Python worker: (target, prediction, label). The fits, a row a
    target, are the broadcast side."""
    features = list(features)
    ok = fits.where("status = 'ok'").select("target", "lo", "hi", "beta")
    targets = [r["target"] for r in ok.select("target").collect()]
    names = [f"_x{i}" for i in range(len(features))]
    y = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), q(t).cast("double").alias("y")) for t in targets])).alias("_t")
    rows = model_df.select(*[q(f).cast("double").alias(c) for f, c in zip(features, names)], q(label_col).cast("int").alias("label"), y) \
        .dropna(subset=[*names, "label"]).where("_t.y IS NOT NULL").select(*names, "label", "_t.target")
    d = rows.join(F.broadcast(ok), "target")
    value = F.get("beta", F.lit(0))
    for k, c in enumerate(names):
        j, t = place(F.col(c), F.get("lo", F.lit(k)), F.get("hi", F.lit(k)), N_BASIS)
        value = value + spline_value(F.col("beta"), 1 + k * N_BASIS, j, t)
    return d.select("target", F.round(value, PREDICTION_DIGITS).alias("prediction"), "label")


def effect_curves(fits: DataFrame, term: int = 0, n: int = GRID) -> DataFrame:
    """M8 + M9: (target, i, x, effect, lower, upper), each target's partial
    effect of a term on ``n`` evenly spaced values over its range, with a 95%
    band."""
    d = fits.where("status = 'ok'").select(
        "target", "beta", F.get("lo", F.lit(term)).alias("lo"), F.get("hi", F.lit(term)).alias("hi"), F.get("cov", F.lit(term)).alias("cov"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    d = d.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (n - 1))
    j, t = place(F.col("x"), F.col("lo"), F.col("hi"), N_BASIS)
    d = d.select("target", "i", "x", spline_value(F.col("beta"), 1 + term * N_BASIS, j, t).alias("effect"),
                 F.sqrt(F.greatest(spline_variance(F.col("cov"), j, t), F.lit(0.0))).alias("_se"))
    return d.select("target", "i", "x", "effect", (F.col("effect") - Z975 * F.col("_se")).alias("lower"),
                    (F.col("effect") + Z975 * F.col("_se")).alias("upper"))


def effect_change(curves: DataFrame) -> DataFrame:
    """A23 + F16: (target, change), mean effect after day 0 minus before; null
    if the range has but one side."""
    return curves.groupBy("target").agg((F.avg(F.when(F.col("x") > 0, F.col("effect"))) - F.avg(F.when(F.col("x") < 0, F.col("effect")))).alias("change"))


RESULT_SCHEMA = ("Analyte string, r2 double, explained_deviance double, post_fire_change double, Direction string, "
                 "Accuracy double, Precision double, Recall double, F1 double, n long, status string")


def gam_results(model_df: DataFrame, targets, features=MODEL_FEATURES, label_col="post_fire",
                labels: dict | None = None, min_rows: int = 100):
    """Per target the fit quality, post-event change of the first
    term's effect (mean over grid days > 0 minus days < 0), direction, and
    the model used as a pre/post classifier (fitted value >= its exact
    median vs the label, on the fitted rows; weighted metrics).

    Returns (results, curves, fits). Scoring, medians and confusion grids
    for all targets share one scoring pass and one set of selection passes.
    Published values are rounded to 4 digits (P21). A target without a fit has a
    row with its status and n.
    """
    spark = model_df.sparkSession
    labels = labels or {t: t for t in targets}
    fits = fit_gam(model_df, list(targets), features, label_col, min_rows)
    named = F.create_map(*[F.lit(x) for t in targets for x in (t, labels[t])])[F.col("target")].alias("Analyte")
    curves = effect_curves(fits)
    change = {r["target"]: r["change"] for r in effect_change(curves).collect()}
    every = fits.select("target", "n", "status", "mcfadden", "explained_deviance").collect()
    grid: dict = {}
    if change:
        with passes_over(score_all(model_df, fits, features, label_col)) as scored:
            meds = exact_quantile(scored, "prediction", 0.5, group_col="target")
            cut = F.create_map(*[x for t, m in meds.items() for x in (F.lit(t), F.lit(float(m)))])
            cls = (F.col("prediction") >= cut[F.col("target")]).cast("int")
            for r in scored.groupBy("target", "label", cls.alias("cls")).agg(F.count(F.lit(1)).alias("n")).collect():
                grid.setdefault(r["target"], {})[(r["label"], r["cls"])] = r["n"]
    rows = []
    f = lambda v: None if v is None or v != v else round(float(v), 4)
    for r in every:
        t = r["target"]
        if r["status"] != "ok":
            rows.append((labels[t], *[None] * 8, r["n"], r["status"]))
            continue
        cells = {(a, b): grid.get(t, {}).get((a, b), 0) for a in (0, 1) for b in (0, 1)}
        rep, total = report_rows(cells), sum(cells.values())
        w = lambda i: sum(x[i] * x[4] for x in rep) / total if total else 0.0
        correct = sum(v for (a, b), v in cells.items() if a == b)
        ch = change[t]
        rows.append((labels[t], f(r["mcfadden"]), f(r["explained_deviance"]), f(ch), "↑ increases" if (ch is not None and ch > 0) else "↓ decreases",
                     f(correct / total if total else 0.0), f(w(1)), f(w(2)), f(w(3)), int(r["n"]), "ok"))
    res = spark.createDataFrame(rows, RESULT_SCHEMA).orderBy(F.desc_nulls_last("post_fire_change"), "Analyte")
    return res, curves.select("i", "x", "effect", "lower", "upper", named), fits
