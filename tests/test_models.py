"""Model invariants: importances sum to 1, GAM recovers a smooth signal."""

import math
import random

import pytest

import numpy as np
from pyspark.sql import functions as F

from cinderwell.operators import gam, ml
from cinderwell.sources.schema import MODEL_FEATURES


def _frame(spark, n=600, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        d = rnd.randint(-1800, 1800)
        lat, lon = rnd.uniform(32, 42), rnd.uniform(-124, -114)
        y = 2.0 + 0.002 * d + math.sin(lat) + rnd.gauss(0, 0.05)
        rows.append((f"s{i}", d, rnd.uniform(0, 12), rnd.randint(0, 3), lat, lon, rnd.randint(1, 9),
                     int(d >= 0), y))
    return spark.createDataFrame(rows, "StationCode string, days_since_fire int, log_acres double, "
                                       "season_num int, TargetLatitude double, TargetLongitude double, "
                                       "Region int, post_fire int, y double")


def _fit(spark, df, **kw):
    return gam.fit_gam(df, ["y"], **kw)


def _plain_design(pdf, fit):
    ranges = {f: (lo, hi) for f, lo, hi in zip(MODEL_FEATURES, fit["lo"], fit["hi"])}
    return gam._design(pdf, list(MODEL_FEATURES), ranges)


def test_gam_recovers_signal(spark):
    df = _frame(spark)
    fits = _fit(spark, df)
    f = fits.first()
    assert f["n"] == df.count() and f["status"] == "ok"
    assert f["explained_deviance"] > 0.95
    curve = gam.effect_curves(fits).orderBy("i").toPandas()
    slope = (curve.effect.iloc[-1] - curve.effect.iloc[0]) / (curve.x.iloc[-1] - curve.x.iloc[0])
    assert abs(slope - 0.002) < 0.0003
    change = gam.effect_change(gam.effect_curves(fits)).first()["change"]
    assert change == pytest.approx(curve.effect[curve.x > 0].mean() - curve.effect[curve.x < 0].mean())
    got = gam.score_all(df, fits).toPandas().prediction.to_numpy()
    assert np.allclose(np.sort(got), np.sort(_plain_design(df.toPandas(), f) @ np.array(f["beta"])), atol=1e-6)


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_gam_fit_is_that_of_the_dense_normal_equations(spark, offset):
    """Coefficients, edof and the band of every term, also for a target far
    from zero."""
    df = _frame(spark, 150).withColumn("y", F.col("y") + offset)
    f = _fit(spark, df).first()
    pdf = df.toPandas()
    x = _plain_design(pdf, f)
    p = x.shape[1]
    pen = gam.RIDGE * np.eye(p)
    for k in range(len(MODEL_FEATURES)):
        own = slice(1 + 20 * k, 21 + 20 * k)
        d = np.diff(np.eye(20), 2, axis=0)
        sums = x[:, own].sum(0)
        pen[own, own] += gam.LAM * d.T @ d + np.outer(sums, sums) / len(x)
    inv = np.linalg.inv(x.T @ x + pen)
    y = pdf.y - pdf.y.mean()
    beta = inv @ x.T @ y
    res = y - x @ beta
    edof = np.trace(inv @ x.T @ x)
    cov = res @ res / (len(y) - edof) * inv @ x.T @ x @ inv
    tol = 1e-6 if not offset else 1e-4
    assert f["edof"] == pytest.approx(edof, rel=1e-6)
    assert np.allclose(f["beta"][1:], beta[1:], atol=tol) and f["beta"][0] == pytest.approx(beta[0] + pdf.y.mean())
    for k in range(len(MODEL_FEATURES)):
        own = slice(1 + 20 * k, 21 + 20 * k)
        assert np.allclose(f["cov"][k], cov[own, own], atol=tol)
        assert abs((x[:, own] @ np.array(f["beta"])[own]).mean()) < 1e-4  # terms have mean zero


def test_spline_columns_are_the_numpy_basis(spark):
    from cinderwell.functions.splines import basis_np, place, spline_value, spline_variance
    rng = np.random.default_rng(0)
    xs, coefs, m = [-9.0, 0.0, 0.1, 1.5, 2.9999, 3.0, 7.0], rng.normal(size=23), rng.normal(size=(20, 20))
    df = spark.createDataFrame([(i, x, coefs.tolist(), m.tolist()) for i, x in enumerate(xs)], "i int, x double, b array<double>, m array<array<double>>")
    for lo, hi in ((0.0, 3.0), (2.0, 2.0)):
        j, t = place(F.col("x"), F.lit(lo), F.lit(hi), 20)
        got = df.orderBy("i").select(spline_value(F.col("b"), 3, j, t).alias("v"), spline_variance(F.col("m"), j, t).alias("q")).collect()
        b = basis_np(np.array(xs), lo, hi, 20)
        assert np.allclose([r["v"] for r in got], b @ coefs[3:]) and np.allclose([r["q"] for r in got], np.einsum("ij,jk,ik->i", b, m, b))


def test_scoring_and_curves_need_no_python_worker(spark):
    df = _frame(spark, 200)
    fits = _fit(spark, df)
    for out in (gam.score_all(df, fits), gam.effect_curves(fits)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInPandas" not in plan and "Arrow" not in plan


def test_gam_with_a_feature_that_does_not_vary(spark):
    df = _frame(spark, 200).withColumn("Region", F.lit(4))
    f = _fit(spark, df).first()
    assert f["status"] == "ok" and f["explained_deviance"] > 0.9


def test_gam_lists_analytes_without_a_fit(spark):
    df = _frame(spark, 200).withColumn("z", F.when(F.substring("StationCode", 2, 9).cast("int") < 50, F.col("y"))).withColumn("none", F.lit(None).cast("double"))
    res, curves, _ = gam.gam_results(df, ["y", "z", "none"])
    got = {r["Analyte"]: (r["n"], r["status"], r["r2"] is None) for r in res.collect()}
    assert got == {"y": (200, "ok", False), "z": (50, "fewer than 100 complete rows", True), "none": (0, "fewer than 100 complete rows", True)}
    assert {r["Analyte"] for r in curves.select("Analyte").distinct().collect()} == {"y"}


def test_rf_importances_sum_to_one(spark):
    df = _frame(spark, 300).withColumn("SampleDate", F.lit("2020-01-01").cast("date")).withColumn("index_right", F.lit(1))
    res, imp = ml.rf_regression(df, ["y"], num_trees=5, max_depth=4)
    assert res.count() == 1
    assert abs(imp.agg(F.sum("importance")).first()[0] - 1.0) < 1e-9


def test_mixed_effects_matches_dense_reml(spark):
    """Grid REML on sufficient statistics vs a dense brute-force REML."""
    import numpy as np
    from cinderwell.operators.mixed import mixed_effects
    rnd = random.Random(5)
    rows, groups = [], []
    for g in range(12):
        u = rnd.gauss(0, 1.0)
        for i in range(rnd.randint(3, 9)):
            x = rnd.randint(0, 1)
            rows.append((f"g{g}", x, 1.0 + 0.7 * x + u + rnd.gauss(0, 0.5)))
            groups.append(g)
    df = spark.createDataFrame(rows, "StationCode string, post_fire int, y double")
    got = mixed_effects(df, ["y"]).first()
    y = np.array([r[2] for r in rows])
    X = np.array([[1.0, r[1]] for r in rows])
    G = np.array(groups)

    def reml(gam):
        V = np.eye(len(y)) + gam * (G[:, None] == G[None, :])
        Vi = np.linalg.inv(V)
        A = X.T @ Vi @ X
        beta = np.linalg.solve(A, X.T @ Vi @ y)
        r = y - X @ beta
        n, p = len(y), 2
        s2 = r @ Vi @ r / (n - p)
        ll = -0.5 * ((n - p) * np.log(s2) + np.linalg.slogdet(V)[1] + np.linalg.slogdet(A)[1] + (n - p))
        return ll, beta
    gams = np.logspace(-4, 3, 3000)
    best = max(gams, key=lambda g: reml(g)[0])
    assert abs(got["Coefficient"] - round(reml(best)[1][1], 4)) <= 2e-4
    assert got["n_readings"] == len(rows) and got["n_stations"] == 12


def test_mixed_effects_lists_targets_without_a_fit(spark):
    from cinderwell.operators.mixed import mixed_effects
    rows = [(f"g{i % 4}", i % 2, float(i * i % 7), 3.0, None) for i in range(40)]
    df = spark.createDataFrame(rows, "StationCode string, post_fire int, y double, flat double, none double")
    got = {r["Analyte"]: r for r in mixed_effects(df, ["y", "flat", "none"]).collect()}
    assert got["y"]["status"] == "ok" and got["y"]["n_readings"] == 40
    assert got["flat"]["status"].startswith("not fitted") and (got["flat"]["n_readings"], got["flat"]["n_stations"]) == (40, 4)
    assert got["none"]["Coefficient"] is None and got["none"]["n_readings"] == 0


def test_failing_forest_raises(spark, monkeypatch):
    """A lost executor or a bug must not look like a table with an analyte less."""
    df = _frame(spark, 300).withColumn("SampleDate", F.lit("2020-01-01").cast("date")) \
                           .withColumn("index_right", F.lit(1)).withColumn("z", F.col("y") * 2)
    real = ml.r2_score

    def flaky(d, label, *a, **k):
        if label == "z":
            raise RuntimeError("boom")
        return real(d, label, *a, **k)
    monkeypatch.setattr(ml, "r2_score", flaky)
    with pytest.raises(RuntimeError):
        ml.rf_regression(df, ["y", "z"], num_trees=3, max_depth=3)
    alone = ml.rf_regression(df, ["y"], num_trees=3, max_depth=3)[0].first()
    res, imp = ml.rf_regression(df, ["y", "z"], num_trees=3, max_depth=3, isolate=True)
    got = {r["Analyte"]: r for r in res.collect()}
    assert got["y"] == alone and (got["z"]["r2"], got["z"]["status"]) == (None, "failed: RuntimeError")
    assert {r["Analyte"] for r in imp.collect()} == {"y"}
    with pytest.raises(RuntimeError):
        ml.rf_regression(df, ["z"], num_trees=3, max_depth=3, isolate=True)


def test_small_analyte_is_listed_with_its_status(spark):
    df = _frame(spark, 300).withColumn("SampleDate", F.lit("2020-01-01").cast("date")).withColumn("index_right", F.lit(1)) \
        .withColumn("z", F.when(F.substring("StationCode", 2, 9).cast("int") < 99, F.col("y")))
    res, imp = ml.rf_regression(df, ["y", "z"], num_trees=3, max_depth=3)
    got = {r["Analyte"]: r for r in res.collect()}
    assert got["y"]["status"] == "ok" and got["y"]["n"] == 300
    assert got["z"]["n"] == 99 and got["z"]["r2"] is None and got["z"]["status"] == "fewer than 100 complete rows"
    assert {r["Analyte"] for r in imp.collect()} == {"y"}


def test_large_forests_are_fitted_one_after_another(spark, monkeypatch):
    """Each fit keeps its rows in several forms, so as many run side by side as
    fit together; the results do not depend on it."""
    df = _frame(spark, 300).withColumn("SampleDate", F.lit("2020-01-01").cast("date")) \
                           .withColumn("index_right", F.lit(1)).withColumn("z", F.col("y") * 2)
    asked, pool = [], ml.ThreadPoolExecutor
    monkeypatch.setattr(ml, "ThreadPoolExecutor", lambda max_workers: asked.append(max_workers) or pool(max_workers))
    got = []
    for most in (10_000, 500, 300, 10):
        monkeypatch.setattr(ml, "ROWS_AT_ONCE", most)
        got.append([sorted(map(tuple, x.collect())) for x in ml.rf_regression(df, ["y", "z"], num_trees=3, max_depth=3)])
    assert asked == [2, 1, 1, 1]
    assert all(x == got[0] for x in got)
