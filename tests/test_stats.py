"""Exact quantiles, imputation, scaling, metrics, splits (FIXTURES §3)."""

import math
import random

from cinderwell.operators import ml, stats


def test_median_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    assert stats.exact_quantile(df, "v")[None] == 2.5


def test_exact_quantile_multi_pass(spark):
    rnd = random.Random(1)
    vals = [rnd.choice([rnd.gauss(0, 1), 5.0, -3.0]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for p in (0.1, 0.5, 0.77):
        got = stats.exact_quantile(df, "v", p, buckets=8, max_collect=50)[None]
        s = sorted(vals)
        h = (len(s) - 1) * p
        want = s[math.floor(h)] + (s[math.ceil(h)] - s[math.floor(h)]) * (h - math.floor(h))
        assert got == want


def test_standardize_population_sd(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "a double, c double")
    out = stats.standardize(df, ["a", "c"]).collect()
    assert abs(out[3]["a"] - 1.5 / 1.118033988749895) < 1e-12
    assert all(r["c"] == 0.0 for r in out)


def test_min_non_null_and_impute(spark):
    from cinderwell.operators.events import min_non_null
    df = spark.createDataFrame([(1.0, 2.0, None, None, None, None), (1.0, 2.0, 3.0, None, None, None)],
                               "a double, b double, c double, d double, e double, f double")
    assert min_non_null(df, list("abcdef"), 3).count() == 1


def test_pct_change_and_direction(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 2.0), (0, 1.0), (1, 1.0)], "post_fire int, x double")
    r = stats.class_means(df, ["x"]).first()
    assert r["pct_change"] == 200.0
    zero = spark.createDataFrame([(0, 0.0), (1, 2.0)], "post_fire int, x double")
    assert stats.class_means(zero, ["x"]).first()["pct_change"] is None


def test_weighted_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "label int, prediction int")
    m = stats.weighted_metrics(stats.confusion(df)).first()
    assert abs(m["accuracy"] - 1 / 3) < 1e-12
    assert abs(m["precision"] - (1 / 3) * (1 / 3)) < 1e-12  # class 1 never predicted -> 0


def test_hash_split_exact_size_and_stratified(spark):
    df = spark.createDataFrame([(f"k{i}", i % 3 == 0) for i in range(1000)], "k string, lab boolean")
    s = ml.hash_split(df, ["k"], 0.2)
    assert s.where("is_test").count() == 200
    st = ml.hash_split(df.selectExpr("k", "cast(lab as int) lab"), ["k"], 0.2, label_col="lab")
    for lab, n in [(r["lab"], r["c"]) for r in st.groupBy("lab").count().withColumnRenamed("count", "c").collect()]:
        assert st.where(f"is_test and lab = {lab}").count() == math.ceil(0.2 * n)


def test_exact_size_with_repeated_and_null_keys(spark):
    rows = [(f"k{i // 7}" if i % 5 else None, i) for i in range(98)]
    df = spark.createDataFrame(rows, "k string, i int")
    split = ml.hash_split(df, ["k"], 0.2).collect()
    assert len(split) == 98 and sum(r["is_test"] for r in split) == 20
    again = ml.hash_split(df.repartition(5), ["k"], 0.2).collect()
    assert sorted(map(str, again)) == sorted(map(str, split))
    for n in (1, 20, 97, 500):
        sample = ml.capped_sample(df, ["k"], n)
        assert sample.count() == min(n, 98) and sample.distinct().count() == min(n, 98)


def test_null_key_part_differs_from_missing_part(spark):
    df = spark.createDataFrame([("a", None, "b"), (None, "a", "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(ml.row_key(["x", "y", "z"]).alias("k")).distinct().count() == 3


def test_quantile_with_infinities_and_wide_ranges(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, inf)], "v double")
    assert stats.exact_quantile(df, "v", buckets=4, max_collect=1)[None] == 3.0
    df = spark.createDataFrame([(v,) for v in (-inf, -inf, -1.7e308, 0.5, 1.7e308, inf)], "v double")
    for p, want in ((0.0, -inf), (0.2, -inf), (0.4, -1.7e308), (0.6, 0.5), (0.8, 1.7e308), (1.0, inf)):
        assert stats.exact_quantile(df, "v", p, buckets=3, max_collect=1)[None] == want


def test_r2_far_from_zero(spark):
    df = spark.createDataFrame([(1e9 + i, 1e9 + i + (0.9 if i % 2 else -0.9)) for i in range(10)], "label double, prediction double")
    assert abs(stats.r2_score(df).first()["r2"] - (1 - 8.1 / 82.5)) < 1e-6


def test_class_report_has_the_average_rows(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, prediction int")
    got = {r["cls"]: r for r in stats.class_report(stats.confusion(df)).collect()}
    assert got["accuracy"]["f1"] == 0.75 and got["accuracy"]["support"] == 4
    assert abs(got["macro avg"]["precision"] - (1 + 2 / 3) / 2) < 1e-12
    assert abs(got["weighted avg"]["recall"] - 0.75) < 1e-12


def test_ranks_of_one_bracket_share_its_rows(spark, monkeypatch):
    """63 ranks of two groups: no value is gathered for each rank apart, and
    what all brackets gather together is bounded."""
    rnd = random.Random(3)
    vals = {"a": [rnd.gauss(0, 1) for _ in range(3000)], "b": [float(rnd.randrange(5)) for _ in range(500)], None: [rnd.random() for _ in range(200)]}
    df = spark.createDataFrame([(g, v) for g, vs in vals.items() for v in vs], "_g string, _v double")
    frame, gathered = type(df), []
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: gathered.append((self.columns, out := real(self))) or out)
    ranks = lambda n: sorted({n * k // 64 for k in range(1, 64)})
    got, counts = stats.select_ranks(df.repartition(3), ranks, buckets=16, max_collect=400)
    assert got == {(g, k): sorted(vs)[k] for g, vs in vals.items() for k in ranks(len(vs))}
    assert counts == {g: len(vs) for g, vs in vals.items()}
    assert max(len(out) for columns, out in gathered if "_v" in columns) <= 400
