"""Trees grown by histograms against trees grown by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cinderwell.operators import trees


def plain_tree(rows, depth, least, node=1, at=0):
    """[(node, depth, n, value, gain, feature, cut)] of (y, w, xs) rows."""
    w, s = sum(r[1] for r in rows), sum(r[1] * r[0] for r in rows)
    best = None
    if at < depth:
        for f in range(len(rows[0][2])):
            for cut in sorted({r[2][f] for r in rows}):
                left = [r for r in rows if r[2][f] <= cut]
                if len(left) < least or len(rows) - len(left) < least:
                    continue
                lw, ls = sum(r[1] for r in left), sum(r[1] * r[0] for r in left)
                gain = round(ls * ls / lw + (s - ls) * (s - ls) / (w - lw) - s * s / w, 6)
                if best is None or gain > best[0]:
                    best = (gain, f, cut)
    if best is None or best[0] <= 0:
        return [(node, at, len(rows), s / w, None, None, None)]
    out = [(node, at, len(rows), s / w, *best)]
    for side in (0, 1):
        part = [r for r in rows if (r[2][best[1]] > best[2]) == side]
        out += plain_tree(part, depth, least, 2 * node + side, at + 1)
    return sorted(out)


def frame(spark, n, seed, classes=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.randrange(12), rng.randrange(5)
        y = float(3 * (a > 6) + b * (a <= 6) + rng.randrange(3))
        rows.append((i, a, b, rng.random(), float(y > 3) if classes else y, y if i % 3 else None))
    return spark.createDataFrame(rows, "id int, a int, b int, c double, y double, z double")


def as_rows(tree, target):
    return [(r["node"], r["depth"], r["n"], r["value"], r["gain"], r["feature"], r["cut"]) for r in tree.where(F.col("target") == target).orderBy("node").collect()]


def same(got, want):
    assert [(g[:3], g[5:]) for g in got] == [(w[:3], w[5:]) for w in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3]) and (g[4] is None) == (w[4] is None) and (g[4] is None or g[4] == pytest.approx(w[4], abs=1e-5))


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_is_that_of_plain_loops(spark, seed):
    df = frame(spark, 160, seed)
    rows = trees.long_rows(df, ["y", "z"], ["a", "b", "c"]).repartition(5)
    tree = trees.grow(rows, 3, 8)
    for t in ("y", "z"):
        mine = [(r["y"], r["w"], r["xs"]) for r in rows.where(F.col("target") == t).collect()]
        same(as_rows(tree, t), plain_tree(mine, 3, 8))


def test_class_weights(spark):
    df = frame(spark, 200, 4, classes=True)
    rows = trees.long_rows(df, ["y"], ["a", "b"], F.when(F.col("y") == 1, 3.0).otherwise(0.5))
    mine = [(r["y"], r["w"], r["xs"]) for r in rows.collect()]
    tree = trees.grow(rows, 3, 5)
    same(as_rows(tree, "y"), plain_tree(mine, 3, 5))
    # the gain is half the weighted Gini decrease
    gini = lambda rs: (lambda w, p: 2 * w * p * (1 - p))(sum(r[1] for r in rs), sum(r[1] for r in rs if r[0] == 1) / sum(r[1] for r in rs))
    _, _, _, _, gain, f, cut = as_rows(tree, "y")[0]
    parts = [[r for r in mine if (r[2][f] > cut) == side] for side in (0, 1)]
    assert gini(mine) - sum(map(gini, parts)) == pytest.approx(2 * gain, abs=1e-5)


def test_predictions_are_leaf_means(spark):
    df = frame(spark, 150, 7)
    rows = trees.long_rows(df, ["y"], ["a", "b", "c"])
    tree = trees.grow(rows, 3, 6)
    got = trees.predict(rows, tree)
    assert got.count() == 150
    for r in got.groupBy("node").agg(F.avg("y").alias("m"), F.min("prediction").alias("lo"), F.max("prediction").alias("hi"), F.count("*").alias("n")).collect():
        leaf = tree.where(F.col("node") == r["node"]).first()
        assert leaf["feature"] is None and leaf["n"] == r["n"] and r["lo"] == r["hi"] == pytest.approx(r["m"])
    assert 0.3 < trees.r2_by_target(got).first()["r2"] <= 1


def test_importances_share_the_gain(spark):
    rows = trees.long_rows(frame(spark, 300, 3), ["y"], ["a", "b", "c"])
    imp = {r["feature"]: r["importance"] for r in trees.importances(trees.grow(rows, 3, 10), ["a", "b", "c"]).collect()}
    assert sum(imp.values()) == pytest.approx(1) and imp["a"] == max(imp.values())


def test_nothing_to_split_on(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 6.0), (1, 9.0)], "a int, y double")
    rows = trees.long_rows(df, ["y"], ["a"])
    tree = trees.grow(rows, 3, 1)
    assert as_rows(tree, "y") == [(1, 0, 3, pytest.approx(20 / 3), None, None, None)]
    assert {r["importance"] for r in trees.importances(tree, ["a"]).collect()} == {0.0}
    assert [r["prediction"] for r in trees.predict(rows, tree).collect()] == [pytest.approx(20 / 3)] * 3
    assert trees.grow(rows.where("y > 99"), 3, 1).count() == 0
    assert trees.predict(rows, trees.grow(rows.where("y > 99"), 3, 1)).count() == 0


def test_ties_go_to_the_first_feature_and_the_smallest_cut(spark):
    rows = spark.createDataFrame([(float(i >= 4), i) for i in range(8)], "y double, a int")
    tied = trees.long_rows(rows.withColumn("b", F.col("a")), ["y"], ["a", "b"])
    assert as_rows(trees.grow(tied, 1, 1), "y")[0][5:] == (0, 3.0)
    flat = spark.createDataFrame([(y, i) for i, y in enumerate([0.0, 1.0, 1.0, 0.0])], "y double, a int")
    assert as_rows(trees.grow(trees.long_rows(flat, ["y"], ["a"]), 1, 1), "y")[0][5:] == (0, 0.0)


def test_bins_of_equal_counts(spark):
    df = spark.createDataFrame([(float(i % 50), None if i == 3 else i * 0.5) for i in range(200)], "a double, b double")
    cuts = trees.quantile_cuts(df, ["a", "b"], 4)
    assert cuts["a"] == [12.0, 25.0, 37.0]
    got = trees.binned(df, cuts).groupBy("a").count().orderBy("a").collect()
    assert [(r["a"], r["count"]) for r in got] == [(12.0, 52), (25.0, 52), (37.0, 48), (float("inf"), 48)]
    assert trees.binned(df, cuts).where("b IS NULL").count() == 1


def test_rows_keep_columns_beside_and_bins_order_odd_values_like_spark(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(-inf, 1), (-0.0, 2), (0.5, 3), (1.0, 4), (2.0, 5), (inf, 6), (nan, 7), (None, 8)], "a double, y int")
    got = {r["y"]: r["a"] for r in trees.binned(df, {"a": [0.0, 1.0]}).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: inf, 6: inf, 7: inf, 8: None}
    got = {r["y"]: r["a"] for r in trees.binned(df, {"a": [-inf, 1.0, inf]}).collect()}
    assert got == {1: -inf, 2: 1.0, 3: 1.0, 4: 1.0, 5: inf, 6: inf, 7: inf, 8: None}
    rows = trees.long_rows(df.withColumn("is_test", df["y"] > 6), ["y"], ["a"], beside=["is_test"])
    tree = trees.grow(rows, 1, 1)
    assert [(r["y"], r["is_test"]) for r in trees.predict(rows, tree).orderBy("y").collect()] == [(float(i), i > 6) for i in range(1, 8)]
    # NaN is the largest value: the row lies right of every cut
    assert {r["y"] for r in trees.predict(rows, tree).where("node = 3").collect()} >= {7.0}
