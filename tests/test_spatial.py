"""Strict point-in-polygon and the grid join (FIXTURES §3, T7)."""

from pyspark.sql import functions as F

from cinderwell.functions.geometry import side, within
from cinderwell.operators.events import add_years
from cinderwell.operators.spatial import fire_cells, fire_quadtree, quadtree_levels, spatial_join
from cinderwell.plans.stages import build_joined


def brute_force_join(points, fires):
    """Every point tested against every perimeter."""
    f = fires.select(F.col("fire_id").alias("index_right"), "rings", "FIRE_NAME")
    return points.join(f, within(F.col("TargetLongitude"), F.col("TargetLatitude"), F.col("rings")), "left").drop("rings")


SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
PART2 = [(10.0, 10.0), (11.0, 10.0), (11.0, 11.0), (10.0, 11.0), (10.0, 10.0)]


def rings(*rs):
    return [[{"x": x, "y": y} for x, y in r] for r in rs]


def test_within_boundary_cases(spark):
    poly = rings(SQUARE[0], HOLE, PART2)
    pts = [("interior", 3.0, 3.0, True), ("outside", 5.0, 5.0, False), ("left edge", 0.0, 2.0, False),
           ("bottom edge", 2.5, 0.0, False), ("right edge", 4.0, 3.0, False), ("top edge", 3.0, 4.0, False),
           ("vertex", 0.0, 0.0, False), ("in hole", 1.5, 1.5, False), ("hole edge", 1.0, 1.5, False),
           ("second part", 10.5, 10.5, True), ("null", None, 1.0, False)]
    df = spark.createDataFrame([(n, x, y, poly) for n, x, y, _ in pts],
                               "name string, x double, y double, rings array<array<struct<x:double,y:double>>>")
    got = {r["name"]: r["w"] for r in df.select("name", within("x", "y", "rings").alias("w")).collect()}
    assert got == {n: e for n, _, _, e in pts}


def _fires(spark):
    return spark.createDataFrame(
        [(1, "A", rings(SQUARE[0])), (2, "B", rings([(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0), (2.0, 2.0)]))],
        "fire_id long, FIRE_NAME string, rings array<array<struct<x:double,y:double>>>")


def test_overlap_none_and_null(spark):
    pts = spark.createDataFrame([("both", 3.0, 3.0), ("none", 9.0, 9.0), ("null", None, None)],
                                "name string, TargetLongitude double, TargetLatitude double")
    out = spatial_join(pts, _fires(spark), fire_cols=("FIRE_NAME",), cell=1.0).collect()
    got = sorted((r["name"], r["FIRE_NAME"]) for r in out)
    assert got == [("both", "A"), ("both", "B"), ("none", None), ("null", None)]


def test_grid_equals_brute_force(spark):
    import random
    rnd = random.Random(7)
    pts = spark.createDataFrame([(i, rnd.uniform(-1, 7), rnd.uniform(-1, 7)) for i in range(400)]
                                + [(1000 + i, float(i % 7), float(i // 7)) for i in range(49)],
                                "id long, TargetLongitude double, TargetLatitude double")
    for cell, method in ((0.3, "rings"), (1.0, "rings"), (5.0, "rings"), (0.3, "edges"), (1.0, "edges"), (0.3, "cells"), (1.0, "cells"), (9.0, "cells")):
        a = spatial_join(pts, _fires(spark), fire_cols=("FIRE_NAME",), cell=cell, method=method)
        b = brute_force_join(pts, _fires(spark))
        key = lambda r: (r["id"], r["FIRE_NAME"] or "")
        assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_edge_method_boundary_cases(spark):
    """The edge-band test gives the same strict answers as the ring test:
    edges, vertices, holes and a second part."""
    fires = spark.createDataFrame([(1, "A", rings(SQUARE[0], HOLE, PART2))],
                                  "fire_id long, FIRE_NAME string, rings array<array<struct<x:double,y:double>>>")
    pts = [("interior", 3.0, 3.0), ("outside", 5.0, 5.0), ("left edge", 0.0, 2.0), ("bottom edge", 2.5, 0.0),
           ("vertex", 4.0, 4.0), ("in hole", 1.5, 1.5), ("hole edge", 2.0, 1.5), ("second part", 10.5, 10.5)]
    df = spark.createDataFrame(pts, "name string, TargetLongitude double, TargetLatitude double")
    for method in ("rings", "edges"):
        out = spatial_join(df, fires, fire_cols=("FIRE_NAME",), cell=0.5, method=method).collect()
        assert sorted(r["name"] for r in out if r["FIRE_NAME"]) == ["interior", "second part"], method


def test_repeated_perimeter_id_is_an_error(spark):
    import pytest
    pts = spark.createDataFrame([("a", 3.0, 3.0)], "name string, TargetLongitude double, TargetLatitude double")
    with pytest.raises(ValueError, match="more than once"):
        spatial_join(pts, _fires(spark).union(_fires(spark)), fire_cols=("FIRE_NAME",))


def _exact_within(px, py, ring):
    """Even-odd rule without the boundary, in integers."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        det = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        if det == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
            return False
        odd ^= (ay > py) != (by > py) and (det > 0) == (by > ay)
    return odd


def _slanted(spark):
    """Star-like perimeters with integer corners in millionths, points on, beside
    and away from their edges: (points, fires, pairs that match)."""
    import math
    import random
    rnd = random.Random(5)
    unit, shapes, at = 1_000_000, {}, set()
    for f in range(4):
        cx, cy = -120 * unit + f * 1_500_000, 35 * unit
        ring = []
        for k in range(11):
            r = rnd.randint(300_000, 2_500_000)
            ring.append((cx + int(r * math.cos(2 * math.pi * k / 11)) // 8 * 8, cy + int(r * math.sin(2 * math.pi * k / 11)) // 8 * 8))
        shapes[f] = ring = ring + ring[:1]
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            for k in (0, 1, 3, 4, 7):  # eighths of an edge are whole
                x, y = ax + (bx - ax) // 8 * k, ay + (by - ay) // 8 * k
                at |= {(x + dx, y + dy) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))}
    at |= {(rnd.randint(-123 * unit, -112 * unit), rnd.randint(32 * unit, 38 * unit)) for _ in range(300)}
    pts = sorted(at)
    points = spark.createDataFrame([(i, x / unit, y / unit) for i, (x, y) in enumerate(pts)], "id long, TargetLongitude double, TargetLatitude double")
    fires = spark.createDataFrame([(f, f"F{f}", rings([(x / unit, y / unit) for x, y in r])) for f, r in shapes.items()],
                                  "fire_id long, FIRE_NAME string, rings array<array<struct<x:double,y:double>>>")
    return points, fires, sorted((i, f) for i, p in enumerate(pts) for f, r in shapes.items() if _exact_within(*p, r))


def test_points_on_and_beside_slanted_edges(spark):
    points, fires, want = _slanted(spark)
    for method, cell in (("rings", 0.5), ("edges", 0.5), ("cells", 0.5), ("cells", 0.07)):
        got = spatial_join(points, fires, fire_cols=("FIRE_NAME",), cell=cell, method=method, how="inner")
        assert sorted((r["id"], r["index_right"]) for r in got.collect()) == want, (method, cell)


def test_quadtree_grows_with_the_boundary(spark):
    _, fires, _ = _slanted(spark)
    n = []
    for cell in (0.08, 0.04, 0.02):
        levels = quadtree_levels(fires, cell)
        tree = fire_quadtree(fires, cell, levels).persist()
        n.append(tree.count())
        assert tree.where("inside and level > 2").count() and tree.count() == tree.distinct().count()
    # twice as many cells for half the size, where the grid has four times as many
    assert n[1] < 2.4 * n[0] and n[2] < 2.4 * n[1] and 4 * n[2] < fire_cells(fires, 0.02).count()
    empty = fires.where("fire_id < 0")
    assert quadtree_levels(empty, 0.1) == 0 and fire_quadtree(empty, 0.1, 0).count() == 0


def test_side_is_exact(spark):
    rows = [(0.0, 0.0, 0.3, 0.9, 0.1, 0.3, 0), (0.0, 0.0, 0.3, 0.9, 0.1, 0.300000000001, 1), (0.0, 0.0, 0.3, 0.9, 0.100000000001, 0.3, -1),
            (1e5, 1e5, 3e5, 3e5, 2e5, 2e5, 0), (1e5, 1e5, 3e5, 3e5, 2e5, 3e5, 1), (1.0, 1.0, 1.0, 1.0, 5.0, 5.0, 0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, px double, py double, want int")
    assert df.where(side(*map(F.col, df.columns[:6])) != F.col("want")).count() == 0


def test_fire_years_are_told_of_the_perimeters_not_of_the_readings(spark):
    """The alarm's year in UTC, before and behind midnight; none without a perimeter or an alarm."""
    alarms = ["2019-12-31 23:30:00", "2020-01-01 00:10:00", None]
    fires = spark.createDataFrame([(i, f"F{i}", a, 5.0, rings([(x + 10.0 * i, y) for x, y in SQUARE[0]])) for i, a in enumerate(alarms)],
                                  "fire_id long, FIRE_NAME string, ALARM_DATE string, GIS_ACRES double, rings array<array<struct<x:double,y:double>>>") \
                 .withColumn("ALARM_DATE", F.to_timestamp("ALARM_DATE"))
    master = spark.createDataFrame([(10.0 * i + 1, 1.5) for i in range(4)], "TargetLongitude double, TargetLatitude double") \
                  .withColumn("SampleDate", F.lit("2021-05-01").cast("date"))
    j = build_joined(master, fires)
    assert [(r["FireYear"], r["SampleYear"]) for r in j.orderBy("TargetLongitude").collect()] == [(2019, 2021), (2020, 2021), (None, 2021), (None, 2021)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "convert_timezone" in plan(add_years(fires.withColumn("SampleDate", F.current_date())))
    assert "convert_timezone" not in plan(j)
