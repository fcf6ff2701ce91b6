"""Left spatial join, point strictly within polygon.

Grid-partitioned plan, all DataFrame work:

1. distinct station coordinates (stations repeat over dates: test each once);
2. perimeters -> bounding box -> every grid cell the box touches;
3. equi-join points to cells on (cx, cy), bounding-box residual;
4. exact even-odd test, boundary excluded: candidates meet the edges of their
   perimeter in their own horizontal band, so work follows the edges nearby
   and not the size of the perimeter;
5. the (coordinate -> perimeter) matches are written once and left-joined back
   to the readings.

With ``method="cells"`` steps 2 and 3 use cells of several sizes: a quadtree of
each perimeter, split where an edge passes. A point in a cell that no edge
touches is inside or outside as the cell's centre is, so only points in the
smallest cells along the boundary are tested, and the cells number as the
boundary is long, not as the area is large.

No side is broadcast by hint: the optimizer decides by size in bytes, which it
knows for the written match table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderwell.functions.geometry import bbox, cell_index, cell_range, side, within
from cinderwell.session import written_table


def fire_cells(fires: DataFrame, cell: float, id_col="fire_id", rings_col="rings") -> DataFrame:
    """Every grid cell each perimeter's bounding box touches."""
    bb = bbox(rings_col)
    boxes = fires.select(id_col, *[v.alias(k) for k, v in bb.items()])
    return (boxes.withColumn("cx", F.explode(cell_range("minx", "maxx", cell)))
                 .withColumn("cy", F.explode(cell_range("miny", "maxy", cell))))


def _edges(fires: DataFrame, id_col: str, rings_col: str) -> DataFrame:
    rings = fires.select(id_col, F.explode(rings_col).alias("r"))
    edges = rings.select(id_col, F.explode(F.transform(
        F.when(F.size("r") >= 2, F.sequence(F.lit(0), F.size("r") - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.col("r")[i]["x"].alias("ax"), F.col("r")[i]["y"].alias("ay"),
                           F.col("r")[i + 1]["x"].alias("bx"), F.col("r")[i + 1]["y"].alias("by")))).alias("e"))
    return edges.select(id_col, "e.*")


def fire_edges(fires: DataFrame, band: float, id_col="fire_id", rings_col="rings") -> DataFrame:
    """One row per (perimeter, edge, horizontal band the edge spans)."""
    return _edges(fires, id_col, rings_col).withColumn("band", F.explode(cell_range(F.least("ay", "by"), F.greatest("ay", "by"), band)))


def touched_cells(fires: DataFrame, cell: float, id_col="fire_id", rings_col="rings") -> DataFrame:
    """The grid cells (cx, cy) that some edge of a perimeter passes, and at most
    some that it passes within a millionth of a cell: in each row of cells, those
    between the edge's lowest and highest x in that row."""
    rows = fire_edges(fires, cell, id_col, rings_col)
    ax, ay, bx, by, near = *map(F.col, ("ax", "ay", "bx", "by")), cell * 1e-6

    def x_at(y):
        y = F.greatest(F.least("ay", "by"), F.least(F.greatest("ay", "by"), y))
        return ax + F.try_divide(y - ay, by - ay) * (bx - ax)

    low, high = x_at(F.col("band") * cell - near), x_at((F.col("band") + 1) * cell + near)
    first, last = F.least("ax", "bx"), F.greatest("ax", "bx")
    return rows.select(id_col, F.col("band").alias("cy"), F.explode(cell_range(
        F.greatest(first, F.least(F.coalesce(low, first), F.coalesce(high, first)) - near),
        F.least(last, F.greatest(F.coalesce(low, last), F.coalesce(high, last)) + near), cell)).alias("cx")).distinct()


def quadtree_levels(fires: DataFrame, cell: float, id_col="fire_id", rings_col="rings") -> int:
    """How often the smallest cell must double for the largest perimeter to lie
    in two by two cells."""
    box = bbox(rings_col)
    widest = fires.select(F.greatest(box["maxx"] - box["minx"], box["maxy"] - box["miny"]).alias("w")).agg(F.max("w")).first()[0]
    return max(0, math.ceil(math.log2(widest / cell))) if widest else 0


def fire_quadtree(fires: DataFrame, cell: float, levels: int, id_col="fire_id", rings_col="rings") -> DataFrame:
    """(perimeter, level, cx, cy, inside): cells of ``cell * 2**level`` that lie
    inside the perimeter, and the smallest cells along its edges (inside false).

    A cell with an edge is split; a part without one is uniform, and its centre
    decides. At the last level a perimeter spans two cells a side, so a cell
    without an edge there is outside."""
    touched = written_table(
        touched_cells(fires, cell, id_col, rings_col)
        .select(id_col, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"), "cx", "cy")
        .select(id_col, "level", F.expr("shiftright(cx, level)").alias("cx"), F.expr("shiftright(cy, level)").alias("cy")).distinct(), "touched-cells")
    parts = touched.where("level > 0").select(
        id_col, (F.col("level") - 1).alias("level"), (F.col("cx") * 2).alias("cx"), (F.col("cy") * 2).alias("cy"),
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q")) \
        .select(id_col, "level", (F.col("cx") + F.col("q") % 2).alias("cx"), (F.col("cy") + F.floor(F.col("q") / 2)).alias("cy"))
    size = F.pow(F.lit(2.0), F.col("level")) * cell
    uniform = parts.join(touched, [id_col, "level", "cx", "cy"], "left_anti") \
        .withColumn("_px", (F.col("cx") + 0.5) * size).withColumn("_py", (F.col("cy") + 0.5) * size)
    inside = edge_band_within(uniform, fires, cell, id_col, rings_col, by=("level", "cx", "cy"))
    return inside.withColumn("inside", F.lit(True)).unionByName(touched.where("level = 0").withColumn("inside", F.lit(False)))


def edge_band_within(cand: DataFrame, fires: DataFrame, band: float, id_col="fire_id",
                     rings_col="rings", by=("_px", "_py")) -> DataFrame:
    """Exact strict point-in-polygon for candidate (_px, _py, fire) rows by
    joining each candidate to the edges of its perimeter in its own band and
    summing ray crossings per (point, perimeter): work per candidate is the
    edges near its latitude, not the whole perimeter. ``by`` names the columns
    that tell candidates apart and are returned with the perimeter."""
    edges = fire_edges(fires, band, id_col, rings_col)
    c = cand.withColumn("band", cell_index("_py", band))
    j = c.join(edges, [id_col, "band"])
    px, py = F.col("_px"), F.col("_py")
    ax, ay, bx, by_ = F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")
    j = j.withColumn("_side", side(ax, ay, bx, by_, px, py))
    crosses = ((ay > py) != (by_ > py)) & ((F.col("_side") > 0) == (by_ > ay))
    on_edge = ((F.col("_side") == 0)
               & (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx))
               & (py >= F.least(ay, by_)) & (py <= F.greatest(ay, by_)))
    agg = j.groupBy(*by, id_col).agg(F.sum(crosses.cast("int")).alias("_n"),
                                     F.max(on_edge.cast("int")).alias("_on"))
    return agg.where((F.pmod(F.col("_n"), F.lit(2)) == 1) & (F.col("_on") == 0)).select(*by, id_col)


def point_fire_matches(coords: DataFrame, fires: DataFrame, lon="TargetLongitude",
                       lat="TargetLatitude", cell: float = 0.25, id_col="fire_id",
                       rings_col="rings", method: str = "edges") -> DataFrame:
    """(lon, lat, fire_id) for every distinct coordinate strictly inside a
    perimeter. A point inside k overlapping perimeters yields k rows.

    ``method`` "edges" joins candidates to banded edges; "rings" evaluates the
    parity over whole rings per candidate, for layers of small perimeters;
    "cells" finds candidates by the quadtree, for large perimeters, and tests
    those along the boundary like "edges"."""
    if method not in ("edges", "rings", "cells"):
        raise ValueError(f"unknown method {method!r}")
    pts = (coords.select(F.col(lon).alias("_px"), F.col(lat).alias("_py"))
                 .where(F.col("_px").isNotNull() & F.col("_py").isNotNull()
                        & ~F.isnan("_px") & ~F.isnan("_py"))
                 .distinct()
                 .withColumn("cx", cell_index("_px", cell))
                 .withColumn("cy", cell_index("_py", cell)))
    if method == "cells":
        levels = quadtree_levels(fires, cell, id_col, rings_col)
        at = pts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))) \
                .select("_px", "_py", "level", F.expr("shiftright(cx, level)").alias("cx"), F.expr("shiftright(cy, level)").alias("cy"))
        found = at.join(fire_quadtree(fires, cell, levels, id_col, rings_col), ["level", "cx", "cy"]).select("_px", "_py", id_col, "inside")
        along = edge_band_within(found.where(~F.col("inside")), fires, cell / 4, id_col, rings_col)
        hits = found.where("inside").drop("inside").unionByName(along)
        return hits.select(F.col("_px").alias(lon), F.col("_py").alias(lat), id_col)
    cand = (pts.join(fire_cells(fires, cell, id_col, rings_col), ["cx", "cy"])
               .where((F.col("_px") > F.col("minx")) & (F.col("_px") < F.col("maxx"))
                      & (F.col("_py") > F.col("miny")) & (F.col("_py") < F.col("maxy")))
               .select("_px", "_py", id_col))
    if method == "edges":
        hits = edge_band_within(cand, fires, cell / 4, id_col, rings_col)
    else:
        hits = cand.join(fires.select(id_col, rings_col), id_col).where(within(F.col("_px"), F.col("_py"), F.col(rings_col)))
    return hits.select(F.col("_px").alias(lon), F.col("_py").alias(lat), id_col)


def spatial_join(points: DataFrame, fires: DataFrame, fire_cols=("FIRE_NAME", "ALARM_DATE", "GIS_ACRES"),
                 lon="TargetLongitude", lat="TargetLatitude", cell: float = 0.25,
                 coords: DataFrame | None = None, id_col="fire_id", rings_col="rings",
                 id_alias="index_right", how: str = "left", method: str = "edges") -> DataFrame:
    """Left spatial join of readings to perimeters.

    ``coords`` may be a cheaper frame holding the same coordinates (e.g. the
    station metadata) so the match table is computed without the readings.
    No match -> one row with NULL fire columns; NULL coordinates never match.
    The ids of the perimeters must differ; a repeated id is an error.
    """
    twice = fires.groupBy(id_col).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"perimeter id {twice[0][0]} occurs more than once")
    matches = point_fire_matches(coords if coords is not None else points, fires,
                                 lon, lat, cell, id_col, rings_col, method)
    # the attributes join the few matches, so the readings are joined once
    attrs = fires.select(F.col(id_col).alias(id_alias), *fire_cols)
    m = written_table(matches.select(F.col(lon).alias("_mlon"), F.col(lat).alias("_mlat"),
                                     F.col(id_col).alias(id_alias)).join(attrs, id_alias), "matches")
    cond = (F.col(lon) == F.col("_mlon")) & (F.col(lat) == F.col("_mlat"))
    joined = points.join(m, cond, how).drop("_mlon", "_mlat")
    return joined.select(id_alias, *points.columns, *fire_cols)
