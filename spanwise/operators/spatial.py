"""Spatial joins without a cross product: both sides are dealt into square cells and meet by equality.

A search of radius ``c`` looks in cells of side ``c`` and their eight neighbours. Unbounded searches double the cell side
until every point has what it needs; only points still open are asked again, so each round is smaller. Ties go to the
smaller id. Coordinates must be metres on a plane; rows without coordinates take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions import geometry as G
from spanwise.sources.scratch import materialise


def _cells(df: DataFrame, side: float, ring: int) -> DataFrame:
    """``df`` with its cell (cx, cy), or once for each cell up to ``ring`` away."""
    cell = lambda c: F.floor(F.col(c) / side).cast("bigint")
    df = df.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    if not ring:
        return df
    steps = F.sequence(F.lit(-ring), F.lit(ring))
    df = df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return df.withColumn("cx", F.col("cx") + F.col("_dx")).withColumn("cy", F.col("cy") + F.col("_dy")).drop("_dx", "_dy")


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(left_id, right_id, dist) for all pairs of (id, x, y) rows at most ``radius`` apart."""
    a = _cells(left.select(F.col("id").alias("left_id"), "x", "y").dropna(), radius, 1)
    b = _cells(right.select(F.col("id").alias("right_id"), "x", "y").dropna(), radius, 0).withColumnsRenamed({"x": "rx", "y": "ry"})
    d = G.distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry"))
    return a.join(b, ["cx", "cy"]).select("left_id", "right_id", d.alias("dist")).where(F.col("dist") <= radius)


def nearest_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """(left_id, right_id, dist) of the nearest right row at most ``radius`` away, where there is one."""
    best = F.min(F.struct("dist", "right_id")).alias("b")
    return within(left, right, radius).groupBy("left_id").agg(best).select("left_id", "b.right_id", "b.dist")


def k_nearest(left: DataFrame, right: DataFrame, k: int, start: float, others_only: bool = False) -> DataFrame:
    """(left_id, right_id, dist, rank) of the ``k`` nearest right rows (all, if there are fewer).

    ``start`` is the first cell side: about the distance at which k rows are to be found. ``others_only`` leaves out right rows
    with the id of the left one.
    """
    left, right = materialise(left.select("id", "x", "y").dropna()), materialise(right.select("id", "x", "y").dropna())
    span = right.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if not span.n:
        return within(left, right, start).withColumn("rank", F.lit(0)).where(F.lit(False))
    far = left.agg(*[f(G.distance(F.col("x"), F.col("y"), F.lit(x), F.lit(y))) for f in (F.max,) for x in (span.x0, span.x1) for y in (span.y0, span.y1)]).first()
    reach = max([v or 0.0 for v in far]) + 1.0
    order = Window.partitionBy("left_id").orderBy("dist", "right_id")
    done: list[DataFrame] = []
    side, open_ = start, left
    while True:
        found = within(open_, right, side)
        if others_only:
            found = found.where(F.col("left_id") != F.col("right_id"))
        found = materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if side >= reach:
            done.append(found)
            break
        full = found.where(F.col("rank") == k).select("left_id")
        done.append(found.join(full, "left_id", "left_semi"))
        open_ = materialise(open_.join(full, F.col("id") == F.col("left_id"), "left_anti"))
        if open_.isEmpty():
            break
        side = min(side * 2, reach)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def nearest(left: DataFrame, right: DataFrame, start: float) -> DataFrame:
    return k_nearest(left, right, 1, start).select("left_id", "right_id", "dist")


def idw(near: DataFrame, values: DataFrame, power: float = 2.0, cap: float | None = None) -> DataFrame:
    """(left_id, value): values (right_id, v) of near rows weighted by distance; a row at no distance decides alone."""
    rows = near.join(values, "right_id")
    if cap is not None:
        rows = rows.where(F.col("dist") <= cap)
    w = F.when(F.col("dist") > 0, F.pow("dist", F.lit(-power)))
    exact = F.min_by(F.col("v"), F.when(F.col("dist") == 0, F.col("right_id")))
    at = F.max(F.col("dist") == 0)
    return rows.groupBy("left_id").agg(F.when(at, exact).otherwise(F.sum(w * F.col("v")) / F.sum(w)).alias("value"))


def knn_median(near: DataFrame, values: DataFrame) -> DataFrame:
    return near.join(values, "right_id").groupBy("left_id").agg(F.median("v").alias("value"))


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """(poly, x1, y1, x2, y2) of polygons (poly, rings)."""
    s = F.explode(F.flatten(F.transform("rings", G.segments))).alias("s")
    return polygons.select("poly", s).select("poly", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def boxes(polygons: DataFrame, pad: float = 0.0) -> DataFrame:
    e = polygon_edges(polygons)
    return e.groupBy("poly").agg(
        (F.min(F.least("x1", "x2")) - pad).alias("bx0"), (F.max(F.greatest("x1", "x2")) + pad).alias("bx1"),
        (F.min(F.least("y1", "y2")) - pad).alias("by0"), (F.max(F.greatest("y1", "y2")) + pad).alias("by1"),
    )


def candidates(points: DataFrame, polygons: DataFrame, side: float, pad: float = 0.0) -> DataFrame:
    """Points (id, x, y) with polygons (poly, rings) whose padded box holds them; met by cells of ``side``."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side)))
    b = boxes(polygons, pad).withColumn("cx", cells("bx0", "bx1")).withColumn("cy", cells("by0", "by1"))
    met = _cells(points, side, 0).join(b, ["cx", "cy"]).where(F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1")))
    return met.drop("cx", "cy", "bx0", "bx1", "by0", "by1").join(polygons, "poly")


def in_polygons(points: DataFrame, polygons: DataFrame, side: float) -> DataFrame:
    """(id, poly) for each polygon that holds a point."""
    return candidates(points, polygons, side).where(G.inside(F.col("x"), F.col("y"), F.col("rings"))).select("id", "poly")


def first_polygon(points: DataFrame, polygons: DataFrame, side: float) -> DataFrame:
    """(id, poly): the smallest polygon id that holds each point, null for none."""
    hit = in_polygons(points, polygons, side).groupBy("id").agg(F.min("poly").alias("poly"))
    return points.select("id").join(hit, "id", "left")


def nearest_polygon(points: DataFrame, polygons: DataFrame, cap: float, start: float | None = None) -> DataFrame:
    """(id, poly, dist) of the nearest polygon at most ``cap`` away; 0 inside.

    The reach grows from ``start`` (from the cap itself, if none is given) by doubling, and only points without a polygon are
    asked again, so few points meet the polygons of wide cells.
    """
    d = G.to_polygon(F.col("x"), F.col("y"), F.col("rings"))
    reach, open_, out = min(start or cap, cap), points, None
    while True:
        rows = candidates(open_, polygons, max(reach, 1.0), reach).select("id", "poly", d.alias("dist")).where(F.col("dist") <= reach)
        found = rows.groupBy("id").agg(F.min(F.struct("dist", "poly")).alias("b")).select("id", "b.poly", "b.dist")
        if reach >= cap:
            return found if out is None else out.unionByName(found)
        found = materialise(found)
        out = found if out is None else out.unionByName(found)
        open_ = materialise(open_.join(found.select("id"), "id", "left_anti"))
        reach = min(2 * reach, cap) if not open_.isEmpty() else cap


def nearest_line(points: DataFrame, lines: DataFrame, tol: float) -> DataFrame:
    """(id, line, part, t, dist): the nearest segment of lines (line, part, x1, y1, x2, y2) at most ``tol`` away."""
    cells = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - tol) / tol), F.floor((F.greatest(a, b) + tol) / tol)))
    s = lines.withColumn("cx", cells("x1", "x2")).withColumn("cy", cells("y1", "y2"))
    args = [F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]
    rows = _cells(points, tol, 0).join(s, ["cx", "cy"]).select("id", "line", "part", G.place_on_segment(*args).alias("t"), G.to_segment(*args).alias("dist"))
    best = F.min(F.struct("dist", "line", "part", "t")).alias("b")
    return rows.where(F.col("dist") <= tol).groupBy("id").agg(best).select("id", "b.line", "b.part", "b.t", "b.dist")


def shared_borders(polygons: DataFrame) -> DataFrame:
    """(a, b, border) both ways for polygons that share boundary segments (equal end points, either direction)."""
    e = polygon_edges(polygons)
    flip = (F.col("x1") > F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2")))
    pick = lambda a, b: F.when(flip, F.col(b)).otherwise(F.col(a))
    e = e.select("poly", pick("x1", "x2").alias("ax"), pick("y1", "y2").alias("ay"), pick("x2", "x1").alias("bx"), pick("y2", "y1").alias("by"))
    long = G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    a, b = e.withColumnRenamed("poly", "a"), e.withColumnRenamed("poly", "b")
    return a.join(b, ["ax", "ay", "bx", "by"]).where("a <> b").withColumn("l", long).groupBy("a", "b").agg(F.sum("l").alias("border"))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
