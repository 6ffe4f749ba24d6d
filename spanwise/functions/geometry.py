"""Planar geometry on arrays of (x, y) structs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(line: Column) -> Column:
    """Consecutive vertex pairs of a line: array of (a, b)."""
    return F.zip_with(F.slice(line, F.lit(1), F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def length(line: Column) -> Column:
    return F.aggregate(segments(line), F.lit(0.0), lambda s, p: s + distance(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))


def place_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on a segment (0 at a, 1 at b) it comes nearest to a point."""
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    return F.when(long2 == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(long2, F.lit(0.0)))))


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = place_on_segment(px, py, ax, ay, bx, by)
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def crosses(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether the ray from a point towards larger x crosses a segment (even-odd rule)."""
    at = (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax
    return ((ay > py) != (by > py)) & (px < at)


def inside(px: Column, py: Column, rings: Column) -> Column:
    """Even-odd containment in a polygon of rings (arrays of vertices, closed); holes are rings too."""
    hits = lambda ring: F.size(F.filter(segments(ring), lambda s: crosses(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))
    return F.aggregate(rings, F.lit(0), lambda n, ring: n + hits(ring)) % 2 == 1


def to_polygon(px: Column, py: Column, rings: Column) -> Column:
    """Distance from a point to a polygon, 0 inside."""
    edge = lambda ring: F.array_min(F.transform(segments(ring), lambda s: to_segment(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))
    return F.when(inside(px, py, rings), 0.0).otherwise(F.array_min(F.transform(rings, edge)))


def densified(line: Column, step: float) -> Column:
    """(x, y, length) of the middles of pieces at most ``step`` long; every vertex is kept, pieces of no length aren't."""

    def pieces(s: Column) -> Column:
        long = distance(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])
        n = F.ceil(long / step).cast("int")
        at = lambda i, k: s["a"][k] + (i + 0.5) / n * (s["b"][k] - s["a"][k])
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(at(i, "x").alias("x"), at(i, "y").alias("y"), (long / n).alias("length"))))

    return F.flatten(F.filter(F.transform(segments(line), pieces), lambda p: p.isNotNull()))
