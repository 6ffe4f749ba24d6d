"""Raster operators on long cell tables (row, col, value); a missing or null value is no data.

Surfaces of one grid stand side by side as columns, so cellwise algebra needs no join; sampling and filling join on cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions import geometry as G
from spanwise.operators import spatial

#: Grid, reclass breaks and factors.
CELL = 150.0
NODATA = -9999.0
SLOPE_BREAKS = (2.0, 8.0)
SLOPE_FACTORS = (1.0, 1.4, 1.75)
LULC_WATER = 0
LULC_FACTORS = {1: 2.00, 2: 1.15, 3: 2.50, 4: 1.10, 5: 1.60, 6: 1.05, 7: 1.10, 8: 5.00}
PERMAFROST_BREAKS = (0.10, 0.50, 0.90)
PERMAFROST_FACTORS = (1.00, 1.15, 1.30, 1.50)
BREAK_SLACK = 1e-4
ICE = 0.15


def slope_factor(slope: Column) -> Column:
    return F.when(slope < SLOPE_BREAKS[0], SLOPE_FACTORS[0]).when(slope < SLOPE_BREAKS[1], SLOPE_FACTORS[1]).when(slope.isNotNull(), SLOPE_FACTORS[2])


def lulc_factor(lulc: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in LULC_FACTORS.items():
        out = F.when(lulc == k, v).otherwise(out)
    return out


def permafrost_factor(p: Column) -> Column:
    out = F.when(p.isNotNull(), PERMAFROST_FACTORS[-1])
    for b, v in reversed(list(zip(PERMAFROST_BREAKS, PERMAFROST_FACTORS, strict=False))):
        out = F.when(p < b - BREAK_SLACK, v).otherwise(out)
    return out


def static_base(slope: Column, lulc: Column) -> Column:
    return slope_factor(slope) * lulc_factor(lulc)


def road_base(slope: Column, permafrost: Column) -> Column:
    """Never without data: holes in the slope count as flat."""
    return F.greatest(F.lit(1.0), F.coalesce(slope_factor(slope), F.lit(1.0))) * F.coalesce(permafrost_factor(permafrost), F.lit(1.0))


def overland(slope: Column, lulc: Column, permafrost: Column) -> Column:
    return F.when(lulc != LULC_WATER, static_base(slope, lulc) * permafrost_factor(permafrost))


def barge(water: Column, waterway: Column, sea_ice: Column, river_ice: Column, river: Column) -> Column:
    """1 on open water or waterways, no data on land and where sea ice, or river ice on rivers, is over the limit."""
    frozen = F.coalesce(sea_ice > ICE, F.lit(False)) | (F.coalesce(river_ice > ICE, F.lit(False)) & F.coalesce(river, F.lit(False)))
    return F.when((F.coalesce(water, F.lit(False)) | F.coalesce(waterway, F.lit(False))) & ~frozen, 1.0)


def cell_of(x: Column, y: Column, x0: float, y0: float, side: float = CELL) -> tuple[Column, Column]:
    """(row, col) of a point on a grid whose upper left corner is (x0, y0)."""
    return F.floor((y0 - y) / side), F.floor((x - x0) / side)


def sample(points: DataFrame, cells: DataFrame, x0: float, y0: float, side: float = CELL) -> DataFrame:
    """``points`` (x, y, ...) with the value of the cell they lie in; null outside and on no data."""
    row, col = cell_of(F.col("x"), F.col("y"), x0, y0, side)
    value = F.when((F.col("value") != NODATA) & ~F.isnan("value"), F.col("value"))
    return points.withColumn("row", row).withColumn("col", col).join(cells.select("row", "col", value.alias("value")), ["row", "col"], "left").drop("row", "col")


def weighted_stats(samples: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """(key, avg_friction, nodata_frac) of samples (key, length, value) for all of ``owners``; without samples null and 1."""
    valid = F.when(F.col("value").isNotNull(), F.col("length"))
    stats = samples.groupBy(key).agg((F.sum(valid * F.col("value")) / F.sum(valid)).alias("avg_friction"), (1 - F.coalesce(F.sum(valid), F.lit(0.0)) / F.sum("length")).alias("nodata_frac"))
    return owners.select(key).join(stats, key, "left").select(key, "avg_friction", F.coalesce("nodata_frac", F.lit(1.0)).alias("nodata_frac"))


def line_samples(lines: DataFrame, key: str, step: float = CELL / 2) -> DataFrame:
    """(key, x, y, length) of the middles of pieces of lines (key, line)."""
    return lines.select(key, F.explode(G.densified(F.col("line"), step)).alias("p")).select(key, "p.x", "p.y", "p.length")


def padded(cells: DataFrame, grid: DataFrame, rows: int, cols: int, fill: float | None) -> DataFrame:
    """Cells moved by whole rows and columns onto ``grid`` (row, col), with ``fill`` where they have nothing."""
    moved = cells.select((F.col("row") + rows).alias("row"), (F.col("col") + cols).alias("col"), "value")
    return grid.select("row", "col").join(moved, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(fill).cast("double")).alias("value"))


def bilinear(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, value) at fractional cell places (id, r, c), from the four cells around; null if one has no data."""
    r0, c0 = F.floor("r"), F.floor("c")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    t = targets.select("id", (F.col("r") - r0).alias("fr"), (F.col("c") - c0).alias("fc"), r0.alias("r0"), c0.alias("c0"), corner.alias("k"))
    w = F.when(F.col("k.i") == 0, 1 - F.col("fr")).otherwise(F.col("fr")) * F.when(F.col("k.j") == 0, 1 - F.col("fc")).otherwise(F.col("fc"))
    t = t.select("id", (F.col("r0") + F.col("k.i")).alias("row"), (F.col("c0") + F.col("k.j")).alias("col"), w.alias("w"))
    got = t.join(cells, ["row", "col"], "left")
    short = F.max((F.col("w") > 0) & F.col("value").isNull())
    return got.groupBy("id").agg(F.when(~short, F.sum(F.coalesce(F.col("w") * F.col("value"), F.lit(0.0)))).alias("value"))


def dilated(cells: DataFrame, radius: int) -> DataFrame:
    """Cells at most ``radius`` rows and columns from one of ``cells``."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    wide = cells.select("row", "col").withColumn("_i", F.explode(steps)).withColumn("row", F.col("row") + F.col("_i")).select("row", "col").distinct()
    return wide.withColumn("_j", F.explode(steps)).select("row", (F.col("col") + F.col("_j")).alias("col")).distinct()


def leaks(blocked: DataFrame, river: DataFrame, open_off: DataFrame, radius: int) -> DataFrame:
    """Blocked cells off rivers that have open water off the network nearby."""
    return blocked.select("row", "col").join(river, ["row", "col"], "left_anti").join(dilated(open_off, radius), ["row", "col"], "left_semi")


def rasterised(lines: DataFrame, buffer: float, x0: float, y0: float, side: float = CELL) -> DataFrame:
    """(row, col) of cells whose square is at most ``buffer`` from a segment (x1, y1, x2, y2).

    Candidates are cells around points along each segment; the distance between square and segment decides.
    """
    reach = int(buffer // side) + 2
    s = lines.withColumn("seg", F.struct("x1", "y1", "x2", "y2"))
    long = G.distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    at = F.explode(F.sequence(F.lit(0), F.ceil(long / side).cast("int")))
    n = F.greatest(F.ceil(long / side), F.lit(1))
    s = s.withColumn("i", at).withColumn("px", F.col("x1") + F.col("i") / n * (F.col("x2") - F.col("x1"))).withColumn("py", F.col("y1") + F.col("i") / n * (F.col("y2") - F.col("y1")))
    row, col = cell_of(F.col("px"), F.col("py"), x0, y0, side)
    near = F.sequence(F.lit(-reach), F.lit(reach))
    c = s.withColumn("_i", F.explode(near)).withColumn("_j", F.explode(near)).select((row + F.col("_i")).alias("row"), (col + F.col("_j")).alias("col"), "seg").distinct()
    left, top = x0 + F.col("col") * side, y0 - F.col("row") * side
    ax, ay, bx, by = (F.col(f"seg.{k}") for k in ("x1", "y1", "x2", "y2"))
    corners = [(left, top), (left + side, top), (left, top - side), (left + side, top - side)]
    to_rect = lambda px, py: F.hypot(F.greatest(left - px, F.lit(0.0), px - left - side), F.greatest(top - side - py, F.lit(0.0), py - top))
    # A segment that crosses the square has an end in it or crosses one of its sides, whose corners then lie on both sides.
    turn = lambda px, py: F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))
    sides = [turn(px, py) for px, py in corners]
    overlap = (F.greatest(ax, bx) >= left) & (F.least(ax, bx) <= left + side) & (F.greatest(ay, by) >= top - side) & (F.least(ay, by) <= top)
    through = overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    d = F.when(through, 0.0).otherwise(F.least(to_rect(ax, ay), to_rect(bx, by), *[G.to_segment(px, py, ax, ay, bx, by) for px, py in corners]))
    return c.where(d <= buffer).select("row", "col").distinct()


def filled(target: DataFrame, known: DataFrame, cap: float, k: int, start: float) -> DataFrame:
    """(id, value, tier): the nearest known value within ``cap`` (tier 2), else the median of the ``k`` nearest (tier 3).

    ``target`` is (id, x, y), ``known`` (id, x, y, v). Values that are known already are tier 1, the caller's.
    """
    near = spatial.nearest_within(target, known, cap).join(known.select(F.col("id").alias("right_id"), "v"), "right_id").select(F.col("left_id").alias("id"), F.col("v").alias("value"), F.lit(2).alias("tier"))
    rest = target.join(near, "id", "left_anti")
    far = spatial.knn_median(spatial.k_nearest(rest, known, k, start), known.select(F.col("id").alias("right_id"), "v"))
    return near.unionByName(far.select(F.col("left_id").alias("id"), "value", F.lit(3).alias("tier")))


def detected_scale(cells: DataFrame) -> Column:
    """Divisor for values that may be percents: 100 if the largest is over 1 (an aggregate)."""
    return F.when(F.max("value") > 1.0, 100.0).otherwise(1.0)


def confusion(pairs: DataFrame) -> DataFrame:
    """(old, new, n, share): how often classes of two grids meet."""
    n = pairs.groupBy("old", "new").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("old").agg(F.sum("n").alias("_t")), "old").select("old", "new", "n", (F.col("n") / F.col("_t")).alias("share"))


def recall(pairs: DataFrame) -> DataFrame:
    """(old, n, recall): per class how many cells it had and the share that kept it."""
    return pairs.groupBy("old").agg(F.count("*").alias("n"), F.avg(F.when(F.col("old") == F.col("new"), 1.0).otherwise(0.0)).alias("recall"))


def disagreements(pairs: DataFrame, n: int) -> DataFrame:
    """(old, new, n): the ``n`` changes of class that most cells have."""
    return pairs.where("old <> new").groupBy("old", "new").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "old", "new").limit(n)


def mode_composite(images: DataFrame) -> DataFrame:
    """(row, col, value): per cell the class that most images (row, col, value) have, ties to the smaller one."""
    n = images.where("value is not null").groupBy("row", "col", "value").agg(F.count("*").alias("n"))
    return n.groupBy("row", "col").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))


def flips(a: DataFrame, b: DataFrame, limit: float = ICE) -> DataFrame:
    """(month, flips, values_a, values_b): cells of both stacks that are over the limit in one alone, and how many different values each has."""
    key = ["row", "col", "month"]
    j = a.select(*key, F.col("value").alias("va")).join(b.select(*key, F.col("value").alias("vb")), key, "full_outer")
    return j.groupBy("month").agg(F.count_if((F.col("va") > limit) != (F.col("vb") > limit)).alias("flips"), F.countDistinct("va").alias("values_a"), F.countDistinct("vb").alias("values_b"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(month, lost, gained, differ, same) of two stacks (row, col, month, value)."""
    key = ["row", "col", "month"]
    j = a.select(*key, F.col("value").alias("va")).join(b.select(*key, F.col("value").alias("vb")), key, "full_outer")
    return j.groupBy("month").agg(
        F.count_if(F.col("va").isNotNull() & F.col("vb").isNull()).alias("lost"), F.count_if(F.col("va").isNull() & F.col("vb").isNotNull()).alias("gained"),
        F.count_if(F.col("va") != F.col("vb")).alias("differ"), F.count_if(F.col("va") == F.col("vb")).alias("same"),
    )


def zonal(points: DataFrame, zones: DataFrame, side: float, x0: float, y0: float) -> DataFrame:
    """(zone, month, median): points (x, y, month, v) averaged in cells, then the median of a zone's cells (row, col, zone)."""
    row, col = cell_of(F.col("x"), F.col("y"), x0, y0, side)
    cells = points.select(row.alias("row"), col.alias("col"), "month", "v").groupBy("row", "col", "month").agg(F.avg("v").alias("v"))
    return cells.join(zones, ["row", "col"]).groupBy("zone", "month").agg(F.median("v").alias("median"))
