"""Friction stacks as tables (mode, month, row, col, value): the driver that builds them, their checks, and reports over zones and corridors.

A month of 0 stands for surfaces that hold all year. Value tables hold valid cells only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.operators import raster, spatial
from spanwise.sources.scratch import materialise

MONTHS = tuple(range(1, 13))
#: Modes and whether their surface changes with the month; months in which rivers never freeze.
MODES = {"overland": False, "road_base": False, "barge": True}
SUMMER = (7, 8)


@dataclass(frozen=True)
class Inputs:
    """static: (row, col, slope, lulc, permafrost); sea_ice and river_ice: (month, row, col, value), a fraction or percents;
    waterway and river: masks (row, col), every river cell being a waterway cell."""

    static: DataFrame
    sea_ice: DataFrame
    river_ice: DataFrame
    waterway: DataFrame
    river: DataFrame


def rescaled(cells: DataFrame) -> DataFrame:
    """``cells`` (..., value) as fractions between 0 and 1: percents are told by a largest value over 1."""
    scale = cells.agg(raster.detected_scale(cells)).first()[0]
    return cells.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / scale)))


def preflight(inputs: Inputs) -> DataFrame:
    """(check, passed, failures): what must hold before a stack is built; cells off the grid count against a table."""
    grid = inputs.static.select("row", "col")
    off = lambda df: df.select("row", "col").distinct().join(grid, ["row", "col"], "left_anti").count()
    rows = [
        ("river cells are waterway cells", inputs.river.join(inputs.waterway, ["row", "col"], "left_anti").count()),
        ("a cell has one row", grid.groupBy("row", "col").count().where("count > 1").count()),
        ("waterway on the grid", off(inputs.waterway)),
        ("sea ice on the grid", off(inputs.sea_ice)),
        ("river ice on the grid", off(inputs.river_ice)),
        ("there is a waterway", int(inputs.waterway.isEmpty())),
        ("slopes are not negative", inputs.static.where("slope < 0").count()),
        ("land cover is known", inputs.static.where(~F.col("lulc").isin(raster.LULC_WATER, *raster.LULC_FACTORS)).count()),
        ("months are 1 to 12", sum(df.where("month not between 1 and 12").count() for df in (inputs.sea_ice, inputs.river_ice))),
    ]
    return grid.sparkSession.createDataFrame([(n, k == 0, k) for n, k in rows], "check string, passed boolean, failures long")


def filled_river_ice(inputs: Inputs, cap: float, k: int, start: float, months: tuple[int, ...] = MONTHS) -> DataFrame:
    """(month, row, col, value, tier) for every river cell: known (1), the nearest known in ``cap`` metres (2), the median of ``k`` (3).

    Rivers are open in the summer months, whatever is known.
    """
    x, y = (F.col("col") + 0.5) * raster.CELL, -(F.col("row") + 0.5) * raster.CELL
    ice = rescaled(inputs.river_ice).join(inputs.river, ["row", "col"], "left_semi")
    place = lambda df: df.withColumn("id", F.struct("row", "col")).withColumn("x", x).withColumn("y", y)
    out = None
    for m in months:
        if m in SUMMER:
            part = inputs.river.select(F.lit(m).alias("month"), "row", "col", F.lit(0.0).alias("value"), F.lit(1).alias("tier"))
        else:
            known = materialise(place(ice.where(F.col("month") == m)).select("id", "row", "col", "x", "y", F.col("value").alias("v")))
            gaps = place(inputs.river.join(known, ["row", "col"], "left_anti")).select("id", "x", "y")
            rest = raster.filled(gaps, known, cap, k, start).select(F.col("id.row").alias("row"), F.col("id.col").alias("col"), "value", "tier")
            part = known.select("row", "col", F.col("v").alias("value"), F.lit(1).alias("tier")).unionByName(rest).withColumn("month", F.lit(m))
        part = part.select("month", "row", "col", "value", "tier")
        out = part if out is None else out.unionByName(part)
    return out


def stack(inputs: Inputs, modes: tuple[str, ...] = tuple(MODES), months: tuple[int, ...] = MONTHS, cap: float = 25000.0, k: int = 200, start: float = 5000.0) -> DataFrame:
    """(mode, month, row, col, value): static surfaces once, barges per month. Inputs that fail ``preflight`` are an error."""
    failed = [r.check for r in preflight(inputs).where("not passed").collect()]
    if failed:
        raise ValueError(f"inputs of the stack: {'; '.join(failed)}")
    s, parts = inputs.static, []
    permafrost = rescaled(s.select("row", "col", F.col("permafrost").alias("value"))).withColumnRenamed("value", "permafrost")
    s = materialise(s.drop("permafrost").join(permafrost, ["row", "col"], "left"))
    of = {"overland": raster.overland(F.col("slope"), F.col("lulc"), F.col("permafrost")), "road_base": raster.road_base(F.col("slope"), F.col("permafrost"))}
    for mode, value in of.items():
        if mode in modes:
            parts.append(s.select(F.lit(mode).alias("mode"), F.lit(0).alias("month"), "row", "col", value.alias("value")))
    if "barge" in modes:
        flag = lambda df, name: df.select("row", "col", F.lit(True).alias(name))
        water = s.join(flag(inputs.waterway, "way"), ["row", "col"], "left").join(flag(inputs.river, "river"), ["row", "col"], "left").where((F.col("lulc") == raster.LULC_WATER) | F.col("way"))
        water = water.withColumn("month", F.explode(F.array(*[F.lit(m) for m in months])))
        value = lambda df, name: df.select("month", "row", "col", F.col("value").alias(name))
        rows = water.join(value(rescaled(inputs.sea_ice), "sea"), ["month", "row", "col"], "left").join(value(filled_river_ice(inputs, cap, k, start, months), "ice"), ["month", "row", "col"], "left")
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        parts.append(rows.select(F.lit("barge").alias("mode"), "month", "row", "col", raster.barge(F.col("lulc") == raster.LULC_WATER, yes("way"), F.col("sea"), F.col("ice"), yes("river")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("value is not null")


def stack_checks(stack: DataFrame, ports: DataFrame, seasonal: DataFrame, reach: int, months: int = 12) -> DataFrame:
    """(check, passed, failures) of a built stack: all layers there, no value under 1, ports open all months, seasonal ones shut in
    February and open in August, more barge cells in July than in January. A port (port, row, col) is open where a barge cell is within ``reach`` cells."""
    barge = stack.where("mode = 'barge'")
    step = F.sequence(F.lit(-reach), F.lit(reach))
    near = lambda k: F.explode(F.transform(step, lambda d: F.col(k) + d)).alias(k)
    around = lambda p: p.select("port", near("row"), "col").select("port", "row", near("col"))
    open_ = lambda p: barge.join(around(p), ["row", "col"]).select("port", "month").distinct()
    layers = stack.select("mode", "month").distinct().count()
    wanted = stack.where("month = 0").select("mode").distinct().count() + months
    size = {r.month: r["count"] for r in barge.where("month in (1, 7)").groupBy("month").count().collect()}
    always = ports.count() * months - open_(ports).count()
    february = open_(seasonal).where("month = 2").count()
    august = seasonal.count() - open_(seasonal).where("month = 8").count()
    rows = [
        ("all layers", abs(wanted - layers)), ("no value under 1", stack.where("value < 1").count()), ("ports open all months", always),
        ("seasonal ports shut in February", february), ("seasonal ports open in August", august), ("more open water in July", int(size.get(7, 0) <= size.get(1, 0))),
    ]
    return stack.sparkSession.createDataFrame([(n, k == 0, k) for n, k in rows], "check string, passed boolean, failures long")


def river_ice(water: DataFrame, zones: DataFrame, known_from: float, k: int, start: float) -> DataFrame:
    """(month, row, col, p_ice, provenance) of water fractions (month, row, col, water), which repeat, over cells (row, col, zone).

    A cell's ice is 1 less the median of its water, kept within 0 and 1 (provenance 1); else the median of its zone's cells in
    the month (2); else inverse-distance weighted from the ``k`` nearest cells within ``known_from`` metres (3); none beyond.
    """
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.median("water")))
    own = materialise(water.groupBy("month", "row", "col").agg(p.alias("p_ice")))
    zone = own.join(zones, ["row", "col"]).groupBy("month", "zone").agg(F.median("p_ice").alias("z_ice"))
    every = zones.withColumn("month", F.explode(F.array(*[F.lit(m) for m in MONTHS])))
    rows = materialise(every.join(own, ["month", "row", "col"], "left").join(zone, ["month", "zone"], "left"))
    x, y = (F.col("col") + 0.5) * raster.CELL, -(F.col("row") + 0.5) * raster.CELL
    out = rows.where("coalesce(p_ice, z_ice) is not null").select("month", "row", "col", F.coalesce("p_ice", "z_ice").alias("p_ice"), F.when(F.col("p_ice").isNotNull(), 1).otherwise(2).alias("provenance"))
    for m in MONTHS:
        gaps = rows.where((F.col("month") == m) & F.coalesce("p_ice", "z_ice").isNull()).select(F.struct("row", "col").alias("id"), x.alias("x"), y.alias("y"))
        known = out.where((F.col("month") == m) & (F.col("provenance") < 3)).select(F.struct("row", "col").alias("id"), x.alias("x"), y.alias("y"), F.col("p_ice").alias("v"))
        near = spatial.idw(spatial.k_nearest(gaps, known, k, start), known.select(F.col("id").alias("right_id"), "v"), cap=known_from).where("value is not null")
        out = out.unionByName(near.select(F.lit(m).alias("month"), F.col("left_id.row").alias("row"), F.col("left_id.col").alias("col"), F.col("value").alias("p_ice"), F.lit(3).alias("provenance")))
    return out


def slope_degrees(dem: DataFrame, cell: float = raster.CELL) -> DataFrame:
    """(row, col, slope) of heights (row, col, value) by Horn's 3 x 3 differences; cells on the edge of what is known have none."""
    around = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
    far = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in around])).alias("d")
    # Each cell speaks to its eight neighbours; a cell that hears all eight has a slope.
    told = dem.where("value is not null").select("row", "col", "value", far).select((F.col("row") - F.col("d.dr")).alias("row"), (F.col("col") - F.col("d.dc")).alias("col"), "d.dr", "d.dc", "value")
    weight = lambda a, b: F.when(F.col(b) == 0, 2).otherwise(1) * F.col(a)
    sums = told.groupBy("row", "col").agg(F.sum(weight("dc", "dr") * F.col("value")).alias("gx"), F.sum(weight("dr", "dc") * F.col("value")).alias("gy"), F.count("*").alias("n")).where("n = 8")
    g = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2) / (8 * cell)
    return sums.join(dem.where("value is not null").select("row", "col"), ["row", "col"], "left_semi").select("row", "col", F.degrees(F.atan(g)).alias("slope"))


def zone_cells(cells: DataFrame, polygons: DataFrame, segments: DataFrame, buffer: float, x0: float, y0: float, side: float = 20000.0) -> DataFrame:
    """(row, col, zone, corridor): the largest zone (polygons poly, rings) that holds a cell's centre, and whether it is within ``buffer`` of a line."""
    centre = cells.select(F.struct("row", "col").alias("id"), (F.lit(x0) + (F.col("col") + 0.5) * raster.CELL).alias("x"), (F.lit(y0) - (F.col("row") + 0.5) * raster.CELL).alias("y"))
    held = spatial.in_polygons(centre, polygons, side).groupBy("id").agg(F.max("poly").alias("zone"))
    near = spatial.nearest_line(centre, segments, buffer).select("id", F.lit(True).alias("corridor"))
    rows = centre.select("id").join(held, "id", "left").join(near, "id", "left")
    return rows.select("id.row", "id.col", "zone", F.coalesce("corridor", F.lit(False)).alias("corridor")).where("zone is not null or corridor")


def marine_clipped(polygons: DataFrame, marine: DataFrame, side: float) -> DataFrame:
    """``polygons`` (poly, rings) that no marine segment (x1, y1, x2, y2) touches: none crosses an edge or begins inside."""
    lines = marine.withColumn("_m", F.struct("x1", "y1", "x2", "y2")).distinct()
    starts = lines.select(F.col("_m").alias("id"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    within = spatial.in_polygons(starts, polygons, side).select("poly")
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.least(F.col(a), F.col(b)) / side), F.floor(F.greatest(F.col(a), F.col(b)) / side)))
    m = lines.select(*[F.col(c).alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2")]).withColumn("cx", cells("m_x1", "m_x2")).withColumn("cy", cells("m_y1", "m_y2"))
    e = spatial.polygon_edges(polygons).withColumn("cx", cells("x1", "x2")).withColumn("cy", cells("y1", "y2"))
    turn = lambda ax, ay, bx, by, px, py: (F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax))
    apart = lambda a, b: a * b > 0
    crossing = ~apart(turn("x1", "y1", "x2", "y2", "m_x1", "m_y1"), turn("x1", "y1", "x2", "y2", "m_x2", "m_y2")) & ~apart(turn("m_x1", "m_y1", "m_x2", "m_y2", "x1", "y1"), turn("m_x1", "m_y1", "m_x2", "m_y2", "x2", "y2"))
    boxes = (F.least("x1", "x2") <= F.greatest("m_x1", "m_x2")) & (F.least("m_x1", "m_x2") <= F.greatest("x1", "x2")) & (F.least("y1", "y2") <= F.greatest("m_y1", "m_y2")) & (F.least("m_y1", "m_y2") <= F.greatest("y1", "y2"))
    touched = e.join(m, ["cx", "cy"]).where(boxes & crossing).select("poly").unionByName(within).distinct()
    return polygons.join(touched, "poly", "left_anti")


def line_overlap(lines: DataFrame, others: DataFrame, reach: float, step: float = 75.0) -> DataFrame:
    """(id, share, length): of each line (id, line) the share of its length whose pieces' middles are within ``reach`` of a segment of ``others`` (x1, y1, x2, y2)."""
    pieces = materialise(raster.line_samples(lines.select("id", "line"), "id", step).withColumn("_p", F.struct("id", "x", "y")))
    segments = others.select(F.monotonically_increasing_id().alias("line"), F.lit(0).alias("part"), "x1", "y1", "x2", "y2")
    near = spatial.nearest_line(pieces.select(F.col("_p").alias("id"), "x", "y").distinct(), segments, reach).select(F.col("id").alias("_p"), F.lit(1.0).alias("hit"))
    rows = pieces.join(near, "_p", "left")
    return rows.groupBy("id").agg((F.sum(F.col("length") * F.coalesce("hit", F.lit(0.0))) / F.sum("length")).alias("share"), F.sum("length").alias("length"))


def open_share(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, month, share): of the cells (row, col, region) the share that a stack's layer (month, row, col, value) has a value for."""
    size = regions.groupBy("region").agg(F.count("*").alias("_n"))
    n = cells.where("value is not null").join(regions.hint("merge"), ["row", "col"]).groupBy("region", "month").agg(F.count("*").alias("_k"))
    every = size.withColumn("month", F.explode(F.array(*[F.lit(m) for m in MONTHS])))
    return every.join(n, ["region", "month"], "left").select("region", "month", (F.coalesce("_k", F.lit(0)) / F.col("_n")).alias("share"))


def navigability(cells: DataFrame, corridor: DataFrame) -> DataFrame:
    """(row, col, m1 to m12): per corridor cell whether a layer (month, row, col, value) has a value in each month."""
    # A stack of months is more than the planner takes it for, and would be broadcast; so in zones and regions.
    rows = corridor.join(cells.where("value is not null").select("row", "col", "month").hint("merge"), ["row", "col"], "left")
    return rows.groupBy("row", "col").agg(*[F.coalesce(F.max(F.col("month") == m), F.lit(False)).alias(f"m{m}") for m in MONTHS])


def zone_stats(cells: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((zone, month, n, lo, hi, mid) of cells (month, row, col, value) over (row, col, zone), (zone, worst_month, worst) by the largest median)."""
    rows = cells.join(zones.hint("merge"), ["row", "col"]).groupBy("zone", "month").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.median("value").alias("mid"))
    return rows, rows.groupBy("zone").agg(F.min_by("month", F.struct(-F.col("mid"), "month")).alias("worst_month"), F.max("mid").alias("worst"))


def data_window(cells: DataFrame) -> DataFrame:
    """(row0, row1, col0, col1): the rows and columns between which cells have values."""
    return cells.where("value is not null").agg(F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def grid_offset(ax0: float, ay0: float, bx0: float, by0: float, cell: float = raster.CELL, slack: float = 0.01) -> tuple[int, int]:
    """(rows, columns) that cells of a second grid are to be moved by to stand on the first; grids that don't align are an error."""
    dr, dc = (ay0 - by0) / cell, (bx0 - ax0) / cell
    if abs(dr - round(dr)) * cell > slack or abs(dc - round(dc)) * cell > slack:
        raise ValueError(f"the grids are {dr % 1:.4f} rows and {dc % 1:.4f} columns apart")
    return round(dr), round(dc)


def window(cells: DataFrame, row: int, col: int, reach: int) -> DataFrame:
    """Cells at most ``reach`` rows and columns from one; a range filter, which file statistics prune."""
    return cells.where(F.col("row").between(row - reach, row + reach) & F.col("col").between(col - reach, col + reach))


def decimated(cells: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th cell of every ``step``-th row."""
    return cells.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def profile(cells: DataFrame) -> DataFrame:
    """(cells, valid, lo, hi, rows, columns) of one layer."""
    return cells.agg(F.count("*").alias("cells"), F.count("value").alias("valid"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("row").alias("rows"), F.countDistinct("col").alias("columns"))


def selected(candidates: DataFrame, key: str, allowed: list[str], rejected: list[str]) -> DataFrame:
    """``candidates`` whose key is allowed; keys that were never reviewed, or reviewed ones that are gone, are an error."""
    have = {r[0] for r in candidates.select(key).distinct().limit(len(allowed) + len(rejected) + 1).collect()}
    reviewed = set(allowed) | set(rejected)
    if have != reviewed:
        raise ValueError(f"{key}: not reviewed {sorted(have - reviewed)[:5]}, gone {sorted(reviewed - have)[:5]}")
    return candidates.where(F.col(key).isin(*allowed))


def features(df: DataFrame, feature_filter: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` through a filter of the caller's, which must leave the columns as they are."""
    if feature_filter is None:
        return df
    out = df.transform(feature_filter)
    if out.columns != df.columns:
        raise ValueError("a feature filter may drop rows only")
    return out


def shown_limits(values: DataFrame, key: str, value: str, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(key, lo, hi, mid): per key the two percentiles between which a map shows values, and the median."""
    return values.groupBy(key).agg(F.percentile(value, low).alias("lo"), F.percentile(value, high).alias("hi"), F.median(value).alias("mid"))


def centre(rings: Column) -> Column:
    """The middle of a polygon's box: a point for telling where about it is."""
    p = F.flatten(rings)
    mid = lambda k: (F.array_min(F.transform(p, lambda q: q[k])) + F.array_max(F.transform(p, lambda q: q[k]))) / 2
    return F.struct(mid("x").alias("x"), mid("y").alias("y"))


def place_regions(places: DataFrame, regions: DataFrame, key: str, side: float) -> DataFrame:
    """(key, region): per key the region (poly, name, rings) that holds the middle of its first place (poly, key, rings)."""
    mids = places.select(F.struct("poly", key).alias("id"), centre(F.col("rings")).alias("c")).select("id", "c.x", "c.y")
    held = spatial.in_polygons(mids, regions.select("poly", "rings"), side).join(regions.select("poly", "name"), "poly")
    return held.groupBy(F.col(f"id.{key}").alias(key)).agg(F.min_by("name", F.struct("id.poly", "poly")).alias("region"))
