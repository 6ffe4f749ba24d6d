"""Edge-month weights and costs: rates per gallon and mile, transfer fees, passability, their checks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars per gallon and mile, fees per gallon, and how edge types map to them.
RATES = {"Road": 0.0007, "Barge": 0.0010, "Plane": 0.025, "IceRoad": 0.010}
METRES_PER_MILE = 1609.344
FEES = {("barge", "overland"): 0.24, ("barge", "ice_road"): 0.011, ("plane", "overland"): 0.025, ("overland", "ice_road"): 0.022}
TRANSFER_MODES = {
    "BargeRoadTransfer": ("barge", "overland"),
    "BargeIceRoadTransfer": ("barge", "ice_road"),
    "IceRoadRoadTransfer": ("overland", "ice_road"),
    "AirRoadTransfer": ("overland", "plane"),
    "BargeAirTransfer": ("barge", "overland"),
}
RATE_MODE = {"Road": "Road", "RoadConnector": "Road", "Waterway": "Barge", "Air": "Plane", "IceRoad": "IceRoad", "IceRoadConnector": "IceRoad", "Join": "Road", "Bridge": "Road", "Transfer": "Transfer"} | {t: "Transfer" for t in TRANSFER_MODES}
#: The surface that an edge type is sampled from; the other types aren't sampled and weigh 1.
SURFACE = {"Road": "road_base", "IceRoad": "road_base", "IceRoadConnector": "road_base", "Join": "road_base", "Waterway": "barge"}
#: Travel on ice takes twice the time, in the first three months only.
ICE_TYPES = ("IceRoad", "IceRoadConnector")
ICE_PENALTY = 2.0
ICE_MONTHS = (1, 2, 3)


def lookup(key: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def fee(pair: Column) -> Column:
    """The fee between two modes, whichever comes first."""
    table = {"|".join(sorted(k)): v for k, v in FEES.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.array_join(F.array_sort(pair), "|"))


def transfer_fee(kind: Column) -> Column:
    table = {t: FEES.get(m) or FEES[m[1], m[0]] for t, m in TRANSFER_MODES.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind)


def unknown_types(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("type").isin(*RATE_MODE)).select("type").distinct()


def edge_months(edges: DataFrame) -> DataFrame:
    """Every edge in every month."""
    return edges.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))


def passable(kind: Column, month: Column, nodata_frac: Column) -> Column:
    """No gaps in the samples, and ice roads in their months only."""
    return (nodata_frac == 0) & (~kind.isin(*ICE_TYPES) | month.isin(*ICE_MONTHS))


def edge_month_weights(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """(edge_id, month, mode, avg_friction, nodata_frac, passable); ``stats`` is per edge and month, unsampled types weigh 1, ice costs its penalty."""
    # The planner takes rows of all months for as many as there are edges, and would broadcast them; so here and below.
    rows = edge_months(edges.select("edge_id", "type")).join(stats.hint("merge"), ["edge_id", "month"], "left")
    plain = ~F.col("type").isin(*SURFACE)
    friction = F.col("avg_friction") * F.when(F.col("type").isin(*ICE_TYPES), ICE_PENALTY).otherwise(1.0)
    gap = F.when(plain, 0.0).otherwise(F.coalesce("nodata_frac", F.lit(1.0)))
    return rows.select(
        "edge_id", F.col("month").cast("tinyint").alias("month"), lookup(F.col("type"), RATE_MODE).alias("mode"), F.when(plain, 1.0).otherwise(friction).alias("avg_friction"),
        gap.alias("nodata_frac"), passable(F.col("type"), F.col("month"), gap).alias("passable"),
    )


def cost(kind: Column, length_m: Column, friction: Column) -> Column:
    """Per gallon: the fee of a transfer, else length in miles by rate and friction; null for a transfer between modes without a fee."""
    return F.coalesce(transfer_fee(kind), length_m / METRES_PER_MILE * lookup(F.coalesce(lookup(kind, RATE_MODE), F.lit("Road")), RATES) * friction)


def edge_costs(weights: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, month, cost_per_gallon, passable)."""
    rows = weights.join(edges.select("edge_id", "type", "length_m").hint("merge"), "edge_id")
    return rows.select("edge_id", "month", cost(F.col("type"), F.col("length_m"), F.col("avg_friction")).alias("cost_per_gallon"), "passable")


def weight_per_mile(weights: DataFrame, costs: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, month, type, mode, avg_friction, passable, cost_per_gallon, miles, weighted_miles): the three tables joined on edge and month."""
    rows = weights.join(costs.select("edge_id", "month", "cost_per_gallon").hint("merge"), ["edge_id", "month"]).join(edges.select("edge_id", "type", "length_m").hint("merge"), "edge_id")
    miles = F.col("length_m") / METRES_PER_MILE
    return rows.select("edge_id", "month", "type", "mode", "avg_friction", "passable", "cost_per_gallon", miles.alias("miles"), (miles * F.col("avg_friction")).alias("weighted_miles"))


def incomplete(costs: DataFrame) -> DataFrame:
    """Passable rows without cost, or at no cost."""
    return costs.where(F.col("passable") & (F.col("cost_per_gallon").isNull() | F.isnan("cost_per_gallon") | (F.col("cost_per_gallon") == 0)))


def by_class(costs: DataFrame, edges: DataFrame, month: int) -> DataFrame:
    """Per type in a month: count, least, median and largest cost, passable share."""
    rows = costs.where(F.col("month") == month).join(edges.select("edge_id", "type"), "edge_id")
    c = F.col("cost_per_gallon")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.median(c).alias("mid"), F.max(c).alias("hi"), F.avg(F.col("passable").cast("int")).alias("open"))


def passable_share(weights: DataFrame, *keys: str) -> DataFrame:
    return weights.groupBy(*keys).agg(F.avg(F.when(F.col("passable"), 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("n"))


def multi_mode_facilities(edges: DataFrame) -> DataFrame:
    """(facility, modes): facilities at either end of edges (src, dst, mode) of more than one mode."""
    ends = edges.select(F.col("src").alias("facility"), "mode").union(edges.select("dst", "mode")).distinct()
    return ends.groupBy("facility").agg(F.array_sort(F.collect_set("mode")).alias("modes")).where(F.size("modes") > 1)


def network_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, passed, detail): keys unique, ends present, lengths positive, ids without gaps."""
    dup = lambda df, k: df.groupBy(k).count().where("count > 1").count()
    ends = edges.select(F.explode(F.array("from_node", "to_node")).alias("node_id")).join(nodes, "node_id", "left_anti").count()
    lo, hi, n = edges.agg(F.min("edge_id"), F.max("edge_id"), F.countDistinct("edge_id")).first()
    rows = [
        ("node_id unique", (d := dup(nodes, "node_id")) == 0, f"{d} repeated"),
        ("edge_id unique", (d := dup(edges, "edge_id")) == 0, f"{d} repeated"),
        ("ends exist", ends == 0, f"{ends} dangling"),
        ("edge_id dense", n == 0 or (lo == 0 and hi == n - 1), f"{lo} to {hi}, {n} ids"),
        ("lengths positive", (d := edges.where("not (length_m > 0)").count()) == 0, f"{d} bad"),
    ]
    return nodes.sparkSession.createDataFrame(rows, "check string, passed boolean, detail string")
