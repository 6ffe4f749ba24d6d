"""From a network and surfaces to monthly edge weights, costs and hub-to-hub costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.operators import costs, graph, raster


def sampled_stats(edges: DataFrame, surfaces: DataFrame, x0: float, y0: float) -> DataFrame:
    """(edge_id, month, avg_friction, nodata_frac) of edges (edge_id, type, line) on surfaces (mode, month, row, col, value).

    Lines are sampled once, whatever the month; a surface whose month is null holds for all months.
    """
    kind = F.create_map(*[F.lit(v) for kv in costs.SURFACE.items() for v in kv])
    rows = edges.where(F.col("type").isin(*costs.SURFACE)).withColumn("mode", kind[F.col("type")])
    points = raster.line_samples(rows, "edge_id").join(rows.select("edge_id", "mode"), "edge_id")
    row, col = raster.cell_of(F.col("x"), F.col("y"), x0, y0)
    at = points.select("edge_id", "mode", row.alias("row"), col.alias("col"), "length")
    months = F.explode(F.when(F.col("month").isNull(), F.sequence(F.lit(1), F.lit(12))).otherwise(F.array(F.col("month").cast("int"))))
    cells = surfaces.withColumn("month", months).where((F.col("value") != raster.NODATA) & ~F.isnan("value"))
    hit = at.join(cells, ["mode", "row", "col"]).groupBy("edge_id", "month").agg(F.sum("length").alias("valid"), F.sum(F.col("length") * F.col("value")).alias("weighted"))
    total = points.groupBy("edge_id").agg(F.sum("length").alias("total"))
    all_ = costs.edge_months(total).join(hit, ["edge_id", "month"], "left")
    return all_.select("edge_id", "month", (F.col("weighted") / F.col("valid")).alias("avg_friction"), (1 - F.coalesce("valid", F.lit(0.0)) / F.col("total")).alias("nodata_frac"))


def weights_and_costs(edges: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two monthly tables of edges (edge_id, type, length_m). An unknown type is an error."""
    unknown = [r.type for r in costs.unknown_types(edges).take(5)]
    if unknown:
        raise ValueError(f"unknown edge types: {', '.join(unknown)}")
    weights = costs.edge_month_weights(edges, stats)
    return weights, costs.edge_costs(weights, edges)


def month_view(edges: DataFrame, edge_costs: DataFrame, month: int) -> DataFrame:
    """The edges that are passable in a month, with their cost; parallel ones all stay."""
    return edges.join(edge_costs.where((F.col("month") == month) & F.col("passable")).select("edge_id", "cost_per_gallon"), "edge_id")


def month_pairs(edges: DataFrame, edge_costs: DataFrame, month: int) -> DataFrame:
    """(u, v, cost): the cheapest passable edge of each pair of nodes in a month."""
    rows = edge_costs.where(F.col("month") == month).join(edges.select("edge_id", F.col("from_node").alias("a"), F.col("to_node").alias("b")), "edge_id")
    return graph.cheapest_parallel(rows, "cost_per_gallon")


def hub_costs(nodes: DataFrame, edges: DataFrame, edge_costs: DataFrame, month: int) -> DataFrame:
    """(src, dst, cost): cheapest costs between all hubs in a month; pairs without a way are absent."""
    at = nodes.where("is_hub").select(F.col("node_id").alias("node"))
    return graph.shortest_costs(month_pairs(edges, edge_costs, month), at, at)


def validation(weights: DataFrame) -> dict[str, DataFrame]:
    """The reports on the weights: passable shares of barges and ice roads by month, and of all modes."""
    return {
        "barge_by_month": costs.passable_share(weights.where("mode = 'Barge'"), "month").orderBy("month"),
        "ice_road_by_month": costs.passable_share(weights.where("mode = 'IceRoad'"), "month").orderBy("month"),
        "by_mode": costs.passable_share(weights, "mode").orderBy("mode"),
    }
