"""Further operators over the generic tables, each with its SQL. Importing this module completes QUERIES and ORACLE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions import scalars as S
from spanwise.operators import costs, graph, hubs, inventory, raster
from spanwise.plans import domain as D
from spanwise.plans.queries import _WEIGHTS as WEIGHTS
from spanwise.plans.queries import ORACLE_SQL, QUERIES, query
from spanwise.sources import readers, writers


@query(
    """WITH k AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'override' WHEN 1 THEN n_name WHEN 2 THEN r_name ELSE 'nowhere' END AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT s_suppkey, CASE WHEN key = 'override' THEN -1 ELSE coalesce(n_nationkey, r_regionkey + 100) END AS found, CASE WHEN key = 'override' THEN 1 WHEN n_nationkey IS NOT NULL THEN 2 WHEN r_regionkey IS NOT NULL THEN 3 END AS tier
  FROM k LEFT JOIN nation ON n_name = key LEFT JOIN region ON r_name = key"""
)
def tiered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    n, r = D.table(spark, sf, "nation"), D.table(spark, sf, "region")
    s = D.table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey") % 4
    s = s.select("s_suppkey", F.when(k == 0, "override").when(k == 1, F.col("n_name")).when(k == 2, F.col("r_name")).otherwise("nowhere").alias("key"))
    tiers = [spark.createDataFrame([("override", -1)], "name string, value int"), n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("value")), r.select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 100).alias("value"))]
    return readers.lookup_tiers(s, F.col("key"), tiers).select("s_suppkey", "found", "tier")


_LEGS = """leg AS (SELECT s_suppkey, 'N' || CAST(s_nationkey AS VARCHAR) AS o, 'N' || CAST((s_nationkey + s_suppkey) % 30 AS VARCHAR) AS d FROM supplier)"""


def _legs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    code = lambda c: F.concat(F.lit(" n"), c.cast("string"))
    s = D.table(spark, sf, "supplier").select("s_suppkey", code(F.col("s_nationkey")).alias("origin"), code((F.col("s_nationkey") + F.col("s_suppkey")) % 30).alias("destination"))
    places = D.table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("N"), "n_nationkey")).alias("faa"), F.concat(F.lit("N"), "n_nationkey").alias("icao"), F.col("n_nationkey").cast("double").alias("x"), (F.col("n_nationkey") * 2.0).alias("y"))
    return readers.flights(s, ["faa", "icao"], places)


@query(f"WITH {_LEGS} SELECT s_suppkey, a.n_nationkey * 1.0::DOUBLE AS origin_x, b.n_nationkey * 2.0::DOUBLE AS destination_y FROM leg JOIN nation a ON o = 'N' || CAST(a.n_nationkey AS VARCHAR) JOIN nation b ON d = 'N' || CAST(b.n_nationkey AS VARCHAR)")
def od_geocode(spark: SparkSession, sf: str) -> DataFrame:
    return _legs(spark, sf)[0].select("s_suppkey", "origin_x", "destination_y")


@query(f"WITH {_LEGS} SELECT DISTINCT c AS code FROM (SELECT o AS c FROM leg UNION SELECT d FROM leg) WHERE c NOT IN (SELECT 'N' || CAST(n_nationkey AS VARCHAR) FROM nation)")
def od_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return _legs(spark, sf)[1]


@query("SELECT s_suppkey AS edge_id, 12 AS months, round(s_acctbal * 3, 4) AS march FROM supplier")
def month_cost_map(spark: SparkSession, sf: str) -> DataFrame:
    s = costs.edge_months(D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("edge_id"), "s_acctbal"))
    m = graph.month_map(s.select("edge_id", "month", (F.col("s_acctbal") * F.col("month")).alias("cost_per_gallon"), F.lit(True).alias("passable")))
    return m.select("edge_id", F.size("months").alias("months"), F.round(F.col("months")[3]["cost"], 4).alias("march"))


@query(
    f"""WITH {D.CELLS}, t AS (SELECT s_suppkey AS id, (s_suppkey % 7) + 0.25::DOUBLE AS r, (s_suppkey % 13) + 0.5::DOUBLE AS c FROM supplier)
  SELECT id, round((SELECT sum(slope * CASE WHEN cell.row = floor(r) THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END * 0.5::DOUBLE) FROM cell WHERE cell.row BETWEEN floor(r) AND floor(r) + 1 AND cell.col BETWEEN floor(c) AND floor(c) + 1 HAVING count(*) = 4), 6) AS value FROM t"""
)
def bilinear_resample(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = D.table(spark, sf, "supplier").select(k.alias("id"), ((k % 7) + 0.25).alias("r"), ((k % 13) + 0.5).alias("c"))
    cells = D.cells(spark, sf).select("row", "col", F.col("slope").alias("value"))
    return raster.bilinear(t, cells).withColumn("value", F.round("value", 6))


@query(f"WITH {D.CELLS} SELECT a.row, a.col, coalesce(b.slope, 0.0::DOUBLE) AS value FROM cell a LEFT JOIN cell b ON b.row + 1 = a.row AND b.col + 2 = a.col")
def grid_padding(spark: SparkSession, sf: str) -> DataFrame:
    c = D.cells(spark, sf)
    return raster.padded(c.select("row", "col", F.col("slope").alias("value")), c, 1, 2, 0.0)


@query(f"WITH {D.CELLS}, o AS (SELECT row, col FROM cell WHERE lulc = 0 AND slope > 30) SELECT row, col FROM cell c WHERE lulc = 3 AND row % 5 <> 0 AND EXISTS (SELECT 1 FROM o WHERE abs(o.row - c.row) <= 2 AND abs(o.col - c.col) <= 2)")
def leak_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = D.cells(spark, sf)
    return raster.leaks(c.where("lulc = 3"), c.where("row % 5 = 0").select("row", "col"), c.where("lulc = 0 and slope > 30"), 2)


@query(
    """WITH e AS (SELECT s_suppkey AS edge_id, s_suppkey * 10 AS a, s_suppkey * 10 + 1 AS b, 100.0::DOUBLE AS length FROM supplier),
  p AS (SELECT edge_id, 0.0::DOUBLE AS pos, a AS node FROM e UNION ALL SELECT edge_id, length, b FROM e UNION ALL SELECT edge_id, CAST(20 + edge_id % 30 AS DOUBLE), a + 2 FROM e WHERE edge_id % 2 = 0 UNION ALL SELECT edge_id, 70.0::DOUBLE, a + 3 FROM e WHERE edge_id % 3 = 0),
  w AS (SELECT edge_id, node AS a, lead(node) OVER o AS b, lead(pos) OVER o - pos AS length, CAST(row_number() OVER o - 1 AS INTEGER) AS seq FROM p WINDOW o AS (PARTITION BY edge_id ORDER BY pos, node)) SELECT * FROM w WHERE b IS NOT NULL"""
)
def edge_split(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    e = D.table(spark, sf, "supplier").select(k.alias("edge_id"), (k * 10).alias("a"), (k * 10 + 1).alias("b"), F.lit(100.0).alias("length"))
    cuts = e.where("edge_id % 2 = 0").select("edge_id", (20 + F.col("edge_id") % 30).cast("double").alias("at"), (F.col("a") + 2).alias("node"))
    cuts = cuts.unionByName(e.where("edge_id % 3 = 0").select("edge_id", F.lit(70.0).alias("at"), (F.col("a") + 3).alias("node")))
    return graph.split_edges(e, cuts)


_AUDITED = D.EDGES.replace("l_suppkey AS a, l_partkey + 1000000 AS b", "-(l_orderkey * 8 + l_linenumber) AS a, l_orderkey AS b")


@query(f"WITH {_AUDITED}, m AS (SELECT node, list(DISTINCT k) AS ks FROM (SELECT a AS node, CASE type WHEN 'Waterway' THEN 'Barge' ELSE type END AS k FROM edge WHERE type <> 'BargeRoadTransfer' UNION SELECT b, CASE type WHEN 'Waterway' THEN 'Barge' ELSE type END FROM edge WHERE type <> 'BargeRoadTransfer') GROUP BY node), j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_filter(['Barge', 'Road'], lambda t: NOT list_contains(coalesce(x.ks, []), t) AND NOT list_contains(coalesce(y.ks, []), t)) AS missing FROM edge LEFT JOIN m x ON x.node = a LEFT JOIN m y ON y.node = b WHERE type = 'BargeRoadTransfer') SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(missing, ';') AS missing FROM j WHERE len(missing) > 0")
def connector_audit(spark: SparkSession, sf: str) -> DataFrame:
    # Each line item has a node of its own at one end, so some connectors miss a mode there and at the other.
    e = D.edges(spark, sf).withColumn("edge_id", F.struct(*D.EDGE_KEY[:4])).withColumn("a", -(F.col("l_orderkey") * 8 + F.col("l_linenumber")))
    e = e.withColumn("b", F.col("l_orderkey"))
    return graph.inconsistent_connectors(e).select("edge_id.*", F.array_join("missing", ";").alias("missing"))


@query(
    """WITH m AS (SELECT c_custkey AS site, c_nationkey AS hub FROM customer WHERE c_nationkey % 3 <> 0)
  SELECT 'Hub_' || CAST(n_nationkey AS VARCHAR) AS hub_id, site AS site_id, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 1000 AS BIGINT) END AS node_id FROM nation LEFT JOIN m ON hub = n_nationkey"""
)
def hub_handoff(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("Hub_"), F.col(c).cast("string")).alias("hub_id")
    n, c = D.table(spark, sf, "nation"), D.table(spark, sf, "customer")
    snaps = n.where("n_nationkey % 2 = 0").select(name("n_nationkey"), (F.col("n_nationkey") + 1000).cast("long").alias("node_id"))
    return hubs.handoff(n.select(name("n_nationkey")), c.where("c_nationkey % 3 <> 0").select(name("c_nationkey"), F.col("c_custkey").alias("site_id")), snaps)


@query("SELECT c_custkey AS record_id, CASE WHEN c_custkey % 4 = 0 THEN 'road' WHEN c_custkey % 4 = 1 THEN 'ice_road' ELSE 'air' END AS mode_slug FROM customer WHERE c_custkey % 4 <> 3")
def manual_connections(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.when(k == 0, " Road").when(k == 1, "Ice Road").when(k == 2, "AIR").otherwise("Mule").alias("Mode"))
    return readers.manual_connections(c)[0].select("record_id", "mode_slug")


@query(
    """SELECT 'c_custkey' AS column, CAST(0 AS BIGINT) AS nulls, count(DISTINCT c_custkey) AS distinct, min(CAST(c_custkey AS VARCHAR)) AS low, max(CAST(c_custkey AS VARCHAR)) AS high FROM customer
  UNION ALL SELECT 'segment', count(*) FILTER (c_custkey % 7 = 0), count(DISTINCT c_mktsegment) FILTER (c_custkey % 7 <> 0), min(c_mktsegment) FILTER (c_custkey % 7 <> 0), max(c_mktsegment) FILTER (c_custkey % 7 <> 0) FROM customer"""
)
def table_description(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("segment"))
    return writers.described(c).drop("type")


@query("SELECT n_nationkey AS community_id, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_custkey % 9 = 0 GROUP BY n_nationkey")
def region_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "customer").where("c_custkey % 9 = 0").select(F.col("c_nationkey").alias("community_id"))
    return inventory.counts_with_zeros(rows, D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("community_id")), "community_id")


@query(
    """WITH n AS (SELECT delivery_method AS m, total_capacity AS v, count(*) AS n FROM facility GROUP BY 1, 2), c AS (
  SELECT m, v, sum(n) OVER p AS a, sum(n * v) OVER p AS s, sum(n * v * v) OVER p AS q, sum(n) OVER w AS ta, sum(n * v) OVER w AS ts, sum(n * v * v) OVER w AS tq FROM n WINDOW p AS (PARTITION BY m ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w AS (PARTITION BY m))
  SELECT m AS delivery_method, arg_min(v, round(q - s * s / a + (tq - q) - (ts - s) * (ts - s) / (ta - a), 6)) AS cut FROM c WHERE a < ta GROUP BY m""".replace("WITH n AS", f"WITH {D.FACILITIES.replace('c_acctbal AS total_capacity', 'floor(c_acctbal) AS total_capacity')}, n AS")
)
def natural_break(spark: SparkSession, sf: str) -> DataFrame:
    f = D.facilities(spark, sf).withColumn("total_capacity", F.floor("total_capacity").cast("double"))
    return hubs.natural_break(f, "delivery_method", "total_capacity")


@query("SELECT c_custkey AS record_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'ok' END AS x, CASE WHEN c_acctbal < 0 THEN 'missing' WHEN c_custkey % 2 = 0 AND abs(c_acctbal - 100) > 1 THEN 'mismatch' ELSE 'ok' END AS capacity_status FROM customer")
def capacity_status(spark: SparkSession, sf: str) -> DataFrame:
    own = F.when(F.col("c_custkey") % 2 == 0, F.lit(50.0))
    none = F.lit(None).cast("double")
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("total_capacity"), own.alias("gasoline_capacity"), own.alias("diesel_capacity"), none.alias("jet_fuel_capacity"), none.alias("other_fuel_capacity"))
    return c.select("record_id", F.when(F.col("total_capacity").isNotNull(), "ok").alias("x"), inventory.capacity_status().alias("capacity_status"))


@query(f"WITH RECURSIVE {D.POINTS}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM pt a JOIN pt b ON abs(a.x - b.x) <= 1200 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1200), r(n, c) AS (SELECT id, id FROM pt UNION SELECT b, c FROM r JOIN e ON a = n) SELECT n AS id, min(c) AS blob FROM r GROUP BY n")
def buffer_blobs(spark: SparkSession, sf: str) -> DataFrame:
    return hubs.blobs(D.points(spark, sf).select("id", "x", "y"), 600.0)


@query(
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'nome' WHEN 1 THEN 'st mary' ELSE 'kaltag point' END AS base, CASE s_suppkey % 2 WHEN 0 THEN 'IceRoadConnector' ELSE 'Road' END AS class, lower('Fuel_Hub_Name') AS snake FROM supplier"""
)
def name_scalars(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, "Nome International Airport").when(k % 3 == 1, "St. Mary Airport Airstrip").otherwise("Kaltag—Point")
    kind = F.when(k % 2 == 0, "Bridge").otherwise("Road")
    return D.table(spark, sf, "supplier").select("s_suppkey", S.base_name(name).alias("base"), graph.edge_class(kind, F.lit("bridge:IceRoad→Road")).alias("class"), S.snake(F.lit("FuelHub Name")).alias("snake"))


__all__ = ["ORACLE_SQL", "QUERIES", "WEIGHTS"]
