"""Network tables read out of generic star-schema tables, as DataFrames and as the same SQL.

They let every operator run at any scale: suppliers and parts are nodes, line items edges with month, length and friction;
customers are facilities, embeddings points on a plane, parts raster cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.albers import ALASKA, AXIS, E1, E2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EDGE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as edges; the key columns name an edge."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    kind = F.when(F.col("l_returnflag") == "A", "Road").when(F.col("l_returnflag") == "N", "Waterway").otherwise("IceRoad")
    kind = F.when(F.col("l_linenumber") == 7, "BargeRoadTransfer").otherwise(kind)
    return l.select(
        *EDGE_KEY[:4], F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b"), kind.alias("type"), F.month("l_shipdate").alias("month"),
        F.col("l_extendedprice").alias("length_m"), (1 + F.col("l_tax")).alias("friction"), (F.col("l_discount") < 0.08).alias("passable"),
    )


EDGES = """edge AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey AS a, l_partkey + 1000000 AS b,
         CASE WHEN l_linenumber = 7 THEN 'BargeRoadTransfer' WHEN l_returnflag = 'A' THEN 'Road' WHEN l_returnflag = 'N' THEN 'Waterway' ELSE 'IceRoad' END AS type,
         CAST(month(l_shipdate) AS INTEGER) AS month, l_extendedprice AS length_m, 1 + l_tax AS friction, l_discount < 0.08 AS passable
  FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 1e5).alias("x"), (F.col("embedding")[1].cast("double") * 1e5).alias("y"), "label", F.col("embedding")[2].cast("double").alias("v"))


POINTS = """pt AS (
  SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1e5 AS x, CAST(embedding[2] AS DOUBLE) * 1e5 AS y, label, CAST(embedding[3] AS DOUBLE) AS v FROM embeddings)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.expr("p_partkey div 50").alias("row"), (F.col("p_partkey") % 50).alias("col"), F.col("p_size").cast("double").alias("slope"), (F.col("p_partkey") % 9).cast("int").alias("lulc"), ((F.col("p_size") % 11) / 10.0).alias("permafrost"))


CELLS = """cell AS (
  SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, CAST(p_size AS DOUBLE) AS slope, CAST(p_partkey % 9 AS INTEGER) AS lulc, (p_size % 11) / 10.0::DOUBLE AS permafrost FROM part)"""


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("community_name"), F.col("c_nationkey").alias("community_id"), (F.col("c_acctbal") * 10).alias("x"),
        ((F.col("c_custkey") % 97) * 100.0).alias("y"), F.col("c_acctbal").alias("total_capacity"), (F.col("c_custkey") % 60).alias("tank_farm_id"),
        F.when(F.col("c_custkey") % 3 == 0, "Barge or Road").when(F.col("c_custkey") % 3 == 1, "Plane, Barge").alias("delivery_method"),
    )


FACILITIES = """facility AS (
  SELECT c_custkey AS record_id, c_mktsegment AS community_name, c_nationkey AS community_id, c_acctbal * 10 AS x, (c_custkey % 97) * 100.0::DOUBLE AS y,
         c_acctbal AS total_capacity, c_custkey % 60 AS tank_farm_id,
         CASE c_custkey % 3 WHEN 0 THEN 'Barge or Road' WHEN 1 THEN 'Plane, Barge' END AS delivery_method
  FROM customer)"""


def albers(lon: str, lat: str) -> str:
    """SQL of x and y for longitude and latitude, by the formulas of the projection."""
    sin = f"sin(radians({lat}))"
    q = f"({1 - E2!r}::DOUBLE * ({sin} / (1 - {E2!r}::DOUBLE * {sin} * {sin}) - ln((1 - {E1!r}::DOUBLE * {sin}) / (1 + {E1!r}::DOUBLE * {sin})) / {2 * E1!r}::DOUBLE))"
    rho = f"({AXIS!r}::DOUBLE * sqrt({ALASKA.c!r}::DOUBLE - {ALASKA.n!r}::DOUBLE * {q}) / {ALASKA.n!r}::DOUBLE)"
    d = f"({lon} - {ALASKA.lon0!r}::DOUBLE)"
    theta = f"({ALASKA.n!r}::DOUBLE * radians({d} - 360 * round_even({d} / 360, 0)))"
    return f"{rho} * sin({theta}) AS x, {ALASKA.rho0!r}::DOUBLE - {rho} * cos({theta}) AS y"
