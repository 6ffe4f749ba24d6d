"""One query per operator over the generic tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions import scalars as S
from spanwise.operators import costs, graph, hubs, inventory, raster, ranking, spatial
from spanwise.plans import domain as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# --- costs -----------------------------------------------------------------------------------------------------------

_COST = """CASE WHEN type = 'BargeRoadTransfer' THEN 0.24::DOUBLE
  ELSE length_m / 1609.344::DOUBLE * CASE type WHEN 'Road' THEN 0.0007::DOUBLE WHEN 'Waterway' THEN 0.001::DOUBLE ELSE 0.01::DOUBLE END * friction END"""


def _costed(spark: SparkSession, sf: str) -> DataFrame:
    e = D.edges(spark, sf)
    return e.withColumn("cost", costs.cost(F.col("type"), F.col("length_m"), F.col("friction")))


@query(f"WITH {D.EDGES} SELECT type, month, count(*) AS n, round(sum({_COST}), 2) AS cost, round(avg(CASE WHEN passable THEN 1.0::DOUBLE ELSE 0 END), 6) AS open FROM edge GROUP BY type, month")
def edge_cost_by_class_month(spark: SparkSession, sf: str) -> DataFrame:
    return _costed(spark, sf).groupBy("type", "month").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 2).alias("cost"), F.round(F.avg(F.when(F.col("passable"), 1.0).otherwise(0.0)), 6).alias("open"))


@query(f"WITH {D.EDGES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, month, round({_COST}, 6) AS cost, passable FROM edge WHERE type <> 'BargeRoadTransfer'")
def edge_cost_linehaul(spark: SparkSession, sf: str) -> DataFrame:
    return _costed(spark, sf).where("type <> 'BargeRoadTransfer'").select(*D.EDGE_KEY[:4], "month", F.round("cost", 6).alias("cost"), "passable")


@query(f"WITH {D.EDGES} SELECT month, count(*) AS n, min({_COST}) AS lo, max({_COST}) AS hi FROM edge WHERE type = 'BargeRoadTransfer' GROUP BY month")
def edge_cost_transfer_fee(spark: SparkSession, sf: str) -> DataFrame:
    return _costed(spark, sf).where("type = 'BargeRoadTransfer'").groupBy("month").agg(F.count("*").alias("n"), F.min("cost").alias("lo"), F.max("cost").alias("hi"))


@query(f"WITH {D.EDGES} SELECT type, count(*) AS n, min(length_m) AS lo, median(length_m) AS mid, max(length_m) AS hi, round(avg(CASE WHEN passable THEN 1.0::DOUBLE ELSE 0 END), 4) AS open FROM edge WHERE month = 7 GROUP BY type")
def july_stats_by_class(spark: SparkSession, sf: str) -> DataFrame:
    # Line items repeat their keys, but never with two types.
    e = D.edges(spark, sf).withColumn("edge_id", F.struct(*D.EDGE_KEY[:4], "type"))
    c = e.select("edge_id", "month", F.col("length_m").alias("cost_per_gallon"), "passable")
    return costs.by_class(c, e.select("edge_id", "type").distinct(), 7).withColumn("open", F.round("open", 4))


@query(f"WITH {D.EDGES} SELECT month, round(avg(CASE WHEN passable THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, count(*) AS n FROM edge WHERE type = 'IceRoad' GROUP BY month")
def passable_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return costs.passable_share(D.edges(spark, sf).where("type = 'IceRoad'"), "month").withColumn("share", F.round("share", 6))


@query(f"WITH {D.EDGES} SELECT type, round(avg(CASE WHEN passable THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, count(*) AS n FROM edge GROUP BY type")
def passable_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    return costs.passable_share(D.edges(spark, sf), "type").withColumn("share", F.round("share", 6))


@query("SELECT s_suppkey AS edge_id, CAST(m AS INTEGER) AS month, (s_suppkey % 4 <> 0 OR m <= 3) AS passable FROM supplier, generate_series(1, 12) AS g(m)")
def edge_month_cross(spark: SparkSession, sf: str) -> DataFrame:
    s = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("edge_id"), F.when(F.col("s_suppkey") % 4 == 0, "IceRoad").otherwise("Road").alias("type"))
    return costs.edge_months(s).select("edge_id", "month", costs.passable(F.col("type"), F.col("month"), F.lit(0.0)).alias("passable"))


#: Edge types, what they are sampled from, their mode and the time that they take (of the line-haul and connector types of a network).
_TYPES = """t(k, type, surface, mode, slow) AS (VALUES (0, 'Road', 'road_base', 'Road', 1), (1, 'IceRoad', 'road_base', 'IceRoad', 2), (2, 'Waterway', 'barge', 'Barge', 1), (3, 'Air', NULL, 'Plane', 1),
  (4, 'RoadConnector', NULL, 'Road', 1), (5, 'IceRoadConnector', 'road_base', 'IceRoad', 2), (6, 'BargeRoadTransfer', NULL, 'Transfer', 1), (7, 'BargeIceRoadTransfer', NULL, 'Transfer', 1),
  (8, 'IceRoadRoadTransfer', NULL, 'Transfer', 1), (9, 'AirRoadTransfer', NULL, 'Transfer', 1), (10, 'BargeAirTransfer', NULL, 'Transfer', 1))"""
_TYPE_NAMES = ("Road", "IceRoad", "Waterway", "Air", "RoadConnector", "IceRoadConnector", "BargeRoadTransfer", "BargeIceRoadTransfer", "IceRoadRoadTransfer", "AirRoadTransfer", "BargeAirTransfer")
_WEIGHTS = f"""{_TYPES}, m AS (SELECT CAST(m AS INTEGER) AS month FROM generate_series(1, 12) AS g(m)),
  e AS (SELECT p_partkey AS edge_id, p_retailprice * 100 AS length_m, t.* FROM part JOIN t ON k = p_partkey % 11),
  s AS (SELECT edge_id, month, CAST(1 + (edge_id + month) % 3 AS DOUBLE) AS f, CASE WHEN (edge_id + month) % 5 = 0 THEN 0.5::DOUBLE ELSE 0 END AS g FROM e, m WHERE (edge_id * month) % 7 <> 0),
  r AS (SELECT edge_id, month, type, mode, slow, length_m, CASE WHEN surface IS NULL THEN 1.0::DOUBLE ELSE f * slow END AS avg_friction, CASE WHEN surface IS NULL THEN 0.0::DOUBLE ELSE coalesce(g, 1.0::DOUBLE) END AS nodata_frac
        FROM e CROSS JOIN m LEFT JOIN s USING (edge_id, month)),
  w AS (SELECT *, nodata_frac = 0 AND (slow = 1 OR month <= 3) AS passable FROM r),
  c AS (SELECT *, CASE type WHEN 'BargeRoadTransfer' THEN 0.24::DOUBLE WHEN 'BargeIceRoadTransfer' THEN 0.011::DOUBLE WHEN 'IceRoadRoadTransfer' THEN 0.022::DOUBLE WHEN 'AirRoadTransfer' THEN 0.025::DOUBLE WHEN 'BargeAirTransfer' THEN 0.24::DOUBLE
    ELSE length_m / 1609.344::DOUBLE * CASE mode WHEN 'Road' THEN 0.0007::DOUBLE WHEN 'Barge' THEN 0.001::DOUBLE WHEN 'Plane' THEN 0.025::DOUBLE ELSE 0.01::DOUBLE END * avg_friction END AS cost FROM w)"""


def _typed_edges(spark: SparkSession, sf: str, table: str = "part", key: str = "p_partkey", length: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a table as edges of all eleven types, and sampled friction for most of their months."""
    k = F.col("edge_id")
    length = F.col("p_retailprice") * 100 if length is None else length
    e = D.table(spark, sf, table).select(F.col(key).alias("edge_id"), length.alias("length_m")).withColumn("type", F.get(F.array(*[F.lit(t) for t in _TYPE_NAMES]), (k % 11).cast("int")))
    stats = costs.edge_months(e.select("edge_id")).where((k * F.col("month")) % 7 != 0)
    return e, stats.select("edge_id", "month", (1 + (k + F.col("month")) % 3).cast("double").alias("avg_friction"), F.when((k + F.col("month")) % 5 == 0, 0.5).otherwise(0.0).alias("nodata_frac"))


@query(f"WITH {_WEIGHTS} SELECT edge_id, CAST(month AS TINYINT) AS month, mode, avg_friction, nodata_frac, passable FROM w")
def edge_month_weights(spark: SparkSession, sf: str) -> DataFrame:
    e, stats = _typed_edges(spark, sf)
    return costs.edge_month_weights(e, stats)


@query(f"WITH {_WEIGHTS} SELECT type, CAST(month AS TINYINT) AS month, count(*) AS n, round(sum(cost), 4) AS cost, round(avg(CASE WHEN passable THEN 1.0::DOUBLE ELSE 0 END), 6) AS open FROM c GROUP BY type, month")
def edge_costs_all_types(spark: SparkSession, sf: str) -> DataFrame:
    e, stats = _typed_edges(spark, sf)
    weights = costs.edge_month_weights(e, stats)
    rows = costs.edge_costs(weights, e).join(e.select("edge_id", "type").hint("merge"), "edge_id")
    return rows.groupBy("type", "month").agg(F.count("*").alias("n"), F.round(F.sum("cost_per_gallon"), 4).alias("cost"), F.round(F.avg(F.when(F.col("passable"), 1.0).otherwise(0.0)), 6).alias("open"))


@query(f"WITH {_WEIGHTS} SELECT type, CAST(month AS TINYINT) AS month, count(*) AS n, round(sum(avg_friction * length_m / 1609.344::DOUBLE), 4) AS weighted_miles FROM w WHERE passable AND avg_friction IS NOT NULL GROUP BY type, month")
def weight_per_mile(spark: SparkSession, sf: str) -> DataFrame:
    e, stats = _typed_edges(spark, sf)
    rows = costs.weight_per_mile(costs.edge_month_weights(e, stats), costs.edge_costs(costs.edge_month_weights(e, stats), e), e)
    return rows.where("passable and avg_friction is not null").groupBy("type", "month").agg(F.count("*").alias("n"), F.round(F.sum("weighted_miles"), 4).alias("weighted_miles"))


@query(f"WITH {_WEIGHTS} SELECT mode, round(avg(CASE WHEN passable THEN 1.0::DOUBLE ELSE 0 END), 6) AS share, count(*) AS n FROM w GROUP BY mode")
def passable_by_rate_mode(spark: SparkSession, sf: str) -> DataFrame:
    return costs.passable_share(costs.edge_month_weights(*_typed_edges(spark, sf)), "mode").withColumn("share", F.round("share", 6))


@query(f"WITH {D.EDGES}, e AS (SELECT a AS f, type FROM edge UNION SELECT b, type FROM edge) SELECT f AS facility, array_to_string(list_sort(list(DISTINCT type)), ';') AS modes FROM e GROUP BY f HAVING count(DISTINCT type) > 1")
def union_distinct_multi_mode(spark: SparkSession, sf: str) -> DataFrame:
    e = D.edges(spark, sf).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("type").alias("mode"))
    return costs.multi_mode_facilities(e).select("facility", F.array_join("modes", ";").alias("modes"))


# --- tables, names, releases -----------------------------------------------------------------------------------------


@query("SELECT min(l_suppkey) AS lo, max(l_suppkey) AS hi, count(DISTINCT l_suppkey) AS ids, count(*) AS n FROM lineitem")
def integrity_minmax_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "lineitem").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"), F.countDistinct("l_suppkey").alias("ids"), F.count("*").alias("n"))


@query("SELECT l_suppkey AS node, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) GROUP BY l_suppkey")
def dangling_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes = D.table(spark, sf, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"))
    return D.table(spark, sf, "lineitem").join(nodes, "l_suppkey", "left_anti").groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT c_custkey) AS orphans FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def orphan_count(spark: SparkSession, sf: str) -> DataFrame:
    c, o = D.table(spark, sf, "customer"), D.table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").agg(F.countDistinct("c_custkey").alias("orphans"))


@query(
    r"""SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper('Saint. ' || p_type || ', mount''s'), '[.''`’,]', '', 'g'),
  '\bSAINT\b', 'ST', 'g'), '\bMOUNT\b', 'MT', 'g'), '\s+', ' ', 'g')), '') AS key FROM part"""
)
def canon_name(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "part").select("p_partkey", S.canon(F.concat(F.lit("Saint. "), "p_type", F.lit(", mount's"))).alias("key"))


@query(f"WITH {D.FACILITIES} SELECT community_id, array_to_string(list_sort(list(DISTINCT community_name)), ';') AS spellings, CAST(count(DISTINCT community_name) AS INTEGER) AS n FROM facility GROUP BY community_id HAVING count(DISTINCT community_name) > 1")
def spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.spellings(D.facilities(spark, sf), "community_id", "community_name")


@query(f"WITH {D.FACILITIES} SELECT record_id, CASE community_name WHEN 'MACHINERY' THEN 'AUTOMOBILE' ELSE community_name END AS community_key, CASE record_id % 3 WHEN 2 THEN NULL ELSE 'true' END AS delivery_barge, CASE record_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN 'true' END AS delivery_plane FROM facility")
def alias_fold(spark: SparkSession, sf: str) -> DataFrame:
    aliases = spark.createDataFrame([("machinery", "automobile")], "variant string, canonical string")
    return inventory.normalised(D.facilities(spark, sf), aliases).select("record_id", "community_key", "delivery_barge", "delivery_plane")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Barge or Road' WHEN 1 THEN 'IceRoad or Plane' WHEN 2 THEN NULL ELSE 'Road' END AS modes FROM orders")
def mode_set_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, "Road or Barge, Road").when(k == 1, "Plane,IceRoad or Mule").when(k == 2, "Mule").otherwise("Road")
    return D.table(spark, sf, "orders").select("o_orderkey", S.mode_text(S.modes_in(raw)).alias("modes"))


@query(f"WITH {D.FACILITIES}, m AS (SELECT community_id, unnest(CASE WHEN delivery_method = 'Barge or Road' THEN ['Barge', 'Road'] WHEN delivery_method IS NULL THEN [] ELSE ['Barge', 'Plane'] END) AS m FROM facility) SELECT community_id, array_to_string(list_sort(list(DISTINCT m)), ' or ') AS modes FROM m GROUP BY community_id")
def mode_set_union(spark: SparkSession, sf: str) -> DataFrame:
    return D.facilities(spark, sf).groupBy("community_id").agg(S.union_modes(F.col("delivery_method")).alias("modes")).where("modes is not null")


@query("SELECT c_custkey, CAST(round_even(c_acctbal, 0) AS BIGINT) AS whole, CASE WHEN c_custkey < 100000 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE CAST(c_custkey AS VARCHAR) END AS zip, (c_custkey % 2 = 0) AS flag, CASE WHEN c_custkey % 5 <> 0 THEN '2024-01-0' || CAST(c_custkey % 5 AS VARCHAR) END AS day, c_mktsegment || ' | a b' AS note FROM customer")
def typed_projection(spark: SparkSession, sf: str) -> DataFrame:
    c, k = D.table(spark, sf, "customer"), F.col("c_custkey")
    raw = c.select(
        k.alias("id"), F.col("c_acctbal").cast("string").alias("w"), k.cast("string").alias("z"), F.when(k % 2 == 0, " yes ").otherwise("N").alias("f"),
        F.when(k % 5 == 0, "x").otherwise(F.concat(F.lit("2024-01-0"), (k % 5).cast("string"))).alias("d"), F.concat("c_mktsegment", F.lit("\r\n a \t b ")).alias("n"), "c_name",
    )
    return inventory.typed_projection(raw, [("id", "c_custkey", "int"), ("w", "whole", "int"), ("z", "zip", "zip"), ("f", "flag", "bool"), ("d", "day", "date"), ("n", "note", "string")]).withColumn("day", F.col("day").cast("string"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'u' || CAST(user_id AS VARCHAR)) AS label FROM events")
def fold_fill(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("label"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("second"))
    return inventory.folded(e, [("label", "second")])


_RELEASES = """a AS (SELECT s_suppkey AS k, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier WHERE s_suppkey % 11 <> 0),
b AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN s_name || ' Jr' ELSE s_name END AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS nation FROM supplier WHERE s_suppkey % 13 <> 0),
d AS (
  SELECT k, 'removed' AS change, NULL AS field, NULL AS old_value, NULL AS new_value FROM a WHERE k NOT IN (SELECT k FROM b)
  UNION ALL SELECT k, 'added', NULL, NULL, NULL FROM b WHERE k NOT IN (SELECT k FROM a)
  UNION ALL SELECT k, 'edited', 'name', a.name, b.name FROM a JOIN b USING (k) WHERE a.name IS DISTINCT FROM b.name
  UNION ALL SELECT k, 'edited', 'nation', a.nation, b.nation FROM a JOIN b USING (k) WHERE a.nation IS DISTINCT FROM b.nation)"""


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    s = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
    new = s.where("k % 13 <> 0").select("k", F.when(F.col("k") % 7 == 0, F.concat("name", F.lit(" Jr"))).otherwise(F.col("name")).alias("name"), F.when(F.col("k") % 5 != 0, F.col("nation")).alias("nation"))
    return inventory.release_diff(s.where("k % 11 <> 0"), new, "k", ["name", "nation"])


@query(f"WITH {_RELEASES} SELECT * FROM d")
def release_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf)


@query(f"WITH {_RELEASES} SELECT change, count(DISTINCT k) AS records, count(*) AS edits FROM d GROUP BY change")
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.diff_summary(_diff(spark, sf), "k")


@query(
    """SELECT c_custkey AS record_id, CASE WHEN c_custkey % 6 = 0 THEN 'moved twice' WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'moved' ELSE c_mktsegment END AS name,
  CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer"""
)
def guarded_update(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("name"), F.col("c_acctbal").alias("balance"))
    k = F.col("record_id")
    row = lambda field, old, new, seq, ok="approved": F.struct(F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value"), F.lit(ok).alias("status"), F.lit(seq).cast("long").alias("seq"))
    first = F.when((k % 3 == 0) & ((k % 4 != 0) | (k % 6 == 0)), row("name", F.col("name"), F.lit("moved"), 1))
    second = F.when(k % 6 == 0, row("name", F.lit("moved"), F.lit("moved twice"), 2))
    stale = F.when(k % 4 == 0, row("name", F.lit("nobody"), F.lit("wrong"), 3))
    number = F.when(k % 10 == 0, row("balance", F.col("balance").cast("string"), (F.col("balance") + 1).cast("string"), 4))
    rejected = F.when(k % 2 == 0, row("name", F.col("name"), F.lit("no"), 0, "rejected"))
    fixes = c.select("record_id", F.explode(F.array_compact(F.array(first, second, stale, number, rejected))).alias("c")).select("record_id", "c.*")
    return inventory.guarded_update(c, "record_id", ["name", "balance"], fixes)[0]


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30') WHERE k = 1")
def asof_latest(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return ranking.latest(o, ["o_custkey"], "o_orderdate", F.lit("1996-06-30").cast("timestamp"), "o_orderkey")


@query("SELECT o_custkey AS record_id, CASE min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'rejected' END AS covered_by FROM orders GROUP BY o_custkey")
def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    d = o.select(F.col("o_custkey").alias("record_id"), status.alias("status"))
    return inventory.covered(d.select("record_id").distinct(), d)


def _order_flags(spark: SparkSession, sf: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    severity = F.when(p == 1, "high").when(p == 2, "medium").when(p == 3, "low").otherwise("info")
    return D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.lit("priority").alias("detector"), severity.alias("severity"), F.col("o_custkey").alias("c"))


@query(
    """SELECT o_orderkey AS record_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END AS priority
  FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 10 <> 0 AND left(o_orderpriority, 1) IN ('1', '2', '3')"""
)
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    f = _order_flags(spark, sf).withColumn("covered_by", F.when(F.col("c") % 3 == 0, "approved"))
    exceptions = f.where("record_id % 10 = 0").select("record_id", "detector")
    return inventory.review_queue(f, exceptions).select("record_id", "priority")


@query("SELECT o_orderkey AS record_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def coverage_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return D.table(spark, sf, "orders").join(c, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("record_id"))


# --- detectors -------------------------------------------------------------------------------------------------------


@query(f"WITH {D.FACILITIES} SELECT f.record_id, array_to_string(list_filter(g.keys, lambda k: k <> f.community_name), ';') AS others FROM facility f JOIN (SELECT round_even(x / 1000, 0) AS px, round_even(y / 1000, 0) AS py, list_sort(list(DISTINCT community_name)) AS keys FROM facility GROUP BY 1, 2 HAVING count(DISTINCT community_name) > 1) g ON round_even(f.x / 1000, 0) = g.px AND round_even(f.y / 1000, 0) = g.py")
def shared_point(spark: SparkSession, sf: str) -> DataFrame:
    f = D.facilities(spark, sf).withColumn("community_key", F.col("community_name"))
    return inventory.shared_point_labels(f, {"shared_point_m": 1000.0}).select("record_id", F.col("detail").alias("others"))


@query(f"WITH {D.FACILITIES}, f AS (SELECT *, round_even(total_capacity / 4000, 0) AS cap FROM facility), g AS (SELECT record_id, row_number() OVER w AS k, count(*) OVER p AS n, min(cap) OVER p AS lo, max(cap) OVER p AS hi FROM f WINDOW p AS (PARTITION BY tank_farm_id, community_name), w AS (PARTITION BY tank_farm_id, community_name ORDER BY record_id)) SELECT record_id, CAST(n AS VARCHAR) || ' copies' AS detail FROM g WHERE n > 1 AND lo = hi AND k > 1")
def copies_within_group(spark: SparkSession, sf: str) -> DataFrame:
    f = D.facilities(spark, sf).withColumn("total_capacity", F.rint(F.col("total_capacity") / 4000)).withColumn("community_key", F.col("community_name"))
    return inventory.within_farm_copies(f, {}).select("record_id", "detail")


@query(f"WITH {D.FACILITIES} SELECT tank_farm_id, count(DISTINCT community_name) AS n FROM facility GROUP BY tank_farm_id HAVING count(DISTINCT community_name) > 1")
def shared_label_groups(spark: SparkSession, sf: str) -> DataFrame:
    return D.facilities(spark, sf).groupBy("tank_farm_id").agg(F.countDistinct("community_name").alias("n")).where("n > 1")


@query("SELECT p_partkey AS record_id, CASE WHEN p_size * 2 > p_size + 20 THEN 'high' ELSE 'medium' END AS severity FROM part WHERE p_partkey % 2 = 0 AND abs(p_size * 2 - (p_size + 20)) > 1")
def capacity_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    own = F.when(F.col("p_partkey") % 2 == 0, size)
    p = D.table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), (size + 20).alias("total_capacity"), own.alias("gasoline_capacity"), own.alias("diesel_capacity"), F.lit(None).cast("double").alias("jet_fuel_capacity"), F.lit(None).cast("double").alias("other_fuel_capacity"))
    return inventory.capacity_mismatch(p, {"capacity_mismatch_gal": 1.0}).select("record_id", "severity")


@query("SELECT o_orderkey AS record_id, array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'community_name' END, CASE WHEN o_orderkey % 6 = 0 THEN 'latitude' END, CASE WHEN o_orderkey % 5 = 0 THEN 'total_capacity' END], lambda x: x IS NOT NULL), ';') AS detail FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 OR o_orderkey % 5 = 0")
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = D.table(spark, sf, "orders").select(k.alias("record_id"), F.when(k % 4 != 0, "a").alias("community_name"), F.when(k % 6 != 0, 60.0).alias("latitude"), F.lit(-150.0).alias("longitude"), F.lit("Road").alias("delivery_method"), F.when(k % 5 != 0, 1.0).alias("total_capacity"))
    return inventory.missing_fields(o, {}).select("record_id", "detail")


@query("SELECT o_orderkey AS record_id FROM orders WHERE o_orderkey % 9 = 0 AND year(o_orderdate) - 98 < 1900")
def placeholder_date(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").where("o_orderkey % 9 = 0")
    # Years 1995 to 2001 become 1897 to 1903.
    dated = o.select(F.col("o_orderkey").alias("record_id"), F.concat((F.year("o_orderdate") - 98).cast("string"), F.lit("-01-01")).alias("last_inspected"))
    return inventory.placeholder_date(dated, {}).select("record_id")


@query("SELECT c_custkey AS record_id FROM customer WHERE NOT ((45 + c_custkey % 30) BETWEEN 50 AND 72 AND ((-180 + c_custkey % 80) <= -129 OR (-180 + c_custkey % 80) >= 170))")
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = D.table(spark, sf, "customer").select(k.alias("record_id"), (45 + k % 30).cast("double").alias("latitude"), (-180 + k % 80).cast("double").alias("longitude"))
    return inventory.envelope(c, {}).select("record_id")


@query(
    """WITH t AS (SELECT s_suppkey, printf('%.4f', 60 + (s_suppkey % 100) / 8.0::DOUBLE) AS t FROM supplier),
  e AS (SELECT s_suppkey, p, d, CAST(left(t, CAST(p - 1 AS INTEGER)) || CAST(d AS VARCHAR) || substr(t, p + 1) AS DOUBLE) AS v
        FROM t, generate_series(1, 7) AS a(p), generate_series(0, 9) AS b(d) WHERE substr(t, p, 1) <> '.' AND substr(t, p, 1) <> CAST(d AS VARCHAR))
  SELECT s_suppkey, count(*) AS n, round(sum(v), 4) AS total FROM e GROUP BY s_suppkey"""
)
def one_digit_edits(spark: SparkSession, sf: str) -> DataFrame:
    s = D.table(spark, sf, "supplier").select("s_suppkey", F.explode(S.one_digit_edits(60 + (F.col("s_suppkey") % 100) / 8.0)).alias("e"))
    return s.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("e.value"), 4).alias("total"))


@query(f"WITH {D.POINTS}, s AS (SELECT a.label, a.id, round(sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 4) AS s FROM pt a JOIN pt b ON a.label = b.label GROUP BY a.label, a.id) SELECT label, id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s, id) AS k FROM s) WHERE k = 1")
def medoid_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.medoids(D.points(spark, sf), "id", "label").select("label", "id")


@query("SELECT * FROM (SELECT 'balance known' AS check, count(*) FILTER (c_acctbal IS NULL) = 0 AS passed, count(*) FILTER (c_acctbal IS NULL) AS failures FROM customer UNION ALL SELECT 'balance positive', count(*) FILTER (c_acctbal <= 0) = 0, count(*) FILTER (c_acctbal <= 0) FROM customer)")
def publish_checks(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.checks(D.table(spark, sf, "customer"), [("balance known", F.col("c_acctbal").isNotNull()), ("balance positive", F.col("c_acctbal") > 0)])


# --- spatial ---------------------------------------------------------------------------------------------------------

_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_TWO = "l AS (SELECT * FROM pt WHERE id % 5 = 0), r AS (SELECT * FROM pt WHERE id % 5 <> 0)"


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = D.points(spark, sf)
    return p.where("id % 5 = 0"), p.where("id % 5 <> 0")


@query(f"WITH {D.POINTS}, {_TWO}, d AS (SELECT a.id AS left_id, b.id AS right_id, {_DIST} AS d FROM l a, r b) SELECT left_id, right_id, round(d, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY d, right_id) AS k FROM d) WHERE k = 1")
def nearest_k1(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest(*_two(spark, sf), start=1000.0).withColumn("dist", F.round("dist", 4))


@query(f"WITH {D.POINTS}, {_TWO}, d AS (SELECT a.id AS left_id, b.id AS right_id, {_DIST} AS d FROM l a, r b) SELECT left_id, right_id, round(d, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY d, right_id) AS k FROM d WHERE d <= 600) WHERE k = 1")
def nearest_capped(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest_within(*_two(spark, sf), radius=600.0).withColumn("dist", F.round("dist", 4))


@query(f"WITH {D.POINTS}, {_TWO}, d AS (SELECT a.id AS left_id, b.v, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM l a, r b) SELECT left_id, round(median(v), 8) AS value FROM d WHERE k <= 20 GROUP BY left_id")
def knn_median(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _two(spark, sf)
    near = spatial.k_nearest(left, right, 20, 4000.0)
    return spatial.knn_median(near, right.select(F.col("id").alias("right_id"), "v")).withColumn("value", F.round("value", 8))


@query(f"WITH {D.POINTS}, {_TWO}, d AS (SELECT a.id AS left_id, b.v, {_DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM l a, r b) SELECT left_id, round(sum(v / (d * d)) / sum(1 / (d * d)), 6) AS value FROM d WHERE k <= 12 AND d <= 50000 GROUP BY left_id")
def idw_k12(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _two(spark, sf)
    near = spatial.k_nearest(left, right, 12, 3000.0)
    return spatial.idw(near, right.select(F.col("id").alias("right_id"), "v"), cap=50000.0).withColumn("value", F.round("value", 6))


@query(f"WITH {D.POINTS}, {_TWO} SELECT a.id AS left_id, count(*) AS n FROM l a, r b WHERE {_DIST} <= 3000 GROUP BY a.id")
def radius_count(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.within(*_two(spark, sf), radius=3000.0).groupBy("left_id").agg(F.count("*").alias("n"))


_SHAPES = [("east", [[(0.0, -30000.0), (40000.0, -20000.0), (30000.0, 35000.0), (0.0, 20000.0), (0.0, -30000.0)], [(5000.0, -5000.0), (9000.0, -5000.0), (9000.0, 4000.0), (5000.0, 4000.0), (5000.0, -5000.0)]]), ("west", [[(-40000.0, -40000.0), (1000.0, -25000.0), (1000.0, 30000.0), (-20000.0, 10000.0), (-40000.0, -40000.0)]])]
_SEGMENTS = ", ".join(f"('{n}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for n, rings in _SHAPES for ring in rings for a, b in zip(ring, ring[1:], strict=False))
_PIP = f"""s(poly, x1, y1, x2, y2) AS (SELECT c0, CAST(c1 AS DOUBLE), CAST(c2 AS DOUBLE), CAST(c3 AS DOUBLE), CAST(c4 AS DOUBLE) FROM (VALUES {_SEGMENTS}) AS t(c0, c1, c2, c3, c4)),
h AS (SELECT id, poly FROM pt, s WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id, poly HAVING count(*) % 2 = 1)"""


def shapes(spark: SparkSession) -> DataFrame:
    rows = [(n, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for n, rings in _SHAPES]
    return spark.createDataFrame(rows, "poly string, rings array<array<struct<x:double,y:double>>>")


@query(f"WITH {D.POINTS}, {_PIP} SELECT id, min(poly) AS poly FROM pt LEFT JOIN h USING (id) GROUP BY id")
def pip_region(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.first_polygon(D.points(spark, sf), shapes(spark), 10000.0)


@query(f"WITH {D.POINTS}, {_PIP} SELECT id, poly FROM h")
def pip_all(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.in_polygons(D.points(spark, sf), shapes(spark), 10000.0)


@query(
    f"""WITH {D.POINTS}, {_PIP},
  t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM pt, s),
  d AS (SELECT id, poly, min(sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1)))) AS d FROM t GROUP BY id, poly),
  e AS (SELECT d.id, d.poly, CASE WHEN h.poly IS NULL THEN d ELSE 0.0::DOUBLE END AS d FROM d LEFT JOIN h ON h.id = d.id AND h.poly = d.poly),
  f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, poly) AS k FROM e WHERE d <= 8000)
  SELECT pt.id, f.poly AS region, CASE WHEN f.poly IS NULL THEN 'outside' WHEN f.d = 0 THEN 'inside' ELSE 'nearest' END AS relation, round(f.d / 1000, 6) AS km FROM pt LEFT JOIN f ON f.id = pt.id AND f.k = 1"""
)
def region_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.region_of(D.points(spark, sf), shapes(spark), 8000.0).withColumn("km", F.round("km", 6))


# --- rasters ---------------------------------------------------------------------------------------------------------

_SLOPE = "CASE WHEN slope < 2 THEN 1.0::DOUBLE WHEN slope < 8 THEN 1.4::DOUBLE ELSE 1.75::DOUBLE END"
_LULC = "CASE lulc WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 1.15::DOUBLE WHEN 3 THEN 2.5::DOUBLE WHEN 4 THEN 1.1::DOUBLE WHEN 5 THEN 1.6::DOUBLE WHEN 6 THEN 1.05::DOUBLE WHEN 7 THEN 1.1::DOUBLE WHEN 8 THEN 5.0::DOUBLE END"
_FROST = "CASE WHEN permafrost < 0.0999 THEN 1.0::DOUBLE WHEN permafrost < 0.4999 THEN 1.15::DOUBLE WHEN permafrost < 0.8999 THEN 1.3::DOUBLE ELSE 1.5::DOUBLE END"


@query(f"WITH {D.CELLS} SELECT {_SLOPE} AS factor, count(*) AS n FROM cell GROUP BY 1")
def raster_reclass_slope(spark: SparkSession, sf: str) -> DataFrame:
    return D.cells(spark, sf).groupBy(raster.slope_factor(F.col("slope")).alias("factor")).agg(F.count("*").alias("n"))


@query(f"WITH {D.CELLS} SELECT {_LULC} AS factor, count(*) AS n FROM cell GROUP BY 1")
def raster_reclass_lulc(spark: SparkSession, sf: str) -> DataFrame:
    return D.cells(spark, sf).groupBy(raster.lulc_factor(F.col("lulc")).alias("factor")).agg(F.count("*").alias("n"))


@query(f"WITH {D.CELLS} SELECT {_FROST} AS factor, count(*) AS n FROM cell GROUP BY 1")
def permafrost_zone(spark: SparkSession, sf: str) -> DataFrame:
    return D.cells(spark, sf).groupBy(raster.permafrost_factor(F.col("permafrost")).alias("factor")).agg(F.count("*").alias("n"))


@query(f"WITH {D.CELLS} SELECT row, col, round(greatest(1.0, {_SLOPE}) * {_FROST}, 6) AS value FROM cell")
def road_base(spark: SparkSession, sf: str) -> DataFrame:
    return D.cells(spark, sf).select("row", "col", F.round(raster.road_base(F.col("slope"), F.col("permafrost")), 6).alias("value"))


@query(
    f"""WITH {D.CELLS}, m AS (SELECT CAST(m AS INTEGER) AS month FROM generate_series(1, 12) AS g(m))
  SELECT 'overland' AS mode, CAST(1 AS INTEGER) AS month, row, col, round({_SLOPE} * {_LULC} * {_FROST}, 6) AS value FROM cell WHERE lulc <> 0
  UNION ALL SELECT 'barge', month, row, col, 1.0::DOUBLE FROM cell, m WHERE (lulc = 0 OR row % 5 = 0) AND NOT ((month <= 3 AND col % 2 = 0) OR (month <= 4 AND row % 5 = 0))"""
)
def mode_surface(spark: SparkSession, sf: str) -> DataFrame:
    c = D.cells(spark, sf)
    land = c.select(F.lit("overland").alias("mode"), F.lit(1).alias("month"), "row", "col", F.round(raster.overland(F.col("slope"), F.col("lulc"), F.col("permafrost")), 6).alias("value"))
    m, river = c.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))), F.col("row") % 5 == 0
    sea, ice = F.when((F.col("month") <= 3) & (F.col("col") % 2 == 0), 0.9).otherwise(0.1), F.when(F.col("month") <= 4, 0.8)
    water = m.select(F.lit("barge").alias("mode"), "month", "row", "col", raster.barge(F.col("lulc") == 0, river, sea, ice, river).alias("value"))
    return land.unionByName(water).where("value is not null")


_SAMPLE = f"""p AS (SELECT c_custkey AS id, (c_custkey % 60) * 140.0::DOUBLE AS x, -(c_custkey % 41) * 133.0::DOUBLE AS y, 1 + c_custkey % 9 AS len FROM customer),
q AS (SELECT p.*, {_LULC} AS value FROM p LEFT JOIN cell ON cell.row = CAST(floor((0 - y) / 150) AS BIGINT) AND cell.col = CAST(floor(x / 150) AS BIGINT))"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    p = D.table(spark, sf, "customer").select(k.alias("id"), ((k % 60) * 140.0).alias("x"), (-(k % 41) * 133.0).alias("y"), (1 + k % 9).cast("double").alias("length"))
    return raster.sample(p, D.cells(spark, sf).select("row", "col", raster.lulc_factor(F.col("lulc")).alias("value")), 0.0, 0.0)


@query(f"WITH {D.CELLS}, {_SAMPLE} SELECT id, value FROM q")
def raster_point_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).select("id", "value")


@query(f"WITH {D.CELLS}, {_SAMPLE} SELECT id % 50 AS edge_id, round(sum(CASE WHEN value IS NOT NULL THEN len * value END) / sum(CASE WHEN value IS NOT NULL THEN len END), 6) AS avg_friction, round(1 - coalesce(sum(CASE WHEN value IS NOT NULL THEN len END), 0) / sum(len), 6) AS nodata_frac FROM q GROUP BY 1 UNION ALL SELECT CAST(9999 AS BIGINT), NULL, 1.0::DOUBLE")
def length_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    s = _samples(spark, sf).withColumn("edge_id", F.col("id") % 50)
    owners = s.select("edge_id").distinct().unionAll(spark.range(1).select(F.lit(9999).cast("long")))
    return raster.weighted_stats(s, owners, "edge_id").select("edge_id", F.round("avg_friction", 6).alias("avg_friction"), F.round("nodata_frac", 6).alias("nodata_frac"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS y1, (s_suppkey % 17) * 40.0::DOUBLE AS x2, (s_suppkey % 5) * 70.0::DOUBLE AS y2 FROM supplier),
  l AS (SELECT *, sqrt(x2 * x2 + y2 * y2) AS len, CAST(ceil(sqrt(x2 * x2 + y2 * y2) / 75) AS INTEGER) AS n FROM s),
  e AS (SELECT *, unnest(range(n)) AS i FROM l WHERE n > 0)
  SELECT k, CAST(count(*) AS BIGINT) AS n, round(sum(x2 * (i + 0.5::DOUBLE) / n), 4) AS sx, round(sum(y2 * (i + 0.5::DOUBLE) / n), 4) AS sy, round(sum(len / n), 4) AS length FROM e GROUP BY k"""
)
def densify_midpoints(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    line = F.array(spatial.point(F.lit(0), F.lit(0)), spatial.point((k % 17) * 40.0, (k % 5) * 70.0))
    s = D.table(spark, sf, "supplier").select(k.alias("k"), line.alias("line"))
    return raster.line_samples(s, "k", 75.0).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"), F.round(F.sum("length"), 4).alias("length"))


@query("WITH c AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col FROM part WHERE p_partkey % 37 = 0) SELECT DISTINCT row + i AS row, col + j AS col FROM c, generate_series(-2, 2) AS a(i), generate_series(-2, 2) AS b(j)")
def focal_dilation(spark: SparkSession, sf: str) -> DataFrame:
    return raster.dilated(D.cells(spark, sf).where((F.col("row") * 50 + F.col("col")) % 37 == 0), 2)


@query("WITH p AS (SELECT p_partkey % 9 AS old, p_size % 9 AS new FROM part), n AS (SELECT old, CAST(new AS BIGINT) AS new, count(*) AS n FROM p GROUP BY old, new) SELECT old, new, n, round(n / sum(n) OVER (PARTITION BY old), 6) AS share FROM n")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "part").select((F.col("p_partkey") % 9).alias("old"), (F.col("p_size") % 9).cast("long").alias("new"))
    return raster.confusion(p).withColumn("share", F.round("share", 6))


@query(
    """WITH m AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, CAST(m AS INTEGER) AS month, p_size FROM part, generate_series(1, 12) AS g(m)),
  a AS (SELECT row, col, month, p_size % 3 AS v FROM m WHERE (p_size + month) % 4 <> 0), b AS (SELECT row, col, month, p_size % 2 AS v FROM m WHERE (p_size + month) % 5 <> 0)
  SELECT month, count(*) FILTER (a.v IS NOT NULL AND b.v IS NULL) AS lost, count(*) FILTER (a.v IS NULL AND b.v IS NOT NULL) AS gained, count(*) FILTER (a.v <> b.v) AS differ, count(*) FILTER (a.v = b.v) AS same
  FROM a FULL JOIN b USING (row, col, month) GROUP BY month"""
)
def stack_comparison(spark: SparkSession, sf: str) -> DataFrame:
    m = D.cells(spark, sf).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    a = m.where((F.col("slope") + F.col("month")) % 4 != 0).select("row", "col", "month", (F.col("slope") % 3).alias("value"))
    b = m.where((F.col("slope") + F.col("month")) % 5 != 0).select("row", "col", "month", (F.col("slope") % 2).alias("value"))
    return raster.compared(a, b)


@query("SELECT least(9, CAST(floor(l_discount * 100 / 1) AS INTEGER)) AS bin, count(*) AS n, count(*) FILTER (l_tax > 0.05) AS over FROM lineitem GROUP BY 1")
def histogram_bins(spark: SparkSession, sf: str) -> DataFrame:
    l = D.table(spark, sf, "lineitem")  # noqa: E741
    return l.groupBy(F.least(F.lit(9), F.floor(F.col("l_discount") * 100 / 1).cast("int")).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("l_tax") > 0.05).alias("over"))


@query("SELECT user_id % 10 AS community, CAST(month(ts) AS INTEGER) AS month, median(value) AS mid FROM events GROUP BY 1, 2")
def community_month_median(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("community"), F.month("ts").alias("month")).agg(F.median("value").alias("mid"))


@query("WITH c AS (SELECT user_id % 40 AS cell, event_id % 4 AS month, avg(value) AS v FROM events GROUP BY 1, 2) SELECT cell % 5 AS zone, month, round(median(v), 6) AS median FROM c GROUP BY 1, 2")
def zonal_median(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events")
    pts = e.select(((F.col("user_id") % 40) * 150.0 + 10).alias("x"), F.lit(-10.0).alias("y"), (F.col("event_id") % 4).alias("month"), F.col("value").alias("v"))
    zones = spark.range(40).select(F.lit(0).cast("long").alias("row"), F.col("id").alias("col"), (F.col("id") % 5).alias("zone"))
    return raster.zonal(pts, zones, raster.CELL, 0.0, 0.0).withColumn("median", F.round("median", 6))


# --- hubs ------------------------------------------------------------------------------------------------------------


@query(f"WITH {D.FACILITIES} SELECT community_name, count(*) AS n, round(sum(total_capacity), 2) AS capacity, min(record_id) AS first, CASE WHEN count(*) FILTER (record_id % 3 = 0) > 0 THEN 'Barge or Plane or Road' ELSE 'x' END AS modes FROM facility GROUP BY community_name")
def hub_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    f = D.facilities(spark, sf)
    h = hubs.aggregated_hubs(f.select(F.col("record_id").alias("site_id"), F.col("community_name").alias("community"), F.col("community_name").alias("hub_key"), F.lit("community").alias("hub_kind"), "total_capacity", "x", "y", "delivery_method"))
    return h.select(F.col("hub_key").alias("community_name"), F.col("num_facilities").alias("n"), F.round("total_hub_capacity", 2).alias("capacity"), F.substring_index("member_site_ids", ";", 1).cast("long").alias("first"), F.col("delivery_method").alias("modes"))


@query(f"WITH {D.FACILITIES}, s AS (SELECT community_id, community_name, sum(tank_farm_id) AS w FROM facility GROUP BY 1, 2) SELECT community_id, community_name FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY w DESC, community_name) AS k FROM s) WHERE k = 1")
def dominant_label(spark: SparkSession, sf: str) -> DataFrame:
    return hubs.dominant(D.facilities(spark, sf), "community_id", "community_name", "tank_farm_id")


@query(f"WITH {D.FACILITIES}, q AS (SELECT delivery_method AS m, quantile_cont(total_capacity, 0.9) AS cut FROM facility GROUP BY 1) SELECT record_id, CASE WHEN total_capacity >= cut THEN 'Supplier' ELSE 'Receiver' END AS hub_type FROM facility JOIN q ON delivery_method IS NOT DISTINCT FROM m")
def supplier_receiver_p90(spark: SparkSession, sf: str) -> DataFrame:
    return hubs.supplier_or_receiver(D.facilities(spark, sf).withColumn("capacity", F.col("total_capacity"))).select("record_id", "hub_type")


@query(f"WITH {D.FACILITIES} SELECT min(record_id) AS hub_id, round(sum(total_capacity), 2) AS capacity, count(*) AS n_hubs FROM facility GROUP BY round_even(x / 5000, 0), round_even(y / 5000, 0)")
def round_grid_merge(spark: SparkSession, sf: str) -> DataFrame:
    f = D.facilities(spark, sf).withColumnRenamed("record_id", "hub_id").withColumn("capacity", F.col("total_capacity"))
    return hubs.colocated(f, 5000.0).select("hub_id", F.round("capacity", 2).alias("capacity"), "n_hubs")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS text, max(o_totalprice) AS capacity, count(*) AS n_members FROM orders GROUP BY o_custkey")
def first_non_null_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders")
    rows = o.select("o_custkey", F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("text"), F.col("o_totalprice").alias("capacity"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit("Road").alias("delivery_method"))
    return hubs.merged_sites(rows, "o_custkey", "record_id", ["text"], ["capacity"]).select("o_custkey", "text", "capacity", "n_members")


# --- graph -----------------------------------------------------------------------------------------------------------


# Components of a small table of edges; and of all line items, by way of the suppliers that share a part.
_CC = "two AS (SELECT a, b FROM small UNION SELECT b, a FROM small), cc(node, c) AS (SELECT a, a FROM two UNION SELECT b, c FROM cc JOIN two ON a = node), lab AS (SELECT node, min(c) AS component FROM cc GROUP BY node)"


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("a", "b")).alias("node")).distinct()


_ALL_CC = f"""{D.EDGES}, sp AS (SELECT DISTINCT a, b FROM edge), ss AS MATERIALIZED (SELECT DISTINCT x.a AS u, y.a AS v FROM sp x JOIN sp y USING (b)),
  r(node, c) AS (SELECT a, a FROM sp UNION SELECT v, c FROM r JOIN ss ON u = node), sup AS (SELECT node, min(c) AS component FROM r GROUP BY node),
  lab AS (SELECT node, component FROM sup UNION ALL SELECT b, min(component) FROM sp JOIN sup ON a = node GROUP BY b)"""


@query(f"WITH RECURSIVE {_ALL_CC} SELECT node, component FROM lab")
def components_labels(spark: SparkSession, sf: str) -> DataFrame:
    e = D.edges(spark, sf)
    return graph.components(_nodes(e), e)


@query(f"WITH RECURSIVE {_ALL_CC}, s AS (SELECT component, count(*) AS size FROM lab GROUP BY component), rk AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS k FROM s) SELECT k AS component, size, k = 1 AS is_giant FROM rk")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    e = D.edges(spark, sf)
    return graph.ranked_components(_nodes(e), e).select("component", "size", "is_giant").distinct()


@query(f"WITH {D.EDGES} SELECT least(a, b) AS u, greatest(a, b) AS v, min({_COST}) AS cost FROM edge WHERE passable GROUP BY 1, 2")
def parallel_edge_min(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cheapest_parallel(_costed(spark, sf))


@query(
    f"""WITH RECURSIVE {D.EDGES}, p AS (SELECT least(a, b) AS u, greatest(a, b) AS v, min(CAST(round(length_m) AS BIGINT)) AS w FROM edge WHERE passable GROUP BY 1, 2),
  t AS MATERIALIZED (SELECT u, v, w FROM p UNION ALL SELECT v, u, w FROM p), src AS (SELECT min(s_suppkey) AS s FROM supplier GROUP BY s_nationkey),
  best(s, node, d) USING KEY (s, node) AS (
    SELECT s, s, CAST(0 AS BIGINT) FROM src WHERE s IN (SELECT u FROM t)
    UNION SELECT n.s, n.v, n.d FROM (SELECT best.s, t.v, min(best.d + t.w) AS d FROM best JOIN t ON t.u = best.node GROUP BY best.s, t.v) n LEFT JOIN recurring.best o ON o.s = n.s AND o.node = n.v WHERE o.d IS NULL OR n.d < o.d)
  SELECT s AS src, node AS dst, CAST(d AS DOUBLE) AS cost FROM best WHERE s <> node"""
)
def shortest_path_costs(spark: SparkSession, sf: str) -> DataFrame:
    """From the first supplier of every nation to all nodes, over the passable line items."""
    # Parallel line items all go: the cheapest wins, and no shuffle is needed to find it.
    p = D.edges(spark, sf).where("passable").select(F.col("a").alias("u"), F.col("b").alias("v"), F.round("length_m").cast("double").alias("cost"))
    first = D.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("node"))
    return graph.shortest_costs(p, first.select("node"))


@query(
    """WITH l AS (SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS cost, CASE o_orderkey % 3 WHEN 0 THEN 'barge' WHEN 1 THEN 'overland' ELSE 'ice_road' END AS mode FROM orders),
  w AS (SELECT *, lag(mode) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM l)
  SELECT o_custkey AS chain, round(sum(cost) + sum(CASE WHEN before IS NULL OR before = mode THEN 0.0::DOUBLE WHEN 'barge' NOT IN (before, mode) THEN 0.022::DOUBLE WHEN 'overland' IN (before, mode) THEN 0.24::DOUBLE ELSE 0.011::DOUBLE END), 3) AS cost,
  count(*) FILTER (before <> mode) AS changes FROM w GROUP BY o_custkey"""
)
def chain_cost(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    legs = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("leg"), F.round("o_totalprice", 2).alias("cost"), F.when(k == 0, "barge").when(k == 1, "overland").otherwise("ice_road").alias("mode"))
    fees = spark.createDataFrame([(a, b, v) for (a, b), v in costs.FEES.items()], "mode_a string, mode_b string, fee double")
    return graph.chain_cost(legs, fees).withColumn("cost", F.round("cost", 3))


@query(
    f"""WITH {D.EDGES}, e AS (SELECT *, CASE WHEN (l_orderkey + l_linenumber) % 50 = 0 THEN 'Bridge' WHEN type = 'BargeRoadTransfer' THEN 'Road' ELSE type END AS kind FROM (SELECT *, a AS f, 1000000 + l_partkey AS t FROM edge)),
  n AS (SELECT f AS node, CASE kind WHEN 'Waterway' THEN 'Barge' ELSE kind END AS k FROM e WHERE kind <> 'Bridge' UNION SELECT t, CASE kind WHEN 'Waterway' THEN 'Barge' ELSE kind END FROM e WHERE kind <> 'Bridge'),
  m AS (SELECT node, list(k) AS ks FROM n GROUP BY node),
  j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, list_filter(['Barge', 'IceRoad', 'Air', 'Road'], lambda x: list_contains(coalesce(x1.ks, []), x) OR list_contains(coalesce(x2.ks, []), x)) AS ks FROM e LEFT JOIN m x1 ON x1.node = f LEFT JOIN m x2 ON x2.node = t WHERE kind = 'Bridge')
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE len(ks) WHEN 0 THEN kind WHEN 1 THEN ks[1] || 'Connector' ELSE ks[1] || ks[2] || 'Transfer' END AS type FROM j"""
)
def classify_connectors(spark: SparkSession, sf: str) -> DataFrame:
    e = D.edges(spark, sf)
    kind = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 50 == 0, "Bridge").when(F.col("type") == "BargeRoadTransfer", "Road").otherwise(F.col("type"))
    rows = e.withColumn("bridge", kind == "Bridge").withColumn("type", kind).withColumn("source", F.lit(""))
    return graph.classify_connectors(rows).where("bridge").select(*D.EDGE_KEY[:4], "type")


_WELD = f"""{D.POINTS}, small AS (SELECT id AS a, id + 1 AS b FROM pt WHERE id % 4 <> 3 AND id + 1 IN (SELECT id FROM pt)), {_CC},
g AS (SELECT component FROM lab GROUP BY component ORDER BY count(*) DESC, component DESC LIMIT 1), pl AS (SELECT pt.*, component FROM pt JOIN lab ON id = node)"""


def _chains(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = D.points(spark, sf).select("id", "x", "y")
    e = p.where("id % 4 <> 3").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit("Road").alias("type")).join(p.select(F.col("id").alias("b")), "b", "left_semi")
    return p, e


@query(
    f"""WITH RECURSIVE {_WELD}, d AS (SELECT a.component AS c, a.id AS l, b.id AS r, {_DIST} AS d FROM pl a JOIN pl b ON a.component <> b.component WHERE a.component NOT IN (SELECT component FROM g) AND {_DIST} <= 900)
  SELECT DISTINCT least(l, r) AS a, greatest(l, r) AS b, round(d, 4) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d, l, r) AS k FROM d) WHERE k = 1"""
)
def within_mode_weld(spark: SparkSession, sf: str) -> DataFrame:
    p, e = _chains(spark, sf)
    return graph.within_mode_welds(e, p, "Road", 900.0).withColumn("gap", F.round("gap", 4))


@query(
    f"""WITH RECURSIVE {_WELD}, d AS (SELECT a.component AS c, a.id AS l, b.id AS r, {_DIST} AS d FROM pl a, pl b WHERE a.component NOT IN (SELECT component FROM g) AND b.component IN (SELECT component FROM g) AND {_DIST} <= 20000)
  SELECT l AS a, r AS b, round(d, 4) AS gap, CASE WHEN r < 300 THEN 'weld:to-giant' WHEN l % 3 = 0 THEN 'shore:Barge↔Road' ELSE 'shore:Barge↔IceRoad' END AS source FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d, l, r) AS k FROM d) WHERE k = 1"""
)
def connect_to_giant(spark: SparkSession, sf: str) -> DataFrame:
    p, e = _chains(spark, sf)
    both = _nodes(e).select(F.col("node").alias("id"))
    road = both.where("id % 3 = 0").select(F.col("id").alias("node"))
    return graph.connect_to_giant(p.join(both, "id", "left_semi"), e, 20000.0, 300, road).withColumn("gap", F.round("gap", 4))


@query(
    f"""WITH {D.POINTS}, f AS (SELECT * FROM pt WHERE id % 7 = 1), t AS (SELECT * FROM pt WHERE id % 7 = 2), n AS (SELECT * FROM pt WHERE id % 7 = 3),
  x AS (SELECT a.id AS anchor, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM n a, f b WHERE {_DIST} <= 3000),
  y AS (SELECT a.id AS anchor, b.id, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM n a, t b WHERE {_DIST} <= 3000),
  j AS (SELECT x.id AS a, y.id AS b, x.anchor FROM x JOIN y ON x.anchor = y.anchor AND x.k = 1 AND y.k = 1)
  SELECT a, b, 1 AS rule, min(anchor) AS anchor FROM j GROUP BY a, b"""
)
def anchor_transfer_dedup(spark: SparkSession, sf: str) -> DataFrame:
    p = D.points(spark, sf)
    pick = lambda k: p.where(f"id % 7 = {k}")
    return graph.anchor_transfers(pick(3), [(1, pick(1), pick(2), 3000.0), (2, pick(2), pick(1), 3000.0)])


# --- order -----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def topk(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top(D.table(spark, sf, "part").select("p_partkey", "p_retailprice"), 40, F.desc("p_retailprice"), "p_partkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS edge_id FROM part")
def rownum(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.numbered(D.table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand", "p_partkey"], "edge_id").select("p_partkey", "edge_id")


@query("SELECT p_brand, p_type, row_number() OVER (ORDER BY p_brand, p_type) AS k FROM (SELECT DISTINCT p_brand, p_type FROM part)")
def dense_renumber(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.numbered(D.table(spark, sf, "part").select("p_brand", "p_type").distinct(), ["p_brand", "p_type"], "k", 1)


@query("SELECT hub, row_number() OVER (ORDER BY n, hub) AS k FROM (SELECT 'Hub_' || CAST(s_suppkey AS VARCHAR) AS hub, s_suppkey AS n FROM supplier)")
def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    s = D.table(spark, sf, "supplier").select(F.concat(F.lit("Hub_"), F.col("s_suppkey").cast("string")).alias("hub"))
    n = F.regexp_extract("hub", r"(\d+)$", 1).try_cast("bigint")
    s = s.withColumn("_none", n.isNull()).withColumn("_n", n)
    return ranking.numbered(s, ["_none", "_n", "hub"], "k", 1).select("hub", "k")


# --- without SQL: results of closed forms, clustering, noding and snapping, which tests hold against fixtures --------


@query(f"SELECT c_custkey, round(x, 3) AS east, round(y, 3) AS north, true AS lon_back, true AS lat_back FROM (SELECT c_custkey, {D.albers('(-170 + (c_custkey % 400) / 10.0::DOUBLE)', '(52 + (c_custkey % 180) / 10.0::DOUBLE)')} FROM customer)")
def albers_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from spanwise.functions.albers import ALASKA

    k = F.col("c_custkey")
    c = D.table(spark, sf, "customer").select(k, (-170 + (k % 400) / 10.0).alias("lon"), (52 + (k % 180) / 10.0).alias("lat"))
    x, y = ALASKA.forward(F.col("lon"), F.col("lat"))
    c = c.withColumn("x", x).withColumn("y", y)
    lon, lat = ALASKA.inverse(F.col("x"), F.col("y"))
    return c.select("c_custkey", F.round("x", 3).alias("east"), F.round("y", 3).alias("north"), (F.abs(lon - F.col("lon")) < 1e-9).alias("lon_back"), (F.abs(lat - F.col("lat")) < 1e-9).alias("lat_back"))


@query(None)
def site_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return hubs.complete_linkage(D.points(spark, sf).select("id", "x", "y"), 2000.0)


@query(
    f"""WITH {D.POINTS}, h AS (SELECT * FROM pt WHERE id % 9 = 0), n AS (SELECT *, id % 2 = 0 AS road FROM pt WHERE id % 9 <> 0),
  d AS (SELECT a.id AS h, b.id AS node, b.road, {_DIST} AS d FROM h a, n b),
  r AS (SELECT h, node, d FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY d, node) AS k FROM d WHERE road) WHERE k = 1),
  o AS (SELECT h, node, d FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY d, node) AS k FROM d WHERE d <= 1500) WHERE k = 1),
  f AS (SELECT h.id AS n, CASE WHEN r.d <= 1500 THEN r.node ELSE o.node END AS node_id, CASE WHEN r.d <= 1500 THEN r.d ELSE coalesce(o.d, r.d) END AS d FROM h LEFT JOIN r ON r.h = h.id LEFT JOIN o ON o.h = h.id)
  SELECT 'Hub_' || CAST(n AS VARCHAR) AS hub_id, node_id, round(d, 3) AS snap_dist_m,
         CASE WHEN node_id IS NULL THEN 'unplaced:beyond_cap' WHEN n = min(n) OVER (PARTITION BY node_id) THEN 'placed' ELSE 'merged:Hub_' || CAST(min(n) OVER (PARTITION BY node_id) AS VARCHAR) END AS status FROM f"""
)
def hub_snapping(spark: SparkSession, sf: str) -> DataFrame:
    p = D.points(spark, sf)
    h = p.where("id % 9 = 0").select(F.concat(F.lit("Hub_"), F.col("id").cast("string")).alias("hub_id"), F.col("id").alias("n"), "x", "y", F.lit("Barge or Road").alias("delivery_method"))
    n = p.where("id % 9 <> 0").select(F.col("id").alias("node"), F.when(F.col("id") % 2 == 0, "Road").otherwise("Waterway").alias("type"), "x", "y")
    return hubs.snapped(h, n, ["Road"], 1500.0).withColumn("snap_dist_m", F.round("snap_dist_m", 3))


@query(None)
def planar_noding(spark: SparkSession, sf: str) -> DataFrame:
    p = D.points(spark, sf)
    s = p.select(F.col("id").alias("seg"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 3000 + F.col("label") * 100).alias("x2"), (F.col("y") + 2500 - F.col("label") * 300).alias("y2"))
    return graph.planar_noding(s, 5000.0)


@query(None)
def line_corridor_cells(spark: SparkSession, sf: str) -> DataFrame:
    p = D.points(spark, sf)
    s = p.select(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 1000).alias("x2"), (F.col("y") + 700).alias("y2"))
    return raster.rasterised(s, 75.0, -50000.0, 50000.0)


