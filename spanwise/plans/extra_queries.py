"""Queries of the detectors, of hub and network steps, and of friction stacks. Importing this module completes QUERIES and ORACLE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.albers import ALASKA
from spanwise.operators import costs, graph, hubs, inventory, raster, spatial, surface
from spanwise.plans import domain as D
from spanwise.plans import more_queries  # noqa: F401
from spanwise.plans.queries import _CC, _DIST, _PIP, ORACLE_SQL, QUERIES, _typed_edges, query, shapes

# --- detectors and records -------------------------------------------------------------------------------------------


@query(
    f"""WITH {D.FACILITIES}, farm AS (SELECT tank_farm_id, arg_min(x, record_id) AS fx, arg_min(y, record_id) AS fy FROM facility GROUP BY 1 HAVING count(DISTINCT community_name) > 1),
  near AS (SELECT f.tank_farm_id, n.community_name, count(*) AS n FROM farm f JOIN facility n ON n.tank_farm_id <> f.tank_farm_id AND sqrt((n.x - fx) * (n.x - fx) + (n.y - fy) * (n.y - fy)) <= 3000 GROUP BY 1, 2),
  sits AS (SELECT tank_farm_id, community_name AS sits FROM (SELECT *, row_number() OVER (PARTITION BY tank_farm_id ORDER BY n DESC, community_name) AS k FROM near) WHERE k = 1)
  SELECT record_id, CASE WHEN community_name = sits THEN 'info' ELSE 'high' END AS severity, 'farm:' || CAST(tank_farm_id AS VARCHAR) AS group_key FROM facility JOIN farm USING (tank_farm_id) LEFT JOIN sits USING (tank_farm_id)"""
)
def shared_farm_id(spark: SparkSession, sf: str) -> DataFrame:
    f = D.facilities(spark, sf).withColumn("community_key", F.col("community_name"))
    return inventory.shared_farm_id(f, {}).select("record_id", "severity", "group_key")


@query("SELECT c_custkey AS record_id, 'high' AS severity, CAST(c_custkey % 5 * 40 AS VARCHAR) || ' m' AS detail FROM customer WHERE c_custkey % 5 >= 3")
def map_point_disagrees(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = D.table(spark, sf, "customer").select(k.alias("record_id"), (-170 + (k % 400) / 10.0).alias("longitude"), (52 + (k % 180) / 10.0).alias("latitude"))
    x, y = ALASKA.forward(F.col("longitude"), F.col("latitude"))
    c = c.withColumn("map_x", x + F.col("record_id") % 5 * 40).withColumn("map_y", y)
    return inventory.map_point_disagrees(c, {}).select("record_id", "severity", "detail")


_TYPO_LAT, _TYPO_LON = "60 + c_nationkey * 0.3::DOUBLE + (c_custkey % 7) / 1000.0::DOUBLE + CASE WHEN c_custkey % 40 = 0 THEN 2 ELSE 0 END", "-150 + (c_custkey % 5) / 1000.0::DOUBLE"
_EDITS = """SELECT record_id, community_key, '{f}' AS field, {o} AS o, p, d, CAST(left(t, CAST(p - 1 AS INTEGER)) || CAST(d AS VARCHAR) || substr(t, p + 1) AS DOUBLE) AS v, latitude, longitude
  FROM (SELECT *, printf('%.4f', {f}) AS t FROM far), generate_series(1, 9) AS a(p), generate_series(0, 9) AS b(d) WHERE p <= length(t) AND substr(t, p, 1) NOT IN ('.', '-', CAST(d AS VARCHAR))"""


@query(
    f"""WITH f AS (SELECT c_custkey AS record_id, c_nationkey AS community_key, {_TYPO_LAT} AS latitude, {_TYPO_LON} AS longitude FROM customer), pt AS (SELECT *, {D.albers("longitude", "latitude")} FROM f),
  s AS (SELECT a.community_key, a.record_id, a.x, a.y, round(sum({_DIST}), 4) AS s FROM pt a JOIN pt b ON a.community_key = b.community_key GROUP BY ALL),
  mid AS (SELECT community_key, x AS mx, y AS my FROM (SELECT *, row_number() OVER (PARTITION BY community_key ORDER BY s, record_id) AS k FROM s) WHERE k = 1),
  far AS (SELECT pt.* FROM pt JOIN mid USING (community_key) WHERE sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) > 30000),
  e AS ({_EDITS.format(f="latitude", o=0)} UNION ALL {_EDITS.format(f="longitude", o=1)}),
  c AS (SELECT record_id, community_key, field, o, p, d, v, CASE WHEN field = 'latitude' THEN v ELSE latitude END AS la, CASE WHEN field = 'longitude' THEN v ELSE longitude END AS lo FROM e),
  q AS (SELECT *, {D.albers("lo", "la")} FROM c WHERE la BETWEEN -89.9 AND 89.9),
  h AS (SELECT q.*, row_number() OVER (PARTITION BY record_id ORDER BY o, p, d) AS k FROM q JOIN mid USING (community_key) WHERE sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) <= 3000)
  SELECT record_id, 'high' AS severity, field AS suggested_field, printf('%.6f', v) AS suggested_value FROM h WHERE k = 1"""
)
def one_digit_typo(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    lat = 60 + n * 0.3 + (k % 7) / 1000.0 + F.when(k % 40 == 0, 2).otherwise(0)
    c = D.table(spark, sf, "customer").select(k.alias("record_id"), n.alias("community_key"), lat.alias("latitude"), (-150 + (k % 5) / 1000.0).alias("longitude"))
    x, y = ALASKA.forward(F.col("longitude"), F.col("latitude"))
    rows = inventory.one_digit_typo(c.withColumn("x", x).withColumn("y", y), {"label_spread_km": 30.0, "typo_match_km": 3.0})
    return rows.select("record_id", "severity", "suggested_field", "suggested_value")


@query(
    """SELECT s_suppkey AS record_id, CASE WHEN s_suppkey % 3 = 0 THEN 'medium' ELSE 'info' END AS severity, CASE WHEN s_suppkey % 3 = 0 THEN 'map_x' ELSE 's_name' END AS field
  FROM supplier WHERE s_suppkey % 2 = 0 AND (s_suppkey % 3 <> 0 OR s_suppkey % 7 > 2)"""
)
def release_flags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    old = D.table(spark, sf, "supplier").select(k.alias("record_id"), "s_name", k.cast("double").alias("map_x"), F.lit("x").alias("last_edited"))
    even = F.col("record_id") % 2 == 0
    third = F.col("record_id") % 3 == 0
    new = old.withColumns({"s_name": F.when(even & ~third, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")), "map_x": F.when(even & third, F.col("map_x") + F.col("record_id") % 7).otherwise(F.col("map_x")), "last_edited": F.lit("y")})
    diff = inventory.release_diff(old, new, "record_id", ["s_name", "map_x", "last_edited"])
    return inventory.release_flags(diff).select("record_id", "severity", F.substring_index("detail", ":", 1).alias("field"))


_OWN = f"""{_PIP},
  t AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM pt, s),
  e AS (SELECT id, poly, min(sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1)))) AS d FROM t GROUP BY id, poly),
  d AS (SELECT e.id, e.poly, CASE WHEN h.poly IS NULL THEN d ELSE 0.0::DOUBLE END AS d FROM e LEFT JOIN h ON h.id = e.id AND h.poly = e.poly),
  i AS (SELECT id, string_agg(poly, ';' ORDER BY poly) AS inside_of FROM h GROUP BY id),
  own AS (SELECT pt.id, d.d FROM pt JOIN d ON d.id = pt.id AND d.poly = CASE pt.id % 4 WHEN 0 THEN 'east' WHEN 1 THEN 'west' WHEN 2 THEN 'east' END)"""


@query(
    f"""WITH {D.POINTS}, {_OWN}
  SELECT pt.id, CASE WHEN d IS NULL THEN 'untested' WHEN d <= 2000 THEN 'match' WHEN inside_of IS NOT NULL THEN 'mismatch' ELSE 'outside' END AS outcome,
         CASE WHEN d IS NULL THEN 'untested' WHEN d <= 2000 THEN 'inside' WHEN inside_of IS NULL THEN 'remote' WHEN d <= 20000 THEN 'adjacent' ELSE 'elsewhere' END AS relation, round(d / 1000, 6) AS own_km, inside_of,
         CASE WHEN d > 20000 AND inside_of IS NOT NULL THEN 'review' WHEN d > 2000 THEN 'info' END AS priority,
         CASE WHEN d IS NULL THEN 'no boundary for this community' WHEN d > 2000 AND inside_of IS NULL THEN 'remote site' WHEN d > 2000 AND d <= 20000 THEN 'a neighbouring place' END AS note
  FROM pt LEFT JOIN own ON own.id = pt.id LEFT JOIN i ON i.id = pt.id"""
)
def boundary_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id") % 4
    p = D.points(spark, sf).withColumn("community_id", F.when(k == 0, 1).when(k == 1, 2)).withColumn("key", F.when(k == 2, "east").otherwise("nowhere"))
    polygons = shapes(spark).withColumn("guid", F.when(F.col("poly") == "east", 1).otherwise(2)).withColumn("key", F.col("poly"))
    return inventory.boundary_check(p, polygons, side=10000.0).withColumn("own_km", F.round("own_km", 6))


@query(
    """WITH r AS (SELECT c_custkey AS record_id, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey * 100 + c_custkey % 4 END AS own_id, c_custkey % 10 <> 0 AS located, CASE WHEN c_custkey % 8 = 1 THEN 1000000 + c_custkey END AS led FROM customer),
  u AS (SELECT *, CASE WHEN NOT located THEN 'unlocated' WHEN led IS NOT NULL THEN 'ledger' WHEN own_id IS NOT NULL THEN 'own' ELSE 'synthetic' END AS id_source FROM r),
  m AS (SELECT greatest(max(led), max(own_id)) AS top FROM r)
  SELECT record_id, id_source, CASE id_source WHEN 'ledger' THEN led WHEN 'own' THEN own_id WHEN 'synthetic' THEN top + row_number() OVER (PARTITION BY id_source ORDER BY record_id) END AS facility_id, id_source = 'ledger' AND coalesce(own_id <> led, false) AS own_differs FROM u, m"""
)
def minted_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = D.table(spark, sf, "customer")
    rows = c.select(k.alias("record_id"), F.when(k % 3 != 0, F.col("c_nationkey") * 100 + k % 4).cast("long").alias("own_id"), k.alias("source_row"), (k % 10 != 0).alias("located"))
    ledger = c.where(k % 8 == 1).select(k.alias("record_id"), (k + 1000000).cast("long").alias("facility_id"), F.lit("own").alias("id_source"))
    return inventory.minted_ids(rows, ledger)[0]


@query("SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' ELSE 'low' END AS severity, o_orderstatus AS detector, count(*) AS n FROM orders GROUP BY 1, 2")
def queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    return inventory.queue_counts(D.table(spark, sf, "orders").select(F.when(p == "1", "high").when(p == "2", "medium").otherwise("low").alias("severity"), F.col("o_orderstatus").alias("detector")))


@query("SELECT c_custkey, o_orderkey, o_orderkey IS NOT NULL AS in_orders FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def merge_flag(spark: SparkSession, sf: str) -> DataFrame:
    o = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return inventory.flagged(D.table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "in_orders")


@query(
    """WITH a AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg FROM customer), b AS (SELECT c_nationkey, seg, count(*) AS n FROM a GROUP BY 1, 2)
  SELECT a.c_custkey, a.c_nationkey, a.seg, b.n FROM a LEFT JOIN b ON a.c_nationkey = b.c_nationkey AND a.seg IS NOT DISTINCT FROM b.seg"""
)
def null_safe_merge(spark: SparkSession, sf: str) -> DataFrame:
    a = D.table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("seg"))
    return inventory.null_safe_merge(a, a.groupBy("c_nationkey", "seg").agg(F.count("*").alias("n")), ["c_nationkey", "seg"])


# --- costs -----------------------------------------------------------------------------------------------------------

_PLAN = more_queries.WEIGHTS.replace("SELECT p_partkey AS edge_id, p_retailprice * 100 AS length_m, t.* FROM part JOIN t ON k = p_partkey % 11", "SELECT o_orderkey AS edge_id, o_totalprice AS length_m, t.* FROM orders JOIN t ON k = o_orderkey % 11")


@query(f"WITH {_PLAN} SELECT mode, CAST(month AS TINYINT) AS month, count(*) AS n, round(sum(CASE WHEN passable THEN cost END), 2) AS cost, round(avg(CASE WHEN passable THEN 1.0::DOUBLE ELSE 0 END), 6) AS open FROM c GROUP BY mode, month")
def multimodal_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as edges of all types: weights and costs of every edge in every month, about two million rows at the bench's scale."""
    e, stats = _typed_edges(spark, sf, "orders", "o_orderkey", F.col("o_totalprice"))
    # The mode is the type's, so the weights need not meet the costs that are made from them.
    modes = e.select("edge_id", costs.lookup(F.col("type"), costs.RATE_MODE).alias("mode")).hint("merge")
    rows = costs.edge_costs(costs.edge_month_weights(e, stats), e).join(modes, "edge_id")
    return rows.groupBy("mode", "month").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("passable"), F.col("cost_per_gallon"))), 2).alias("cost"), F.round(F.avg(F.when(F.col("passable"), 1.0).otherwise(0.0)), 6).alias("open"))


# --- networks and hubs -----------------------------------------------------------------------------------------------

# Chains of four points; those of even number are ice roads. Chains never meet, so a chain's number is its component.
_ROADS = """ch AS (SELECT *, id // 4 AS c, (id // 4) % 2 = 0 AS ice, CASE WHEN id % 4 = 0 OR id % 4 = 3 OR id + 1 NOT IN (SELECT id FROM pt) THEN 1 ELSE 2 END AS deg FROM pt WHERE id - id % 4 + 1 IN (SELECT id FROM pt))"""


@query(
    f"""WITH {D.POINTS}, {_ROADS}, f AS (SELECT * FROM ch WHERE ice AND deg = 1), t AS (SELECT * FROM ch WHERE NOT ice),
  d AS (SELECT a.c, a.id AS a, b.id AS b, {_DIST} AS gap, row_number() OVER (PARTITION BY a.c ORDER BY {_DIST}, a.id, b.id) AS k FROM f a, t b) SELECT a, b, round(gap, 4) AS gap FROM d WHERE k = 1"""
)
def cross_mode_connectors(spark: SparkSession, sf: str) -> DataFrame:
    p = D.points(spark, sf).select("id", "x", "y")
    e = p.where("id % 4 <> 3").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.when(F.expr("id div 4") % 2 == 0, "IceRoad").otherwise("Road").alias("type"))
    e = e.join(p.select(F.col("id").alias("b")), "b", "left_semi")
    return graph.cross_mode_connectors(e, p, "IceRoad", "Road").withColumn("gap", F.round("gap", 4))


@query(
    f"""WITH {D.FACILITIES}, r AS (SELECT record_id AS id, x, y, community_name AS community, delivery_method AS m FROM facility), b AS (SELECT s_suppkey AS id, s_acctbal * 10 AS x, (s_suppkey % 97) * 100.0::DOUBLE AS y, CASE s_suppkey % 9 WHEN 0 THEN 'machinery' WHEN 1 THEN 'Furniture.' ELSE 'Town ' || CAST(s_suppkey AS VARCHAR) END AS community, CASE s_suppkey % 2 WHEN 0 THEN 'Barge' ELSE 'Road' END AS method FROM supplier),
  n AS (SELECT CASE id % 9 WHEN 0 THEN 'MACHINERY' ELSE 'FURNITURE' END AS key, arg_min(method, id) AS method FROM b WHERE id % 9 < 2 GROUP BY 1),
  d AS (SELECT a.id, b.method, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM r a, b WHERE a.m IS NULL AND {_DIST} <= 500)
  SELECT r.id, coalesce(r.m, n.method, d.method) AS delivery_method, CASE WHEN r.m IS NOT NULL THEN 'record' WHEN n.method IS NOT NULL THEN 'name' WHEN d.method IS NOT NULL THEN 'nearest' END AS delivery_source
  FROM r LEFT JOIN n ON n.key = r.community LEFT JOIN d ON d.id = r.id AND d.k = 1"""
)
def delivery_fill(spark: SparkSession, sf: str) -> DataFrame:
    r = D.facilities(spark, sf).select(F.col("record_id").alias("id"), "x", "y", F.col("community_name").alias("community"), "delivery_method")
    k = F.col("s_suppkey")
    name = F.when(k % 9 == 0, "machinery").when(k % 9 == 1, "Furniture.").otherwise(F.concat(F.lit("Town "), k.cast("string")))
    b = D.table(spark, sf, "supplier").select(k.alias("id"), (F.col("s_acctbal") * 10).alias("x"), ((k % 97) * 100.0).alias("y"), name.alias("community"), F.when(k % 2 == 0, "Barge").otherwise("Road").alias("method"))
    return hubs.delivery_filled(r, b, 500.0).select("id", "delivery_method", "delivery_source")


@query(
    f"""WITH {D.POINTS}, o AS (SELECT id, x, y, id // 10 AS cluster, CASE WHEN id % 3 <> 0 THEN 'L' || CAST(id % 2 AS VARCHAR) END AS label FROM pt),
  n AS (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS k FROM o a JOIN o b ON a.cluster = b.cluster AND a.label IS NULL AND b.label IS NOT NULL),
  l AS (SELECT o.id, o.cluster, coalesce(o.label, n.label) AS label FROM o LEFT JOIN n ON n.id = o.id AND n.k = 1), g AS (SELECT DISTINCT cluster, label FROM l), s AS (SELECT *, row_number() OVER (ORDER BY cluster, label NULLS FIRST) AS site FROM g)
  SELECT l.id, s.site FROM l JOIN s ON s.cluster = l.cluster AND s.label IS NOT DISTINCT FROM l.label"""
)
def split_by_label(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    rows = D.points(spark, sf).select("id", "x", "y", F.expr("id div 10").alias("cluster"), F.when(k % 3 != 0, F.concat(F.lit("L"), (k % 2).cast("string"))).alias("label"))
    return hubs.split_by_label(rows).select("id", "site")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Barge or Road' ELSE 'Barge' END AS delivery_method, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'SYN-' || CAST(c_nationkey AS VARCHAR) END AS site_id FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 2 AND c_acctbal >= 0")
def sites_kept(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    how = F.when(k % 3 == 0, "Road and Barge or Mule").when(k % 3 == 1, "Barge").otherwise("Mule")
    c = D.table(spark, sf, "customer").select(k.alias("id"), F.when(k % 2 == 0, k.cast("double")).alias("site_id"), F.col("c_nationkey").alias("cluster"), F.regexp_replace(how, " and ", " or ").alias("delivery_method"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("total_capacity"), F.when(k % 5 == 0, "Pending_Review").otherwise("clean").alias("qc_status"))
    return hubs.sited(hubs.withheld(c)[0], ["Barge", "Road", "Plane"]).select("id", "delivery_method", "site_id")


@query(
    f"""WITH {D.POINTS}, {_OWN}, p AS (SELECT id, min(poly) AS place FROM h GROUP BY id), r AS (SELECT id, poly AS region FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, poly) AS k FROM d WHERE d <= 50000) WHERE k = 1),
  l AS (SELECT id, CASE id % 3 WHEN 0 THEN 'EAST' WHEN 1 THEN 'WEST' ELSE 'OTHER' END AS label FROM pt)
  SELECT l.id, place, region, coalesce(place, region) AS geo_label, CASE WHEN label = 'OTHER' THEN 'n/a' WHEN upper(place) = label THEN 'agree' WHEN upper(region) = label THEN 'neighbor' ELSE 'conflict' END AS name_match
  FROM l LEFT JOIN p ON p.id = l.id LEFT JOIN r ON r.id = l.id"""
)
def tagged_places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id") % 3
    f = D.points(spark, sf).select("id", "x", "y", F.when(k == 0, "east").when(k == 1, "West.").otherwise("other").alias("label"))
    named = shapes(spark).withColumn("name", F.col("poly"))
    return hubs.tagged(f, named, named, 10000.0, 50000.0).select("id", "place", "region", "geo_label", "name_match")


@query(
    f"""WITH RECURSIVE {D.POINTS}, road AS (SELECT id AS a, id + 1 AS b FROM pt WHERE id % 4 <> 3 AND id + 1 IN (SELECT id FROM pt)),
  small AS (SELECT a, b FROM road UNION ALL SELECT id, id + 4 FROM pt WHERE id % 20 IN (0, 4, 8, 12) AND id + 4 IN (SELECT id FROM pt)), {_CC},
  one AS (SELECT component FROM lab GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
  chain AS (SELECT id, id - id % 4 AS component FROM pt), big AS (SELECT component FROM chain GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)
  SELECT node FROM lab JOIN one USING (component) WHERE node NOT IN (SELECT id FROM chain JOIN big USING (component))"""
)
def mode_contribution(spark: SparkSession, sf: str) -> DataFrame:
    p = D.points(spark, sf).select("id")
    road = p.where("id % 4 <> 3").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit("Road").alias("type"))
    air = p.where("id % 20 in (0, 4, 8, 12)").select(F.col("id").alias("a"), (F.col("id") + 4).alias("b"), F.lit("Air").alias("type"))
    e = road.unionByName(air).join(p.select(F.col("id").alias("b")), "b", "left_semi")
    return graph.mode_contribution(p.select(F.col("id").alias("node")), e, "Air")


@query(
    f"""WITH {D.POINTS}, h AS (SELECT * FROM pt WHERE id % 11 = 0), g AS (SELECT * FROM pt WHERE id % 11 <> 0 AND id % 2 = 1),
  d AS (SELECT a.id, min({_DIST}) AS g, min({_DIST}) FILTER (b.id % 5 = 0) AS w FROM h a, g b GROUP BY a.id)
  SELECT id AS hub_id, CASE WHEN id % 3 = 0 THEN 'unplaced' ELSE 'disconnected' END AS problem, round(g / 1000, 2) AS giant_km, round(w / 1000, 2) AS water_km FROM d WHERE id % 3 <> 1 AND round(g / 1000, 2) <= 25"""
)
def hub_triage(spark: SparkSession, sf: str) -> DataFrame:
    p, k = D.points(spark, sf), F.col("id")
    h = p.where("id % 11 = 0").select(k.alias("hub_id"), "x", "y")
    n = p.where("id % 11 <> 0").select(k.alias("node"), "x", "y", (k % 2 == 1).alias("is_giant"), (k % 5 == 0).alias("wet"))
    # Hubs of one third have no node, of one a node of the largest component, of one another.
    one = n.agg(F.min(F.when(F.col("is_giant"), F.col("node"))), F.min(F.when(~F.col("is_giant"), F.col("node")))).first()
    snaps = h.select("hub_id", F.when(F.col("hub_id") % 3 == 1, F.lit(one[0])).when(F.col("hub_id") % 3 == 2, F.lit(one[1])).alias("node_id"))
    return hubs.triage(h, snaps, n, 25000.0)


# --- surfaces --------------------------------------------------------------------------------------------------------

_HORN = " + ".join(f"{w} * (c{a} - c{b})" for w, a, b in ((1, "pm", "mm"), (2, "pz", "mz"), (1, "pp", "mp")))
_HORN_Y = " + ".join(f"{w} * (c{a} - c{b})" for w, a, b in ((1, "mp", "mm"), (2, "zp", "zm"), (1, "pp", "pm")))
_AROUND = {"m": -1, "z": 0, "p": 1}


@query(
    f"""WITH {D.CELLS}, n AS (SELECT a.row, a.col, {", ".join(f"max(CASE WHEN b.col = a.col + {_AROUND[x]} AND b.row = a.row + {_AROUND[y]} THEN b.slope END) AS c{x}{y}" for x in "mzp" for y in "mzp")}
    FROM cell a JOIN cell b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col HAVING count(*) = 9)
  SELECT row, col, round(degrees(atan(sqrt(({_HORN}) * ({_HORN}) + ({_HORN_Y}) * ({_HORN_Y})) / (8 * 150.0::DOUBLE))), 6) AS slope FROM n"""
)
def slope_from_heights(spark: SparkSession, sf: str) -> DataFrame:
    c = D.cells(spark, sf)
    return surface.slope_degrees(c.select("row", "col", F.col("slope").alias("value"))).withColumn("slope", F.round("slope", 6))


_LAYER = "v AS (SELECT row, col, CAST(m AS INTEGER) AS month, slope + m AS value, CAST(lulc % 4 AS INTEGER) AS zone FROM cell, generate_series(1, 12) AS g(m) WHERE (row * 7 + col + m) % 5 <> 0)"


def _layer(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = D.cells(spark, sf)
    m = c.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).where("(row * 7 + col + month) % 5 <> 0")
    return m.select("month", "row", "col", (F.col("slope") + F.col("month")).alias("value")), c.select("row", "col", (F.col("lulc") % 4).alias("zone"))


@query("WITH p AS (SELECT p_partkey % 9 AS old, p_size % 9 AS new FROM part) SELECT old, count(*) AS n, round(count(*) FILTER (old = new) / count(*), 6) AS recall FROM p GROUP BY old")
def class_recall(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "part").select((F.col("p_partkey") % 9).alias("old"), (F.col("p_size") % 9).cast("long").alias("new"))
    return raster.recall(p).withColumn("recall", F.round("recall", 6))


@query("WITH p AS (SELECT p_partkey % 9 AS old, CAST(p_size % 9 AS BIGINT) AS new FROM part) SELECT old, new, count(*) AS n FROM p WHERE old <> new GROUP BY 1, 2 ORDER BY n DESC, old, new LIMIT 8")
def top_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    p = D.table(spark, sf, "part").select((F.col("p_partkey") % 9).alias("old"), (F.col("p_size") % 9).cast("long").alias("new"))
    return raster.disagreements(p, 8)


@query(f"WITH {D.CELLS}, m AS (SELECT row, col, CAST((row + col * y + lulc) % 3 AS INTEGER) AS value FROM cell, generate_series(1, 7) AS g(y)), n AS (SELECT row, col, value, count(*) AS n FROM m GROUP BY ALL) SELECT row, col, value FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, value) AS k FROM n) WHERE k = 1")
def mode_composite(spark: SparkSession, sf: str) -> DataFrame:
    c = D.cells(spark, sf).withColumn("y", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return raster.mode_composite(c.select("row", "col", ((F.col("row") + F.col("col") * F.col("y") + F.col("lulc")) % 3).cast("int").alias("value")))


@query(f"WITH {D.CELLS}, {_LAYER}, z AS (SELECT lulc % 4 AS region, count(*) AS n FROM cell GROUP BY 1) SELECT CAST(region AS INTEGER) AS region, month, round(k / n, 6) AS share FROM z JOIN (SELECT zone, month, count(*) AS k FROM v GROUP BY 1, 2) ON zone = region")
def open_share(spark: SparkSession, sf: str) -> DataFrame:
    cells, zones = _layer(spark, sf)
    return surface.open_share(cells, zones.withColumnRenamed("zone", "region")).withColumn("share", F.round("share", 6))


@query(f"WITH {D.CELLS}, {_LAYER} SELECT zone, month, count(*) AS n, min(value) AS lo, max(value) AS hi, median(value) AS mid FROM v GROUP BY 1, 2")
def zone_stats(spark: SparkSession, sf: str) -> DataFrame:
    return surface.zone_stats(*_layer(spark, sf))[0]


@query(f"WITH {D.CELLS}, {_LAYER}, z AS (SELECT zone, month, median(value) AS mid FROM v GROUP BY 1, 2) SELECT zone, month AS worst_month, mid AS worst FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY mid DESC, month) AS k FROM z) WHERE k = 1")
def zone_worst_month(spark: SparkSession, sf: str) -> DataFrame:
    return surface.zone_stats(*_layer(spark, sf))[1]


@query(f"WITH {D.CELLS}, {_LAYER} SELECT c.row, c.col, {', '.join(f'coalesce(bool_or(v.month = {m}), false) AS m{m}' for m in range(1, 13))} FROM cell c LEFT JOIN v ON v.row = c.row AND v.col = c.col WHERE c.lulc % 2 = 0 GROUP BY c.row, c.col")
def navigability(spark: SparkSession, sf: str) -> DataFrame:
    return surface.navigability(_layer(spark, sf)[0], D.cells(spark, sf).where("lulc % 2 = 0").select("row", "col"))


@query(
    f"""WITH {D.POINTS}, k AS (SELECT * FROM pt WHERE id % 4 = 0), t AS (SELECT * FROM pt WHERE id % 4 <> 0),
  d AS (SELECT a.id, b.v, {_DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {_DIST}, b.id) AS n FROM t a, k b),
  one AS (SELECT id, v FROM d WHERE n = 1 AND d <= 2000), far AS (SELECT id, median(v) AS v FROM d WHERE n <= 9 AND id NOT IN (SELECT id FROM one) GROUP BY id)
  SELECT id, round(v, 8) AS value, 2 AS tier FROM one UNION ALL SELECT id, round(v, 8), 3 FROM far"""
)
def fill_tiers(spark: SparkSession, sf: str) -> DataFrame:
    p = D.points(spark, sf)
    return raster.filled(p.where("id % 4 <> 0"), p.where("id % 4 = 0"), 2000.0, 9, 4000.0).withColumn("value", F.round("value", 8))


@query(
    f"""WITH {D.POINTS}, l AS (SELECT id, x, y, x + 700 AS ex, y + 100 * (label % 3) AS ey FROM pt WHERE id % 2 = 0), o AS (SELECT x AS x1, y AS y1, x + 500 AS x2, y + 400 AS y2 FROM pt WHERE id % 2 = 1),
  n AS (SELECT *, CAST(ceil(sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y)) / 75) AS INTEGER) AS n FROM l), p AS (SELECT id, n, x + (i + 0.5::DOUBLE) / n * (ex - x) AS x, y + (i + 0.5::DOUBLE) / n * (ey - y) AS y FROM (SELECT *, unnest(range(n)) AS i FROM n)),
  t AS (SELECT p.id, p.n, p.x, p.y, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - x1) * 500 + (y - y1) * 400) / 410000.0::DOUBLE)) AS t, x1, y1 FROM p, o),
  d AS (SELECT id, n, x, y, min(sqrt((x - x1 - t * 500) * (x - x1 - t * 500) + (y - y1 - t * 400) * (y - y1 - t * 400))) AS d FROM t GROUP BY ALL)
  SELECT id, round(count(*) FILTER (d <= 400) / count(*), 6) AS share FROM d GROUP BY id"""
)
def line_overlap(spark: SparkSession, sf: str) -> DataFrame:
    p = D.points(spark, sf)
    lines = p.where("id % 2 = 0").select("id", F.array(spatial.point(F.col("x"), F.col("y")), spatial.point(F.col("x") + 700, F.col("y") + 100 * (F.col("label") % 3))).alias("line"))
    others = p.where("id % 2 = 1").select(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 500).alias("x2"), (F.col("y") + 400).alias("y2"))
    return surface.line_overlap(lines, others, 400.0).select("id", F.round("share", 6).alias("share"))


__all__ = ["ORACLE_SQL", "QUERIES"]
