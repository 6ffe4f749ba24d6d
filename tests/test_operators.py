"""Operators on small hand-built cases."""

import heapq
import math
import random

import pandas as pd
from pyspark.sql import functions as F

from spanwise.functions import geometry as G
from spanwise.functions import scalars as S
from spanwise.functions.albers import ALASKA
from spanwise.operators import costs, graph, hubs, inventory, raster, spatial
from spanwise.sources import readers, writers


def pts(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], "id long, x double, y double")


def edges(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, type string")


def test_albers_round_trip_over_the_antimeridian(spark):
    c = spark.createDataFrame([(-150.0, 61.0), (173.0, 52.8), (-179.9, 51.5)], "lon double, lat double")
    x, y = ALASKA.forward(F.col("lon"), F.col("lat"))
    c = c.withColumn("px", x).withColumn("py", y)
    lon, lat = ALASKA.inverse(F.col("px"), F.col("py"))
    for r in c.select("lon", "lat", "px", lon.alias("l2"), lat.alias("p2")).collect():
        assert abs(r.lon - r.l2) < 1e-9 and abs(r.lat - r.p2) < 1e-9
    assert {r.px < 0 for r in c.where("lon > 0").collect()} == {True}


def test_canon_and_modes(spark):
    df = spark.createDataFrame([("St. Mary's",), ("Saint  Marys",), ("ST MARYS",), ("  ",), (None,)], "n string")
    assert [r[0] for r in df.select(S.canon(F.col("n"))).collect()] == ["ST MARYS", "ST MARYS", "ST MARYS", None, None]
    df = spark.createDataFrame([("Road or Barge, Road",), ("Mule",), (None,)], "n string")
    assert [r[0] for r in df.select(S.mode_text(S.modes_in(F.col("n")))).collect()] == ["Barge or Road", None, None]
    df = spark.createDataFrame([("Nome International Airport",), ("Seaplane Base",), ("Kaltag Airport Airport",)], "n string")
    assert [r[0] for r in df.select(S.base_name(F.col("n"))).collect()] == ["nome", "seaplane base", "kaltag"]


def test_typed(spark):
    df = spark.createDataFrame([("229.5", "7", " y ", "x"), ("", "99501", "?", "2024-02-01")], "i string, z string, b string, d string")
    got = df.select(S.typed(F.col("i"), "int"), S.typed(F.col("z"), "zip"), S.typed(F.col("b"), "bool"), S.typed(F.col("d"), "date").cast("string")).collect()
    assert [tuple(r) for r in got] == [(230, "00007", True, None), (None, "99501", None, "2024-02-01")]


def test_two_road_clusters_weld(spark):
    xy, e = pts(spark, [(0, 0, 0), (1, 50, 0), (2, 150, 0), (3, 200, 0)]), edges(spark, [(0, 1, "Road"), (2, 3, "Road"), (1, 2, "Waterway")])
    weld = lambda tol: [tuple(r) for r in graph.within_mode_welds(e, xy, "Road", tol).collect()]
    assert weld(150.0) == [(1, 2, 100.0)] == weld(100.0)
    assert weld(99.0) == []


def test_cross_mode_takes_the_loose_end(spark):
    xy = pts(spark, [(0, 0, 0), (1, 100, 0), (2, 0, 20), (3, 0, 60), (4, 900, 0), (5, 990, 0)])
    e = edges(spark, [(0, 1, "Road"), (2, 3, "IceRoad"), (4, 5, "IceRoad")])
    got = sorted(graph.cross_mode_connectors(e, xy, "IceRoad", "Road", 50.0).collect(), key=lambda r: r.gap)
    assert len(got) == 2 and got[0].gap == 20 and got[0].b == 0


def test_connect_to_giant(spark):
    xy = pts(spark, [(0, 0, 0), (1, 100, 0), (2, 150, 0), (3, 180, 0), (4, 280, 0), (5, 9000, 0)])
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    near = graph.connect_to_giant(xy, pairs, 100.0, 2).collect()
    assert [(r.a, r.b, r.source) for r in near] == [(3, 2, "shore:Barge↔Road")]
    ice = spark.createDataFrame([(4,)], "node long")
    assert [r.source for r in graph.connect_to_giant(xy, pairs, 100.0, 2, ice).collect()] == ["shore:Barge↔IceRoad"]
    assert [r.source for r in graph.connect_to_giant(xy, pairs, 100.0).collect()] == ["weld:to-giant"]
    assert graph.connect_to_giant(xy, pairs, 0.0).count() == 0
    assert graph.join_components(xy, pairs, 10000.0).count() == 2


def test_classify(spark):
    rows = [(0, 1, 2, "Road", ""), (1, 3, 4, "Waterway", ""), (2, 2, 3, "Bridge", ""), (3, 1, 2, "Bridge", ""), (4, 8, 9, "Bridge", ""), (5, 5, 2, "Air", ""), (6, 5, 6, "IceRoad", ""), (7, 5, 2, "Bridge", "bridge:IceRoad→Road")]
    e = spark.createDataFrame(rows, "edge_id long, a long, b long, type string, source string")
    got = {r.edge_id: r.type for r in graph.classify_connectors(e).collect()}
    assert got == {0: "Road", 1: "Waterway", 2: "BargeAirTransfer", 3: "AirRoadTransfer", 4: "Bridge", 5: "Air", 6: "IceRoad", 7: "IceRoadRoadTransfer"}


def test_paths_and_chains(spark):
    e = spark.createDataFrame([(1, 2, 5.0, True), (2, 1, 3.0, True), (2, 3, 4.0, True), (1, 3, 1.0, False), (8, 9, 1.0, True), (1, 3, float("nan"), True)], "a long, b long, cost double, passable boolean")
    p = graph.cheapest_parallel(e)
    nodes = spark.createDataFrame([(1,), (3,), (9,)], "node long")
    assert {(r.src, r.dst, r.cost) for r in graph.shortest_costs(p, nodes, nodes).collect()} == {(1, 3, 7.0), (3, 1, 7.0)}
    legs = spark.createDataFrame([(1, 1, "overland", 1.0), (1, 2, "barge", 2.0), (1, 3, "plane", 3.0)], "chain long, leg long, mode string, cost double")
    fees = spark.createDataFrame([("barge", "overland", 0.24)], "mode_a string, mode_b string, fee double")
    r = graph.chain_cost(legs, fees).first()
    assert math.isclose(r.cost, 6.24)


def test_noding_smoothing_and_split(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (2, 5.0, -5.0, 5.0, 5.0), (3, 20.0, 0.0, 30.0, 0.0)], "seg long, x1 double, y1 double, x2 double, y2 double")
    assert {r[0]: r[1] for r in graph.planar_noding(s, 4.0).groupBy("seg").count().collect()} == {1: 2, 2: 2, 3: 1}
    e = spark.createDataFrame([(0, 1, 2, 1.0), (1, 2, 3, 2.0), (2, 3, 4, 3.0), (3, 3, 5, 1.0)], "edge_id long, a long, b long, length double")
    assert {(r.a, r.b, r.length) for r in graph.smoothed(e).collect()} == {(1, 3, 3.0), (3, 4, 3.0), (3, 5, 1.0)}
    cuts = spark.createDataFrame([(0, 0.25, 9)], "edge_id long, at double, node long")
    assert {(r.a, r.b, r.length) for r in graph.split_edges(e.where("edge_id = 0"), cuts).collect()} == {(1, 9, 0.25), (9, 2, 0.75)}


def test_complete_linkage_and_labels(spark):
    p = pts(spark, [(0, 0, 0), (1, 10, 0), (2, 12, 0), (3, 5000, 0), (4, 55, 0)])
    assert {r.id: r.cluster for r in hubs.complete_linkage(p, 50.0).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    rows = spark.createDataFrame([(0, 0.0, 0.0, 1, "Atmautluak"), (1, 10.0, 0.0, 1, "Chefornak"), (2, 12.0, 0.0, 1, None), (3, 5000.0, 0.0, 2, "Atmautluak")], "id long, x double, y double, cluster long, label string")
    assert {r.id: r.site for r in hubs.split_by_label(rows).collect()} == {0: 1, 1: 2, 2: 2, 3: 3}


def test_snapping(spark):
    h = spark.createDataFrame([("Hub_1", 1, 0.0, 10.0, "Road", 10.0, "Receiver"), ("Hub_2", 2, 0.0, 20.0, "Barge", 20.0, "Supplier"), ("Hub_3", 3, 0.0, 90000.0, "Barge", 1.0, "Receiver"), ("Hub_4", 4, 0.0, 90000.0, "Plane", 1.0, "Receiver")], "hub_id string, n long, x double, y double, delivery_method string, capacity double, hub_type string")
    n = spark.createDataFrame([(0, "Road", 0.0, 0.0), (1, "Road", 1000.0, 0.0), (2, "Waterway", 0.0, 89500.0)], "node long, type string, x double, y double")
    snaps = hubs.snapped(h, n, ["Road"], 25000.0)
    assert {r.hub_id: (r.node_id, r.status) for r in snaps.collect()} == {"Hub_1": (0, "placed"), "Hub_2": (0, "merged:Hub_1"), "Hub_3": (2, "placed"), "Hub_4": (None, "unplaced:beyond_cap")}
    r = hubs.merged_nodes(snaps, h).where("node_id = 0").first()
    assert (r.hub_id, r.capacity, r.delivery_method, r.hub_type, r.n_hubs) == ("Hub_1+Hub_2", 30.0, "Barge or Road", "Supplier", 2)


def test_hub_types(spark):
    df = spark.createDataFrame([("m", float(c)) for c in (1, 2, 3, 4, 100)] + [("k", 500.0)] * 6, "delivery_method string, capacity double")
    got = hubs.supplier_or_receiver(df)
    assert sorted(r.capacity for r in got.where("delivery_method = 'm' and hub_type = 'Supplier'").collect()) == [100.0]
    assert got.where("delivery_method = 'k' and hub_type = 'Supplier'").count() == 6
    assert hubs.supplier_or_receiver(df, "jenks").where("delivery_method = 'm' and hub_type = 'Supplier'").count() == 2
    assert hubs.supplier_or_receiver(df, "absolute", 500.0).where("hub_type = 'Supplier'").count() == 6


def test_tagging_and_blobs(spark):
    box = lambda n, p, x0, x1: (p, n, [[{"x": x0, "y": 0.0}, {"x": x1, "y": 0.0}, {"x": x1, "y": 100.0}, {"x": x0, "y": 100.0}, {"x": x0, "y": 0.0}]])
    schema = "poly long, name string, rings array<array<struct<x:double,y:double>>>"
    places = spark.createDataFrame([box("Unalaska", 1, 0.0, 100.0), box("Nome", 2, 10000.0, 10100.0)], schema)
    regions = spark.createDataFrame([box("West", 1, -1.0, 5000.0), box("East", 2, 9000.0, 20000.0)], schema)
    f = spark.createDataFrame([(0, 50.0, 50.0, "Unalaska"), (1, 10050.0, 50.0, "Unalaska"), (2, 3000.0, 50.0, "Unalaska")], "id long, x double, y double, label string")
    got = {r.id: (r.name_match, r.region) for r in hubs.tagged(f, places, regions).collect()}
    assert got == {0: ("agree", "West"), 1: ("conflict", "East"), 2: ("neighbor", "West")}
    b = {r.id: r.blob for r in hubs.blobs(pts(spark, [(0, 0, 0), (1, 3000, 0), (2, 300000, 0)]), 5000.0).collect()}
    assert b == {0: 0, 1: 0, 2: 2}


def test_raster(spark):
    c = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, 7.0)], "row long, col long, value double")
    t = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 1.0), (3, 1.5, 1.0)], "id long, r double, c double")
    assert {r.id: r.value for r in raster.bilinear(t, c).collect()} == {1: 4.0, 2: 3.0, 3: None}
    line = spark.createDataFrame([(225.0, -225.0, 225.0, -226.0)], "x1 double, y1 double, x2 double, y2 double")
    assert {tuple(r) for r in raster.rasterised(line, 73.5, 0.0, 0.0).collect()} == {(1, 1)}
    assert {(1, 1), (0, 1), (1, 0), (2, 1), (1, 2)} == {tuple(r) for r in raster.rasterised(line, 76.0, 0.0, 0.0).collect()}
    grid = c.select("row", "col")
    assert {r.value for r in raster.padded(c, grid, 1, 1, 0.0).collect()} == {0.0, 1.0}
    k = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 100.0, 0.0, 7.0)], "id long, x double, y double, v double")
    got = {r.id: (r.value, r.tier) for r in raster.filled(pts(spark, [(1, 1, 0), (2, 50, 0)]), k, 10.0, 2, 10.0).collect()}
    assert got == {1: (5.0, 2), 2: (6.0, 3)}


def test_geometry(spark):
    line = spark.createDataFrame([([(0.0, 0.0), (100.0, 0.0), (100.0, 0.0), (100.0, 75.0)],)], "line array<struct<x:double,y:double>>")
    got = line.select(F.explode(G.densified(F.col("line"), 75.0)).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [(25.0, 0.0, 50.0), (75.0, 0.0, 50.0), (100.0, 37.5, 75.0)]
    near = spatial.nearest_line(pts(spark, [(1, 50, 100), (2, 50, 3000)]), spark.createDataFrame([(7, 0, 0.0, 0.0, 100.0, 0.0)], "line long, part int, x1 double, y1 double, x2 double, y2 double"), 2000.0).collect()
    assert [(r.id, r.line, r.t, r.dist) for r in near] == [(1, 7, 0.5, 100.0)]


def test_inventory(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k long, n string, v double")
    fixes = spark.createDataFrame([(1, "n", "a", "c", "approved", 1), (1, "n", "c", "d", "approved", 2), (2, "n", "x", "y", "approved", 3), (9, "n", "x", "y", "approved", 4), (2, "v", "2.0000001", "5", "approved", 5), (2, "zz", "1", "2", "approved", 6)], "k long, field string, old_value string, new_value string, status string, seq long")
    new, log = inventory.guarded_update(old, "k", ["n", "v"], fixes)
    assert sorted(map(tuple, new.collect())) == [(1, "d", 1.0), (2, "b", 5.0)]
    assert {r.seq: r.outcome for r in log.collect()} == {1: "applied", 2: "applied", 3: "skipped-old-value-mismatch", 4: "skipped-record-absent", 5: "applied", 6: "skipped-unknown-field"}
    ids = spark.createDataFrame([("r1", 5, 1, True), ("r2", 5, 2, True), ("r3", None, 3, True), ("r4", 9, 4, True), ("r5", 77, 5, False), ("r6", 41, 6, True)], "record_id string, own_id long, source_row long, located boolean")
    ledger = spark.createDataFrame([("r4", 40, "own"), ("zz", 41, "synthetic")], "record_id string, facility_id long, id_source string")
    assigned, problems = inventory.minted_ids(ids, ledger)
    assert {r.record_id: (r.facility_id, r.id_source, r.own_differs) for r in assigned.collect()} == {
        "r1": (5, "own", False), "r2": (5, "own", False), "r3": (78, "synthetic", False), "r4": (40, "ledger", True), "r5": (None, "unlocated", False), "r6": (79, "synthetic", False),
    }
    assert {tuple(r) for r in problems.collect()} == {("id of two records", 5), ("own id was minted for another record", 41)}


TH = {"shared_point_m": 1.0, "label_spread_km": 30.0, "typo_match_km": 3.0, "capacity_mismatch_gal": 1.0}


def test_detectors(spark):
    x, y = ALASKA.forward(F.col("longitude"), F.col("latitude"))
    rows = [("a", "NOME", 64.5, -165.4, 1, 7), ("b", "NOME", 64.5001, -165.4, 2, 7), ("c", "NOME", 65.5, -165.4, 3, 7), ("d", "ELIM", 64.5, -165.401, 1, 8)]
    df = spark.createDataFrame(rows, "record_id string, community_key string, latitude double, longitude double, tank_farm_id long, community_id long").withColumn("x", x).withColumn("y", y)
    diff = spark.createDataFrame([("a", "edited", "map_x", "1", "2"), ("b", "edited", "map_x", "1", "9"), ("c", "edited", "note", "x", None), ("d", "added", None, None, None), ("d", "edited", "last_edited", "1", "2")], "record_id string, change string, field string, old_value string, new_value string")
    flags = inventory.detected(df, TH, diff=diff)
    got = {(r.record_id, r.detector): r.severity for r in flags.collect()}
    assert got["c", "one_digit_typo"] == "high" and got["a", "shared_farm_id"] == "info" and got["d", "shared_farm_id"] == "high"
    assert got["b", "release_diff"] == "medium" and got["c", "release_diff"] == "info" and ("a", "release_diff") not in got and ("d", "release_diff") not in got
    order = [{"high": 0, "medium": 1, "low": 2, "info": 3}[r.severity] for r in flags.collect()]
    assert order == sorted(order)
    ran = {r.detector: (r.status, r.records_flagged) for r in inventory.detectors_run(df, flags, diff).collect()}
    assert ran["release_diff"] == ("ran", 2) and ran["map_point_disagrees"][0] == "skipped" and ran["one_digit_typo"] == ("ran", 1)


def test_exclusions_and_statuses(spark):
    import pytest

    df = spark.createDataFrame([("a", 377.0, "x"), ("b", 1.0, "y"), ("c", 2.0, "z")], "record_id string, tank_farm_id double, name string")
    rows = [("a", "exclude", "tank_farm_id=377", None, "approved", "r", "d", 1, "copy"), ("b", "exclude", "tank_farm_id=9", None, "approved", "r", "d", 2, "copy"), ("c", "exclude", None, None, "pending", "r", "d", 3, "x"), ("q", "exclude", None, None, "approved", "r", "d", 4, "gone")]
    fixes = spark.createDataFrame(rows, "record_id string, field string, old_value string, new_value string, status string, reviewer string, reviewed_on string, seq long, reason string")
    kept, excluded, log = inventory.without_excluded(df, inventory.checked_corrections(fixes))
    assert {r.record_id for r in kept.collect()} == {"b", "c"} and [(r.record_id, r.exclusion_reason) for r in excluded.collect()] == [("a", "copy")]
    assert {r.seq: r.outcome for r in log.collect()} == {1: "applied", 2: "skipped-old-value-mismatch", 4: "skipped-record-absent"}
    with pytest.raises(ValueError, match="unknown status"):
        inventory.checked_corrections(fixes.withColumn("status", F.lit("maybe")))
    with pytest.raises(ValueError, match="lack reviewer"):
        inventory.checked_corrections(fixes.drop("reviewer"))
    assert inventory.thresholds(spark.createDataFrame([("a", "2.5", "m")], "name string, value string, unit string")) == {"a": 2.5}


def test_landing_on_edges(spark):
    h = spark.createDataFrame([("Hub_1", 1, 500.0, 30.0, "Road"), ("Hub_2", 2, 500.0, -20.0, "Road"), ("Hub_3", 3, 0.5, 90.0, "Road"), ("Hub_4", 4, 700.0, 900.0, "Road")], "hub_id string, n long, x double, y double, delivery_method string")
    n = spark.createDataFrame([(0, "Road", 0.0, 0.0), (1, "Road", 1000.0, 0.0)], "node long, type string, x double, y double")
    e = spark.createDataFrame([(7, 0, 1, 0.0, 0.0, 1000.0, 0.0)], "edge_id long, a long, b long, ax double, ay double, bx double, by double")
    snaps = hubs.snapped(h, n, ["Road"], 10.0)
    assert {r.status for r in snaps.collect()} == {"unplaced:beyond_cap"}
    out, nodes, cuts = hubs.landed_on_edges(snaps, h, e, 100.0, 1.0, 50)
    assert {r.hub_id: (r.node_id, r.status) for r in out.collect()} == {"Hub_1": (50, "placed"), "Hub_2": (50, "merged:Hub_1"), "Hub_3": (0, "placed"), "Hub_4": (None, "unplaced:beyond_cap")}
    assert [tuple(r) for r in nodes.collect()] == [(50, 500.0, 0.0)] and [tuple(r) for r in cuts.collect()] == [(7, 500.0, 50)]
    parts = graph.split_edges(e.select("edge_id", "a", "b", F.lit(1000.0).alias("length")), cuts)
    assert {(r.a, r.b, r.length) for r in parts.collect()} == {(0, 50, 500.0), (50, 1, 500.0)}


def test_weights_and_checks(spark):
    n = spark.createDataFrame([(1,), (2,)], "node_id long")
    e = spark.createDataFrame([(0, 1, 2, "Road", 1.0), (1, 1, 3, "Air", 0.0)], "edge_id long, from_node long, to_node long, type string, length_m double")
    assert {r.check: r.passed for r in costs.network_checks(n, e).collect()} == {"node_id unique": True, "edge_id unique": True, "ends exist": False, "edge_id dense": True, "lengths positive": False}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,Lat,Lon\n1,61,-150\n2,,\n3,"60",-149\n')
    t = readers.text_table(spark, str(tmp_path / "a.csv"))
    assert readers.points(t).count() == 2
    df = spark.createDataFrame([(2, "b"), (1, None)], "id long, name string")
    a, b = writers.write_csv(df, str(tmp_path / "o1"), ["id"]), writers.write_csv(df.orderBy("name"), str(tmp_path / "o2"), ["id"])
    assert a == b and a != writers.digest(df.limit(1))
    df.write.parquet(str(tmp_path / "rel/release=2022"))
    df.limit(1).write.parquet(str(tmp_path / "rel/release=2025"))
    assert readers.releases(spark, str(tmp_path / "rel")) == ["2022", "2025"]
    assert readers.read_release(spark, str(tmp_path / "rel")).count() == 1 and readers.previous_release(spark, str(tmp_path / "rel"), "2025").count() == 2
    m = [{"source_column": "id", "schema_column": "key", "type": "int", "keep": "yes", "fold_into": ""}, {"source_column": "name", "schema_column": "", "type": "", "keep": "fold", "fold_into": "note"}]
    s = readers.snapshot(df.withColumn("x", F.lit(1)), readers.column_map(m, ["key", "note"]), [("key", "int"), ("note", "string")])
    assert s.columns == ["key", "note"] and s.where("note = 'b'").count() == 1
    writers.write_manifest(spark, str(tmp_path / "m"), {"n": 1})
    assert readers.manifest(spark, str(tmp_path / "m")) == {"n": 1}
    old = writers.report("R", {}, "").replace("<!-- feedback -->\n", "<!-- feedback -->\nkept\n")
    assert "kept" in writers.report("R", {"t": df}, old)


def test_network_build_to_hub_costs(spark):
    from spanwise.plans import multimodal, network

    line = lambda k, t, *p: (k, t, [{"x": float(x), "y": float(y)} for x, y in p])
    schema = "line_id long, type string, line array<struct<x:double,y:double>>"
    lines = spark.createDataFrame([line(0, "Road", (0, 0), (900, 0)), line(1, "Road", (1000, 0), (2000, 0)), line(2, "Waterway", (2000, 500), (3000, 500), (4000, 500)), line(3, "Road", (9000, 0), (9500, 0))], schema)
    anchors = spark.createDataFrame([(1, 2000.0, 250.0)], "id long, x double, y double")
    profile = network.Profile(transfers=(network.Transfer(anchors, "Road", "Waterway", 600.0),), welds={"Road": 150.0}, join_reach=6000.0)
    nodes, edges = network.build(lines, profile)
    kinds = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    assert kinds == {"Road": 3, "Waterway": 2, "RoadConnector": 1, "BargeRoadTransfer": 2}
    assert nodes.where("not is_giant").count() == 0 or {r.component for r in nodes.select("component").distinct().collect()} == {1}
    hub_rows = spark.createDataFrame([("Hub_1", 1, 10.0, 10.0, 5.0, "Road", "Receiver"), ("Hub_2", 2, 3990.0, 480.0, 9.0, "Barge", "Supplier")], "hub_id string, n long, x double, y double, capacity double, delivery_method string, hub_type string")
    nodes, snaps = network.with_hubs(nodes, edges, hub_rows, network.Profile(snap_cap=1000.0))
    assert {r.hub_id: r.status for r in snaps.collect()} == {"Hub_1": "placed", "Hub_2": "placed"}
    stats = costs.edge_months(edges.select("edge_id")).withColumn("avg_friction", F.lit(1.0)).withColumn("nodata_frac", F.lit(0.0))
    weights, edge_costs = multimodal.weights_and_costs(edges, stats)
    assert weights.count() == 12 * edges.count() and costs.incomplete(edge_costs).count() == 0
    got = {(r.src, r.dst): r.cost for r in multimodal.hub_costs(nodes, edges, edge_costs, 7).collect()}
    mile = 1609.344
    want = (900 + 100 + 1000) / mile * 0.0007 + 0.24 + 2000 / mile * 0.001
    assert len(got) == 2 and all(abs(c - want) < 1e-9 for c in got.values())
    assert set(multimodal.validation(weights)) == {"barge_by_month", "ice_road_by_month", "by_mode"}


def test_sampled_stats(spark):
    from spanwise.plans import multimodal

    e = spark.createDataFrame([(0, "Road", [{"x": 0.0, "y": -10.0}, {"x": 300.0, "y": -10.0}]), (1, "Air", [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}])], "edge_id long, type string, line array<struct<x:double,y:double>>")
    s = spark.createDataFrame([("road_base", None, 0, 0, 2.0), ("road_base", None, 0, 1, -9999.0)], "mode string, month int, row long, col long, value double")
    got = multimodal.sampled_stats(e, s, 0.0, 0.0).collect()
    assert len(got) == 12 and all((r.edge_id, r.avg_friction, r.nodata_frac) == (0, 2.0, 0.5) for r in got)


def test_quality_control_plan(spark):
    from spanwise.plans import quality_control

    schema = [("record_id", "string"), ("community_name", "string"), ("delivery_method", "string"), ("latitude", "float"), ("longitude", "float"), ("map_x", "float"), ("map_y", "float"), ("total_capacity", "float"), *[(f, "float") for f in inventory.FUELS], ("last_inspected", "string")]
    raw = spark.createDataFrame([("r1", "Nome", "Barge", "64.5", "-165.4", "5", "60", "40", "1850-01-01"), ("r2", "NOME", None, "10.0", "-165.4", "50", None, None, None)], "id string, name string, how string, lat string, lon string, cap string, gas string, diesel string, seen string")
    pairs = {"id": "record_id", "name": "community_name", "how": "delivery_method", "lat": "latitude", "lon": "longitude", "cap": "total_capacity", "gas": "gasoline_capacity", "diesel": "diesel_capacity", "seen": "last_inspected"}
    mapping = [{"source_column": a, "schema_column": b, "type": "", "keep": "yes", "fold_into": ""} for a, b in pairs.items()]
    fixes = spark.createDataFrame([("r1", "total_capacity", "5", "100", "approved", 1)], "record_id string, field string, old_value string, new_value string, status string, seq long")
    aliases = spark.createDataFrame([("x", "y")], "variant string, canonical string")
    p = quality_control.publish(raw, mapping, schema, fixes, aliases, TH, ["total_capacity"])
    rows = {r.record_id: r for r in p.rows.collect()}
    assert rows["r1"].total_capacity == 100.0 and rows["r1"].capacity_status == "ok" and rows["r1"].community_key == "NOME" and rows["r1"].map_x is None
    flags = {(r.record_id, r.detector) for r in p.flags.collect()}
    assert ("r2", "alaska_envelope") in flags and ("r1", "placeholder_inspection_date") in flags and ("r2", "missing_fields") in flags
    assert {r.record_id for r in p.queue.collect()} == {"r2"} and rows["r2"].qc_status == "pending_review" and rows["r1"].qc_status == "clean"
    assert rows["r1"].last_inspected is None and rows["r1"].corrections_applied == "total_capacity" and rows["r1"].coordinate_source == "publisher"
    assert all(r.passed for r in p.checks.collect())


def test_blobs_link_cells_and_not_all_pairs(spark, monkeypatch):
    rows = [(k, (k % 40) * 900.0 if k % 40 < 20 else 50000.0 + (k % 40) * 1300.0, 0.5 * (k % 3)) for k in range(800)] + [(900, float("nan"), 0.0)]
    seen = []
    plain = graph.components
    monkeypatch.setattr(graph, "components", lambda nodes, links: seen.append(links.count()) or plain(nodes, links))
    got = {r.id: r.blob for r in hubs.blobs(pts(spark, rows), 600.0).collect()}
    assert got == {k: (0 if k % 40 < 20 else k % 40) for k in range(800)} | {900: 900}
    # 40 places of 20 points each: their pairs are 83,600.
    assert seen[0] < 40


def test_complete_linkage_in_rounds_and_of_stacked_points(spark, monkeypatch):
    spots = [((k * 37) % 12 * 1.0, (k * 61) % 11 * 1.0 + (k % 3) * 0.25) for k in range(90)]
    rows = [(k, *spots[k % 90]) for k in range(180)]
    pairs = [(a, b, math.hypot(p - r, q - s)) for a, p, q in rows for b, r, s in rows if a < b and math.hypot(p - r, q - s) <= 3.0]
    want = {r.id: r.cluster for r in hubs._agglomerate(pd.DataFrame(pairs, columns=["a", "b", "dist"])).itertuples()}
    seen = []
    plain = hubs.spatial.within
    monkeypatch.setattr(hubs.spatial, "within", lambda a, b, r: seen.append(a.count()) or plain(a, b, r))
    for alone in (0, 1_000_000):
        assert {r.id: r.cluster for r in hubs.complete_linkage(pts(spark, rows), 3.0, alone).collect()} == want
    assert max(seen) <= 90


def test_shortest_costs_leave_out_what_no_source_reaches(spark):
    # Two short runs, of which one holds the source, and a long one.
    links = [(k, k + 1, 1.0) for k in (*range(4), *range(10, 14), *range(100, 112))]
    pairs = spark.createDataFrame(links, "u long, v long, cost double")
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "node long")
    everywhere = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    assert {r.node for r in graph._reached(pairs.union(pairs.select("v", "u", "cost")), ids(0)).collect()} == {0, 1, 2, 3, 4}
    assert graph._reached(pairs, ids(100)) is None
    for source, n in ((0, 4), (100, 12)):
        got = {(r.src, r.dst): r.cost for r in graph.shortest_costs(pairs, ids(source), everywhere, 0).collect()}
        assert got == {(source, source + k): float(k) for k in range(1, n + 1)}


def test_long_ways_take_few_rounds(spark):
    # A round per link would start a few jobs per link.
    pairs = spark.createDataFrame([(k, k + 1, 1.0) for k in range(60)], "u long, v long, cost double")
    nodes = spark.range(61).withColumnRenamed("id", "node")
    spark.sparkContext.setJobGroup("long ways", "")
    got = {r.dst: r.cost for r in graph.shortest_costs(pairs, nodes.where("node = 0"), nodes, 30).collect()}
    spark.sparkContext.setJobGroup("other", "")
    assert got == {k: float(k) for k in range(1, 61)}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("long ways")) < 120


def test_shortest_costs_over_blocks_equal_dijkstra(spark):
    # Named nodes, parallel links, links without cost, of no cost, to the same node and to none; two parts that don't meet.
    rnd = random.Random(5)
    name = lambda k: f"n{k}"
    links = [(rnd.randrange(40) + 40 * side, rnd.randrange(40) + 40 * side, float(rnd.choice((0, 1, 5, 9, 40)))) for side in (0, 1) for _ in range(90)]
    odd = [("n0", "n79", None), ("n0", "n78", float("nan")), ("n1", None, 0.0)]
    pairs = spark.createDataFrame([(name(u), name(v), c) for u, v, c in links] + odd, "u string, v string, cost double")
    want = {}
    for s in range(0, 40, 8):
        best, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            for u, v, c in links:
                for a, b in ((u, v), (v, u)):
                    if a == x and d + c < best.get(b, math.inf):
                        best[b] = d + c
                        heapq.heappush(heap, (d + c, b))
        want |= {(name(s), name(x)): d for x, d in best.items() if x != s}
    sources = spark.createDataFrame([(name(k),) for k in (*range(0, 40, 8), 999)], "node string")
    got = [((r.src, r.dst), r.cost) for r in graph.shortest_costs(pairs, sources, None, 60).collect()]
    assert len(got) == len(want) and dict(got) == want
