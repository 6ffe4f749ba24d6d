"""Friction stacks, network steps and record tables on small hand-built cases."""

import math

import pytest
from pyspark.sql import functions as F

from spanwise.operators import graph, hubs, inventory, spatial, surface

LINE = "array<struct<x:double,y:double>>"
RINGS = f"array<{LINE}>"


def line(*p):
    return [{"x": float(x), "y": float(y)} for x, y in p]


def box(x0, y0, x1, y1):
    return [line((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def inputs(spark, river=((0, 1), (0, 2)), way=((0, 1), (0, 2), (1, 1))):
    static = spark.createDataFrame([(r, c, 1.0 + r, 0 if c == 0 else 2, 60.0 if r else 0.0) for r in range(2) for c in range(4)], "row long, col long, slope double, lulc int, permafrost double")
    cell = lambda rows: spark.createDataFrame(list(rows), "row long, col long")
    sea = spark.createDataFrame([(1, 0, 0, 90.0), (1, 1, 0, 10.0), (7, 0, 0, 0.0)], "month int, row long, col long, value double")
    ice = spark.createDataFrame([(1, 0, 1, 0.9), (2, 0, 1, 0.0), (12, 0, 2, 0.5)], "month int, row long, col long, value double")
    return surface.Inputs(static, sea, ice, cell(way), cell(river))


def test_stack(spark):
    i = inputs(spark)
    assert all(r.passed for r in surface.preflight(i).collect())
    tiers = {(r.month, r.row, r.col): (r.value, r.tier) for r in surface.filled_river_ice(i, 1000.0, 3, 500.0, (1, 7, 12)).collect()}
    assert tiers == {(1, 0, 1): (0.9, 1), (1, 0, 2): (0.9, 2), (7, 0, 1): (0.0, 1), (7, 0, 2): (0.0, 1), (12, 0, 2): (0.5, 1), (12, 0, 1): (0.5, 2)}
    rows = {(r.mode, r.month, r.row, r.col): r.value for r in surface.stack(i, months=(1, 7), cap=1000.0, k=3, start=500.0).collect()}
    assert ("overland", 0, 0, 0) not in rows and rows["overland", 0, 0, 1] == pytest.approx(1.15) and rows["overland", 0, 1, 1] == pytest.approx(1.4 * 1.15 * 1.3)
    assert rows["road_base", 0, 0, 0] == pytest.approx(1.0)
    # Sea ice shuts one cell in January, river ice both river cells; the waterway off the river stays open.
    assert {k[2:] for k in rows if k[:2] == ("barge", 1)} == {(1, 0), (1, 1)}
    assert {k[2:] for k in rows if k[:2] == ("barge", 7)} == {(0, 0), (1, 0), (0, 1), (0, 2), (1, 1)}
    with pytest.raises(ValueError, match="river cells are waterway cells"):
        surface.stack(inputs(spark, river=((1, 3),)))


def test_stack_checks(spark):
    cells = [("barge", m, 5, 5, 1.0) for m in range(1, 13)] + [("barge", m, 9, 9, 1.0) for m in (6, 7, 8)] + [("overland", 0, 5, 5, 1.2)]
    stack = spark.createDataFrame(cells, "mode string, month int, row long, col long, value double")
    port = lambda *rows: spark.createDataFrame(list(rows), "port string, row long, col long")
    got = {r.check: r.passed for r in surface.stack_checks(stack, port(("a", 6, 4)), port(("b", 9, 10)), 1).collect()}
    assert all(got.values()) and len(got) == 6
    got = {r.check: r.failures for r in surface.stack_checks(stack.withColumn("value", F.lit(0.5)), port(("b", 9, 9)), port(("a", 5, 5)), 1).collect()}
    assert got["ports open all months"] == 9 and got["seasonal ports shut in February"] == 1 and got["no value under 1"] == len(cells)


def test_slope_ice_and_zones(spark):
    plane = spark.createDataFrame([(r, c, 150.0 * c) for r in range(4) for c in range(4)], "row long, col long, value double")
    assert {(r.row, r.col): round(r.slope, 6) for r in surface.slope_degrees(plane).collect()} == {(r, c): 45.0 for r in (1, 2) for c in (1, 2)}
    water = spark.createDataFrame([(1, 0, 0, 0.4), (1, 0, 0, 0.2), (1, 0, 0, 1.5), (2, 0, 9, 0.5)], "month int, row long, col long, water double")
    zones = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 9, 2), (0, 12, 3)], "row long, col long, zone int")
    got = {(r.month, r.col): (round(r.p_ice, 6), r.provenance) for r in surface.river_ice(water, zones, 500.0, 2, 300.0).collect()}
    assert got == {(1, 0): (0.6, 1), (1, 1): (0.6, 2), (2, 9): (0.5, 1), (2, 12): (0.5, 3)}
    cells = spark.createDataFrame([(0, 0), (0, 1), (0, 9)], "row long, col long")
    polygons = spark.createDataFrame([(1, box(0, -150, 300, 0)), (2, box(150, -150, 300, 0))], f"poly long, rings {RINGS}")
    segments = spark.createDataFrame([(7, 0, 1300.0, 0.0, 1500.0, 0.0)], "line long, part int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.col, r.zone, r.corridor) for r in surface.zone_cells(cells, polygons, segments, 100.0, 0.0, 0.0).collect()}
    assert got == {(0, 1, False), (1, 2, False), (9, None, True)}


def test_marine_clip_overlap_and_windows(spark):
    polygons = spark.createDataFrame([(1, box(0, 0, 100, 100)), (2, box(200, 0, 300, 100)), (3, box(400, 0, 500, 100)), (4, box(600, 0, 700, 100))], f"poly long, rings {RINGS}")
    marine = spark.createDataFrame([(-50.0, 50.0, 150.0, 50.0), (220.0, 20.0, 240.0, 40.0), (400.0, 200.0, 500.0, 200.0)], "x1 double, y1 double, x2 double, y2 double")
    assert {r.poly for r in surface.marine_clipped(polygons, marine, 80.0).collect()} == {3, 4}
    lines = spark.createDataFrame([(1, line((0, 0), (300, 0))), (2, line((0, 5000), (75, 5000)))], f"id long, line {LINE}")
    others = spark.createDataFrame([(0.0, 10.0, 150.0, 10.0)], "x1 double, y1 double, x2 double, y2 double")
    assert {r.id: (r.share, r.length) for r in surface.line_overlap(lines, others, 20.0).collect()} == {1: (0.5, 300.0), 2: (0.0, 75.0)}
    cells = spark.createDataFrame([(r, c, 1.0 if (r, c) != (0, 0) else None) for r in range(5) for c in range(6)], "row long, col long, value double")
    assert tuple(surface.data_window(cells.where("row < 3 and col > 1")).first()) == (0, 2, 2, 5)
    assert surface.window(cells, 2, 2, 1).count() == 9 and surface.decimated(cells, 2).count() == 9
    p = surface.profile(cells).first()
    assert (p.cells, p.valid, p.rows, p.columns) == (30, 29, 5, 6)
    assert surface.grid_offset(0.0, 0.0, 300.0, -150.0) == (1, 2)
    with pytest.raises(ValueError, match="apart"):
        surface.grid_offset(0.0, 0.0, 10.0, 0.0)


def test_selection_and_places(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n long")
    assert [r.n for r in surface.selected(df, "name", ["a"], ["b"]).collect()] == [1]
    with pytest.raises(ValueError, match="not reviewed \\['b'\\], gone \\['c'\\]"):
        surface.selected(df, "name", ["a"], ["c"])
    assert surface.features(df, lambda d: d.where("n > 1")).count() == 1 and surface.features(df).count() == 2
    with pytest.raises(ValueError, match="rows only"):
        surface.features(df, lambda d: d.select("n"))
    places = spark.createDataFrame([(1, "K", box(0, 0, 10, 10)), (2, "K", box(100, 0, 110, 10))], f"poly long, key string, rings {RINGS}")
    regions = spark.createDataFrame([(1, "West", box(-50, -50, 50, 50)), (2, "East", box(60, -50, 150, 50))], f"poly long, name string, rings {RINGS}")
    assert [tuple(r) for r in surface.place_regions(places, regions, "key", 100.0).collect()] == [("K", "West")]
    limits = surface.shown_limits(spark.range(0, 1001).selectExpr("'t' AS type", "cast(id as double) AS v"), "type", "v").first()
    assert (limits.lo, limits.hi, limits.mid) == (5.0, 995.0, 500.0)


def test_airports_and_landings(spark):
    legs = spark.createDataFrame([(1, 0.0, 0.0, 5000.0, 0.0), (2, 77.0, 0.0, 9000.0, 0.0)], "leg long, ax double, ay double, bx double, by double")
    pts = lambda rows: spark.createDataFrame([(i, float(x), float(y)) for i, x, y in rows], "id long, x double, y double")
    got = {r.leg: (r.ax, r.ay, r.bx, r.by) for r in graph.airport_legs(legs, pts([(1, 0.5, 0), (2, 5000, 0), (3, 9000, 0)]), pts([(1, 100, 0), (2, 5000, 900), (3, 20000, 0)])).collect()}
    assert got == {1: (100.0, 0.0, 5000.0, 900.0), 2: (77.0, 0.0, 9000.0, 0.0)}
    extra = spark.createDataFrame([(1, line((500, 40), (500, 900))), (2, line((20, 30), (20, 900))), (3, line((0, 5000), (9, 5000)))], f"id long, line {LINE}")
    base = spark.createDataFrame([(7, line((0, 0), (1000, 0), (2000, 0)))], f"id long, line {LINE}")
    welded, cut = graph.landing_welds(extra, base)
    lines = {r.id: [(p.x, p.y) for p in r.line] for r in welded.collect()}
    assert lines == {1: [(500.0, 0.0), (500.0, 900.0)], 2: [(0.0, 0.0), (20.0, 900.0)], 3: [(0.0, 5000.0), (9.0, 5000.0)]}
    assert [(p.x, p.y) for p in cut.first().line] == [(0.0, 0.0), (500.0, 0.0), (1000.0, 0.0), (2000.0, 0.0)]


def test_network_reports(spark):
    nodes = spark.createDataFrame([(k,) for k in range(5)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    s = graph.summary(nodes, edges).first()
    assert (s.nodes, s.edges, s.components, s.largest, s.share) == (5, 2, 3, 3, 0.6)
    ids = spark.createDataFrame([(1,), (2,)], "edge_id long")
    weights = spark.createDataFrame([(1, m) for m in range(1, 13)] + [(2, 1), (9, 1)], "edge_id long, month int")
    assert {tuple(r) for r in graph.unweighted(ids, weights).collect()} == {(2, 1, False), (9, 1, True)}
    gaps = spark.createDataFrame([(1, 2, 9.0), (3, 4, 1.0)], "a long, b long, gap double")
    assert [r.gap for r in graph.by_gap(gaps).collect()] == [1.0, 9.0]
    state = lambda rows: spark.createDataFrame(rows, "hub_id string, is_giant boolean")
    got = {r.hub_id: r.state for r in hubs.rescued(state([("a", False), ("a", True), ("b", False), ("c", True)]), state([("a", True), ("b", True), ("d", False)])).collect()}
    assert got == {"a": "connected", "b": "rescued", "c": "lost", "d": "disconnected"}
    h = spark.createDataFrame([("h1", "Barge or Road", 1.0, 2.0), ("h2", "Road", 3.0, 4.0)], "hub_id string, delivery_method string, x double, y double")
    assert [tuple(r) for r in hubs.anchors_of(h, "Barge").collect()] == [("h1", 1.0, 2.0)]


def test_linkage_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 400, (120, 2)).round(0)
    points = spark.createDataFrame([(int(k), float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    label, live = np.arange(len(xy)), np.ones(len(xy), bool)
    while True:
        i, j = divmod(int(np.argmin(np.where(live[:, None] & live[None], d, np.inf))), len(xy))
        if d[i, j] > 60:
            break
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i], live[j] = np.inf, False
        label[label == j] = i
    assert {r.id: r.cluster for r in hubs.complete_linkage(points, 60.0).collect()} == dict(enumerate(label.tolist()))


def test_record_tables(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")
    got = {r.k: (r.m, r.there) for r in inventory.flagged(left, spark.createDataFrame([("a", 5)], "k string, m long"), "k", "there").collect()}
    assert got == {"a": (5, True), "b": (None, False)}
    with pytest.raises(ValueError, match="k repeats on the right: a"):
        inventory.flagged(left, spark.createDataFrame([("a", 5), ("a", 6)], "k string, m long"), "k", "there")
    status = spark.createDataFrame([("approved",), ("pending",), ("approved",)], "status string")
    log = spark.createDataFrame([("applied",), ("skipped-record-absent",)], "outcome string")
    queue = spark.createDataFrame([("high",), ("low",)], "severity string")
    rows = spark.createDataFrame([(60.0, -150.0, "clean"), (None, None, "pending_review")], "latitude double, longitude double, qc_status string")
    r = inventory.ledger_summary(status, log, queue, rows).first()
    assert (r.approved, r.pending, r.applied, r.absent, r.high, r.medium, r.records, r.located, r.clean, r.pending_review) == (2, 1, 1, 1, 1, 0, 2, 1, 1, 1)
    records = spark.createDataFrame([("1", "NOWHERE", "A", 0.0, 0.0), ("2", "NOWHERE", "B", 10.0, 0.0), ("3", "NOME", "A", 0.0, 0.0)], "record_id string, community_key string, code string, x double, y double")
    known = spark.createDataFrame([("NOME",)], "community_key string")
    places = spark.createDataFrame([("P1", 5.0, 3.0), ("P2", 5.0, 90.0), ("P3", 5.0, 900.0)], "name string, x double, y double")
    r = inventory.label_review(records, known, places, 1000.0, 50.0).first()
    assert (r.community_key, r.records, r.x, r.codes, r.nearest, r.nearest_m, r.second) == ("NOWHERE", 2, 5.0, "A;B", "P1", 3.0, "P2")


def test_polygons_are_found_by_growing_reach(spark):
    polygons = spark.createDataFrame([(1, box(0, 0, 10, 10)), (2, box(1000, 0, 1010, 10))], f"poly long, rings {RINGS}")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 400.0, 5.0), (3, 99999.0, 5.0), (4, 990.0, 5.0)], "id long, x double, y double")
    got = {r.id: (r.poly, r.dist) for r in spatial.nearest_polygon(points, polygons, 5000.0, 16.0).collect()}
    assert got == {1: (1, 0.0), 2: (1, 390.0), 4: (2, 10.0)} and math.isclose(got[4][1], 10.0)


def test_releases(spark, tmp_path):
    from spanwise.plans import release

    schema = [("record_id", "string"), ("name", "string"), ("latitude", "float"), ("longitude", "float")]
    mapping = [{"source_column": a, "schema_column": b, "type": "", "keep": "yes", "fold_into": ""} for a, b in (("id", "record_id"), ("n", "name"), ("lat", "latitude"), ("lon", "longitude"))]
    raw = lambda rows: spark.createDataFrame(rows, "id string, n string, lat string, lon string")
    one, two = raw([("a", "x", "60", "-150"), ("b", "y", None, None)]), raw([("a", "z", "60", "-150"), ("c", "y", None, None)])
    root = str(tmp_path)
    first = release.ingest(one, root, "2022", mapping, schema)
    assert (first["rows"], first["rows_with_coordinates"]) == (2, 1) and "diff_from" not in first
    second = release.ingest(two, root, "2025", mapping, schema)
    assert (second["diff_from"], second["removed"], second["added"], second["edited_beyond_jitter"]) == ("2022", 1, 1, 1)
    assert release.previous_diff(spark, root, "2022") is None and release.previous_diff(spark, root, "2025").count() == 3
    got = {(r.release, r.check): r.passed for r in release.checked(spark, root, mapping, schema, {"2022": one, "2025": one}).collect()}
    assert got == {("2022", "digest of the manifest"): True, ("2022", "made anew from the raw table"): True, ("2025", "digest of the manifest"): True, ("2025", "made anew from the raw table"): False}


def test_places_and_stitches(spark):
    from spanwise.sources import readers

    places = spark.createDataFrame([("OME", "Nome Airport", 1.0, 1.0), ("UNK", "Unalakleet Airport", 2.0, 2.0), ("KAL", "Kaltag Point Airport", 3.0, 3.0), ("ZZZ", "Nome International Airport", 9.0, 9.0)], "code string, name string, x double, y double")
    fixed = spark.createDataFrame([("Lost  Camp", 7.0, 7.0)], "name string, x double, y double")
    overrides = spark.createDataFrame([("The Beach", "ome")], "name string, code string")
    names = spark.createDataFrame([("lost camp",), ("The Beach",), ("UNK",), ("nome",), ("Unalakleet Airstrip",), ("Kaltag",), ("Nowhere",), (None,)], "name string")
    got = {r.name: (r.x, r.tier) for r in readers.matched_places(names, places, fixed, overrides).collect()}
    assert got == {"lost camp": (7.0, 1), "The Beach": (1.0, 2), "UNK": (2.0, 3), "nome": (1.0, 4), "Unalakleet Airstrip": (2.0, 5), "Kaltag": (3.0, 6), "Nowhere": (None, None), None: (None, None)}
    primary = spark.createDataFrame([(1, line((0, 0), (1000, 0)))], f"id long, line {LINE}")
    extra = spark.createDataFrame([(2, line((500, 300), (500, 9000))), (3, line((0, 7000), (9, 9000)))], f"id long, line {LINE}")
    got = {r.id: [(p.x, p.y) for p in r.line] for r in readers.road_stitches(primary, extra).collect()}
    assert got == {2: [(500.0, 300.0), (500.0, 0.0)]}


def test_optional_sources_and_long_reports(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from spanwise.sources import readers, writers

    (tmp_path / "a.csv").write_text("k,n\n1,x\n2,y\n")
    spec = [{"name": "a", "path": str(tmp_path / "a.csv"), "filter": "k = '1'", "rename": {"n": "m"}, "keep": ["m"]}, {"name": "b", "path": str(tmp_path / "no.csv"), "optional": True}]
    got = readers.normalised(spark, spec)
    assert [r.m for r in got["a"].collect()] == ["x"] and got["b"] is None
    with pytest.raises(AnalysisException):
        readers.normalised(spark, [{"name": "b", "path": str(tmp_path / "no.csv")}])
    with pytest.raises(AnalysisException):
        readers.normalised(spark, [{"name": "a", "path": str(tmp_path / "a.csv"), "filter": "zz = 1", "optional": True}])
    text = writers.report("R", {"t": spark.range(5)}, rows=3)
    assert "The first 3 rows." in text and "| 3 |" not in text


def test_profiles_and_gates(spark):
    from spanwise.plans import network

    anchors = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    table = {"node_tol": 1.0, "transfers": [{"anchors": "ports", "from_type": "Waterway", "to_type": "Road", "reach": 500}], "bridges": [["IceRoad", "Road", 100]], "welds": {"Road": 150.0}, "snap_types": ["Road"]}
    p = network.profile_of(table, {"ports": anchors})
    assert p.transfers[0].reach == 500.0 and p.bridges == (("IceRoad", "Road", 100.0),) and p.snap_types == ("Road",)
    with pytest.raises(ValueError, match="a profile has no speed"):
        network.profile_of({"speed": 1}, {})
    with pytest.raises(ValueError, match="no anchors ports"):
        network.profile_of(table, {})
    lines = spark.createDataFrame([(0, "Road", line((0, 0), (100, 50)))], f"line_id long, type string, line {LINE}")
    assert network.validated(p, lines) == ["no line of type IceRoad", "no line of type Waterway", "places look like degrees, not metres"]
    assert network.validated(network.Profile(node_tol=0.0, snap_types=("Road",)), lines.withColumn("line", F.transform("line", lambda q: F.struct((q["x"] * 100).alias("x"), q["y"].alias("y"))))) == ["node_tol is 0"]
    assert network.validated(p, lines.drop("line")) == ["lines lack line"]
    nodes = spark.createDataFrame([(1, True, True, "Hub_1+Hub_2"), (2, True, False, None), (3, False, True, "Hub_3")], "node_id long, is_giant boolean, is_hub boolean, hub_id string")
    edges = spark.createDataFrame([(1, 2, "Road"), (2, 9, "Air")], "from_node long, to_node long, type string")
    got = {r.check: r.passed for r in network.gates(nodes, edges, {"Road": 1, "Air": 2}, 0.6, ["Hub_2", "Hub_3"]).collect()}
    assert got == {"at least 1 of Road": True, "at least 2 of Air": False, "at least 0.6 of nodes in one component": True, "every edge has its nodes": False, "Hub_2 is on the largest component": True, "Hub_3 is on the largest component": False}
    assert tuple(network.hub_reach(nodes).first()) == (2, 1)
    assert {tuple(r) for r in graph.counts_by(nodes, edges).collect()} == {("is_giant", "true", 2), ("is_giant", "false", 1), ("type", "Road", 1), ("type", "Air", 1)}


def test_component_report_and_flips(spark):
    from spanwise.operators import raster

    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 20.0, 0.0), (4, 500.0, 0.0), (5, 620.0, 0.0)], "node long, x double, y double")
    edges = spark.createDataFrame([(1, 2, "Road"), (2, 3, "Air"), (4, 5, "Road")], "a long, b long, type string")
    hubs_on = spark.createDataFrame([(4,), (1,), (2,)], "node long")
    got = {r.component: (r.size, r.edges, r.modes, r.hubs, r.giant_m) for r in graph.component_report(nodes, edges, hubs_on).collect()}
    assert got == {1: (3, 2, "Air;Road", 2, 0.0), 2: (2, 1, "Road", 1, 480.0)}
    a = spark.createDataFrame([(0, 0, 1, 0.1), (0, 1, 1, 0.9)], "row long, col long, month int, value double")
    b = spark.createDataFrame([(0, 0, 1, 0.5), (0, 1, 1, 0.5), (0, 2, 1, 0.5)], "row long, col long, month int, value double")
    assert tuple(raster.flips(a, b).first()) == (1, 1, 2, 1)
