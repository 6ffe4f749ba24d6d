"""From lines, anchors and hubs to a connected, typed network: nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions import geometry as G
from spanwise.operators import graph, hubs
from spanwise.operators.ranking import numbered
from spanwise.sources.scratch import materialise


@dataclass(frozen=True)
class Transfer:
    """Anchors (id, x, y) that link the nearest nodes of two types, both within reach."""

    anchors: DataFrame
    from_type: str
    to_type: str
    reach: float


@dataclass(frozen=True)
class Profile:
    """What a build does, as data: tolerances in metres, transfers in order, welds and bridges by type."""

    node_tol: float = 1.0
    water_tol: float = 50.0
    water_type: str = "Waterway"
    transfers: tuple[Transfer, ...] = ()
    welds: dict[str, float] = field(default_factory=dict)
    bridges: tuple[tuple[str, str, float], ...] = ()
    join_reach: float = 0.0
    iterate_join: bool = False
    snap_types: tuple[str, ...] = ("Road",)
    snap_cap: float = 25000.0


def profile_of(table: dict, anchors: dict[str, DataFrame]) -> Profile:
    """A profile from plain data; transfers name their anchors. A key that no profile has is an error."""
    known = {f.name for f in fields(Profile)}
    stray = sorted(set(table) - known)
    if stray:
        raise ValueError(f"a profile has no {', '.join(stray)}")
    out = dict(table)
    transfers = []
    for t in out.get("transfers", ()):
        if t["anchors"] not in anchors:
            raise ValueError(f"no anchors {t['anchors']}")
        transfers.append(Transfer(anchors[t["anchors"]], t["from_type"], t["to_type"], float(t["reach"])))
    out["transfers"] = tuple(transfers)
    out["bridges"] = tuple((a, b, float(d)) for a, b, d in out.get("bridges", ()))
    if "snap_types" in out:
        out["snap_types"] = tuple(out["snap_types"])
    return Profile(**out)


def validated(profile: Profile, lines: DataFrame) -> list[str]:
    """What speaks against building ``lines`` with a profile: missing columns, types that no line has, tolerances that can't be, places that aren't metres."""
    missing = sorted({"line_id", "type", "line"} - set(lines.columns))
    if missing:
        return [f"lines lack {', '.join(missing)}"]
    have = {r.type for r in lines.select("type").distinct().collect()}
    named = {t for x in profile.transfers for t in (x.from_type, x.to_type)} | set(profile.welds) | {t for a, b, _ in profile.bridges for t in (a, b)} | set(profile.snap_types)
    out = [f"no line of type {t}" for t in sorted(named - have)]
    numbers = {"node_tol": profile.node_tol, "water_tol": profile.water_tol, **{f"weld {k}": v for k, v in profile.welds.items()}, **{f"bridge {a} {b}": d for a, b, d in profile.bridges}, **{f"transfer {k}": t.reach for k, t in enumerate(profile.transfers)}}
    out += [f"{k} is {v:g}" for k, v in numbers.items() if not v > 0]
    out += [f"{k} is {v:g}" for k, v in (("join_reach", profile.join_reach), ("snap_cap", profile.snap_cap)) if v < 0]
    vertex = lines.select(F.explode("line").alias("p"))
    far = vertex.agg(F.max(F.greatest(F.abs("p.x"), F.abs("p.y")))).first()[0]
    if far is not None and far <= 360:
        out.append("places look like degrees, not metres")
    return out


def _laid(lines: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): land lines between their ends, waterways between all their vertices; one node per rounded place."""
    water = lines.where(F.col("type") == profile.water_type)
    land = lines.where(F.col("type") != profile.water_type)
    grid = lambda p, k: F.rint(p[k] / profile.node_tol) * profile.node_tol
    first, last = F.get("line", 0), F.element_at("line", -1)
    ends = land.select("line_id", F.lit(0).alias("seq"), "type", grid(first, "x").alias("ax"), grid(first, "y").alias("ay"), grid(last, "x").alias("bx"), grid(last, "y").alias("by"), G.length(F.col("line")).alias("length"))
    wet = graph.vertex_edges(water.withColumnRenamed("line_id", "edge_id"), profile.water_tol).withColumnRenamed("edge_id", "line_id")
    wet = wet.select("line_id", "seq", F.lit(profile.water_type).alias("type"), "ax", "ay", "bx", "by", G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("length"))
    rows = materialise(ends.unionByName(wet).where("ax <> bx or ay <> by"))
    # Water nodes are never land nodes, even at the same place: landings are connectors.
    at = lambda e: rows.select((F.col("type") == profile.water_type).alias("wet"), F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y"), "line_id", "seq", F.lit("ab".index(e)).alias("end"))
    seen = at("a").unionByName(at("b")).groupBy("wet", "x", "y").agg(F.min(F.struct("line_id", "seq", "end")).alias("f"))
    nodes = materialise(numbered(seen.select("wet", "x", "y", "f.*"), ["wet", "line_id", "seq", "end"], "node").select("node", "wet", "x", "y"))
    side = lambda e: nodes.select(F.col("node").alias(e), (F.col("wet")).alias("wet"), F.col("x").alias(f"{e}x"), F.col("y").alias(f"{e}y"))
    edges = rows.withColumn("wet", F.col("type") == profile.water_type).join(side("a"), ["wet", "ax", "ay"]).join(side("b"), ["wet", "bx", "by"])
    return nodes, materialise(edges.select("line_id", "seq", "a", "b", "type", F.lit("").alias("source"), F.lit(None).cast("double").alias("gap"), "length"))


def _connectors(found: DataFrame, source: str) -> DataFrame:
    gap = F.col("gap") if "gap" in found.columns else F.lit(None).cast("double")
    own = F.col("source") if "source" in found.columns else F.lit(source)
    return found.select(F.lit(None).cast("long").alias("line_id"), F.lit(0).alias("seq"), "a", "b", F.lit("Bridge").alias("type"), own.alias("source"), gap.alias("gap"), F.coalesce(gap, F.lit(0.0)).alias("length"))


def build(lines: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``lines`` (line_id, type, line).

    Nodes: node_id, x, y, component (1 is the largest), is_giant. Edges: edge_id, from_node, to_node, type, source, join_gap_m,
    length_m. Order: base edges, transfers, welds within types, bridges between types, joins to the giant, then typing.
    """
    nodes, edges = _laid(lines, profile)
    xy = nodes.select(F.col("node").alias("id"), "x", "y")
    base = edges
    of = lambda t: xy.join(base.where(F.col("type") == t).select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    if profile.transfers:
        anchors = None
        rules = []
        for k, t in enumerate(profile.transfers):
            rules.append((k, of(t.from_type), of(t.to_type), t.reach))
            # Anchors of a rule are told apart by its number.
            one = graph.anchor_transfers(t.anchors, [rules[-1]])
            anchors = one if anchors is None else anchors.unionByName(one)
        pair = [F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]
        best = anchors.select("a", "b", "rule", "anchor", *pair).groupBy("u", "v").agg(F.min(F.struct("rule", "anchor", "a", "b")).alias("m"))
        edges = edges.unionByName(_connectors(best.select("m.a", "m.b"), "transfer"))
    for kind, tol in profile.welds.items():
        edges = edges.unionByName(_connectors(graph.within_mode_welds(base, xy, kind, tol), f"weld:{kind}"))
    for a, b, reach in profile.bridges:
        edges = edges.unionByName(_connectors(graph.cross_mode_connectors(base, xy, a, b).where(F.col("gap") <= reach), f"bridge:{a}→{b}"))
    edges = materialise(edges)
    if profile.join_reach > 0:
        if profile.iterate_join:
            new = graph.join_components(xy, edges.select("a", "b"), profile.join_reach)
        else:
            first_wet = nodes.where("wet").agg(F.min("node")).first()[0]
            road = base.where(F.col("type") == "Road").select(F.explode(F.array("a", "b")).alias("node"))
            new = graph.connect_to_giant(xy, edges.select("a", "b"), profile.join_reach, first_wet, road)
        edges = materialise(edges.unionByName(_connectors(new, "join")))
    typed = graph.classify_connectors(edges)
    order = ["line_id_", "seq", "a", "b", "source"]
    numbered_edges = numbered(typed.withColumn("line_id_", F.coalesce("line_id", F.lit((1 << 62) - 1))), order, "edge_id")
    out = numbered_edges.select("edge_id", F.col("a").alias("from_node"), F.col("b").alias("to_node"), "type", "source", F.col("gap").alias("join_gap_m"), F.col("length").alias("length_m"))
    ranked = graph.ranked_components(nodes.select("node"), edges)
    at = nodes.join(ranked, "node").select(F.col("node").alias("node_id"), "x", "y", "component", "is_giant")
    return at, out


def with_hubs(nodes: DataFrame, edges: DataFrame, hub_rows: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """(nodes with what stands on them, snaps): hubs (hub_id, n, x, y, capacity, delivery_method, hub_type) on the network."""
    kinds = edges.select(F.explode(F.array("from_node", "to_node")).alias("node"), "type").distinct()
    places = kinds.join(nodes.select(F.col("node_id").alias("node"), "x", "y"), "node")
    snaps = materialise(hubs.snapped(hub_rows, places, list(profile.snap_types), profile.snap_cap))
    held = hubs.merged_nodes(snaps, hub_rows)
    out = nodes.join(held, "node_id", "left").withColumn("is_hub", F.col("hub_id").isNotNull())
    return out, snaps


def hub_reach(nodes: DataFrame) -> DataFrame:
    """(hubs, in_giant): how many of the hubs that stand on nodes reach the largest component."""
    return nodes.where("is_hub").agg(F.count("*").alias("hubs"), F.count_if("is_giant").alias("in_giant"))


def gates(nodes: DataFrame, edges: DataFrame, least: dict[str, int], share: float, hubs: list[str]) -> DataFrame:
    """(check, passed, detail): a built network has at least so many edges per type, that share of nodes in one component, no loose edge, and these hubs on it."""
    n = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    rows = [(f"at least {k} of {t}", n.get(t, 0) >= k, str(n.get(t, 0))) for t, k in least.items()]
    total, giant = nodes.agg(F.count("*"), F.count_if("is_giant")).first()
    rows.append((f"at least {share:g} of nodes in one component", total > 0 and giant >= share * total, f"{giant} of {total}"))
    loose = edges.select(F.explode(F.array("from_node", "to_node")).alias("node_id")).join(nodes, "node_id", "left_anti").count()
    rows.append(("every edge has its nodes", loose == 0, f"{loose} ends without a node"))
    # Merged hubs share a node, their names joined by plus signs.
    on = {r.h for r in nodes.where("is_hub and is_giant").select(F.explode(F.split("hub_id", r"\+")).alias("h")).where(F.col("h").isin(*hubs)).distinct().collect()} if hubs else set()
    rows += [(f"{h} is on the largest component", h in on, "") for h in hubs]
    return nodes.sparkSession.createDataFrame(rows, "check string, passed boolean, detail string")


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, nodes, in_giant): how many nodes each type touches, and how many of these are in the giant."""
    ends = edges.select(F.explode(F.array("from_node", "to_node")).alias("node_id"), "type").distinct().join(nodes, "node_id")
    return ends.groupBy("type").agg(F.count("*").alias("nodes"), F.count_if("is_giant").alias("in_giant"))
