"""Graph operators on edge tables: components, connectors, typing, cheapest parallels, shortest paths, noding.

Iterations write each round to the shared folder; no graph is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions import geometry as G
from spanwise.operators import paths, spatial
from spanwise.operators.ranking import numbered
from spanwise.sources.scratch import materialise, removed, written

#: Tokens of line-haul types in names of connectors, in naming order.
TOKENS = {"Waterway": "Barge", "IceRoad": "IceRoad", "Air": "Air", "Road": "Road"}
ORDER = ("Barge", "IceRoad", "Air", "Road")


def _state(df: DataFrame) -> tuple:
    """Count and fingerprint of distinct rows; no sum, which overflows."""
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all of ``nodes`` (node) over ``edges`` (a, b).

    Stars in turn: every node's larger neighbours, then its smaller ones, are hung on the smallest neighbour, so long
    chains shrink by a power each round.
    """
    links, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    was = _state(links)
    while was[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, now_at = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # What the round was made from is read no more.
        removed(links.sparkSession, path)
        path, now = now_at, _state(links)
        if now == was:
            break
        was = now
    return nodes.select("node").distinct().join(links.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def ranked_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, size, is_giant): components numbered from 1 by size, equal ones by smallest node."""
    labels = materialise(components(nodes, edges))
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).withColumn("_order", -F.col("size"))
    order = numbered(sizes, ["_order", "component"], "rank", 1).select("component", "size", "rank")
    return labels.join(order, "component").select("node", F.col("rank").cast("long").alias("component"), "size", (F.col("rank") == 1).alias("is_giant"))


def mode_components(edges: DataFrame, mode: str) -> DataFrame:
    """Components of the nodes that edges (a, b, type) of one type touch."""
    own = edges.where(F.col("type") == mode)
    return components(own.select(F.explode(F.array("a", "b")).alias("node")), own)


def giant_of(labels: DataFrame) -> int | None:
    """The component with most nodes, equal ones by largest label (one value)."""
    row = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("component")).first()
    return row.component if row else None


def within_mode_welds(edges: DataFrame, xy: DataFrame, mode: str, tol: float, extra: DataFrame | None = None) -> DataFrame:
    """(a, b, gap): from each component of a mode but the largest, its closest pair to another one, at most ``tol`` apart."""
    own = edges.where(F.col("type") == mode).select("a", "b")
    linked = own if extra is None else own.unionByName(extra.select("a", "b"))
    labels = materialise(components(own.select(F.explode(F.array("a", "b")).alias("node")), linked).join(own.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"))
    giant = giant_of(labels)
    at = materialise(labels.join(xy, F.col("node") == F.col("id")).select("id", "x", "y", "component"))
    pairs = spatial.within(at.where(F.col("component") != F.lit(giant)), at, tol)
    side = lambda n: at.select(F.col("id").alias(f"{n}_id"), F.col("component").alias(f"{n}_c"))
    pairs = pairs.join(side("left"), "left_id").join(side("right"), "right_id").where("left_c <> right_c")
    best = pairs.groupBy("left_c").agg(F.min(F.struct("dist", "left_id", "right_id")).alias("m"))
    ends = best.select(F.least("m.left_id", "m.right_id").alias("a"), F.greatest("m.left_id", "m.right_id").alias("b"), F.col("m.dist").alias("gap"))
    return ends.distinct()


def cross_mode_connectors(edges: DataFrame, xy: DataFrame, from_mode: str, to_mode: str, start: float = 1000.0) -> DataFrame:
    """(a, b, gap): each component of one mode to its nearest node of the other, from loose ends if it has any."""
    labels = materialise(mode_components(edges, from_mode))
    degree = edges.where(F.col("type") == from_mode).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    rows = labels.join(degree, "node").withColumn("loose", F.max(F.col("deg") == 1).over(Window.partitionBy("component"))).where(~F.col("loose") | (F.col("deg") == 1))
    left = materialise(rows.join(xy, F.col("node") == F.col("id")).select("id", "x", "y", "component"))
    right = edges.where(F.col("type") == to_mode).select(F.explode(F.array("a", "b")).alias("id")).distinct().join(xy, "id").select("id", "x", "y")
    near = spatial.nearest(left, right, start).join(left.select(F.col("id").alias("left_id"), "component"), "left_id")
    best = near.groupBy("component").agg(F.min(F.struct("dist", "left_id", "right_id")).alias("m"))
    return best.select(F.col("m.left_id").alias("a"), F.col("m.right_id").alias("b"), F.col("m.dist").alias("gap"))


def connect_to_giant(xy: DataFrame, pairs: DataFrame, max_dist: float, water_from: int | None = None, road: DataFrame | None = None) -> DataFrame:
    """(a, b, gap, source): one connector from each other component to the nearest giant node within reach; one pass.

    ``a`` is the component's node. A giant node from number ``water_from`` on is water, and the connector a landing of a barge,
    on a road if ``road`` (node) holds ``a`` (all nodes do if it isn't given), else on ice; others are welds.
    """
    labels = materialise(components(xy.select(F.col("id").alias("node")), pairs))
    giant = giant_of(labels)
    at = materialise(labels.join(xy, F.col("node") == F.col("id")).select("id", "x", "y", "component"))
    rest, main = at.where(F.col("component") != F.lit(giant)), at.where(F.col("component") == F.lit(giant))
    if max_dist <= 0:
        near = spatial.within(rest, main, 1.0).where(F.lit(False))
    else:
        near = spatial.nearest_within(rest, main, max_dist)
    near = near.join(rest.select(F.col("id").alias("left_id"), "component"), "left_id")
    best = near.groupBy("component").agg(F.min(F.struct("dist", "left_id", "right_id")).alias("m"))
    best = best.select(F.col("m.left_id").alias("a"), F.col("m.right_id").alias("b"), F.col("m.dist").alias("gap"))
    best = best.withColumn("_road", F.lit(True)) if road is None else best.join(road.select(F.col("node").alias("a"), F.lit(True).alias("_road")).distinct(), "a", "left")
    shore = F.lit(False) if water_from is None else F.col("b") >= water_from
    landing = F.when(F.col("_road"), "shore:Barge↔Road").otherwise("shore:Barge↔IceRoad")
    return best.select("a", "b", "gap", F.when(shore, landing).otherwise("weld:to-giant").alias("source"))


def join_components(xy: DataFrame, pairs: DataFrame, max_dist: float) -> DataFrame:
    """All connectors of ``connect_to_giant``, repeated while the giant grows."""
    out = None
    while True:
        new = materialise(connect_to_giant(xy, pairs, max_dist))
        if new.isEmpty():
            return new if out is None else out
        out = new if out is None else materialise(out.unionByName(new))
        pairs = pairs.select("a", "b").unionByName(new.select("a", "b"))


def anchor_transfers(anchors: DataFrame, rules: list[tuple[int, DataFrame, DataFrame, float]]) -> DataFrame:
    """(a, b, rule): per rule (number, from nodes, to nodes, reach) and anchor the nearest of both, if both are in reach.

    A pair of nodes counts once over all rules: the first rule, then the smallest anchor, has it.
    """
    out = None
    for number, f, t, reach in rules:
        a = spatial.nearest_within(anchors, f, reach).select(F.col("left_id").alias("anchor"), F.col("right_id").alias("a"))
        b = spatial.nearest_within(anchors, t, reach).select(F.col("left_id").alias("anchor"), F.col("right_id").alias("b"))
        one = a.join(b, "anchor").where("a <> b").withColumn("rule", F.lit(number))
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("rule", "anchor")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("a", "b", "rule", "anchor")


def modes_at_nodes(edges: DataFrame, tokens: dict[str, str] = TOKENS) -> DataFrame:
    """(node, tokens): the sorted tokens of the line-haul edges (a, b, type) that touch a node."""
    token = F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv])[F.col("type")]
    ends = edges.where(F.col("type").isin(*tokens)).select(F.explode(F.array("a", "b")).alias("node"), token.alias("token"))
    return ends.groupBy("node").agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def classify_connectors(edges: DataFrame, tokens: dict[str, str] = TOKENS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """``edges`` (edge_id, a, b, type, source) with connectors typed by the modes at their ends; line-haul types stay.

    One mode gives its connector, two the transfer between them; of more, the pair that the source declares (``x:A→B``)
    or else the first two; none leaves the type. Typing twice changes nothing.
    """
    at = modes_at_nodes(edges, tokens)
    side = lambda n: at.select(F.col("node").alias(n), F.col("tokens").alias(f"t_{n}"))
    rows = edges.join(side("a"), "a", "left").join(side("b"), "b", "left")
    none = F.array().cast("array<string>")
    met = F.array_union(F.coalesce("t_a", none), F.coalesce("t_b", none))
    ranked = F.filter(F.array(*[F.lit(t) for t in order]), lambda t: F.array_contains(met, t))
    named = F.transform(F.split(F.regexp_extract("source", r":(.+)$", 1), "[→↔]"), lambda x: F.coalesce(F.create_map(*[F.lit(v) for kv in tokens.items() for v in kv])[x], x))
    declared = F.filter(F.array(*[F.lit(t) for t in order]), lambda t: F.array_contains(named, t))
    pick = F.when((F.size(ranked) > 2) & (F.size(declared) == 2), declared).otherwise(ranked)
    new = F.when(F.size(pick) == 1, F.concat(F.get(pick, 0), F.lit("Connector"))).when(F.size(pick) >= 2, F.concat(F.get(pick, 0), F.get(pick, 1), F.lit("Transfer"))).otherwise(F.col("type"))
    return rows.withColumn("type", F.when(F.col("type").isin(*tokens), F.col("type")).otherwise(new)).drop("t_a", "t_b")


def cheapest_parallel(edges: DataFrame, cost: str = "cost") -> DataFrame:
    """(u, v, cost): per unordered pair the cheapest passable edge with a cost."""
    ok = edges.where(F.col("passable") & F.col(cost).isNotNull() & ~F.isnan(cost))
    return ok.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min(cost).alias("cost"))


def _reached(adj: DataFrame, sources: DataFrame, rounds: int = 8, most: int = 500_000) -> DataFrame | None:
    """(node) all that ``adj`` (u, v) leads to from sources (node); None if that takes more rounds, or more than ``most`` nodes in one."""
    seen = front = materialise(sources.select("node").distinct())
    for _ in range(rounds):
        n = front.count()
        if not n:
            return seen
        if n > most:
            return None
        step = adj.join(F.broadcast(front), F.col("u") == F.col("node"), "left_semi").select(F.col("v").alias("node")).distinct()
        front = materialise(step.join(seen, "node", "left_anti"))
        seen = materialise(seen.unionByName(front))
    return None


def shortest_costs(pairs: DataFrame, sources: DataFrame, targets: DataFrame | None = None, block: int = 2_000_000) -> DataFrame:
    """(src, dst, cost): cheapest paths over ``pairs`` (u, v, cost) from sources (node) to other targets (node), or to all nodes.

    Pairs may repeat. Blocks of about ``block`` links are settled by themselves and tell each other what fell, see ``paths``.
    """
    best = paths.cheapest(pairs, sources, block)
    if targets is None:
        return best
    # By merge: the planner takes the costs for a few rows.
    return best.join(targets.select(F.col("node").alias("dst")).distinct().hint("merge"), "dst").select("src", "dst", "cost")


def chain_cost(legs: DataFrame, fees: DataFrame) -> DataFrame:
    """(chain, cost, changes): leg costs plus fees (mode_a, mode_b, fee) where the mode changes; a missing fee counts 0."""
    w = Window.partitionBy("chain").orderBy("leg")
    moved = legs.withColumn("before", F.lag("mode").over(w))
    key = F.array_sort(F.array("before", "mode"))
    fee = fees.select(F.array_sort(F.array("mode_a", "mode_b")).alias("_pair"), "fee")
    rows = moved.withColumn("_pair", F.when(F.col("before") != F.col("mode"), key)).join(fee, "_pair", "left")
    return rows.groupBy("chain").agg((F.sum("cost") + F.sum(F.coalesce("fee", F.lit(0.0)))).alias("cost"), F.count("_pair").alias("changes"))


def nodes_of(lines: DataFrame, tol: float) -> tuple[DataFrame, DataFrame]:
    """Node table (node, x, y) of rounded line ends, numbered by first use, and edges (edge_id, a, b); self-loops go.

    ``lines``: (edge_id, line), line an array of points.
    """
    grid = lambda p, k: (F.rint(p[k] / tol) * tol).alias(k)
    ends = lines.select("edge_id", F.posexplode(F.array(F.get("line", 0), F.element_at("line", -1))).alias("end", "p"))
    ends = materialise(ends.select("edge_id", "end", grid(F.col("p"), "x"), grid(F.col("p"), "y")))
    seen = ends.groupBy("x", "y").agg(F.min(F.struct("edge_id", "end")).alias("first"))
    nodes = materialise(numbered(seen.select("x", "y", "first.edge_id", "first.end"), ["edge_id", "end"], "node").select("node", "x", "y"))
    at = ends.join(nodes, ["x", "y"]).groupBy("edge_id").agg(F.max(F.when(F.col("end") == 0, F.col("node"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("node"))).alias("b"))
    return nodes, at.where("a <> b")


def vertex_edges(lines: DataFrame, tol: float) -> DataFrame:
    """(edge_id, seq, ax, ay, bx, by): one edge for each two following vertices that differ after rounding to ``tol``."""
    grid = lambda p, k: F.rint(p[k] / tol) * tol
    rows = lines.select("edge_id", F.posexplode(G.segments(F.col("line"))).alias("seq", "s"))
    rows = rows.select("edge_id", "seq", *[grid(F.col(f"s.{e}"), k).alias(f"{e}{k}") for e in "ab" for k in "xy"])
    return rows.where("ax <> bx or ay <> by")


def split_edges(edges: DataFrame, cuts: DataFrame) -> DataFrame:
    """(edge_id, seq, a, b, length): edges (edge_id, a, b, length) cut at (edge_id, at, node), ``at`` being the length from a."""
    stops = (
        edges.select("edge_id", F.lit(0.0).alias("at"), F.col("a").alias("node"))
        .unionByName(edges.select("edge_id", F.col("length").alias("at"), F.col("b").alias("node")))
        .unionByName(cuts.select("edge_id", "at", "node"))
    )
    w = Window.partitionBy("edge_id").orderBy("at", "node")
    rows = stops.withColumn("b", F.lead("node").over(w)).withColumn("to", F.lead("at").over(w)).withColumn("seq", F.row_number().over(w) - 1)
    return rows.where("b is not null and node <> b").select("edge_id", "seq", F.col("node").alias("a"), "b", (F.col("to") - F.col("at")).alias("length"))


def planar_noding(segments: DataFrame, side: float, digits: int = 3) -> DataFrame:
    """(seg, seq, ax, ay, bx, by): segments (seg, x1, y1, x2, y2) cut wherever they cross or touch another one.

    Segments meet in cells of ``side``; a pair that shares several cells counts once.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / side), F.floor(F.greatest(a, b) / side)))
    s = materialise(segments.withColumn("cx", cells("x1", "x2")).withColumn("cy", cells("y1", "y2")))
    o = s.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("seg", "x1", "y1", "x2", "y2")])
    dx, dy, ex, ey = (F.col(b) - F.col(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("o_x1", "o_x2"), ("o_y1", "o_y2")))
    det = dx * ey - dy * ex
    fx, fy = F.col("o_x1") - F.col("x1"), F.col("o_y1") - F.col("y1")
    t, u = (fx * ey - fy * ex) / F.nullif(det, F.lit(0.0)), (fx * dy - fy * dx) / F.nullif(det, F.lit(0.0))
    crossing = s.join(o, ["cx", "cy"]).where("seg <> o_seg").withColumn("t", t).withColumn("u", u).where("t between 0 and 1 and u between 0 and 1").select("seg", "t")
    # Ends of a parallel segment that lie on this one cut it too.
    ends = s.join(o, ["cx", "cy"]).where("seg <> o_seg").where(det == 0)
    on = []
    for x, y in (("o_x1", "o_y1"), ("o_x2", "o_y2")):
        args = [F.col(c) for c in (x, y, "x1", "y1", "x2", "y2")]
        on.append(ends.where(G.to_segment(*args) < 10.0**-digits).select("seg", G.place_on_segment(*args).alias("t")))
    cuts = crossing.unionByName(on[0]).unionByName(on[1])
    both = cuts.unionByName(segments.select("seg", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")))
    at = both.join(segments, "seg").select("seg", "t", F.round(F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1")), digits).alias("ax"), F.round(F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1")), digits).alias("ay"))
    at = at.groupBy("seg", "ax", "ay").agg(F.min("t").alias("t"))
    w = Window.partitionBy("seg").orderBy("t")
    out = at.withColumn("bx", F.lead("ax").over(w)).withColumn("by", F.lead("ay").over(w)).withColumn("seq", F.row_number().over(w) - 1)
    return out.where("bx is not null").select("seg", "seq", "ax", "ay", "bx", "by")


def smoothed(edges: DataFrame) -> DataFrame:
    """(a, b, length, parts): chains through nodes of degree two joined to one edge; edges are (edge_id, a, b, length)."""
    ends = edges.select("edge_id", F.explode(F.array("a", "b")).alias("node"))
    inner = ends.groupBy("node").agg(F.count("*").alias("deg"), F.min("edge_id").alias("a"), F.max("edge_id").alias("b")).where("deg = 2 and a <> b")
    chain = materialise(components(edges.select(F.col("edge_id").alias("node")), inner).select(F.col("node").alias("edge_id"), F.col("component").alias("chain")))
    rows = edges.join(chain, "edge_id")
    outer = rows.select("chain", F.explode(F.array("a", "b")).alias("node")).groupBy("chain", "node").agg(F.count("*").alias("n")).where("n = 1")
    tips = outer.groupBy("chain").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    sums = rows.groupBy("chain").agg(F.sum("length").alias("length"), F.count("*").alias("parts"), F.min("a").alias("any"))
    # A ring has no tips; it starts and ends at its smallest node.
    return sums.join(tips, "chain", "left").select(F.coalesce("a", "any").alias("a"), F.coalesce("b", "any").alias("b"), "length", "parts")


def airport_legs(legs: DataFrame, airports: DataFrame, roads: DataFrame, near: float = 1.0, reach: float = 2000.0) -> DataFrame:
    """Air ``legs`` (leg, ax, ay, bx, by) whose ends at an airport (id, x, y) move to the nearest road end (id, x, y) within ``reach``.

    An end is at an airport if it is at most ``near`` metres from one; an end without a road stays.
    """
    ends = legs.select("leg", F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit("b").alias("end"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select("leg", "e.*")
    ends = materialise(ends.withColumn("id", F.struct("leg", "end")))
    at = spatial.nearest_within(ends.select("id", "x", "y"), airports, near).select(F.col("left_id").alias("id"))
    moved = spatial.nearest_within(ends.join(at, "id", "left_semi").select("id", "x", "y"), roads, reach)
    place = roads.groupBy(F.col("id").alias("right_id")).agg(F.min(F.struct("x", "y")).alias("p"))
    new = moved.join(place, "right_id").select(F.col("left_id").alias("id"), F.col("p.x").alias("nx"), F.col("p.y").alias("ny"))
    rows = ends.join(new, "id", "left").select("leg", "end", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y"))
    side = lambda e, k: F.max(F.when(F.col("end") == e, F.col(k))).alias(f"{e}{k}")
    return rows.groupBy("leg").agg(side("a", "x"), side("a", "y"), side("b", "x"), side("b", "y"))


def landing_welds(extra: DataFrame, base: DataFrame, reach: float = 100.0, vertex: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """(extra lines, base lines) after ends of ``extra`` (id, line) moved onto base lines (id, line) at most ``reach`` away.

    An end takes the nearest vertex of the base line if that is within ``vertex`` of where it projects; else the base line gets a
    vertex there. So both lines share a vertex.
    """
    ends = extra.select("id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.get("line", 0).alias("p")), F.struct(F.lit(1).alias("end"), F.element_at("line", -1).alias("p")))).alias("e"))
    ends = materialise(ends.select(F.struct("id", "e.end").alias("id"), "e.p.x", "e.p.y"))
    parts = materialise(base.select(F.col("id").alias("line"), F.posexplode(G.segments(F.col("line"))).alias("part", "s")).select("line", "part", *[F.col(f"s.{e}.{k}").alias(f"{k}{n}") for n, e in ((1, "a"), (2, "b")) for k in "xy"]))
    near = spatial.nearest_line(ends, parts, reach).join(parts, ["line", "part"])
    along = lambda p, q: F.col(p) + F.col("t") * (F.col(q) - F.col(p))
    px, py = along("x1", "x2"), along("y1", "y2")
    near = near.withColumn("px", px).withColumn("py", py)
    d1, d2 = G.distance(F.col("px"), F.col("py"), F.col("x1"), F.col("y1")), G.distance(F.col("px"), F.col("py"), F.col("x2"), F.col("y2"))
    first = d1 <= d2
    keep = F.least(d1, d2) <= vertex
    x = F.when(keep, F.when(first, F.col("x1")).otherwise(F.col("x2"))).otherwise(F.col("px"))
    y = F.when(keep, F.when(first, F.col("y1")).otherwise(F.col("y2"))).otherwise(F.col("py"))
    hit = materialise(near.select("id", "line", "part", "t", x.alias("x"), y.alias("y"), (~keep).alias("new")))
    to = hit.groupBy(F.col("id.id").alias("_id")).agg(*[F.max(F.when(F.col("id.end") == e, F.struct("x", "y"))).alias(f"_p{e}") for e in (0, 1)])
    line = F.transform("line", lambda p, i: F.when((i == 0) & F.col("_p0").isNotNull(), F.col("_p0")).when((i == F.size("line") - 1) & F.col("_p1").isNotNull(), F.col("_p1")).otherwise(p))
    welded = extra.join(to, F.col("id") == F.col("_id"), "left").select("id", line.alias("line"))
    # New vertices come behind the vertex that begins their part, in the order along it; a place that repeats counts once.
    fresh = hit.where("new").groupBy("line", "part", "x", "y").agg(F.min("t").alias("t")).groupBy(F.col("line").alias("_line")).agg(F.array_sort(F.collect_list(F.struct("part", "t", "x", "y"))).alias("_new"))
    inserted = F.flatten(F.transform("line", lambda p, i: F.concat(F.array(p), F.transform(F.filter("_new", lambda v: v["part"] == i), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))))
    cut = base.join(fresh, F.col("id") == F.col("_line"), "left").select("id", F.when(F.col("_new").isNull(), F.col("line")).otherwise(inserted).alias("line"))
    return welded, cut


def by_gap(connectors: DataFrame) -> DataFrame:
    """Connectors (a, b, gap), the shortest first."""
    return connectors.orderBy("gap", "a", "b")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges, components, largest, share): one row about a network of nodes (node) and edges (a, b)."""
    sizes = components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    out = sizes.agg(F.sum("n").alias("nodes"), F.count("*").alias("components"), F.max("n").alias("largest"))
    return out.withColumn("share", F.col("largest") / F.col("nodes")).withColumn("edges", F.lit(edges.count()))


def component_report(nodes: DataFrame, edges: DataFrame, hubs: DataFrame, start: float = 1000.0) -> DataFrame:
    """(component, size, edges, modes, hubs, giant_m): per component of nodes (node, x, y) and edges (a, b, type) what it holds,
    how many hubs (node) stand on it, and how far its nearest node is from the largest component (0 for that one)."""
    at = materialise(ranked_components(nodes.select("node"), edges.select("a", "b")).join(nodes.select("node", "x", "y"), "node"))
    label = at.select(F.col("node").alias("a"), "component")
    inside = edges.join(label, "a").groupBy("component").agg(F.count("*").alias("edges"), F.array_join(F.array_sort(F.collect_set("type")), ";").alias("modes"))
    held = hubs.select("node").join(at.select("node", "component"), "node").groupBy("component").agg(F.count("*").alias("hubs"))
    point = lambda df: df.select(F.col("node").alias("id"), "x", "y")
    near = spatial.nearest(point(at.where("not is_giant")), point(at.where("is_giant")), start).join(at.select(F.col("node").alias("left_id"), "component"), "left_id").groupBy("component").agg(F.min("dist").alias("giant_m"))
    sizes = at.groupBy("component").agg(F.first("size").alias("size"), F.first("is_giant").alias("_giant"))
    out = sizes.join(inside, "component", "left").join(held, "component", "left").join(near, "component", "left")
    return out.select("component", "size", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("modes", F.lit("")).alias("modes"), F.coalesce("hubs", F.lit(0)).alias("hubs"), F.when(F.col("_giant"), 0.0).otherwise(F.col("giant_m")).alias("giant_m"))


def counts_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, value, n): nodes in and off the largest component, and edges by type."""
    a = nodes.groupBy(F.col("is_giant").cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("is_giant").alias("what"), "value", "n")
    return a.unionByName(edges.groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n")).select(F.lit("type").alias("what"), "value", "n"))


def unweighted(edges: DataFrame, weights: DataFrame, months: int = 12) -> DataFrame:
    """(edge_id, months, stray): edges without a weight for each month, and weights without an edge."""
    n = weights.groupBy("edge_id").agg(F.countDistinct("month").alias("months"))
    rows = edges.select("edge_id", F.lit(True).alias("_e")).join(n, "edge_id", "full_outer")
    return rows.where(F.col("_e").isNull() | (F.coalesce("months", F.lit(0)) != months)).select("edge_id", F.coalesce("months", F.lit(0)).alias("months"), F.col("_e").isNull().alias("stray"))


def mode_contribution(nodes: DataFrame, edges: DataFrame, mode: str) -> DataFrame:
    """(node): nodes that are in the largest component only because of a mode."""
    giant = lambda e: ranked_components(nodes, e).where("is_giant").select("node")
    return giant(edges).subtract(giant(edges.where(F.col("type") != mode)))


def month_map(costs: DataFrame) -> DataFrame:
    """(edge_id, months): map of month to (cost, passable)."""
    entry = F.struct("month", F.struct(F.col("cost_per_gallon").alias("cost"), "passable"))
    return costs.groupBy("edge_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("months"))


def inconsistent_connectors(edges: DataFrame, tokens: dict[str, str] = TOKENS) -> DataFrame:
    """Connectors whose type names a mode that neither end has: (edge_id, type, missing)."""
    at = modes_at_nodes(edges, tokens)
    side = lambda n: at.select(F.col("node").alias(n), F.col("tokens").alias(f"t_{n}"))
    rows = edges.where(~F.col("type").isin(*tokens)).join(side("a"), "a", "left").join(side("b"), "b", "left")
    none = F.array().cast("array<string>")
    met = F.array_union(F.coalesce("t_a", none), F.coalesce("t_b", none))
    rest = F.regexp_replace("type", "(Connector|Transfer)$", "")
    has = lambda t: F.contains(F.replace(rest, F.lit("IceRoad"), F.lit("#")), F.lit("#" if t == "IceRoad" else t))
    named = F.array_compact(F.array(*[F.when(has(t), t) for t in ORDER]))
    return rows.select("edge_id", "type", F.array_except(named, met).alias("missing")).where(F.size("missing") > 0)


def edge_class(kind: Column, source: Column) -> Column:
    """Types pass; a bridge is the connector of the mode its source names."""
    return F.when(kind == "Bridge", F.when(F.contains(source, F.lit("IceRoad")), "IceRoadConnector").otherwise("RoadConnector")).otherwise(kind)
