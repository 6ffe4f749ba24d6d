"""Queries that must take in all rows, against brute force over the smallest tables."""

import heapq
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from spanwise.operators import graph
from spanwise.plans.extra_queries import QUERIES


@pytest.fixture(scope="module")
def line_items(duck):
    """(supplier node, part node, length, passable) of every line item."""
    return duck.execute("SELECT l_suppkey, l_partkey + 1000000, CAST(round(l_extendedprice) AS BIGINT), l_discount < 0.08 FROM lineitem").fetchall()


def labels_of(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


def test_components_see_every_line_item(spark, line_items):
    want = labels_of([(a, b) for a, b, _, _ in line_items])
    assert {r.node: r.component for r in QUERIES["components_labels"](spark, SF).collect()} == want
    sizes = {}
    for c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    ranked = [n for _, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0]))]
    got = sorted(tuple(r) for r in QUERIES["component_sizes"](spark, SF).select("component", "size", "is_giant").collect())
    assert got == [(k, n, k == 1) for k, n in enumerate(ranked, 1)]


def test_shortest_paths_use_every_line_item(spark, duck, line_items):
    near = {}
    for a, b, length, passable in line_items:
        if passable:
            near.setdefault(a, []).append((b, length))
            near.setdefault(b, []).append((a, length))
    sources = [k for (k,) in duck.execute("SELECT min(s_suppkey) FROM supplier GROUP BY s_nationkey").fetchall() if k in near]
    want = {}
    for s in sources:
        best, heap = {s: 0}, [(0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if d == best[x]:
                for y, w in near[x]:
                    if d + w < best.get(y, 1 << 60):
                        best[y] = d + w
                        heapq.heappush(heap, (d + w, y))
        want |= {(s, x): float(d) for x, d in best.items() if x != s}
    assert {(r.src, r.dst): r.cost for r in QUERIES["shortest_path_costs"](spark, SF).collect()} == want


def made(spark, tmp_path, name, sql):
    """A folder with one table made by SQL."""
    spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_natural_sort_numbers_every_supplier(spark, tmp_path):
    sf = made(spark, tmp_path, "supplier", "SELECT 1201 - id AS s_suppkey FROM range(1, 1201)")
    assert {r.hub: r.k for r in QUERIES["natural_sort"](spark, sf).collect()} == {f"Hub_{k}": k for k in range(1, 1201)}


def test_typed_projection_keeps_long_keys(spark, tmp_path):
    sf = made(spark, tmp_path, "customer", "SELECT id AS c_custkey, 1.5D AS c_acctbal, 'A' AS c_mktsegment, 'n' AS c_name FROM VALUES (7), (99999), (123456) AS t(id)")
    assert {r.c_custkey: r.zip for r in QUERIES["typed_projection"](spark, sf).collect()} == {7: "00007", 99999: "99999", 123456: "123456"}


POINTS = "SELECT id AS vec_id, array(float(id % 25) / 4, float(id div 25) / 4, 0f) AS embedding, 0 AS label FROM range(0, 250)"


def test_every_point_is_noded_rasterised_and_in_a_blob(spark, tmp_path):
    sf = made(spark, tmp_path, "embeddings", POINTS)
    assert {r.seg for r in QUERIES["planar_noding"](spark, sf).select("seg").collect()} == set(range(250))
    assert {r.id: r.blob for r in QUERIES["buffer_blobs"](spark, sf).collect()} == {k: k for k in range(250)}
    cells = {tuple(r) for r in QUERIES["line_corridor_cells"](spark, sf).collect()}
    assert all(((50000 - y * 25000) // 150, (x * 25000 + 50000) // 150) in cells for x in range(25) for y in range(10))


# Rows of every month, which the planner takes for a twelfth of what they are.
@pytest.mark.parametrize("name", ["edge_month_weights", "passable_by_rate_mode", "navigability", "multimodal_costs", "edge_costs_all_types", "open_share", "weight_per_mile", "zone_stats"])
def test_monthly_rows_are_never_broadcast(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin \[(edge_id|row)", plan)


def test_states_of_many_links_never_overflow(spark):
    # 2^25 numbers of 40 bits summed up beyond 64 bits.
    links = spark.range(1 << 25).select("id", (F.col("id") + 1).alias("v"))
    assert graph._state(links)[0] == 1 << 25
    assert graph._state(links) != graph._state(links.where("id <> 7"))
