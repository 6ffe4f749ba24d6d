"""Operator 8: exact top-k inner-product search by dual cover trees.

Rows are dealt into blocks of about ``BLOCK`` rows, queries likewise; each pair of blocks is one task. It indexes both
sides by a cover tree (every node's points lie within its covering radius of its centre, children's radii shrink by
``SHRINK``) and walks pairs of nodes: centres' product plus what both radii can add bounds every product between
two nodes, and a pair is pruned if that is below the worst kth score of the query node. What is left is scored exactly. The
first block of rows is searched before the others: the kth score that a query has there is what rows of the other blocks must
reach, so they are pruned from the start and give out few rows. Blocks' results are merged per query. Every query meets every
row, in blocks, so the work is queries times rows less what is pruned. MOST_TASKS bounds the tasks, not what they search.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; vectors of
different lengths don't meet; equal vectors are ordered by id; rows that repeat an id are candidates each, a repeated query is asked
once (its smallest vector); components too large for exact scores in 64 bits are scored in whole numbers of any size, and a
score beyond a long counts as the nearest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwise.llm.common import materialise, table

K = 20
EVERY = 20
BLOCK = 8192
LEAF = 256
SHRINK = 0.7
#: A separated centre with fewer points is kept in a common leaf of its parent.
SMALL = 32
#: So many such centres, and one for each child, are tried in a node; then the points left go to common leaves too.
TRIES = 32
MOST_TASKS = 10_000


class Node:
    __slots__ = ("centre", "radius", "norm", "lo", "hi", "children")

    def __init__(self, centre: np.ndarray, radius: float, lo: int, hi: int) -> None:
        self.centre, self.radius, self.norm, self.lo, self.hi = centre, radius, float(np.sqrt(centre @ centre)), lo, hi
        self.children: list[Node] = []


class CoverTree:
    """``order`` lists the points so that each node's stand together from ``lo`` to ``hi``."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.order = x, []
        self.root = self._build(np.arange(len(x)), x.mean(0))
        self.order = np.array(self.order, np.int64)

    def _build(self, points: np.ndarray, centre: np.ndarray) -> Node:
        y = self.x[points] - centre
        d2 = np.einsum("ij,ij->i", y, y)
        radius, lo = float(np.sqrt(d2.max())), len(self.order)
        node = Node(centre, radius, lo, lo + len(points))
        if len(points) <= LEAF or radius == 0:
            self.order.extend(points.tolist())
            return node
        by_d = np.argsort(d2, kind="stable")
        scale, left, y, d2, loose, few = radius * SHRINK, points[by_d], y[by_d], d2[by_d], [], 0
        while len(left):
            # Centres are points farther than ``scale`` from those before. Products tell it: radii are measured anew in each child.
            near = d2 - 2 * (y @ y[0]) + d2[0] <= scale * scale
            near[0] = True
            if near.sum() < SMALL:
                loose.append(left[near])
                few += 1
            elif near.all() and len(left) == len(points):
                loose = [left[k : k + LEAF] for k in range(0, len(left), LEAF)]
                break
            else:
                node.children.append(self._build(left[near], self.x[left[0]]))
            left, y, d2 = left[~near], y[~near], d2[~near]
            if few > TRIES + len(node.children):
                # Points that lie apart from each other: to try them all takes the square of them and prunes nothing.
                loose.append(left)
                break
        if loose:
            rest = np.concatenate(loose)
            for k in range(0, len(rest), LEAF):
                some = rest[k : k + LEAF]
                mid, at = self.x[some].mean(0), len(self.order)
                self.order.extend(some.tolist())
                node.children.append(Node(mid, float(np.sqrt(((self.x[some] - mid) ** 2).sum(1)).max()), at, at + len(some)))
        return node


def _bound(q: Node, p: Node) -> float:
    top = float(q.centre @ p.centre) + q.norm * p.radius + p.norm * q.radius + q.radius * p.radius
    return top + 1e-6 * (1 + abs(top))


def top_k(qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, k: int = K, floor: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, row, score), the k best rows of each query, ties to smaller ids; a query's own id is left out.

    Rows that score less than a query's ``floor`` are left out too.
    """
    floor = np.full(len(qid), -np.inf) if floor is None else floor
    if not len(qid) or not len(pid):
        return []
    by_id = np.argsort(pid, kind="stable")
    pid, p = pid[by_id], p[by_id]
    width = len(pid)
    largest = q.shape[1] * (np.abs(q).max() if q.size else 0.0) * (np.abs(p).max() if p.size else 0.0)
    if not largest * width < 2.0**61 or largest >= 2.0**53:
        return _large(qid, q, pid, p, k, floor)
    qt, pt = CoverTree(q), CoverTree(p)
    q, qid, floor, place = q[qt.order], qid[qt.order], floor[qt.order], pt.order
    p, pid_at = p[place], pid[place]
    low = np.iinfo(np.int64).min
    best = np.full((len(q), k), low)
    # A key orders by score, then by smaller id: rows stand in the order of ids.
    worst = floor.copy()

    def score(a: Node, b: Node) -> None:
        s = q[a.lo : a.hi] @ p[b.lo : b.hi].T
        rows = np.flatnonzero(s.max(1) >= worst[a.lo : a.hi])
        if not len(rows):
            return
        s, at = s[rows].astype(np.int64), a.lo + rows
        keys = s * width + (width - 1 - place[b.lo : b.hi])[None, :]
        keys[(qid[at, None] == pid_at[None, b.lo : b.hi]) | (s < floor[at, None])] = low
        better = np.flatnonzero(keys.max(1) > best[at, 0])
        if len(better):
            at = at[better]
            both = np.concatenate([best[at], keys[better]], 1)
            best[at] = np.sort(np.partition(both, both.shape[1] - k, 1)[:, -k:], 1)
            kth = best[at, 0]
            worst[at] = np.maximum(floor[at], np.where(kth == low, -np.inf, kth // width))

    stack = [(np.inf, qt.root, pt.root)]
    while stack:
        bound, a, b = stack.pop()
        if bound < worst[a.lo : a.hi].min():
            continue
        if not a.children and not b.children:
            score(a, b)
            continue
        if b.children and (not a.children or b.radius >= a.radius):
            pairs = [(_bound(a, c), a, c) for c in b.children]
        else:
            pairs = [(_bound(c, b), c, b) for c in a.children]
        stack += sorted(pairs, key=lambda x: x[0])
    at = np.nonzero(best > low)
    keys = best[at]
    return list(zip(qid[at[0]].tolist(), pid[width - 1 - keys % width].tolist(), (keys // width).tolist(), strict=True))


def _large(qid: np.ndarray, q: np.ndarray, pid: np.ndarray, p: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, int]]:
    """``top_k`` without a tree, in Python's whole numbers: for components whose scores 64 bits can't hold."""
    whole = lambda x: [[int(v) for v in row] for row in x.tolist()]
    rows, out = whole(p), []
    for i, a, least in zip(qid.tolist(), whole(q), floor.tolist(), strict=True):
        scored = ((-max(LOW, min(HIGH, sum(x * y for x, y in zip(a, b, strict=True)))), j) for j, b in zip(pid.tolist(), rows, strict=True) if i != j)
        out += [(i, j, -s) for s, j in heapq.nsmallest(k, (x for x in scored if -x[0] >= least))]
    return out


LOW, HIGH = -(2**63), 2**63 - 1


def _vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("vec_id").to_numpy()
    flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, np.floor(64.0 * flat.astype(np.float64)).reshape(len(ids), -1 if len(ids) and len(flat) else 0)


def _pair(queries: pa.Table, rows: pa.Table) -> pa.Table:
    floor = queries.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy() if len(queries) else None
    found = top_k(*_vectors(queries), *_vectors(rows), floor=floor) if len(queries) and len(rows) else []
    cols = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])


def search(embeddings: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score for the queries among ``embeddings`` (ids divisible by EVERY)."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * 64) == float("inf")))
    rows = embeddings.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(~bad)
    rows = rows.withColumn("dim", F.size("v"))
    queries = rows.where(F.col("vec_id") % EVERY == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("s")).select("vec_id", "s.v", "s.dim")
    n, nq = embeddings.agg(F.count("*"), F.sum((F.col("vec_id") % EVERY == 0).cast("int"))).first()
    blocks, asked = max(1, -(-n // BLOCK)), max(1, -(-(nq or 0) // BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    schema = "query_id long, vec_id long, score long"

    def searched(some: DataFrame, first: int, stop: int) -> DataFrame:
        """What the queries ``some``, with their floors, find in the blocks from ``first`` to before ``stop``."""
        left = some.select("dim", "vec_id", "v", "floor", deal(asked).alias("q"), F.explode(F.sequence(F.lit(first), F.lit(stop - 1))).alias("b"))
        right = rows.withColumn("b", deal(blocks)).where(F.col("b").between(first, stop - 1)).select("dim", "vec_id", "v", "b", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("q"))
        # More tasks than pairs of blocks, so that few pairs share one; adaptive execution would join these small inputs.
        parts = min(4 * (stop - first) * asked, MOST_TASKS)
        # Columns of their own for both sides, which come from one table.
        left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]).repartition(parts, "dim", "q", "b") for x in (left, right))
        return left.groupBy("dim", "q", "b").cogroup(right.groupBy("dim", "q", "b")).applyInArrow(_pair, schema)

    found = materialise(searched(queries.withColumn("floor", F.lit(None).cast("long")), 0, 1))
    if blocks > 1:
        # A floor that a double can't hold exactly is none.
        floors = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= K)
        floors = floors.select(F.col("query_id").alias("vec_id"), F.when(F.abs("floor") < 1 << 53, F.col("floor")).alias("floor"))
        found = found.unionByName(searched(queries.join(floors, "vec_id", "left"), 1, blocks))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.e, p.e) AS BIGINT) AS score
      FROM v q, v p WHERE q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
