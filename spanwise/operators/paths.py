"""Cheapest paths over a graph in blocks of links.

A block is settled by itself for one source after the other; only nodes that blocks share, and whose cost fell, are told to
the blocks that have them. So a path takes as many rounds as it goes from block to block, however many links it has. What
blocks know lies in the folder that driver and executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.operators.ranking import numbered
from spanwise.sources.scratch import materialise, opened, removed, scratch, written

Batches = Iterator[pa.RecordBatch]


def _put(at: fs.FileSystem, path: str, values: np.ndarray) -> None:
    at.create_dir(path.rpartition("/")[0], recursive=True)
    with at.open_output_stream(path) as out:
        out.write(memoryview(np.ascontiguousarray(values)).cast("B"))


def _get(at: fs.FileSystem, path: str, kind: type) -> np.ndarray:
    with at.open_input_stream(path) as rows:
        return np.frombuffer(rows.read(), kind)


def _listed(at: fs.FileSystem, path: str) -> list[str]:
    return [x.base_name for x in at.get_file_info(fs.FileSelector(path, allow_not_found=True))]


def _table(at: fs.FileSystem, path: str) -> pa.Table | None:
    """All rows that Spark wrote to a folder; None if it isn't there."""
    return pq.read_table(path, filesystem=at, partitioning=None) if _listed(at, path) else None


def _blocks(root: str) -> Callable[[Batches], Batches]:
    """Writes a partition's links (u, v, cost) as a block, both ways and by the node they leave; gives its nodes (block, at, node)."""

    def run(batches: Batches) -> Batches:
        rows = list(batches)
        if not sum(b.num_rows for b in rows):
            return
        block, (at, path) = TaskContext.get().partitionId(), opened(root)
        links = pa.Table.from_batches(rows)
        ends = pa.chunked_array(links["u"].chunks + links["v"].chunks).combine_chunks().dictionary_encode()
        if isinstance(ends, pa.ChunkedArray):
            ends = ends.combine_chunks()
        leaves, m, nodes = ends.indices.to_numpy().astype(np.int32), links.num_rows, ends.dictionary
        order = np.argsort(leaves, kind="stable")
        _put(at, f"{path}/block/{block}/start", np.concatenate([[0], np.cumsum(np.bincount(leaves, minlength=len(nodes)))]).astype(np.int64))
        _put(at, f"{path}/block/{block}/to", np.concatenate([leaves[m:], leaves[:m]])[order])
        _put(at, f"{path}/block/{block}/cost", links["cost"].to_numpy()[np.where(order < m, order, order - m)])
        pq.write_table(pa.table({"node": nodes}), f"{path}/block/{block}/nodes", filesystem=at)
        where = pa.array(np.arange(len(nodes), dtype=np.int32))
        yield from pa.table({"block": pa.array(np.full(len(nodes), block, np.int32)), "at": where, "node": nodes}).to_batches(100_000)

    return run


def settle(dist: np.ndarray, fell: np.ndarray, start: np.ndarray, to: np.ndarray, cost: np.ndarray, step: float) -> None:
    """Lower ``dist`` in place until no link leads to less, from the nodes that ``fell``; those within ``step`` of the least go on together."""
    open_ = np.zeros(len(dist), bool)
    open_[fell] = True
    while (at := np.flatnonzero(open_)).size:
        have = dist[at]
        now = have <= have.min() + step
        at, have = at[now], have[now]
        open_[at] = False
        n = start[at + 1] - start[at]
        link = np.arange(n.sum()) + np.repeat(start[at] - np.cumsum(n) + n, n)
        new, node = np.repeat(have, n) + cost[link], to[link]
        less = new < dist[node]
        new, node = new[less], node[less]
        np.minimum.at(dist, node, new)
        open_[node] = True


def _settled(root: str, turn: int, groups: int, sources: int) -> Callable[[Batches], Batches]:
    """Tells a block's group of sources what the round before found; gives (node, src, dist) of shared nodes whose cost fell by that."""

    def run(batches: Batches) -> Batches:
        at, path = opened(root)
        for block, group in (divmod(x, groups) for b in batches for x in b.column(0).to_pylist()):
            told = _table(at, f"{path}/told/{turn}/block={block}")
            told = told and told.filter(pa.array(told["src"].to_numpy() % groups == group))
            if not told:
                continue
            start, to, cost = (_get(at, f"{path}/block/{block}/{x}", k) for x, k in (("start", np.int64), ("to", np.int32), ("cost", np.float64)))
            state, size = f"{path}/state/{block}-{group}", (len(range(group, sources, groups)), len(start) - 1)
            # A task that runs again finds what it found before: states of this round don't count, older ones stay for one round.
            turns = sorted(x for x in map(int, _listed(at, state)) if x < turn)
            dist = _get(at, f"{state}/{turns[-1]}", np.float64).reshape(size).copy() if turns else np.full(size, np.inf)
            for x in turns[:-1]:
                at.delete_file(f"{state}/{x}")
            shared = _table(at, f"{path}/shared/block={block}")
            places = shared["at"].to_numpy() if shared else np.zeros(0, np.int32)
            src, node, new = (told[x].to_numpy() for x in ("src", "at", "dist"))
            step = float(cost.mean()) * size[1] / len(cost)
            order = np.argsort(src, kind="stable")
            out = []
            for rows in np.split(order, np.flatnonzero(np.diff(src[order])) + 1):
                mine = dist[src[rows[0]] // groups]
                rows = rows[new[rows] < mine[node[rows]]]
                np.minimum.at(mine, node[rows], new[rows])
                was = mine[places]
                settle(mine, node[rows], start, to, cost, step)
                if (fell := np.flatnonzero(mine[places] < was)).size:
                    out.append((int(src[rows[0]]), fell, mine[places[fell]]))
            _put(at, f"{state}/{turn}", dist)
            for one, fell, values in out:
                yield from pa.table({"node": shared["node"].take(fell), "src": np.full(len(fell), one, np.int64), "dist": values}).to_batches(100_000)

    return run


def _found(root: str, named: str, groups: int, sources: int) -> Callable[[Batches], Batches]:
    """(src, dst, cost) of a block's group of sources, each node from the first block that has it."""

    def run(batches: Batches) -> Batches:
        at, path = opened(root)
        names = _table(*opened(named))
        names = names and names.sort_by("src")["node"].combine_chunks()
        for block, group in (divmod(x, groups) for b in batches for x in b.column(0).to_pylist()):
            state = f"{path}/state/{block}-{group}"
            if not (turns := _listed(at, state)):
                continue
            nodes = pq.read_table(f"{path}/block/{block}/nodes", filesystem=at, partitioning=None)["node"].combine_chunks()
            dist = _get(at, f"{state}/{max(map(int, turns))}", np.float64).reshape(-1, len(nodes))
            own = np.ones(len(nodes), bool)
            if shared := _table(at, f"{path}/shared/block={block}"):
                own[shared["at"].to_numpy()[~shared["own"].to_numpy()]] = False
            for src, mine in zip(range(group, sources, groups), dist):
                reached = np.flatnonzero(own & np.isfinite(mine))
                source = pa.DictionaryArray.from_arrays(np.full(len(reached), src, np.int64), names).dictionary_decode()
                yield from pa.table({"src": source, "dst": nodes.take(reached), "cost": mine[reached]}).to_batches(100_000)

    return run


def cheapest(links: DataFrame, sources: DataFrame, block: int, most: int = 64 << 20) -> DataFrame:
    """(src, dst, cost) from sources (node) to all that they reach over ``links`` (u, v, cost), which lead both ways.

    Blocks of about ``block`` links are ranges of the larger node. Sources are dealt into groups, so that few blocks still use
    all cores and a task's costs take ``most`` bytes, or are those of one source.
    """
    spark = links.sparkSession
    links, path = written(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("cost").cast("double").alias("cost")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v AND cost IS NOT NULL AND NOT isnan(cost)"))
    kind, root = links.schema["u"].dataType, scratch(spark)
    blocks = max(1, -(-links.count() // max(1, block)))
    nodes = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("node", kind)])
    held, held_at = written(links.repartitionByRange(blocks, "v", "u").mapInArrow(_blocks(root), nodes))
    removed(spark, path)
    many = held.groupBy("node").agg(F.count("*").alias("n"), F.min("block").alias("first")).where("n > 1")
    shared = materialise(held.join(many, "node").select("block", "at", "node", (F.col("block") == F.col("first")).alias("own")))
    shared.repartition("block").write.partitionBy("block").parquet(f"{root}/shared")
    named, named_at = written(numbered(sources.select(F.col("node").cast(kind)).where("node IS NOT NULL").distinct(), ["node"], "src").select("node", F.col("src").cast("long")))
    n = named.count()
    largest = held.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, min(n, max(-(-4 * spark.sparkContext.defaultParallelism // blocks), -(-n * largest * 8 // most))))
    tasks = spark.range(0, blocks * groups, 1, blocks * groups)
    told, turn = held.join(named, "node").select("block", "at", "src", F.lit(0.0).alias("dist")), 0
    fell = T.StructType([T.StructField("node", kind), T.StructField("src", T.LongType()), T.StructField("dist", T.DoubleType())])
    at, plain = opened(root)
    while True:
        told.repartition("block").write.partitionBy("block").parquet(f"{root}/told/{turn}")
        removed(spark, held_at if not turn else f"{root}/told/{turn - 1}")
        if not any(x.startswith("block=") for x in _listed(at, f"{plain}/told/{turn}")):
            break
        # Written before the join: adaptive execution would stop the tasks, which keep states, if no node is shared.
        found = materialise(tasks.mapInArrow(_settled(root, turn, groups, n), fell)).groupBy("node", "src").agg(F.min("dist").alias("dist"))
        told, turn = found.join(shared.hint("merge"), "node").select("block", "at", "src", "dist"), turn + 1
    out = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("cost", T.DoubleType())])
    return tasks.mapInArrow(_found(root, named_at, groups, n), out).where("src <> dst")
