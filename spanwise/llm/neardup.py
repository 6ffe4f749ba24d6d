"""Operator 4: near duplicates by HyperMinHash.

A text's set is its distinct word shingles (64-bit hashes). The sketch has ``REGISTERS`` buckets; each keeps of its smallest
hash the count of leading zeros and ``MANTISSA`` bits after them, 16 bits in all. An empty bucket borrows the register of
the first filled one in a probing order of its own, so small sets fill all registers with the same law. Bands of
``ROWS`` registers give candidates: texts with Jaccard similarity 0.8 share none of the 32 bands once in 10^7.

Equal sets are one class from the start (grouped by a 128-bit digest of the set); classes are numbered as they are written.
In each band, classes are paired with the smallest one of the band only (a star); what is linked joins one component. Only in
bands where several components are left beside that hub could pairs still link something: of their members, those outside the
largest component are compared with all, block by block inside one function that gives out the links that join
components, so no pair that isn't a link becomes a row and no link is lost. All pairs go through the sketches' Jaccard
estimate, corrected for registers that collide by chance, and then through the full sets of 64-bit shingle hashes.
Components are made by alternating stars.

Defined cases: a text without words (null, empty, white space) has no set, links with nothing and is kept; rows without
doc_id link with nothing and are kept; each row is a document of its own: rows that repeat a doc_id with other texts stand in the
components of their texts, rows that repeat both are exact copies, of which ``kept_documents`` keeps one (any of
them, if other columns differ); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.common import materialise, released, removed, slices, spread, table, unused, written

#: Words of a shingle; the query takes four.
WIDTH = 5
PERCENT = 80
BUCKET_BITS = 7
REGISTERS = 1 << BUCKET_BITS
MANTISSA = 10
ROWS = 4
#: Candidates whose estimate is under the threshold by more than this are dropped: over seven standard deviations.
MARGIN = 0.3
REMEMBER = 200_000
#: Up to so many ids (16 bytes each) are sent to every executor to pick texts; more go by a shuffle.
BROADCAST_IDS = 500_000
#: Members of a block, and about the shingles that it may hold. Two blocks meet in one call.
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
#: Hashes in more sets than this are counted by a matrix product.
FEW = 8

_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, seen: _Hashes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out) + h[i : i + len(out)]
    return np.unique(_mix(out))


_PROBE = (np.arange(REGISTERS)[:, None] * (2 * ((np.arange(REGISTERS) * 37 + 11) % REGISTERS) + 1)[None, :] + (np.arange(REGISTERS) * 61 + 29)[None, :]) % REGISTERS


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each of ``sets``, none of which is empty."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    if not sets:
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = owner * REGISTERS + (flat >> _U(64 - BUCKET_BITS)).astype(np.int64)
    # Sets are sorted, so the first hash of a bucket is its smallest.
    first = np.flatnonzero(np.diff(place, prepend=-1))
    rest = flat[first] << _U(BUCKET_BITS)
    zeros = np.minimum(40, 53 - np.frexp((rest >> _U(11)).astype(np.float64))[1]).astype(np.uint64)
    mantissa = (rest << (zeros + _U(1))) >> _U(64 - MANTISSA)
    out.reshape(-1)[place[first]] = ((zeros + _U(1)) << _U(MANTISSA) | mantissa).astype(np.uint16)
    todo = np.flatnonzero((out == 0).any(1))
    own = out[todo]
    full = own.copy()
    live = np.arange(len(todo))
    for probe in _PROBE:
        if not len(live):
            break
        some = full[live]
        full[live] = np.where(some == 0, own[live][:, probe], some)
        live = live[(full[live] == 0).any(1)]
    out[todo] = full
    return out


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How likely registers of two disjoint sets of these sizes agree: both have the same zeros and mantissa.

    A bucket of k hashes has its minimum near 1/k; with cells that grow with the minimum by powers of two the chance is
    summed over the numbers of zeros.
    """
    return (_zeros(na) * _zeros(nb)).sum(1) / (1 << MANTISSA)


def _zeros(n: np.ndarray) -> np.ndarray:
    """Per set size how likely the minimum of a bucket has 0, 1, ... leading zeros."""
    k, z = np.maximum(n / REGISTERS, 1.0)[:, None], np.arange(40.0)[None]
    return (1 - 2.0 ** -(z + 1)) ** k - (1 - 2.0**-z) ** k


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketch rows, corrected for chance agreement."""
    c = chance(na.astype(float), nb.astype(float))
    return ((a == b).mean(1) - c) / (1 - c)


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    seen = _Hashes()
    for part in slices(batches, 1):
        sets = [shingles(t, seen, width) for t in part.column(1).to_pylist()]
        full = [k for k, s in enumerate(sets) if len(s)]
        regs = dict(zip(full, sketches([sets[k] for k in full]), strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([regs[k].tobytes() if k in regs else None for k in range(len(sets))], pa.binary()),
            ],
            ["doc_id", "n_shingles", "class", "sketch"],
        )
    seen.clear()
    released()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = REGISTERS // ROWS
    salt = _mix(np.arange(1, count + 1, dtype=np.uint64))
    for b in batches:
        if b.num_rows:
            regs = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(b.num_rows, REGISTERS)
            keys = _mix(_mix(regs.view(np.uint64) + salt) ^ salt).view(np.int64).reshape(-1)
            per = lambda name: pa.array(np.repeat(b.column(name).to_numpy(), count))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(keys), per("node"), per("n")], ["key", "node", "n"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sa, sb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, REGISTERS) for c in ("sa", "sb"))
            ok = estimate(sa, sb, b.column("na").to_numpy(), b.column("nb").to_numpy()) >= PERCENT / 100 - MARGIN
            yield b.select(["a", "b"]).filter(pa.array(ok))


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 3):
        pairs = zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True)
        ok = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _make_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    seen = _Hashes()
    for b in slices(batches, 1):
        sets = [shingles(t, seen, width) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "class", "set"])
    seen.clear()
    released()


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, set) of the classes ``nodes``, made anew from the text of one document of each; written.

    The table of documents is shuffled only for more than BROADCAST_IDS of them.
    """
    wanted = materialise(classes.select("node", "doc", "class").join(nodes.select("node").distinct(), "node", "left_semi"))
    ids = wanted.select(F.col("doc").alias("doc_id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    made = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(functools.partial(_make_sets, width=width), "doc_id long, class binary, set binary")
    # The digest tells which of several rows of one doc_id is meant; rows that repeat both have equal sets.
    return materialise(made.join(wanted, (F.col("doc_id") == F.col("doc")) & (made["class"] == wanted["class"])).groupBy("node").agg(F.first("set").alias("set")))


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets are similar enough; written."""
    side = lambda x, n, s: classes.select(F.col("node").alias(x), F.col("n").alias(n), F.col("sketch").alias(s))
    near = materialise(pairs.join(side("a", "na", "sa"), "a").join(side("b", "nb", "sb"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near, "a long, b long"))
    sets = _sets(near.select(F.explode(F.array("a", "b")).alias("node")), classes, docs, width)
    side = lambda x, t: sets.select(F.col("node").alias(x), F.col("set").alias(t))
    both = near.join(side("b", "sb"), "b").join(side("a", "sa"), "a").select("a", "b", "sa", "sb")
    return materialise(both.mapInArrow(_verify, "a long, b long"))


def _across(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Links between ``members`` (node, n, c, cluster) of one cluster and different components c; written.

    Members outside a cluster's largest component (the left side) meet all its members (the right side). Each side is dealt
    into blocks of at most about BLOCK members and BLOCK_SHINGLES shingles; a left and a right block are compared in
    one group, by estimates, then by exact intersections of all at once. Only links that join components come out.
    """
    largest = members.groupBy("cluster", "c").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.min_by("c", F.struct(-F.col("m"), "c")).alias("largest"))
    marked = materialise(members.join(largest, "cluster").withColumn("minor", F.col("c") != F.col("largest")).drop("largest"))
    blocks = lambda rows, n: F.greatest(F.ceil(rows / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    size = marked.groupBy("cluster").agg(
        blocks(F.count_if("minor"), F.sum(F.when(F.col("minor"), F.col("n")).otherwise(0))).alias("lefts"), blocks(F.count("*"), F.sum("n")).alias("rights")
    )
    sets = _sets(marked, classes, docs, width)
    rows = marked.join(size, "cluster").join(classes.select("node", "sketch"), "node").join(sets, "node")
    deal = lambda name, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    keep = ["cluster", "i", "j", "left", "minor", "node", "n", "c", "sketch", "set"]
    left = rows.where("minor").withColumn("i", deal("lefts", 1)).withColumn("j", every("rights")).withColumn("left", F.lit(True)).select(*keep)
    right = rows.withColumn("j", deal("rights", 2)).withColumn("i", every("lefts")).withColumn("left", F.lit(False)).select(*keep)
    return materialise(left.unionByName(right).groupBy("cluster", "i", "j").applyInArrow(_block, "a long, b long"))


def _block(t: pa.Table) -> pa.Table:
    left = t.column("left").to_numpy()
    at, to = np.flatnonzero(left), np.flatnonzero(~left)
    node, comp, minor = (t.column(c).to_numpy() for c in ("node", "c", "minor"))
    size = t.column("n").to_numpy().astype(np.int64)
    found: list[tuple[int, int]] = []
    if len(at) and len(to):
        regs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(t.num_rows, REGISTERS)
        same = np.stack([(regs[to] == regs[k]).mean(1) for k in at])
        by_chance = _zeros(size[at]) @ _zeros(size[to]).T / (1 << MANTISSA)
        near = (same - by_chance) / (1 - by_chance) >= PERCENT / 100 - MARGIN
        x, y = size[at][:, None], size[to][None]
        # Two members outside the largest component meet twice; once is enough.
        near &= (comp[at][:, None] != comp[to][None]) & (100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)) & (~minor[to][None] | (node[at][:, None] < node[to][None]))
        left_at, right_at = np.nonzero(near)
        if len(left_at):
            used = np.unique(np.concatenate([at[left_at], to[right_at]]))
            place = np.zeros(t.num_rows, np.int64)
            place[used] = np.arange(len(used))
            both = intersections([np.frombuffer(x, np.uint64) for x in t.column("set").take(pa.array(used)).to_pylist()])
            a, b = at[left_at], to[right_at]
            k = both[place[a], place[b]]
            ok = 100 * k >= PERCENT * (size[a] + size[b] - k)
            found = _joining(a[ok].tolist(), b[ok].tolist(), comp.tolist(), node.tolist())
    cols = list(zip(*found, strict=True)) or [(), ()]
    return pa.table([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


def _joining(a: list[int], b: list[int], comp: list[int], node: list[int]) -> list[tuple[int, int]]:
    """Of the links between rows ``a`` and ``b`` those that join two components still apart, as nodes."""
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = top(comp[x]), top(comp[y])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((node[x], node[y]))
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections, exactly.

    A hash that few sets hold adds to each of its pairs; hashes that many sets hold are columns of a 0-1 matrix, whose product
    with itself counts them.
    """
    n = len(sets)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(flat)))
    out = np.zeros(n * n, np.int64)
    for d in range(2, FEW + 1):
        at = first[many == d]
        for i in range(d if len(at) else 0):
            for j in range(i + 1, d):
                out += np.bincount(row[at + i] * n + row[at + j], minlength=n * n) if len(at) > n else 0
                if len(at) <= n:
                    np.add.at(out, row[at + i] * n + row[at + j], 1)
    out = out.reshape(n, n)
    out = out + out.T
    often = np.flatnonzero(many > FEW)
    for k in range(0, len(often), 4096):
        some = often[k : k + 4096]
        m = np.zeros((n, len(some)), np.float32)
        take = np.concatenate([np.arange(first[x], first[x] + many[x]) for x in some])
        m[row[take], np.repeat(np.arange(len(some)), many[some])] = 1
        out += (m @ m.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest node reachable. Large and small stars in turn."""
    edges, path = written(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    was = state(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges, now_at = written(small.where("u <> v").distinct())
        # What the round was made from is read no more.
        removed(edges.sparkSession, path)
        path, now = now_at, state(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _resolved(docs: DataFrame, width: int) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, class, component_id, and whether its class is the one that its component keeps."""
    sketched = materialise(docs.select("doc_id", "text").mapInArrow(functools.partial(_sketch, width=width), "doc_id long, n_shingles long, class binary, sketch binary"))
    first = F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("s")
    full = sketched.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull())
    # Numbered and written in one: the numbers can't change any more.
    classes = materialise(
        full.groupBy("class").agg(first).select(F.monotonically_increasing_id().alias("node"), "class", F.col("s.doc_id").alias("doc"), F.col("s.n_shingles").alias("n"), F.col("s.sketch").alias("sketch"))
    )
    bands = classes.select("node", "n", "sketch").mapInArrow(_bands, "key long, node long, n long")
    shared = bands.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("_c")).where("_c > 1").select("key", "hub", "_c")
    # Rows of bands with several classes: all that can still matter. The hub itself stands beside each of them.
    met = materialise(bands.join(shared, "key").where(F.col("hub.node") != F.col("node")).select("key", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), "_c"))
    like = lambda x, y: 100 * F.least(x, y) >= PERCENT * F.greatest(x, y)
    stars = materialise(met.where(like(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    links = _linked(stars, classes, docs, width)

    # Bands in which several components meet beside the hub, whose pairs are all done: their members, in clusters that such bands connect.
    found = components(links)
    member = met.where("_c > 2").select("key", "node", "n").join(found.withColumnsRenamed({"node": "_x", "component": "_y"}), F.col("node") == F.col("_x"), "left")
    member = member.select("key", "node", "n", F.coalesce("_y", "node").alias("c"))
    mixed = member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("node").alias("one")).where("lo < hi").select("key", "one")
    member = materialise(member.join(mixed, "key"))
    cluster = components(member.select(F.col("one").alias("a"), F.col("node").alias("b"))).select(F.col("node").alias("_x"), F.col("component").alias("cluster"))
    open_ = member.select("node", "n", "c").distinct().join(cluster, F.col("node") == F.col("_x")).select("node", "n", "c", "cluster")
    more = _across(materialise(open_), classes, docs, width)
    found = components(links.unionByName(more)).select(F.col("node").alias("_x"), F.col("component").alias("_y"))

    of_class = classes.select("node", "class", "doc").join(found, F.col("node") == F.col("_x"), "left").select("class", "doc", F.coalesce("_y", "node").alias("component"))
    # The row kept: of the smallest doc_id of the component, in the smallest class.
    least = of_class.groupBy("component").agg(F.min(F.struct("doc", "class")).alias("least"))
    named = of_class.join(least, "component").select("class", F.col("least.doc").alias("component_id"), (F.col("least.class") == F.col("class")).alias("winner"))
    return sketched.select("doc_id", "n_shingles", "class").join(named, "class", "left")


def resolve(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id and kept."""
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return _resolved(docs, width).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _classes(batches: Iterator[pa.RecordBatch], text: int, width: int) -> Iterator[pa.RecordBatch]:
    seen = _Hashes()
    for b in slices(batches, text):
        digests = [_digest(shingles(t, seen, width)) for t in b.column(text).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.binary())], names=[*b.schema.names, _CLASS])


_CLASS = "_class_of_row"


def kept_documents(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of each component, with the columns of ``docs``."""
    columns, name = [f"`{c}`" for c in docs.columns], unused(docs, "_gone")
    rows = materialise(_resolved(docs, width).where(F.col("doc_id").isNotNull()).select("doc_id", "class", "component_id", "winner"))
    # Ids that several rows have, which a doc_id doesn't tell apart: their rows are told apart by their classes.
    again = materialise(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    gone = materialise(rows.where(~F.col("winner") | (F.col("component_id") != F.col("doc_id"))).select("doc_id").unionByName(again).distinct().withColumnRenamed("doc_id", name))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    single = docs.join(small(gone), F.col("doc_id") == F.col(name), "left_anti").select(*columns)
    if again.isEmpty():
        return single
    schema = T.StructType([*docs.schema.fields, T.StructField(_CLASS, T.BinaryType())])
    twice = docs.join(small(again.withColumnRenamed("doc_id", name)), F.col("doc_id") == F.col(name), "left_semi").select(*columns)
    twice = twice.mapInArrow(functools.partial(_classes, text=docs.columns.index("text"), width=width), schema)
    # Rows without a set have no class, link with nothing and all stay.
    bare = twice.where(F.col(_CLASS).isNull()).select(*columns)
    stay = rows.where(F.col("winner") & (F.col("component_id") == F.col("doc_id"))).select(F.col("doc_id").alias(name), F.col("class").alias(f"{name}2")).distinct()
    one = twice.groupBy("doc_id", _CLASS).agg(F.first(F.struct(*columns)).alias(name)).select(F.col("doc_id").alias("_d"), F.col(_CLASS).alias("_c"), F.col(name).alias("_row"))
    one = one.join(stay, (F.col("_d") == F.col(name)) & (F.col("_c") == F.col(f"{name}2"))).select("_row.*")
    return single.unionByName(bare).unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(spread(table(spark, sf_dir, "documents")), width=4)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT b, c FROM r JOIN both_ ON a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n
"""
