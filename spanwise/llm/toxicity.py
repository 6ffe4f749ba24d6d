"""Operator 3: toxicity by a factorization machine over hashed terms.

A term is a lower-cased run of letters or its first ``PREFIX`` letters; terms are hashed into ``BUCKETS``. Labels are
taken from a bounded sample (``SAMPLE`` labelled rows outside the held-out fold, chosen by hash); all buckets of the sample that
tell something about the label, by a likelihood-ratio test at ``GAIN``, become inputs, however many. Buckets are counted on
the executors; the driver gets a number per bucket and label, and of the sampled rows the chosen inputs alone. The machine's score is
sigmoid(bias + sum of weights + sum over pairs of inputs of the product of their factor vectors), so that a
pair (an insult and a group) can weigh more than its parts. Scores are made from whole texts alone.

Defined cases: a null or empty text scores like one without known terms; null ids are scored and are not held out;
repeated label rows count once with their largest label; repeated documents are scored row by row; without
labels, or with labels of one kind, every score is that label's share (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.common import materialise, released, slices, spread, table, unused

BUCKETS = 1 << 18
PREFIX = 5
SAMPLE = 20_000
#: Twice the log-likelihood ratio that chance alone passes for about one bucket in fifty thousand; and the rows that a bucket must have.
GAIN = 18.0
LEAST_ROWS = 3
FACTORS = 8
EPOCHS = 40
BATCH = 256
RATE = 0.1
DECAY = 1e-4
THRESHOLD = 0.7
#: Words whose buckets a worker remembers; beyond, it starts anew.
REMEMBER = 150_000

_LETTERS = re.compile(r"[^\W\d_]+")


def buckets(word: str) -> tuple[int, ...]:
    """The buckets of a word and, if it is longer, of its prefix."""
    own = zlib.crc32(f"w:{word}".encode("utf-8", "replace")) % BUCKETS
    if len(word) <= PREFIX:
        return (own, zlib.crc32(f"p:{word}".encode("utf-8", "replace")) % BUCKETS)
    return (own, zlib.crc32(f"p:{word[:PREFIX]}".encode("utf-8", "replace")) % BUCKETS)


class _Buckets(dict):
    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > REMEMBER:
            self.clear()
        found = self[word] = buckets(word)
        return found


def terms(text: str | None, seen: _Buckets) -> set[int]:
    out: set[int] = set()
    for found in map(seen.__getitem__, set(_LETTERS.findall((text or "").lower()))):
        out.update(found)
    return out


@dataclass
class Machine:
    """inputs: sorted bucket numbers; weights and factors stand in their order."""

    bias: float
    inputs: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * ((s * s).sum(1) - x @ (self.factors**2).sum(1))

    def score(self, inputs: list[int]) -> float:
        if not inputs:
            return float(1 / (1 + np.exp(-self.bias)))
        v = self.factors[inputs]
        s = v.sum(0)
        z = self.bias + self.weights[inputs].sum() + 0.5 * ((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def choose(hits: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """The buckets with a log-likelihood ratio between the labels over GAIN. ``hits``: bucket, rows of label 0 and of label 1."""
    bucket, h0, h1 = hits.astype(float).T if len(hits) else np.zeros((3, 0))
    total, n = h0 + h1, n0 + n1

    def part(a: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return a * np.log(np.where(a > 0, a, 1) / np.where(a > 0, expected, 1))

    gain = part(h1, total * n1 / n) + part(h0, total * n0 / n) + part(n1 - h1, (n - total) * n1 / n) + part(n0 - h0, (n - total) * n0 / n)
    return np.sort(bucket[(2 * gain > GAIN) & (total >= LEAST_ROWS)]).astype(np.int64)


def fit(lists: list[np.ndarray], labels: np.ndarray) -> Machine:
    """The machine of rows of buckets and their labels."""
    labels = labels.astype(np.int64)
    if labels.sum() in (0, len(labels)):
        return constant(labels)
    hits = [np.bincount(np.concatenate([x for x, y in zip(lists, labels, strict=True) if y == k]), minlength=BUCKETS) for k in (0, 1)]
    seen = np.flatnonzero(hits[0] + hits[1])
    inputs = choose(np.stack([seen, hits[0][seen], hits[1][seen]], 1), int((1 - labels).sum()), int(labels.sum()))
    return descend(inputs, [np.searchsorted(inputs, np.intersect1d(row, inputs)) for row in lists], labels)


def constant(labels: np.ndarray) -> Machine:
    """Where there are no labels, or of one kind: their share, whatever the text."""
    return Machine(60.0 if len(labels) and labels.sum() else -60.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))


def descend(inputs: np.ndarray, lists: list[np.ndarray], labels: np.ndarray) -> Machine:
    """Adaptive-gradient descent on the logistic loss, in a fixed order of rows; ``lists`` are places among ``inputs``."""
    labels = labels.astype(np.float64)
    share = float(labels.mean())
    rng = np.random.default_rng(0)
    x = np.zeros((len(lists), len(inputs)), np.uint8)
    for k, row in enumerate(lists):
        x[k, row] = 1
    m = Machine(float(np.log(share / (1 - share))), inputs, np.zeros(len(inputs)), rng.normal(0, 0.02, (len(inputs), FACTORS)))
    gb, gw, gv = 1e-6, np.full(len(inputs), 1e-6), np.full((len(inputs), FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(lists))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            xb = x[rows].astype(np.float64)
            s = xb @ m.factors
            z = m.bias + xb @ m.weights + 0.5 * ((s * s).sum(1) - xb @ (m.factors**2).sum(1))
            err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[rows]) / len(rows)
            db, dw = err.sum(), xb.T @ err + DECAY * m.weights
            dv = xb.T @ (err[:, None] * s) - (xb.T @ err)[:, None] * m.factors + DECAY * m.factors
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            m.bias -= RATE * db / np.sqrt(gb)
            m.weights -= RATE * dw / np.sqrt(gw)
            m.factors -= 0.3 * RATE * dv / np.sqrt(gv)
    return m


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Buckets()
    for b in slices(batches, 1):
        found = [np.array(sorted(terms(t, seen)), "<i4").tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine for ``labels`` (doc_id, toxic) of ``docs``: at most SAMPLE ids leave the label table, and only their texts are read for terms."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1))
        .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    extracted = rows.mapInArrow(_extract, "doc_id long, toxic int, terms binary")
    found = materialise(extracted.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms")))
    kinds = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return constant(np.array(list(kinds)))
    hits = found.mapInArrow(_count, "bucket int, toxic int, n long").groupBy("bucket").agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(f"h{k}") for k in (0, 1)])
    counted = np.array([(r.bucket, r.h0, r.h1) for r in hits.where(F.col("h0") + F.col("h1") >= LEAST_ROWS).collect()], np.int64).reshape(-1, 3)
    inputs = choose(counted, kinds.get(0, 0), kinds.get(1, 0))
    placed = found.mapInArrow(_Placed(inputs), "doc_id long, toxic int, places binary")
    got = sorted((r.doc_id, r.toxic, bytes(r.places)) for r in placed.collect())
    return descend(inputs, [np.frombuffer(t, "<i4").astype(np.int64) for _, _, t in got], np.array([y for _, y, _ in got]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows per bucket and label, of a whole partition."""
    n = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        for y, t in zip(b.column("toxic").to_pylist(), b.column("terms").to_pylist(), strict=True):
            n[int(y > 0), np.frombuffer(t, "<i4")] += 1
    for k in (0, 1):
        at = np.flatnonzero(n[k])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), k), pa.int32()), pa.array(n[k][at], pa.int64())], ["bucket", "toxic", "n"])


class _Placed:
    """Of each row the places of its terms among the inputs."""

    def __init__(self, inputs: np.ndarray) -> None:
        self.inputs = inputs

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.searchsorted(self.inputs, np.intersect1d(np.frombuffer(t, "<i4"), self.inputs)).astype("<i4").tobytes() for t in b.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "places"])


class _Scorer:
    """Appends a score to rows whose column ``text`` holds the texts."""

    def __init__(self, machine: Machine, at: int, name: str) -> None:
        self.machine, self.at, self.name = machine, at, name

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(b): k for k, b in enumerate(self.machine.inputs)}
        known: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches, self.at):
            scores = []
            for text in batch.column(self.at).to_pylist():
                hits: set[int] = set()
                for w in set(_LETTERS.findall((text or "").lower())):
                    found = known.get(w)
                    if found is None:
                        if len(known) > REMEMBER:
                            known.clear()
                        found = known[w] = tuple(place[b] for b in buckets(w) if b in place)
                    if found:
                        hits.update(found)
                scores.append(self.machine.score(sorted(hits)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, self.name])
        known.clear()
        released()


def with_score(docs: DataFrame, machine: Machine, name: str = "_score") -> DataFrame:
    """``docs`` with a column ``name`` of scores."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_Scorer(machine, docs.columns.index("text"), name), schema)


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under THRESHOLD, with their columns as they are."""
    name = unused(docs, "_score")
    return with_score(docs, train(docs, labels), name).where(F.col(name) < THRESHOLD).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
