"""Operator 2: personal data by fixed patterns and a skip-chain conditional random field.

Base spans come from the four patterns of the contract and always stay. The field adds spans, also of a fifth kind, secrets
such as keys and access tokens: its nodes are the white-space tokens that hold a digit or an at sign (all others are clamped
to "other"); neighbours in the text share a chain potential, and consecutive occurrences of the same or a similar token
(equal digits, or equal name before the at sign), however far apart, share a skip potential. Tokens inside base
spans are clamped to their kind, and loopy sum-product messages carry that to the others until each document's labels agree.

The weights are trained on ``SAMPLE`` documents, and at most ``EXAMPLES`` different nodes of them, both chosen by hash, by
pseudo-likelihood: each node given the labels of its neighbours. Labels are the base spans, and for secrets what stands behind
a word like "token" and an equals sign. Features are shapes, neighbouring words and check digits, never the outcome of a pattern. So that the field can find what
no pattern does, a node without a label that resembles a labelled one of its document is no example of "other", and labelled
nodes that have a similar one stand in the examples a second time without their features: there the links alone must tell.

Defined cases: a null or empty text has no spans; repeated rows are searched row by row; null ids are kept; without
documents to train on only base spans are found; messages that don't settle in ``ROUNDS`` rounds are used as they are then, which the
column ``settled`` tells; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm.common import slices, spread, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of labels: those of the contract, secrets, and nothing of the kind.
LABELS = (*KINDS, "secret")
SECRET, OTHER = len(KINDS), len(KINDS) + 1
SAMPLE = 4_000
EXAMPLES = 100_000
HASHED = 1 << 12
#: The feature of a node whose features are withheld; it has no weight.
NONE = HASHED
FEATURES = 11
ROUNDS = 200
#: Of the difference to the last message so much is taken, so that loops settle.
STEP = 0.7
#: A node gets the label of a kind only if its belief is at least this.
BELIEF = 0.7

# The patterns of the contract. Possessive repeats and the look-behind only save work: a number that fails
# from its first digit fails from the others too.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"[\x20\x09-\x0D]|\Z")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: What labels a secret in training: a name, an equals sign or colon, and a run of key characters.
_SECRET = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth)\w*[\x20\t]*[=:][\x20\t]*[\"']?([A-Za-z0-9_+/=-]{16,})")
_KEY = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_SPACES = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign outwards: what is before it can't hold another one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base, by kind and start."""
    if not text:
        return []
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if not _MARK.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in _short(m.group()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def _short(ip: str) -> list[str]:
    """The parts; a part of very many digits stands as 999, so that it needn't become a number."""
    return [p if len(p) < 100 else (p.lstrip("0") or "0")[:4] for p in ip.split(".")]


def tokens(text: str) -> list[tuple[int, int]]:
    """White-space tokens that hold a digit or an at sign."""
    out, end = [], 0
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] not in _SPACES:
            start -= 1
        end = _TOKEN_END.search(text, m.start()).start()
        out.append((start, end))
    return out


def seeds(text: str) -> list[tuple[int, int, int]]:
    """Spans that label secrets in training."""
    found = (m.span(1) for m in _SECRET.finditer(text))
    return [(SECRET, s, e) for s, e in found if any(c.isdigit() for c in text[s:e]) and any(c.isalpha() for c in text[s:e])]


def key_like(token: str) -> str:
    """The length (in eights) of the run of key characters that makes most of a token with digits and letters; empty for others."""
    m = _KEY.search(token)
    if not m or 2 * (m.end() - m.start()) < len(token) or not any(c.isdigit() for c in m.group()) or not any(c.isalpha() for c in m.group()):
        return ""
    return str(min((m.end() - m.start()) // 8, 16))


def similar(token: str) -> str:
    """The key of tokens that share a skip potential; empty for those too short to mean anything."""
    if "@" in token:
        return "@" + token.split("@")[0].lower().strip("<(\"'[")
    digits = _NOT_DIGIT.sub("", token)
    return digits if len(digits) >= 7 else ""


def shape(token: str) -> str:
    """Runs of digits as 9 and their length, letters as a, other characters as they are."""
    out = re.sub(r"[0-9]+", lambda m: "9" + "abcdefghijklmnopqrstuvwxyz"[min(len(m.group()), 25)], token)
    return re.sub(r"[^\W\d_]+", lambda m: "a" if not m.group().startswith("9") else m.group(), re.sub(r"9([a-z])", r"9\1", out))


class Graph:
    """A document's nodes: features, clamped labels (-1: free), chain and skip edges."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]) -> None:
        self.spans = tokens(text)
        n = len(self.spans)
        self.clamped = np.full(n, -1)
        starts = [s for s, _ in self.spans]
        for kind, s, e in reversed(base):
            at = max(0, int(np.searchsorted(starts, s, "right")) - 1)
            while at < n and self.spans[at][0] < e:
                if self.spans[at][1] > s:
                    self.clamped[at] = kind
                at += 1
        words = [text[s:e] for s, e in self.spans]
        near = [k + 1 < n and not text[self.spans[k][1] : self.spans[k + 1][0]].strip(_SPACES) for k in range(n)]
        self.chain = [(k, k + 1) for k in range(n - 1) if near[k]]
        last: dict[str, int] = {}
        self.skip = []
        self.keys = [similar(w) for w in words]
        for k, key in enumerate(self.keys):
            if key:
                if key in last and not (near[k - 1] and last[key] == k - 1):
                    self.skip.append((last[key], k))
                last[key] = k
        shapes = [shape(w) for w in words]
        self.features = []
        for k in range(n):
            context = text[max(0, self.spans[k][0] - 24) : self.spans[k][0]].split()
            before = shapes[k - 1] if k and near[k - 1] else " ".join(context[-1:])
            after = shapes[k + 1] if near[k] else "."
            digits = len(_NOT_DIGIT.sub("", words[k]))
            named = (
                f"s:{shapes[k]}", f"d:{min(digits, 20)}", f"@:{'@' in words[k]}", f".:{min(words[k].count('.'), 4)}", f"+:{words[k][:1] == '+'}", f"b:{before}", f"a:{after}",
                f"c:{' '.join(context[-2:]).lower()}", f"k:{key_like(words[k])}", f"l:{13 <= digits <= 19 and luhn(_NOT_DIGIT.sub('', words[k]))}", "1",
            )
            self.features.append([zlib.crc32(x.encode("utf-8", "replace")) % HASHED for x in named])


class Field:
    """unary: feature x label; chain: label x label; skip: what agreement of two labels adds, per label."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.unary, self.chain, self.skip = unary, chain, skip

    def beliefs(self, g: Graph) -> tuple[np.ndarray, bool]:
        """Marginals by loopy sum-product, and whether the messages settled; clamped nodes are certain."""
        n, k = len(g.spans), OTHER + 1
        local = self.unary[np.array(g.features, np.int64).reshape(n, -1)].sum(1).reshape(n, k)
        held = np.flatnonzero(g.clamped >= 0)
        local[held] = -1e3
        local[held, g.clamped[held]] = 0
        edges = [(a, b, self.chain) for a, b in g.chain] + [(a, b, np.diag(self.skip)) for a, b in g.skip]
        if not edges:
            return _norm(local), True
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        pot = np.array([e[2] for e in edges])
        right, left = np.zeros((len(edges), k)), np.zeros((len(edges), k))
        settled = False
        for _ in range(ROUNDS):
            total = local.copy()
            np.add.at(total, b, right)
            np.add.at(total, a, left)
            right2 = _lse(pot + (total[a] - left)[:, :, None], 1)
            left2 = _lse(pot + (total[b] - right)[:, None, :], 2)
            right2, left2 = right2 - right2.max(1, keepdims=True), left2 - left2.max(1, keepdims=True)
            settled = max(np.abs(right2 - right).max(), np.abs(left2 - left).max()) < 1e-6
            if settled:
                break
            right, left = right + STEP * (right2 - right), left + STEP * (left2 - left)
        total = local.copy()
        np.add.at(total, b, right)
        np.add.at(total, a, left)
        return _norm(total), settled


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _norm(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True)) if len(x) else x
    return p / p.sum(1, keepdims=True) if len(x) else x


Example = tuple[list[int], int, list[int], list[int], list[int], int]


def fit(examples: list[Example]) -> Field:
    """examples: (features, label, labels before and after in the chain, labels over skip edges, how often), different nodes once."""
    k = OTHER + 1
    unary, chain, skip = np.zeros((HASHED + 1, k)), np.zeros((k, k)), np.zeros(k)
    if not examples:
        return Field(unary, chain, skip)
    f = np.array([e[0] for e in examples])
    y = np.array([e[1] for e in examples])
    weight = np.array([e[5] for e in examples], float)
    before, after, links = (np.zeros((len(examples), k)) for _ in range(3))
    for i, e in enumerate(examples):
        for x, m in zip(e[2:5], (before, after, links), strict=True):
            np.add.at(m[i], x, 1.0)
    truth = np.eye(k)[y]
    # What all kinds share of the skip weight, and what each has beside.
    shared, own = np.zeros(1), np.zeros(k)
    g = [np.full_like(x, 1e-6) for x in (unary, chain, shared, own)]
    flat = f.ravel()
    for _ in range(150):
        z = unary[f].sum(1) + before @ chain + after @ chain.T + links * (shared + own)
        err = (_norm(z) - truth) * (weight / weight.sum())[:, None]
        du = np.stack([np.bincount(flat, np.repeat(err[:, c], f.shape[1]), HASHED + 1) for c in range(k)], 1)
        du[NONE] = 0
        ds = (links * err).sum(0)
        steps = (du + 1e-6 * unary, before.T @ err + err.T @ after + 1e-5 * chain, np.array([ds.sum()]) + 1e-5 * shared, ds + 1e-5 * own)
        for p, d, s in zip((unary, chain, shared, own), steps, g, strict=True):
            s += d * d
            p -= 0.3 * d / np.sqrt(s)
    # Equal things are the same kind of thing: agreement never counts against a label.
    return Field(unary, chain, np.maximum(shared + own, 0.0))


def examples(text: str | None) -> list[tuple[list[int], int, list[int], list[int], list[int]]]:
    """The training nodes of a text: (features, label, labels before, after and over skip edges)."""
    marks = base_spans(text) + seeds(text or "")
    g = Graph(text or "", marks)
    n = len(g.spans)
    y = [int(c) if c >= 0 else OTHER for c in g.clamped]
    named = {key: y[k] for k, key in enumerate(g.keys) if key and y[k] != OTHER}
    known = [y[k] != OTHER or g.keys[k] not in named for k in range(n)]
    links: list[list[list[int]]] = [[[] for _ in range(n)] for _ in range(3)]
    for i, j in g.chain:
        if known[i] and known[j]:
            links[0][j].append(y[i])
            links[1][i].append(y[j])
    for i, j in g.skip:
        if known[i] and known[j]:
            links[2][i].append(y[j])
            links[2][j].append(y[i])
    out = []
    for k in range(n):
        if known[k]:
            out.append((g.features[k], y[k], links[0][k], links[1][k], links[2][k]))
            if links[2][k]:
                out.append(([NONE] * FEATURES, y[k], links[0][k], links[1][k], links[2][k]))
    return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ints = pa.list_(pa.int32())
    for b in slices(batches, 0, 64):
        rows = [e for text in b.column(0).to_pylist() for e in examples(text)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (ints, pa.int32(), ints, ints, ints), strict=True)], ["f", "y", "b", "a", "s"])


def train(docs: DataFrame) -> Field:
    """Weights from at most SAMPLE documents that hold a digit or an at sign, chosen by the hash of their id.

    All their nodes are examples, equal ones once with their number; of the different ones the EXAMPLES with the smallest hash.
    """
    marked = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    ids = marked.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = marked.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(_examples, "f array<int>, y int, b array<int>, a array<int>, s array<int>")
    alike = rows.groupBy("f", "y", "b", "a", "s").agg(F.count("*").alias("n"))
    some = alike.orderBy(F.xxhash64("f", "y", "b", "a", "s"), "f", "y", "b", "a", "s").limit(EXAMPLES)
    return fit(sorted((list(r.f), r.y, list(r.b), list(r.a), list(r.s), r.n) for r in some.toLocalIterator()))


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """What the field adds: runs of neighbouring nodes with the same label, without punctuation around, off the base spans."""
    return labelled(text, base, field)[0]


def labelled(text: str, base: list[tuple[int, int, int]], field: Field) -> tuple[list[tuple[int, int, int]], bool]:
    """``added_spans`` and whether the field's messages settled."""
    if not _MARK.search(text):
        return [], True
    g = Graph(text, base)
    if not (g.clamped < 0).any():
        return [], True
    p, settled = field.beliefs(g)
    label = np.where(p[:, :OTHER].max(1) >= BELIEF, p[:, :OTHER].argmax(1), OTHER)
    label[g.clamped >= 0] = OTHER
    chained = set(g.chain)
    out: list[tuple[int, int, int]] = []
    k = 0
    while k < len(label):
        if label[k] == OTHER:
            k += 1
            continue
        end = k
        while label[k] != SECRET and (end, end + 1) in chained and label[end + 1] == label[k]:
            end += 1
        s, e = g.spans[k][0], g.spans[end][1]
        if label[k] == SECRET and (m := _KEY.search(text, s, e)):
            s, e = m.span()
        while s < e and not (text[s].isalnum() or text[s] in "+("):
            s += 1
        while e > s and not (text[e - 1].isalnum() or text[e - 1] == ")"):
            e -= 1
        if e > s and not any(b < e and s < c for _, b, c in base):
            out.append((int(label[k]), s, e))
        k = end + 1
    return out, settled


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{LABELS[k]}:{s}:{e}" for k, s, e in sorted(spans))


class _Finder:
    def __init__(self, field: Field) -> None:
        self.field = field

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                added, settled = labelled(text or "", base, self.field)
                four, secrets = [x for x in added if x[0] != SECRET], [x for x in added if x[0] == SECRET]
                counts = [sum(k == x for x, _, _ in base) for k in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + four), listed(secrets), len(base) + len(added), settled))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, FOUND.types[1:], strict=True))], schema=FOUND)


#: All spans of the contract's kinds in ``spans``, those of secrets in ``secrets``, and the number of both.
FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("secrets", pa.string()), ("n_found", pa.int64()), ("settled", pa.bool_())])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Per row: doc_id, base counts by kind, base_sha256, all spans, secrets, the number of what was found, and whether messages settled."""
    shape_ = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, secrets string, n_found long, settled boolean"
    return docs.select("doc_id", "text").mapInArrow(_Finder(field), shape_)


class _Redactor:
    def __init__(self, field: Field, text: int, chars: int) -> None:
        self.field, self.text, self.chars = field, text, chars

    def redact(self, text: str) -> str:
        base = base_spans(text)
        out, at = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in base + added_spans(text, base, self.field)):
            if s >= at:
                out += [text[at:s], f"[{LABELS[k].upper()}]"]
            at = max(at, e)
        return "".join([*out, text[at:]])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, self.text):
            texts = [x if not x or not _MARK.search(x) else self.redact(x) for x in b.column(self.text).to_pylist()]
            columns = list(b.columns)
            if self.chars >= 0:
                old = b.column(self.chars).to_pylist()
                was = b.column(self.text).to_pylist()
                columns[self.chars] = pa.array([n if x == y or x is None else len(x) for n, x, y in zip(old, texts, was, strict=True)], b.schema.types[self.chars])
            columns[self.text] = pa.array(texts, b.schema.types[self.text])
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; n_chars follows where a text changed."""
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    return docs.mapInArrow(_Redactor(field, docs.columns.index("text"), chars), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return find(docs, train(docs))
