"""Operator 1: SentencePiece encoding and decoding with exact N-best segmentations.

The lattice of a text has an edge for every vocabulary piece at every place (and for the bytes of a character without
one); a segmentation scores the sum of its pieces' scores. A forward Viterbi pass gives the best score up to each place. Read
backwards that score is exactly what remains to be gained, so A-star search from the end towards the start pops
complete segmentations in order of their score. Since no piece holds the space mark behind another character, texts are
cut before the marks, and the lattice is a chain of small ones: forward passes are shared by equal parts, and
backward search enters only the parts whose best alternative costs least, as others can't be in the N best.

Scores tie exactly (they are whole numbers): of equal segmentations of a part the first has the smaller piece ids, read from the
end backwards; the others follow in a fixed order.

Defined cases: null and empty texts have one segmentation, without pieces; repeated rows are encoded each; unpaired
surrogates can't occur in a table's strings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from spanwise.llm.common import slices, spread, table

SPACE = "▁"
BEST = 4
REMEMBER = 1_200_000
#: So many characters are looked up at once, and so many of these, and N-best lists of parts, are remembered.
WINDOW = 4
REMEMBER_WINDOWS = 200_000
REMEMBER_LISTS = 50_000
#: What a byte piece costs more than the worst piece, so that bytes stand only where nothing else fits.
BYTE_COST = 10.0


class Model:
    """Pieces and scores of a SentencePiece vocabulary file.

    Pieces of space marks alone, which the file scores out of reach of any sum, count one less than the worst other piece.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.names = [m.id_to_piece(k) for k in range(size)]
        plain = [k for k in range(size) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k))]
        worst = min(m.get_score(k) for k in plain if self.names[k].strip(SPACE))
        self.ids = {self.names[k]: k for k in plain}
        self.score = {self.names[k]: m.get_score(k) if self.names[k].strip(SPACE) else worst - 1 for k in plain}
        self.bytes = {int(self.names[k][3:5], 16): k for k in range(size) if m.is_byte(k)}
        self.longest = max(map(len, self.ids))
        self.prefixes = {x[:k] for x in self.ids for k in range(1, len(x) + 1)}
        # One look-up tells a piece (its score and id), the beginning of one (empty) and neither (missing).
        self.known: dict[str, tuple] = dict.fromkeys(self.prefixes, ()) | {x: (self.score[x], (k,)) for x, k in self.ids.items()}
        self.byte_score = worst - BYTE_COST
        if any(SPACE in x.lstrip(SPACE) for x in self.ids):
            raise ValueError("a piece holds the space mark behind another character")
        self.parts: dict[str, tuple[float, float, bytes]] = {}
        self.windows: dict[str, tuple] = {}
        self.lists: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def edges(self, s: str, start: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """(end, score, ids) of the edges that leave ``start``."""
        single = False
        for end in range(start + 1, len(s) + 1):
            piece = s[start:end]
            if piece not in self.prefixes:
                break
            if piece in self.ids:
                single |= end == start + 1
                yield end, self.score[piece], (self.ids[piece],)
        if not single:
            raw = s[start].encode("utf-8", "replace")
            yield start + 1, self.byte_score * len(raw), tuple(self.bytes[b] for b in raw)

    def forward(self, s: str) -> list[float]:
        """Best score up to each place."""
        best = [0.0] + [-np.inf] * len(s)
        for start in range(len(s)):
            for end, score, _ in self.edges(s, start):
                if best[start] + score > best[end]:
                    best[end] = best[start] + score
        return best

    def into(self, s: str, end: int) -> list[tuple[tuple[int, ...], float, int]]:
        """(ids, score, start) of the edges that end at ``end``: those of ``edges``, found when they are asked for."""
        found = [((self.ids[x],), self.score[x], start) for start in range(max(0, end - self.longest), end) if (x := s[start:end]) in self.ids]
        if s[end - 1] not in self.ids:
            raw = s[end - 1].encode("utf-8", "replace")
            found.append((tuple(self.bytes[b] for b in raw), self.byte_score * len(raw), end - 1))
        return found

    def part(self, s: str) -> tuple[float, float, bytes]:
        """(score, loss of the second best, ids of the best) of one part, remembered.

        The same forward pass as ``forward``, but of the edges into a place only the best and the second best score stay.
        """
        if len(self.parts) > REMEMBER:
            self.parts.clear()
        n, known, windows = len(s), self.known.get, self.windows.get
        best, second = [0.0] + [-np.inf] * n, [-np.inf] * (n + 1)
        back: list[tuple[tuple[int, ...], int]] = [((), 0)] * (n + 1)
        for start in range(n):
            here = best[start]
            hits, more, raw = windows(w := s[start : start + WINDOW]) or self.window(w)
            for size, score, ids in hits:
                total, end = here + score, start + size
                top = best[end]
                if total > top:
                    second[end], best[end], back[end] = top, total, (ids, start)
                elif total == top:
                    second[end] = total
                    if (ids, start) < back[end]:
                        back[end] = ids, start
                elif total > second[end]:
                    second[end] = total
            if more:
                for end in range(start + WINDOW + 1, n + 1):
                    hit = known(s[start:end])
                    if not hit:
                        # The beginning of a piece, or nothing.
                        if hit is None:
                            break
                        continue
                    total = here + hit[0]
                    if total > best[end] or (total == best[end] and (hit[1], start) < back[end]):
                        second[end], best[end], back[end] = best[end], total, (hit[1], start)
                    elif total > second[end]:
                        second[end] = total
            if raw:
                total, end = here + raw[0], start + 1
                if total > best[end]:
                    second[end], best[end], back[end] = best[end], total, (raw[1], start)
                elif total > second[end]:
                    second[end] = total
        # A segmentation leaves the best one, seen from the end, at one place.
        at, loss, found = n, np.inf, []
        while at:
            loss = min(loss, best[at] - second[at])
            found.append(back[at][0])
            at = back[at][1]
        got = self.parts[s] = best[n], float(loss), struct.pack(f"<{sum(map(len, found))}I", *(k for x in reversed(found) for k in x))
        return got

    def window(self, w: str) -> tuple[tuple[tuple[int, float, tuple[int, ...]], ...], bool, tuple | None]:
        """What leaves a place that ``w`` follows, remembered: (size, score, ids) of its pieces, whether longer ones may begin with all of it, and the first character's bytes if it is no piece."""
        if len(self.windows) > REMEMBER_WINDOWS:
            self.windows.clear()
        hits, hit = [], None
        for end in range(1, len(w) + 1):
            hit = self.known.get(w[:end])
            if hit is None:
                break
            if hit:
                hits.append((end, *hit))
        raw = None if self.known.get(w[0]) else w[0].encode("utf-8", "replace")
        got = self.windows[w] = tuple(hits), hit is not None and len(w) == WINDOW, raw and (self.byte_score * len(raw), tuple(self.bytes[x] for x in raw))
        return got

    def listed(self, s: str, n: int) -> list[tuple[float, bytes]]:
        """``n_best`` with ids as bytes, remembered unless long: the parts with the smallest losses are often the same."""
        got = self.lists.get((s, n))
        if got is None:
            got = [(x, struct.pack(f"<{len(k)}I", *k)) for x, k in self.n_best(s, n)]
            if len(s) <= 64:
                if len(self.lists) > REMEMBER_LISTS:
                    self.lists.clear()
                self.lists[s, n] = got
        return got

    def n_best(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best (score, ids) of one part: A-star from the end, by the score so far and the exact rest.

        Of equal ones the last that came up goes on, and of one step's the smallest id comes up last: so a segmentation is
        followed to its start before another, and the first is that of ``part``.
        """
        best, count = self.forward(s), 0
        queue: list[tuple[float, int, int, float, tuple | None]] = [(-best[-1], 0, len(s), 0.0, None)]
        out = []
        while queue and len(out) < n:
            _, _, at, done, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for ids_, score, start in sorted(self.into(s, at), reverse=True):
                count -= 1
                heapq.heappush(queue, (-(done + score + best[start]), count, start, done + score, (ids_, path)))
        return out

    def encode(self, text: str, n: int = BEST) -> list[tuple[float, bytes]]:
        """The ``n`` best (score, ids as little-endian 32-bit numbers) of a whole text, best first."""
        parts, known = cut(text), self.parts
        if not parts:
            return [(0.0, b"")]
        scores, losses, ids = zip(*[known.get(p) or self.part(p) for p in parts], strict=True)
        total = sum(scores)
        # The best is left n - 1 times at most, so in parts with the n - 1 smallest losses; equal ones go by place.
        least = np.argsort(np.array(losses), kind="stable")[: n - 1]
        chosen = [int(k) for k in least if losses[k] < np.inf]
        if not chosen or n == 1:
            return [(total, b"".join(ids))]
        chosen.sort()
        lists = [self.listed(parts[k], n) for k in chosen]
        # The ids before, between and behind the chosen parts, the same in all.
        row = [b""] * (2 * len(chosen) + 1)
        row[::2] = [b"".join(ids[x:y]) for x, y in zip([0, *(k + 1 for k in chosen)], [*chosen, len(ids)], strict=True)]
        # Sums of one choice from each list, best first, each reached from exactly one other.
        queue = [(-sum(x[0][0] for x in lists), (0,) * len(lists), 0)]
        found = []
        fixed = total - sum(x[0][0] for x in lists)
        while queue and len(found) < n:
            cost, pick, move = heapq.heappop(queue)
            row[1::2] = [x[c][1] for c, x in zip(pick, lists, strict=True)]
            found.append((fixed - cost, b"".join(row)))
            for k in range(move, len(lists)):
                if pick[k] + 1 < len(lists[k]):
                    step = lists[k][pick[k] + 1][0] - lists[k][pick[k]][0]
                    heapq.heappush(queue, (cost - step, pick[:k] + (pick[k] + 1,) + pick[k + 1 :], k))
        return found


_PART = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def cut(text: str) -> list[str]:
    """The parts of a text: it is put behind a space, and each run of spaces starts a part."""
    return _PART.findall(SPACE + text.replace(" ", SPACE)) if text else []


@functools.lru_cache(2)
def load(path: str) -> Model:
    return Model(path)


class Surface:
    """What each id of a vocabulary file stands for."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(k) for k in range(m.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if m.is_byte(k) else x.replace(SPACE, " ").encode() for k, x in enumerate(names)]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids, without the space that encoding puts first."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


@functools.lru_cache(2)
def surface(path: str) -> Surface:
    return Surface(path)


class _Encoder:
    def __init__(self, path: str, n: int) -> None:
        self.path, self.n = path, n

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(self.path)
        for b in slices(batches, 1):
            found = [model.encode(text or "", self.n) for text in b.column(1).to_pylist()]
            ids = [i for f in found for _, i in f]
            outer = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            inner = pa.array(np.cumsum([0, *(len(i) // 4 for i in ids)]), pa.int32())
            lists = pa.ListArray.from_arrays(inner, pa.array(np.frombuffer(b"".join(ids), "<i4")))
            pieces = pa.array([len(f[0][1]) // 4 for f in found], pa.int64())
            scores = pa.ListArray.from_arrays(outer, pa.array([x for f in found for x, _ in f], pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, pieces, scores, pa.ListArray.from_arrays(outer, lists)], ["doc_id", "text", "n_pieces", "scores", "ids"])


def encode(docs: DataFrame, path: str, n: int = BEST) -> DataFrame:
    """Per row: doc_id, text, n_pieces of the best segmentation, and scores and ids of the ``n`` best (of all, if there are fewer), best first."""
    return docs.select("doc_id", "text").mapInArrow(_Encoder(path, n), "doc_id long, text string, n_pieces long, scores array<double>, ids array<array<int>>")


class _Decoder:
    def __init__(self, path: str, at: int) -> None:
        self.path, self.at = path, at

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = surface(self.path)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                lists = part.column(self.at)
                # All ids of the rows as one run of bytes each, cut where the lists end.
                pieces = list(map(back.bytes.__getitem__, lists.flatten().to_numpy(zero_copy_only=False).tolist()))
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
                starts, known = [0, *ends[:-1]], lists.is_valid().to_pylist()
                texts = [b"".join(pieces[x:y]).decode("utf-8", "replace").removeprefix(" ") if ok else None for x, y, ok in zip(starts, ends, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded``: the text of the column ``ids`` of piece ids; null for null. An id off the vocabulary is an error."""
    return rows.mapInArrow(_Decoder(path, rows.columns.index(ids)), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


class _Digester:
    """What ``encode`` and ``decode`` give of each text, digested where it is made: the ids of all segmentations are several times the texts."""

    def __init__(self, path: str, n: int) -> None:
        self.path, self.n = path, n

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, back = load(self.path), surface(self.path)
        for b in slices(batches, 1):
            rows = []
            for text in b.column(1).to_pylist():
                found = model.encode(text or "", self.n)
                best = np.frombuffer(found[0][1], "<u4").tolist()
                same = back.decode(best) == (text or "").replace(SPACE, " ")
                rows.append((len(best), [x for x, _ in found], [hashlib.sha256(i).hexdigest() for _, i in found], same))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_pieces", "scores", "ids_sha256", "decoded"])


def encode_documents(docs: DataFrame, path: str, n: int = BEST) -> DataFrame:
    """Per row: doc_id, n_pieces of the best segmentation, scores and id digests of the ``n`` best, and whether decoding the best gives the text back.

    A digest is that of the ids as little-endian 32-bit numbers. The space mark itself, in a text, comes back as a space: all that encoding loses.
    """
    return docs.select("doc_id", "text").mapInArrow(_Digester(path, n), "doc_id long, n_pieces long, scores array<double>, ids_sha256 array<string>, decoded boolean")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spread(table(spark, sf_dir, "documents")), default_path())
