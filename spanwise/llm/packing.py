"""Operator 5: best-fit packing of token pieces into sequences, improved by swap-based local search.

Only the histogram of piece lengths (at most ``CAPACITY`` numbers, whatever the corpus) leaves the executors. From it
the driver makes patterns: a multiset of lengths that fills one sequence, and how many sequences follow it. Best-fit
decreasing makes the first ones; local search then moves one document, or exchanges one for one or two for one, from a
sequence to one at least as full, equal sequences together, until no two sequences gain by it or no fewer could hold all. Pieces
find their places by their rank among those of equal length, counted in slices, so no length is ever sorted in one task.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each; null ids stay; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import array
import bisect
import functools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwise.llm.common import materialise, released, slices, spread, table

CAPACITY = 2048
END_ID = 0
#: About the rows of a length that are ranked together.
SLICE = 1024
#: About the bytes of remembered words that a worker holds, twice.
HELD = 40 << 20
#: Characters whose unknown words are tokenised in one call.
TOGETHER = 1 << 20



class Words:
    """Ids of what stands between spaces. The vocabulary drops white space and no token spans it.

    A word of letters is one pre-token, and so is a run of marks behind it: both are kept apart, so that a word costs once
    whatever follows it. ASCII letters go to the tokenizer's model one by one; other letters are tokenised many words at a time
    and parted where a token ends a word.

    Words are remembered in two generations of HELD bytes: when the new one is full it becomes the old one, and what is
    asked for again moves back into the new one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.ends[k] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.weight = 0

    def one_by_one(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found, strict=True)}

    def together(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, many at a time."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            return self.one_by_one(words)
        data = ids.tobytes()
        return {w: data[4 * a : 4 * b] for w, a, b in zip(words, [0, *stops.tolist()], stops.tolist(), strict=False)}

    def hold(self, fresh: dict[str, bytes]) -> None:
        self.new |= fresh
        # An entry of a dictionary, a string and a byte string come to about this.
        self.weight += 200 * len(fresh) + sum(map(len, fresh)) + sum(map(len, fresh.values()))

    def unknown(self, words: set[str]) -> set[str]:
        """Those of ``words`` that aren't remembered; the others are in the new generation behind this."""
        missing = words.difference(self.new)
        ask = missing.difference(self.old)
        self.hold({w: self.old[w] for w in missing - ask})
        return ask

    def learn(self, words: set[str]) -> None:
        """See to it that ``new`` holds all of ``words``, until the next call."""
        if self.weight > HELD:
            self.old, self.new, self.weight = self.new, {}, 0
        # Lists side by side, not of pairs: so the collector of cycles has nothing to look at.
        whole, cores, tails, odd = [], [], [], set()
        for w in self.unknown(words):
            core = w.rstrip(MARKS)
            if core.isascii():
                core = core.lower()
            if core.isalpha() and core.lower().isalpha():
                whole.append(w)
                cores.append(core)
                tails.append(w[len(core) :])
            else:
                odd.add(w)
        ask, other = self.unknown(set(cores)), []
        plain: dict[str, bytes] = {}
        for core in ask:
            # Lower-case ASCII letters are what the model itself reads; others are first made so by the tokenizer's steps.
            if core.isascii():
                plain[core] = array.array("I", [x.id for x in self.model.tokenize(core)]).tobytes()
            else:
                other.append(core)
        self.hold(plain)
        other.sort()
        for k in range(0, len(other), 20_000):
            self.hold(self.together(other[k : k + 20_000]))
        self.hold(self.one_by_one(sorted(odd | self.unknown(set(tails) - {""}))))
        new = self.new
        new[""] = b""
        self.hold({w: new[core] + new[tail] for w, core, tail in zip(whole, cores, tails, strict=True)})


#: Marks that end words; any other mark inside makes a word one to be tokenised by itself.
MARKS = ".,;:!?*$&%#)]}|"


@functools.lru_cache(2)
def _words(path: str) -> Words:
    return Words(path)


def encoded(texts: list[str], path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian 32-bit numbers, the closing id last."""
    words = _words(path)
    at = 0
    while at < len(texts):
        parts, chars = [], 0
        while at < len(texts) and (not parts or chars < TOGETHER):
            chars += len(texts[at])
            parts.append(texts[at].replace("\n", " ").split(" "))
            at += 1
        words.learn(set().union(*parts) - {""})
        for p in parts:
            yield b"".join(map(words.new.__getitem__, p)) + END_ID.to_bytes(4, "little")


class _Cutter:
    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            ids, rows = b.column(0).to_pylist(), []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, data in zip(ids, encoded(texts, self.path), strict=True):
                for k, s in enumerate(range(0, len(data), 4 * CAPACITY)):
                    part = data[s : s + 4 * CAPACITY]
                    rows.append((doc, k, s // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        _words(self.path).forget()
        released()


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    return docs.select("doc_id", "text").mapInArrow(_Cutter(path), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, sequences) by best-fit decreasing; equal sequences are handled together."""
    free: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            if not free[room]:
                bisect.insort(rooms, room)
            free[room].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, n = free[room].pop()
                if not free[room]:
                    rooms.pop(at)
            else:
                room, pattern, n = capacity, (), left
            fit = room // length
            used = min(n, left // fit) if left >= fit else 0
            if used:
                add(room - fit * length, pattern + (length,) * fit, used)
                left -= used * fit
            else:
                add(room - left * length, pattern + (length,) * left, 1)
                used, left = 1, 0
            if pattern:
                add(room, pattern, n - used)
    return [x for room in sorted(free) for x in free[room]]


def fewest(histogram: dict[int, int], capacity: int) -> int:
    """A number of sequences that no packing can go below.

    For each ``a`` up to half the capacity: pieces longer than ``capacity - a`` stand alone among those of at least ``a``, those
    longer than a half stand one to a sequence, and what the others of at least ``a`` need beyond the room left there takes
    sequences of its own.
    """
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] += n
    # Python numbers: a corpus may hold more tokens than 64 bits count times the capacity.
    pieces_to = np.cumsum(count).tolist()
    tokens_to = np.cumsum(count * np.arange(capacity + 1)).tolist()
    half, best = capacity // 2, 0
    for a in range(half + 1):
        alone = pieces_to[capacity] - pieces_to[capacity - a]
        wide = pieces_to[capacity - a] - pieces_to[half]
        room = wide * capacity - (tokens_to[capacity - a] - tokens_to[half])
        small = tokens_to[half] - (tokens_to[a - 1] if a else 0)
        best = max(best, alone + wide + max(0, -(-(small - room) // capacity)))
    return best


def _pairs(items: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(sum, one, other) of two documents of a sequence, each two lengths once."""
    many = {x for k, x in enumerate(items[1:]) if x == items[k]}
    kinds = sorted(set(items))
    return sorted((u + v, u, v) for i, u in enumerate(kinds) for v in kinds[i:] if u != v or u in many)


def _best_move(a: tuple[int, ...], b: tuple[int, ...], room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """What to take from ``a`` and give back from ``b`` so that ``b`` gains most, but no more than ``room``."""
    xs, ys = sorted(set(a)), sorted(set(b))
    best: tuple[int, tuple[int, ...], tuple[int, ...]] | None = None

    def offer(gain: int, give: tuple[int, ...], back: tuple[int, ...]) -> None:
        nonlocal best
        if 0 < gain <= room and (best is None or gain > best[0]):
            best = (gain, give, back)

    for x in xs:
        offer(x, (x,), ())
        k = bisect.bisect_left(ys, x - room)
        if k < len(ys):
            offer(x - ys[k], (x,), (ys[k],))
    two = _pairs(a)
    sums = [p[0] for p in two]
    for y in ys:  # two from a for one from b
        k = bisect.bisect_right(sums, y + room) - 1
        if k >= 0:
            offer(sums[k] - y, two[k][1:], (y,))
    two = _pairs(b)
    sums = [p[0] for p in two]
    for x in xs:  # one from a for two from b
        k = bisect.bisect_left(sums, x - room)
        if k < len(sums):
            offer(x - sums[k], (x,), two[k][1:])
    return best


def _bits(sums: Iterable[int]) -> int:
    out = 0
    for s in set(sums):
        out |= 1 << s
    return out


def _above(bits: int, room: int) -> int:
    """The numbers that are more than one of ``bits``, by at most ``room``."""
    out, wide = bits << 1 if room else 0, 1
    while wide < room:
        step = min(wide, room - wide)
        out |= out << step
        wide += step
    return out


class _Kind:
    """A pattern: its fill, what it can give (sums of one and of two documents) and what it would take, as bit sets."""

    def __init__(self, number: int, items: tuple[int, ...], capacity: int) -> None:
        self.number, self.items, self.fill, self.seen = number, items, sum(items), 0
        self.one, self.two = _bits(items), _bits(p[0] for p in _pairs(items))
        room = capacity - self.fill
        self.for_one, self.for_two = _above(1 | self.one | self.two, room), _above(self.one, room)

    def gains(self, other: "_Kind") -> int:
        """Not 0 if ``other`` can gain from this."""
        return self.one & other.for_one or self.two & other.for_two


def improved(patterns: Iterable[tuple[tuple[int, ...], int]], capacity: int) -> dict[tuple[int, ...], int]:
    """Patterns and how many sequences follow each, after moves that each raise the sum of squared fills.

    Equal sequences move together. It ends when no two sequences gain, or when no fewer sequences could hold all.
    """
    kinds: dict[tuple[int, ...], _Kind] = {}
    count: dict[tuple[int, ...], int] = defaultdict(int)
    made: list[_Kind] = []
    alive: list[tuple[int, int]] = []
    # Patterns in the order they came up: a pattern that found nothing asks only those that came up since.
    came: list[_Kind] = []

    def add(items: tuple[int, ...], n: int) -> None:
        if items and items not in kinds:
            kinds[items] = _Kind(len(kinds), items, capacity)
            made.append(kinds[items])
        if items and not count[items]:
            bisect.insort(alive, (kinds[items].fill, kinds[items].number))
        # A second sequence of a pattern can be the first one's partner.
        if items and n > 0 and count[items] < 2:
            came.append(kinds[items])
        if items:
            count[items] += n
            if not count[items]:
                alive.pop(bisect.bisect_left(alive, (kinds[items].fill, kinds[items].number)))

    for items, n in patterns:
        add(tuple(sorted(items, reverse=True)), n)
    lengths: dict[int, int] = defaultdict(int)
    for items, n in count.items():
        for x in items:
            lengths[x] += n
    left, least = sum(count.values()), fewest(lengths, capacity)

    def partner(a: _Kind) -> _Kind | None:
        if a.seen:
            others = sorted((k for k in came[a.seen :] if count[k.items] and a.fill <= k.fill < capacity), key=lambda k: (k.fill, k.number))
        else:
            # The roomiest first: they take most from the sequence that is to be emptied.
            others = (made[k] for f, k in alive[bisect.bisect_left(alive, (a.fill, -1)) :] if f < capacity)
        return next((b for b in others if a.gains(b) and (b is not a or count[a.items] > 1)), None)

    at = 0
    while left > least and at < len(alive):
        a = made[alive[at][1]]
        if a.seen == len(came) or not (b := partner(a)):
            a.seen = len(came)
            at += 1
            continue
        n = count[a.items] // 2 if a is b else min(count[a.items], count[b.items])
        _, give, back = _best_move(a.items, b.items, capacity - b.fill)
        new_a, new_b = list(a.items), list(b.items)
        for x in give:
            new_a.remove(x)
            new_b.append(x)
        for y in back:
            new_b.remove(y)
            new_a.append(y)
        add(a.items, -n)
        add(b.items, -n)
        add(tuple(sorted(new_a, reverse=True)), n)
        add(tuple(sorted(new_b, reverse=True)), n)
        left -= 0 if new_a else n
        at = 0
    return {x: n for x, n in count.items() if n}


def local_search(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """``bins`` after moves that each raise the sum of squared fills; emptied ones are gone."""
    return [list(x) for x, n in improved([(tuple(b), 1) for b in bins], capacity).items() for _ in range(n)]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences follow each."""
    made = sorted(best_fit(histogram, capacity), key=lambda x: (sum(x[0]), x[0]))
    if sum(n for _, n in made) <= fewest(histogram, capacity):
        return made
    return sorted(improved(made, capacity).items())


class _Placer:
    """Turns (length, rank) into (sequence_id, offset) by the runs of ranks that each place of a pattern takes."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        sequence = 0
        for pattern, n in patterns:
            offset = 0
            for length in pattern:
                runs[length].append((taken[length], sequence, offset))
                taken[length] += n
                offset += length
            sequence += n
        self.runs = {k: np.array(v, np.int64) for k, v in runs.items()}

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                run = self.runs[int(k)]
                hit = run[np.searchsorted(run[:, 0], rank[at], "right") - 1]
                sequence[at], offset[at] = hit[:, 1] + rank[at] - hit[:, 0], hit[:, 2]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in PIECE], pa.array(sequence), pa.array(offset)], [*PIECE, "sequence_id", "offset"])


PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def pack(docs: DataFrame, path: str) -> DataFrame:
    """Per piece its document, place in the document, checksum, and place in the sequences."""
    cut = materialise(pieces(docs, path))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # A row per length, so never more than CAPACITY.
    parts = docs.sparkSession.createDataFrame([(k, 1 + n // SLICE) for k, n in histogram.items()], "length long, slices long")
    cut = cut.join(F.broadcast(parts), "length").withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.col("slices")))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy("length", "slice").agg(F.count("*").alias("n")).select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece")
    ranked = cut.withColumn("row", F.row_number().over(own)).join(first, ["length", "slice"]).select(*PIECE, (F.col("first") + F.col("row") - 1).alias("rank"))
    return ranked.mapInArrow(_Placer(plan(histogram)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")), default_path())
