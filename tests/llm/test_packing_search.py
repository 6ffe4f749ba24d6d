"""Local search of packing goes over all sequences and ends where no two gain."""

from collections import Counter
from itertools import combinations

import numpy as np

from spanwise.llm import packing


def can_gain(a, b, capacity):
    """Whether one or two documents of ``a``, for none, one or two of ``b``, fill ``b`` more: by brute force."""
    room = capacity - sum(b)
    one, two = lambda x: set(x), lambda x: {u + v for u, v in combinations(x, 2)}
    moves = [(s, t) for s in one(a) for t in {0} | one(b) | two(b)] + [(s, t) for s in two(a) for t in one(b)]
    return any(0 < s - t <= room for s, t in moves)


def test_no_two_sequences_gain():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        h = Counter(rng.integers(350, 800, 400).tolist())
        plan = packing.plan(h)
        used = Counter()
        for pattern, n in plan:
            used += Counter({x: k * n for x, k in Counter(pattern).items()})
        assert used == h
        if sum(n for _, n in plan) > -(-sum(x * n for x, n in h.items()) // 2048):
            pairs = [(a, b) for a, _ in plan for b, m in plan if sum(a) <= sum(b) < 2048 and (a != b or m > 1)]
            assert not any(can_gain(a, b, 2048) for a, b in pairs)


def test_search_reaches_beyond_a_few_hundred_sequences():
    h = Counter(np.random.default_rng(1).integers(200, 700, 6000).tolist())
    assert sum(n for _, n in packing.plan(h)) <= 1325
