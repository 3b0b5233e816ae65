"""Validity of rings by a sweep against all pairs of sides."""

import time

import numpy as np

from densigrid.operators.simple import is_simple


def by_pairs(ring: list[tuple]) -> bool:
    """Whether no two sides of a closed ring share a point, but for the ends of neighbours. Whole numbers, exact; a side is held against all later ones at once."""
    at = np.array(ring)
    p, q = at[:-1], at[1:]
    n = len(p)
    if len({tuple(x) for x in p.tolist()}) < n:
        return False
    turn = lambda a, b, c: np.sign((b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]))
    boxed = lambda a, b, c: ((np.minimum(a, b) <= c) & (c <= np.maximum(a, b))).all(axis=-1)
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        near = (j == i + 1) | ((i == 0) & (j == n - 1))
        a, b, c, d = p[i], q[i], p[j], q[j]
        t = [turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)]
        cross = (t[0] * t[1] < 0) & (t[2] * t[3] < 0)
        on = [(t[0] == 0) & boxed(a, b, c), (t[1] == 0) & boxed(a, b, d), (t[2] == 0) & boxed(c, d, a), (t[3] == 0) & boxed(c, d, b)]
        shared = sum(x.astype(int) for x in on)
        # neighbours share one corner, which is on both; a third hit means that one folds back on the other
        if (np.where(near, shared > 2, cross | (shared > 0))).any():
            return False
    return True


def closed(points):
    return [*map(tuple, points), tuple(points[0])]


def test_sweep_equals_all_pairs():
    rng = np.random.default_rng(8)
    seen = set()
    for k in range(6000):
        wide = (3, 4, 6, 12, 10**6)[k % 5]
        pts = rng.integers(0, wide, (rng.integers(3, 9), 2)).tolist()
        if k % 2:  # around the middle: often simple
            mid = np.mean(pts, axis=0)
            pts = sorted(pts, key=lambda p: np.arctan2(p[1] - mid[1], p[0] - mid[0]))
        ring = closed(pts)
        assert is_simple(ring) == by_pairs(ring), ring
        seen.add((wide, is_simple(ring)))
    assert len(seen) == 10


def test_known_rings():
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    assert is_simple(closed(square)) and is_simple(closed([(0, 0), (2, 0), (4, 0), (4, 4), (4, 2), (3, 2), (3, 4)])) is False
    assert not is_simple(closed([(0, 0), (4, 4), (4, 0), (0, 4)]))  # crossed
    assert not is_simple(closed([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]))  # a corner on a side
    assert not is_simple(closed([(0, 0), (4, 0), (2, 0)])) and not is_simple([(0, 0), (1, 1), (0, 0)])


def test_a_hundred_thousand_sides():
    n = 50_000
    comb = [p for i in range(n // 2) for p in ((2 * i, 10), (2 * i + 1, 0))]
    ring = closed([*comb, *((x, y + 20) for x, y in comb[::-1])])
    began = time.perf_counter()
    assert is_simple(ring) and len(ring) == 2 * n + 1
    bad = ring[:]
    bad[n + 100] = (bad[n + 100][0], -5)
    assert not is_simple(bad)
    assert time.perf_counter() - began < 60
