"""Whether closed rings of whole-numbered points are simple, by a sweep over their corners. Exact, and about n log n."""

from __future__ import annotations

Point = tuple[int, int]


def _turn(a: Point, b: Point, p: Point) -> int:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _meet(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two sides share a point."""
    t, u, v, w = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if (t > 0) != (u > 0) and t and u and (v > 0) != (w > 0) and v and w:
        return True
    within = lambda p, q, x: min(p[0], q[0]) <= x[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= x[1] <= max(p[1], q[1])
    return (t == 0 and within(a, b, c)) or (u == 0 and within(a, b, d)) or (v == 0 and within(c, d, a)) or (w == 0 and within(c, d, b))


class Sweep:
    """The sides that a vertical line meets, from low to high, as the line goes over the corners by x and then y. Side i goes from corner i to the next."""

    def __init__(self, corners: list[Point]):
        self.at = corners
        self.n = len(corners)
        self.order: list[int] = []

    def ends(self, side: int) -> tuple[Point, Point]:
        """From the corner that the line meets first."""
        a, b = self.at[side], self.at[(side + 1) % self.n]
        return (a, b) if a < b else (b, a)

    def below(self, p: Point) -> tuple[int, int]:
        """How many sides are below p, and how many from there on go through it."""
        lo, hi = 0, len(self.order)
        while lo < hi:
            mid = (lo + hi) // 2
            if _turn(*self.ends(self.order[mid]), p) > 0:
                lo = mid + 1
            else:
                hi = mid
        on = 0
        while lo + on < len(self.order) and on < 3 and _turn(*self.ends(self.order[lo + on]), p) == 0:
            on += 1
        return lo, on

    def crossed(self, i: int) -> bool:
        """Whether the sides at places i and i + 1 of the order meet; those next to each other on the ring may, at their common corner."""
        if i < 0 or i + 1 >= len(self.order):
            return False
        s, t = self.order[i], self.order[i + 1]
        if (s - t) % self.n in (1, self.n - 1):
            return False
        return _meet(*self.ends(s), *self.ends(t))

    def passes(self, k: int) -> bool:
        """Takes the line over corner k; whether no meeting of sides has come up."""
        p, sides = self.at[k], ((k - 1) % self.n, k)
        ended = [s for s in sides if self.ends(s)[1] == p]
        begun = [s for s in sides if self.ends(s)[0] == p]
        i, on = self.below(p)
        if on != len(ended) or set(self.order[i : i + on]) != set(ended):
            return False  # another side goes through the corner
        if len(begun) == 2:
            a, b = (self.ends(s)[1] for s in begun)
            side = _turn(p, a, b)
            if side == 0:
                return False  # one folds back on the other
            begun = begun if side > 0 else begun[::-1]
        self.order[i : i + on] = begun
        return not any(self.crossed(j) for j in range(i - 1, i + len(begun)))


def is_simple(ring: list[Point]) -> bool:
    """Whether no two sides of a closed ring (its last point is its first) share a point, but for the ends of neighbours."""
    corners = ring[:-1]
    if len(corners) < 3 or len(set(corners)) < len(corners):
        return False
    sweep = Sweep(corners)
    return all(sweep.passes(k) for k in sorted(range(len(corners)), key=corners.__getitem__))
