"""Fill-in-the-middle rearrangement of texts, held as ropes while they are cut and put together.

Null texts count as empty ones, and empty texts and those that hold a sentinel stay plain. Null ids hash as the empty text. Repeated rows are treated alike and all
are kept, all other columns pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from densigrid.llm.common import extended

LEAF = 2048  # code points of a leaf, if its units allow it
SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
ORDERS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}  # which sentinel, and so which part, comes when


class Rope:
    """A text as a balanced tree of pieces; every node knows how many units and code points are below it. Nodes never change, so trees share them."""

    __slots__ = ("height", "left", "points", "right", "text", "units")

    def __init__(self, text: str = "", units: int = 0, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.units, self.points, self.height = units, len(text), 0
        else:
            self.units, self.points, self.height = left.units + right.units, left.points + right.points, 1 + max(left.height, right.height)

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.text
            else:
                todo += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


@dataclass(frozen=True)
class Units:
    """What a text is counted in: code points, or the matches of a pattern from left to right. What is between two matches goes with the later, what follows the last
    goes with the last; a text without matches is one unit."""

    pattern: str | None = None

    def ends(self, text: str) -> list[int] | range:
        """Where each unit ends."""
        if self.pattern is None:
            return range(1, len(text) + 1)
        found = [m.end() for m in re.finditer(self.pattern, text) if m.end() > m.start()] or [len(text)]
        found[-1] = len(text)
        return found if text else []

    def rope(self, text: str) -> Rope:
        """A balanced tree whose leaves end where units do."""
        ends = self.ends(text)
        pieces, lo, first = [], 0, 0
        while first < len(ends):
            last = first + LEAF - 1 if self.pattern is None else self._within(ends, first, lo + LEAF)
            last = min(last, len(ends) - 1)
            pieces.append(Rope(text[lo : ends[last]], last + 1 - first))
            lo, first = ends[last], last + 1
        while len(pieces) > 1:
            pieces = [joined(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0] if pieces else Rope()

    @staticmethod
    def _within(ends: list[int], first: int, limit: int) -> int:
        last = first
        while last + 1 < len(ends) and ends[last + 1] <= limit:
            last += 1
        return last

    def split(self, rope: Rope, rank: int) -> tuple[Rope, Rope]:
        """The first ``rank`` units, and the rest."""
        if rope.left is None:
            if rank <= 0 or rank >= rope.units:
                return (Rope(), rope) if rank <= 0 else (rope, Rope())
            at = self.ends(rope.text)[rank - 1]
            return Rope(rope.text[:at], rank), Rope(rope.text[at:], rope.units - rank)
        if rank <= rope.left.units:
            low, high = self.split(rope.left, rank)
            return low, joined(high, rope.right)
        low, high = self.split(rope.right, rank - rope.left.units)
        return joined(rope.left, low), high


def split_points(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first ``rank`` code points, and the rest; a leaf that is cut counts its units as code points."""
    if rope.left is None:
        cut = rope.text[: max(rank, 0)]
        return Rope(cut, len(cut)), Rope(rope.text[len(cut) :], rope.points - len(cut))
    if rank <= rope.left.points:
        low, high = split_points(rope.left, rank)
        return low, joined(high, rope.right)
    low, high = split_points(rope.right, rank - rope.left.points)
    return joined(rope.left, low), high


def joined(a: Rope, b: Rope) -> Rope:
    """One tree after another; sides differ by one level at most, so a tree of n leaves stays of about log n levels."""
    if not a.points or not b.points:
        return a if a.points else b
    if a.height > b.height + 1:
        return _level(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _level(joined(a, b.left), b.right)
    return Rope(left=a, right=b)


def _level(a: Rope, b: Rope) -> Rope:
    """A node of two trees that differ by two levels at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Rope(left=a.left, right=Rope(left=a.right, right=b))
        return Rope(left=Rope(left=a.left, right=a.right.left), right=Rope(left=a.right.right, right=b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Rope(left=Rope(left=a, right=b.left), right=b.right)
        return Rope(left=Rope(left=a, right=b.left.left), right=Rope(left=b.left.right, right=b.right))
    return Rope(left=a, right=b)


@dataclass(frozen=True)
class Plan:
    """How texts are rearranged. Of 100 texts that can be, ``plain`` stay as they are; of 100 others, ``spm`` have the suffix first."""

    seed: str = "1"
    plain: int = 10
    spm: int = 20
    units: Units = Units()
    sentinels: tuple[str, str, str] = SENTINELS

    def arranged(self, text: str | None, id_: object) -> tuple[str, Rope, int, int | None, int | None]:
        """(form, rearranged text, its units before, code points of prefix and middle), by a hash of the id."""
        text = text or ""
        rope = self.units.rope(text)
        digest = hashlib.sha256(f"{self.seed}:{'' if id_ is None else id_}".encode()).hexdigest()
        h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
        if not text or any(s in text for s in self.sentinels) or h[2] % 100 >= 100 - self.plain:
            return "plain", rope, rope.units, None, None
        lo, hi = sorted((h[0] % (rope.units + 1), h[1] % (rope.units + 1)))
        head, suffix = self.units.split(rope, hi)
        prefix, middle = self.units.split(head, lo)
        form, parts, out = "spm" if h[3] % 100 < self.spm else "psm", (prefix, suffix, middle), Rope()
        for k in ORDERS[form]:
            out = joined(joined(out, Rope(self.sentinels[k], len(self.sentinels[k]))), parts[k])
        return form, out, rope.units, prefix.points, middle.points

    def restored(self, output: str | Rope | None, form: str | None) -> Rope:
        """The text before, from the rearranged one and its form alone."""
        rope = output if isinstance(output, Rope) else Units().rope(output or "")
        if form not in ORDERS:
            return rope
        flat, parts = str(rope), {}
        marks = [self.sentinels[k] for k in ORDERS[form]]
        starts = [0]
        for mark in marks[1:]:
            starts.append(flat.index(mark, starts[-1] + 1))
        for k, mark, at in reversed(list(zip(ORDERS[form], marks, starts, strict=True))):
            rope, tail = split_points(rope, at)
            parts[k] = split_points(tail, len(mark))[1]
        return joined(joined(parts[0], parts[2]), parts[1])


def transformed(docs: DataFrame, plan: Plan = Plan(), text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``docs`` with _form, _units, _prefix_chars, _middle_chars (null if plain) and _output, the rearranged text."""

    def work(texts: list, ids: list) -> tuple:
        rows = [plan.arranged(t, i) for t, i in zip(texts, ids, strict=True)]
        return tuple([r[k] for r in rows] for k in (0, 2, 3, 4)) + ([str(r[1]) for r in rows],)

    return extended(docs, [text, id_], "_form string, _units long, _prefix_chars long, _middle_chars long, _output string", work)


def inverted(docs: DataFrame, plan: Plan = Plan(), output: str = "_output", form: str = "_form") -> DataFrame:
    """``docs`` with _restored, the text before, from the rearranged text and its form."""
    return extended(docs, [output, form], "_restored string", lambda o, f: ([str(plan.restored(x, y)) for x, y in zip(o, f, strict=True)],))


def digests(docs: DataFrame, plan: Plan = Plan(), text: str = "text", id_: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with what transformed() says of each and the SHA-256 of the rearranged text and of the text restored from it. No text leaves its task."""

    def digest(rope: Rope) -> str:
        held = hashlib.sha256()
        for piece in rope.leaves():
            held.update(piece.encode())
        return held.hexdigest()

    def work(texts: list, ids: list) -> tuple:
        out: tuple = ([], [], [], [], [], [])
        for t, i in zip(texts, ids, strict=True):
            form, rope, *counts = plan.arranged(t, i)
            for held, x in zip(out, (form, *counts, digest(rope), digest(plan.restored(str(rope), form))), strict=True):
                held.append(x)
        return out

    return extended(docs, [text, id_], "_form string, _units long, _prefix_chars long, _middle_chars long, _output_sha256 string, _restored_sha256 string", work, drop=(text,))
