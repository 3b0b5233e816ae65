"""Mixing sources to target weights by Pfair scheduling.

A source with weight w (of the sum of all) gives out its documents in blocks. Block j (from 0) is released at floor(j / w) and due at ceil((j + 1) / w), in
block slots. Earliest deadline first over the released blocks serves every block in its window, so after any number of
slots a source is less than one block from its target. Weights are exact fractions, never rounded; their least common denominator is the
schedule's period. When a source runs out, a new phase starts with the weights of the others, scaled up; no document is dropped or repeated.

The plan holds, for each phase, the blocks of one period (or of the phase, where that is shorter) and how often it repeats. One task writes it as a stream and
holds one row a source; it has no more rows than there are blocks, and is joined like any table. Blocks are numbered without bringing a source
into one task: documents are dealt to buckets by a hash, bucket counts are summed ahead, and numbers are given within a bucket.

Defined cases: a null source is a source of its own; sources without a weight (or with one of zero or less) come after all others, by equal
weights; null or repeated ids keep their rows; empty tables give empty results; other columns are kept, and replaced only where they are
named as a result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from densigrid.llm.common import discard, packed, quoted, salted_join, unpacked, written

RESULTS = ("_phase", "_block", "_release", "_deadline", "_slot", "_place")
TILE = 64  # blocks of a source among which a block looks for its phase
PLAN = "kind int, phase int, name string, start long, place long, period long, c long, lo long, hi long, j long, release long, due long, slot long"
_FIELDS = [x.split(" ")[0] for x in PLAN.split(", ")]
SPAN, CELL = 0, 1


def source_name(source: str):
    """A text for each source, nulls included, in the order that ties go by."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))


def exact_shares(weights: dict) -> tuple[int, dict]:
    """(period, blocks of each source in a period) of weights, taken as the decimals that they print as."""
    share = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in weights.items()}
    total = sum(share.values())
    share = {s: w / total for s, w in share.items()}
    period = math.lcm(*(w.denominator for w in share.values()))
    return period, {s: w.numerator * (period // w.denominator) for s, w in share.items()}


def edf(slots: dict, period: int) -> Iterator[tuple]:
    """(source, block, release, deadline, slot) of the slots of one period, earliest deadline first, ties by source name."""
    todo = [(0, s, 0) for s in slots]
    heapq.heapify(todo)
    ready: list = []
    for slot in range(period):
        while todo and todo[0][0] <= slot:
            release, s, j = heapq.heappop(todo)
            heapq.heappush(ready, (-(-(j + 1) * period // slots[s]), s, j, release))
            if j + 1 < slots[s]:
                heapq.heappush(todo, ((j + 1) * period // slots[s], s, j + 1))
        deadline, s, j, release = heapq.heappop(ready)
        yield s, j, release, deadline, slot


def plan(rows: dict[str, int], weight: Callable[[str], object], block_rows: int) -> Iterator[tuple]:
    """Rows of PLAN. A SPAN gives the blocks lo up to hi of a source to a phase; a CELL the windows and slots of the j-th block of a period."""
    left = {s: -(-n // block_rows) for s, n in rows.items() if n > 0}
    given = dict.fromkeys(left, 0)
    phase = start = place = 0
    while left:
        weights = {s: w for s in left if (w := weight(s)) is not None and Fraction(str(w)) > 0} or dict.fromkeys(left, 1)
        period, slots = exact_shares(weights)
        # The phase ends with some source's last block. Whole periods before the one in which that is:
        whole = min((left[s] - 1) // c for s, c in slots.items())
        last = {s: left[s] - 1 - whole * c for s, c in slots.items()}
        served, ended = dict.fromkeys(slots, 0), None
        for s, j, release, due, slot in edf(slots, period):
            if ended is not None and not whole:
                break
            yield CELL, phase, s, 0, 0, 0, 0, 0, 0, j, release, due, slot
            if ended is None:
                served[s] += 1
                if j == last[s]:
                    ended = s, slot + 1
        done, length = {s: whole * c + served[s] for s, c in slots.items()}, whole * period + ended[1]
        for s, c in slots.items():
            if done[s]:
                yield SPAN, phase, s, start, place, period, c, given[s], given[s] + done[s], 0, 0, 0, 0
                given[s], left[s] = given[s] + done[s], left[s] - done[s]
        # All blocks are full but for the last one of a source.
        place += length * block_rows - (-rows[ended[0]] % block_rows)
        start, phase = start + length, phase + 1
        left = {s: n for s, n in left.items() if n}


def tie(docs: DataFrame) -> Column:
    """What rows of equal ids go by: a hash of all columns of ``docs``. Carried along, it gives a row its place again after its other columns have changed."""
    return F.xxhash64(*(F.col(quoted(c)) for c in docs.columns))


def numbered(docs: DataFrame, source: str, order: str, seed: int, n: int, ties: str | None = None) -> DataFrame:
    """(row, name, seq): the packed rows of ``docs`` with their number (from 0) within their source in a seeded order, that of a digest."""
    buckets = max(64, math.isqrt(n))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(order).cast("string"), F.lit(""))))
    keyed = docs.select(packed(docs), source_name(source).alias("name"), digest.alias("h"), *([F.col(quoted(ties)).alias("tie")] if ties else []))
    # Buckets follow the digest's order. Equal digests (of repeated ids) go by ``ties``, or by the whole row.
    bucket = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * buckets).cast("int")
    keyed = keyed.withColumn("b", bucket)
    ahead = Window.partitionBy("name").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("name", "b").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("name", "b", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("off"))
    within = Window.partitionBy("name", "b").orderBy("h", F.col("tie") if ties else F.xxhash64("row"))
    return keyed.withColumn("i", F.row_number().over(within) - 1).join(offsets, ["name", "b"]).select("row", "name", "h", (F.col("off") + F.col("i")).alias("seq"))


def schedule(docs: DataFrame, weights: dict | Callable[[str], object] | None = None, source: str = "source", order: str = "doc_id", block_rows: int = 4, seed: int = 11, ties: str | None = None) -> DataFrame:
    """``docs`` with _phase, _block, _release, _deadline, _slot (all in block slots, global) and _place, the place in the mix (from 0, without gaps).

    ``weights``: target share of each source in any unit, as a dict by source or as a function of its text; None: equal shares. ``ties``: a column that rows of equal
    ids go by; None: the whole row.
    """
    if weights is None:
        weight = lambda s: 1
    elif callable(weights):
        weight = lambda s: weights(None if s == "null" else s[1:])
    else:
        by_name = {"null" if s is None else f"s{s}": w for s, w in weights.items()}
        weight = by_name.get
    sizes = written(docs.groupBy(source_name(source).alias("name")).agg(F.count(F.lit(1)).alias("n")), "pfair-sources")
    total = sizes.agg(F.sum("n")).first()[0] or 0

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = {s: n for part in batches for s, n in zip(part["name"], part["n"].tolist())}
        held = []
        for x in plan(dict(sorted(rows.items())), weight, block_rows):
            held.append(x)
            if len(held) == 10_000:
                yield pd.DataFrame(held, columns=_FIELDS)
                held = []
        yield pd.DataFrame(held, columns=_FIELDS)

    # One row a source goes to the one task.
    laid = written(sizes.coalesce(1).mapInPandas(lay_out, PLAN), "pfair-plan")
    discard(sizes)
    tiles = F.explode(F.sequence(F.floor(F.col("lo") / TILE), F.floor((F.col("hi") - 1) / TILE)))
    spans = laid.where(F.col("kind") == SPAN).withColumn("tile", tiles).select(F.struct("name", "tile").alias("at"), "phase", "start", "place", "period", "c", "lo", "hi")
    cells = laid.where(F.col("kind") == CELL).select(F.struct("phase", "name", "j").alias("cell"), "release", "due", "slot")
    rows = numbered(docs, source, order, seed, total, ties).withColumn("block", F.floor(F.col("seq") / block_rows).cast("long"))
    rows = rows.withColumn("at", F.struct("name", F.floor(F.col("block") / TILE).alias("tile")))
    inside = (F.col("block") >= F.col("lo")) & (F.col("block") < F.col("hi"))
    met = rows.join(spans, "at").where(inside).withColumn("k", F.col("block") - F.col("lo"))
    met = met.withColumn("cell", F.struct("phase", "name", F.pmod("k", F.col("c")).alias("j")))
    # A short period's cells hold very many rows each; so few cells are broadcast by Spark's own size check, and dealt to several tasks otherwise.
    met = met.join(cells, "cell") if cells.count() <= 65_536 else salted_join(met, cells, "cell", "h", total)
    local = F.floor(F.col("k") / F.col("c")).cast("long") * F.col("period")
    base, at = F.col("start") + local, local + F.col("slot")
    more = {
        "_phase": F.col("phase"), "_block": F.col("block"), "_release": base + F.col("release"), "_deadline": base + F.col("due"), "_slot": F.col("start") + at,
        "_place": F.col("place") + at * block_rows + F.pmod("seq", F.lit(block_rows)),
    }
    return unpacked(met, docs, more)


def mixed(docs: DataFrame, weights: dict | Callable[[str], object] | None = None, source: str = "source", order: str = "doc_id", block_rows: int = 4, parts: int | None = None) -> DataFrame:
    """Every row and the columns of ``docs``, in the order of the mix: range partitions by place, sorted within."""
    rows = docs.select(packed(docs), F.col(source).alias("source"), F.col(order).alias("id"), tie(docs).alias("tie"))
    placed = schedule(rows, weights, "source", "id", block_rows, ties="tie")
    ranged = placed.repartitionByRange(parts, "_place") if parts else placed.repartitionByRange("_place")
    return unpacked(ranged.sortWithinPartitions("_place"), docs)
