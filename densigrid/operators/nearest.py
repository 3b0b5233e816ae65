"""Exact nearest neighbours of vectors: cells around pivots, bounds by the triangle inequality, and only those cells visited that may hold a nearer row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densigrid.operators.raster import shuffled
from densigrid.sources.stage import staged

PIVOTS = 64  # rows drawn as pivots; more only spare work
BLOCK = 512  # rows of a cell that are handled at once
EXACT = 1 << 16  # distances worked out from differences at a time
_SLACK = 1 + 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between all rows of two small sets, each from the differences themselves."""
    return np.sqrt(np.stack([((x - b) ** 2).sum(axis=1) for x in a])) if len(a) else np.zeros((0, len(b)))


def _matrix(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.float64).reshape(-1, width)


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between all rows of two sets by one product of matrices, and how far each row of them may be off."""
    with np.errstate(over="ignore", invalid="ignore"):
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        return aa[:, None] + bb - 2 * (a @ b.T), (aa + bb.max(initial=0)) * (1e-15 * (a.shape[1] + 8)) + 1e-300


def _least(squares: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th least square; infinite where there are fewer, or where some are not known."""
    if squares.shape[1] < k:
        return np.full(len(squares), np.inf)
    found = np.partition(squares, k - 1, axis=1)[:, k - 1]
    return np.where(np.isnan(found), np.inf, found)


def _nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of up to the k nearest rows j of ``x`` of each row i of ``q``, ties to the smaller id, and the bounds lowered to the k-th of them.

    The product of matrices tells which rows may be nearest, no farther than ``bound`` (squared); only their distances are worked out from the differences.
    """
    squares, off = _squares(q, x)
    own = q_ids[:, None] == ids
    squares[own] = np.inf
    bound = np.minimum(bound, _least(squares, k) + 2 * off)
    with np.errstate(invalid="ignore"):
        i, j = np.nonzero(~(squares > (bound + off)[:, None]) & ~own)
    far = np.concatenate([np.zeros(0), *(np.sqrt(((q[i[lo : lo + EXACT]] - x[j[lo : lo + EXACT]]) ** 2).sum(axis=1)) for lo in range(0, len(i), EXACT))])
    order = np.lexsort((ids[j], far, i))
    i, j, far = i[order], j[order], far[order]
    count = np.bincount(i, minlength=len(q))
    first = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) < k
    return i[first], j[first], far[first], bound


def nearest_neighbors(rows: DataFrame, key: str, vector: str, k: int, within: float | None = None) -> DataFrame:
    """(key, neighbor, distance, rank): the k nearest other rows of each row, ties to the smaller key, no farther than ``within`` if that is given. Exact.

    A row is in the cell of its nearest pivot. Within its own block of a cell it has k neighbours already, the farthest of them at distance t. A cell whose pivot is farther
    than t plus its radius from the row can't hold a nearer one, which leaves a block the cells that one of its rows may need; blocks meet the blocks of those only, and in
    a block the rows whose distance from their pivot is too different are passed over as well. Large cells are dealt to blocks, so no task holds one; where vectors have
    no structure most cells must be visited, as exactness then costs.

    Rows whose vector is null, of another length than most of the pivots', or holds nulls or no finite numbers take no part. Keys are whole numbers, each of one row.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    drawn = kept.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    out = f"{key} long, neighbor long, distance double, rank int"
    if not drawn:
        return spark.createDataFrame([], out)
    width = int(np.bincount([len(r["v"]) for r in drawn]).argmax())
    pivots = np.unique(np.array([r["v"] for r in drawn if len(r["v"]) == width]), axis=0)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = np.array(part["v"].tolist(), dtype=np.float64).reshape(-1, width)
            far = _distances(x, pivots)
            cell = far.argmin(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
            yield pd.DataFrame({"id": part["id"], "cell": cell, "far": far[np.arange(len(x)), cell], "v": [r.tobytes() for r in x]})

    own = staged(kept.where(F.size("v") == width).mapInPandas(placed, "id long, cell int, far double, v binary"))
    cells = own.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # at most PIVOTS rows
    radius = np.full(len(pivots), -np.inf)
    for c in cells:
        radius[c["cell"]] = c["radius"]
    ways = F.element_at(F.create_map(*(F.lit(x) for c in cells for x in (c["cell"], -(-c["n"] // BLOCK)))), F.col("cell"))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        cell, x = int(part["cell"].iloc[0]), _matrix(b"".join(part["v"]), width)
        ids, far = part["id"].to_numpy(), part["far"].to_numpy()
        squares, off = _squares(x, x)
        np.fill_diagonal(squares, np.inf)
        to = np.sqrt(np.maximum(_least(squares, k) + 2 * off, 0)) * _SLACK  # no less than the k-th distance
        if within is not None:
            to = np.minimum(to, within)
        reach = _distances(x, pivots) <= (to[:, None] + radius) * _SLACK + 1e-12
        reach[:, cell] = True
        need = np.flatnonzero(reach.any(axis=0) & np.isfinite(radius)).astype(np.int32)
        return pd.DataFrame({"cell": [cell], "block": [int(part["block"].iloc[0])], "ids": [ids.tobytes()], "far": [far.tobytes()], "to": [to.tobytes()], "v": [x.tobytes()], "need": [need.tolist()]})

    dealt = own.withColumn("block", F.pmod(F.xxhash64("id"), ways).cast("int"))
    blocks = staged(dealt.groupBy("cell", "block").applyInPandas(packed, "cell int, block int, ids binary, far binary, to binary, v binary, need array<int>"))
    asked = blocks.select(F.col("ids").alias("q_ids"), F.col("to").alias("q_to"), F.col("v").alias("q_v"), F.explode("need").alias("cell"))

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bound = None, None
        for part in batches:
            for row in part.itertuples(index=False):
                q_ids, ids = np.frombuffer(row.q_ids, dtype=np.int64), np.frombuffer(row.ids, dtype=np.int64)
                to, far = np.frombuffer(row.q_to), np.frombuffer(row.far)
                q, x = _matrix(row.q_v, width), _matrix(row.v, width)
                if (row.q_ids, row.cell) != last:  # the blocks of a cell follow each other, and each lowers the bounds for the next
                    last, bound = (row.q_ids, row.cell), (to * _SLACK + 1e-12) ** 2
                    at = _distances(q, pivots[row.cell : row.cell + 1])[:, 0]
                    low, high = (at - to * _SLACK).min() - 1e-12, (at + to * _SLACK).max() + 1e-12
                near = ~((far < low) | (far > high))
                i, j, d, bound = _nearest(q, q_ids, x[near], ids[near], k, bound)
                keep = d <= to[i] * _SLACK + 1e-12
                yield pd.DataFrame({key: q_ids[i[keep]], "neighbor": ids[near][j[keep]], "distance": d[keep]})

    pairs = asked.join(shuffled(blocks.select("cell", "ids", "far", "v")), "cell").mapInPandas(met, f"{key} long, neighbor long, distance double")
    if within is not None:
        pairs = pairs.where(F.col("distance") <= within)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "neighbor"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
