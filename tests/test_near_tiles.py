"""Neighbours and density clusters over many tiles equal brute force, and pairs in reach are never shuffled."""

import numpy as np
import pytest

from densigrid.operators import neighbors

KIND = "fov string, id long, r int, c int"


def brute(rows, radius, least):
    """{row: (neighbours, cluster)} of rows (fov, id, r, c), ids apart."""
    near = {p: [q for q in rows if q[0] == p[0] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= radius * radius] for p in rows}
    core = {p for p in rows if len(near[p]) >= least}
    group, n = {}, 0
    for p in core:
        if p not in group:
            todo, group[p] = [p], n
            while todo:
                for q in near[todo.pop()]:
                    if q in core and q not in group:
                        group[q] = n
                        todo.append(q)
            n += 1
    member = {p: group[p if p in core else min((q for q in near[p] if q in core), key=lambda q: q[1])] for p in rows if p in core or any(q in core for q in near[p])}
    out = {}
    for fov in {p[0] for p in rows}:
        first = {}
        for p in sorted((p for p in member if p[0] == fov), key=lambda p: p[1]):
            first.setdefault(member[p], len(first))
        out |= {p: (len(near[p]), first[member[p]] if p in member else -1) for p in rows if p[0] == fov}
    return out


@pytest.mark.parametrize("radius,wide,kind", [(2, 16, KIND), (3, 4, KIND), (2.5, 5, KIND.replace("r int, c int", "r double, c double"))])
def test_tiles_equal_brute_force(spark, monkeypatch, radius, wide, kind):
    monkeypatch.setattr(neighbors, "_cells", lambda r: (r / 2**0.5, wide))
    monkeypatch.setattr(neighbors, "PAIRS", 50)
    rng = np.random.default_rng(wide)
    number = float if "double" in kind else int
    places = np.concatenate([rng.integers(-20, 60, (350, 2)), [(40, c) for c in range(-10, 50)]]) * (1.25 if number is float else 1)
    ids = rng.permutation(len(places))
    rows = [("AB"[k % 3 == 0], int(i), number(r), number(c)) for k, (i, (r, c)) in enumerate(zip(ids, places))]
    want, points = brute(rows, radius, 4), spark.createDataFrame(rows, kind)
    assert {tuple(x)[:4]: x["n"] for x in neighbors.neighbor_count(points, radius).collect()} == {p: n for p, (n, _) in want.items()}
    assert {tuple(x)[:4]: x["cluster"] for x in neighbors.dbscan(points, radius, 4).collect()} == {p: k for p, (_, k) in want.items()}


def test_null_and_large_ids(spark):
    rows = [("A", None, 0, 0), ("A", 1 << 60, 0, 1), ("A", (1 << 60) + 1, 1, 0), ("A", 5, 30, 30), ("A", 6, 30, 31), ("A", 7, 31, 30), ("A", 8, 90, 90), ("A", 9, None, 3)]
    got = {x["id"]: x["cluster"] for x in neighbors.dbscan(spark.createDataFrame(rows, KIND), 2, 3).collect()}
    assert got == {None: 1, 1 << 60: 1, (1 << 60) + 1: 1, 5: 0, 6: 0, 7: 0, 8: -1, 9: -1}


def test_pairs_in_reach_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([("A", i, i % 7, i // 7) for i in range(40)], KIND).write.parquet(f"{tmp_path}/points")
    points = spark.read.parquet(f"{tmp_path}/points")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert plan(neighbors.neighbor_count(points, 3)).count("SortMergeJoin") == 1  # the points and their places' counts
    assert plan(neighbors.dbscan(points, 3, 3)).count("SortMergeJoin") <= 4
