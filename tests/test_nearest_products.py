"""Nearest neighbours by products of matrices: exact distances and ties as by brute force, also where products are inexact, and few rows out of each block."""

import numpy as np

from densigrid.operators import nearest


def test_candidates_hold_the_nearest():
    rng = np.random.default_rng(8)
    for shift, scale, width in ((0, 1, 3), (1e6, 1e-3, 5), (0, 1e160, 4), (-3e4, 1, 64)):
        x = rng.integers(0, 4, (300, width)) * float(scale) + shift  # many ties
        q, ids, q_ids = x[40:90], rng.permutation(300), None
        q_ids = ids[40:90]
        i, j, d, bound = nearest._nearest(q, q_ids, x, ids, 4, np.full(len(q), np.inf))
        for n in range(len(q)):
            with np.errstate(over="ignore"):
                far = np.sqrt(((q[n] - x) ** 2).sum(axis=1))
            want = [m for m in np.lexsort((ids, far)) if ids[m] != q_ids[n]][:4]
            assert j[i == n].tolist() == want and d[i == n].tolist() == far[want].tolist()
        _, j2, _, _ = nearest._nearest(q, q_ids, x + 9 * scale * width, ids + 1000, 4, bound)
        assert shift == 1e6 or scale > 1e100 or len(j2) == 0  # where products are exact enough, a later block gives only what is nearer than what the first gave
