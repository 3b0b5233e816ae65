"""Border following pixel by pixel, which the traced rings are held against."""

from __future__ import annotations

import numpy as np

_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # clockwise on an image, from the east


def borders(img: np.ndarray) -> list[tuple[bool, list[tuple[int, int]]]]:
    """Outer and hole borders of a binary image as (is it a hole's, its pixels (row, column) in order), by border following with 8-joined foreground."""
    f = np.pad(img.astype(np.int32), 1)
    solid = f != 0
    starts = np.zeros(f.shape, dtype=np.int8)
    starts[:, 1:] |= solid[:, 1:] & ~solid[:, :-1]
    starts[:, :-1] |= (solid[:, :-1] & ~solid[:, 1:]) * np.int8(2)
    out, mark = [], 1
    for i, j in np.argwhere(starts).tolist():
        if starts[i, j] & 1 and f[i, j] == 1:
            hole, at = False, 4
        elif starts[i, j] & 2 and f[i, j] >= 1:
            hole, at = True, 0
        else:
            continue
        mark += 1
        first = next((d % 8 for d in range(at, at + 8) if f[i + _AROUND[d % 8][0], j + _AROUND[d % 8][1]]), None)
        if first is None:
            f[i, j] = -mark
            out.append((hole, [(i - 1, j - 1)]))
            continue
        begin = (i + _AROUND[first][0], j + _AROUND[first][1])
        here, back, ring = (i, j), first, []
        while True:
            east_open = False
            for d in range(back - 1, back - 9, -1):
                to = (here[0] + _AROUND[d % 8][0], here[1] + _AROUND[d % 8][1])
                if f[to]:
                    break
                east_open |= d % 8 == 0
            if east_open:
                f[here] = -mark
            elif f[here] == 1:
                f[here] = mark
            ring.append((here[0] - 1, here[1] - 1))
            if to == (i, j) and here == begin:
                break
            here, back = to, (d + 4) % 8
        out.append((hole, ring))
    return out
