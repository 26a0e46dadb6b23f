"""Indel distance by dynamic programming inside a band, many pairs at once."""

from __future__ import annotations

import numpy as np

_FAR = np.int32(1 << 29)
_CELLS = 1 << 24
#: Rows after which pairs that can't stay within their budget any more are dropped.
_LOOK = 16


def indel_distances(a: list[np.ndarray], b: list[np.ndarray], budget: np.ndarray) -> np.ndarray:
    """Insertions and deletions that turn a[k] into b[k], or budget[k] + 1 where it takes more than budget[k].

    One step of the loop advances one row of the tables of all pairs of a group; a cell beyond the budget's
    band around the diagonal can't be on a path within the budget and isn't held.
    Empty strings and equal ones are ordinary cases; the lists may be empty.
    """
    out = np.asarray(budget, np.int64) + 1
    order = np.argsort(budget, kind="stable")
    done = 0
    while done < len(order):  # groups of similar band width, bounded in cells
        k = done
        width = 0
        while k < len(order) and (k == done or (k - done + 1) * (2 * int(budget[order[k]]) + 1) <= _CELLS // 64):
            width = int(budget[order[k]])
            k += 1
        group = order[done:k]
        out[group] = np.minimum(_group([a[g] for g in group], [b[g] for g in group], width, np.asarray(budget)[group]), out[group])
        done = k
    return out


def _group(a: list[np.ndarray], b: list[np.ndarray], r: int, budget: np.ndarray) -> np.ndarray:
    n = np.array([len(x) for x in a], np.int64)
    m = np.array([len(x) for x in b], np.int64)
    rows, width = int(n.max(initial=0)), 2 * r + 1
    pad_a = np.zeros((len(a), rows), np.uint64)
    pad_b = np.zeros((len(b), int(m.max(initial=0)) + 2 * r + 1), np.uint64)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        pad_a[k, : len(x)] = x
        pad_b[k, r : r + len(y)] = y
    columns = np.arange(-r, r + 1, dtype=np.int64)  # band cell d of row i is column i + columns[d] of b
    steps = columns.astype(np.int32)
    band = np.where((columns >= 0) & (columns <= m[:, None]), columns, _FAR).astype(np.int32)
    result = np.where(n == 0, m, _FAR).astype(np.int64)
    who = np.arange(len(a))
    for i in range(1, rows + 1):
        j = i + columns
        inside = (j >= 1) & (j <= m[:, None])
        window = np.zeros((len(n), width), np.uint64)
        have = pad_b[:, i - 1 : i - 1 + width]
        window[:, : have.shape[1]] = have
        # diagonal: same band cell of the row above; deletion: the next band cell of the row above
        best = np.where(inside & (window == pad_a[:, i - 1 : i]), band, _FAR)
        best[:, :-1] = np.minimum(best[:, :-1], band[:, 1:] + 1)
        best[:, (j == 0)] = i
        # insertions run along the row: a running minimum of cost - column
        best = np.minimum.accumulate(best - steps, axis=1) + steps
        band = np.where((j >= 0) & (j <= m[:, None]), best, _FAR).astype(np.int32)
        last = np.flatnonzero(n == i)
        if len(last):
            d = m[last] - i + r
            ok = (d >= 0) & (d < width)
            result[who[last[ok]]] = band[last[ok], d[ok]]
        if i % _LOOK == 0 or len(last):
            # what is left of both strings can only cost more than their difference in length
            least = (band + np.abs((m[:, None] - j) - (n[:, None] - i))).min(1)
            alive = (least <= budget) & (n > i)
            if not alive.any():
                break
            if not alive.all():
                n, m, band, pad_a, pad_b, who, budget = (x[alive] for x in (n, m, band, pad_a, pad_b, who, budget))
    return result
