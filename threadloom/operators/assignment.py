"""Minimum-cost assignment of two lists under small whole-number costs."""

from __future__ import annotations

from collections import deque

import numpy as np


def min_cost_assignment(cost, highest: int | None = None) -> list[tuple[int, int]]:
    """Pairs (row, column) that use every row or every column, whichever are fewer, at the least total cost.

    ``cost`` holds whole numbers from 0, up to ``highest`` if that is given; it is an array or anything with a shape and its rows by number. What a pair saves against the dearest one is its weight, and a matching of the
    largest weight is grown level by level: rows and columns carry prices that together cover every weight; pairs
    that are covered exactly may be matched; where no row can be matched any more, prices of the rows reached fall and those
    of the columns reached rise, by whole numbers. Unmatched rows all have the same price, so there are at most as many
    levels as there are different costs. What is left when their price is 0 is as dear as can be in any pairing.

    Memory is that of ``cost`` and a few vectors. Of equally cheap assignments one is returned, always the same.
    """
    n, m = cost.shape
    if not n or not m:
        return []
    highest = int(cost.max()) if highest is None else highest
    row_price, col_price = np.full(n, highest, dtype=np.int64), np.zeros(m, dtype=np.int64)
    col_of, row_of = np.full(n, -1), np.full(m, -1)

    def spare(r: int) -> np.ndarray:
        """How far the prices of a row and of each column exceed their weight."""
        return (row_price[r] - highest) + col_price + cost[r]

    def grow() -> tuple[bool, np.ndarray, np.ndarray]:
        """Search from all unmatched rows at once; each tree is closed by the first way to an unmatched column."""
        came_from, unseen = np.full(m, -1), np.ones(m, dtype=bool)
        tree = np.where(col_of < 0, np.arange(n), -1)
        closed = np.zeros(n, dtype=bool)
        todo, matched = deque(np.flatnonzero(col_of < 0).tolist()), False
        while todo:
            r = todo.popleft()
            if closed[tree[r]]:
                continue
            cols = np.flatnonzero(unseen & (spare(r) == 0))
            free = cols[row_of[cols] < 0]
            if len(free):
                c = int(free[0])
                unseen[c], closed[tree[r]], matched = False, True, True
                came_from[c] = r
                while c >= 0:  # swap along the way back to the root
                    r = came_from[c]
                    before = int(col_of[r])
                    row_of[c], col_of[r] = r, c
                    c = before
            elif len(cols):
                unseen[cols], came_from[cols] = False, r
                rows = row_of[cols]
                tree[rows] = tree[r]
                todo.extend(rows.tolist())
        return matched, tree >= 0, ~unseen

    while True:
        matched, rows, cols = True, None, None
        while matched:
            matched, rows, cols = grow()
        waiting = np.flatnonzero(col_of < 0)
        level = int(row_price[waiting[0]]) if len(waiting) else 0
        if level == 0 or not (row_of < 0).any():
            break
        outside = ~cols
        step = min([level, *(int(spare(r)[outside].min()) for r in np.flatnonzero(rows))])
        row_price[rows] -= step
        col_price[cols] += step
    pairs = [(r, int(c)) for r, c in enumerate(col_of) if c >= 0]
    return sorted(pairs + list(zip(np.flatnonzero(col_of < 0).tolist(), np.flatnonzero(row_of < 0).tolist())))
