"""Nearest neighbours within one block of points; NumPy only.

Coordinates are integers. Candidates come from a grid whose cells are as wide as the reach tried; the
reach doubles for those that have not found enough, so that what a point is compared with follows
from how many neighbours it needs and not from how dense its surroundings are. Pairs are made in
slices of bounded size."""

from __future__ import annotations

import numpy as np

PAIRS = 1 << 20


def _ranges(left: np.ndarray, cells: np.ndarray, low: np.ndarray, spans: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """For each left point the starts and lengths of the runs of sorted ``cells`` that touch its own
    cell: one run for each offset in all dimensions but the last."""
    at = np.floor_divide(left, side) - low + 1
    inside = ((at >= 0) & (at <= spans + 1)).all(1)
    at = np.clip(at, 0, spans + 1)
    steps = np.array([int(np.prod(spans[i + 1 :] + 3)) for i in range(len(spans))], dtype=np.int64)
    base = at @ steps
    offsets = np.zeros(1, dtype=np.int64)
    for step in steps[:-1]:
        offsets = (offsets[:, None] + step * np.arange(-1, 2)[None]).ravel()
    first = np.searchsorted(cells, base[:, None] + offsets[None] - 1, "left")
    last = np.searchsorted(cells, base[:, None] + offsets[None] + 1, "right")
    return first, np.where(inside[:, None], last - first, 0)


def search(left: np.ndarray, right: np.ndarray, k: int, radius: int, own: np.ndarray | None = None):
    """Yields ``(rows, counts, found, d2)`` until every left row has come: numbers of left rows, how many
    neighbours each has (at most k), and their right rows and squared distances, row by row, nearest first.
    Equal distances go by the right row's number. ``own`` tells the identity of left and right rows, as two
    arrays; what is identical is no neighbour."""
    todo = np.arange(len(left))
    if k == 1 and own is None and len(right) and (radius * radius + 1) * len(right) < 1 << 63:
        yield from closest(left, right, radius)
        return
    if not len(right):
        yield todo, np.zeros(len(left), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return
    left, right = np.asfortranarray(left), np.asfortranarray(right)
    reach, extent = 1, (right.max(0) - right.min(0)).astype(float)
    while reach < radius and np.prod(extent / reach + 4) >= 1 << 62:
        reach *= 2
    while len(todo):
        reach = min(reach, radius)
        final = reach == radius
        grid = np.floor_divide(right, max(reach, 1))
        low = grid.min(0)
        spans = grid.max(0) - low + 1
        steps = np.array([int(np.prod(spans[i + 1 :] + 3)) for i in range(len(spans))], dtype=np.int64)
        cells = (grid - low + 1) @ steps
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        open_ = []
        for part in np.array_split(todo, max(1, len(todo) // (1 << 17))):
            first, length = _ranges(left[part], cells, low, spans, max(reach, 1))
            total = length.sum(1)
            # a ball is a small share of the cells about it: with less in them the next reach is the cheaper one
            enough = total >= (1 if final else 3 * k)
            if final:
                lone = part[~enough]
                yield lone, np.zeros(len(lone), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                open_.append(part[~enough])
            part, first, length, total = part[enough], first[enough], length[enough], total[enough]
            ends = np.cumsum(total)
            a = 0
            while a < len(part):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
                rows, n, found, d2 = _slice(left, right, part[a:b], first[a:b], length[a:b], order, k, reach, own)
                a = b
                if not final:
                    done = n >= k
                    open_.append(rows[~done])
                    keep = np.repeat(done, n)
                    rows, n, found, d2 = rows[done], n[done], found[keep], d2[keep]
                yield rows, n, found, d2
        if final:
            return
        todo = np.concatenate(open_)
        reach *= 2


#: points or boxes that a box of the tree holds, and left points that go down it together
FAN, TOGETHER = 4, 1 << 14


def _along(points: np.ndarray) -> np.ndarray:
    """The order of points along a curve that takes the bits of their coordinates in turn."""
    x = points - points.min(0)
    bits = 62 // x.shape[1]
    x >>= max(0, int(x.max()).bit_length() - bits)
    code = np.zeros(len(x), dtype=np.int64)
    for bit in range(int(x.max()).bit_length()):
        for c in range(x.shape[1]):
            code |= (x[:, c] >> bit & 1) << (bit * x.shape[1] + c)
    return np.argsort(code, kind="stable")


def closest(left: np.ndarray, right: np.ndarray, radius: int):
    """:func:`search` for the one nearest, down a tree of boxes about right points: a left point goes on into the boxes that
    are no farther than the nearest point it has met. What a point is compared with does not grow with the density of right
    points, however far they are."""
    order, m = _along(right), len(right)
    # boxes of FAN points or boxes, up to few; with each a point that it holds
    low = high = some = right[order]
    tree = [(low, high, some)]
    while len(low) > 2 * FAN:
        at = np.arange(0, len(low), FAN)
        low, high, some = np.minimum.reduceat(low, at, 0), np.maximum.reduceat(high, at, 0), some[np.minimum(at + FAN // 2, len(low) - 1)]
        tree.append((low, high, some))
    sort = _along(left) if len(left) else np.zeros(0, np.int64)
    for begin in range(0, len(left), TOGETHER):
        rows = sort[begin : begin + TOGETHER]
        x = left[rows]
        near = np.full(len(rows), radius * radius, dtype=np.int64)
        best = np.full(len(rows), (radius * radius + 1) * m, dtype=np.int64)
        top = len(tree) - 1
        n = len(tree[top][0])
        work = [(top, np.repeat(np.arange(len(rows)), n), np.tile(np.arange(n), len(rows)))]
        while work:
            level, i, j = work.pop()
            if len(i) > PAIRS:
                half = len(i) // 2
                work += [(level, i[half:], j[half:]), (level, i[:half], j[:half])]
                continue
            low, high, some = tree[level]
            at = x[i]
            if not level:
                d2 = ((at - low[j]) ** 2).sum(1)
                keep = d2 <= near[i]
                np.minimum.at(best, i[keep], d2[keep] * m + order[j[keep]])
                near = np.minimum(near, best // m)
                continue
            to = ((at - some[j]) ** 2).sum(1)
            np.minimum.at(near, i, to)
            away = np.maximum(np.maximum(low[j] - at, at - high[j]), 0)
            keep = (away * away).sum(1) <= near[i]
            i, j = i[keep], j[keep]
            below = j[:, None] * FAN + np.arange(FAN)
            there = below < len(tree[level - 1][0])
            work.append((level - 1, np.repeat(i, FAN)[there.ravel()], below[there]))
        found = best <= radius * radius * m + m - 1
        yield rows, found.astype(np.int64), best[found] % m, best[found] // m


def same_places(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places that points hold the number of a first point, and for each point the number of its place."""
    x = points - points.min(0)
    spans = x.max(0) + 1
    if np.prod(spans.astype(float)) < 1 << 62:
        code = x[:, 0]
        for c in range(1, x.shape[1]):
            code = code * spans[c] + x[:, c]
        _, first, at = np.unique(code, return_index=True, return_inverse=True)
    else:
        _, first, at = np.unique(x, axis=0, return_index=True, return_inverse=True)
    return first, at.ravel()


def _slice(left, right, part, first, length, order, k, reach, own):
    flat, starts = length.ravel(), first.ravel()
    run = np.repeat(starts - np.concatenate([[0], np.cumsum(flat)[:-1]]), flat) + np.arange(flat.sum())
    r = order[run]
    at = np.repeat(np.arange(len(part)), length.sum(1))
    row = part[at]
    d2 = sum((left[row, c] - right[r, c]) ** 2 for c in range(left.shape[1]))
    keep = d2 <= reach * reach
    if own is not None:
        keep &= own[0][row] != own[1][r]
    at, r, d2 = at[keep], r[keep], d2[keep]
    m, most = len(right), reach * reach + 1
    if k == 1 and most * m < 1 << 63:
        n = np.bincount(at, minlength=len(part))
        some = n > 0
        begin = (np.cumsum(n) - n)[some]
        if len(begin):
            key = np.minimum.reduceat(d2 * m + r, begin)
            return part, some.astype(np.int64), key % m, key // m
        return part, n, r, d2
    if len(part) * most * m < 1 << 63:
        key = np.sort((at * most + d2) * m + r)
        r, key = key % m, key // m
        at, d2 = key // most, key % most
    else:
        by = np.lexsort((r, d2, at))
        at, r, d2 = at[by], r[by], d2[by]
    n = np.bincount(at, minlength=len(part))
    rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    keep = rank < k
    return part, np.minimum(n, k), r[keep], d2[keep]
