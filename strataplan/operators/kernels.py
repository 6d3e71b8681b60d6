"""Dense kernels over one bounded raster or plan, in NumPy: run per group by ``applyInPandas``
(one slice, one building), never over a whole corpus."""

from __future__ import annotations

import math

import numpy as np


def dense(col: np.ndarray, row: np.ndarray, pad: int = 1) -> tuple[np.ndarray, int, int]:
    """Boolean image of sparse cells with a margin, and the column and row of its corner."""
    c0, r0 = int(col.min()) - pad, int(row.min()) - pad
    image = np.zeros((int(row.max()) - r0 + 1 + pad, int(col.max()) - c0 + 1 + pad), dtype=bool)
    image[row - r0, col - c0] = True
    return image, c0, r0


def contour(mask: np.ndarray) -> list[tuple[int, int]]:
    """Longest closed boundary of the set cells, as corner points along cell edges."""
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    p = np.pad(mask, 1)
    for r, c in zip(*np.nonzero(mask)):
        r, c = int(r), int(c)
        if not p[r, c + 1]:
            edges.setdefault((c, r), []).append((c + 1, r))
        if not p[r + 1, c + 2]:
            edges.setdefault((c + 1, r), []).append((c + 1, r + 1))
        if not p[r + 2, c + 1]:
            edges.setdefault((c + 1, r + 1), []).append((c, r + 1))
        if not p[r + 1, c]:
            edges.setdefault((c, r + 1), []).append((c, r))
    best: list[tuple[int, int]] = []
    while edges:
        start = min(edges)
        at, loop = start, []
        while at in edges:
            loop.append(at)
            nxt = edges[at].pop(0)
            if not edges[at]:
                del edges[at]
            at = nxt
            if at == start:
                break
        best = max(best, loop, key=len)
    return best


def simplify_at(points: list[tuple[float, float]], tolerance: float) -> list[int]:
    """Douglas-Peucker on an open line: positions of what is kept. Stretches wait on a list, so that a long line
    needs no deep recursion."""
    p = np.array(points)
    kept, waiting = {0, len(points) - 1}, [(0, len(points) - 1)]
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo < 2:
            continue
        ab, rel = p[hi] - p[lo], p[lo + 1 : hi] - p[lo]
        n = float(np.hypot(*ab.astype(float)))
        off = (rel * rel).sum(1) if n == 0 else np.abs(ab[0] * rel[:, 1] - ab[1] * rel[:, 0])
        i = int(off.argmax())
        if off[i] > (tolerance * tolerance if n == 0 else tolerance * n):
            at = lo + 1 + i
            kept.add(at)
            waiting += [(lo, at), (at, hi)]
    return sorted(kept)


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    return [points[i] for i in simplify_at(points, tolerance)]


def area(polygon) -> float:
    p = np.array(polygon, float)
    return abs(float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum())) / 2


def convex_hull(points) -> list[tuple[float, float]]:
    """Monotone chain, counter-clockwise, without collinear points."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def simple_ring(ring: list[tuple[float, float]]) -> bool:
    """Whether no two edges of a closed ring cross; one at a time against all, in NumPy."""
    p = np.array(ring, float)
    q = np.roll(p, -1, axis=0)
    side = lambda a, b, c: (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
    for a, b in zip(p, q):
        if ((side(a, b, p) * side(a, b, q) < 0) & (side(p, q, a) * side(p, q, b) < 0)).any():
            return False
    return True


def interior_point(polygon) -> tuple[float, float]:
    """A point inside: the middle of the widest chord at the polygon's middle height."""
    p = [tuple(map(float, q)) for q in polygon]
    ys = sorted({y for _, y in p})
    y = (ys[len(ys) // 2 - 1] + ys[len(ys) // 2]) / 2 if len(ys) > 1 else ys[0]
    xs = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for (x0, y0), (x1, y1) in zip(p, [*p[1:], p[0]]) if (y0 > y) != (y1 > y))
    if len(xs) < 2:
        return p[0]
    a, b = max(zip(xs[::2], xs[1::2]), key=lambda s: s[1] - s[0])
    return (a + b) / 2, y


def line_cells(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Cells of a line, both ends included, one per step of the longer side."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    if n == 0:
        return [(x0, y0)]
    half = n // 2
    step = lambda a, b, i: a + ((abs(b - a) * i + half) // n) * (1 if b >= a else -1)
    return [(step(x0, x1, i), step(y0, y1, i)) for i in range(n + 1)]


def peel_vertical(xyz: np.ndarray, least: int, near: float, up: float, height: float, seed: int, most: int = 40, tries: int = 200) -> list[tuple[tuple[float, float, float, float], int]]:
    """Vertical planes of one bounded cloud, ((a, b, c, d), inliers) each, by peeling: the fullest of
    ``tries`` seeded three-point planes is refined on its inliers and taken out; of those, planes with
    a level normal and enough height count."""
    rng = np.random.default_rng(seed)
    left, out = xyz, []
    for _ in range(most):
        if len(left) < max(3, least):
            break
        p, q, r = (left[rng.integers(0, len(left), tries)] for _ in range(3))
        normal = np.cross(q - p, r - p)
        size = np.linalg.norm(normal, axis=1)
        ok = size > 1e-6
        if not ok.any():
            break
        normal = normal[ok] / size[ok, None]
        d = -np.einsum("ij,ij->i", normal, p[ok])
        counts = np.array([np.count_nonzero(np.abs(left @ n + k) <= near) for n, k in zip(normal, d)])
        n, k = normal[counts.argmax()], d[counts.argmax()]
        inl = np.abs(left @ n + k) <= near
        mean = left[inl].mean(0)
        better = np.linalg.eigh(np.cov((left[inl] - mean).T))[1][:, 0]
        again = np.abs((left - mean) @ better) <= near
        if again.sum() >= inl.sum():
            n, k, inl = better, -float(better @ mean), again
        if inl.sum() < least:
            break
        lead = n[np.abs(n).argmax()]
        n, k = (n, k) if lead > 0 else (-n, -k)
        if abs(n[2]) <= up and np.ptp(left[inl][:, 2]) >= height:
            out.append(((*map(float, n), float(k)), int(inl.sum())))
        left = left[~inl]
    return out


def neighbours(xyz: np.ndarray, radius: float, most: int) -> list[np.ndarray]:
    """For each point the others within the radius, the nearest ``most`` of them, by grid cells."""
    cell = np.floor(xyz / radius).astype(np.int64)
    cell -= cell.min(0) - 1
    span = cell.max(0) + 2
    key = (cell[:, 0] * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    steps = [(i * span[1] + j) * span[2] + k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    out = []
    for i, own in enumerate(key.tolist()):
        near = np.concatenate([order[np.searchsorted(ranked, own + s) : np.searchsorted(ranked, own + s, "right")] for s in steps])
        near = near[near != i]
        d = np.linalg.norm(xyz[near] - xyz[i], axis=1)
        near, d = near[d <= radius], d[d <= radius]
        out.append(near[np.argsort(d, kind="stable")[:most]])
    return out


def point_features(xyz: np.ndarray, voxel: float) -> np.ndarray:
    """33 numbers a point: histograms (11 bins each) of the three angles between the normals of the
    point and its neighbours, each point's own mixed with its neighbours' by nearness."""
    around = neighbours(xyz, 6 * voxel, 30)
    normal = np.zeros_like(xyz)
    middle = xyz.mean(0)
    for i, near in enumerate(around):
        if len(near) >= 2:
            normal[i] = np.linalg.eigh(np.cov(xyz[np.append(near, i)].T))[1][:, 0]
            if normal[i] @ (middle - xyz[i]) < 0:  # all normals look to the middle, which a turn keeps
                normal[i] = -normal[i]
    around = neighbours(xyz, 15 * voxel, 100)
    simple = np.zeros((len(xyz), 33))
    for i, near in enumerate(around):
        if not len(near):
            continue
        d = xyz[near] - xyz[i]
        d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
        u = normal[i]
        v = np.cross(d, u)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        w = np.cross(np.broadcast_to(u, v.shape), v)
        alpha = np.einsum("ij,ij->i", v, normal[near])
        phi = d @ u
        theta = np.arctan2(np.einsum("ij,ij->i", w, normal[near]), normal[near] @ u)
        for block, (value, low, high) in enumerate(((alpha, -1, 1), (phi, -1, 1), (theta, -np.pi, np.pi))):
            simple[i, 11 * block : 11 * block + 11] = np.histogram(np.clip(value, low, high), 11, (low, high))[0] * (100 / len(near))
    out = simple.copy()
    for i, near in enumerate(around):
        if len(near):
            weight = 1 / np.maximum(np.linalg.norm(xyz[near] - xyz[i], axis=1), 1e-9)
            out[i] += (simple[near] * weight[:, None]).sum(0) / weight.sum()
    return out


def mutual_matches(a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """Pairs of rows that are each other's nearest."""
    best_a, best_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    far = np.full(len(b), np.inf)
    for low in range(0, len(a), block):
        d = (a[low : low + block] ** 2).sum(1)[:, None] + (b**2).sum(1) - 2 * a[low : low + block] @ b.T
        best_a[low : low + block] = d.argmin(1)
        nearer = d.min(0) < far
        best_b[nearer] = low + d.argmin(0)[nearer]
        far = np.minimum(far, d.min(0))
    i = np.flatnonzero(best_b[best_a] == np.arange(len(a)))
    return np.stack([i, best_a[i]], 1)


def match_transform(a: np.ndarray, b: np.ndarray, pairs: np.ndarray, near: float, tries: int = 4000, edge: float = 0.9, seed: int = 1) -> tuple[np.ndarray, int]:
    """The rigid transform (4 x 4) that carries most matched points of ``a`` near theirs in ``b``:
    seeded quadruples whose edges agree in length up to ``edge``, the best refined on its inliers."""
    from .planes import rigid

    rng = np.random.default_rng(seed)
    p, q = a[pairs[:, 0]], b[pairs[:, 1]]

    def fitted(at) -> np.ndarray:
        mp, mq = p[at].mean(0), q[at].mean(0)
        return rigid((p[at] - mp).T @ (q[at] - mq), mp, mq)

    best, most = np.eye(4), 0
    for _ in range(tries if len(pairs) >= 4 else 0):
        at = rng.choice(len(pairs), 4, replace=False)
        i, j = np.triu_indices(4, 1)
        ea, eb = (np.linalg.norm(x[at][i] - x[at][j], axis=1) for x in (p, q))
        if (np.minimum(ea, eb) < edge * np.maximum(ea, eb)).any():
            continue
        m = fitted(at)
        inl = np.linalg.norm(p @ m[:3, :3].T + m[:3, 3] - q, axis=1) <= near
        if inl.sum() > most:
            best, most = m, int(inl.sum())
    if most >= 4:
        inl = np.linalg.norm(p @ best[:3, :3].T + best[:3, 3] - q, axis=1) <= near
        best = fitted(inl)
    return best, most
