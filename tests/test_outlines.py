"""Contours, their simplification and alpha shapes against brute force."""

import math

import numpy as np
import pytest

from strataplan.operators import alpha, contours, kernels, rooms


def cells(spark, rows):
    return spark.createDataFrame(rows, "label long, col long, row long")


def blobs(seed):
    """Random cells of two labels, side by side, with holes, corners that touch and repeated rows."""
    rng = np.random.default_rng(seed)
    rows = [(int(1 + c // 12), int(c), int(r)) for c, r in zip(*np.nonzero(rng.random((24, 14)) < 0.62))]
    return rows + rows[:5]


@pytest.mark.parametrize("few", [0, 10**6])
def test_contours(spark, few):
    rows = blobs(3)
    got = contours.contours(cells(spark, rows), few)
    facts = contours.measured(got).collect()
    for label in (1, 2):
        own = {(c, r) for k, c, r in rows if k == label}
        sides = sum((c + a, r + b) not in own for c, r in own for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        mine = [f for f in facts if f.label == label]
        assert sum(f.area for f in mine) == len(own) and sum(f.size for f in mine) == sides
        # by region of sides: its outer ring holds it and its holes
        mask = np.zeros((26, 16), bool)
        for c, r in own:
            mask[c, r] = True
        regions = 0
        todo = set(own)
        while todo:
            stack = [todo.pop()]
            regions += 1
            while stack:
                c, r = stack.pop()
                for p in ((c + 1, r), (c - 1, r), (c, r + 1), (c, r - 1)):
                    if p in todo:
                        todo.remove(p)
                        stack.append(p)
        assert sum(f.area > 0 for f in mine) == regions
    rings = {}
    for r in got.collect():
        rings.setdefault(r.ring, {})[r.place] = (r.x, r.y)
    for ring in rings.values():
        line = [ring[i] for i in range(len(ring))]
        assert line[0] == min(line) and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(line, [*line[1:], line[0]]))


def test_longest_contour(spark):
    frame = [(1, c, r) for c in range(6) for r in range(6) if not (2 <= c <= 3 and 2 <= r <= 3)]
    got = contours.longest(contours.contours(cells(spark, [*frame, (2, 40, 40), (2, 41, 41)]))).collect()
    assert sorted((r.place, r.x, r.y) for r in got if r.label == 1)[:2] == [(0, 0, 0), (1, 1, 0)] and sum(r.label == 1 for r in got) == 24
    # cells that meet at a corner have rings of their own; of equals the one of smallest corner
    assert sorted((r.x, r.y) for r in got if r.label == 2) == [(40, 40), (40, 41), (41, 40), (41, 41)]
    assert contours.contours(cells(spark, [])).count() == 0


@pytest.mark.parametrize("tolerance", [0.6, 1.0, 2.5])
def test_simplified_rings(spark, tolerance):
    corners = contours.contours(cells(spark, blobs(8)))
    want = {}
    for r in corners.collect():
        want.setdefault((r.label, r.ring), {})[r.place] = (r.x, r.y)
    for few in (0, 10**6):
        got = {}
        for r in contours.simplified(corners, tolerance, few).collect():
            got.setdefault((r.label, r.x, r.y), []).append((r.place, r.size))
        seen = {}
        for line in want.values():
            ring = [line[i] for i in range(len(line))]
            kept = recursive([*ring, ring[0]], tolerance)[:-1]
            label = next(k[0] for k, v in want.items() if v is line)
            for i in kept:
                seen.setdefault((label, *ring[i]), []).append((i, len(kept)))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in seen.items()}


def recursive(line, tolerance, lo=0, hi=None):
    hi = len(line) - 1 if hi is None else hi
    (ax, ay), (bx, by) = line[lo], line[hi]
    n = math.hypot(bx - ax, by - ay)
    best, at = 0.0, None
    for i in range(lo + 1, hi):
        x, y = line[i]
        off = math.hypot(x - ax, y - ay) if n == 0 else abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / n
        if off > best + 1e-12:
            best, at = off, i
    if best <= tolerance:
        return [lo, hi]
    return recursive(line, tolerance, lo, at)[:-1] + recursive(line, tolerance, at, hi)


def rim(p, radius):
    """Edges with just one empty circle, the shape to their left; and the points that none of them holds, of those
    that an empty circle reaches."""
    edges, reached = set(), set()
    for i, a in enumerate(p):
        alone = True
        for j, b in enumerate(p):
            d = math.dist(a, b)
            if i == j or d >= 2 * radius:
                continue
            alone = False
            t = math.sqrt(radius**2 - d * d / 4) / d
            mid, turn = (a + b) / 2, np.array([-(b - a)[1], (b - a)[0]]) * t
            others = np.delete(p, [i, j], 0)
            left, right = (bool((((others - c) ** 2).sum(1) < radius**2 * (1 - 1e-9)).any()) for c in (mid + turn, mid - turn))
            if not right:
                reached.add(i)
                if left:
                    edges.add((i, j))
        if alone:
            reached.add(i)
    held = {i for e in edges for i in e}
    return edges, reached - held


@pytest.mark.parametrize("seed, radius", [(1, 9.0), (2, 14.0), (3, 30.0), (4, 4.0)])
def test_alpha_rim(spark, seed, radius):
    rng = np.random.default_rng(seed)
    p = np.unique(rng.integers(0, 100, (160, 2)), axis=0).astype(float) + rng.uniform(-0.2, 0.2, (1, 2))
    p += rng.uniform(-0.1, 0.1, p.shape)
    t = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "point_id long, x double, y double")
    edges, lost = alpha.rim(t, radius)
    want, apart = rim(p, radius)
    assert {(r.p, r.q) for r in edges.collect()} == want
    assert {r.point_id for r in lost.collect()} == apart
    # every edge is on a ring, whichever way rings are closed; the areas are those of the triangles
    for few in (0, 10**6):
        sides = alpha.shape_rings(edges, few)
        assert sides.count() == len(want) == sides.select("ring", "place").distinct().count()
        line = {}
        for r in sides.collect():
            line.setdefault(r.ring, {})[r.place] = (r.ox, r.oy, r.dx, r.dy)
        for ring in line.values():
            assert all(ring[i][2:] == ring[(i + 1) % len(ring)][:2] for i in range(len(ring)))
    inside = sum(r.area for r in alpha.ring_areas(sides).collect())
    assert inside == pytest.approx(sum(p[i][0] * p[j][1] - p[j][0] * p[i][1] for i, j in want) / 2)


def test_points_without_a_shape(spark):
    t = lambda rows: spark.createDataFrame(rows, "point_id long, x double, y double")
    edges, lost = alpha.rim(t([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 50.0, 0.0)]), 2.0)
    assert edges.count() == 0 and sorted(r.point_id for r in lost.collect()) == [1, 2, 3]
    edges, lost = alpha.rim(t([]), 2.0)
    assert edges.count() == 0 and lost.count() == 0
    # a lattice, whose squares lie on one circle: the rim of the whole, no diagonal
    edges, lost = alpha.rim(t([(10 * i + j, float(i), float(j)) for i in range(4) for j in range(4)]), 1.1)
    assert edges.count() == 12 and lost.count() == 0
    assert [r.area for r in alpha.ring_areas(alpha.shape_rings(edges)).collect()] == [9.0]


def test_outline_by_building(spark):
    """An L keeps its corner, two parts get a hull, and more points than any sample change nothing."""
    rng = np.random.default_rng(5)
    ell = [(0, x, y) for x, y in rng.uniform(0, 20_000, (30_000, 2)) if not (x > 10_000 and y > 10_000)]
    apart = [(1, x + d, y) for d in (0, 60_000) for x, y in rng.uniform(0, 6_000, (400, 2))]
    p = spark.createDataFrame([(b, i, int(x), int(y)) for i, (b, x, y) in enumerate(ell + apart)], "building int, point_id long, x_mm long, y_mm long")
    got = {}
    for r in sorted(rooms.outline(p, cell=500).collect(), key=lambda r: (r.building, r.k)):
        got.setdefault(r.building, []).append((r.x, r.y))
    assert 275 <= kernels.area(got[0]) <= 300 and kernels.simple_ring(got[0])
    assert 340 <= kernels.area(got[1]) <= 396 and set(map(tuple, kernels.convex_hull(got[1]))) == set(got[1])
    one = rooms.outline(p.where("building = 0").drop("building"), cell=500)
    assert sorted((r.k, r.x, r.y) for r in one.collect()) == [(i, *q) for i, q in enumerate(got[0])]
