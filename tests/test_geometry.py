"""Rings, faces, drawings, rasters and basins against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataplan.operators import basins, drawings, filters, graph, kernels, lines, raster, rings, rooms


def cells(spark, at):
    return spark.createDataFrame([(int(c), int(r)) for c, r in at], "col long, row long")


def blob(seed, w=34, h=26, share=0.62):
    """A lumpy connected-ish mask."""
    rng = np.random.default_rng(seed)
    m = rng.random((h, w))
    m = (m + np.roll(m, 1, 0) + np.roll(m, 1, 1) + np.roll(m, -1, 0) + np.roll(m, -1, 1)) / 5 < share * 0.9
    return [(c, r) for r, c in zip(*np.nonzero(m))]


# graphs and rings ------------------------------------------------------------------------------


def test_components_few_and_many(spark):
    rng = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))], "a long, b long")
    few, many = (sorted(map(tuple, graph.components(edges, few=f).collect())) for f in (graph.FEW, 0))
    assert few == many and len(few) > 150
    assert graph.components(edges.where("a < 0")).count() == 0


def test_cycles(spark):
    steps = [(1, 5), (5, 3), (3, 1), (10, 11), (11, 10), (20, 21), (21, 22), (22, None), (7, 7)] + [(100 + i, 100 + (i + 1) % 37) for i in range(37)]
    df = spark.createDataFrame(steps, "id long, next long")
    want = sorted([(1, 1, 0, 3), (5, 1, 1, 3), (3, 1, 2, 3), (10, 10, 0, 2), (11, 10, 1, 2), (7, 7, 0, 1)] + [(100 + i, 100, i, 37) for i in range(37)])
    for few in (graph.FEW, 0):
        assert sorted(map(tuple, rings.cycles(df, few).collect())) == want


SQUARE = [(0, 0, 100, 0), (100, 0, 100, 100), (100, 100, 0, 100), (0, 100, 0, 0)]


def segs(spark, rows):
    return spark.createDataFrame([("g", i, *map(float, s)) for i, s in enumerate(rows)], "by string, seg_id long, x1 double, y1 double, x2 double, y2 double")


def test_faces(spark):
    """A square cut in two; a dangling edge and a bridge bound nothing; an island is a hole with a face of its own; walls
    that share a line are one edge."""
    island = [(10, 10, 30, 10), (30, 10, 30, 30), (30, 30, 10, 30), (10, 30, 10, 10)]
    rows = SQUARE + [(50, -10, 50, 120)] + [(100, 20, 100, 80)] + [(50, 60, 80, 60)] + island + [(60, 10, 60, 20)] + [(200, 0, 260, 0), (260, 0, 260, 60), (260, 60, 200, 60), (200, 60, 200, 0), (100, 50, 200, 30)]
    for snap in (0.001, 0.5):
        got = rings.measured(rings.faces(segs(spark, rows), cell=40.0, snap=snap)).collect()
        assert sorted(round(r.area, 3) for r in got) == [400, 3600, 4600, 5000]
    left = next(r for r in got if round(r.area) == 4600)
    assert left.corners == 8 + 1 and (round(left.x0), round(left.y0)) == (0, 0)  # the island, and a corner where the wall is cut at its foot
    assert rings.faces(segs(spark, rows[:3])).count() == 0


def test_faces_over_each_other_on_the_grid(spark):
    """Collinear pieces that only snapping puts on one line are split there."""
    rows = [(0, 0, 10, 0), (0, 0, 20, 0.0004), (20, 0, 20, 10), (20, 10, 0, 10), (0, 10, 0, 0)]
    got = rings.measured(rings.faces(segs(spark, rows), cell=10.0, snap=0.01)).collect()
    assert [round(r.area, 3) for r in got] == [200]


DXF = "file string, entity int, kind string, layer string, closed boolean, vertex int, x double, y double, text string"


def polyline(file, entity, ring, closed=True, kind="LWPOLYLINE"):
    return [(file, entity, kind, "0", closed, i, float(x), float(y), None) for i, (x, y) in enumerate(ring)]


def text(file, entity, x, y, t, kind="TEXT"):
    return [(file, entity, kind, "0", False, 0, float(x), float(y), t)]


def test_rooms_of_drawings(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rows = polyline("a", 1, box(0, 0, 5, 4)) + polyline("a", 2, box(6, 0, 2, 2)) + polyline("a", 3, box(0, 9, 0.5, 0.5)) + polyline("a", 4, [(0, 20), (4, 24), (4, 20), (0, 24)]) + polyline("a", 5, [(0, 30), (9, 30)])
    rows += polyline("a", 13, box(20, 20, 3, 3), kind="POLYLINE") + polyline("a", 14, box(30, 20, 3, 3), closed=False)
    rows += text("a", 6, 1, 1, "Lobby A", "MTEXT") + text("a", 7, 2, 2, " Restroom ") + text("a", 8, 7, 1, "  ") + text("a", 9, 99, 99, "Office")
    # one closed outline only: faces of all lines
    rows += polyline("b", 1, box(0, 0, 10, 6)) + polyline("b", 2, [(4, -1), (4, 7)], False, "LINE") + text("b", 3, 7, 3, "Server room")
    rows += polyline("c", 1, [(0, 0), (9, 9)], False, "LINE")
    got = sorted((r.file, r.room_id, r.label, r.category, round(r.cx, 6), round(r.cy, 6), round(r.area_m2, 6), len(r.polygon)) for r in drawings.rooms(spark.createDataFrame(rows, DXF)).collect())
    assert got == [
        ("a", "room-001", "Restroom", "bathroom", 2.5, 2.0, 20.0, 5), ("a", "room-002", "Room-002", "office", 7.0, 1.0, 4.0, 5), ("a", "room-003", "Room-003", "office", 21.5, 21.5, 9.0, 5),
        ("b", "room-001", "Server room", "common", 7.0, 3.0, 36.0, 5), ("b", "room-002", "Room-002", "office", 2.0, 3.0, 24.0, 5)]


# rasters ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("eight", [False, True])
def test_holes_by_runs(spark, eight):
    at = blob(5, share=0.55)
    held = set(at)
    c0, c1, r0, r1 = (f(v) for v, f in ((([c for c, _ in at]), min), ([c for c, _ in at], max), ([r for _, r in at], min), ([r for _, r in at], max)))
    near = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    left = {(c, r) for c in range(c0 - 1, c1 + 2) for r in range(r0 - 1, r1 + 2)} - held
    parts = []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            c, r = todo.pop()
            part.add((c, r))
            for a, b in near:
                if (c + a, r + b) in left:
                    left.remove((c + a, r + b))
                    todo.append((c + a, r + b))
        parts.append(part)
    inner = [p for p in parts if (c0 - 1, r0 - 1) not in p]
    df = cells(spark, at)
    assert {(r.col, r.row) for r in raster.holes(df, eight=eight).collect()} == set().union(*inner) and len(inner) >= 3
    assert {(r.col, r.row) for r in raster.holes(df, 3, eight).collect()} == set().union(*[p for p in inner if len(p) < 3])


def test_distances(spark):
    at = blob(6)
    df = cells(spark, at).withColumn("building", F.lit("x")).unionByName(cells(spark, [(c + 3, r) for c, r in at[:200]]).withColumn("building", F.lit("y")))
    for name, own in (("x", at), ("y", [(c + 3, r) for c, r in at[:200]])):
        p = np.array(own)
        box = [(c, r) for c in range(p[:, 0].min(), p[:, 0].max() + 1) for r in range(p[:, 1].min(), p[:, 1].max() + 1)]
        free = np.array([b for b in box if b not in set(own)])
        want = {tuple(map(int, f)): int(((p - f) ** 2).sum(1).min()) for f in free}
        got = {(r.col, r.row): round(r.dist**2) for r in raster.free_distance(df).where(F.col("building") == name).collect()}
        assert got == want
        out = np.array([(c, r) for c in range(p[:, 0].min() - 1, p[:, 0].max() + 2) for r in range(p[:, 1].min() - 1, p[:, 1].max() + 2) if (c, r) not in set(own)])
        deep = {(r.col, r.row): r.h for r in raster.depth(df).where(F.col("building") == name).collect()}
        assert deep == {tuple(c): int(((out - c) ** 2).sum(1).min()) for c in own}


def brute_peaks(h, apart, least):
    near = [(a, b) for a in range(-apart, apart + 1) for b in range(-apart, apart + 1)]
    order = sorted((((c * 73856093) ^ (r * 19349663)) & 0x7FFFFFFF, c, r) for (c, r), v in h.items() if v >= least and all(h.get((c + a, r + b), 0) <= v for a, b in near))
    taken = set()
    for _, c, r in order:
        if not any((c + a, r + b) in taken for a, b in near):
            taken.add((c, r))
    return taken


def brute_watershed(h, seeds):
    key = lambda p: ((p[1] + (1 << 30)) << 31) + p[0] + (1 << 30)
    edges = sorted((-min(h[p], h[q]), *sorted((key(p), key(q))), p, q) for p in h for q in ((p[0] + 1, p[1]), (p[0], p[1] + 1)) if q in h)
    parent, rooted = {p: p for p in h}, {p: p if p in seeds else None for p in h}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for *_, p, q in edges:
        p, q = find(p), find(q)
        if p != q and not (rooted[p] and rooted[q]):
            parent[q] = p
            rooted[p] = rooted[p] or rooted[q]
    return {p: key(rooted[find(p)]) for p in h if rooted[find(p)]}


@pytest.mark.parametrize("tile,few", [(256, 200_000), (7, 200_000), (5, 0)])
def test_watershed_by_tiles(spark, tile, few):
    at = [p for s in (8, 9) for p in ([(c, r) for c, r in blob(s, 22, 18)] if s == 8 else [(c + 25, r) for c, r in blob(s, 12, 12)])]
    h = raster.depth(cells(spark, at))
    height = {(r.col, r.row): r.h for r in h.collect()}
    seeds = basins.room_seeds(h, 2, 2)
    want = brute_peaks(height, 2, 1) | brute_peaks(height, 1, 4)
    assert {(r.col, r.row) for r in seeds.collect()} == want
    assert {(r.col, r.row) for r in basins.peaks(h, 2, few=0).collect()} == brute_peaks(height, 2, 1)
    some = sorted(want)[::3]
    got = {(r.col, r.row): r.label for r in basins.watershed(h, cells(spark, some), tile, few).collect()}
    assert got == brute_watershed(height, set(some)) and len(set(got.values())) == len(some)


def test_edges_and_lines(spark):
    """The outline of a filled rectangle: thin closed edges, four Hough segments, four regions of one orientation."""
    df = cells(spark, [(c, r) for c in range(40) for r in range(25)])
    shades = raster.blur(df, raster.gaussian(5, 1.5))
    edge = raster.edge_cells(shades)
    at = {(r.col, r.row) for r in edge.collect()}
    assert 100 <= len(at) <= 160 and all(min(abs(c), abs(c - 39), abs(r), abs(r - 24)) <= 2 for c, r in at)
    found = lines.hough_segments(edge, votes=12, least=12, gap=4).collect()
    assert len(found) >= 4 and {"v" if abs(s.x1 - s.x2) < 2 else "h" if abs(s.y1 - s.y2) < 2 else "?" for s in found} == {"v", "h"}
    grown = lines.grown_segments(raster.gradients(shades), least=10).collect()
    assert sum(r.n for r in grown) > 100
    assert lines.hough_segments(edge.limit(0)).count() == 0 and raster.edge_cells(shades.limit(0)).count() == 0


# rooms -----------------------------------------------------------------------------------------


def cloud(spark, rects, step=0.1):
    """Chest-high points along the sides of rectangles (metres)."""
    rows = []
    for x0, y0, x1, y1 in rects:
        for t in np.arange(0, 1, step / max(x1 - x0, y1 - y0)):
            rows += [(x0 + t * (x1 - x0), y0), (x0 + t * (x1 - x0), y1), (x0, y0 + t * (y1 - y0)), (x1, y0 + t * (y1 - y0))]
    return spark.createDataFrame([(i, int(x * 1000), int(y * 1000), 1500) for i, (x, y) in enumerate(rows)], "point_id long, x_mm long, y_mm long, z_mm long")


def test_rooms_with_yard_and_detached_part(spark):
    """Rooms around a yard of 256 m2 that stays open; a detached hut and the yard are no rooms; a known wall divides
    what the scan shows as one; a building of its own falls back to its box."""
    wing = [(0, 0, 24, 4), (0, 20, 24, 24), (0, 4, 4, 20), (20, 4, 24, 20)]
    p = cloud(spark, [*wing, (40, 0, 43, 3)])
    wall = spark.createDataFrame([(12_000, 0, 12_000, 4000)], "x1 long, y1 long, x2 long, y2 long")
    got = rooms.rooms_from_scan(p, wall).collect()
    assert len(got) >= 5 and all(r.cx < 30 for r in got) and not any(5 < r.cx < 19 and 5 < r.cy < 19 for r in got)
    south = sorted(r.cx for r in got if r.cy < 4)
    assert any(x < 12 for x in south) and any(x > 12 for x in south)
    floor = {(r.col, r.row) for r in rooms.floor_cells(p, 500, wall).collect()}
    assert (24, 3) not in floor and (23, 3) in floor and (24, 24) not in floor
    two = p.withColumn("building", F.lit(1)).unionByName(spark.createDataFrame([(i, 100 * i, 50 * i, 1500, 2) for i in range(5)], "point_id long, x_mm long, y_mm long, z_mm long, building int"))
    both = rooms.rooms_from_scan(two).collect()
    assert [r.label for r in both if r.building == 2] == ["Building"] and sum(r.building == 1 for r in both) >= 4


def test_plan_falls_back_to_box(spark):
    got = rooms.plan_from_projection(cloud(spark, [(0, 0, 1, 1)])).collect()
    assert len(got) == 4 and {(r.x1, r.y1) for r in got} == {(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)}


def test_simple_ring():
    assert kernels.simple_ring([(0, 0), (4, 0), (4, 4), (0, 4)]) and not kernels.simple_ring([(0, 0), (4, 4), (4, 0), (0, 4)])


def test_class_mask_by_scan(spark):
    """A scan that was never classified is kept whole beside one that was."""
    df = spark.createDataFrame([(s, c) for s, cs in ((0, [6] * 10 + [2] * 5 + [7]), (1, [0] * 8 + [18]), (2, [6] + [0] * 20 + [2] * 9)) for c in cs], "scan int, classification int")
    got = {(r["scan"], r["classification"]): r["count"] for r in filters.class_mask(df, by="scan").groupBy("scan", "classification").count().collect()}
    assert got == {(0, 6): 10, (1, 0): 8, (2, 6): 1, (2, 0): 20}


def test_manhattan_needs_four(spark):
    rows = [(1, 0, 0, 100, 0), (2, 0, 0, 90, 1), (3, 0, 0, 70, 70)]
    s = spark.createDataFrame(rows, "seg_id long, x1 long, y1 long, x2 long, y2 long")
    assert filters.manhattan_filter(s).count() == 3
    assert filters.manhattan_filter(s.unionByName(spark.createDataFrame([(4, 0, 0, 0, 50)], s.schema))).count() == 3


def test_faces_group_by_group_and_by_joins(spark):
    """Small groups are one task's work each, and their segments move once; large ones go by joins, to the same faces."""
    rng = np.random.default_rng(8)
    rows = []
    for by in "abc":
        a = rng.integers(0, 60, (45, 2))
        ends = np.hstack([a, a + rng.integers(-25, 26, (45, 2))])
        ends[::3, 3] = ends[::3, 1]  # level ones, of which some lie on each other
        ends[::9, :] += 200  # apart from the rest
        island = [(20, 20, 24, 20), (24, 20, 24, 24), (24, 24, 20, 24), (20, 24, 20, 20), (400, 0, 500, 0), (500, 0, 500, 90), (500, 90, 400, 0), (450, 10, 460, 10), (460, 10, 460, 15), (460, 15, 450, 10)]
        rows += [(by, i, *map(float, r)) for i, r in enumerate([*ends.tolist(), *island, (5.0, 5.0, 5.0, 5.0), (float("nan"), 0, 1, 1)])]
    df = spark.createDataFrame(rows + rows[:20], "by string, seg_id long, x1 double, y1 double, x2 double, y2 double")
    for snap, least in ((0.001, 0.0), (0.5, 2.0)):
        told = []
        for group in (rings.GROUP, 60, 0):  # all, some and none at once: b and c hold 57
            f = graph.cut(rings.faces(df, 20.0, snap, least, group))
            shown = rings.measured(f).select("by", *[F.round(c, 6) for c in ("area", "cx", "cy", "x0", "y0", "x1", "y1")], "corners")
            walks = rings.outlines(f).select("by", F.sort_array("polygon"), F.lit(0))
            told.append([sorted(map(tuple, t.collect())) for t in (shown, walks)] + [f.where("hole IS NOT NULL").count()])
        assert told[0][0] == told[1][0] == told[2][0] and len(told[0][0]) > 15
        assert told[0][2] == told[1][2] == told[2][2] > 0
        assert [len(t[1]) for t in told] == [len(told[0][1])] * 3
    plan = rings.faces(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_lines_of_drawings_meet_no_join(spark):
    """Whatever the number of drawings, their lines go to their drawing; pairs, corners and rings are not joined."""
    rows = polyline("a", 1, [(0, 0), (4, 0), (4, 4), (0, 4)]) + polyline("b", 2, [(1, -1), (1, 5)], False, "LINE")
    faces = drawings.line_faces(spark.createDataFrame(rows, DXF))
    assert "Join" not in faces._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in rings.measured(faces).select("by", "area", "corners").collect()] == [("a", 16.0, 4)]


def test_lines_of_drawings_are_made_once(spark):
    """Faces count the lines of a drawing before they take them; the drawings are read once for both."""
    read = spark.sparkContext.accumulator(0)

    def told(k):
        read.add(1)
        return k

    rows = polyline("a", 1, [(0, 0), (4, 0), (4, 4), (0, 4)]) + polyline("b", 2, [(1, -1), (1, 5)], False, "LINE")
    faces = drawings.line_faces(spark.createDataFrame(rows, DXF).withColumn("vertex", F.udf(told, "int")("vertex")))
    assert [tuple(r) for r in rings.measured(faces).select("by", "area", "corners").collect()] == [("a", 16.0, 4)]
    assert read.value == len(rows)
