"""Operators against seeded scenes, properties and round trips."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataplan.operators import classify, filters, graph, kernels, planes, raster, rooms, scalars, segments, spatial, voxel
from strataplan.sources import building as src
from strataplan.sources import scan_files, sinks


def cloud(spark, xyz, **more):
    rows = [(i, *(int(round(float(v) * 1000)) for v in p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "point_id long, x_mm long, y_mm long, z_mm long")


@pytest.fixture(scope="module")
def pts(spark, data):
    return src.points(spark, data)


# classifier ------------------------------------------------------------------------------------


def room(spark, area, ecc, sol):
    return spark.createDataFrame([(float(area), float(ecc), float(sol))], "a double, e double, s double").select(classify.classify_room(F.col("a"), F.col("e"), F.col("s")).alias("c")).first().c


@pytest.mark.parametrize("shape, category, label", [
    ((15, 0.95, 0.9), "hallway", "Hallway / Corridor"), ((45, 0.95, 0.9), "office", "Conference Room"), ((5, 0.3, 0.9), "bathroom", "Bathroom / Storage"),
    ((7, 0.3, 0.9), "office", "Office / Meeting"), ((40, 0.3, 0.9), "office", "Office / Meeting"), ((40.01, 0.3, 0.9), "office", "Conference Room"),
    ((80, 0.3, 0.95), "office", "Conference Room"), ((81, 0.3, 0.95), "common", "Open Plan / Lobby"), ((81, 0.3, 0.85), "office", "Conference Room"),
    ((20, 0.3, 0.5), "unknown", "Irregular Space"), ((20, 0.85, 0.9), "office", "Office / Meeting"),
])
def test_classifier(spark, shape, category, label):
    c = room(spark, *shape)
    assert (c.category, c.label) == (category, label) and 0 <= c.confidence <= 1


def test_classifier_order(spark):
    assert room(spark, 10, 0.97, 0.9).confidence > room(spark, 10, 0.87, 0.9).confidence
    assert room(spark, 2, 0.2, 0.9).confidence > room(spark, 6.5, 0.2, 0.9).confidence
    assert room(spark, 300, 0.05, 0.99).confidence == pytest.approx(1.0)


# filters, properties -----------------------------------------------------------------------------


def test_band_and_complement(pts):
    low, high = 750, 1800
    inside, outside = filters.band(pts, low, high), pts.where(f"z_mm < {low} or z_mm > {high}")
    assert inside.count() + outside.count() == pts.count()
    assert inside.where(f"z_mm in ({low}, {high})").count() >= 0
    with pytest.raises(Exception, match="too few points"):
        filters.band(pts, 10_000, 20_000, at_least=100).count()


def test_voxel_properties(spark, pts):
    a = {tuple(r) for r in voxel.downsample(pts, 100).collect()}
    b = {tuple(r) for r in voxel.downsample(pts.repartition(7).orderBy(F.desc("point_id")), 100).collect()}
    assert a == b and sum(r[3] for r in a) == pts.count()


def test_transform_and_inverse(spark, pts):
    m = np.array(scalars.rotation_matrix(37.0, 1000, 2000, 55, -20))
    inv = np.linalg.inv(m).tolist()
    x, y, z = scalars.transform(m.tolist(), *[F.col(f"{k}_mm").cast("double") for k in "xyz"])
    back = scalars.transform(inv, x, y, z)
    assert pts.where(F.greatest(*[F.abs(b - F.col(f"{k}_mm")) for b, k in zip(back, "xyz")]) > 1e-6).count() == 0


def test_snap_is_idempotent(spark, data):
    s = src.segments(spark, data).limit(400)
    once = graph.cut(segments.manhattan_snap(s))
    twice = segments.manhattan_snap(once)
    d = once.join(twice.withColumnsRenamed({c: f"{c}b" for c in ("x1", "y1", "x2", "y2")}), "seg_id")
    assert d.count() == once.count() and d.where("abs(x1 - x1b) + abs(y1 - y1b) > 1e-6").count() == 0


# scenes ----------------------------------------------------------------------------------------


def test_floor_scene(spark):
    rng = np.random.default_rng(42)
    for level in (0.0, 1.5):
        floor = np.column_stack([rng.uniform(-10, 10, (3000, 2)), rng.normal(level, 0.005, 3000)])
        above = np.column_stack([rng.uniform(-10, 10, (2000, 2)), rng.uniform(level + 0.5, level + 3.0, 2000)])
        top = planes.floor_levels(cloud(spark, np.vstack([floor, above])), bin_mm=100, least_share=0.1).first()
        assert abs(top.floor_z / 1000 - level) < 0.15 and top.inlier_count > 500


def box(rng, n=500):
    out = []
    for z in np.linspace(0.75, 1.80, 15):
        t = rng.random(n)
        for x, y in ((t * 10, 0 * t), (t * 10, 0 * t + 8), (0 * t, t * 8), (0 * t + 10, t * 8)):
            out.append(np.column_stack([x + rng.normal(0, 0.01, n), y + rng.normal(0, 0.01, n), np.full(n, z)]))
    return np.vstack(out)


def test_walls_of_a_box(spark):
    p = cloud(spark, box(np.random.default_rng(7), 60)).repartition(4)
    found, rung = planes.wall_planes(graph.cut(p), most=6, tries=96)
    assert rung == "band at 50 mm"
    assert len(found) >= 4 and all(abs(w.c) < 0.25 for w, _ in found)
    assert planes.ransac(p.where("1 = 0")) is None


def test_alignment_recovers_the_truth(spark):
    """A seeded scan of the plan, turned and moved, is brought back to the wall lines."""
    rng = np.random.default_rng(3)
    pts = []
    for _, x0, y0, x1, y1 in src.WALLS:
        t = rng.random(400)
        pts.append(np.column_stack([x0 + (x1 - x0) * t, y0 + (y1 - y0) * t]) / 1000 + rng.normal(0, 0.01, (400, 2)))
    plan = np.vstack(pts)
    turn = math.radians(8)
    r = np.array([[math.cos(turn), -math.sin(turn)], [math.sin(turn), math.cos(turn)]])
    scan = plan @ r.T + [5, -3]
    p = cloud(spark, np.column_stack([scan, rng.uniform(0.8, 1.7, len(scan))]))
    got = planes.align_to_plan(p, src.walls(spark), voxel_mm=50)
    m = np.array(got["matrix"])
    moved = scan * 1000 @ m[:2, :2].T + m[:2, 2]
    assert np.sqrt(((moved - plan * 1000) ** 2).sum(1).mean()) < 60 and got["rmse_mm"] < 30
    assert abs(math.degrees(math.atan2(m[1, 0], m[0, 0])) + 8) < 0.5


def test_icp_without_matches_fails(spark):
    a, b = cloud(spark, [(0, 0, 0)]), cloud(spark, [(100, 100, 0)])
    with pytest.raises(ValueError):
        planes.icp_2d(a, b)


def test_fixture_scene(spark):
    rng = np.random.default_rng(99)
    bump = np.column_stack([rng.normal(5.10, 0.02, 200), rng.normal(2, 0.08, 200), rng.normal(1.5, 0.08, 200)])
    clean = np.column_stack([rng.normal(5.0, 0.005, 2000), rng.uniform(0, 4, 2000), rng.uniform(0, 3, 2000)])
    wall = spark.createDataFrame([(1, -1.0, 0.0, 0.0, 5000.0, 5000, 5000, 0, 4000)], "wall int, a double, b double, c double, d double, bx0 long, bx1 long, by0 long, by1 long")
    wall = wall.withColumns({"a": F.lit(1.0), "d": F.lit(-5000.0)})
    found = rooms.fixtures(spatial.near_planes(cloud(spark, np.vstack([bump, clean])), wall), eps=100, least=20).collect()
    assert len(found) == 1 and 10 <= found[0].depth_mm <= 350
    assert rooms.fixtures(spatial.near_planes(cloud(spark, clean), wall), eps=50, least=50).count() == 0


def test_room_scene(spark):
    rng = np.random.default_rng(42)
    t = np.linspace(0, 10, 800)
    walls = np.vstack([np.column_stack(c) for c in ((t, 0 * t), (t, 0 * t + 10), (0 * t, t), (0 * t + 10, t))])
    z = rng.uniform(1.05, 1.95, (len(walls) * 3, 1))
    p = cloud(spark, np.hstack([np.repeat(walls, 3, axis=0), z]))
    got = rooms.rooms_from_scan(p).collect()
    assert sum(r.area_m2 for r in got) == pytest.approx(100, rel=0.2) and all(0.3 <= r.confidence <= 1 for r in got)
    ring = rooms.outline(p).collect()
    assert kernels.area([(r.x, r.y) for r in sorted(ring, key=lambda r: r.k)]) == pytest.approx(100, rel=0.1)
    lines = rooms.plan_from_projection(p, cell=50).collect()
    assert len(lines) >= 4 and all(min(abs(r.x1 - r.x2), abs(r.y1 - r.y2)) < 200 for r in lines)


# spatial joins -----------------------------------------------------------------------------------


def test_spatial_joins_match_brute_force(spark):
    rng = np.random.default_rng(5)
    xyz = rng.uniform(-3, 3, (250, 3))
    p = cloud(spark, xyz)
    mm = np.round(xyz * 1000).astype(int)
    d2 = ((mm[:, None] - mm[None]) ** 2).sum(2)
    got = {(r.a_id, r.b_id): r.d2 for r in spatial.radius_pairs(p, p, 900).collect()}
    assert got == {(i, j): d2[i, j] for i, j in zip(*np.nonzero(d2 <= 900 * 900))}
    knn = {r.a_id: r.mean_d for r in spatial.knn_distance(p, 5, 300).collect()}
    want = np.sqrt(np.sort(d2 + np.eye(250, dtype=int) * 10**12, axis=1)[:, :5]).mean(1)
    assert all(knn[i] == pytest.approx(want[i]) for i in range(250))


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    xyz = np.vstack([rng.normal(c, 0.1, (40, 3)) for c in (0, 2, 5)] + [rng.uniform(-5, 8, (20, 3))])
    mm = np.round(xyz * 1000).astype(int)
    near = ((mm[:, None] - mm[None]) ** 2).sum(2) <= 200 * 200
    core = near.sum(1) >= 6
    label = {}
    for i in np.flatnonzero(core):
        if i in label:
            continue
        todo = [i]
        label[i] = i
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & core):
                if j not in label:
                    label[j] = i
                    todo.append(j)
    want = [label.get(i, min((label[j] for j in np.flatnonzero(near[i] & core)), default=None)) for i in range(len(mm))]
    got = {r.point_id: r.label for r in planes.dbscan(cloud(spark, xyz), 200, 6).collect()}
    assert [got[i] for i in range(len(mm))] == want


# rasters and kernels -------------------------------------------------------------------------------


def test_closing_is_extensive(spark):
    rng = random.Random(1)
    cells = spark.createDataFrame([(rng.randrange(20), rng.randrange(20)) for _ in range(120)], "col long, row long").distinct()
    closed = raster.close(cells)
    assert cells.join(closed, ["col", "row"], "left_anti").count() == 0
    opened = raster.open_(cells)
    assert opened.join(cells, ["col", "row"], "left_anti").count() == 0


def test_hole_filling(spark):
    ring = [(x, y) for x in range(8) for y in range(8) if x in (0, 7) or y in (0, 7)]
    cells = spark.createDataFrame(ring, "col long, row long")
    assert raster.fill_holes(cells).count() == 64 and raster.fill_holes(cells, largest=10).count() == len(ring)


def test_kernels():
    mask = np.zeros((9, 9), bool)
    mask[1:8, 1:8] = True
    assert kernels.area(kernels.contour(mask)) == 49
    assert kernels.convex_hull([(0, 0), (2, 0), (1, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert kernels.simplify([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.1) == [(0, 0), (2, 0), (2, 2)]
    assert kernels.line_cells(0, 0, 4, 2)[0] == (0, 0) and kernels.line_cells(0, 0, 4, 2)[-1] == (4, 2) and len(kernels.line_cells(3, 3, 3, 3)) == 1
    x, y = kernels.interior_point([(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (0, 1)])
    assert 0 < y < 4 and 0 < x < 4


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {r.component for r in graph.components(edges).collect()} == {0}


# files -------------------------------------------------------------------------------------------


def las_bytes(xyz, cls, rgb):
    h = bytearray(227)
    h[:4] = b"LASF"
    h[24:26] = bytes((1, 2))
    struct.pack_into("<H", h, 94, 227)
    struct.pack_into("<I", h, 96, 227)
    h[104] = 2
    struct.pack_into("<HI", h, 105, 26, len(xyz))
    struct.pack_into("<6d", h, 131, 0.001, 0.001, 0.001, 0, 0, 0)
    body = b"".join(struct.pack("<iiiHBBbBH3H", *p, 7, 0, c, 0, 0, 0, *k) for p, c, k in zip(xyz, cls, rgb))
    return bytes(h) + body


def test_las_and_ply(spark, tmp_path):
    rng = random.Random(3)
    xyz = [(rng.randrange(9999), rng.randrange(9999), rng.randrange(3000)) for _ in range(2500)]
    cls = [6 if i % 5 == 0 else 7 if i % 5 == 1 else 2 for i in range(2500)]
    (tmp_path / "a.las").write_bytes(las_bytes(xyz, cls, [(i, 2, 3) for i in range(2500)]))
    scan_files.register(spark)
    raw = spark.read.format("scan").option("pointsPerTask", "600").load(str(tmp_path))
    assert raw.rdd.getNumPartitions() == 5
    got = {r.point_id: (round(r.x * 1000), round(r.y * 1000), round(r.z * 1000), r.r) for r in raw.collect()}
    assert got == {i: (*p, i) for i, p in enumerate(xyz)}
    assert scan_files.load_scan(spark, str(tmp_path)).select("classification").distinct().collect()[0][0] == 6
    pts = spark.createDataFrame([(0.5, 1.5, -2.25, 1.0, 0.5, 0.0), (1.0, 2.0, 3.0, 0.0, 0.25, 1.0)], "x double, y double, z double, r double, g double, b double")
    (tmp_path / "b.ply").write_bytes(sinks.ply_bytes(pts))
    back = spark.read.format("scan").load(str(tmp_path / "b.ply")).orderBy("x").collect()
    assert [(r.x, r.y, r.z, r.r, r.g, r.b) for r in back] == [(0.5, 1.5, -2.25, 255, 127, 0), (1.0, 2.0, 3.0, 0, 63, 255)]
    with pytest.raises(ValueError):
        scan_files.load_scan(spark, "x.laz")


def test_scan_files_in_ranges(spark, tmp_path, monkeypatch):
    """PLY files split as LAS files do; batches are bounded; URIs are paths too."""
    monkeypatch.setattr(scan_files, "BATCH", 100)
    rng = random.Random(4)
    xyz = [(rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0, 3)) for _ in range(950)]
    pts = spark.createDataFrame([(*p, 0.0, 1.0, 0.5) for p in xyz], "x double, y double, z double, r double, g double, b double")
    (tmp_path / "a.ply").write_bytes(sinks.ply_bytes(pts))
    head = scan_files.ply_header(str(tmp_path / "a.ply"))
    got = [b for low in range(0, 950, 300) for b in scan_files.ply_records(str(tmp_path / "a.ply"), head, low, min(950, low + 300))]
    assert max(b.num_rows for b in got) == 100 and sum(b.num_rows for b in got) == 950
    scan_files.register(spark)
    raw = spark.read.format("scan").option("pointsPerTask", "300").load(f"file://{tmp_path}/a.ply")
    assert raw.rdd.getNumPartitions() == 4
    rows = {r.point_id: (r.x, r.y, r.z, r.r, r.g, r.b, r.classification) for r in raw.collect()}
    assert len(rows) == 950 and {v[3:] for v in rows.values()} == {(0, 255, 127, None)}
    assert sorted(round(v[0], 4) for v in rows.values()) == sorted(round(float(np.float32(p[0])), 4) for p in xyz)
    text = "\n".join(["ply", "format ascii 1.0", "element vertex 250", "property float x", "property float y", "property float z", "end_header", *(f"{i} {i / 2} 0" for i in range(250))])
    (tmp_path / "b.ply").write_text(text + "\n")
    assert {(r.point_id, r.x, r.y, r.r) for r in spark.read.format("scan").load(str(tmp_path / "b.ply")).collect()} == {(i, float(i), i / 2, None) for i in range(250)}
    assert spark.read.format("scan").load(str(tmp_path)).count() == 1200
    for body in (b"nope", b"ply\nformat ascii 1.0\nelement vertex 0\nend_header\n"):
        (tmp_path / "c.ply").write_bytes(body)
        with pytest.raises(ValueError):
            scan_files.ply_header(str(tmp_path / "c.ply"))


def test_colours_of_scans(spark, tmp_path):
    """Scan by scan: colours as they are scaled, else those of the intensities, else none."""
    xyz, cls = [(i, i, i) for i in range(100)], [2] * 100
    (tmp_path / "a.las").write_bytes(las_bytes(xyz, cls, [(65535, 0, 13107)] * 100))
    grey = bytearray(las_bytes(xyz, cls, [(0, 0, 0)] * 100))
    grey[104] = 0  # a point format without colours; the records are as long
    for i in range(100):
        struct.pack_into("<H", grey, 227 + 26 * i + 12, i)
    (tmp_path / "b.las").write_bytes(bytes(grey))
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n")
    got = {}
    for r in scan_files.load_scan(spark, str(tmp_path)).collect():
        got.setdefault(r.scan[-5:], {})[r.point_id] = (r.r, r.g, r.b)
    assert got["a.las"][5] == pytest.approx((1.0, 0.0, 0.2)) and got["c.ply"] == {0: (None, None, None)}
    assert got["b.las"][0] == pytest.approx((0.0, 0.0, 0.55)) and got["b.las"][99] == pytest.approx((0.4, 0.85, 1.0))
    assert got["b.las"][50] == pytest.approx(tuple(k * (50 - 1.98) / 95.04 + o for k, o in ((0.4, 0), (0.85, 0), (0.45, 0.55))))


def test_dxf_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("walls", 0.0, 0.0, 20.0, 0.0), ("walls", 20.0, 0.0, 20.0, 15.0), ("ghost", 1.0, 1.0, 2.0, 2.0)], "class string, x1 double, y1 double, x2 double, y2 double")
    text, dropped = sinks.dxf_text(s, note="hello")
    assert dropped == ["ghost"]
    (tmp_path / "p.dxf").write_text(text)
    scan_files.register(spark)
    v = spark.read.format("dxf").load(str(tmp_path / "p.dxf"))
    edges = sorted((r.x1, r.y1, r.x2, r.y2) for r in scan_files.plan_edges(v).collect())
    assert edges == [(0.0, 0.0, 20.0, 0.0), (20.0, 0.0, 20.0, 15.0)]
    assert {r.text for r in v.where("text is not null").collect()} == {"hello", "dropped classes: ghost"}
    noted = sinks.annotated_dxf(text, "turned by 8 degrees")
    (tmp_path / "q.dxf").write_text(noted)
    again = spark.read.format("dxf").load(str(tmp_path / "q.dxf"))
    assert sorted((r.x1, r.y1, r.x2, r.y2) for r in scan_files.plan_edges(again).collect()) == edges
    assert [r.layer for r in again.where("text = 'turned by 8 degrees'").collect()] == ["ALIGNMENT_NOTE"]
    with pytest.raises(ValueError):
        sinks.annotated_dxf("0\nEOF\n", "x")
    moved = sinks.transformed_dxf(s, scalars.rotation_matrix(90))
    assert "transform" in moved


def test_uploads(spark, tmp_path):
    for name, body in {"a.las": b"LASFxx", "b.las": b"nope", "c.ply": b"ply\n", "d.txt": b"x"}.items():
        (tmp_path / name).write_bytes(body)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.verdict for r in scan_files.valid_uploads(files).collect()}
    assert got == {"a.las": "ok", "b.las": "magic", "c.ply": "ok", "d.txt": "suffix"}
    assert [r.verdict for r in scan_files.valid_uploads(files, most_scans=2).orderBy("path").collect()] == ["ok", "magic", "too many", "suffix"]
    plain = {r.path.rsplit("/", 1)[1]: r.verdict for r in scan_files.valid_vectorize_upload(files).collect()}
    assert plain == {"a.las": "ok", "b.las": "ok", "c.ply": "ok", "d.txt": "suffix"}


def test_jobs(spark, tmp_path):
    from strataplan.jobs import JobTable, VectorizeParams

    t = JobTable(spark, str(tmp_path / "jobs"))
    t.create("a", "align")
    t.create("b", "vectorize", "{}")
    t.update("a", "processing")
    t.update("a", "aligned", '{"rooms": ["x", "y"], "fixtures": []}')
    assert t.get("a")["status"] == "aligned" and t.get("b")["status"] == "queued"
    assert {r.job_id: r.rooms for r in t.result_counts().collect()} == {"a": 2, "b": 0}
    assert t.result("a")["rooms"] == ["x", "y"] and t.result("b") is None
    assert [r.job_id for r in t.recent(kind="vectorize").collect()] == ["b"]
    with pytest.raises(KeyError):
        t.update("zz", "failed")
    with pytest.raises(ValueError):
        t.update("b", "approved")
    with pytest.raises(ValueError):
        VectorizeParams(slab=5.0)


def test_job_queue_and_retention(spark, tmp_path):
    from strataplan.jobs import JobTable

    t = JobTable(spark, str(tmp_path / "jobs"))
    for name in "abcd":
        t.create(name, "align")
    assert [r.job_id for r in t.admitted().orderBy("job_id").collect()] == ["a", "b"]
    t.update("a", "processing")
    assert [r.job_id for r in t.admitted().collect()] == ["b"]
    t.update("b", "processing")
    assert t.admitted().count() == 0
    with pytest.raises(ValueError):
        t.update("c", "approved")  # it was never aligned
    t.update("a", "aligned")
    t.update("a", "aligned", '{"rooms": []}')
    t.update("a", "approved")
    assert [r.job_id for r in t.admitted().collect()] == ["c"]
    assert t.recover() == 1 and t.get("b")["status"] == "queued" and t.recover() == 0
    assert t.delete_expired("0000") == 0 and t.latest().count() == 4
    t.create("e", "align")
    cutoff = t.get("e")["created_at"]
    assert t.delete_expired(cutoff) == 4 and [r.job_id for r in t.latest().collect()] == ["e"]
    t.update("e", "processing")
    assert t.get("e")["status"] == "processing"


def test_streams_drop_what_is_late(spark, tmp_path):
    """Files come one by one; a row behind the watermark is left out, and a query that is started
    again goes on after the last file it saw."""
    from strataplan.streaming import progress as st

    def put(k, *rows):
        from datetime import datetime

        df = spark.createDataFrame([(datetime(2024, 1, 1, h, m), "job", "step", 0.5) for h, m in rows], "ts timestamp, job_id string, stage string, progress double")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        return df.schema

    schema = put(1, (1, 5), (1, 50))
    put(2, (3, 0))
    put(3, (3, 10))
    put(4, (1, 30), (4, 0))  # 1:30 is more than ten minutes behind what the batches before last had

    def counts():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        return st.tumbling_counts(events)

    out = st.resumed(counts(), str(tmp_path / "q"), "append")
    assert sorted((r.start.hour, r.n) for r in out.collect()) == [(1, 2)]
    put(5, (9, 0))
    out = st.resumed(counts(), str(tmp_path / "q"), "append")
    assert sorted((r.start.hour, r.n) for r in out.collect()) == [(1, 2), (3, 2), (4, 1)]


def house(rng, n=700):
    """Walls, floor and a column of an L-shaped room, metres."""
    out = [np.column_stack([rng.uniform(0, 6, n), rng.uniform(0, 4, n), np.zeros(n)])]
    for x0, y0, x1, y1 in ((0, 0, 6, 0), (6, 0, 6, 4), (6, 4, 2, 4), (2, 4, 2, 6), (2, 6, 0, 6), (0, 6, 0, 0)):
        t = rng.random(n)
        out.append(np.column_stack([x0 + (x1 - x0) * t, y0 + (y1 - y0) * t, rng.uniform(0, 2.5, n)]))
    t = rng.uniform(0, 2 * np.pi, n)
    out.append(np.column_stack([4.5 + 0.3 * np.cos(t), 2.5 + 0.3 * np.sin(t), rng.uniform(0, 1.6, n)]))
    return np.vstack(out)


def turned(xyz, degrees, shift):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return xyz @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + shift


def test_icp_in_space(spark):
    xyz = house(np.random.default_rng(5), 300)
    a, b = cloud(spark, turned(xyz, 2, [0.08, -0.05, 0.03])), cloud(spark, xyz)
    m, rmse, share, rounds = planes.icp_3d(a, b, rounds=40, reach=300)
    moved = turned(xyz, 2, [0.08, -0.05, 0.03]) @ m[:3, :3].T + m[:3, 3] / 1000
    assert np.abs(moved - xyz).max() < 0.03 and share > 0.95 and rounds <= 40
    with pytest.raises(ValueError):
        planes.icp_3d(a, cloud(spark, xyz + 500), rounds=2, reach=100)


def scans(spark, *clouds):
    out = [cloud(spark, c).withColumn("scan_id", F.lit(i)).withColumn("point_id", F.col("point_id") + 1_000_000 * i) for i, c in enumerate(clouds)]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def test_merge_strategies(spark):
    from strataplan.operators import merging

    rng = np.random.default_rng(6)
    first, second = house(rng), house(rng)
    one = merging.merge(scans(spark, first), 100, neighbours=5)
    assert one.strategy == "single" and one.after <= one.before and abs(one.cloud.agg(F.avg("x_mm")).first()[0]) < 1
    far = merging.merge(scans(spark, first, second + [12, 0, 0]), 100, neighbours=0)
    assert far.strategy == "concatenate" and far.scans == 2
    apart = merging.merge(scans(spark, first, turned(second, 65, [1.5, -2.0, 6.0])), 100, neighbours=0)
    assert apart.strategy == "icp_registered"
    # registered, both scans lie on the same walls: hardly more voxels than one scan has
    alone = merging.merge(scans(spark, first), 100, neighbours=0)
    assert apart.after < 1.75 * alone.after
    back = apart.cloud.toPandas()[["x_mm", "y_mm", "z_mm"]].to_numpy() + np.array(apart.offset)
    walls = house(np.random.default_rng(1), 4000) * 1000
    d = np.array([np.sqrt(((walls - p) ** 2).sum(1).min()) for p in back[::37]])
    assert np.quantile(d, 0.9) < 150
    with pytest.raises(ValueError):
        merging.merge(scans(spark, first).where("1 = 0"), 100)


def test_floors_by_peeling(spark):
    rng = np.random.default_rng(8)
    floor = np.column_stack([rng.uniform(0, 12, (9000, 2)), rng.normal(0, 0.004, 9000)])
    roof = np.column_stack([rng.uniform(0, 12, (9000, 2)), rng.normal(2.8, 0.004, 9000)])
    walls = np.column_stack([rng.uniform(0, 12, 4000), np.zeros(4000), rng.uniform(0, 2.8, 4000)])
    up = np.vstack([floor, roof, walls])
    got = planes.peel_floors(cloud(spark, up), tries=48)
    assert abs(got[0]["floor_z"]) < 30 and got[0]["axis_idx"] == 2 and any(abs(f["floor_z"] - 2800) < 30 for f in got)
    side = planes.peel_floors(cloud(spark, up[:, [0, 2, 1]]), tries=48)
    assert abs(side[0]["floor_z"]) < 30 and side[0]["axis_idx"] == 1
    none = planes.peel_floors(cloud(spark, rng.uniform(0, 3, (1500, 3))), least=1400, tries=8)
    assert len(none) == 1 and none[0]["inlier_count"] == 1


def test_wall_ladder_uses_normals_last(spark):
    """Walls that only stand above the band are found by their normals."""
    rng = np.random.default_rng(9)
    t = rng.random(3000) * 4
    high = np.column_stack([t, np.zeros(3000), rng.uniform(2.2, 3.4, 3000)])
    found, rung = planes.wall_planes(graph.cut(cloud(spark, high)), most=2, tries=32)
    assert found and rung.startswith("normals") and abs(found[0][0].b) > 0.95


def test_planes_scan_by_scan(spark):
    rng = np.random.default_rng(10)
    p = scans(spark, house(rng, 900), turned(house(rng, 900), 90, [30, 0, 0]))
    got = planes.scan_planes(p).toPandas()
    assert set(got.scan_id) == {0, 1} and (got.groupby("scan_id").size() >= 4).all() and got.c.abs().max() <= 0.3
    south = got[(got.scan_id == 0) & (got.b.abs() > 0.98) & (got.d.abs() < 60)]
    assert len(south) == 1
    assert planes.scan_planes(p.where("z_mm < 500")).count() == 0


def test_main_cluster(spark):
    rng = np.random.default_rng(11)
    p = cloud(spark, np.vstack([rng.uniform(0, 3, (200, 3)), rng.uniform(0, 2, (60, 3)) + [40, 0, 0], [[5.5, 1, 1], [8.0, 1, 1]]]))
    kept = planes.main_cluster_box(p, eps=1500, least=10).toPandas()
    assert len(kept) == 201 and kept.x_mm.max() == 5500
    assert planes.main_cluster_box(p.where("x_mm < 4000"), eps=1500, least=10).count() == 200


def test_neighbours_beyond_any_radius(spark):
    """Outliers far from all others get their true mean; too few points use those there are."""
    pts = [(0, 0, 0), (10, 0, 0), (20, 0, 0), (100_000, 0, 0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "point_id long, x_mm long, y_mm long, z_mm long")
    got = {r.a_id: (r.n, r.mean_d) for r in spatial.knn_distance(df, 2, 50).collect()}
    assert got[3] == (2, 99_985.0) and got[0] == (2, 15.0)
    few = {r.a_id: (r.n, r.mean_d) for r in spatial.knn_distance(df, 9, 50).collect()}
    assert few[0] == (3, pytest.approx(100_030 / 3))
    assert spatial.knn_distance(df.where("point_id = 0"), 2, 50).first().mean_d is None and spatial.knn_distance(df.where("1 = 0"), 2, 50).count() == 0


def test_rooms_by_building(spark):
    ring = [(c, r) for c in range(40) for r in range(40)]
    one = spark.createDataFrame(ring, "col long, row long").where("NOT (col = 19 AND row <> 20)")
    many = one.withColumn("building", F.explode(F.array(F.lit("a"), F.lit("b"))))
    alone = rooms.rooms_from_floor(one, 150).toPandas()
    both = rooms.rooms_from_floor(many, 150).toPandas()
    assert len(alone) >= 2 and sorted(both.building.unique()) == ["a", "b"]
    for name in "ab":
        mine = both[both.building == name].drop(columns="building").reset_index(drop=True)
        assert sorted(mine.area_m2) == sorted(alone.area_m2)
    dist = raster.free_distance(many)
    assert dist.columns == ["building", "col", "row", "dist"] and dist.where("building = 'a'").count() == raster.free_distance(one).count()


def test_geojson(spark):
    s = spark.createDataFrame([(1, 0, 0, 5, 5)], "seg_id long, x1 long, y1 long, x2 long, y2 long")
    assert '"LineString"' in sinks.feature_collection(s, (0, 0, 1, 1)) and '"bounds"' in sinks.feature_collection(s.where("1 = 0"), (0, 0, 1, 1))


def test_vectorize(spark, pts, tmp_path):
    from strataplan.plans.pipelines import VectorizeParams, vectorize

    out = vectorize(pts.where("not is_floor"), VectorizeParams(elevation=1.4, slab=1.0, resolution=0.1, least_length=1.0))
    assert out["metrics"]["segments"] >= 5 and "AC1032" in out["dxf"]
    sinks.save_slice(out["cells"], out["affine"], str(tmp_path / "s"))
    cells, affine = sinks.load_slice(spark, str(tmp_path / "s"))
    assert cells.count() == out["metrics"]["cells"] and affine == out["affine"]
    assert sinks.png_bytes(np.zeros((3, 4), np.uint8)).startswith(b"\x89PNG")
    assert (tmp_path / "s" / "slice.png").read_bytes().startswith(b"\x89PNG")
    assert sinks.overlay_png(cells, out["segments"], affine).startswith(b"\x89PNG")


def test_scan_to_plan(spark, pts):
    from strataplan.plans.pipelines import ScanParams, scan_to_plan

    out = scan_to_plan(pts, src.walls(spark), ScanParams(room_cell=300))
    assert out["alignment"]["rmse_mm"] < 60 and out["plan"].count() >= 4 and out["floors"].count() >= 1 and out["outline"].count() >= 4
