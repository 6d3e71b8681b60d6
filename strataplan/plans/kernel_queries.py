"""Iterative and dense operators as queries; job tables; driver pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, graph, planes, raster, rooms, segments as seg, spatial
from ..sources import building as src
from .join_queries import _E3D, _NEAR, _dist, _e3, _near
from .registry import query

P, S = src.POINTS_SQL, src.SEGMENTS_SQL


def _wall_planes() -> list[planes.Plane]:
    out = []
    for _, x0, y0, x1, y1 in src.WALLS:
        n = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
        a, b = (y1 - y0) / n, (x0 - x1) / n
        out.append(planes.Plane(a, b, 0.0, -(a * x0 + b * y0)))
    return out


@query("ransac_score", f"WITH {P}, h AS (SELECT wall, (y1 - y0) / sqrt(CAST((x1 - x0) ** 2 + (y1 - y0) ** 2 AS DOUBLE)) AS na, (x0 - x1) / sqrt(CAST((x1 - x0) ** 2 + (y1 - y0) ** 2 AS DOUBLE)) AS nb, x0, y0 FROM walls) SELECT h.wall AS hypothesis, count(*) FILTER (abs(na * x_mm + nb * y_mm - (na * x0 + nb * y0)) <= 50) AS inliers FROM h, pts GROUP BY 1")
def ransac_score(spark, d):
    """All hypotheses are scored in one pass over the points."""
    h = _wall_planes()
    one = src.points(spark, d).agg(*[F.count_if(F.abs(p.distance()) <= 50).alias(f"p{i}") for i, p in enumerate(h)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i + 1).alias("hypothesis"), F.col(f"p{i}").alias("inliers")) for i in range(len(h))])).alias("s")).select("s.*")


@query("ransac_planes")
def ransac_planes(spark, d):
    found, _ = planes.peel_planes(src.points(spark, d), most=8, least=500, tries=48)
    return spark.createDataFrame([(f"wall-{i + 1:03d}", p.a, p.b, p.c, p.d, n) for i, (p, n) in enumerate(found)], "wall_id string, a double, b double, c double, d double, n_inliers long")


@query("floor_levels", f"""WITH {P}, h AS (SELECT CAST(floor(z_mm / 50.0) AS BIGINT) AS bin, count(*) AS n, CAST(sum(z_mm) AS BIGINT) AS s FROM pts GROUP BY 1), pk AS (SELECT a.* FROM h a LEFT JOIN h b ON abs(a.bin - b.bin) = 1 GROUP BY ALL HAVING a.n > coalesce(max(b.n), 0) AND a.n >= 0.01 * (SELECT sum(n) FROM h))
SELECT CAST(pk.s AS DOUBLE) / pk.n AS floor_z, pk.n AS inlier_count, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS wall_score, CAST(2 AS INT) AS axis_idx FROM pk LEFT JOIN h ON h.bin >= pk.bin + 6 AND h.bin < pk.bin + 60 GROUP BY pk.bin, pk.n, pk.s""")
def floor_levels(spark, d):
    return planes.floor_levels(src.points(spark, d))


_ICP = "a AS (SELECT * FROM pts WHERE scan_id = 0 AND NOT is_floor), b AS (SELECT * FROM pts WHERE scan_id = 1 AND NOT is_floor)"


@query("icp_step", f"""WITH {P}, {_ICP}, p AS (SELECT a.point_id AS a_id, arg_min((b.x_mm, b.y_mm), ({_dist('a', 'b', 'xy')}, b.point_id)) AS q, any_value(a.x_mm) AS px, any_value(a.y_mm) AS py FROM a JOIN b ON b.x_mm BETWEEN a.x_mm - 500 AND a.x_mm + 500 AND b.y_mm BETWEEN a.y_mm - 500 AND a.y_mm + 500 WHERE {_dist('a', 'b', 'xy')} <= 250000 GROUP BY 1),
m AS (SELECT CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, CAST(q[1] AS DOUBLE) AS qx, CAST(q[2] AS DOUBLE) AS qy FROM p), s AS (SELECT count(*) AS n, avg(px) AS mpx, avg(py) AS mpy, avg(qx) AS mqx, avg(qy) AS mqy, avg(px * qx + py * qy) AS dt, avg(px * qy - py * qx) AS cr FROM m)
SELECT n AS matched, round(atan2(cr - (mpx * mqy - mpy * mqx), dt - (mpx * mqx + mpy * mqy)), 6) AS angle FROM s""")
def icp_step(spark, d):
    p = src.points(spark, d).where("not is_floor")
    a, b = p.where("scan_id = 0"), p.where("scan_id = 1")
    near = spatial.nearest(a, b, 500, dims="xy")
    m = near.join(a.selectExpr("point_id as a_id", "cast(x_mm as double) as px", "cast(y_mm as double) as py"), "a_id").join(b.selectExpr("point_id as b_id", "cast(x_mm as double) as qx", "cast(y_mm as double) as qy"), "b_id")
    s = m.agg(F.count("*").alias("n"), *[F.avg(k).alias(f"m{k}") for k in ("px", "py", "qx", "qy")], F.avg(F.expr("px * qx + py * qy")).alias("dt"), F.avg(F.expr("px * qy - py * qx")).alias("cr"))
    return s.select(F.col("n").alias("matched"), F.round(F.atan2(F.expr("cr - (mpx * mqy - mpy * mqx)"), F.expr("dt - (mpx * mqx + mpy * mqy)")), 6).alias("angle"))


@query("icp_register")
def icp_register(spark, d):
    p = src.points(spark, d).where("not is_floor")
    a = p.where("scan_id = 0").withColumn("x_mm", F.col("x_mm") + 60).withColumn("y_mm", F.col("y_mm") - 40)
    m, rmse, share, rounds = planes.icp_2d(a, p.where("scan_id <> 0"), rounds=8)
    return spark.createDataFrame([(*m[0], *m[1], rmse, share, rounds)], "m00 double, m01 double, tx double, m10 double, m11 double, ty double, rmse_mm double, inlier_ratio double, iterations int")


@query("align_to_plan")
def align_to_plan(spark, d):
    r = planes.align_to_plan(src.points(spark, d).where("not is_floor"), src.walls(spark), voxel_mm=200)
    m = r["matrix"]
    return spark.createDataFrame([(*m[0], *m[1], r["rmse_mm"], r["inlier_ratio"], r["iterations"], r["turn"])], "m00 double, m01 double, tx double, m10 double, m11 double, ty double, rmse_mm double, inlier_ratio double, iterations int, turn int")


@query("dbscan_labels", f"""WITH RECURSIVE {_E3D}, p AS (SELECT a.point_id AS a_id, b.point_id AS b_id FROM e a JOIN e b ON {_dist('a', 'b')} <= 250000), core AS (SELECT a_id AS c FROM p GROUP BY 1 HAVING count(*) >= 4),
l AS (SELECT a_id, b_id FROM p WHERE a_id IN (SELECT c FROM core) AND b_id IN (SELECT c FROM core)), reach(s, r) AS (SELECT c, c FROM core UNION SELECT l.b_id, reach.r FROM reach JOIN l ON l.a_id = reach.s), lab AS (SELECT s, min(r) AS label FROM reach GROUP BY 1),
every AS (SELECT s AS point_id, label FROM lab UNION ALL SELECT a_id, min(label) FROM p JOIN lab ON lab.s = b_id WHERE a_id NOT IN (SELECT c FROM core) GROUP BY 1) SELECT e.point_id, coalesce(label, -1) AS label FROM e LEFT JOIN every USING (point_id)""")
def dbscan_labels(spark, d):
    return planes.dbscan(_e3(spark, d), 500, 4).withColumn("label", F.coalesce("label", F.lit(-1)))  # noise as -1


@query("local_normals")
def local_normals(spark, d):
    p = src.points(spark, d).where("not is_floor")
    return planes.normals(p, 200, 20).select("point_id", "n", *[F.round(F.col("normal")[i], 6).alias(f"n{k}") for i, k in enumerate("xyz")])


@query("vertical_normal_filter")
def vertical_normal_filter(spark, d):
    p = src.points(spark, d).where("z_mm > 200")
    n = planes.normals(p, 200, 20)
    return n.where(F.abs(F.col("normal")[2]) <= 0.30).select("point_id", "n")


@query("fixtures_detected")
def fixtures_detected(spark, d):
    f = rooms.fixtures(_near(spark, d), eps=400, least=5)
    return f.select("wall_id", "label", "point_count", *[F.round(c, 3).alias(c) for c in ("cx", "cy", "cz", "depth_mm", "width_mm", "height_mm", "confidence")])


@query("rooms_from_scan")
def rooms_from_scan(spark, d):
    """Two buildings from one cloud: the rooms of one are divided by the plan's walls, the other's have none."""
    p = src.points(spark, d).where("not is_floor").withColumn("building", F.col("scan_id") % 2)
    w = src.walls(spark).select(F.lit(0).alias("building"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))
    return rooms.rooms_from_scan(p, w, 250, yard_m2=400.0).select("building", "room_id", "label", "category", "cx", "cy", "area_m2", "eccentricity", "solidity", "orientation_deg", "confidence")


@query("convex_hull")
def convex_hull(spark, d):
    return rooms.hull(src.points(spark, d))


@query("plan_from_projection")
def plan_from_projection(spark, d):
    return rooms.plan_from_projection(src.points(spark, d).where("not is_floor"), cell=100).select("seg_id", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("preprocess_raster", f"""WITH {P}, cells AS (SELECT DISTINCT CAST(floor(x_mm / 250.0) AS BIGINT) AS col, CAST(floor(y_mm / 250.0) AS BIGINT) AS row FROM pts WHERE NOT is_floor), k AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) k(dx, dy)),
g AS (SELECT DISTINCT col + dx AS col, row + dy AS row FROM cells, k), g2 AS (SELECT DISTINCT col + dx AS col, row + dy AS row FROM g, k),
e AS (SELECT c.col, c.row FROM g2 c, k JOIN g2 o ON o.col = c.col + dx AND o.row = c.row + dy GROUP BY 1, 2 HAVING count(*) = 5), e2 AS (SELECT c.col, c.row FROM e c, k JOIN e o ON o.col = c.col + dx AND o.row = c.row + dy GROUP BY 1, 2 HAVING count(*) = 5) SELECT * FROM e2""")
def preprocess_raster(spark, d):
    """Closing with two iterations of the small kernel."""
    c = src.points(spark, d).where("not is_floor").select(F.floor(F.col("x_mm") / 250.0).alias("col"), F.floor(F.col("y_mm") / 250.0).alias("row")).distinct()
    return raster.erode(raster.erode(raster.dilate(raster.dilate(c))))


@query("preprocess_blurred", f"""WITH {P}, cells AS (SELECT DISTINCT CAST(floor(x_mm / 250.0) AS BIGINT) AS col, CAST(floor(y_mm / 250.0) AS BIGINT) AS row FROM pts WHERE NOT is_floor), k AS (SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) k(dx, dy)),
g AS (SELECT DISTINCT col + dx AS col, row + dy AS row FROM cells, k), g2 AS (SELECT DISTINCT col + dx AS col, row + dy AS row FROM g, k),
e AS (SELECT c.col, c.row FROM g2 c, k JOIN g2 o ON o.col = c.col + dx AND o.row = c.row + dy GROUP BY 1, 2 HAVING count(*) = 5), e2 AS (SELECT c.col, c.row FROM e c, k JOIN e o ON o.col = c.col + dx AND o.row = c.row + dy GROUP BY 1, 2 HAVING count(*) = 5),
w AS (SELECT * FROM (VALUES """ + ", ".join(f"({dx}, {dy}, {w!r}e0)" for (dx, dy), w in raster.gaussian(3, 0.8).items()) + ") w(dx, dy, w)) SELECT col + dx AS col, row + dy AS row, round(sum(w), 9) AS v FROM e2, w GROUP BY 1, 2")
def preprocess_blurred(spark, d):
    """Closing, then the blur, as before line detection."""
    c = src.points(spark, d).where("not is_floor").select(F.floor(F.col("x_mm") / 250.0).alias("col"), F.floor(F.col("y_mm") / 250.0).alias("row"))
    return raster.preprocess(c).select("col", "row", F.round("v", 9).alias("v"))


@query("slab_on_side", f"WITH {P}, s AS (SELECT * FROM pts WHERE y_mm BETWEEN 4900 AND 5100), e AS (SELECT min(x_mm) x0, min(z_mm) z0 FROM s) SELECT CAST(floor((x_mm - x0) / 100.0) AS BIGINT) AS col, CAST(floor((z_mm - z0) / 100.0) AS BIGINT) AS row, count(*) AS n FROM s, e GROUP BY 1, 2")
def slab_on_side(spark, d):
    """A slab of a scan that lies on its side: y is the way up, the plan is x and z."""
    cells, _ = raster.slice_to_raster(src.points(spark, d), 4900, 5100, 100, up="y", clamp=False)
    return cells


_M3 = [[0.9998, -0.02, 0.0, 30.0], [0.02, 0.9998, 0.0, -20.0], [0.0, 0.0, 1.0, 5.0], [0.0, 0.0, 0.0, 1.0]]


@query("icp_step_3d", f"""WITH {P}, {_ICP}, g AS (SELECT point_id, """ + ", ".join(f"CAST(round(x_mm * {r[0]!r}e0 + y_mm * {r[1]!r}e0 + z_mm * {r[2]!r}e0 + {r[3]!r}e0) AS BIGINT) AS {k}_mm" for k, r in zip("xyz", _M3)) + f""" FROM a), p AS (SELECT a.point_id AS a_id, arg_min((b.x_mm, b.y_mm, b.z_mm), ({_dist('a', 'b')}, b.point_id)) AS q, min({_dist('a', 'b')}) AS d2 FROM g a JOIN b ON b.x_mm BETWEEN a.x_mm - 300 AND a.x_mm + 300 AND b.y_mm BETWEEN a.y_mm - 300 AND a.y_mm + 300 WHERE {_dist('a', 'b')} <= 90000 GROUP BY 1),
m AS (SELECT CAST(a.x_mm AS DOUBLE) AS px, CAST(a.y_mm AS DOUBLE) AS py, CAST(a.z_mm AS DOUBLE) AS pz, CAST(q[1] AS DOUBLE) AS qx, CAST(q[2] AS DOUBLE) AS qy, CAST(q[3] AS DOUBLE) AS qz, d2 FROM p JOIN a ON a.point_id = a_id)
SELECT count(*) AS matched, round(sqrt(avg(d2)), 6) AS rmse, """ + ", ".join(f"round(avg(p{i} * q{j}) - avg(p{i}) * avg(q{j}), 3) AS c{i}{j}" for i in "xyz" for j in "xyz") + " FROM m")
def icp_step_3d(spark, d):
    """The sums of one registration round in space: moved points meet their nearest, and the
    cross-covariance goes to the rotation."""
    p = src.points(spark, d).where("not is_floor")
    a, b = p.where("scan_id = 0"), p.where("scan_id = 1")
    near = spatial.nearest(planes.moved(a, _M3), b, 300)
    side = lambda t, key, name: t.select(F.col("point_id").alias(key), *[F.col(f"{k}_mm").cast("double").alias(f"{name}{k}") for k in "xyz"])
    m = near.join(side(a, "a_id", "p"), "a_id").join(side(b, "b_id", "q"), "b_id")
    return m.agg(F.count("*").alias("matched"), F.round(F.sqrt(F.avg("d2")), 6).alias("rmse"), *[F.round(F.avg(F.col(f"p{i}") * F.col(f"q{j}")) - F.avg(f"p{i}") * F.avg(f"q{j}"), 3).alias(f"c{i}{j}") for i in "xyz" for j in "xyz"])


@query("main_cluster_box", f"""WITH RECURSIVE {_E3D}, p AS (SELECT a.point_id AS a_id, b.point_id AS b_id FROM e a JOIN e b ON {_dist('a', 'b')} <= 250000), core AS (SELECT a_id AS c FROM p GROUP BY 1 HAVING count(*) >= 4),
l AS (SELECT a_id, b_id FROM p WHERE a_id IN (SELECT c FROM core) AND b_id IN (SELECT c FROM core)), reach(s, r) AS (SELECT c, c FROM core UNION SELECT l.b_id, reach.r FROM reach JOIN l ON l.a_id = reach.s), lab AS (SELECT s, min(r) AS label FROM reach GROUP BY 1),
every AS (SELECT s AS point_id, label FROM lab UNION ALL SELECT a_id, min(label) FROM p JOIN lab ON lab.s = b_id WHERE a_id NOT IN (SELECT c FROM core) GROUP BY 1), best AS (SELECT label FROM every GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1),
box AS (SELECT min(x_mm) - 300 AS x0, max(x_mm) + 300 AS x1, min(y_mm) - 300 AS y0, max(y_mm) + 300 AS y1 FROM e JOIN every USING (point_id) JOIN best USING (label)), n AS (SELECT count(DISTINCT label) AS k FROM every)
SELECT e.point_id FROM e, box, n WHERE k < 2 OR (x_mm BETWEEN x0 AND x1 AND y_mm BETWEEN y0 AND y1)""")
def main_cluster_box(spark, d):
    return planes.main_cluster_box(_e3(spark, d), 500, 4, 300).select("point_id")


@query("floor_planes")
def floor_planes(spark, d):
    return spark.createDataFrame([(f["floor_z"], f["inlier_count"], f["wall_score"], f["axis_idx"]) for f in planes.peel_floors(src.points(spark, d), tries=48)], "floor_z double, inlier_count long, wall_score long, axis_idx int")


@query("scan_wall_planes")
def scan_wall_planes(spark, d):
    return planes.scan_planes(src.points(spark, d))


@query("wall_ladder")
def wall_ladder(spark, d):
    found, rung = planes.wall_planes(src.points(spark, d).where("not is_floor"), most=8, tries=48)
    return spark.createDataFrame([(rung, p.a, p.b, p.c, p.d, n) for p, n in found], "rung string, a double, b double, c double, d double, n_inliers long")


@query("regularised_segments")
def regularised_segments(spark, d):
    return seg.regularise(src.segments(spark, d)).select("seg_id", *[F.round(c, 2).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("vectorize_metrics", f"WITH {S}, k AS (SELECT *, sqrt(CAST((x2 - x1) ** 2 + (y2 - y1) ** 2 AS DOUBLE)) AS len FROM segs) SELECT count(*) AS n_raw, count(*) FILTER (len >= 500) AS n_long, round(sum(len) FILTER (len >= 500), 3) AS total_mm FROM k")
def vectorize_metrics(spark, d):
    s = src.segments(spark, d).withColumn("len", filters.length_mm())
    return s.agg(F.count("*").alias("n_raw"), F.count_if(F.col("len") >= 500).alias("n_long"), F.round(F.sum(F.when(F.col("len") >= 500, F.col("len"))), 3).alias("total_mm"))


@query("merge_scans")
def merge_scans(spark, d):
    from ..operators import merging

    m = merging.merge(src.points(spark, d), 100, neighbours=8)
    return spark.createDataFrame([(m.strategy, m.scans, m.before, m.after, *m.offset)], "strategy string, scans int, before long, after long, ox double, oy double, oz double")


@query("decimated_count", f"WITH {P}, m AS (SELECT min(x_mm) mx, min(y_mm) my, min(z_mm) mz FROM pts) SELECT least(count(*), 20000) AS n FROM (SELECT DISTINCT (2 * (x_mm - mx) + 300) // 600, (2 * (y_mm - my) + 300) // 600, (2 * (z_mm - mz) + 300) // 600 FROM pts, m)")
def decimated_count(spark, d):
    from ..operators import voxel

    return voxel.downsample(src.points(spark, d), 300).agg(F.least(F.count("*"), F.lit(20000)).alias("n"))


_STEP = "a + ((abs(b - a) * i + n // 2) // greatest(n, 1)) * (CASE WHEN b >= a THEN 1 ELSE -1 END)"


@query("rasterise_segments", f"""WITH {S}, c AS (SELECT seg_id, CAST(floor(x1 / 100.0) AS BIGINT) AS ax, CAST(floor(y1 / 100.0) AS BIGINT) AS ay, CAST(floor(x2 / 100.0) AS BIGINT) AS bx, CAST(floor(y2 / 100.0) AS BIGINT) AS "by" FROM segs), n AS (SELECT *, greatest(abs(bx - ax), abs("by" - ay)) AS n FROM c), e AS (SELECT *, unnest(range(n + 1)) AS i FROM n)
SELECT DISTINCT {_STEP.replace("b - a", "bx - ax").replace("a +", "ax +").replace("b >= a", "bx >= ax")} AS col, {_STEP.replace("b - a", '"by" - ay').replace("a +", "ay +").replace("b >= a", '"by" >= ay')} AS row FROM e""")
def rasterise_segments(spark, d):
    """Cells of all segments: one exploded step along the longer side, no Python."""
    c = src.segments(spark, d).select("seg_id", *[F.floor(F.col(a) / 100.0).alias(b) for a, b in (("x1", "ax"), ("y1", "ay"), ("x2", "bx"), ("y2", "by_"))])
    return raster.line_cells(c)


@query("distance_transform", f"""WITH {P}, cells AS (SELECT DISTINCT CAST(floor(x_mm / 500.0) AS BIGINT) AS col, CAST(floor(y_mm / 500.0) AS BIGINT) AS row FROM pts WHERE NOT is_floor), box AS (SELECT min(col) c0, max(col) c1, min(row) r0, max(row) r1 FROM cells),
grid AS (SELECT col, unnest(range(r0, r1 + 1)) AS row FROM (SELECT r0, r1, unnest(range(c0, c1 + 1)) AS col FROM box)), free AS (SELECT * FROM grid EXCEPT SELECT * FROM cells)
SELECT f.col, f.row, round(sqrt(min((f.col - c.col) * (f.col - c.col) + (f.row - c.row) * (f.row - c.row))), 6) AS dist FROM free f, cells c GROUP BY 1, 2""")
def distance_transform(spark, d):
    c = src.points(spark, d).where("not is_floor").select(F.floor(F.col("x_mm") / 500.0).alias("col"), F.floor(F.col("y_mm") / 500.0).alias("row")).distinct()
    return raster.free_distance(c).select("col", "row", F.round("dist", 6).alias("dist"))


@query("vectorize_slice")
def vectorize_slice(spark, d):
    from .pipelines import VectorizeParams, vectorize

    out = vectorize(src.points(spark, d).where("not is_floor"), VectorizeParams(elevation=1.4, slab=0.4, resolution=0.05, least_length=1.0))
    return out["segments"].select("seg_id", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


# job tables ------------------------------------------------------------------------------------


@query("job_lookup", "SELECT user_id AS job_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS rooms, event_type = 'error' AS failed FROM events")
def job_lookup(spark, d):
    e = src.load(spark, d, "events")
    return e.select(F.col("user_id").alias("job_id"), "event_id", F.from_json("props", "k long")["k"].alias("rooms"), (F.col("event_type") == "error").alias("failed"))


@query("job_result_counts", "SELECT o_orderkey AS job_id, o_orderkey % 5 AS room_count, (o_orderkey % 5) * 12.5e0 AS area FROM orders")
def job_result_counts(spark, d):
    """Counts derived from nested results: rooms are built as JSON, parsed and measured."""
    result = F.to_json(F.struct(F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < F.col("o_orderkey") % 5), lambda i: F.struct(i.alias("id"), F.lit(12.5).alias("area"))).alias("rooms")))
    parsed = F.from_json(result, "struct<rooms:array<struct<id:int,area:double>>>")
    j = src.load(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), parsed.alias("r"))
    return j.select("job_id", F.size("r.rooms").cast("long").alias("room_count"), F.aggregate("r.rooms", F.lit(0.0), lambda a, x: a + x["area"]).alias("area"))


@query("job_status_counts", "SELECT o_orderstatus AS status, count(*) AS jobs FROM orders GROUP BY 1")
def job_status_counts(spark, d):
    return src.load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("jobs"))


@query("uploads_dedup", "SELECT DISTINCT p_name AS name, CASE WHEN p_name LIKE '%ring' THEN 'plan' ELSE 'scan' END AS route FROM part")
def uploads_dedup(spark, d):
    p = src.load(spark, d, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_name").like("%ring"), "plan").otherwise("scan").alias("route"))
    return p.dropDuplicates(["name"])


@query("first_files", "SELECT p_brand AS job, min(p_name) FILTER (p_type = 'ECONOMY') AS plan_file, min(p_name) FILTER (p_type <> 'ECONOMY') AS scan_file FROM part GROUP BY 1")
def first_files(spark, d):
    t = F.col("p_type") == "ECONOMY"
    return src.load(spark, d, "part").groupBy(F.col("p_brand").alias("job")).agg(F.min(F.when(t, F.col("p_name"))).alias("plan_file"), F.min(F.when(~t, F.col("p_name"))).alias("scan_file"))


@query("health", "SELECT CASE WHEN count(*) FILTER (event_type = 'error') * 2 <= count(*) THEN 'ok' ELSE 'failing' END AS status, count(*) AS events FROM events")
def health(spark, d):
    """One row for a probe: whether at most half of the events are errors."""
    return src.load(spark, d, "events").agg(F.when(F.count_if(F.col("event_type") == "error") * 2 <= F.count("*"), "ok").otherwise("failing").alias("status"), F.count("*").alias("events"))


# extensions over events: event time, grouping sets -----------------------------------------------


@query("event_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_tumbling(spark, d):
    e = src.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("event_cube", "SELECT coalesce(event_type, 'all') AS event_type, coalesce(user_id % 4, -1) AS grp, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 4)")
def event_cube(spark, d):
    e = src.load(spark, d, "events").withColumn("grp", F.expr("user_id % 4"))
    return e.cube("event_type", "grp").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("grp", F.lit(-1)).alias("grp"), "n")


@query("event_rollup", "SELECT coalesce(event_type, 'all') AS event_type, coalesce(user_id % 4, -1) AS grp, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, user_id % 4)")
def event_rollup(spark, d):
    e = src.load(spark, d, "events").withColumn("grp", F.expr("user_id % 4"))
    return e.rollup("event_type", "grp").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("grp", F.lit(-1)).alias("grp"), "n", "total")


@query("event_grouping_sets", "SELECT coalesce(event_type, 'all') AS event_type, coalesce(user_id % 4, -1) AS grp, GROUPING(event_type, user_id % 4) AS level, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 4), ())")
def event_grouping_sets(spark, d):
    e = src.load(spark, d, "events").withColumn("grp", F.expr("user_id % 4"))
    return e.groupingSets([["event_type"], ["grp"], []], "event_type", "grp").agg(F.grouping_id().alias("level"), F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("grp", F.lit(-1)).alias("grp"), "level", "n")


@query("event_asof", "SELECT a.event_id, a.user_id, coalesce(b.event_id, -1) AS last_error FROM (SELECT * FROM events WHERE event_type <> 'error') a LEFT JOIN LATERAL (SELECT max_by(e.event_id, (e.ts, e.event_id)) AS event_id FROM events e WHERE e.event_type = 'error' AND e.user_id = a.user_id AND e.ts <= a.ts) b ON true")
def event_asof(spark, d):
    """The last error of the same user up to each other event."""
    from ..operators import temporal

    e = src.load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    got = temporal.asof(e.where("event_type <> 'error'").drop("event_type"), e.where("event_type = 'error'"), "user_id", "ts", ["event_id"])
    return got.select("event_id", "user_id", F.coalesce("right_event_id", F.lit(-1)).alias("last_error"))


@query("event_interval_join", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR AND a.event_type = 'error' AND b.event_type <> 'error'")
def event_interval_join(spark, d):
    """What a user did in the hour after an error."""
    from ..operators import temporal

    e = src.load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    pairs = temporal.within(e.where("event_type = 'error'"), e.where("event_type <> 'error'"), "user_id", "ts", 3600)
    return pairs.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"))
