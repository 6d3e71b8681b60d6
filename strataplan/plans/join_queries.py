"""Spatial joins, rasters and segment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, raster, segments as seg, spatial
from ..sources import building as src
from .registry import query

P, S = src.POINTS_SQL, src.SEGMENTS_SQL


def _dist(a: str, b: str, dims: str = "xyz") -> str:
    return " + ".join(f"({a}.{k}_mm - {b}.{k}_mm) * ({a}.{k}_mm - {b}.{k}_mm)" for k in dims)


_TWO = f"{P}, a AS (SELECT * FROM pts WHERE scan_id = 0), b AS (SELECT * FROM pts WHERE scan_id = 1)"


def _two(spark, d):
    p = src.points(spark, d)
    return p.where("scan_id = 0"), p.where("scan_id = 1")


@query("nn_join", f"WITH {_TWO}, p AS (SELECT a.point_id AS a_id, b.point_id AS b_id, {_dist('a', 'b')} AS d2 FROM a JOIN b ON b.x_mm BETWEEN a.x_mm - 500 AND a.x_mm + 500 AND b.y_mm BETWEEN a.y_mm - 500 AND a.y_mm + 500 WHERE {_dist('a', 'b')} <= 250000) SELECT a_id, arg_min(b_id, (d2, b_id)) AS b_id, min(d2) AS d2 FROM p GROUP BY 1")
def nn_join(spark, d):
    return spatial.nearest(*_two(spark, d), 500)


@query("icp_correspondences", f"WITH {_TWO}, p AS (SELECT a.point_id AS a_id, min({_dist('a', 'b')}) AS d2 FROM a JOIN b ON b.x_mm BETWEEN a.x_mm - 500 AND a.x_mm + 500 AND b.y_mm BETWEEN a.y_mm - 500 AND a.y_mm + 500 WHERE {_dist('a', 'b')} <= 250000 GROUP BY 1) SELECT count(*) AS matched, (SELECT count(*) FROM a) AS source_points, round(sqrt(avg(d2)), 6) AS rmse, round(count(*) / CAST((SELECT count(*) FROM a) AS DOUBLE), 6) AS inlier_ratio FROM p")
def icp_correspondences(spark, d):
    a, b = _two(spark, d)
    m = spatial.nearest(a, b, 500).agg(F.count("*").alias("matched"), F.round(F.sqrt(F.avg("d2")), 6).alias("rmse"))
    return filters.with_scalar(m, a.agg(F.count("*").alias("source_points"))).withColumn("inlier_ratio", F.round(F.col("matched") / F.col("source_points").cast("double"), 6))


@query("mutual_nn", f"""WITH {_TWO}, p AS (SELECT a.point_id AS a_id, b.point_id AS b_id, {_dist('a', 'b')} AS d2 FROM a JOIN b ON b.x_mm BETWEEN a.x_mm - 500 AND a.x_mm + 500 AND b.y_mm BETWEEN a.y_mm - 500 AND a.y_mm + 500 WHERE {_dist('a', 'b')} <= 250000),
ab AS (SELECT a_id, arg_min(b_id, (d2, b_id)) AS b_id, min(d2) AS d2 FROM p GROUP BY 1), ba AS (SELECT b_id, arg_min(a_id, (d2, a_id)) AS a_id FROM p GROUP BY 1) SELECT a_id, b_id, d2 FROM ab JOIN ba USING (a_id, b_id)""")
def mutual_nn(spark, d):
    return spatial.mutual_nearest(*_two(spark, d), 500)


_E3 = "e AS (SELECT vec_id AS point_id, CAST(round(embedding[1] * 10000) AS BIGINT) AS x_mm, CAST(round(embedding[2] * 10000) AS BIGINT) AS y_mm, CAST(round(embedding[3] * 10000) AS BIGINT) AS z_mm FROM embeddings)"


def _e3(spark, d):
    return src.load(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), *[F.round(F.col("embedding")[i].cast("double") * 10000).cast("long").alias(f"{k}_mm") for i, k in enumerate("xyz")])


@query("radius_neighbours", f"WITH {_E3.replace('embedding[1] * 10000', 'CAST(embedding[1] AS DOUBLE) * 10000').replace('embedding[2] * 10000', 'CAST(embedding[2] AS DOUBLE) * 10000').replace('embedding[3] * 10000', 'CAST(embedding[3] AS DOUBLE) * 10000')} SELECT a.point_id AS a_id, count(*) AS n FROM e a JOIN e b ON {_dist('a', 'b')} <= 640000 GROUP BY 1")
def radius_neighbours(spark, d):
    return spatial.neighbour_counts(_e3(spark, d), 800)


_E3D = "e AS (SELECT vec_id AS point_id, " + ", ".join(f"CAST(round(CAST(embedding[{i + 1}] AS DOUBLE) * 10000) AS BIGINT) AS {k}_mm" for i, k in enumerate("xyz")) + " FROM embeddings)"


@query("dbscan_core", f"WITH {_E3D} SELECT a.point_id AS a_id FROM e a JOIN e b ON {_dist('a', 'b')} <= 250000 GROUP BY 1 HAVING count(*) >= 4")
def dbscan_core(spark, d):
    return spatial.neighbour_counts(_e3(spark, d), 500).where("n >= 4").select("a_id")


@query("knn_outliers", f"""WITH {_E3D}, p AS (SELECT a.point_id AS a_id, {_dist('a', 'b')} AS d2, row_number() OVER (PARTITION BY a.point_id ORDER BY {_dist('a', 'b')}, b.point_id) AS k FROM e a JOIN e b ON a.point_id <> b.point_id),
m AS (SELECT a_id, avg(sqrt(d2)) AS mean_d FROM p WHERE k <= 5 GROUP BY 1), s AS (SELECT avg(mean_d) AS mu, stddev_samp(mean_d) AS sd FROM m) SELECT a_id, round(mean_d, 6) AS mean_d, mean_d > mu + 2 * sd AS outlier FROM m, s""")
def knn_outliers(spark, d):
    d5 = spatial.knn_distance(_e3(spark, d), 5, 800)
    stat = d5.agg(F.avg("mean_d").alias("mu"), F.stddev_samp("mean_d").alias("sd"))
    return filters.with_scalar(d5, stat).select("a_id", F.round("mean_d", 6).alias("mean_d"), (F.col("mean_d") > F.col("mu") + 2 * F.col("sd")).alias("outlier"))


_PIP = f"{P}, {src.room_edges_sql()}, inside AS (SELECT p.point_id, p.x_mm, p.y_mm, e.room_id FROM pts p JOIN edges e ON (e.y0 > p.y_mm) <> (e.y1 > p.y_mm) AND p.x_mm < (e.x1 - e.x0) * (p.y_mm - e.y0) / CAST(e.y1 - e.y0 AS DOUBLE) + e.x0 GROUP BY ALL HAVING count(*) % 2 = 1)"


@query("pip_rooms", f"WITH {_PIP} SELECT point_id, room_id FROM inside")
def pip_rooms(spark, d):
    return spatial.points_in_polygons(src.points(spark, d), src.room_edges(spark)).select("point_id", "room_id")


@query("match_quality", f"""WITH {_PIP}, w AS (SELECT x0 AS x, y0 AS y FROM walls UNION SELECT x1, y1 FROM walls), n AS (SELECT room_id, point_id, min((x_mm - x) * (x_mm - x) + (y_mm - y) * (y_mm - y)) AS d2 FROM inside, w GROUP BY 1, 2)
SELECT room_id, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(CASE WHEN d2 < 90000 THEN 1e0 ELSE 0e0 END), 6) END AS quality FROM n GROUP BY 1""")
def match_quality(spark, d):
    """Share of a room's points nearer than the tolerance to a wall end."""
    from .pipelines import match_quality as quality

    w = src.walls(spark)
    ends = w.select(F.col("x0").alias("x_mm"), F.col("y0").alias("y_mm")).union(w.select("x1", "y1")).distinct().withColumn("point_id", F.xxhash64("x_mm", "y_mm"))
    return quality(src.points(spark, d), src.room_edges(spark), ends, 300).select("room_id", "n", F.round("quality", 6).alias("quality"))


_PLANES = "pl(wall, pa, pb, pd, bx0, bx1, by0, by1) AS (SELECT wall, CAST(y1 - y0 AS DOUBLE), CAST(x0 - x1 AS DOUBLE), CAST((x1 - x0) * y0 - (y1 - y0) * x0 AS DOUBLE), least(x0, x1), greatest(x0, x1), least(y0, y1), greatest(y0, y1) FROM walls)"
_NEAR = f"{P}, {_PLANES}, near AS (SELECT p.point_id, pl.wall AS wall_id, (pa * x_mm + pb * y_mm + pd) / sqrt(pa * pa + pb * pb) AS dist FROM pts p, pl WHERE (pa * x_mm + pb * y_mm + pd) / sqrt(pa * pa + pb * pb) BETWEEN 20 AND 300 AND x_mm BETWEEN bx0 - 100 AND bx1 + 100 AND y_mm BETWEEN by0 - 100 AND by1 + 100)"


def _near(spark, d):
    planes = src.walls(spark).selectExpr("wall", "cast(y1 - y0 as double) as a", "cast(x0 - x1 as double) as b", "0D as c", "cast((x1 - x0) * y0 - (y1 - y0) * x0 as double) as d", "least(x0, x1) as bx0", "greatest(x0, x1) as bx1", "least(y0, y1) as by0", "greatest(y0, y1) as by1")
    return spatial.near_planes(src.points(spark, d), planes)


@query("fixture_candidates", f"WITH {_NEAR} SELECT point_id, wall_id, round(dist, 4) AS dist FROM near")
def fixture_candidates(spark, d):
    return _near(spark, d).select("point_id", "wall_id", F.round("dist", 4).alias("dist"))


@query("scalar_broadcast", f"WITH {P}, m AS (SELECT min(x_mm) AS x0, min(y_mm) AS y0 FROM pts) SELECT point_id, x_mm - x0 AS dx, y_mm - y0 AS dy FROM pts, m")
def scalar_broadcast(spark, d):
    p = src.points(spark, d)
    return filters.with_scalar(p, p.agg(F.min("x_mm").alias("x0"), F.min("y_mm").alias("y0"))).selectExpr("point_id", "x_mm - x0 as dx", "y_mm - y0 as dy")


@query("rotation_candidates", f"WITH {S} SELECT seg_id, CAST(k AS INT) AS k, CASE k WHEN 0 THEN x1 WHEN 1 THEN -y1 WHEN 2 THEN -x1 ELSE y1 END AS x, CASE k WHEN 0 THEN y1 WHEN 1 THEN x1 WHEN 2 THEN -y1 ELSE -x1 END AS y FROM segs, range(4) r(k)")
def rotation_candidates(spark, d):
    s = src.segments(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return s.selectExpr("seg_id", "k", "case k when 0 then x1 when 1 then -y1 when 2 then -x1 else y1 end as x", "case k when 0 then y1 when 1 then x1 when 2 then -y1 else -x1 end as y")


@query("artifact_flags", "SELECT c_custkey AS job_id, n.n_nationkey IS NOT NULL AS has_result, s.s_suppkey IS NOT NULL AS has_raster FROM customer LEFT JOIN nation n ON n_nationkey = c_nationkey LEFT JOIN supplier s ON s_suppkey = c_custkey")
def artifact_flags(spark, d):
    c = src.load(spark, d, "customer")
    n, s = src.load(spark, d, "nation"), src.load(spark, d, "supplier")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(s, c.c_custkey == s.s_suppkey, "left").select(F.col("c_custkey").alias("job_id"), F.col("n_nationkey").isNotNull().alias("has_result"), F.col("s_suppkey").isNotNull().alias("has_raster"))


@query("selected_lookup", "SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def selected_lookup(spark, d):
    return src.load(spark, d, "orders").join(src.load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"))


# rasters ---------------------------------------------------------------------------------------

_CELLS = f"{P}, cells AS (SELECT DISTINCT CAST(floor(x_mm / 250.0) AS BIGINT) AS col, CAST(floor(y_mm / 250.0) AS BIGINT) AS row FROM pts WHERE NOT is_floor)"
_PLUS = "(SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) k(dx, dy))"


def _cells(spark, d):
    return src.points(spark, d).where("not is_floor").select(F.floor(F.col("x_mm") / 250.0).alias("col"), F.floor(F.col("y_mm") / 250.0).alias("row")).distinct()


def _dil(name: str, source: str) -> str:
    return f"{name} AS (SELECT DISTINCT col + dx AS col, row + dy AS row FROM {source}, {_PLUS})"


def _ero(name: str, source: str) -> str:
    return f"{name} AS (SELECT c.col, c.row FROM {source} c, {_PLUS} k JOIN {source} o ON o.col = c.col + dx AND o.row = c.row + dy GROUP BY 1, 2 HAVING count(*) = 5)"


@query("morph_dilate", f"WITH {_CELLS}, {_dil('r', 'cells')} SELECT * FROM r")
def morph_dilate(spark, d):
    return raster.dilate(_cells(spark, d))


@query("morph_erode", f"WITH {_CELLS}, {_dil('g', 'cells')}, {_dil('g2', 'g')}, {_ero('r', 'g2')} SELECT * FROM r")
def morph_erode(spark, d):
    return raster.erode(raster.dilate(raster.dilate(_cells(spark, d))))


@query("morph_close", f"WITH {_CELLS}, {_dil('g', 'cells')}, {_ero('r', 'g')} SELECT * FROM r")
def morph_close(spark, d):
    return raster.close(_cells(spark, d))


@query("morph_open", f"WITH {_CELLS}, {_dil('g', 'cells')}, {_ero('e', 'g')}, {_ero('e2', 'e')}, {_dil('r', 'e2')} SELECT * FROM r")
def morph_open(spark, d):
    return raster.open_(raster.close(_cells(spark, d)))


_COMP = """lab AS (WITH RECURSIVE reach(col, row, c0, r0) AS (SELECT col, row, col, row FROM part_cells UNION SELECT c.col, c.row, r.c0, r.r0 FROM reach r JOIN part_cells c ON abs(c.col - r.col) <= 1 AND abs(c.row - r.row) <= 1) SELECT col, row, min((r0 + 1073741824) * 2147483648 + c0 + 1073741824) AS label FROM reach GROUP BY 1, 2)"""
_PART = f"{P}, part_cells AS (SELECT DISTINCT CAST(floor(x_mm / 500.0) AS BIGINT) AS col, CAST(floor(y_mm / 500.0) AS BIGINT) AS row FROM pts WHERE NOT is_floor)"


def _part(spark, d):
    return src.points(spark, d).where("not is_floor").select(F.floor(F.col("x_mm") / 500.0).alias("col"), F.floor(F.col("y_mm") / 500.0).alias("row")).distinct()


@query("components_labels", f"WITH {_PART}, {_COMP} SELECT col, row, label FROM lab")
def components_labels(spark, d):
    return raster.labelled(_part(spark, d))


@query("largest_component", f"WITH {_PART}, {_COMP}, t AS (SELECT label FROM lab GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) SELECT col, row FROM lab JOIN t USING (label)")
def largest_component(spark, d):
    return raster.largest_component(_part(spark, d))


_WCELLS = f"{P}, cells AS (SELECT DISTINCT CAST(floor(x_mm / 1000.0) AS BIGINT) AS col, CAST(floor(y_mm / 1000.0) AS BIGINT) AS row FROM pts WHERE NOT is_floor)"


def _wcells(spark, d):
    return src.points(spark, d).where("not is_floor").select(F.floor(F.col("x_mm") / 1000.0).alias("col"), F.floor(F.col("y_mm") / 1000.0).alias("row")).distinct()


@query("hole_fill", f"""WITH RECURSIVE {_WCELLS}, box AS (SELECT min(col) - 1 c0, max(col) + 1 c1, min(row) - 1 r0, max(row) + 1 r1 FROM cells), grid AS (SELECT c AS col, r AS row FROM box, range(-5, 100) a(c), range(-5, 100) b(r) WHERE c BETWEEN c0 AND c1 AND r BETWEEN r0 AND r1),
back AS (SELECT * FROM grid EXCEPT SELECT * FROM cells), outside(col, row) AS (SELECT c0, r0 FROM box UNION SELECT b.col, b.row FROM outside o JOIN back b ON abs(b.col - o.col) + abs(b.row - o.row) = 1)
SELECT col, row FROM cells UNION SELECT col, row FROM (SELECT * FROM back EXCEPT SELECT * FROM outside)""")
def hole_fill(spark, d):
    return raster.fill_holes(_wcells(spark, d))


@query("cells_anti_walls", f"WITH {P}, c AS (SELECT is_floor, CAST(floor(x_mm / 500.0) AS BIGINT) AS col, CAST(floor(y_mm / 500.0) AS BIGINT) AS row FROM pts) SELECT col, row FROM c WHERE is_floor EXCEPT SELECT col, row FROM c WHERE NOT is_floor")
def cells_anti_walls(spark, d):
    p = src.points(spark, d).select("is_floor", F.floor(F.col("x_mm") / 500.0).alias("col"), F.floor(F.col("y_mm") / 500.0).alias("row"))
    wall = p.where("not is_floor").select("col", "row").distinct()
    return p.where("is_floor").select("col", "row").distinct().join(wall, ["col", "row"], "left_anti")


@query("gaussian_blur", f"WITH {_CELLS}, k AS (SELECT * FROM (VALUES " + ", ".join(f"({dx}, {dy}, {w!r}e0)" for (dx, dy), w in raster.gaussian(3, 0.8).items()) + ") k(dx, dy, w)) SELECT col + dx AS col, row + dy AS row, round(sum(w), 9) AS v FROM cells, k GROUP BY 1, 2")
def gaussian_blur(spark, d):
    return raster.blur(_cells(spark, d), raster.gaussian(3, 0.8)).select("col", "row", F.round("v", 9).alias("v"))


@query("hough_votes", f"WITH {_CELLS} SELECT CAST(t AS INT) AS theta, CAST(floor(round(col * cos(radians(t * 5e0)) + row * sin(radians(t * 5e0)), 6) + 0.5) AS BIGINT) AS rho, count(*) AS votes FROM cells, range(36) r(t) GROUP BY 1, 2")
def hough_votes(spark, d):
    return raster.hough_votes(_cells(spark, d))


@query("slice_flip", f"WITH {_CELLS}, h AS (SELECT max(row) + 1 AS height FROM cells) SELECT col, height - 1 - row AS row FROM cells, h")
def slice_flip(spark, d):
    c = _cells(spark, d)
    return filters.with_scalar(c, c.agg((F.max("row") + 1).alias("height"))).select("col", (F.col("height") - 1 - F.col("row")).alias("row"))


# segments --------------------------------------------------------------------------------------

_LEN = "sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))"
_SMALL = f"{S}, ss AS (SELECT *, {_LEN} AS len, round(((degrees(atan2(CAST(y2 - y1 AS DOUBLE), CAST(x2 - x1 AS DOUBLE))) % 180.0) + 180.0) % 180.0, 6) AS ang, CAST(x2 - x1 AS DOUBLE) / {_LEN} AS ux, CAST(y2 - y1 AS DOUBLE) / {_LEN} AS uy FROM segs WHERE {_LEN} >= 500)"
_PAIRS = """pairs AS (SELECT a.seg_id AS a_id, b.seg_id AS b_id FROM ss a JOIN ss b ON a.seg_id // 500 = b.seg_id // 500 AND a.seg_id < b.seg_id AND least(abs(a.ang - b.ang), 180 - abs(a.ang - b.ang)) <= 3
AND round(abs(((b.x1 + b.x2) / 2e0 - (a.x1 + a.x2) / 2e0) * -a.uy + ((b.y1 + b.y2) / 2e0 - (a.y1 + a.y2) / 2e0) * a.ux), 6) <= 50
AND round(greatest(least((b.x1 - a.x1) * a.ux + (b.y1 - a.y1) * a.uy, (b.x2 - a.x1) * a.ux + (b.y2 - a.y1) * a.uy) - ((a.x2 - a.x1) * a.ux + (a.y2 - a.y1) * a.uy), -greatest((b.x1 - a.x1) * a.ux + (b.y1 - a.y1) * a.uy, (b.x2 - a.x1) * a.ux + (b.y2 - a.y1) * a.uy), 0), 6) <= 300)"""


def _small(spark, d):
    return filters.drop_short(src.segments(spark, d), 500)


@query("segment_pairs", f"WITH {_SMALL}, {_PAIRS} SELECT a_id, b_id FROM pairs")
def segment_pairs(spark, d):
    return seg.collinear_pairs(_small(spark, d))


_CROSS = """x AS (SELECT a.seg_id AS a_id, b.seg_id AS b_id, CAST(a.x1 AS DOUBLE) AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, CAST((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS DOUBLE) AS den
FROM segs a JOIN segs b ON a.seg_id // 500 = b.seg_id // 500 AND a.seg_id < b.seg_id), t AS (SELECT *, ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / den AS ta, ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / den AS tb FROM x WHERE den <> 0), met AS (SELECT * FROM t WHERE ta BETWEEN 0 AND 1 AND tb BETWEEN 0 AND 1)"""


@query("segment_crossings", f"WITH {S}, {_CROSS} SELECT a_id, b_id, round(ax1 + (ax2 - ax1) * ta, 4) AS x, round(ay1 + (ay2 - ay1) * ta, 4) AS y FROM met")
def segment_crossings(spark, d):
    return seg.crossings(src.segments(spark, d)).select("a_id", "b_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("segments_noded", f"WITH {S}, {_CROSS}, cuts AS (SELECT a_id AS seg_id, ta AS t FROM met UNION SELECT b_id, tb FROM met) SELECT s.seg_id, 1 + count(t) FILTER (t > 0 AND t < 1) AS parts, round(sqrt(CAST((x2 - x1) ** 2 + (y2 - y1) ** 2 AS DOUBLE)), 3) AS total FROM segs s LEFT JOIN cuts USING (seg_id) GROUP BY s.seg_id, x1, y1, x2, y2")
def segments_noded(spark, d):
    n = seg.noded(src.segments(spark, d)).withColumn("len", filters.length_mm())
    return n.groupBy("seg_id").agg(F.count("*").alias("parts"), F.round(F.sum("len"), 3).alias("total"))


@query("segments_merged", f"""WITH RECURSIVE {_SMALL}, {_PAIRS}, und AS (SELECT a_id AS a, b_id AS b FROM pairs UNION SELECT b_id, a_id FROM pairs), reach(s, c) AS (SELECT seg_id, seg_id FROM ss UNION SELECT u.b, r.c FROM reach r JOIN und u ON u.a = r.s),
comp AS (SELECT s AS seg_id, min(c) AS c FROM reach GROUP BY 1) SELECT c AS seg_id, count(*) AS members, round(sum(len), 3) AS total FROM comp JOIN ss USING (seg_id) GROUP BY 1""")
def segments_merged(spark, d):
    s = _small(spark, d)
    return seg.merged(s, seg.collinear_pairs(s)).select("seg_id", "members", F.round("total", 3).alias("total"))


@query("manhattan_snap", f"""WITH {S}, a AS (SELECT *, {_LEN} AS len, ((degrees(atan2(CAST(y2 - y1 AS DOUBLE), CAST(x2 - x1 AS DOUBLE))) % 180.0) + 180.0) % 180.0 AS ang FROM segs), pk AS (SELECT (floor(round(ang, 6) / 2) + 0.5) * 2 AS dom FROM a GROUP BY floor(round(ang, 6) / 2) ORDER BY round(sum(len), 3) DESC, floor(round(ang, 6) / 2) LIMIT 1),
m AS (SELECT a.*, CASE WHEN least(abs(ang - dom), 180 - abs(ang - dom)) <= 12 THEN dom WHEN least(abs(ang - (dom + 90) % 180), 180 - abs(ang - (dom + 90) % 180)) <= 12 THEN (dom + 90) % 180 END AS t FROM a, pk)
SELECT seg_id, round((x1 + x2) / 2e0 - cos(radians(t)) * len / 2, 3) AS x1, round((y1 + y2) / 2e0 - sin(radians(t)) * len / 2, 3) AS y1, round((x1 + x2) / 2e0 + cos(radians(t)) * len / 2, 3) AS x2, round((y1 + y2) / 2e0 + sin(radians(t)) * len / 2, 3) AS y2 FROM m WHERE t IS NOT NULL""")
def manhattan_snap(spark, d):
    return seg.manhattan_snap(src.segments(spark, d)).select("seg_id", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("sample_segments", f"WITH {S}, n AS (SELECT *, CASE WHEN {_LEN} < 1e-9 THEN 0 ELSE greatest(2, CAST(floor({_LEN} / 50) AS INT)) END AS k FROM segs) SELECT seg_id, CAST(i AS INT) AS i, round(x1 + (x2 - x1) * (CASE WHEN k = 0 THEN 0e0 ELSE i / CAST(k AS DOUBLE) END), 4) AS x, round(y1 + (y2 - y1) * (CASE WHEN k = 0 THEN 0e0 ELSE i / CAST(k AS DOUBLE) END), 4) AS y FROM (SELECT *, unnest(range(k + 1)) AS i FROM n)")
def sample_segments(spark, d):
    return seg.sampled(src.segments(spark, d)).select("seg_id", "i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("geojson_plan", f"""WITH {S} SELECT seg_id, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[[' || x1 || ',' || y1 || '],[' || x2 || ',' || y2 || ']]}},"properties":{{"id":' || seg_id || '}}}}' AS feature FROM segs""")
def geojson_plan(spark, d):
    from ..sources.sinks import line_features

    return line_features(src.segments(spark, d))


@query("geojson_vertices", f"WITH {S} SELECT seg_id, CAST(0 AS INT) AS k, x1 AS x, y1 AS y FROM segs UNION ALL SELECT seg_id, 1, x2, y2 FROM segs")
def geojson_vertices(spark, d):
    s = src.segments(spark, d).select("seg_id", F.posexplode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("k", "p"))
    return s.select("seg_id", "k", "p.x", "p.y")
