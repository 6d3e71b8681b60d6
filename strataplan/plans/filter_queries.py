"""Filters and predicates over the synthetic building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as op
from ..sources import building as src
from .registry import query

P, S = src.POINTS_SQL, src.SEGMENTS_SQL
_XYZ = "point_id, x_mm, y_mm, z_mm"
_PICK = ["point_id", "x_mm", "y_mm", "z_mm"]


@query("class_mask", f"""WITH {P}, s AS (SELECT avg(CASE WHEN classification = 6 THEN 1.0 ELSE 0.0 END) AS share FROM pts)
SELECT classification, count(*) AS n, CAST(sum(z_mm) AS BIGINT) AS sum_z FROM pts, s
WHERE classification NOT IN (7, 18) AND (CASE WHEN share >= 0.1 THEN classification = 6 WHEN share >= 0.02 THEN classification IN (0, 1, 6) ELSE TRUE END) GROUP BY 1""")
def class_mask(spark, d):
    return op.class_mask(src.points(spark, d)).groupBy("classification").agg(F.count("*").alias("n"), F.sum("z_mm").alias("sum_z"))


@query("class_mask_by_scan", f"""WITH {P}, q AS (SELECT scan_id, CASE WHEN scan_id % 3 = 1 THEN 0 WHEN scan_id % 3 = 2 AND classification = 6 AND point_id % 5 > 1 THEN 2 ELSE classification END AS classification FROM pts),
s AS (SELECT scan_id, avg(CASE WHEN classification = 6 THEN 1.0 ELSE 0.0 END) AS share FROM q GROUP BY 1)
SELECT scan_id, classification, count(*) AS n FROM q JOIN s USING (scan_id) WHERE classification NOT IN (7, 18) AND (CASE WHEN share >= 0.1 THEN classification = 6 WHEN share >= 0.02 THEN classification IN (0, 1, 6) ELSE TRUE END) GROUP BY 1, 2""")
def class_mask_by_scan(spark, d):
    """Each scan by its own share of class 6: some were never classified, some in part."""
    part = F.when(F.col("scan_id") % 3 == 1, 0).when((F.col("scan_id") % 3 == 2) & (F.col("classification") == 6) & (F.col("point_id") % 5 > 1), 2).otherwise(F.col("classification"))
    return op.class_mask(src.points(spark, d).withColumn("classification", part), by="scan_id").groupBy("scan_id", "classification").agg(F.count("*").alias("n"))


@query("class_mask_weak", f"WITH {P} SELECT classification, count(*) AS n FROM pts WHERE classification IN (0, 1, 6) GROUP BY 1")
def class_mask_weak(spark, d):
    """The share of class 6 lies between the two limits."""
    return op.class_mask(src.points(spark, d), strong=0.5).groupBy("classification").agg(F.count("*").alias("n"))


@query("wall_band", f"WITH {P} SELECT {_XYZ} FROM pts WHERE z_mm BETWEEN 750 AND 1800")
def wall_band(spark, d):
    return op.band(src.points(spark, d), 750, 1800, at_least=100).select(*_PICK)


@query("viewer_slice_fallback", f"""WITH {P}, n AS (SELECT count(*) FILTER (z_mm > 200 AND z_mm < 2500) AS k FROM pts)
SELECT {_XYZ} FROM pts, n WHERE k < 1000 OR (z_mm > 200 AND z_mm < 2500)""")
def viewer_slice(spark, d):
    return op.band_or_all(src.points(spark, d), 200, 2500, 1000).select(*_PICK)


@query("viewer_slice_unfiltered", f"""WITH {P}, n AS (SELECT count(*) FILTER (z_mm > 2890 AND z_mm < 2900) AS k FROM pts)
SELECT scan_id, count(*) AS n FROM pts, n WHERE k < 1000 OR (z_mm > 2890 AND z_mm < 2900) GROUP BY 1""")
def viewer_slice_unfiltered(spark, d):
    return op.band_or_all(src.points(spark, d), 2890, 2900, 1000).groupBy("scan_id").agg(F.count("*").alias("n"))


_DENSE = """z AS (SELECT min(z_mm) AS z0, max(z_mm) AS z1 FROM pts),
w AS (SELECT z0 + 100 * i AS low FROM z, range(0, 1000) r(i) WHERE z0 + 100 * i <= greatest(z0, z1 - 1000)),
dense AS (SELECT low, count(*) AS n FROM w JOIN pts ON z_mm >= low AND z_mm < low + 1000 GROUP BY low ORDER BY n DESC, low LIMIT 1)"""


@query("dense_slice", f"WITH {P}, {_DENSE} SELECT low, n FROM dense")
def dense_slice(spark, d):
    return op.densest_window(src.points(spark, d))


@query("chest_slice", f"WITH {P} SELECT {_XYZ} FROM pts WHERE z_mm > 1000 AND z_mm < 2000")
def chest_slice(spark, d):
    return op.chest_slice(src.points(spark, d), 1000, 2000, 500, 0.01, 50).select(*_PICK)


@query("chest_slice_dense_fallback", f"WITH {P}, {_DENSE} SELECT {_XYZ} FROM pts, dense WHERE z_mm >= low AND z_mm < low + 1000")
def chest_slice_dense(spark, d):
    return op.chest_slice(src.points(spark, d), 5000, 6000, 500, 0.01, 50).select(*_PICK)


@query("room_band_fallback", f"WITH {P}, {_DENSE} SELECT scan_id, count(*) AS n FROM pts, dense WHERE z_mm >= low AND z_mm < low + 1000 GROUP BY 1")
def room_band(spark, d):
    return op.chest_slice(src.points(spark, d), 5000, 6000, 100, 0.01, 100).groupBy("scan_id").agg(F.count("*").alias("n"))


@query("scan_chest_bands", f"""WITH {P}, b AS (SELECT * FROM pts WHERE z_mm > 1000 AND z_mm < 2000), k AS (SELECT scan_id FROM b GROUP BY 1 HAVING count(*) >= 50)
SELECT scan_id, count(*) AS n, min(z_mm) AS lo, max(z_mm) AS hi FROM b JOIN k USING (scan_id) GROUP BY 1""")
def scan_bands(spark, d):
    return op.group_bands(src.points(spark, d), 1000, 2000, 50).groupBy("scan_id").agg(F.count("*").alias("n"), F.min("z_mm").alias("lo"), F.max("z_mm").alias("hi"))


@query("slab_filter", f"WITH {P} SELECT {_XYZ} FROM pts WHERE z_mm BETWEEN 1400 - 50 AND 1400 + 50")
def slab(spark, d):
    return op.band(src.points(spark, d), 1350, 1450, at_least=1).select(*_PICK)


_LEN = "sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE))"
_ANG = "((degrees(atan2(CAST(y2 - y1 AS DOUBLE), CAST(x2 - x1 AS DOUBLE))) % 180.0) + 180.0) % 180.0"


@query("drop_short", f"WITH {S} SELECT * FROM segs WHERE {_LEN} >= 500")
def drop_short(spark, d):
    return op.drop_short(src.segments(spark, d), 500)


@query("manhattan_filter", f"""WITH {S}, a AS (SELECT *, {_ANG} AS ang FROM segs), pk AS (SELECT (floor(round(ang, 6) / 2) + 0.5) * 2 AS dom FROM a GROUP BY floor(round(ang, 6) / 2) ORDER BY count(*) DESC, floor(round(ang, 6) / 2) LIMIT 1),
m AS (SELECT a.*, least(abs(ang - dom), 180 - abs(ang - dom)) <= 15 OR least(abs(ang - (dom + 90) % 180), 180 - abs(ang - (dom + 90) % 180)) <= 15 AS near FROM a, pk)
SELECT seg_id, x1, y1, x2, y2 FROM m WHERE near OR NOT (SELECT bool_or(near) FROM m)""")
def manhattan(spark, d):
    return op.manhattan_filter(src.segments(spark, d))


@query("thin_artefacts", f"""WITH {P}, c AS (SELECT wall, scan_id, count(*) AS n, max(x_mm) - min(x_mm) AS dx, max(y_mm) - min(y_mm) AS dy, max(z_mm) - min(z_mm) AS dz FROM pts GROUP BY 1, 2)
SELECT * FROM c WHERE n >= 50 AND NOT (dx < 50 AND dz < 50 AND dy < 30)""")
def thin_artefacts(spark, d):
    c = src.points(spark, d).groupBy("wall", "scan_id").agg(F.count("*").alias("n"), *[(F.max(f"{k}_mm") - F.min(f"{k}_mm")).alias(f"d{k}") for k in "xyz"])
    return c.where("n >= 50 and not (dx < 50 and dz < 50 and dy < 30)")


@query("plane_orientation", """WITH pl AS (SELECT p_partkey AS id, CAST(p_partkey % 11 - 5 AS DOUBLE) AS a, CAST(p_partkey % 7 - 3 AS DOUBLE) AS b, CAST(p_size AS DOUBLE) AS c FROM part),
u AS (SELECT *, abs(c) / sqrt(a * a + b * b + c * c) AS nz, abs(b) / sqrt(a * a + b * b + c * c) AS ny FROM pl)
SELECT id, CASE WHEN nz > 0.96 THEN 2 WHEN ny > 0.96 THEN 1 ELSE 0 END AS axis_idx, nz <= 0.30 AS is_wall FROM u""")
def plane_orientation(spark, d):
    u = src.load(spark, d, "part").selectExpr("p_partkey as id", "cast(p_partkey % 11 - 5 as double) as a", "cast(p_partkey % 7 - 3 as double) as b", "cast(p_size as double) as c").selectExpr("id", "abs(c) / sqrt(a * a + b * b + c * c) as nz", "abs(b) / sqrt(a * a + b * b + c * c) as ny")
    return u.select("id", F.when(F.col("nz") > 0.96, 2).when(F.col("ny") > 0.96, 1).otherwise(0).alias("axis_idx"), (F.col("nz") <= 0.30).alias("is_wall"))


@query("area_floors", "SELECT p_partkey AS id, 0.3 * p_size AS area, 0.3 * p_size >= 4 AS is_room, 0.3 * p_size >= greatest(2.0, 0.005 * 500) AS is_face, 0.3 * p_size > 0.5 AS is_polyline FROM part WHERE 0.3 * p_size >= 0.1".replace("0.3 * p_size", "CAST(p_size AS DOUBLE) * 0.3"))
def area_floors(spark, d):
    area = F.col("p_size").cast("double") * F.lit(0.3)
    rooms = src.load(spark, d, "part").select(F.col("p_partkey").alias("id"), area.alias("area")).where("area >= 0.1D")
    return rooms.select("id", "area", (F.col("area") >= 4.0).alias("is_room"), (F.col("area") >= 2.5).alias("is_face"), (F.col("area") > 0.5).alias("is_polyline"))


@query("expired_jobs", "SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') < '1996-01-01T00:00:00'")
def expired_jobs(spark, d):
    jobs = src.load(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    return jobs.where(F.col("created_at") < "1996-01-01T00:00:00")


@query("unknown_layers", "SELECT p_type AS class, count(*) AS dropped FROM part WHERE p_type NOT IN ('STANDARD', 'ECONOMY') GROUP BY 1")
def unknown_layers(spark, d):
    layers = spark.createDataFrame([("STANDARD",), ("ECONOMY",)], "class string")
    parts = src.load(spark, d, "part").select(F.col("p_type").alias("class"))
    return parts.join(F.broadcast(layers), "class", "left_anti").groupBy("class").agg(F.count("*").alias("dropped"))
