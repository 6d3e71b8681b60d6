"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, filters, scalars as op
from ..sources import building as src
from .registry import query

P, S = src.POINTS_SQL, src.SEGMENTS_SQL


@query("rgb_scale", f"""WITH {P}, t AS (SELECT greatest(max(r), max(g), max(b)) AS top FROM pts), k AS (SELECT CASE WHEN top <= 1 THEN 1.0 WHEN top <= 255 THEN 255.0 ELSE 65535.0 END AS s FROM t)
SELECT point_id, CAST(r AS DOUBLE) / s AS r, CAST(g AS DOUBLE) / s AS g, CAST(b AS DOUBLE) / s AS b FROM pts, k""".replace("1.0 WHEN", "CAST(1 AS DOUBLE) WHEN").replace("255.0 ELSE 65535.0", "CAST(255 AS DOUBLE) ELSE CAST(65535 AS DOUBLE)"))
def rgb_scale(spark, d):
    return op.normalised_rgb(src.points(spark, d)).select("point_id", "r", "g", "b")


_LEVEL = f"""WITH {P}, q AS (SELECT quantile_cont(CAST(intensity AS DOUBLE), 0.02) AS lo, quantile_cont(CAST(intensity AS DOUBLE), 0.98) AS hi FROM pts),
v AS (SELECT point_id, (least(greatest(CAST(intensity AS DOUBLE), lo), hi) - lo) / greatest(hi - lo, 1.0) AS level FROM pts, q)"""


@query("intensity_p2_p98", f"{_LEVEL} SELECT point_id, round(level, 9) AS level FROM v")
def intensity(spark, d):
    return op.normalised_intensity(src.points(spark, d)).select("point_id", F.round("level", 9).alias("level"))


@query("intensity_colours", f"{_LEVEL} SELECT point_id, round(level * 0.4, 9) AS r, round(level * 0.85, 9) AS g, round(least(greatest(level * 0.45 + 0.55, 0.0), 1.0), 9) AS b FROM v")
def intensity_colours(spark, d):
    out = op.normalised_intensity(src.points(spark, d))
    r, g, b = op.intensity_colours(F.col("level"))
    return out.select("point_id", F.round(r, 9).alias("r"), F.round(g, 9).alias("g"), F.round(b, 9).alias("b"))


M = op.rotation_matrix(30.0, tx=1500.0, ty=-700.0)


@query("transform_points", f"""WITH {P} SELECT point_id, round({M[0][0]!r} * x_mm + {M[0][1]!r} * y_mm + {M[0][3]!r}, 3) AS x, round({M[1][0]!r} * x_mm + {M[1][1]!r} * y_mm + {M[1][3]!r}, 3) AS y, CAST(z_mm AS DOUBLE) AS z FROM pts""")
def transform_points(spark, d):
    x, y, z = op.transform(M, *[F.col(f"{k}_mm").cast("double") for k in "xyz"])
    return src.points(spark, d).select("point_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), z.alias("z"))


@query("centroid_offset", f"WITH {P}, c AS (SELECT avg(x_mm) AS cx, avg(y_mm) AS cy, avg(z_mm) AS cz FROM pts) SELECT point_id, round(x_mm - cx, 6) AS x, round(y_mm - cy, 6) AS y, round(z_mm - cz, 6) AS z FROM pts, c")
def centroid_offset(spark, d):
    return op.centred(src.points(spark, d)).select("point_id", *[F.round(k, 6).alias(k) for k in "xyz"])


@query("plane_projection", f"WITH {P} SELECT point_id, axis_idx, x_mm AS u, CASE WHEN axis_idx = 2 THEN y_mm ELSE z_mm END AS v FROM pts, (VALUES (1), (2)) a(axis_idx)")
def plane_projection(spark, d):
    axes = F.explode(F.array(F.lit(1), F.lit(2))).alias("axis_idx")
    return src.points(spark, d).select("point_id", "x_mm", "y_mm", "z_mm", axes).select("point_id", "axis_idx", F.col("x_mm").alias("u"), F.when(F.col("axis_idx") == 2, F.col("y_mm")).otherwise(F.col("z_mm")).alias("v"))


@query("grid_index", f"""WITH {P} SELECT point_id, CAST(least(greatest(floor((x_mm - 500) / 80.0), 0), 4095) AS BIGINT) AS plan_col, CAST(least(greatest(trunc((x_mm - 500) / 150.0), 0), 4999) AS BIGINT) AS room_col,
CAST(least(greatest(floor((x_mm - 500) / 10.0), 0), 999) AS BIGINT) AS slice_col FROM pts""")
def grid_index(spark, d):
    x = F.col("x_mm")
    return src.points(spark, d).select("point_id", op.grid_index(x, 500, 80, 4095).alias("plan_col"), op.grid_index(x, 500, 150, 4999, truncating=True).alias("room_col"), op.grid_index(x, 500, 10, 999).alias("slice_col"))


@query("world_pixel", f"""WITH {P}, c AS (SELECT point_id, CAST(floor((x_mm + 40) / 10.0) AS BIGINT) AS col FROM pts)
SELECT point_id, col, (col + 0.5) * 10 - 40 AS x_centre, CAST(col * 10 - 40 AS DOUBLE) AS x_edge FROM c""".replace("(col + 0.5) * 10 - 40", "CAST((col + 0.5) * 10 - 40 AS DOUBLE)"))
def world_pixel(spark, d):
    c = src.points(spark, d).select("point_id", op.to_pixel(F.col("x_mm"), -40, 10).alias("col"))
    return c.select("point_id", "col", op.to_world(F.col("col"), -40, 10, True).alias("x_centre"), op.to_world(F.col("col"), -40, 10, False).alias("x_edge"))


@query("segment_pixels", f"WITH {S}, p AS (SELECT seg_id, CAST(trunc(x1 / 20.0) AS INT) AS px1, CAST(trunc(y1 / 20.0) AS INT) AS py1, CAST(trunc(x2 / 20.0) AS INT) AS px2, CAST(trunc(y2 / 20.0) AS INT) AS py2 FROM segs) SELECT *, px1 * 20 AS wx1, py1 * 20 AS wy1, px2 * 20 AS wx2, py2 * 20 AS wy2 FROM p")
def segment_pixels(spark, d):
    ends = ["x1", "y1", "x2", "y2"]
    px = src.segments(spark, d).select("seg_id", *[(F.col(c) / 20.0).cast("int").alias(f"p{c}") for c in ends])
    return px.select("*", *[(F.col(f"p{c}") * 20).alias(f"w{c}") for c in ends])


@query("axis_rotation", f"""WITH {S}, a AS (SELECT seg_id, atan2(CAST(y2 - y1 AS DOUBLE), CAST(x2 - x1 AS DOUBLE)) AS t FROM segs) SELECT seg_id, round(cos(-t), 6) + 0 AS m00, round(-sin(-t), 6) + 0 AS m01, round(sin(-t), 6) + 0 AS m10, round(cos(-t), 6) + 0 AS m11 FROM a""")
def axis_rotation(spark, d):
    t = F.atan2((F.col("y2") - F.col("y1")).cast("double"), (F.col("x2") - F.col("x1")).cast("double"))
    z = lambda c: (F.round(c, 6) + 0.0)  # noqa: E731  no negative zero
    return src.segments(spark, d).select("seg_id", t.alias("t")).select("seg_id", z(F.cos(-F.col("t"))).alias("m00"), z(-F.sin(-F.col("t"))).alias("m01"), z(F.sin(-F.col("t"))).alias("m10"), z(F.cos(-F.col("t"))).alias("m11"))


_ANG = "((degrees(atan2(CAST(y2 - y1 AS DOUBLE), CAST(x2 - x1 AS DOUBLE))) % 180.0) + 180.0) % 180.0"


@query("segment_angles", f"WITH {S}, a AS (SELECT seg_id, {_ANG} AS ang FROM segs) SELECT seg_id, round(ang, 6) AS angle, round(least(abs(ang - 175), 180 - abs(ang - 175)), 6) AS to_175 FROM a")
def segment_angles(spark, d):
    a = filters.angle_deg()
    return src.segments(spark, d).select("seg_id", F.round(a, 6).alias("angle"), F.round(filters.circular_diff(a, F.lit(175.0)), 6).alias("to_175"))


@query("plane_distance", f"WITH {P}, n AS (SELECT sqrt(3.0 * 3.0 + 4.0 * 4.0) AS len) SELECT point_id, round((3 * x_mm + 4 * y_mm - 25000) / len, 4) AS dist FROM pts, n")
def plane_distance(spark, d):
    return src.points(spark, d).select("point_id", F.round((F.col("x_mm") * 3 + F.col("y_mm") * 4 - 25000) / F.lit(5.0), 4).alias("dist"))


_JOB = "SELECT o_orderkey AS job_id, (o_custkey % 70) / 1000.0 AS rmse, (o_orderkey % 120) / 100.0 AS inlier, CAST(o_orderkey % 20 AS DOUBLE) AS support FROM orders"


@query("confidence_score", f"""WITH j AS (SELECT job_id, CAST(rmse AS DOUBLE) rmse, CAST(inlier AS DOUBLE) inlier, support FROM ({_JOB})), c AS (SELECT job_id, greatest(1 - rmse * 1000.0 / 50.0, 0) * 0.5 + least(inlier, 1) * 0.3 + least(support / 12, 1) * 0.2 AS s FROM j)
SELECT job_id, round(s, 6) AS score, CAST(round_even(round(least(greatest(s * 100, 0), 100), 6), 0) AS BIGINT) AS pct, CASE WHEN round_even(round(least(greatest(s * 100, 0), 100), 6), 0) >= 90 THEN 'high' WHEN round_even(round(least(greatest(s * 100, 0), 100), 6), 0) >= 70 THEN 'medium' ELSE 'low' END AS label FROM c""")
def confidence_score(spark, d):
    j = src.load(spark, d, "orders").selectExpr("o_orderkey as job_id", "(o_custkey % 70) / 1000D as rmse", "(o_orderkey % 120) / 100D as inlier", "cast(o_orderkey % 20 as double) as support")
    s = op.alignment_confidence(F.col("rmse"), F.col("inlier"), F.col("support"))
    pct = F.bround(F.round(F.least(F.greatest(s * 100.0, F.lit(0.0)), F.lit(100.0)), 6), 0).cast("long")
    return j.select("job_id", F.round(s, 6).alias("score"), pct.alias("pct"), op.confidence_label(pct).alias("label"))


def _category_sql(column: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in op.CATEGORIES) + " ELSE 'unknown' END"


@query("categorize_labels", f"WITH l AS (SELECT doc_id, text AS label FROM documents) SELECT doc_id, {_category_sql('label')} AS category FROM l")
def categorize_labels(spark, d):
    return src.load(spark, d, "documents").select("doc_id", op.category(F.col("text")).alias("category"))


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


@query("classify_rooms", f"""WITH r AS (SELECT p_partkey AS id, 2.5e0 * p_size AS a, (p_partkey % 100) / 100e0 AS e, 0.4e0 + (p_partkey % 60) / 100e0 AS s FROM part),
c AS (SELECT *, CASE WHEN e > 0.85e0 AND a < 40 THEN 1 WHEN a < 7 THEN 2 WHEN a > 80 AND s > 0.85e0 THEN 3 WHEN a > 40 THEN 4 WHEN s < 0.7e0 THEN 5 ELSE 6 END AS k FROM r)
SELECT id, CASE k WHEN 1 THEN 'Hallway / Corridor' WHEN 2 THEN 'Bathroom / Storage' WHEN 3 THEN 'Open Plan / Lobby' WHEN 4 THEN 'Conference Room' WHEN 5 THEN 'Irregular Space' ELSE 'Office / Meeting' END AS label,
CASE k WHEN 1 THEN 'hallway' WHEN 2 THEN 'bathroom' WHEN 3 THEN 'common' WHEN 5 THEN 'unknown' ELSE 'office' END AS category,
round({_clamp(f'''CASE k WHEN 1 THEN 0.55e0 + {_clamp('(e - 0.85e0) / 0.12e0')} * 0.38e0 + {_clamp('1 - a / 45e0')} * 0.07e0 WHEN 2 THEN 0.55e0 + (7 - a) / 14 WHEN 3 THEN 0.6e0 + {_clamp('(a - 80) / 120')} * 0.25e0 + {_clamp('(s - 0.85e0) / 0.14e0')} * 0.15e0
 WHEN 4 THEN 0.55e0 + (a - 40) / 100 WHEN 5 THEN 0.5e0 + (0.7e0 - s) / 0.6e0 ELSE 0.5e0 + greatest(1 - abs(a - 18) / 25, 0) * 0.25e0 + {_clamp('(s - 0.6e0) / 0.35e0')} * 0.15e0 END''')}, 6) AS confidence FROM c""")
def classify_rooms(spark, d):
    r = src.load(spark, d, "part").selectExpr("p_partkey as id", "2.5D * p_size as a", "(p_partkey % 100) / 100D as e", "0.4D + (p_partkey % 60) / 100D as s")
    return r.select("id", classify.classify_room(F.col("a"), F.col("e"), F.col("s")).alias("c")).select("id", "c.label", "c.category", F.round("c.confidence", 6).alias("confidence"))


@query("sequence_ids", "SELECT o_orderkey AS job_id, o_custkey % 6 AS scan_id, 's' || lpad(CAST(o_custkey % 6 AS VARCHAR), 2, '0') || '-wall-' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey % 6 ORDER BY o_orderkey) AS VARCHAR), 6, '0') AS wall_id FROM orders")
def sequence_ids(spark, d):
    from ..operators.filters import label, numbered

    o = src.load(spark, d, "orders").selectExpr("o_orderkey as job_id", "o_custkey % 6 as scan_id")
    n = numbered(o, F.col("scan_id"), [F.col("job_id")], "n")
    return n.select("job_id", "scan_id", F.concat(label("s", "scan_id", 2), label("-wall-", "n", 6)).alias("wall_id"))


@query("room_hash_ids", "SELECT p_partkey AS id, 'room-' || substr(md5(CAST(round(p_retailprice) AS BIGINT) || ':' || CAST(round(p_size) AS BIGINT)), 1, 4) AS room_id FROM part")
def room_hash_ids(spark, d):
    """Stable ids from the rounded centroid; they may collide."""
    c = src.load(spark, d, "part").selectExpr("p_partkey as id", "p_retailprice as cx", "p_size as cy")
    return c.select("id", op.hashed_id(F.col("cx"), F.col("cy")).alias("room_id"))


@query("safe_filenames", r"""WITH n AS (SELECT p_partkey AS id, 'up/../' || p_name || ' #' || p_partkey || '..scan.LAS' AS name FROM part)
SELECT id, replace(regexp_replace(regexp_extract(name, '([^/]*)$', 1), '[^\p{L}\p{N}._-]', '', 'g'), '..', '_') AS safe, CASE WHEN p = '' THEN 'scan.laz' ELSE p END AS safe_scan
FROM (SELECT *, replace(regexp_replace(regexp_extract(CASE WHEN id % 10 = 0 THEN 'up/###' ELSE name END, '([^/]*)$', 1), '[^\p{L}\p{N}._-]', '', 'g'), '..', '_') AS p FROM n)""")
def safe_filenames(spark, d):
    n = src.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("up/../"), "p_name", F.lit(" #"), F.col("p_partkey").cast("string"), F.lit("..scan.LAS")).alias("name"))
    scan = F.when(F.col("id") % 10 == 0, "up/###").otherwise(F.col("name"))
    return n.select("id", op.safe_filename(F.col("name")).alias("safe"), op.safe_scan_name(scan).alias("safe_scan"))


@query("density_confidence", "SELECT p_partkey AS id, round(least(p_retailprice / greatest((p_size / 1000e0) * (p_size / 500e0) * 0.1e0, 1e-4) / 1000, 1), 6) AS confidence FROM part")
def density_confidence(spark, d):
    v = F.greatest((F.col("p_size") / F.lit(1000.0)) * (F.col("p_size") / F.lit(500.0)) * F.lit(0.1), F.lit(1e-4))
    return src.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(F.least(F.col("p_retailprice") / v / 1000.0, F.lit(1.0)), 6).alias("confidence"))


@query("bbox_shape", f"WITH {P}, b AS (SELECT wall, CAST(max(x_mm) - min(x_mm) AS DOUBLE) AS w, CAST(max(y_mm) - min(y_mm) AS DOUBLE) AS h FROM pts WHERE NOT is_floor GROUP BY 1) SELECT wall, round(1 - 1 / (greatest(w, h) / greatest(least(w, h), 1)), 6) AS eccentricity FROM b")
def bbox_shape(spark, d):
    b = src.points(spark, d).where("not is_floor").groupBy("wall").agg((F.max("x_mm") - F.min("x_mm")).cast("double").alias("w"), (F.max("y_mm") - F.min("y_mm")).cast("double").alias("h"))
    return b.select("wall", F.round(1.0 - 1.0 / (F.greatest("w", "h") / F.greatest(F.least("w", "h"), F.lit(1.0))), 6).alias("eccentricity"))


_E = "(SELECT greatest((max({k}_mm) - min({k}_mm)) / 1000e0, 1e-3) FROM pts)"


@query("voxel_estimate", f"""WITH {P}, e AS (SELECT greatest(pow({_E.format(k='x')} * {_E.format(k='y')} * {_E.format(k='z')} / 5000, 1 / 3e0), 1e-3) AS v0),
v AS (SELECT v0, greatest(CAST(round_even(v0 * 1000, 0) AS BIGINT), 1) AS v FROM e), m AS (SELECT min(x_mm) mx, min(y_mm) my, min(z_mm) mz FROM pts),
t AS (SELECT count(*) AS trial FROM (SELECT DISTINCT floor((x_mm - mx) / CAST(v AS DOUBLE)), floor((y_mm - my) / CAST(v AS DOUBLE)), floor((z_mm - mz) / CAST(v AS DOUBLE)) FROM pts, m, v))
SELECT round(v0, 9) AS v0, trial, round(CASE WHEN trial / 5000e0 > 1.3e0 THEN v0 * pow(trial / 5000e0, 1 / 3e0) ELSE v0 END, 9) AS voxel FROM v, t""")
def voxel_estimate(spark, d):
    return op.voxel_estimate(src.points(spark, d), 5000).select(F.round("v0", 9).alias("v0"), "trial", F.round("voxel", 9).alias("voxel"))


@query("auto_elevation", f"WITH {P}, b AS (SELECT z_mm // 50 AS bin, count(*) AS n FROM pts WHERE is_floor OR z_mm < 500 GROUP BY 1 ORDER BY n DESC, bin LIMIT 1) SELECT bin * 50 AS floor_mm, bin * 50 + 1400 AS elevation_mm FROM b")
def auto_elevation(spark, d):
    b = src.points(spark, d).where("is_floor or z_mm < 500").groupBy(F.expr("z_mm div 50").alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bin").limit(1)
    return b.selectExpr("bin * 50 as floor_mm", "bin * 50 + 1400 as elevation_mm")


@query("pixel_lengths", "SELECT p_partkey AS id, greatest(CAST(round_even(p_size / 7e0, 0) AS BIGINT), 3) AS min_px, CAST(least(greatest(ceil(p_retailprice / 20), 4), 16384) AS BIGINT) AS slice_px FROM part")
def pixel_lengths(spark, d):
    return src.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.greatest(F.bround(F.col("p_size") / F.lit(7.0), 0).cast("long"), F.lit(3)).cast("long").alias("min_px"), F.least(F.greatest(F.ceil(F.col("p_retailprice") / 20.0), F.lit(4)), F.lit(16384)).cast("long").alias("slice_px"))


@query("segment_arrays", f"WITH {S} SELECT seg_id, '[[' || x1 || ',' || y1 || '],[' || x2 || ',' || y2 || ']]' AS segment FROM segs")
def segment_arrays(spark, d):
    s = src.segments(spark, d)
    return s.select("seg_id", F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("a")).select("seg_id", F.to_json(F.struct("a")).alias("j")).select("seg_id", F.expr("substring(j, 6, length(j) - 6)").alias("segment"))


@query("annotation_text", f"WITH {S} SELECT 'walls: ' || count(*) || ' segments, ' || CAST(sum(abs(x2 - x1) + abs(y2 - y1)) AS BIGINT) || ' mm' AS note FROM segs")
def annotation_text(spark, d):
    return src.segments(spark, d).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))).alias("mm")).select(F.format_string("walls: %d segments, %d mm", "n", "mm").alias("note"))


@query("fixture_hue", "SELECT p_partkey AS id, round(0.5e0 - 0.5e0 * least(greatest((p_size / 100e0 - 0.02e0) / 0.28e0, 0), 1), 6) AS hue, round(greatest(least(greatest(p_size / 100e0, 0.01e0) / 2, 0.2e0), 0.06e0), 6) AS radius FROM part")
def fixture_hue(spark, d):
    depth = F.col("p_size") / F.lit(100.0)
    return src.load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(op.hsl_hue(depth), 6).alias("hue"), F.round(F.greatest(F.least(F.greatest(depth, F.lit(0.01)) / 2.0, F.lit(0.2)), F.lit(0.06)), 6).alias("radius"))


def _ramp_sql(channel: int) -> str:
    parts = []
    for lo, hi in zip(op.HEIGHT_STOPS, op.HEIGHT_STOPS[1:]):
        parts.append(f"WHEN t <= {hi[0]}e0 THEN {lo[channel]}e0 + (t - {lo[0]}e0) / ({hi[0]}e0 - {lo[0]}e0) * ({hi[channel]}e0 - {lo[channel]}e0)")
    return "round(CASE " + " ".join(parts) + f" ELSE {op.HEIGHT_STOPS[-1][channel]}e0 END, 6)"


@query("height_colours", f"""WITH {P}, e AS (SELECT min(z_mm) AS lo, greatest(max(z_mm) - min(z_mm), 1) AS span FROM pts), h AS (SELECT point_id, least(greatest((z_mm - lo) / CAST(span AS DOUBLE), 0), 1) AS t FROM pts, e)
SELECT point_id, {_ramp_sql(1)} AS r, {_ramp_sql(2)} AS g, {_ramp_sql(3)} AS b FROM h""")
def height_colours(spark, d):
    p = src.points(spark, d)
    e = p.agg(F.min("z_mm").alias("lo"), F.greatest(F.max("z_mm") - F.min("z_mm"), F.lit(1)).alias("span"))
    t = filters.with_scalar(p, e).select("point_id", F.least(F.greatest((F.col("z_mm") - F.col("lo")) / F.col("span").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("t"))
    return t.select("point_id", *[F.round(op.height_ramp(F.col("t"), [(s[0], s[i]) for s in op.HEIGHT_STOPS]), 6).alias(c) for i, c in ((1, "r"), (2, "g"), (3, "b"))])


@query("matrix_flattening", "SELECT p_partkey AS id, '1,0,0,' || p_size || ',0,1,0,' || p_partkey || ',0,0,1,0,0,0,0,1' AS row_major, '1,0,0,0,0,1,0,0,0,0,1,0,' || p_size || ',' || p_partkey || ',0,1' AS column_major FROM part")
def matrix_flattening(spark, d):
    cell = lambda r, c: F.col("p_size").cast("string") if (r, c) == (0, 3) else F.col("p_partkey").cast("string") if (r, c) == (1, 3) else F.lit("1" if r == c else "0")
    rows = F.array(*[F.array(*[cell(r, c) for c in range(4)]) for r in range(4)])
    m = src.load(spark, d, "part").select(F.col("p_partkey").alias("id"), rows.alias("m"))
    turned = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.transform("m", lambda r: F.get(r, c))))
    return m.select("id", F.array_join(F.flatten("m"), ",").alias("row_major"), F.array_join(turned, ",").alias("column_major"))


@query("nudge_rotate", f"WITH {P} SELECT point_id, round(10000 + (x_mm - 10000) * cos(radians(5e0)) - (y_mm - 7500) * sin(radians(5e0)) + 50, 3) AS x, round(7500 + (x_mm - 10000) * sin(radians(5e0)) + (y_mm - 7500) * cos(radians(5e0)), 3) AS y FROM pts")
def nudge_rotate(spark, d):
    x, y, _ = op.transform(op.rotation_matrix(5.0, 10000.0, 7500.0, 50.0), *[F.col(f"{k}_mm").cast("double") for k in "xyz"])
    return src.points(spark, d).select("point_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _table_sql(column: str, table: dict, default: str) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in table.items()) + f" ELSE {default} END"


@query("category_display", f"""WITH c AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'office' WHEN 1 THEN 'bathroom' WHEN 2 THEN 'hallway' WHEN 3 THEN 'common' ELSE 'other' END AS category, (p_partkey % 101) / 100e0 AS q FROM part)
SELECT id, {_table_sql('category', op.CATEGORY_COLOURS, '7041664')} AS colour, {_table_sql('category', op.CATEGORY_NAMES, "'Unknown'")} AS name, CASE WHEN q >= 0.9e0 THEN 'green' WHEN q >= 0.7e0 THEN 'yellow' ELSE 'red' END AS band FROM c""".replace("7041664", str(op.CATEGORY_COLOURS["unknown"])))
def category_display(spark, d):
    c = src.load(spark, d, "part").selectExpr("p_partkey as id", "case p_partkey % 6 when 0 then 'office' when 1 then 'bathroom' when 2 then 'hallway' when 3 then 'common' else 'other' end as category", "(p_partkey % 101) / 100D as q")
    return c.select("id", op.lookup(F.col("category"), op.CATEGORY_COLOURS, op.CATEGORY_COLOURS["unknown"]).alias("colour"), op.lookup(F.col("category"), op.CATEGORY_NAMES, "Unknown").alias("name"), F.when(F.col("q") >= 0.9, "green").when(F.col("q") >= 0.7, "yellow").otherwise("red").alias("band"))
