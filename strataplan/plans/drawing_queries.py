"""Line work to faces and rooms: queries over the drawings of the fixture, and faces as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drawings, rings, rooms
from ..sources import building as src
from .registry import query
from .scalar_queries import _category_sql

S = src.SEGMENTS_SQL
_ROUNDS = 17  # of pointer doubling: rings of up to 2^17 edges


def _rings_sql(p: str, edges: str) -> str:
    """Half-edges ``{p}h`` of an edge table, and their rings ``{p}r``: the smallest id of the walk around each face."""
    fan = "PARTITION BY g, ox, oy ORDER BY atan2(CAST(dy - oy AS DOUBLE), CAST(dx - ox AS DOUBLE)), id"
    rounds = "".join(f", {p}d{k + 1} AS MATERIALIZED (SELECT a.id, b.ptr, least(a.best, b.best) AS best FROM {p}d{k} a JOIN {p}d{k} b ON a.ptr = b.id)" for k in range(_ROUNDS))
    return f"""{p}h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY g, ox, oy, dx, dy) AS id, * FROM (SELECT g, ax AS ox, ay AS oy, bx AS dx, by1 AS dy FROM {edges} UNION ALL SELECT g, bx, by1, ax, ay FROM {edges})),
{p}n AS (SELECT g, ox, oy, dx, dy, coalesce(lag(id) OVER ({fan}), last_value(id) OVER ({fan} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev FROM {p}h),
{p}d0 AS MATERIALIZED (SELECT t.id, n.prev AS ptr, t.id AS best FROM {p}n n JOIN {p}h t ON t.g = n.g AND t.ox = n.dx AND t.oy = n.dy AND t.dx = n.ox AND t.dy = n.oy){rounds},
{p}r AS MATERIALIZED (SELECT h.*, d.best AS ring FROM {p}h h JOIN {p}d{_ROUNDS} d USING (id))"""


def _apart_sql(edges: str, out: str) -> str:
    """Of two pieces that leave a corner in one direction the longer becomes what is beyond the shorter; once."""
    h = f"{out}h"
    return f"""{h} AS (SELECT *, dx - ox AS u, dy - oy AS v FROM (SELECT *, ax AS ox, ay AS oy, bx AS dx, by1 AS dy FROM {edges} UNION ALL SELECT *, bx, by1, ax, ay FROM {edges})),
{h}o AS MATERIALIZED (SELECT a.g, a.ax, a.ay, a.bx, a.by1, arg_max((b.dx, b.dy), b.u * b.u + b.v * b.v) AS s, (a.dx, a.dy) AS t FROM {h} a JOIN {h} b ON a.g = b.g AND a.ox = b.ox AND a.oy = b.oy AND a.u * b.v = a.v * b.u AND a.u * b.u + a.v * b.v > 0 AND b.u * b.u + b.v * b.v < a.u * a.u + a.v * a.v GROUP BY ALL),
{out} AS MATERIALIZED (SELECT * FROM {edges} WHERE (g, ax, ay, bx, by1) NOT IN (SELECT (g, ax, ay, bx, by1) FROM {h}o) UNION SELECT g, least(s, t)[1], least(s, t)[2], greatest(s, t)[1], greatest(s, t)[2] FROM {h}o)"""


def faces_sql(lines: str, snap: str) -> str:
    """CTEs over ``lines(g, seg_id, x1, y1, x2, y2)`` ending in ``fc(g, face, ox, oy, dx, dy)``, holes included, in units of ``snap``."""
    end = lambda k: f"CASE WHEN ta = 0 THEN a{k}1 WHEN ta = 1 THEN a{k}2 WHEN tb = 0 THEN b{k}1 WHEN tb = 1 THEN b{k}2 WHEN a_id < b_id THEN a{k}1 + (a{k}2 - a{k}1) * ta ELSE b{k}1 + (b{k}2 - b{k}1) * tb END"
    cols = ", ".join(f"CAST({s}.{c} AS DOUBLE) AS {s}{c}" for s in "ab" for c in ("x1", "y1", "x2", "y2"))
    at = lambda v: f"CAST(round({v} / {snap}) AS BIGINT)"
    half = "(ox - _x) * CAST(dy - _y AS DOUBLE) - (dx - _x) * CAST(oy - _y AS DOUBLE)"
    return f"""pr AS (SELECT a.g, a.seg_id AS a_id, b.seg_id AS b_id, {cols} FROM {lines} a JOIN {lines} b ON a.g = b.g AND a.seg_id <> b.seg_id AND greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND greatest(b.y1, b.y2) >= least(a.y1, a.y2)),
dn AS MATERIALIZED (SELECT *, (ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1) AS den FROM pr),
mt AS (SELECT *, ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / den AS ta, ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / den AS tb FROM dn WHERE den <> 0),
en AS (SELECT g, a_id, ax1, ay1, ax2, ay2, unnest([bx1, bx2]) AS x, unnest([by1, by2]) AS y FROM dn WHERE den = 0 AND (bx1 - ax1) * (ay2 - ay1) = (by1 - ay1) * (ax2 - ax1)),
ct AS (SELECT g, a_id AS seg_id, ta AS t, {end('x')} AS x, {end('y')} AS y FROM mt WHERE ta BETWEEN 0 AND 1 AND tb BETWEEN 0 AND 1
  UNION ALL SELECT g, a_id, CASE WHEN abs(ax2 - ax1) >= abs(ay2 - ay1) THEN (x - ax1) / (ax2 - ax1) ELSE (y - ay1) / (ay2 - ay1) END, x, y FROM en),
pt AS (SELECT g, seg_id, t, {at('x')} AS x, {at('y')} AS y FROM ct WHERE t > 0 AND t < 1 UNION SELECT g, seg_id, 0e0, {at('x1')}, {at('y1')} FROM {lines} UNION SELECT g, seg_id, 1e0, {at('x2')}, {at('y2')} FROM {lines}),
sg AS (SELECT g, x, y, lead(x) OVER w AS u, lead(y) OVER w AS v FROM pt WINDOW w AS (PARTITION BY g, seg_id ORDER BY t, x, y)),
e0 AS MATERIALIZED (SELECT DISTINCT g, CASE WHEN (x, y) < (u, v) THEN x ELSE u END AS ax, CASE WHEN (x, y) < (u, v) THEN y ELSE v END AS ay, CASE WHEN (x, y) < (u, v) THEN u ELSE x END AS bx, CASE WHEN (x, y) < (u, v) THEN v ELSE y END AS by1 FROM sg WHERE u IS NOT NULL AND (x <> u OR y <> v)),
{_apart_sql('e0', 'f0')}, {_apart_sql('f0', 'e1')}, {_rings_sql('p_', 'e1')},
e2 AS MATERIALIZED (SELECT a.g, a.ox AS ax, a.oy AS ay, a.dx AS bx, a.dy AS by1 FROM p_r a JOIN p_r b ON a.g = b.g AND a.ox = b.dx AND a.oy = b.dy AND a.dx = b.ox AND a.dy = b.oy WHERE (a.ox, a.oy) < (a.dx, a.dy) AND a.ring <> b.ring),
{_rings_sql('q_', 'e2')},
bx AS (SELECT g, ring, min(ox) AS _x, min(oy) AS _y, min((ox, oy)) AS p FROM q_r GROUP BY 1, 2),
ar AS MATERIALIZED (SELECT g, ring, p, sum({half}) / 2 AS area FROM q_r JOIN bx USING (g, ring) GROUP BY ALL),
hl AS (SELECT n.g, n.ring, s.ring AS face, s.area FROM ar n JOIN ar s ON s.g = n.g AND s.area > -n.area JOIN q_r e ON e.g = s.g AND e.ring = s.ring AND (e.oy > n.p[2]) <> (e.dy > n.p[2]) AND n.p[1] < (e.dx - e.ox) * CAST(n.p[2] - e.oy AS DOUBLE) / (e.dy - e.oy) + e.ox WHERE n.area < 0 GROUP BY ALL HAVING count(*) % 2 = 1),
ho AS (SELECT g, ring, arg_min(face, (area, face)) AS face FROM hl GROUP BY 1, 2),
fc AS MATERIALIZED (SELECT q_r.g, coalesce(ho.face, q_r.ring) AS face, ho.face IS NOT NULL AS hole, ox, oy, dx, dy FROM q_r JOIN ar USING (g, ring) LEFT JOIN ho USING (g, ring) WHERE ar.area > 0 OR ho.face IS NOT NULL)"""


def measured_sql(sides: str) -> str:
    """Area, centroid and edges of ``sides(g, face, ox, oy, dx, dy)``, as ``ms``."""
    c = "((ox - _x) * (dy - _y) - (dx - _x) * (oy - _y))"
    return f"""mb AS (SELECT g, face, min(ox) AS _x, min(oy) AS _y FROM {sides} GROUP BY 1, 2),
ms AS (SELECT g, face, abs(sum({c})) / 2 AS area, _x + sum((ox + dx - 2 * _x) * {c}) / (3 * sum({c})) AS cx, _y + sum((oy + dy - 2 * _y) * {c}) / (3 * sum({c})) AS cy, count(*) AS corners FROM {sides} JOIN mb USING (g, face) GROUP BY g, face, _x, _y HAVING sum({c}) <> 0)"""


_UNIT = "SELECT g, face, hole, ox * {0} AS ox, oy * {0} AS oy, dx * {0} AS dx, dy * {0} AS dy FROM fc"


@query("noded_faces", f"""WITH {S}, ln AS (SELECT seg_id // 500 AS g, * FROM segs), {faces_sql('ln', '0.001e0')}, fu AS ({_UNIT.format('0.001e0')}), {measured_sql('fu')}
SELECT g AS building, round(area, 2) AS area_mm2, round(_x, 3) AS x0, round(_y, 3) AS y0, corners FROM ms JOIN mb USING (g, face)""")
def noded_faces(spark, d):
    """Faces of the wall segments of each building: half-edges, rings by pointer doubling, holes."""
    s = src.segments(spark, d).select(F.expr("seg_id div 500").alias("by"), "seg_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return rings.measured(rings.faces(s)).select(F.col("by").alias("building"), F.round("area", 2).alias("area_mm2"), F.round("x0", 3).alias("x0"), F.round("y0", 3).alias("y0"), "corners")


#: closed polylines of three corners that do not cross or touch themselves, of more than 0.5 m2, as ``cl``
_CLOSED = """ol AS (SELECT file, entity, vertex, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2, count(*) OVER (PARTITION BY file, entity) AS k FROM outline WINDOW w AS (PARTITION BY file, entity ORDER BY vertex)),
oc AS (SELECT * FROM ol WHERE k >= 3 AND (x1 <> x2 OR y1 <> y2)),
ox AS (SELECT a.file, a.entity, a.vertex AS i, b.vertex AS j, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS den FROM oc a JOIN oc b USING (file, entity) WHERE a.vertex <> b.vertex),
bad AS (SELECT file, entity FROM ox WHERE den <> 0 AND ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / den > 0 AND ((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / den < 1 AND ((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / den BETWEEN 0 AND 1
  UNION SELECT file, entity FROM oc GROUP BY file, entity, x1, y1 HAVING count(*) > 1),
cl AS (SELECT file, entity, vertex, x1 AS ox, y1 AS oy, x2 AS dx, y2 AS dy FROM oc WHERE (file, entity) NOT IN (SELECT (file, entity) FROM bad) AND (file, entity) IN (SELECT (file, entity) FROM oc GROUP BY file, entity HAVING abs(sum(x1 * y2 - x2 * y1)) / 2 > 0.5e0))"""


@query("closed_polylines", f"WITH {S}, {src.DRAWING_SQL}, {_CLOSED} SELECT file, entity, count(*) AS vertices, round(abs(sum(ox * dy - dx * oy)) / 2, 6) AS area_m2 FROM cl GROUP BY 1, 2")
def closed_polylines(spark, d):
    e = drawings.closed_outlines(src.drawing(spark, d))
    return e.groupBy(F.col("by").alias("file"), F.col("face").alias("entity")).agg(F.count("*").alias("vertices"), F.round(F.abs(F.sum(rings.shoelace())) / 2, 6).alias("area_m2"))


@query("text_labels", f"WITH {S}, {src.DRAWING_SQL} SELECT file, entity, kind, text, round(x, 4) AS x, round(y, 4) AS y FROM texts")
def text_labels(spark, d):
    return drawings.texts(src.drawing(spark, d)).select("file", "entity", "kind", "text", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_INSIDE = "(s.oy > t.y) <> (s.dy > t.y) AND t.x < (s.dx - s.ox) * (t.y - s.oy) / (s.dy - s.oy) + s.ox"
_HIT = f"hit AS (SELECT s.g, s.face, t.text, t.kind, t.entity FROM {{0}} s JOIN texts t ON t.file = s.g AND {_INSIDE} GROUP BY ALL HAVING count(*) % 2 = 1), lb AS (SELECT g, face, arg_min(text, (kind = 'MTEXT', entity)) AS text FROM hit GROUP BY 1, 2)"


@query("label_first_match", f"WITH {S}, {src.DRAWING_SQL}, {_CLOSED}, cs AS (SELECT file AS g, entity AS face, ox, oy, dx, dy FROM cl), {_HIT.format('cs')} SELECT g AS file, face AS entity, text AS label FROM lb")
def label_first_match(spark, d):
    """The first label inside each closed polyline, TEXT before MTEXT."""
    v = src.drawing(spark, d)
    return drawings.first_labels(drawings.closed_outlines(v), drawings.texts(v)).select(F.col("by").alias("file"), F.col("face").alias("entity"), F.col("text").alias("label"))


@query("drawing_rooms", f"""WITH {S}, {src.DRAWING_SQL}, {_CLOSED}, many AS (SELECT file FROM cl GROUP BY 1 HAVING count(DISTINCT entity) >= 2),
ln AS (SELECT 'plan-' || (seg_id // 500) AS g, seg_id * 8 AS seg_id, x1 / 1000e0 AS x1, y1 / 1000e0 AS y1, x2 / 1000e0 AS x2, y2 / 1000e0 AS y2 FROM segs WHERE 'plan-' || (seg_id // 500) NOT IN (SELECT file FROM many)
  UNION ALL SELECT file, (entity // 3) * 8 + vertex, x1, y1, x2, y2 FROM ol WHERE file NOT IN (SELECT file FROM many) AND (x1 <> x2 OR y1 <> y2)), {faces_sql('ln', '1e-6')},
fu AS ({_UNIT.format('1e-6')}), al AS (SELECT g, face, ox, oy, dx, dy FROM fu UNION ALL SELECT file, entity, ox, oy, dx, dy FROM cl JOIN many USING (file)), {measured_sql('al')}, {_HIT.format('al')},
nm AS (SELECT ms.*, text, row_number() OVER (PARTITION BY g ORDER BY CASE WHEN g IN (SELECT file FROM many) THEN CAST(face AS DOUBLE) ELSE -round(area, 6) END, round(cx, 6), round(cy, 6)) AS n FROM ms LEFT JOIN lb USING (g, face) WHERE area > 0.5e0),
lab AS (SELECT *, CASE WHEN coalesce(text, '') <> '' THEN text ELSE 'Room-' || printf('%03d', n) END AS label FROM nm)
SELECT g AS file, 'room-' || printf('%03d', n) AS room_id, label, {_category_sql('label')} AS category, round(cx, 4) AS cx, round(cy, 4) AS cy, round(area, 4) AS area_m2, corners FROM lab""")
def drawing_rooms(spark, d):
    """Rooms of each drawing: closed outlines, or faces of the lines; first label, category, centroid, area."""
    return drawings.rooms(src.drawing(spark, d)).select("file", "room_id", "label", "category", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"), F.round("area_m2", 4).alias("area_m2"), "corners")


@query("rooms_polygonized", f"""WITH {S}, ln AS (SELECT seg_id // 500 AS g, seg_id, x1 / 1000e0 AS x1, y1 / 1000e0 AS y1, x2 / 1000e0 AS x2, y2 / 1000e0 AS y2 FROM segs), {faces_sql('ln', '1e-6')}, fu AS ({_UNIT.format('1e-6')}), {measured_sql('fu')},
bb AS (SELECT g, (max(greatest(x1, x2)) - min(least(x1, x2))) * (max(greatest(y1, y2)) - min(least(y1, y2))) * 0.005e0 AS least_m2 FROM ln GROUP BY 1)
SELECT ms.g AS building, round(area, 6) AS area_m2 FROM ms JOIN bb USING (g) WHERE area > 2 AND area >= least_m2""")
def rooms_polygonized(spark, d):
    """Rooms as faces of the wall segments of each building."""
    s = src.segments(spark, d).select(F.expr("seg_id div 500").alias("building"), *[(F.col(c) / 1000.0).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return rooms.rooms_from_lines(s).select("building", F.round("area_m2", 6).alias("area_m2"))


@query("building_as_room", f"""WITH {S}, b AS (SELECT seg_id // 500 AS building, min(least(x1, x2)) / 1000e0 AS x0, min(least(y1, y2)) / 1000e0 AS y0, max(greatest(x1, x2)) / 1000e0 AS x1, max(greatest(y1, y2)) / 1000e0 AS y1 FROM segs GROUP BY 1)
SELECT building, 'room-001' AS room_id, 'Building' AS label, 'unknown' AS category, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round((x1 - x0) * (y1 - y0), 6) AS area_m2, 0.3e0 AS confidence FROM b""")
def building_as_room(spark, d):
    """What is left where nothing divides a building: its box as one room."""
    ends = F.explode(F.array(*[F.struct(F.col(f"x{i}").alias("x_mm"), F.col(f"y{i}").alias("y_mm")) for i in (1, 2)])).alias("p")
    p = src.segments(spark, d).select(F.expr("seg_id div 500").alias("building"), ends).select("building", "p.*")
    return rooms.building_rooms(rooms.boxes(p)).select("building", "room_id", "label", "category", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "area_m2")], "confidence")
