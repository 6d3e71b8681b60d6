"""Rasters to edges, lines, seeds and basins, each with its form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import basins, lines, raster
from .join_queries import _CELLS, _cells, _dil, _ero
from .registry import query

#: closed twice and blurred, in 0..255
_SHADES = f"{_CELLS}, {_dil('g1', 'cells')}, {_dil('g2', 'g1')}, {_ero('x1', 'g2')}, {_ero('cl', 'x1')}, sh AS (SELECT col + dx AS col, row + dy AS row, CAST(round(round(sum(w), 9) * 255) AS BIGINT) AS q FROM cl, (VALUES " + ", ".join(f"({dx}, {dy}, {w!r}e0)" for (dx, dy), w in raster.gaussian(3, 0.8).items()) + ") k(dx, dy, w) GROUP BY 1, 2)"
_SOBEL = ", ".join(f"({dx}, {dy}, {dx * (2 if dy == 0 else 1)}, {dy * (2 if dx == 0 else 1)})" for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy)
_SLOPES = f"{_SHADES}, sl AS MATERIALIZED (SELECT col - dx AS col, row - dy AS row, CAST(sum(q * sx) AS BIGINT) AS gx, CAST(sum(q * sy) AS BIGINT) AS gy FROM sh, (VALUES {_SOBEL}) k(dx, dy, sx, sy) GROUP BY 1, 2 HAVING sum(q * sx) <> 0 OR sum(q * sy) <> 0)"


def _shades(spark, d):
    return raster.preprocess(_cells(spark, d))


@query("edge_cells", f"""WITH RECURSIVE {_SLOPES}, mg AS (SELECT *, gx * gx + gy * gy AS m, CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN 0 WHEN abs(gy) * 32768 > abs(gx) * 13573 + abs(gx) * 65536 THEN 1 WHEN (gx < 0) <> (gy < 0) THEN 2 ELSE 3 END AS way FROM sl),
thin AS MATERIALIZED (SELECT c.col, c.row, c.m > 14400 AS strong FROM mg c, (VALUES (0, -1, 0), (1, 0, -1), (2, 1, -1), (3, -1, -1)) w(way, dx, dy) LEFT JOIN mg p ON p.col = c.col + dx AND p.row = c.row + dy LEFT JOIN mg n ON n.col = c.col - dx AND n.row = c.row - dy
  WHERE c.way = w.way AND c.m > 1600 AND c.m > coalesce(p.m, 0) AND CASE WHEN c.way < 2 THEN c.m >= coalesce(n.m, 0) ELSE c.m > coalesce(n.m, 0) END),
edge(col, row) AS (SELECT col, row FROM thin WHERE strong UNION SELECT t.col, t.row FROM edge e JOIN thin t ON abs(t.col - e.col) <= 1 AND abs(t.row - e.row) <= 1) SELECT col, row FROM edge""")
def edge_cells(spark, d):
    """Edges of the closed, blurred wall raster."""
    return raster.edge_cells(_shades(spark, d))


@query("grown_lines", f"""WITH RECURSIVE {_SLOPES}, o AS MATERIALIZED (SELECT col, row, (row + 1073741824) * 2147483648 + col + 1073741824 AS id, (round(degrees(atan2(CAST(gy AS DOUBLE), CAST(gx AS DOUBLE))), 6) % 180e0 + 180e0) % 180e0 AS a FROM sl),
lk AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM o p JOIN o q ON abs(p.col - q.col) <= 1 AND abs(p.row - q.row) <= 1 AND p.id <> q.id AND least(abs(p.a - q.a), 180e0 - abs(p.a - q.a)) <= 10e0),
reach(s, r) AS (SELECT id, id FROM o UNION SELECT lk.b, reach.r FROM reach JOIN lk ON lk.a = reach.s), lab AS (SELECT s AS id, min(r) AS label FROM reach GROUP BY 1),
w AS (SELECT label, col AS x_mm, row AS y_mm FROM lab JOIN o USING (id)),
s AS (SELECT label, count(*) AS n, avg(x_mm) AS cx, avg(y_mm) AS cy, (CAST(sum(CAST(x_mm AS HUGEINT) * x_mm) AS DOUBLE) - CAST(sum(x_mm) AS DOUBLE) * CAST(sum(x_mm) AS DOUBLE) / count(*)) / count(*) AS vx, (CAST(sum(CAST(y_mm AS HUGEINT) * y_mm) AS DOUBLE) - CAST(sum(y_mm) AS DOUBLE) * CAST(sum(y_mm) AS DOUBLE) / count(*)) / count(*) AS vy,
 (CAST(sum(CAST(x_mm AS HUGEINT) * y_mm) AS DOUBLE) - CAST(sum(x_mm) AS DOUBLE) * CAST(sum(y_mm) AS DOUBLE) / count(*)) / count(*) AS cxy FROM w GROUP BY 1),
a AS (SELECT *, 0.5e0 * atan2(2 * cxy, vx - vy) AS t FROM s), e AS (SELECT label, n, cx, cy, t, min((x_mm - cx) * cos(t) + (y_mm - cy) * sin(t)) AS lo, max((x_mm - cx) * cos(t) + (y_mm - cy) * sin(t)) AS hi FROM w JOIN a USING (label) GROUP BY ALL)
SELECT label, n, round(hi - lo, 3) AS length FROM e WHERE n >= 5 AND hi - lo >= 4""")
def grown_lines(spark, d):
    """Lines by region growing: neighbouring cells of like gradient, and the principal axis of each region."""
    s = lines.grown_segments(raster.gradients(_shades(spark, d)), least=4.0, tolerance=10.0)
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return s.select("label", "n", F.round(length, 3).alias("length"))


_BINS, _VOTES, _LEAST, _GAP, _HOUGH_ROUNDS = 36, 8, 6.0, 3.0, 3


def _hough_round(k: int) -> str:
    t = f"radians(theta * {180 / _BINS!r}e0)"
    beside = ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1))
    return f""", th{k} AS MATERIALIZED (SELECT col, row, CAST(theta AS INT) AS theta, CAST(floor(round(col * cos({t}) + row * sin({t}), 6) + 0.5) AS BIGINT) AS rho FROM c{k}, range({_BINS}) r(theta)),
ta{k} AS (SELECT theta, rho, count(*) AS votes FROM th{k} GROUP BY 1, 2 HAVING count(*) >= {_VOTES}),
tn{k} AS (SELECT (theta + dt + {_BINS}) % {_BINS} AS theta, CASE WHEN theta + dt < 0 OR theta + dt >= {_BINS} THEN -rho ELSE rho END + dr AS rho, (-votes, theta, rho) AS r FROM ta{k}, (VALUES {beside}) o(dt, dr)),
pk{k} AS MATERIALIZED (SELECT t.* FROM ta{k} t JOIN (SELECT theta, rho, min(r) AS r FROM tn{k} GROUP BY 1, 2) n ON n.theta = t.theta AND n.rho = t.rho AND n.r = (-t.votes, t.theta, t.rho)),
on{k} AS (SELECT col, row, min((-votes, p.theta, p.rho)) AS r FROM th{k} t JOIN pk{k} p ON p.theta = t.theta AND abs(p.rho - t.rho) <= 1 GROUP BY 1, 2),
al{k} AS (SELECT col, row, theta, rho, round(row * cos({t}) - col * sin({t}), 6) AS along FROM (SELECT col, row, r[2] AS theta, r[3] AS rho FROM on{k})),
ru{k} AS (SELECT *, sum(brk) OVER (PARTITION BY theta, rho ORDER BY along, col, row) AS run FROM (SELECT *, CASE WHEN along - lag(along) OVER (PARTITION BY theta, rho ORDER BY along, col, row) > {_GAP} THEN 1 ELSE 0 END AS brk FROM al{k})),
sg{k} AS MATERIALIZED (SELECT theta, rho, run, min(along) AS a, max(along) AS b, count(*) AS n FROM ru{k} GROUP BY 1, 2, 3 HAVING max(along) - min(along) >= {_LEAST}),
c{k + 1} AS MATERIALIZED (SELECT col, row FROM c{k} EXCEPT SELECT col, row FROM ru{k} JOIN sg{k} USING (theta, rho, run))"""


@query("hough_segments_by_runs", f"WITH {_CELLS}, c0 AS (SELECT * FROM cells){''.join(map(_hough_round, range(_HOUGH_ROUNDS)))} SELECT theta, rho, round(a, 4) AS a, round(b, 4) AS b, n FROM (" + " UNION ALL ".join(f"SELECT * FROM sg{k}" for k in range(_HOUGH_ROUNDS)) + ")")
def hough_segments_by_runs(spark, d):
    """Peak lines split at gaps; three rounds, in each of which what was found leaves the vote."""
    s = lines.hough_segments(_cells(spark, d), _VOTES, _LEAST, _GAP, _BINS, _HOUGH_ROUNDS)
    t = F.radians(F.col("theta") * (180.0 / _BINS))
    along = lambda i: F.round(F.col(f"y{i}") * F.cos(t) - F.col(f"x{i}") * F.sin(t), 4)
    return s.select("theta", "rho", along(1).alias("a"), along(2).alias("b"), "n")


#: the filled building, and squared distances to what is outside of it
_FILLED = """box AS (SELECT min(col) - 1 c0, max(col) + 1 c1, min(row) - 1 r0, max(row) + 1 r1 FROM cl), grid AS (SELECT c AS col, r AS row FROM box, range(-50, 200) a(c), range(-50, 200) b(r) WHERE c BETWEEN c0 AND c1 AND r BETWEEN r0 AND r1),
back AS MATERIALIZED (SELECT * FROM grid EXCEPT SELECT * FROM cl), outside(col, row) AS (SELECT c0, r0 FROM box UNION SELECT b.col, b.row FROM outside o JOIN back b ON abs(b.col - o.col) + abs(b.row - o.row) = 1),
wall AS (SELECT 30 AS col, row FROM range(-50, 200) b(row) WHERE row NOT BETWEEN 20 AND 23), fl AS MATERIALIZED (SELECT * FROM (SELECT * FROM grid EXCEPT SELECT * FROM outside) EXCEPT SELECT * FROM wall),
zero AS (SELECT col, row FROM grid EXCEPT SELECT col, row FROM fl), dp AS MATERIALIZED (SELECT f.col, f.row, min((f.col - z.col) * (f.col - z.col) + (f.row - z.row) * (f.row - z.row)) AS h FROM fl f JOIN zero z ON z.col BETWEEN f.col - 40 AND f.col + 40 AND z.row BETWEEN f.row - 40 AND f.row + 40 GROUP BY 1, 2)"""
_CLOSED = _SHADES.split(", sh AS")[0]


def _depth(spark, d):
    """Depths of the filled building, with a wall and a door in it."""
    filled = raster.fill_holes(raster.close(_cells(spark, d), rounds=2))
    return raster.depth(filled.where("NOT (col = 30 AND row NOT BETWEEN 20 AND 23)"))


@query("depth_cells", f"WITH RECURSIVE {_CLOSED}, {_FILLED} SELECT col, row, h FROM dp")
def depth_cells(spark, d):
    return _depth(spark, d)


_APART, _SMALL, _PEAK_ROUNDS = 6, 6, 12


def _peaks_sql(p: str, apart: int, least: int) -> str:
    near = lambda a, b: f"abs({a}.col - {b}.col) <= {apart} AND abs({a}.row - {b}.row) <= {apart}"
    out = f", {p}0 AS MATERIALIZED (SELECT c.col, c.row, (xor(c.col * 73856093, c.row * 19349663) & 2147483647, c.col, c.row) AS turn FROM dp c JOIN dp o ON {near('c', 'o')} WHERE c.h >= {least} GROUP BY c.col, c.row, c.h HAVING max(o.h) = c.h)"
    for k in range(_PEAK_ROUNDS):
        out += f", {p}t{k} AS MATERIALIZED (SELECT c.col, c.row FROM {p}{k} c JOIN {p}{k} o ON {near('c', 'o')} GROUP BY c.col, c.row, c.turn HAVING min(o.turn) = c.turn)"
        out += f", {p}{k + 1} AS MATERIALIZED (SELECT c.* FROM {p}{k} c WHERE NOT EXISTS (SELECT 1 FROM {p}t{k} t WHERE {near('c', 't')}))"
    return out + f", {p}all AS (" + " UNION ALL ".join(f"SELECT col, row FROM {p}t{k}" for k in range(_PEAK_ROUNDS)) + ")"


_SEEDS = f"{_peaks_sql('pw', _APART, 1)}{_peaks_sql('pn', 1, _SMALL * _SMALL)}, seeds AS MATERIALIZED (SELECT * FROM pwall UNION SELECT * FROM pnall)"


@query("room_seeds", f"WITH RECURSIVE {_CLOSED}, {_FILLED}{_SEEDS} SELECT col, row FROM seeds")
def room_seeds(spark, d):
    return basins.room_seeds(_depth(spark, d), _APART, _SMALL)


_FLOOD_ROUNDS = 10


def _flood_round(k: int) -> str:
    """Parts without a seed take their best pass; what is so linked is one part."""
    return f""", ps{k} AS (SELECT pa.part AS pa, pb.part AS pb, w, lo, hi, pa.rooted AS ra, pb.rooted AS rb FROM pass JOIN n{k} pa ON pa.id = lo JOIN n{k} pb ON pb.id = hi WHERE pa.part <> pb.part),
bt{k} AS MATERIALIZED (SELECT x AS part, arg_min(y, (-w, lo, hi)) AS other FROM (SELECT pa AS x, pb AS y, w, lo, hi FROM ps{k} WHERE NOT ra UNION ALL SELECT pb, pa, w, lo, hi FROM ps{k} WHERE NOT rb) GROUP BY 1),
un{k} AS MATERIALIZED (SELECT part AS a, other AS b FROM bt{k} UNION SELECT other, part FROM bt{k}), rc{k}(a, r) AS (SELECT a, a FROM un{k} UNION SELECT u.b, r.r FROM rc{k} r JOIN un{k} u ON u.a = r.a),
nm{k} AS MATERIALIZED (SELECT a, min(r) AS r FROM rc{k} GROUP BY 1),
n{k + 1} AS MATERIALIZED (SELECT id, part, bool_or(rooted) OVER (PARTITION BY part) AS rooted, seed FROM (SELECT id, coalesce(nm{k}.r, n{k}.part) AS part, rooted, seed FROM n{k} LEFT JOIN nm{k} ON nm{k}.a = n{k}.part))"""


_ID = "(row + 1073741824) * 2147483648 + col + 1073741824"


@query("watershed_rooms", f"""WITH RECURSIVE {_CLOSED}, {_FILLED}{_SEEDS}, hi0 AS MATERIALIZED (SELECT col, row, {_ID} AS id, h FROM dp),
pass AS MATERIALIZED (SELECT least(a.h, b.h) AS w, least(a.id, b.id) AS lo, greatest(a.id, b.id) AS hi FROM hi0 a JOIN hi0 b ON (b.col = a.col + 1 AND b.row = a.row) OR (b.col = a.col AND b.row = a.row + 1)),
n0 AS MATERIALIZED (SELECT id, id AS part, s.col IS NOT NULL AS rooted, CASE WHEN s.col IS NOT NULL THEN id END AS seed FROM hi0 LEFT JOIN seeds s USING (col, row)){''.join(map(_flood_round, range(_FLOOD_ROUNDS)))},
top AS (SELECT part, max(seed) AS label FROM n{_FLOOD_ROUNDS} GROUP BY 1) SELECT hi0.col, hi0.row, label FROM hi0 JOIN n{_FLOOD_ROUNDS} USING (id) JOIN top USING (part) WHERE label IS NOT NULL""")
def watershed_rooms(spark, d):
    """Basins of the depths around the two-pass seeds, flooded tile by tile."""
    h = _depth(spark, d)
    return basins.watershed(h, basins.room_seeds(h, _APART, _SMALL), tile=16)
