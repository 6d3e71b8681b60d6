"""Outlines: contours of labelled cells, their simplification, and alpha shapes, each with its form in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alpha, contours, raster, rooms
from ..sources import building as src
from .join_queries import _COMP, _PART, _part
from .registry import query

# sides with no cell of the label beyond, each followed by the one that turns left most; a ring is walked from its
# smallest side, and a walk from any other ends where it meets a smaller one
_RINGS = f"""{_PART}, {_COMP}, sd AS (SELECT label, col + ox AS x, row + oy AS y, way FROM lab l, (VALUES (0, 0, 0, 0, -1), (1, 0, 1, 1, 0), (1, 1, 2, 0, 1), (0, 1, 3, -1, 0)) s(ox, oy, way, nx, ny) WHERE NOT EXISTS (SELECT 1 FROM lab o WHERE o.label = l.label AND o.col = l.col + nx AND o.row = l.row + ny)),
e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY label, x, y, way) AS id FROM sd),
nx AS MATERIALIZED (SELECT i.id, arg_min(o.id, (i.way + 5 - o.way) % 4) AS nxt FROM e i JOIN e o ON o.label = i.label AND o.x = i.x + CASE i.way WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AND o.y = i.y + CASE i.way WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END GROUP BY 1),
walk(ring, pos, place) AS (SELECT id, id, CAST(0 AS BIGINT) FROM e UNION ALL SELECT ring, nxt, place + 1 FROM walk JOIN nx ON nx.id = walk.pos WHERE nxt > ring),
lead_ AS MATERIALIZED (SELECT ring, place + 1 AS size FROM walk JOIN nx ON nx.id = walk.pos WHERE nxt = ring),
rg AS MATERIALIZED (SELECT label, ring, place, size, x, y FROM walk JOIN lead_ USING (ring) JOIN e ON e.id = walk.pos),
ms AS (SELECT r.label, r.ring, r.size, sum(r.x * n.y - n.x * r.y) / 2e0 AS area FROM rg r JOIN rg n ON n.ring = r.ring AND n.place = (r.place + 1) % r.size GROUP BY 1, 2, 3),
lg AS (SELECT label, arg_min(ring, (-size, ring)) AS ring FROM ms GROUP BY 1)"""


def _contours(spark, d):
    return contours.contours(raster.labelled(_part(spark, d)))


@query("region_contours", f"WITH RECURSIVE {_RINGS} SELECT label, size, area FROM ms")
def region_contours(spark, d):
    """Every ring of every region: its length and the area it encloses, less than nothing for holes."""
    return contours.measured(_contours(spark, d)).select("label", "size", F.col("area").cast("double").alias("area"))


@query("longest_contours", f"WITH RECURSIVE {_RINGS} SELECT label, place, x, y FROM rg JOIN lg USING (label, ring)")
def longest_contours(spark, d):
    """Corners in order of each region's longest ring."""
    return contours.longest(_contours(spark, d)).select("label", "place", "x", "y")


_SPLIT = """pt AS MATERIALIZED (SELECT ring, place, x, y FROM rg JOIN lg USING (label, ring) UNION ALL SELECT ring, size, x, y FROM rg JOIN lg USING (label, ring) WHERE place = 0),
dp(ring, lo, hi) AS (SELECT ring, CAST(0 AS BIGINT), max(place) FROM pt GROUP BY 1 UNION ALL SELECT f.ring, CASE s WHEN 0 THEN f.lo ELSE f.mid END, CASE s WHEN 0 THEN f.mid ELSE f.hi END FROM (
  SELECT ring, lo, hi, arg_min(place, (-off, place)) AS mid FROM (SELECT d.ring, d.lo, d.hi, p.place, CASE WHEN a.x = b.x AND a.y = b.y THEN (p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y) ELSE abs((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)) END AS off,
    CASE WHEN a.x = b.x AND a.y = b.y THEN 1e0 ELSE sqrt(CAST((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) AS DOUBLE)) END AS lim
    FROM dp d JOIN pt a ON a.ring = d.ring AND a.place = d.lo JOIN pt b ON b.ring = d.ring AND b.place = d.hi JOIN pt p ON p.ring = d.ring AND p.place > d.lo AND p.place < d.hi) o WHERE off > lim GROUP BY 1, 2, 3) f, (VALUES (0), (1)) v(s))"""


@query("simplified_contours", f"WITH RECURSIVE {_RINGS}, {_SPLIT} SELECT label, place, x, y FROM rg JOIN (SELECT DISTINCT ring, lo AS place FROM dp) k USING (ring, place)")
def simplified_contours(spark, d):
    """The corners that a tolerance of one cell leaves of each region's longest ring."""
    return contours.simplified(contours.longest(_contours(spark, d)), 1.0).select("label", "place", "x", "y")


_RADIUS = 2000.0
_RIM = f"""WITH {src.POINTS_SQL}, m AS MATERIALIZED (SELECT CAST(floor(x_mm / 1000.0) AS BIGINT) AS c, CAST(floor(y_mm / 1000.0) AS BIGINT) AS r, CAST(floor(avg(x_mm)) AS BIGINT) AS x, CAST(floor(avg(y_mm)) AS BIGINT) AS y FROM pts GROUP BY 1, 2),
pr AS (SELECT p.x AS ox, p.y AS oy, q.x AS dx, q.y AS dy, sqrt(CAST((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS DOUBLE)) AS d FROM m p JOIN m q ON (q.x <> p.x OR q.y <> p.y) AND (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) < {4 * int(_RADIUS) ** 2}),
ce AS (SELECT *, sqrt({_RADIUS!r}e0 * {_RADIUS!r}e0 - d * d / 4) / d AS t FROM pr),
ci AS MATERIALIZED (SELECT *, (ox + dx) / 2e0 - (dy - oy) * t AS lx, (oy + dy) / 2e0 + (dx - ox) * t AS ly, (ox + dx) / 2e0 + (dy - oy) * t AS rx, (oy + dy) / 2e0 - (dx - ox) * t AS ry FROM ce),
hits AS (SELECT ox, oy, dx, dy, bool_or((m.x - lx) * (m.x - lx) + (m.y - ly) * (m.y - ly) < {_RADIUS ** 2 * (1 - 1e-9)!r}e0) AS l, bool_or((m.x - rx) * (m.x - rx) + (m.y - ry) * (m.y - ry) < {_RADIUS ** 2 * (1 - 1e-9)!r}e0) AS r
  FROM ci, m WHERE (m.x <> ox OR m.y <> oy) AND (m.x <> dx OR m.y <> dy) GROUP BY 1, 2, 3, 4)
SELECT ox, oy, dx, dy FROM hits WHERE l AND NOT r"""


def _thinned(spark, d):
    at = lambda k: F.floor(F.col(f"{k}_mm") / 1000.0)
    m = src.points(spark, d).groupBy(at("x").alias("c"), at("y").alias("r")).agg(*[F.floor(F.avg(f"{k}_mm")).cast("long").alias(k) for k in "xy"])
    return m.select((F.col("r") * 100_000 + F.col("c")).alias("point_id"), "x", "y")


@query("alpha_edges", _RIM)
def alpha_edges(spark, d):
    """Rim of the alpha shape (0.5) of all points' cells, by empty circles."""
    edges, _ = alpha.rim(_thinned(spark, d), _RADIUS)
    return edges.select("ox", "oy", "dx", "dy")


@query("building_outline")
def building_outline(spark, d):
    return rooms.outline(src.points(spark, d), cell=1000)
