"""The synthetic building: point and plan tables derived from the driver's order lines.

Coordinates are integer millimetres, so sums are exact in any order. Every order line becomes one
point: on the floor for return flag A, else on the wall of its line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# plan walls of the fixture, metres x 1000 (fixed values)
WALLS = [
    (1, 0, 0, 20000, 0), (2, 20000, 0, 20000, 15000), (3, 20000, 15000, 10000, 15000), (4, 10000, 15000, 10000, 10000),
    (5, 10000, 10000, 0, 10000), (6, 0, 10000, 0, 0), (7, 0, 5000, 10000, 5000),
]
# plan labels of the fixture (fixed values)
LABELS = [(1, "Office-A", 5000, 7500), (2, "Office-B", 5000, 2500), (3, "Conf Room", 15000, 7500), (4, "Hallway", 5000, 11000)]
# closed room outlines on the same plan
ROOMS = [
    (1, [(0, 0), (10000, 0), (10000, 5000), (0, 5000)]), (2, [(0, 5000), (10000, 5000), (10000, 10000), (0, 10000)]),
    (3, [(10000, 0), (20000, 0), (20000, 15000), (10000, 15000)]),
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WALLS, "wall int, x0 long, y0 long, x1 long, y1 long")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "label_id long, text string, x_mm long, y_mm long")


def room_edges(spark: SparkSession) -> DataFrame:
    """Outline edges ``(room_id, x0, y0, x1, y1)``, closing edge included."""
    rows = [(r, *a, *b) for r, pts in ROOMS for a, b in zip(pts, [*pts[1:], pts[0]])]
    return spark.createDataFrame(rows, "room_id int, x0 long, y0 long, x1 long, y1 long")


def _of_wall(name: str, at: int):
    out = F.lit(None).cast("long")
    for row in WALLS:
        out = F.when(F.col("l_linenumber") == row[0], F.lit(row[at]).cast("long")).otherwise(out)
    return out.alias(name)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``point_id, scan_id, wall, is_floor, x_mm, y_mm, z_mm, classification, intensity, r, g, b``."""
    lines = load(spark, sf_dir, "lineitem").select(
        F.expr("(((l_orderkey * 1000 + l_partkey % 1000) * 1000 + l_suppkey % 1000) * 8 + l_linenumber) * 64 + cast(l_quantity as bigint)").alias("point_id"),
        F.expr("cast(l_suppkey % 6 as int)").alias("scan_id"), F.col("l_linenumber").alias("wall"), (F.col("l_returnflag") == "A").alias("is_floor"),
        F.expr("(31 * l_orderkey + 17 * l_partkey + 7 * l_linenumber) % 1001").alias("t"), F.expr("cast(round(100 * l_tax) as bigint)").alias("tx"),
        F.expr("cast(round(100 * l_discount) as bigint)").alias("ds"), F.expr("cast(l_quantity as bigint)").alias("q"), "l_orderkey", "l_partkey",
        _of_wall("x0", 1), _of_wall("y0", 2), _of_wall("x1", 3), _of_wall("y1", 4), F.expr("cast(l_extendedprice as bigint)").alias("price"))
    pick = lambda floor, wall: F.when(F.col("is_floor"), F.expr(floor)).otherwise(F.expr(wall))
    return lines.select(
        "point_id", "scan_id", "wall", "is_floor",
        pick("20 * t", "x0 + (x1 - x0) * t div 1000 + 2 * (tx - 4)").alias("x_mm"),
        pick("(13 * l_orderkey + 911 * ds + 101 * q) % 15001", "y0 + (y1 - y0) * t div 1000 + 2 * (ds - 5)").alias("y_mm"),
        pick("tx - 4", "58 * q").alias("z_mm"),
        F.expr("cast(case when l_partkey % 20 < 3 then 6 when l_partkey % 20 = 3 then 7 when l_partkey % 20 = 4 then 18 else l_partkey % 3 end as int)").alias("classification"),
        F.expr("cast(price % 65536 as int)").alias("intensity"), F.expr("cast(l_partkey % 256 as int)").alias("r"),
        F.expr("cast(l_orderkey % 256 as int)").alias("g"), F.expr("cast((l_orderkey + l_partkey) % 256 as int)").alias("b"))


_VALUES = ", ".join(map(str, WALLS))
#: The same mapping as CTEs of DuckDB SQL ending in ``pts``; ``walls`` holds the plan.
POINTS_SQL = f"""walls(wall, x0, y0, x1, y1) AS (SELECT CAST(c0 AS INT), CAST(c1 AS BIGINT), CAST(c2 AS BIGINT), CAST(c3 AS BIGINT), CAST(c4 AS BIGINT) FROM (VALUES {_VALUES}) v(c0, c1, c2, c3, c4)),
l0 AS (SELECT (((l_orderkey * 1000 + l_partkey % 1000) * 1000 + l_suppkey % 1000) * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT) AS point_id, CAST(l_suppkey % 6 AS INT) AS scan_id, l_linenumber AS wall, l_returnflag = 'A' AS is_floor,
  (31 * l_orderkey + 17 * l_partkey + 7 * l_linenumber) % 1001 AS t, CAST(round(100 * l_tax) AS BIGINT) AS tx, CAST(round(100 * l_discount) AS BIGINT) AS ds, CAST(l_quantity AS BIGINT) AS q,
  l_orderkey, l_partkey, CAST(trunc(l_extendedprice) AS BIGINT) AS price FROM lineitem),
pts AS (SELECT point_id, scan_id, l0.wall, is_floor,
  CASE WHEN is_floor THEN 20 * t ELSE x0 + (x1 - x0) * t // 1000 + 2 * (tx - 4) END AS x_mm,
  CASE WHEN is_floor THEN (13 * l_orderkey + 911 * ds + 101 * q) % 15001 ELSE y0 + (y1 - y0) * t // 1000 + 2 * (ds - 5) END AS y_mm,
  CASE WHEN is_floor THEN tx - 4 ELSE 58 * q END AS z_mm,
  CAST(CASE WHEN l_partkey % 20 < 3 THEN 6 WHEN l_partkey % 20 = 3 THEN 7 WHEN l_partkey % 20 = 4 THEN 18 ELSE l_partkey % 3 END AS INT) AS classification,
  CAST(price % 65536 AS INT) AS intensity, CAST(l_partkey % 256 AS INT) AS r, CAST(l_orderkey % 256 AS INT) AS g, CAST((l_orderkey + l_partkey) % 256 AS INT) AS b
  FROM l0 LEFT JOIN walls ON walls.wall = l0.wall)"""


def labels_sql() -> str:
    return "labels_2d(label_id, text, x_mm, y_mm) AS (SELECT CAST(a AS BIGINT), b, CAST(c AS BIGINT), CAST(d AS BIGINT) FROM (VALUES " + ", ".join(f"({i}, '{t}', {x}, {y})" for i, t, x, y in LABELS) + ") v(a, b, c, d))"


def room_edges_sql() -> str:
    rows = [(r, *a, *b) for r, pts in ROOMS for a, b in zip(pts, [*pts[1:], pts[0]])]
    return "edges(room_id, x0, y0, x1, y1) AS (SELECT CAST(a AS INT), CAST(b AS BIGINT), CAST(c AS BIGINT), CAST(d AS BIGINT), CAST(e AS BIGINT) FROM (VALUES " + ", ".join(map(str, rows)) + ") v(a, b, c, d, e))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short wall segments ``(seg_id, x1, y1, x2, y2)`` in millimetres, one per order: jittered
    pieces of plan walls, 500 to a building, buildings 40 m apart; for the segment operators."""
    orders = load(spark, sf_dir, "orders")
    return orders.selectExpr(
        "o_orderkey as seg_id", "cast(o_orderkey % 7 as int) as w", "(o_custkey * 37 + o_orderkey * 11) % 9000 as a", "200 + (o_orderkey * 53) % 1800 as len", "(o_custkey % 41) - 20 as j", "(o_orderkey % 61) - 30 as k",
    ).selectExpr(
        "seg_id", "40000 * (seg_id div 500) + case when w in (0, 2, 4, 6) then a else w * 3000 + j end as x1", "case when w in (0, 2, 4, 6) then w * 2500 + j else a end as y1",
        "40000 * (seg_id div 500) + case when w in (0, 2, 4, 6) then a + len when w = 5 then w * 3000 + j + len else w * 3000 + j + k end as x2", "case when w in (0, 2, 4, 6) then w * 2500 + j + k else a + len end as y2")


SEGMENTS_SQL = """s0 AS (SELECT o_orderkey AS seg_id, CAST(o_orderkey % 7 AS INT) AS w, (o_custkey * 37 + o_orderkey * 11) % 9000 AS a, 200 + (o_orderkey * 53) % 1800 AS len, (o_custkey % 41) - 20 AS j, (o_orderkey % 61) - 30 AS k FROM orders),
segs AS (SELECT seg_id, 40000 * (seg_id // 500) + CASE WHEN w IN (0, 2, 4, 6) THEN a ELSE w * 3000 + j END AS x1, CASE WHEN w IN (0, 2, 4, 6) THEN w * 2500 + j ELSE a END AS y1,
  40000 * (seg_id // 500) + CASE WHEN w IN (0, 2, 4, 6) THEN a + len WHEN w = 5 THEN w * 3000 + j + len ELSE w * 3000 + j + k END AS x2, CASE WHEN w IN (0, 2, 4, 6) THEN w * 2500 + j + k ELSE a + len END AS y2 FROM s0)"""


# corner directions of the outlines and words of the labels of the fixture's drawings (fixed values)
_CORNERS = [(10, 0), (6, 8), (-3, 9), (-9, 4), (-9, -5), (-2, -10), (6, -8)]
_WORDS = ["Office", "Corridor", "WC", "Kitchen", "Meeting", "Plant"]


def drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan drawings as the ``dxf`` source returns them, metres; one for each building of :func:`segments`. Orders
    are LINE entities; in every other drawing some are closed outlines, with their order lines as corners in order; some
    are TEXT or MTEXT entities."""
    segs = segments(spark, sf_dir)
    head = lambda k, e, kind, closed: [F.concat(F.lit("plan-"), F.expr(f"{k} div 500")).alias("file"), F.expr(f"cast({e} as int)").alias("entity"), F.expr(f"{kind}").alias("kind"), F.lit("0").alias("layer"), F.lit(closed).alias("closed")]
    ends = F.posexplode(F.array(*[F.struct((F.col(f"x{i}") / 1000.0).alias("x"), (F.col(f"y{i}") / 1000.0).alias("y")) for i in (1, 2)])).alias("vertex", "p")
    lines = segs.select(*head("seg_id", "3 * seg_id", "'LINE'", False), ends).select("file", "entity", "kind", "layer", "closed", "vertex", "p.x", "p.y", F.lit(None).cast("string").alias("text"))
    widest = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    rooms = segs.where("seg_id % 25 = 0 AND seg_id div 500 % 2 = 0").join(widest, F.col("seg_id") == F.col("l_orderkey"))
    table = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _CORNERS])
    corner = F.element_at(table, F.col("l_linenumber").cast("int"))
    at = lambda k: ((F.col(f"{k}1") + corner[k] * (F.expr("cast(l_quantity as bigint)") + 60)) / 1000.0).alias(k)
    outlines = rooms.select(*head("seg_id", "3 * seg_id + 1", "'LWPOLYLINE'", True), F.col("l_linenumber").cast("int").alias("vertex"), at("x"), at("y"), F.lit(None).cast("string").alias("text"))
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), F.expr("cast(seg_id % 6 + 1 as int)"))
    texts = segs.where("seg_id % 4 = 1").select(
        *head("seg_id", "3 * seg_id + 2", "CASE WHEN seg_id % 8 = 1 THEN 'MTEXT' ELSE 'TEXT' END", False), F.lit(0).alias("vertex"), ((F.col("x1") + 300) / 1000.0).alias("x"), ((F.col("y1") + 200) / 1000.0).alias("y"),
        F.when(F.col("seg_id") % 12 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), word, F.lit(" "), F.col("seg_id"), F.lit("  "))).alias("text"))
    return lines.unionByName(outlines).unionByName(texts)


_CORNERS_SQL = ", ".join(f"({i + 1}, {x}, {y})" for i, (x, y) in enumerate(_CORNERS))
_WORDS_SQL = ", ".join(f"'{w}'" for w in _WORDS)
#: The same drawings as CTEs after SEGMENTS_SQL, ending in ``outline`` (corners of closed polylines) and ``texts``; LINE entities are ``segs``.
DRAWING_SQL = f"""corners(k, dx, dy) AS (VALUES {_CORNERS_SQL}),
outline AS (SELECT 'plan-' || (seg_id // 500) AS file, 3 * seg_id + 1 AS entity, l_linenumber AS vertex, (x1 + dx * (CAST(l_quantity AS BIGINT) + 60)) / 1000e0 AS x, (y1 + dy * (CAST(l_quantity AS BIGINT) + 60)) / 1000e0 AS y FROM segs JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) ON seg_id = l_orderkey JOIN corners ON k = l_linenumber WHERE seg_id % 25 = 0 AND seg_id // 500 % 2 = 0),
texts AS (SELECT 'plan-' || (seg_id // 500) AS file, 3 * seg_id + 2 AS entity, CASE WHEN seg_id % 8 = 1 THEN 'MTEXT' ELSE 'TEXT' END AS kind, (x1 + 300) / 1000e0 AS x, (y1 + 200) / 1000e0 AS y,
  CASE WHEN seg_id % 12 = 1 THEN '' ELSE [{_WORDS_SQL}][seg_id % 6 + 1] || ' ' || seg_id END AS text FROM segs WHERE seg_id % 4 = 1)"""
