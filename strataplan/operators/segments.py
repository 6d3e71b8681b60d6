"""Line segments: PCA lines, snapping, merging, sampling, edges of polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .filters import angle_deg, circular_diff, dominant_angle, length_mm, with_scalar


def pca_lines(points: DataFrame, key: str, least_points: int = 10, least_length: float = 200.0) -> DataFrame:
    """One line per key along the first principal axis, ends at the extreme projections. The axis
    has the closed form atan2(2 cov, var x - var y) / 2, so two aggregations do; their inputs are
    integers, whose sums do not depend on order."""
    x, y = F.col("x_mm"), F.col("y_mm")
    wide = lambda c: F.sum(c.cast("decimal(38,0)")).cast("double")
    s = points.groupBy(key).agg(F.count("*").alias("n"), F.avg("x_mm").alias("cx"), F.avg("y_mm").alias("cy"), F.sum("x_mm").cast("double").alias("sx"), F.sum("y_mm").cast("double").alias("sy"), wide(x * x).alias("xx"), wide(y * y).alias("yy"), wide(x * y).alias("xy"))
    n = F.col("n")
    t = F.lit(0.5) * F.atan2(2 * (F.col("xy") - F.col("sx") * F.col("sy") / n) / n, (F.col("xx") - F.col("sx") * F.col("sx") / n) / n - (F.col("yy") - F.col("sy") * F.col("sy") / n) / n)
    axes = s.select(key, "n", "cx", "cy", t.alias("t"))
    along = (x - F.col("cx")) * F.cos("t") + (y - F.col("cy")) * F.sin("t")
    ends = points.join(axes, key).groupBy(key, "n", "cx", "cy", "t").agg(F.min(along).alias("lo"), F.max(along).alias("hi"))
    keep = ends.where((F.col("n") >= least_points) & (F.col("hi") - F.col("lo") >= least_length))
    at = lambda c, f, e: F.col(c) + F.col(e) * f("t")
    return keep.select(key, "n", "t", at("cx", F.cos, "lo").alias("x1"), at("cy", F.sin, "lo").alias("y1"), at("cx", F.cos, "hi").alias("x2"), at("cy", F.sin, "hi").alias("y2"))


def manhattan_snap(segments: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """Segments near the dominant (length-weighted) orientation or across it, turned onto it about
    their centre; the input as it is where none is near."""
    a, peak = angle_deg(), F.col("dominant")
    across = F.pmod(peak + 90.0, F.lit(180.0))
    target = F.when(circular_diff(a, peak) <= tolerance, peak).when(circular_diff(a, across) <= tolerance, across)
    marked = with_scalar(segments, dominant_angle(segments, weighted=True)).withColumn("_to", target)
    some = marked.agg(F.bool_or(F.col("_to").isNotNull()).alias("_some"))
    rows = with_scalar(marked, some).where(F.col("_to").isNotNull() | ~F.col("_some"))
    half = length_mm() / 2.0
    mx, my = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    dx, dy = F.cos(F.radians("_to")) * half, F.sin(F.radians("_to")) * half
    as_is = F.col("_to").isNull()
    put = lambda old, new: F.when(as_is, F.col(old).cast("double")).otherwise(new)
    return rows.select("seg_id", put("x1", mx - dx).alias("x1"), put("y1", my - dy).alias("y1"), put("x2", mx + dx).alias("x2"), put("y2", my + dy).alias("y2"))


def _direction(p: str) -> tuple[Column, Column]:
    dx, dy = F.col(f"{p}x2") - F.col(f"{p}x1"), F.col(f"{p}y2") - F.col(f"{p}y1")
    n = F.greatest(F.sqrt((dx * dx + dy * dy).cast("double")), F.lit(1e-9))
    return dx / n, dy / n


def collinear_pairs(segments: DataFrame, angle: float = 3.0, off: float = 50.0, gap: float = 300.0) -> DataFrame:
    """``(a_id, b_id)``, a_id < b_id, of segments that may be one: orientations within ``angle``,
    b's centre within ``off`` of a's line, and a gap of at most ``gap`` along it.

    The join is on a grid: mergeable segments of a have a point within reach of b's, so both are
    put into the cells their boxes (a's grown by gap + off) touch; orientation is tested exactly."""
    cell = 1000
    reach = gap + off

    def cells(df: DataFrame, grow: float) -> DataFrame:
        lo, hi = (lambda k: F.floor((F.least(f"{k}1", f"{k}2") - grow) / cell)), (lambda k: F.floor((F.greatest(f"{k}1", f"{k}2") + grow) / cell))
        return df.withColumns({"lx": lo("x"), "ly": lo("y")}).withColumn("gx", F.explode(F.sequence("lx", hi("x")))).withColumn("gy", F.explode(F.sequence("ly", hi("y"))))

    # what follows from the ends is made again after the join, so that narrow rows move; but for the angle, which is dear
    cols = ["seg_id", "x1", "y1", "x2", "y2", "ang"]
    base = segments.select("seg_id", "x1", "y1", "x2", "y2").withColumn("ang", F.round(angle_deg(), 6))
    a = cells(base, reach).select(*[F.col(c).alias(f"a_{c}") for c in cols], "gx", "gy")
    b = cells(base, 0.0).select(*[F.col(c).alias(f"b_{c}") for c in cols], "gx", "gy")
    first = lambda p, k, grow: F.floor((F.least(f"{p}{k}1", f"{p}{k}2") - grow) / cell)
    once = (F.col("gx") == F.greatest(first("a_", "x", reach), first("b_", "x", 0.0))) & (F.col("gy") == F.greatest(first("a_", "y", reach), first("b_", "y", 0.0)))
    alike = circular_diff(F.col("a_ang"), F.col("b_ang")) <= angle
    # boxes share a rectangle of cells; the pair is tested in its first cell only
    met = a.join(b, ["gx", "gy"]).where("a_seg_id < b_seg_id").where(once & alike)
    ux, uy = _direction("a_")
    met = met.withColumns({"a_ux": ux, "a_uy": uy})
    mid = lambda p, k: (F.col(f"{p}{k}1") + F.col(f"{p}{k}2")) / 2.0
    ux, uy = F.col("a_ux"), F.col("a_uy")
    perp = F.abs((mid("b_", "x") - mid("a_", "x")) * -uy + (mid("b_", "y") - mid("a_", "y")) * ux)
    t = lambda k: (F.col(f"b_x{k}") - F.col("a_x1")) * ux + (F.col(f"b_y{k}") - F.col("a_y1")) * uy
    end = (F.col("a_x2") - F.col("a_x1")) * ux + (F.col("a_y2") - F.col("a_y1")) * uy
    between = F.greatest(F.least(t(1), t(2)) - end, -F.greatest(t(1), t(2)), F.lit(0.0))
    near = (F.round(perp, 6) <= off) & (F.round(between, 6) <= gap)
    return met.where(near).select(F.col("a_seg_id").alias("a_id"), F.col("b_seg_id").alias("b_id"))


def merged(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """One segment for each component of the pairs: length-weighted direction (turned to agree
    with the first member) and centre, ends at the extreme projections; ``total`` is the members' length."""
    comp = graph.components(pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    s = segments.join(comp.withColumnRenamed("node", "seg_id"), "seg_id", "left").withColumn("component", F.coalesce("component", "seg_id"))
    length = length_mm()
    s = s.withColumns({"len": length, "dx": (F.col("x2") - F.col("x1")) / F.greatest(length, F.lit(1e-9)), "dy": (F.col("y2") - F.col("y1")) / F.greatest(length, F.lit(1e-9))})
    first = s.groupBy("component").agg(F.min(F.struct("seg_id", "dx", "dy")).alias("f")).select("component", F.col("f.dx").alias("fx"), F.col("f.dy").alias("fy"))
    s = s.join(first, "component")
    sign = F.when(F.col("dx") * F.col("fx") + F.col("dy") * F.col("fy") < 0, -1.0).otherwise(1.0)  # a square member keeps its sign
    w = F.col("len")
    means = s.groupBy("component").agg(
        F.count("*").alias("members"), F.sum("len").alias("total"), F.sum(sign * F.col("dx") * w).alias("ux"), F.sum(sign * F.col("dy") * w).alias("uy"),
        (F.sum((F.col("x1") + F.col("x2")) / 2.0 * w) / F.sum(w)).alias("cx"), (F.sum((F.col("y1") + F.col("y2")) / 2.0 * w) / F.sum(w)).alias("cy"))
    n = F.greatest(F.sqrt(F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")), F.lit(1e-9))
    means = means.withColumns({"ux": F.col("ux") / n, "uy": F.col("uy") / n})
    t = lambda i: (F.col(f"x{i}") - F.col("cx")) * F.col("ux") + (F.col(f"y{i}") - F.col("cy")) * F.col("uy")
    ends = s.join(means, "component").groupBy("component", "members", "total", "ux", "uy", "cx", "cy").agg(F.min(F.least(t(1), t(2))).alias("lo"), F.max(F.greatest(t(1), t(2))).alias("hi"))
    at = lambda c, u, e: F.col(c) + F.col(u) * F.col(e)
    return ends.select(F.col("component").alias("seg_id"), "members", "total", at("cx", "ux", "lo").alias("x1"), at("cy", "uy", "lo").alias("y1"), at("cx", "ux", "hi").alias("x2"), at("cy", "uy", "hi").alias("y2"))


def regularise(segments: DataFrame, drop_below: float = 500.0, snap: bool = True, merge: bool = True) -> DataFrame:
    """Drop short segments, snap to the two main directions, merge collinear ones."""
    from .filters import drop_short

    out = drop_short(segments, drop_below).select("seg_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    if snap:
        out = manhattan_snap(out)
    if merge:
        out = merged(out, collinear_pairs(out)).drop("members", "total")
    return out


def crossings(segments: DataFrame, cell: int = 2000, by: str | None = None) -> DataFrame:
    """``(a_id, b_id, ta, tb, x, y)`` for segments that cross or touch, a_id < b_id: where, as shares of
    their lengths and as a point. Segments meet in the grid cells of their boxes; parallel ones, also
    on one line, do not cross. With ``by`` only segments of one group meet."""
    at = lambda v: F.floor(v / float(cell))
    reach = lambda a, b: F.explode(F.sequence(at(F.least(a, b)), at(F.greatest(a, b))))
    placed = segments.select("seg_id", *([F.col(by).alias("_by")] if by else []), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], reach(F.col("x1"), F.col("x2")).alias("cx")).withColumn("cy", reach(F.col("y1"), F.col("y2")))
    same = ["cx", "cy", *(["_by"] if by else [])]
    side = lambda p: placed.select(*same, F.col("seg_id").alias(f"{p}_id"), *[F.col(c).alias(p + c) for c in ("x1", "y1", "x2", "y2")])
    e = F.expr
    pairs = side("a").join(side("b"), same).where("a_id < b_id").withColumn("den", e("(ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1)")).where("den <> 0")
    pairs = pairs.withColumn("ta", e("((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / den")).withColumn("tb", e("((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / den"))
    hit = pairs.where("ta BETWEEN 0 AND 1 AND tb BETWEEN 0 AND 1").select("a_id", "b_id", "ta", "tb", e("ax1 + (ax2 - ax1) * ta").alias("x"), e("ay1 + (ay2 - ay1) * ta").alias("y"))
    return hit.groupBy("a_id", "b_id").agg(*[F.first(c).alias(c) for c in ("ta", "tb", "x", "y")])


def valid_rings(edges: DataFrame, key: str = "room_id", least_m2: float = 0.1) -> DataFrame:
    """``(key, area_m2)`` of the rings ``edges(key, x0, y0, x1, y1)`` of at least an area that do not cross
    themselves. Neighbouring edges touch at their common corner, which is no crossing."""
    named = edges.withColumnRenamed("x1", "x2").withColumnRenamed("y1", "y2").withColumnRenamed("x0", "x1").withColumnRenamed("y0", "y1").withColumn("seg_id", F.xxhash64(key, "x1", "y1", "x2", "y2"))
    inner = crossings(named, by=key).where("(ta > 0 AND ta < 1) OR (tb > 0 AND tb < 1)")
    crossed = named.join(inner.select(F.col("a_id").alias("seg_id")), "seg_id", "left_semi").select(key).distinct()
    area = F.abs(F.sum(F.expr("x0 * y1 - x1 * y0"))) / F.lit(2e6)
    return edges.groupBy(key).agg(area.alias("area_m2")).where(F.col("area_m2") >= least_m2).join(crossed, key, "left_anti")


def noded(segments: DataFrame, cell: int = 2000) -> DataFrame:
    """Segments split where they cross or touch: ``(seg_id, k, x1, y1, x2, y2)``."""
    met = crossings(segments, cell)
    cuts = met.select(F.col("a_id").alias("seg_id"), F.col("ta").alias("t")).unionByName(met.select(F.col("b_id").alias("seg_id"), F.col("tb").alias("t")))
    cuts = cuts.where("t > 0 AND t < 1").groupBy("seg_id").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    ends = segments.join(cuts, "seg_id", "left").withColumn("ts", F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    parts = ends.select("*", F.posexplode(F.slice("ts", F.lit(2), F.size("ts") - 1)).alias("k", "t1")).withColumn("t0", F.get("ts", F.col("k")))
    point = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    return parts.select("seg_id", "k", *[point(a, b, t).alias(n) for n, a, b, t in (("x1", "x1", "x2", "t0"), ("y1", "y1", "y2", "t0"), ("x2", "x1", "x2", "t1"), ("y2", "y1", "y2", "t1"))])


def sampled(segments: DataFrame, step: int = 50) -> DataFrame:
    """Points along each segment: max(2, length div step) + 1 of them; one for a degenerate one."""
    n = F.when(length_mm() < 1e-9, F.lit(0)).otherwise(F.greatest(F.lit(2), F.floor(length_mm() / step).cast("int")))
    k = segments.withColumn("_n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    f = F.when(F.col("_n") == 0, 0.0).otherwise(F.col("i") / F.col("_n"))
    return k.select("seg_id", "i", (F.col("x1") + (F.col("x2") - F.col("x1")) * f).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * f).alias("y"))


def polyline_edges(vertices: DataFrame, key: str, order: str, closed: bool) -> DataFrame:
    """Consecutive vertex pairs of polylines ``(key, order, x, y)``; the closing edge if closed."""
    w = Window.partitionBy(key).orderBy(order)
    start = [F.first("x").over(w), F.first("y").over(w)]
    nxt = [F.lead(c).over(w) for c in ("x", "y")]
    ends = [F.coalesce(n, s) if closed else n for n, s in zip(nxt, start)]
    out = vertices.select(key, order, F.col("x").alias("x0"), F.col("y").alias("y0"), ends[0].alias("x1"), ends[1].alias("y1"))
    return out if closed else out.where("x1 is not null")
