"""Alpha shapes of thinned points by empty circles: a point is on the rim where a circle of the radius through it
can be turned about it without holding another point. The arcs its neighbours forbid come from one join by
cells; the gaps between the arcs are the rim, whose edges are chained to rings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import filters, graph, rings

#: angles nearer than this count as one
_HAIR = 1e-9


def gaps(points: DataFrame, radius: float) -> DataFrame:
    """``(point_id, before, after)``: for each point ``(point_id, x, y)`` of distinct places, by building where there is
    such a column, the neighbours between which an empty circle of ``radius`` through the point can turn; null
    where no other point is within twice the radius.

    Every point meets all others within twice the radius: thin the points first (a mean a cell), so that the
    number a point meets is bounded by the cells in that circle."""
    own = filters.own_keys(points)
    cell = 2.0 * radius
    at = lambda c: F.floor(F.col(c) / cell)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = points.select(*own, F.col("point_id").alias("q"), F.col("x").alias("u"), F.col("y").alias("v"), F.explode(around).alias("o"), at("x").alias("gx"), at("y").alias("gy")).select(*own, "q", "u", "v", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    pairs = points.select(*own, "point_id", "x", "y", at("x").alias("gx"), at("y").alias("gy")).join(near, [*own, "gx", "gy"]).where("point_id <> q").withColumns({"dx": F.col("u") - F.col("x"), "dy": F.col("v") - F.col("y")})
    pairs = pairs.withColumn("d", F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))).where(F.col("d") < cell)
    # a neighbour forbids the circles whose centre lies within an arc about its direction
    half = F.acos(F.col("d") / cell)
    start = F.pmod(F.atan2(F.col("dy").cast("double"), F.col("dx").cast("double")) - half, F.lit(2 * math.pi))
    twice = pairs.select(*own, "point_id", "q", start.alias("s"), (2 * half).alias("wide")).select(*own, "point_id", "q", "wide", "s", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    arcs = twice.select(*own, "point_id", "q", "turn", (F.col("s") + F.col("turn") * (2 * math.pi)).alias("s"), (F.col("s") + F.col("turn") * (2 * math.pi) + F.col("wide")).alias("e"))
    w = Window.partitionBy(*own, "point_id").orderBy("s", "e", "q")
    reach = F.max(F.struct("e", "q")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    open_ = arcs.withColumn("r", reach).where((F.col("turn") == 1) & (F.col("s") > F.col("r.e") + _HAIR))
    met = open_.select(*own, "point_id", F.col("r.q").alias("before"), F.col("q").alias("after"))
    alone = points.select(*own, "point_id").join(pairs.select(*own, "point_id").distinct(), [*own, "point_id"], "left_anti")
    return met.unionByName(alone.select(*own, "point_id", F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after")))


def rim(points: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """Edges ``(p, q, ox, oy, dx, dy)`` of the shape, which lies to their left: just one of the circles through both
    ends is empty. And the points ``(point_id)`` that no part of the shape holds: those that are alone, or at
    the ends of edges both of whose circles are empty."""
    own = filters.own_keys(points)
    g = graph.cut(gaps(points, radius))
    ways = g.where("after IS NOT NULL").select(*own, F.col("point_id").alias("p"), F.col("after").alias("q"))
    back = ways.select(*own, F.col("q").alias("p"), F.col("p").alias("q"))
    once = graph.cut(ways.join(back, [*own, "p", "q"], "left_anti"))
    at = lambda i, x, y: points.select(*own, F.col("point_id").alias(i), F.col("x").alias(x), F.col("y").alias(y))
    edges = once.join(at("p", "ox", "oy"), [*own, "p"]).join(at("q", "dx", "dy"), [*own, "q"])
    held = once.select(*own, F.explode(F.array("p", "q")).alias("point_id")).distinct()
    return edges, g.select(*own, "point_id").distinct().join(held, [*own, "point_id"], "left_anti")


def shape_rings(edges: DataFrame, few: int = graph.FEW) -> DataFrame:
    """``(ring, place, size, ox, oy, dx, dy)``: the edges of :func:`rim` in rings, a ring from its smallest point on. At a
    point where the shape touches itself a ring goes on along the part it came by."""
    own = filters.own_keys(edges)
    e = graph.cut(edges.orderBy(*own, "p", "q").withColumn("id", F.monotonically_increasing_id()))
    turn = lambda x, y, u, v: F.atan2((F.col(v) - F.col(y)).cast("double"), (F.col(u) - F.col(x)).cast("double"))
    # about a point, what comes in is followed counter-clockwise, past the gap, by what goes out
    fan = e.select(*own, F.col("q").alias("p"), turn("dx", "dy", "ox", "oy").alias("a"), "id", F.lit(True).alias("comes")).unionByName(e.select(*own, "p", turn("ox", "oy", "dx", "dy").alias("a"), "id", F.lit(False).alias("comes")))
    w = Window.partitionBy(*own, "p").orderBy("a", "comes")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("id", "comes")
    steps = fan.withColumn("n", F.coalesce(F.lead(row).over(w), F.first(row).over(whole))).where("comes AND NOT n.comes").select("id", F.col("n.id").alias("next"))
    return e.join(rings.cycles(steps, few), "id").select(*own, "ring", "place", "size", "ox", "oy", "dx", "dy")


def ring_areas(sides: DataFrame) -> DataFrame:
    """``(ring, area)``; negative for holes. Sums are taken about the ring's box, so that large places keep their digits."""
    own = filters.own_keys(sides)
    box = sides.groupBy(*own, "ring").agg(F.min("ox").alias("x0"), F.min("oy").alias("y0"))
    cross = F.expr("(ox - x0) * (dy - y0) - (dx - x0) * (oy - y0)")
    return sides.join(box, [*own, "ring"]).groupBy(*own, "ring").agg((F.sum(cross) / 2).alias("area"))


def alpha_ring(points: DataFrame, radius: float, share: float = 0.9) -> DataFrame:
    """``(ring, place, ox, oy)``: the outer ring of the shape of each building whose shape has just one, and holds at
    least ``share`` of its points."""
    own = filters.own_keys(points)
    edges, lost = rim(points, radius)
    sides = graph.cut(shape_rings(edges))
    facts = ring_areas(sides).where("area > 0").groupBy(*own).agg(F.min("ring").alias("ring"), F.count("*").alias("_parts"))
    n = points.groupBy(*own).agg(F.count("*").alias("_all"))
    out = lost.groupBy(*own).agg(F.count("*").alias("_lost"))
    if own:
        sizes = n.join(out, own, "left")
        good = facts.join(sizes, own)
    else:
        good = filters.with_scalar(filters.with_scalar(facts, n), out)
    good = good.where((F.col("_parts") == 1) & (F.coalesce("_lost", F.lit(0)) <= (1 - share) * F.col("_all"))).select("ring")
    return sides.join(good, "ring", "left_semi").select(*own, "ring", "place", "ox", "oy")
