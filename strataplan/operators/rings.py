"""Rings and faces of line work, as joins: pointer doubling over "next" pointers, half-edges ordered by
angle, holes put into the faces around them. Coordinates are snapped to a grid and compared as integers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, spatial


def _at_once(f: pd.DataFrame) -> pd.DataFrame:
    """:func:`cycles` of few rows, in place."""
    f = f.sort_values("id", ignore_index=True)
    ids, nxt = f["id"].to_numpy(np.int64), f["next"]
    n = len(ids)
    to = np.searchsorted(ids, nxt.fillna(0).to_numpy(np.int64))
    lost = nxt.isna().to_numpy() | (to >= n) | (ids[np.minimum(to, n - 1)] != nxt.fillna(0).to_numpy(np.int64))
    ptr = np.append(np.where(lost, n, to), n)  # position n: past the end of an open chain
    best, off, span = np.arange(n + 1), np.zeros(n + 1, np.int64), 1
    while span < 2 * n:
        less = best[ptr] < best
        best, off = np.where(less, best[ptr], best), np.where(less, span + off[ptr], off)
        ptr, span = ptr[ptr], 2 * span
    closed = np.flatnonzero(ptr[:n] < n)
    size = np.bincount(best[closed], minlength=n + 1)[best[closed]]
    return pd.DataFrame({"id": ids[closed], "ring": ids[best[closed]], "place": (size - off[closed]) % size, "size": size})


def cycles(steps: DataFrame, few: int = graph.FEW) -> DataFrame:
    """``(id, ring, place, size)`` of the rows ``steps(id, next)`` that lie on a closed ring: ``ring`` is its
    smallest id, ``place`` the number of steps from there. No two rows have the same ``next``; rows of open
    chains are left out.

    Pointers double twice a round, so a ring of n rows takes log4(n) rounds. A row keeps the smallest id ahead of
    it and how far ahead that is; when a doubling finds no smaller one for any row, all rings are closed. At most
    ``few`` rows, which are counted, are one task's work."""
    steps = graph.cut(steps.select("id", "next"))
    if graph.is_few(steps, few):
        return steps.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda f: _at_once(f), "id long, ring long, place long, size long")
    cur = graph.cut(steps.select("id", F.col("next").alias("ptr"), F.col("id").alias("best"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("moved")))
    span = 1
    while cur.where("moved").take(1):
        nxt = graph.cut(_doubled(_doubled(cur, span), 2 * span))
        graph.drop(cur)
        cur, span = nxt, 4 * span
    # an open chain's pointers have run off its end: all of them, once the span reaches its length
    closed = cur.where("ptr IS NOT NULL")
    sizes = closed.groupBy("best").agg(F.count("*").alias("size"))
    return closed.join(sizes, "best").select("id", F.col("best").alias("ring"), F.pmod(F.col("size") - F.col("off"), F.col("size")).alias("place"), "size")


def _doubled(cur: DataFrame, span: int) -> DataFrame:
    """Pointers to where the pointers' own pointers lead, ``span`` steps on each."""
    ahead = cur.select(F.col("id").alias("_id"), F.col("ptr").alias("_ptr"), F.col("best").alias("_best"), F.col("off").alias("_off"))
    less = F.coalesce(F.col("_best") < F.col("best"), F.lit(False))
    return cur.join(ahead, F.col("ptr") == F.col("_id"), "left").select(
        "id", F.col("_ptr").alias("ptr"), F.when(less, F.col("_best")).otherwise(F.col("best")).alias("best"), F.when(less, F.col("_off") + F.lit(span).cast("long")).otherwise(F.col("off")).alias("off"), less.alias("moved"))


def _walked(segments: DataFrame, cell: float) -> DataFrame:
    """A row for each grid cell ``(_gx, _gy)`` that a segment passes: column by column, the rows between
    where the line enters and leaves (a hair wider)."""
    at = lambda v: F.floor(v / cell)
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    s = segments.withColumn("_gx", F.explode(F.sequence(at(lo), at(hi))))
    flat = F.col("x1") == F.col("x2")
    y = lambda x: F.when(flat, F.col("y1")).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * ((x - F.col("x1")) / F.when(flat, F.lit(None)).otherwise(F.col("x2") - F.col("x1"))))
    ya, yb = y(F.greatest(lo, F.col("_gx") * F.lit(cell))), F.when(flat, F.col("y2")).otherwise(y(F.least(hi, (F.col("_gx") + 1) * F.lit(cell))))
    return s.withColumns({"_ya": ya, "_yb": yb}).withColumn("_gy", F.explode(F.sequence(at(F.least("_ya", "_yb") - cell * 1e-6), at(F.greatest("_ya", "_yb") + cell * 1e-6)))).drop("_ya", "_yb")


def cuts(segments: DataFrame, cell: float = 2000.0) -> DataFrame:
    """``(seg_id, t, x, y)``: where segments ``(by, seg_id, x1, y1, x2, y2)`` of one group ``by`` are met by others,
    t in 0..1: crossings, touches, and ends of others on the same line. The point is the same for both segments
    of a pair: an end where an end is met, else computed on the one of smaller id."""
    placed = _walked(segments, float(cell))
    side = lambda p: placed.select("by", "_gx", "_gy", F.col("seg_id").alias(f"{p}_id"), *[F.col(c).alias(p + c) for c in ("x1", "y1", "x2", "y2")])
    e = F.expr
    pairs = side("a").join(side("b"), ["by", "_gx", "_gy"]).where("a_id <> b_id").drop("_gx", "_gy").distinct()
    pairs = pairs.withColumn("den", e("(ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1)"))
    # both orders of a pair see the quantities of the pair with the smaller id first
    first = F.col("a_id") < F.col("b_id")
    own = e("((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / den")
    other = e("((bx1 - ax1) * (ay2 - ay1) - (by1 - ay1) * (ax2 - ax1)) / den")
    met = pairs.where("den <> 0").withColumns({"ta": own, "tb": other}).where("ta BETWEEN 0 AND 1 AND tb BETWEEN 0 AND 1")
    point = lambda k: F.when(F.col("ta") == 0, F.col(f"a{k}1")).when(F.col("ta") == 1, F.col(f"a{k}2")).when(F.col("tb") == 0, F.col(f"b{k}1")).when(F.col("tb") == 1, F.col(f"b{k}2")).when(
        first, e(f"a{k}1 + (a{k}2 - a{k}1) * ta")).otherwise(e(f"b{k}1 + (b{k}2 - b{k}1) * tb"))
    out = met.select(F.col("by"), F.col("a_id").alias("seg_id"), F.col("ta").alias("t"), point("x").alias("x"), point("y").alias("y"))
    # on one line: the other's ends
    line = pairs.where("den = 0 AND (bx1 - ax1) * (ay2 - ay1) = (by1 - ay1) * (ax2 - ax1) AND (ax1 <> ax2 OR ay1 <> ay2)")
    ends = line.select("*", F.explode(F.array(*[F.struct(F.col(f"bx{i}").alias("x"), F.col(f"by{i}").alias("y")) for i in (1, 2)])).alias("p"))
    t = e("CASE WHEN abs(ax2 - ax1) >= abs(ay2 - ay1) THEN (p.x - ax1) / (ax2 - ax1) ELSE (p.y - ay1) / (ay2 - ay1) END")
    return out.unionByName(ends.select("by", F.col("a_id").alias("seg_id"), t.alias("t"), "p.x", "p.y")).where("t > 0 AND t < 1")


def edges(segments: DataFrame, cell: float = 2000.0, snap: float = 0.001) -> DataFrame:
    """The distinct pieces ``(by, ax, ay, bx, by_)`` of segments cut where they meet, on a grid of ``snap``;
    the smaller end first."""
    at = lambda v: F.round(v / snap).cast("long")
    met = cuts(segments, cell).groupBy("by", "seg_id").agg(F.array_sort(F.collect_set(F.struct("t", at(F.col("x")).alias("x"), at(F.col("y")).alias("y")))).alias("met"))
    end = lambda i: F.array(F.struct(F.lit(float(i - 1)).alias("t"), at(F.col(f"x{i}")).alias("x"), at(F.col(f"y{i}")).alias("y")))
    whole = segments.join(met, ["by", "seg_id"], "left").withColumn("p", F.concat(end(1), F.coalesce("met", F.array().cast("array<struct<t:double,x:bigint,y:bigint>>")), end(2)))
    xy = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    parts = whole.select("by", F.explode(F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.struct(xy(a).alias("a"), xy(b).alias("b")))).alias("s"))
    low, high = F.least("s.a", "s.b"), F.greatest("s.a", "s.b")
    return _apart(parts.where("s.a <> s.b").select("by", low["x"].alias("ax"), low["y"].alias("ay"), high["x"].alias("bx"), high["y"].alias("by_")).distinct())


def _apart(pieces: DataFrame) -> DataFrame:
    """Pieces that came to lie on each other on the grid: of two that leave a corner in one direction the longer
    becomes what is beyond the shorter, until none is left."""
    cur = graph.cut(pieces)
    while True:
        ends = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(names, ("ox", "oy", "dx", "dy"))]) for names in (("ax", "ay", "bx", "by_"), ("bx", "by_", "ax", "ay"))])
        half = cur.select("*", F.explode(ends).alias("h")).select("by", "ax", "ay", "bx", "by_", "h.*").withColumns({"u": F.col("dx") - F.col("ox"), "v": F.col("dy") - F.col("oy")})
        turn = Window.partitionBy("by", "ox", "oy").orderBy(F.atan2(F.col("v").cast("double"), F.col("u").cast("double")), F.col("u") * F.col("u") + F.col("v") * F.col("v"))
        half = half.withColumn("p", F.lag(F.struct("u", "v", "dx", "dy")).over(turn))
        over = graph.cut(half.where("p.u * v = p.v * u AND p.u * u + p.v * v > 0 AND p.u * p.u + p.v * p.v < u * u + v * v").select("by", "ax", "ay", "bx", "by_", F.struct("p.dx", "p.dy").alias("s"), F.struct("dx", "dy").alias("t")))
        if not over.take(1):
            return cur
        low, high = F.least("s", "t"), F.greatest("s", "t")
        rest = over.select("by", low["dx"].alias("ax"), low["dy"].alias("ay"), high["dx"].alias("bx"), high["dy"].alias("by_"))
        cur = graph.cut(cur.join(over.select("by", "ax", "ay", "bx", "by_"), ["by", "ax", "ay", "bx", "by_"], "left_anti").unionByName(rest).distinct())


def _halves(numbered: DataFrame) -> DataFrame:
    """Both directions ``(by, id, ox, oy, dx, dy)`` of the edges; the other direction of id is id ^ 1."""
    both = F.array(*[F.struct((F.col("e") * 2 + i).alias("id"), *[F.col(c).alias(n) for c, n in zip(names, ("ox", "oy", "dx", "dy"))]) for i, names in enumerate((("ax", "ay", "bx", "by_"), ("bx", "by_", "ax", "ay")))])
    return numbered.select("by", F.explode(both).alias("h")).select("by", "h.*")


def _steps(halves: DataFrame) -> DataFrame:
    """``(id, next)``: at its end an edge goes on with the next one clockwise, so that faces lie to the left."""
    fan = Window.partitionBy("by", "ox", "oy").orderBy(F.atan2((F.col("dy") - F.col("oy")).cast("double"), (F.col("dx") - F.col("ox")).cast("double")), "id")
    last = F.last("id").over(fan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return halves.select(F.col("id").bitwiseXOR(F.lit(1).cast("long")).alias("id"), F.coalesce(F.lag("id").over(fan), last).alias("next"))


def shoelace(x0="ox", y0="oy", x1="dx", y1="dy") -> Column:
    return F.col(x0) * F.col(y1) - F.col(x1) * F.col(y0)


#: segments of a group that one task takes at once; they have at most as many pieces as their square
GROUP = 1000


def faces(segments: DataFrame, cell: float = 2000.0, snap: float = 0.001, least: float = 0.0, group: int = GROUP) -> DataFrame:
    """``(by, face, hole, place, ox, oy, dx, dy)``: the edges of the bounded faces that the segments of each group
    ``by`` enclose, of an area above ``least``, in the units of the input. Edges run with the face to their left; those of holes
    (``hole`` is theirs, else null) run the other way. Dangling edges and bridges bound no face: they have one
    walk on both sides and are taken out first.

    Segments move once, to their group, where it has at most ``group`` of them, which are counted; larger groups go by
    joins. ``segments`` is read twice, and should be stored where it is dear."""
    s = segments.select("by", "seg_id", "x1", "y1", "x2", "y2").dropna()
    large = graph.cut(s.groupBy("by").agg(F.count("*").alias("_n")).where(F.col("_n") > group).select("by"))
    kind = s.schema["by"].dataType.simpleString()
    told = lambda df: df.groupBy("by").applyInArrow(lambda t: _group_faces(t, snap, least), f"by {kind}, face long, hole long, place long, ox double, oy double, dx double, dy double")
    if not large.take(1):
        return told(s)
    return told(s.join(large, "by", "left_anti")).unionByName(_joined_faces(s.join(large, "by", "left_semi").distinct(), cell, snap, least))


def _snapped(v: np.ndarray, snap: float) -> np.ndarray:
    """As SQL's round: halves go away from zero."""
    w = np.abs(v / snap)
    return (np.sign(v) * (np.trunc(w) + (w - np.trunc(w) >= 0.5))).astype(np.int64)


def _group_pieces(ids: np.ndarray, ends: np.ndarray, snap: float) -> np.ndarray:
    """:func:`edges` of one group, before :func:`_apart`: rows ax, ay, bx, by."""
    x1, y1, x2, y2 = ends.T
    lx, hx, ly, hy = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    over = lambda lo, hi: (hi[:, None] >= lo) & (lo[:, None] <= hi)
    a, b = np.nonzero(over(lx, hx) & over(ly, hy) & (ids[:, None] != ids))
    ux, uy, vx, vy, wx, wy = x2[a] - x1[a], y2[a] - y1[a], x2[b] - x1[b], y2[b] - y1[b], x1[b] - x1[a], y1[b] - y1[a]
    den = ux * vy - uy * vx
    with np.errstate(all="ignore"):
        ta, tb = (wx * vy - wy * vx) / den, (wx * uy - wy * ux) / den
    met = (den != 0) & (ta > 0) & (ta < 1) & (tb >= 0) & (tb <= 1)  # an own end is no cut
    line = np.repeat(np.flatnonzero((den == 0) & (wx * uy == wy * ux) & ((ux != 0) | (uy != 0))), 2)
    i, j, ta, tb = a[met], b[met], ta[met], tb[met]
    point = lambda p, q: np.select([tb == 0, tb == 1, ids[i] < ids[j]], [p[j], q[j], p[i] + (q[i] - p[i]) * ta], p[j] + (q[j] - p[j]) * tb)
    k, turn = a[line], np.arange(len(line)) % 2 == 0
    px, py = np.where(turn, x1[b[line]], x2[b[line]]), np.where(turn, y1[b[line]], y2[b[line]])
    wide = np.abs(x2[k] - x1[k]) >= np.abs(y2[k] - y1[k])
    with np.errstate(all="ignore"):
        at = np.where(wide, (px - x1[k]) / (x2[k] - x1[k]), (py - y1[k]) / (y2[k] - y1[k]))
    inner, own = (at > 0) & (at < 1), np.arange(len(ids))
    seg = np.concatenate([own, own, i, k[inner]])
    t = np.concatenate([np.zeros(len(ids)), np.ones(len(ids)), ta, at[inner]])
    x = _snapped(np.concatenate([x1, x2, point(x1, x2), px[inner]]), snap)
    y = _snapped(np.concatenate([y1, y2, point(y1, y2), py[inner]]), snap)
    order = np.lexsort((y, x, t, seg))
    p = np.stack([x, y], 1)[order]
    step = np.hstack([p[:-1], p[1:]])[(seg[order][:-1] == seg[order][1:]) & (p[:-1] != p[1:]).any(1)]
    return _low_first(step)


def _low_first(e: np.ndarray) -> np.ndarray:
    turn = (e[:, 0] > e[:, 2]) | (e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3])
    return np.unique(np.where(turn[:, None], e[:, [2, 3, 0, 1]], e), axis=0)


def _fan(half: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-edges ox, oy, dx, dy by corner, angle and ``last``, and where a corner begins in that order."""
    turn = np.arctan2((half[:, 3] - half[:, 1]).astype(float), (half[:, 2] - half[:, 0]).astype(float))
    order = np.lexsort((last, turn, half[:, 1], half[:, 0]))
    o = half[order, :2]
    return order, np.append(True, (o[1:] != o[:-1]).any(1))[:len(o)]


def _group_apart(e: np.ndarray) -> np.ndarray:
    """:func:`_apart` of one group."""
    while True:
        half = np.vstack([e, e[:, [2, 3, 0, 1]]])
        w = half[:, 2:] - half[:, :2]
        order, new = _fan(half, (w * w).sum(1))
        p, q = w[order][:-1], w[order][1:]
        over = np.flatnonzero(~new[1:] & (p[:, 0] * q[:, 1] == p[:, 1] * q[:, 0]) & ((p * q).sum(1) > 0) & ((p * p).sum(1) < (q * q).sum(1)))
        if not len(over):
            return e
        rest = np.hstack([half[order[over], 2:], half[order[over + 1], 2:]])
        e = _low_first(np.vstack([np.delete(e, order[over + 1] % len(e), 0), rest]))


def _group_rings(half: np.ndarray) -> pd.DataFrame:
    """The rings of half-edges, of which the other direction of i is i ^ 1, in their order."""
    order, new = _fan(half, np.arange(len(half)))
    first = np.flatnonzero(new)
    before = np.append(0, order[:-1])
    before[first] = order[np.append(first[1:], len(order)) - 1]
    return _at_once(pd.DataFrame({"id": order ^ 1, "next": before}))


def _group_faces(table: pa.Table, snap: float, least: float) -> pa.Table:
    """:func:`faces` of one group, all in place."""
    column = lambda c: table[c].to_numpy()
    e = _group_apart(_group_pieces(column("seg_id"), np.stack([column(c).astype(float) for c in ("x1", "y1", "x2", "y2")], 1), snap))
    both = lambda e: np.stack([e, e[:, [2, 3, 0, 1]]], 1).reshape(-1, 4)
    if len(e):
        ring = _group_rings(both(e))["ring"].to_numpy()
        e = e[ring[::2] != ring[1::2]]  # others are bridges
    half = both(e)
    walks = _group_rings(half) if len(e) else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("id", "ring", "place")})
    names, ring = np.unique(walks["ring"].to_numpy(), return_inverse=True)
    n = len(names)
    low = np.full((n, 2), np.iinfo(np.int64).max)
    np.minimum.at(low, ring, half[:, :2])
    rel = (half - np.hstack([low, low])[ring]).astype(float)
    area = np.bincount(ring, rel[:, 0] * rel[:, 3] - rel[:, 2] * rel[:, 1], n) / 2 * snap * snap
    by_corner = np.lexsort((half[:, 1], half[:, 0], ring))
    corner = half[by_corner[np.searchsorted(ring[by_corner], np.arange(n))], :2]
    # a walk around the outside of a connected part lies in the smallest face of another part that holds it
    face, side = np.where(area > 0, np.arange(n), -1), half[area[ring] > 0].astype(float)
    shell = ring[area[ring] > 0]
    by_area = np.lexsort((np.arange(n), area))
    for r in np.flatnonzero(area < 0):
        x, y = corner[r]
        s = (side[:, 1] > y) != (side[:, 3] > y)
        x0, y0, u, v = side[s].T
        odd = np.bincount(shell[s][x < (u - x0) * (y - y0) / (v - y0) + x0], minlength=n) % 2 == 1
        held = by_area[(odd & (area > -area[r]))[by_area]]
        face[r] = held[0] if len(held) else -1
    hole = (area < 0) & (face >= 0)
    left = area - np.bincount(face[hole], -area[hole], n)
    rows = np.flatnonzero((face[ring] >= 0) & (left[face[ring]] > least))
    out = [names[face[ring[rows]]], pa.array(names[ring[rows]], mask=~hole[ring[rows]]), walks["place"].to_numpy()[rows], *(half[rows] * snap).T]
    own = table["by"].combine_chunks().take(pa.array(np.zeros(len(rows), np.int64)))
    return pa.table([own, *map(pa.array, out)], ["by", "face", "hole", "place", "ox", "oy", "dx", "dy"])


def _joined_faces(segments: DataFrame, cell: float, snap: float, least: float) -> DataFrame:
    """:func:`faces` by joins, whatever the size of a group."""
    numbered = graph.cut(edges(segments, cell, snap).withColumn("e", F.monotonically_increasing_id()))
    halves = _halves(numbered)
    walks = graph.cut(cycles(_steps(halves)))
    bridge = walks.groupBy(F.shiftright("id", 1).alias("e")).agg((F.min("ring") == F.max("ring")).alias("b")).where("b").select("e")
    if bridge.take(1):
        halves = _halves(graph.cut(numbered.join(bridge, "e", "left_anti")))
        # a bridge has one walk on both sides, and only that walk changes
        torn = walks.join(bridge, F.shiftright("id", 1) == F.col("e")).select("ring").distinct()
        again = walks.join(torn, "ring", "left_semi").select("id")
        walks = graph.cut(walks.join(torn, "ring", "left_anti").select("id", "ring", "place", "size").unionByName(cycles(_steps(halves).join(again, "id", "left_semi"))))
    rows = graph.cut(halves.join(walks, "id"))
    # areas about a ring's own corner, in doubles: integers of large plans would overflow
    own = rows.groupBy("by", "ring").agg(F.min("ox").alias("_x"), F.min("oy").alias("_y"), F.min(F.struct("ox", "oy")).alias("_p"))
    rel = rows.join(own, ["by", "ring"])
    about = lambda x, y, u, v: ((F.col(x) - F.col("_x")).cast("double") * (F.col(v) - F.col("_y")) - (F.col(u) - F.col("_x")).cast("double") * (F.col(y) - F.col("_y")))
    area = graph.cut(rel.groupBy("by", "ring").agg((F.sum(about("ox", "oy", "dx", "dy")) / 2 * snap * snap).alias("area"), F.first("_p").alias("p")))
    shells = area.where(F.col("area") > 0).select("by", F.col("ring").alias("face"), "area")
    # a walk around the outside of a connected part lies in the smallest face of another part that holds it
    outer = area.where(F.col("area") < 0).select("by", F.col("ring").alias("point_id"), F.col("p.ox").alias("x_mm"), F.col("p.oy").alias("y_mm"), (-F.col("area")).alias("_own"))
    around = rows.join(shells.select("by", F.col("face").alias("ring")), ["by", "ring"], "left_semi").select("by", F.col("ring").alias("room_id"), F.col("ox").alias("x0"), F.col("oy").alias("y0"), F.col("dx").alias("x1"), F.col("dy").alias("y1"))
    held = spatial.points_in_polygons(outer, around, cell=max(1, round(2.5 * cell / snap)), by="by")
    held = held.join(shells.select(F.col("face").alias("room_id"), F.col("area").alias("_area")), "room_id").where(F.col("_area") > F.col("_own"))
    holes = held.groupBy("by", "point_id").agg(F.min(F.struct("_area", "room_id")).alias("m"), F.first("_own").alias("_own")).select("by", F.col("point_id").alias("ring"), F.col("m.room_id").alias("face"), F.col("ring").alias("hole"), "_own")
    taken = holes.groupBy("by", "face").agg(F.sum("_own").alias("taken"))
    kept = shells.join(taken, ["by", "face"], "left").where(F.col("area") - F.coalesce("taken", F.lit(0.0)) > least).select("by", "face")
    parts = shells.select("by", F.col("face").alias("ring"), "face", F.lit(None).cast("long").alias("hole")).unionByName(holes.select("by", "ring", "face", "hole")).join(kept, ["by", "face"], "left_semi")
    unit = lambda c: (F.col(c) * F.lit(snap)).alias(c)
    return rows.join(parts, ["by", "ring"]).select("by", "face", "hole", "place", *[unit(c) for c in ("ox", "oy", "dx", "dy")])


def measured(sides: DataFrame, key: str = "face") -> DataFrame:
    """``(by, key, area, cx, cy, corners, x0, y0, x1, y1)`` of ``(by, key, ox, oy, dx, dy)``: area without holes, its
    centroid, edges and box. Sums are taken about the box's corner."""
    own = Window.partitionBy("by", key)
    boxed = sides.select("by", key, "ox", "oy", "dx", "dy", F.min("ox").over(own).alias("x0"), F.min("oy").over(own).alias("y0"), F.max("ox").over(own).alias("x1"), F.max("oy").over(own).alias("y1"))
    px, py, qx, qy = (F.col(c) - F.col(o) for c, o in (("ox", "x0"), ("oy", "y0"), ("dx", "x0"), ("dy", "y0")))
    cross = px * qy - qx * py
    sums = boxed.groupBy("by", key, "x0", "y0", "x1", "y1").agg(F.sum(cross).alias("a"), F.sum((px + qx) * cross).alias("mx"), F.sum((py + qy) * cross).alias("my"), F.count("*").alias("corners"))
    return sums.where("a <> 0").select("by", key, (F.abs("a") / 2).alias("area"), (F.col("x0") + F.col("mx") / (3 * F.col("a"))).alias("cx"), (F.col("y0") + F.col("my") / (3 * F.col("a"))).alias("cy"), "corners", "x0", "y0", "x1", "y1")


def outlines(sides: DataFrame, key: str = "face") -> DataFrame:
    """``(by, key, polygon)``: corners in order, the first one again at the end; holes are left out."""
    own = sides.where("hole IS NULL") if "hole" in sides.columns else sides
    ring = F.array_sort(F.collect_list(F.struct("place", F.struct(F.col("ox").alias("x"), F.col("oy").alias("y")).alias("p"))))
    points = F.transform(ring, lambda r: r["p"])
    return own.groupBy("by", key).agg(F.concat(points, F.slice(points, 1, 1)).alias("polygon"))
