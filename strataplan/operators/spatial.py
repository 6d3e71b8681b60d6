"""Spatial joins as equi-joins on grid cells.

Cells are twice as wide as the search radius, so a point's ball touches two of them a dimension at
most: one side is sent to those 2^d cells, joined on the cell and tested exactly. No plan compares all
points with all points. Searches that widen store what each radius found, so no step is repeated. Searches for the nearest
go block by block (a block of left points with all right points in reach), and return no pairs but those wanted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, neighbours
from .filters import if_small, with_scalar


def _cells(df: DataFrame, radius: int, dims: str) -> DataFrame:
    return df.withColumns({f"c{k}": F.floor(F.col(f"{k}_mm") / (2.0 * radius)) for k in dims})


def _neighbours(df: DataFrame, radius: int, dims: str) -> DataFrame:
    """Each row once for every cell that its ball touches."""
    for k in dims:
        first, last = (F.floor((F.col(f"{k}_mm") + s * radius) / (2.0 * radius)) for s in (-1, 1))
        df = df.withColumn(f"c{k}", F.explode(F.sequence(first, last)))
    return df


def distance2(a: str, b: str, dims: str) -> Column:
    return sum(((F.col(f"{a}{k}_mm") - F.col(f"{b}{k}_mm")) * (F.col(f"{a}{k}_mm") - F.col(f"{b}{k}_mm")) for k in dims), F.lit(0).cast("long"))


def _side(df: DataFrame, prefix: str, id_col: str, dims: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(F.col(id_col).alias(f"{prefix}id"), *[F.col(f"{k}_mm").alias(f"{prefix}{k}_mm") for k in dims], *[F.col(f"c{k}") for k in dims], *[F.col(c).alias(f"{prefix}{c}") for c in keep])


def radius_pairs(left: DataFrame, right: DataFrame, radius: int, id_col: str = "point_id", dims: str = "xyz") -> DataFrame:
    """``(a_id, b_id, d2)`` for pairs within the radius (closed)."""
    a = _side(_neighbours(left, radius, dims), "a_", id_col, dims)
    b = _side(_cells(right, radius, dims), "b_", id_col, dims)
    pairs = a.join(b, [f"c{k}" for k in dims]).withColumn("d2", distance2("a_", "b_", dims))
    return pairs.where(F.col("d2") <= radius * radius).select("a_id", "b_id", "d2")


#: points that a block holds at most, where its side may still shrink
BLOCK = 200_000


def _block_side(points: DataFrame, reach: int, dims: str) -> int:
    """The side of blocks for a search: the widest whose fullest block holds at most ``BLOCK`` points, but no
    less than the reach. The counts of the narrowest blocks are stored, and added up for wider ones."""
    narrow = max(reach, 1)
    at = [f"c{k}" for k in dims]
    counted = graph.cut(points.groupBy(*[F.floor(F.col(f"{k}_mm") / float(narrow)).alias(f"c{k}") for k in dims]).agg(F.count("*").alias("n")))
    for times in (64, 16, 8, 4, 2):
        wide = counted.groupBy(*[F.floor(F.col(c) / times).alias(c) for c in at]).agg(F.sum("n").alias("n"))
        if (wide.agg(F.max("n")).first()[0] or 0) <= BLOCK:
            return times * narrow
    return narrow


def _blocks(left: DataFrame, right: DataFrame, k: int, reach: int, dims: str, run, schema: str, others: bool, side: int | None = None, few_blocks: bool = False) -> DataFrame:
    """``run(left frame, right frame, search)`` block by block: every left point is in one block, every right
    point in all that are within reach of it. Right points are ordered by id, so that equal distances go to the smallest.
    A table that is both sides moves once. With ``others`` a point's own id is no neighbour, and ``run`` must return a row
    for each left point; points at one place have the same neighbours, places and distances, and are searched once. ``few_blocks``: left points are in few
    blocks, and right points of others do not move."""
    side = side or _block_side(left if left is right else left.unionByName(right), reach, dims)
    keys = [f"c{c}" for c in dims]
    cols = [f"{c}_mm" for c in dims]
    cell = {c: F.floor(F.col(x) / float(side)) for x, c in zip(cols, keys)}
    b = right.select("id", *cols)
    for x, c in zip(cols, keys):
        b = b.withColumn(c, F.explode(F.sequence(*[F.floor((F.col(x) + s * reach) / float(side)) for s in (-1, 1)])))

    def answers(f: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in empty})
        ids = f["id"].to_numpy(), g["id"].to_numpy()
        xyz = f[cols].to_numpy(np.int64), g[cols].to_numpy(np.int64)
        # among right points of one id each, all of a place miss one neighbour there, themselves
        if not others or (ids[1][1:] == ids[1][:-1]).any() or not np.isin(ids[0], ids[1]).all():
            return run(ids, xyz, neighbours.search(*xyz, k, reach, ids if others else None))
        first, at = neighbours.same_places(xyz[0])
        few = xyz[0][first]
        out = run((np.arange(len(first)), ids[1]), (few, xyz[1]), neighbours.search(few, xyz[1], k, reach, (ids[0][first], ids[1])))
        place = np.empty(len(first), dtype=np.int64)
        place[out["id"].to_numpy()] = np.arange(len(first))
        return out.iloc[place[at]].assign(id=ids[0])

    empty = [(c.split()[0], "float64" if "double" in c else "int64") for c in schema.split(", ") if "<" not in c]
    empty += [(c.split()[0], "object") for c in schema.split(", ") if "<" in c]
    if left is right:
        home = F.lit(True)
        for c in keys:
            home &= F.col(c) == cell[c]

        def each(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            g = f.sort_values("id", kind="stable")
            return answers(g[g["home"]], g)

        return b.select("id", *cols, *keys, home.alias("home")).groupBy(*keys).applyInPandas(each, schema)
    a = left.select("id", *cols, *[cell[c].alias(c) for c in keys])
    b = b.select("id", *cols, *keys)
    if few_blocks:
        b = b.join(if_small(graph.cut(a.select(*keys).distinct())), keys, "left_semi").select("id", *cols, *keys)
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(lambda key, f, g: answers(f, g.sort_values("id")), schema)


def places(df: DataFrame, id_col: str, dims: str) -> DataFrame:
    """Each place that points hold, once, under its smallest id."""
    return df.groupBy(*[F.col(f"{k}_mm").cast("long").alias(f"{k}_mm") for k in dims]).agg(F.min(id_col).alias("id"))


def nearest(left: DataFrame, right: DataFrame, radius: int, id_col: str = "point_id", dims: str = "xyz") -> DataFrame:
    """Nearest right row within the radius of each left row; the smallest id of equals.

    Points at one place have one answer, so places are searched, and those that both sides hold are each
    other's. The others go block by block (:mod:`neighbours`), where the reach doubles until each has its
    nearest; no table of pairs is made. Where blocks of the full radius are crowded, most are done with a short one."""
    cols = [f"{k}_mm" for k in dims]
    own = left.select(F.col(id_col).alias("a_id"), *[F.col(c).cast("long").alias(c) for c in cols])
    targets = graph.cut(places(right, id_col, dims))
    marked = graph.cut(own.join(targets.withColumnRenamed("id", "b_id"), cols, "left"))
    same = marked.where("b_id IS NOT NULL").select("a_id", "b_id", F.lit(0).cast("long").alias("d2"))
    rest = marked.where("b_id IS NULL").drop("b_id")
    spots = todo = graph.cut(places(rest, "a_id", dims))
    by_place = []

    def run(ids, xyz, search) -> pd.DataFrame:
        out = [(ids[0][rows[n > 0]], ids[1][found], d2) for rows, n, found, d2 in search]
        return pd.DataFrame(dict(zip(("id", "b_id", "d2"), map(np.concatenate, zip(*out)))))

    kind = f"id {left.schema[id_col].dataType.simpleString()}, b_id {right.schema[id_col].dataType.simpleString()}, d2 long"
    for reach in (max(radius // 16, 1), radius):
        if reach < radius and is_sparse(todo, targets, radius, dims):
            continue
        by_place.append(graph.cut(_blocks(todo, targets, 1, reach, dims, run, kind, False)))
        if reach < radius:
            todo = graph.cut(todo.join(by_place[-1].select("id"), "id", "left_anti"))
    found = by_place[0] if len(by_place) == 1 else by_place[0].unionByName(by_place[1])
    named = rest.join(spots.join(found, "id"), cols).select("a_id", "b_id", "d2")
    best = same.unionByName(named).groupBy("a_id").agg(F.min(F.struct("d2", "b_id")).alias("m"))
    return best.select("a_id", F.col("m.b_id").alias("b_id"), F.col("m.d2").alias("d2"))


def is_sparse(left: DataFrame, right: DataFrame, reach: int, dims: str) -> bool:
    """Blocks eight times as wide as the reach hold at most ``BLOCK`` points each."""
    wide = [F.floor(F.col(f"{k}_mm") / (8.0 * reach)) for k in dims]
    most = left.unionByName(right).groupBy(*wide).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= BLOCK


def mutual_nearest(left: DataFrame, right: DataFrame, radius: int, id_col: str = "point_id", dims: str = "xyz") -> DataFrame:
    """Pairs that are each other's nearest."""
    ab = nearest(left, right, radius, id_col, dims)
    ba = nearest(right, left, radius, id_col, dims).select(F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id"))
    return ab.join(ba, ["a_id", "b_id"])


def neighbourhoods(points: DataFrame, others: DataFrame, k: int, radius: int, what, schema: str, id_col: str = "point_id", dims: str = "xyz") -> DataFrame:
    """``(id, n, ...)`` for each of ``points``: ``what(rows of others as coordinates, counts, d2)`` of its k nearest among
    ``others`` that have another id and lie within the radius, by distance then id. ``schema`` names what it returns.

    Where points are their own others and crowded, a block of the full radius could hold little more than what is in reach of
    it, and each point would move to many. Most have their k within a sixteenth of the radius there, in blocks that
    overlap little; what has not is searched again, with what is in the same blocks."""
    own = lambda df: df.select(F.col(id_col).alias("id"), *[F.col(f"{c}_mm").cast("long").alias(f"{c}_mm") for c in dims])
    cols = [f"{c}_mm" for c in dims]

    def run(ids, xyz, search) -> pd.DataFrame:
        out = [(ids[0][rows], *xyz[0][rows].T, n, *what(xyz[1][found], n, d2)) for rows, n, found, d2 in search]
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame(dict(zip(("id", *cols, "n", *names), map(np.concatenate, zip(*out)))))

    kind = f"id {points.schema[id_col].dataType.simpleString()}, {', '.join(f'{c} long' for c in cols)}, n long, {schema}"
    if points is not others:
        return _blocks(own(points), own(others), k, radius, dims, run, kind, True).drop(*cols)
    every, short = own(points), radius // 16
    side = _block_side(every, radius, dims)
    if side >= 4 * radius or not short:
        return _blocks(every, every, k, radius, dims, run, kind, True, side).drop(*cols)
    first = graph.cut(_blocks(every, every, k, short, dims, run, kind, True))
    late = first.where(F.col("n") < k).select("id", *cols)
    return first.where(F.col("n") == k).unionByName(_blocks(late, every, k, radius, dims, run, kind, True, side, True)).drop(*cols)


def knn_distance(points: DataFrame, k: int, radius: int, id_col: str = "point_id", dims: str = "xyz") -> DataFrame:
    """Mean distance of each point to its k nearest others. Points with fewer than k others in reach
    are searched again with twice the radius, until the radius spans all points; only where there
    are not k others at all do rows use those there are (none: null)."""
    box = points.agg(F.count("*"), *[f(f"{c}_mm") for c in dims for f in (F.min, F.max)]).first()
    total, span = box[0], sum((hi - lo) ** 2 for lo, hi in zip(box[1::2], box[2::2])) ** 0.5 if box[0] else 0.0
    every = points.select(id_col, *[f"{c}_mm" for c in dims])
    todo, parts, reach, left = every, [], max(radius // 16, 1), total

    def mean(_, n: np.ndarray, d2: np.ndarray):
        at = np.repeat(np.arange(len(n)), n)
        return (np.bincount(at, np.sqrt(d2.astype(float)), len(n)) / np.maximum(n, 1),)

    while left or not parts:
        found = neighbourhoods(todo, every, k, reach, mean, "mean_d double", id_col, dims).where("n > 0").withColumnRenamed("id", "a_id")
        if reach >= span:
            parts.append(graph.cut(found))
            break
        parts.append(graph.cut(found.where(F.col("n") == k)))
        todo = graph.cut(todo.join(parts[-1].select(F.col("a_id").alias(id_col)), id_col, "left_anti"))
        left = todo.count()
        reach *= 4
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return points.select(F.col(id_col).alias("a_id")).join(out, "a_id", "left")


def statistical_outliers(points: DataFrame, k: int = 20, ratio: float = 2.0, radius: int = 200) -> DataFrame:
    """Points with a mean neighbour distance above mean + ratio x standard deviation."""
    d = knn_distance(points, k, radius)
    stat = d.agg(F.avg("mean_d").alias("_m"), F.stddev_samp("mean_d").alias("_s"))
    return with_scalar(d, stat).withColumn("outlier", F.col("mean_d").isNull() | (F.col("mean_d") > F.col("_m") + ratio * F.col("_s"))).drop("_m", "_s")


def neighbour_counts(points: DataFrame, radius: int, id_col: str = "point_id", dims: str = "xyz") -> DataFrame:
    """Points within the radius of each point, itself included."""
    return radius_pairs(points, points, radius, id_col, dims).groupBy("a_id").agg(F.count("*").alias("n"))


def points_in_polygons(points: DataFrame, edges: DataFrame, key: str = "room_id", cell: int = 5000, by: str | None = None) -> DataFrame:
    """``(point columns, key)`` for points inside by the even-odd rule. Polygons are put into the
    grid cells their boxes touch, so points meet only polygons of their cell; a polygon is then
    an array of the edges that can lie beside points of the cell, tested in place. The tiles of few
    polygons are broadcast (they are counted first), and points do not move; those of many are joined
    by cell. With ``by`` points meet only polygons of their own group."""
    same = [by] if by else []
    shape = edges.groupBy(key, *same).agg(
        F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_edges"),
        F.min(F.least("x0", "x1")).alias("_bx0"), F.max(F.greatest("x0", "x1")).alias("_bx1"), F.min(F.least("y0", "y1")).alias("_by0"), F.max(F.greatest("y0", "y1")).alias("_by1"))
    tiles = shape.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_bx0") / cell), F.floor(F.col("_bx1") / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_by0") / cell), F.floor(F.col("_by1") / cell))))
    # an edge counts for points below its top, above its foot and left of it
    beside = lambda e: (F.greatest(e["y0"], e["y1"]) >= F.col("_cy") * cell) & (F.least(e["y0"], e["y1"]) <= (F.col("_cy") + 1) * cell) & (F.greatest(e["x0"], e["x1"]) >= F.col("_cx") * cell)
    tiles = if_small(tiles.withColumn("_edges", F.filter("_edges", beside)))
    x, y = F.col("x_mm"), F.col("y_mm")

    def crosses(e: Column) -> Column:
        straddles = (e["y0"] > y) != (e["y1"] > y)
        at = (e["x1"] - e["x0"]) * (y - e["y0"]) / F.when(e["y1"] == e["y0"], F.lit(None)).otherwise(e["y1"] - e["y0"]) + e["x0"]
        return straddles & (x < at)

    joined = points.withColumns({"_cx": F.floor(x / cell), "_cy": F.floor(y / cell)}).join(tiles, ["_cx", "_cy", *same])
    inside = (x >= F.col("_bx0")) & (x <= F.col("_bx1")) & (y >= F.col("_by0")) & (y <= F.col("_by1"))
    odd = F.size(F.filter("_edges", crosses)) % 2 == 1
    return joined.where(inside & odd).select(*points.columns, key)


def near_planes(points: DataFrame, planes: DataFrame, least: int = 20, most: int = 300, buffer: int = 100) -> DataFrame:
    """Points ``least``..``most`` in front of a wall plane (closed) and inside the plane's box
    with a buffer. ``planes(wall, a, b, c, d, bx0, bx1, by0, by1)``: the join is on the cells of the
    boxes, which are broadcast if they are few (counted first)."""
    cell = 2000
    names = {"a": "_pa", "b": "_pb", "c": "_pc", "d": "_pd", "wall": "wall_id"}
    boxes = planes.withColumnsRenamed(names).withColumn("_cx", F.explode(F.sequence(F.floor((F.col("bx0") - buffer) / cell), F.floor((F.col("bx1") + buffer) / cell)))).withColumn(
        "_cy", F.explode(F.sequence(F.floor((F.col("by0") - buffer) / cell), F.floor((F.col("by1") + buffer) / cell))))
    norm = F.sqrt(F.col("_pa") * F.col("_pa") + F.col("_pb") * F.col("_pb") + F.col("_pc") * F.col("_pc"))
    dist = (F.col("_pa") * F.col("x_mm") + F.col("_pb") * F.col("y_mm") + F.col("_pc") * F.col("z_mm") + F.col("_pd")) / norm
    p = points.withColumns({"_cx": F.floor(F.col("x_mm") / cell), "_cy": F.floor(F.col("y_mm") / cell)})
    out = p.join(if_small(boxes), ["_cx", "_cy"]).withColumn("dist", dist)
    return out.where(F.col("dist").between(least, most) & F.col("x_mm").between(F.col("bx0") - buffer, F.col("bx1") + buffer) & F.col("y_mm").between(F.col("by0") - buffer, F.col("by1") + buffer)).select(*points.columns, "wall_id", "dist")
