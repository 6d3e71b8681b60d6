"""Rooms and plans from a scan: occupancy raster, filled floor, walls, distance seeds, watershed. Tables with a column
``building`` are treated building by building, whose rows stand side by side in the same joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alpha, basins, classify, filters, graph, kernels, lines, planes, raster, rings, scalars, voxel

ROOM = "room_id string, label string, category string, polygon array<struct<x:double,y:double>>, cx double, cy double, area_m2 double, eccentricity double, solidity double, orientation_deg double, confidence double"
_SHAPE = "polygon array<struct<x:double,y:double>>, cx double, cy double, area_m2 double, eccentricity double, solidity double, orientation_deg double"


def _housed(df: DataFrame) -> DataFrame:
    """With a column ``building``; without one all rows are of building 0."""
    return df if filters.own_keys(df) else df.withColumn("building", F.lit(0).cast("long"))


def _cells(points: DataFrame, cell: int) -> DataFrame:
    return points.select(*filters.own_keys(points), F.floor(F.col("x_mm") / float(cell)).alias("col"), F.floor(F.col("y_mm") / float(cell)).alias("row")).distinct()


def floor_cells(points: DataFrame, cell: int, segments: DataFrame | None = None, yard_m2: float = 200.0) -> DataFrame:
    """The floor of each building: occupied cells of the chest band (with its fallbacks) closed twice, holes below
    ``yard_m2`` filled, so that courtyards stay open, the largest part, and the cells of known walls taken
    out."""
    chest = filters.chest_slice(points, 1000, 2000, 100, 0.01, 100)
    closed = raster.close(_cells(chest, cell), rounds=2)
    floor = raster.largest_component(graph.cut(raster.fill_holes(graph.cut(closed), int(yard_m2 * 1e6 / cell**2), eight=True)))
    if segments is None:
        return floor
    own = filters.own_keys(points)
    burnt = raster.line_cells(segments.select(*own, *[F.floor(F.col(a) / float(cell)).cast("long").alias(b) for a, b in (("x1", "ax"), ("y1", "ay"), ("x2", "bx"), ("y2", "by_"))]))
    return floor.join(burnt, [*own, "col", "row"], "left_anti")


def _room_shape(cell: int, least_m2: float):
    unit = cell / 1000.0

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        c, r = f["col"].to_numpy(np.int64), f["row"].to_numpy(np.int64)
        area = len(c) * unit * unit
        if area < least_m2:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("building", "polygon", "cx", "cy", "area_m2", "eccentricity", "solidity", "orientation_deg")})
        part, c0, r0 = kernels.dense(c, r)
        ring = kernels.contour(part)
        line = kernels.simplify([*ring, ring[0]], max(1.0, 1000.0 / cell))[:-1]
        if len(line) < 3 or not kernels.simple_ring(line):
            line = ring  # cell edges never cross
        hull = kernels.area(kernels.convex_hull(ring)) or 1.0
        cov = np.cov(np.stack([c, r])) if len(c) > 1 else np.eye(2)
        lo, hi = np.linalg.eigvalsh(cov)
        ecc = float(np.sqrt(max(0.0, 1 - lo / hi))) if hi > 0 else 0.0
        turn = float(np.degrees(0.5 * np.arctan2(2 * cov[0, 1], cov[0, 0] - cov[1, 1])) % 180)
        poly = [((x + c0) * unit, (y + r0) * unit) for x, y in line]
        cx, cy = kernels.interior_point(poly)
        return pd.DataFrame({
            "building": pd.Series([key[0]], dtype=object), "polygon": [[{"x": x, "y": y} for x, y in poly]], "cx": [cx], "cy": [cy], "area_m2": [area], "eccentricity": [ecc], "solidity": [min(1.0, len(c) / hull)], "orientation_deg": [turn]})

    return run


def rooms_from_floor(floor: DataFrame, cell: int = 500, apart_m: float = 1.5, least_m2: float = 4.0, most: int = 80) -> DataFrame:
    """Rooms of floor cells: distance to what is no floor, seeds in two passes, watershed; the ``most`` largest of a
    building. A group is one room."""
    many = bool(filters.own_keys(floor))
    h = graph.cut(raster.depth(_housed(floor)))
    apart = max(3, int(apart_m * 1000 / cell))
    label = basins.watershed(h, basins.room_seeds(h, apart, apart))
    found = label.groupBy("building", "label").applyInPandas(_room_shape(cell, least_m2), f"building {h.schema['building'].dataType.simpleString()}, {_SHAPE}")
    out = _named(filters.top_by(found, ["building"], [F.desc("area_m2"), F.col("cx"), F.col("cy")], most))
    return out if many else out.drop("building")


def _named(rooms: DataFrame) -> DataFrame:
    """Add stable ids and the classification."""
    rid = scalars.hashed_id(F.col("cx"), F.col("cy"))
    c = rooms.withColumn("c", classify.classify_room(F.col("area_m2"), F.col("eccentricity"), F.col("solidity")))
    return c.select(*filters.own_keys(rooms), rid.alias("room_id"), "c.label", "c.category", "polygon", "cx", "cy", "area_m2", "eccentricity", "solidity", "orientation_deg", F.round("c.confidence", 3).alias("confidence"))


def rooms_from_lines(segments: DataFrame, cell: float = 5.0, snap: float = 1e-6) -> DataFrame:
    """Rooms as faces of plan lines (metres), at least max(2 m2, 0.5 % of the box of the building's lines). Faces are
    made by joins; only a face's own corners go to a function, for its hull and a point inside."""
    many = bool(filters.own_keys(segments))
    s = _housed(segments)
    kind = s.schema["building"].dataType.simpleString()
    x, y = (lambda f, g: f(g("x1", "x2"))), (lambda f, g: f(g("y1", "y2")))
    box = s.groupBy("building").agg(((x(F.max, F.greatest) - x(F.min, F.least)) * (y(F.max, F.greatest) - y(F.min, F.least)) * 0.005).alias("_least"))
    ends = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    sides = graph.cut(rings.faces(s.select(F.col("building").alias("by"), F.xxhash64("x1", "y1", "x2", "y2").alias("seg_id"), *ends), cell, snap, 2.0))
    big = rings.measured(sides).join(filters.if_small(box), F.col("by") == F.col("building")).where(F.col("area") >= F.col("_least"))
    faces = big.join(rings.outlines(sides), ["by", "face"]).select("building", "area", "x0", "y0", F.col("x1").alias("u"), F.col("y1").alias("v"), "polygon")

    def shaped(frames):
        for f in frames:
            rows = []
            for b, area, x0, y0, u, v, polygon in f.itertuples(index=False):
                ring = [(p["x"], p["y"]) for p in polygon]
                cx, cy = kernels.interior_point(ring[:-1])
                ecc = 1 - 1 / (max(u - x0, v - y0) / max(min(u - x0, v - y0), 0.001))
                rows.append((b, [{"x": p, "y": q} for p, q in ring], cx, cy, area, ecc, min(1.0, area / (kernels.area(kernels.convex_hull(ring[:-1])) or 1.0)), 0.0))
            if rows:
                yield pd.DataFrame(rows, columns=["building", "polygon", "cx", "cy", "area_m2", "eccentricity", "solidity", "orientation_deg"])

    out = _named(faces.mapInPandas(shaped, f"building {kind}, {_SHAPE}"))
    return out if many else out.drop("building")


def building_rooms(boxes: DataFrame) -> DataFrame:
    """The box ``(x0, y0, x1, y1)`` of each building as a single room."""
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ring = F.array(*[point(x, y) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    return boxes.select(
        *filters.own_keys(boxes), F.lit("room-001").alias("room_id"), F.lit("Building").alias("label"), F.lit("unknown").alias("category"), ring.alias("polygon"), F.expr("(x0 + x1) / 2").alias("cx"), F.expr("(y0 + y1) / 2").alias("cy"),
        F.expr("(x1 - x0) * (y1 - y0)").alias("area_m2"), F.lit(0.0).alias("eccentricity"), F.lit(1.0).alias("solidity"), F.lit(0.0).alias("orientation_deg"), F.lit(0.3).alias("confidence"))


def boxes(points: DataFrame) -> DataFrame:
    """The box of each building's points, metres."""
    return points.groupBy(*filters.own_keys(points)).agg(*[(f(c) / 1000.0).alias(n) for n, f, c in (("x0", F.min, "x_mm"), ("y0", F.min, "y_mm"), ("x1", F.max, "x_mm"), ("y1", F.max, "y_mm"))])


def rooms_from_scan(points: DataFrame, segments: DataFrame | None = None, cell: int = 500, yard_m2: float = 200.0) -> DataFrame:
    """Rooms of each building's floor, divided by known wall lines (millimetres); of a building without any the faces
    of its lines; else the building as one room."""
    many = bool(filters.own_keys(points))
    p = _housed(points)
    s = None if segments is None else _housed(segments)
    out = graph.cut(rooms_from_floor(floor_cells(p, cell, s, yard_m2), cell))
    left = graph.cut(boxes(p).join(out.select("building").distinct(), "building", "left_anti"))
    if left.take(1):
        if s is not None:
            rest = s.join(left.select("building"), "building", "left_semi")
            faces = graph.cut(rooms_from_lines(rest.select("building", *[(F.col(c) / 1000.0).alias(c) for c in ("x1", "y1", "x2", "y2")])))
            out = out.unionByName(faces)
            left = left.join(faces.select("building").distinct(), "building", "left_anti")
        out = out.unionByName(building_rooms(left))
    return out if many else out.drop("building")


def plan_from_projection(points: DataFrame, cell: int = 100, least_m: float = 2.0, most: int = 120, thin: int = 80) -> DataFrame:
    """Wall lines of a scan without planes, ``(seg_id, x1, y1, x2, y2)`` in millimetres: chest band of the thinned cloud,
    the main cluster's box, raster closed three times and filled, blurred, edges, Hough runs of at least ``least_m``, the
    ``most`` longest, and of four or more those of the two main directions; the box where no line is found."""
    own = filters.own_keys(points)
    small = planes.thinned(points, thin) if thin and not own else points
    chest = graph.cut(filters.chest_slice(small.select(*own, "point_id", "x_mm", "y_mm", "z_mm"), 1000, 2000, 500, 0.01, 50))
    if not own and chest.limit(501).count() > 500:
        chest = graph.cut(planes.main_cluster_box(chest, 1500, 10, 3000))
    filled = graph.cut(raster.fill_holes(graph.cut(raster.close(_cells(chest, cell), raster.DISC5, 3))))
    edges = graph.cut(raster.edge_cells(raster.blur(filled, raster.gaussian(5, 1.5))))
    found = lines.hough_segments(edges, 35, max(10, int(least_m * 1000 / cell)), max(5, int(600 / cell)))
    mm = found.select(*own, *[((F.col(c) + 0.5) * cell).alias(c) for c in ("x1", "y1", "x2", "y2")])
    long = mm.where(filters.length_mm() >= least_m * 1000).withColumn("seg_id", F.xxhash64("x1", "y1", "x2", "y2"))
    kept = graph.cut(filters.manhattan_filter(graph.cut(filters.top_by(long, own, [filters.length_mm().desc(), F.col("seg_id")], most))))
    box = chest.groupBy(*own).agg(*[f(c).cast("double").alias(n) for n, f, c in (("x0", F.min, "x_mm"), ("y0", F.min, "y_mm"), ("u", F.max, "x_mm"), ("v", F.max, "y_mm"))])
    bare = box.join(kept.select(*own).distinct(), own, "left_anti") if own else box.where(F.lit(not kept.take(1)))
    sides = F.explode(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(side, ("x1", "y1", "x2", "y2"))]) for side in (("x0", "y0", "u", "y0"), ("u", "y0", "u", "v"), ("u", "v", "x0", "v"), ("x0", "v", "x0", "y0"))])).alias("s")
    ends = bare.where("x0 IS NOT NULL").select(*own, sides).select(*own, "s.*").withColumn("seg_id", F.xxhash64("x1", "y1", "x2", "y2"))
    return kept.unionByName(ends).select(*own, "seg_id", "x1", "y1", "x2", "y2")


def outline(points: DataFrame, cell: int = 500, alphas: tuple[float, ...] = (0.5, 1.0, 2.0, 0.25)) -> DataFrame:
    """Outline ``(k, x, y)`` in metres of each building: the ring of the alpha shape of its cells' means (whole
    millimetres), for the first alpha that gives just one and holds nine tenths of the means; else their hull."""
    own = filters.own_keys(points)
    place = [F.floor(F.col(f"{k}_mm") / float(cell)).alias(c) for k, c in (("x", "c"), ("y", "r"))]
    means = points.groupBy(*own, *place).agg(*[F.floor(F.avg(f"{k}_mm")).cast("long").alias(k) for k in "xy"])
    left = graph.cut(means.select(*own, ((F.col("r") + (1 << 30)) * (1 << 31) + F.col("c") + (1 << 30)).alias("point_id"), "x", "y"))
    found: list[DataFrame] = []
    for a in alphas:
        ring = graph.cut(alpha.alpha_ring(left, 1000.0 / a))
        if ring.take(1):
            found.append(ring.select(*own, F.col("place").cast("int").alias("k"), F.col("ox").alias("x_mm"), F.col("oy").alias("y_mm")))
            if not own:
                break
            left = graph.cut(left.join(ring.select(*own).distinct(), own, "left_anti"))
        if not left.take(1):
            break
    else:
        found.append(hulls(left.select(*own, F.col("x").alias("x_mm"), F.col("y").alias("y_mm"))))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(*own, "k", (F.col("x_mm") / 1000).alias("x"), (F.col("y_mm") / 1000).alias("y"))


def hulls(points: DataFrame, parts: int = 64) -> DataFrame:
    """Convex hull corners ``(k, x_mm, y_mm)`` in order of each building: first those of its parts, then of their
    corners."""
    own = filters.own_keys(points)
    corners = lambda f: kernels.convex_hull([(int(x), int(y)) for x, y in f[["x_mm", "y_mm"]].to_numpy()])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ring = corners(f)
        out = pd.DataFrame({"k": range(len(ring)), "x_mm": [p[0] for p in ring], "y_mm": [p[1] for p in ring]})
        for c in own:
            out[c] = f[c].iloc[0]
        return out

    kinds = ", ".join(["k int", "x_mm long", "y_mm long", *[f"{c} {points.schema[c].dataType.simpleString()}" for c in own]])
    some = points.withColumn("_part", F.pmod(F.xxhash64("x_mm", "y_mm"), F.lit(parts))).groupBy(*own, "_part").applyInPandas(run, kinds)
    return some.groupBy(*(own or [F.lit(0).alias("_all")])).applyInPandas(run, kinds)


def hull(points: DataFrame) -> DataFrame:
    """Convex hull corners ``(x_mm, y_mm)``: each task takes the hull of what it holds, and the last
    kernel sees the corners of those."""

    def own(frames):
        kept: list[tuple[int, int]] = []
        for f in frames:
            kept = kernels.convex_hull(kept + [(int(x), int(y)) for x, y in f.drop_duplicates().to_numpy()])
        yield pd.DataFrame(kept, columns=["x_mm", "y_mm"]).astype("int64")

    ends = points.select("x_mm", "y_mm").mapInPandas(own, "x_mm long, y_mm long").distinct()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ring = kernels.convex_hull([(int(x), int(y)) for x, y in f[["x_mm", "y_mm"]].to_numpy()])
        return pd.DataFrame(ring, columns=["x_mm", "y_mm"]).astype("int64")

    return ends.groupBy(F.lit(0).alias("b")).applyInPandas(run, "x_mm long, y_mm long")


def fixtures(candidates: DataFrame, eps: int = 50, least: int = 50) -> DataFrame:
    """Clusters of wall-front points ``(point_id, wall_id, x_mm, y_mm, z_mm, dist)``: box, centre,
    depth, width, height, count, density confidence; thin artefacts are dropped. Walls are far
    apart on the height axis while clustering, so that clusters stay on one wall."""
    from .planes import dbscan

    apart = graph.cut(candidates.select(F.xxhash64("wall_id", "point_id").alias("point_id"), "wall_id", "x_mm", "y_mm", "z_mm", "dist"))
    lifted = apart.withColumn("z_mm", F.col("z_mm") + F.col("wall_id") * 1_000_000)
    label = dbscan(lifted.select("point_id", "x_mm", "y_mm", "z_mm"), eps, least)
    c = apart.join(label.where("label is not null"), "point_id").groupBy("wall_id", "label").agg(
        F.count("*").alias("point_count"), *[f(f"{k}_mm").alias(f"{k}{i}") for k in "xyz" for i, f in ((0, F.min), (1, F.max))], *[F.avg(f"{k}_mm").alias(f"c{k}") for k in "xyz"], F.max("dist").alias("depth_mm"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    c = c.withColumn("width_mm", F.sqrt((dx * dx + dy * dy).cast("double"))).withColumn("height_mm", (F.col("z1") - F.col("z0")).cast("double"))
    kept = c.where((F.col("point_count") >= least) & ~((F.col("width_mm") < 50) & (F.col("height_mm") < 50) & (F.col("depth_mm") < 30)))
    volume = F.greatest(F.col("width_mm") / 1000, F.lit(1e-4)) * F.greatest(F.col("height_mm") / 1000, F.lit(1e-4)) * F.greatest(F.col("depth_mm") / 1000, F.lit(1e-4))
    return kept.withColumn("confidence", F.least(F.col("point_count") / volume / 1000.0, F.lit(1.0)))
