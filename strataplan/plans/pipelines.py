"""The two end-to-end plans: a scan to plan, rooms and fixtures; a slice to wall lines.

A plan is driver control flow over lazy tables; only counts, planes and small artefacts come to
the driver.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs import VectorizeParams
from ..operators import filters, graph, lines, merging, planes, raster, rooms, segments, spatial
from ..sources import sinks


@dataclass(frozen=True)
class ScanParams:
    """Millimetres. One band for alignment and planes."""

    band_low: int = 750
    band_high: int = 1800
    voxel: int = 30
    room_cell: int = 500
    outlier_neighbours: int = 20
    outlier_ratio: float = 2.0


def merge_scans(points: DataFrame, params: ScanParams = ScanParams()) -> merging.Merged:
    """One cloud of one or several scans, in a shared frame or registered to the first."""
    return merging.merge(points, params.voxel, params.outlier_neighbours, params.outlier_ratio)


def scan_to_plan(points: DataFrame, walls: DataFrame | None = None, params: ScanParams = ScanParams()) -> dict:
    """Floors, wall planes, plan lines, rooms, outline and, with a plan, the alignment."""
    cloud = graph.cut(points.select("point_id", "x_mm", "y_mm", "z_mm"))
    floors = planes.floor_levels(cloud).limit(5)
    best = floors.first()
    base = 0.0 if best is None else best.floor_z
    level = cloud.withColumn("z_mm", (F.col("z_mm") - F.lit(base)).cast("long"))
    found, _ = planes.wall_planes(level, low=params.band_low, high=params.band_high, least_found=4, most=12)
    plan = graph.cut(rooms.plan_from_projection(level) if len(found) < 4 else plane_lines(level, found))
    out = {"floors": floors, "planes": found, "plan": plan, "rooms": rooms.rooms_from_scan(level, plan, params.room_cell), "outline": rooms.outline(level)}
    if walls is not None:
        out["alignment"] = planes.align_to_plan(level, walls, params.band_low, params.band_high)
    return out


def plane_lines(points: DataFrame, found: list[tuple[planes.Plane, int]], threshold: float = 50.0) -> DataFrame:
    """A PCA line for the inliers of each plane; a point counts for the first plane it is near."""
    which = F.lit(None).cast("int")
    for i in reversed(range(len(found))):
        which = F.when(F.abs(found[i][0].distance()) <= threshold, i).otherwise(which)
    return segments.pca_lines(points.withColumn("wall", which).where("wall is not null"), "wall").select(F.col("wall").cast("long").alias("seg_id"), "x1", "y1", "x2", "y2")


def detect(shades: DataFrame, res: int, least_mm: float, detector: str) -> DataFrame:
    """Segments of a grey raster in millimetres from its corner: ``hough`` over its edges, ``fld`` (regions of one
    orientation; hough where it finds nothing) or ``both``."""
    own = filters.own_keys(shades)
    least = max(3, round(least_mm / res))
    ends = ("x1", "y1", "x2", "y2")
    grown = graph.cut(lines.grown_segments(raster.gradients(shades), least=least).select(*own, *ends)) if detector != "hough" else None
    if detector == "fld" and grown.take(1):
        found = grown
    else:
        found = lines.hough_segments(raster.edge_cells(shades), votes=least, least=least).select(*own, *ends)
        found = found if grown is None else found.unionByName(grown)
    return found.select(*own, *[((F.col(c) + 0.5) * res).alias(c) for c in ends]).withColumn("seg_id", F.xxhash64(*ends))


def vectorize(points: DataFrame, params: VectorizeParams = VectorizeParams(), preprocess: raster.Preprocess = raster.Preprocess(), progress=None) -> dict:
    """Slice, preprocess, detect, regularise: wall lines in world millimetres, drawing and metrics. ``progress`` is told
    the share that is done and what comes next."""
    tell = progress or (lambda share, text: None)
    tell(0.0, "slice")
    elevation = params.elevation
    if elevation is None:
        best = planes.floor_levels(points).first()
        elevation = ((best.floor_z if best else 0.0) + 1400) / 1000
    mid, half, res = elevation * 1000, params.slab * 500, max(1, round(params.resolution * 1000))
    cells, affine = raster.slice_to_raster(points, int(mid - half), int(mid + half), res)
    clean = graph.cut(raster.preprocess(cells, preprocess))
    at = affine.first()
    tell(0.3, "lines")
    raw = detect(clean, res, params.least_length * 1000, params.detector)
    world = graph.cut(raw.select("seg_id", (F.col("x1") + at.x0).alias("x1"), (F.col("y1") + at.y0).alias("y1"), (F.col("x2") + at.x0).alias("x2"), (F.col("y2") + at.y0).alias("y2")))
    tell(0.7, "walls")
    walls = graph.cut(segments.regularise(world, params.least_length * 1000))
    n = {"points": at.n_points, "cells": cells.count(), "raw_segments": world.count(), "segments": walls.count(), "elevation_m": elevation}
    text, dropped = sinks.dxf_text(walls.select(F.lit("walls").alias("class"), *[(F.col(c) / 1000.0).alias(c) for c in ("x1", "y1", "x2", "y2")]), note=f"{n['segments']} walls at {elevation:.2f} m")
    tell(1.0, "done")
    return {"segments": walls, "cells": cells, "affine": at.asDict(), "metrics": n, "dxf": text, "dropped": dropped, "params_json": json.dumps(asdict(params))}


def fixtures(points: DataFrame, plane_table: DataFrame) -> DataFrame:
    return rooms.fixtures(spatial.near_planes(points, plane_table))


def match_quality(points: DataFrame, edges: DataFrame, ends: DataFrame, tolerance: int = 50) -> DataFrame:
    """Per room: points inside, and the share near a wall end (20 points at least, else null). Ends are told to the cells in
    reach of them, so that points are read once and, where such cells are few, do not move."""
    cell = 2.0 * max(tolerance, 1)
    reach = lambda k: F.explode(F.sequence(*[F.floor((F.col(f"{k}_mm") + s * tolerance) / cell) for s in (-1, 1)]))
    told = ends.select("x_mm", "y_mm").dropna().distinct().withColumn("_cx", reach("x")).withColumn("_cy", reach("y"))
    about = told.groupBy("_cx", "_cy").agg(F.collect_list(F.struct("x_mm", "y_mm")).alias("_ends"))
    inside = spatial.points_in_polygons(points.select("x_mm", "y_mm"), edges).withColumns({f"_c{k}": F.floor(F.col(f"{k}_mm") / cell) for k in "xy"})
    away = lambda e, k: (e[f"{k}_mm"] - F.col(f"{k}_mm")) * (e[f"{k}_mm"] - F.col(f"{k}_mm"))
    hit = F.exists("_ends", lambda e: away(e, "x") + away(e, "y") < tolerance * tolerance)
    got = inside.join(filters.if_small(about), ["_cx", "_cy"], "left").groupBy("room_id").agg(F.count("*").alias("n"), F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("q"))
    return got.select("room_id", "n", F.when(F.col("n") >= 20, F.col("q")).alias("quality"))


def cleaned(points: DataFrame, share: float = 0.1) -> DataFrame:
    """Class mask applied (kept here as a plan step)."""
    return filters.class_mask(points, strong=share)
