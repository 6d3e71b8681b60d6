"""Merging scans: one alone, several in a shared frame, or registered to the first one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, kernels, planes, spatial, voxel


@dataclass(frozen=True)
class Merged:
    """``cloud(point_id, x_mm, y_mm, z_mm)`` about its centroid; ``offset`` leads back."""

    cloud: DataFrame
    scans: int
    before: int
    after: int
    strategy: str
    offset: tuple[float, float, float]


def feature_transforms(points: DataFrame, reference, voxel_mm: int, seed: int = 1) -> dict:
    """For each other scan the transform that its point features suggest. Every scan meets the
    reference in one task, both as coarse voxel means, which their rooms bound."""
    coarse = 3.0 * voxel_mm
    cell = lambda k: F.floor((F.col(f"{k}_mm") + F.lit(coarse / 2)) / F.lit(coarse)).alias(f"v{k}")
    means = graph.cut(points.groupBy("scan_id", *[cell(k) for k in "xyz"]).agg(*[F.avg(f"{k}_mm").alias(k) for k in "xyz"]).select("scan_id", "x", "y", "z"))
    others = means.where(F.col("scan_id") != reference)
    names = others.select("scan_id").distinct()
    target = means.where(F.col("scan_id") == reference).select(F.lit(1).alias("_one"), "x", "y", "z").join(names.withColumn("_one", F.lit(1)), "_one")
    target = target.select(*[F.col(c).alias(c) for c in ("scan_id", "x", "y", "z")])  # columns of its own, so that both sides can be told apart

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (f.sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy(float) for f in (a, b))
        pairs = kernels.mutual_matches(kernels.point_features(a, voxel_mm), kernels.point_features(b, voxel_mm)) if len(a) and len(b) else np.zeros((0, 2), np.int64)
        m, n = kernels.match_transform(a, b, pairs, 6.0 * voxel_mm, seed=seed)
        return pd.DataFrame({"scan_id": [key[0]], "m": [m.ravel()], "matched": [n]})

    kind = points.schema["scan_id"].dataType.simpleString()
    found = others.groupBy("scan_id").cogroup(target.groupBy("scan_id")).applyInPandas(run, f"scan_id {kind}, m array<double>, matched long")
    return {r.scan_id: np.array(r.m).reshape(4, 4) for r in found.collect()}  # a row a scan


def registered(points: DataFrame, voxel_mm: int, rounds: int = 100) -> DataFrame:
    """All scans moved into the frame of the first one: features give the start, ICP the rest. A scan
    without any match stays where its features put it."""
    names = sorted(r.scan_id for r in points.select("scan_id").distinct().collect())  # a row a scan
    reference = points.where(F.col("scan_id") == names[0])
    out = reference.select("point_id", "scan_id", "x_mm", "y_mm", "z_mm")
    starts = feature_transforms(points, names[0], voxel_mm)
    target = planes.thinned(reference, 3 * voxel_mm)
    for name in names[1:]:
        own = points.where(F.col("scan_id") == name)
        m = starts.get(name, np.eye(4))
        try:
            m, *_ = planes.icp_3d(planes.thinned(own, 3 * voxel_mm), target, rounds, 6 * voxel_mm, start=m)
        except ValueError:
            pass
        out = out.unionByName(planes.moved(own, m).withColumn("scan_id", F.lit(name)))
    return out


def merge(points: DataFrame, voxel_mm: int = 30, neighbours: int = 20, ratio: float = 2.0) -> Merged:
    """``points(point_id, scan_id, x_mm, y_mm, z_mm)`` as one cloud: voxel means scan by scan,
    outliers out, frames brought together where they differ, voxel means again, centred."""
    cell = lambda k: F.floor((F.col(f"{k}_mm") + F.lit(voxel_mm / 2)) / F.lit(float(voxel_mm))).alias(f"v{k}")
    thin = points.groupBy("scan_id", *[cell(k) for k in "xyz"]).agg(*[F.avg(f"{k}_mm").alias(k) for k in "xyz"])
    thin = graph.cut(thin.select(F.xxhash64("scan_id", "vx", "vy", "vz").alias("point_id"), "scan_id", *[F.round(k).cast("long").alias(f"{k}_mm") for k in "xyz"]))
    scans = thin.select("scan_id").distinct().count()
    if not scans:
        raise ValueError("no scan has a point")
    if neighbours:
        keep = thin.select("scan_id").distinct().collect()  # a row a scan: outliers are judged in their own scan
        parts = [spatial.statistical_outliers(thin.where(F.col("scan_id") == r.scan_id), neighbours, ratio, 4 * voxel_mm).where("not outlier").select(F.col("a_id").alias("point_id")) for r in keep]
        good = parts[0]
        for p in parts[1:]:
            good = good.unionByName(p)
        thin = graph.cut(thin.join(good, "point_id", "left_semi"))
    before = thin.count()
    strategy = "single" if scans == 1 else "concatenate" if voxel.shared_frame(thin).first()["same_frame"] else "icp_registered"
    cloud = registered(thin, voxel_mm) if strategy == "icp_registered" else thin
    if scans > 1:
        cloud = planes.thinned(cloud, voxel_mm)
    cloud = graph.cut(cloud.select("point_id", "x_mm", "y_mm", "z_mm"))
    n, *middle = cloud.agg(F.count("*"), *[F.avg(f"{k}_mm") for k in "xyz"]).first()
    centred = cloud.select("point_id", *[F.round(F.col(f"{k}_mm") - c).cast("long").alias(f"{k}_mm") for k, c in zip("xyz", middle)])
    return Merged(centred, scans, before, n, strategy, tuple(float(c) for c in middle))
