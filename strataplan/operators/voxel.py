"""Voxel aggregation and voxel-set comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import with_scalar


def keys(points: DataFrame, size: int, centred: bool = True) -> DataFrame:
    """Points with voxel indices ``vx, vy, vz``. Centred grids start half a voxel below the
    minimum of the cloud, others at zero."""
    if not centred:
        return points.withColumns({f"v{k}": F.floor(F.col(f"{k}_mm") / float(size)) for k in "xyz"})
    low = points.agg(*[F.min(f"{k}_mm").alias(f"_{k}0") for k in "xyz"])
    return with_scalar(points, low).withColumns({f"v{k}": F.expr(f"(2 * ({k}_mm - _{k}0) + {size}) div {2 * size}") for k in "xyz"}).drop("_x0", "_y0", "_z0")


def downsample(points: DataFrame, size: int, colours: bool = False) -> DataFrame:
    """One mean point (and colour) a voxel."""
    means = [F.avg(f"{k}_mm").alias(k) for k in "xyz"] + ([F.avg(c).alias(c) for c in "rgb"] if colours else [])
    return keys(points, size).groupBy("vx", "vy", "vz").agg(F.count("*").alias("n"), *means)


def overlap(points: DataFrame, size: int, a: int, b: int) -> DataFrame:
    """Voxels of scan ``a``, those shared with scan ``b``, and whether 5 % are."""
    cells = keys(points, size, centred=False).select("scan_id", "vx", "vy", "vz").distinct()
    first = cells.where(F.col("scan_id") == a).drop("scan_id")
    shared = first.join(cells.where(F.col("scan_id") == b).drop("scan_id"), ["vx", "vy", "vz"], "left_semi")
    n = first.agg(F.count("*").alias("n_a"))
    return with_scalar(n, shared.agg(F.count("*").alias("shared"))).select("n_a", "shared", (F.col("shared") >= F.col("n_a") * 0.05).alias("overlap"))


def shared_frame(points: DataFrame, limit: float = 5000.0, size: int = 200) -> DataFrame:
    """Largest distance of a scan's centroid to the mean of the scans' centroids, and whether the
    scans are in one frame: their centroids are spread by the limit or more, or else the first scan
    shares its voxels with the second (by name), or there is one scan only."""
    c = points.groupBy("scan_id").agg(*[F.avg(f"{k}_mm").alias(k) for k in "xyz"])
    mean = c.agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"])
    d = F.sqrt(sum((F.col(k) - F.col(f"m{k}")) * (F.col(k) - F.col(f"m{k}")) for k in "xyz"))
    far = with_scalar(c, mean).agg(F.max(d).alias("spread"), F.count("*").alias("_scans"))
    first = c.agg(F.min("scan_id").alias("_a"))
    second = with_scalar(c, first).where(F.col("scan_id") > F.col("_a")).agg(F.min("scan_id").alias("_b"))
    cells = keys(points, size, centred=False).select("scan_id", "vx", "vy", "vz").distinct()
    cells = with_scalar(with_scalar(cells, first), second)
    own = cells.where(F.col("scan_id") == F.col("_a")).select("vx", "vy", "vz")
    shared = own.join(cells.where(F.col("scan_id") == F.col("_b")).select("vx", "vy", "vz"), ["vx", "vy", "vz"], "left_semi")
    share = with_scalar(own.agg(F.count("*").alias("_n")), shared.agg(F.count("*").alias("_k")))
    same = (F.col("_scans") < 2) | (F.col("spread") >= limit) | (F.col("_k") >= F.col("_n") * 0.05)
    return with_scalar(far, share).select("spread", same.alias("same_frame"))
