"""Scalar column functions: colours, grids, transforms, scores and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import with_scalar


def normalised_rgb(points: DataFrame) -> DataFrame:
    """Colours in [0, 1]: as they are up to 1, by 255 up to 255, else by 65535."""
    top = points.agg(F.greatest(F.max("r"), F.max("g"), F.max("b")).alias("_top"))
    scale = F.when(F.col("_top") <= 1, 1.0).when(F.col("_top") <= 255, 255.0).otherwise(65535.0)
    out = with_scalar(points, top)
    return out.withColumns({c: F.col(c) / scale for c in "rgb"}).drop("_top")


def normalised_intensity(points: DataFrame) -> DataFrame:
    """Clip to the 2nd and 98th percentile, scale by their distance (1 at least)."""
    q = points.agg(F.percentile("intensity", [0.02, 0.98]).alias("_q")).select(F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    i = F.col("intensity").cast("double")
    level = (F.least(F.greatest(i, F.col("_lo")), F.col("_hi")) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1.0))
    return with_scalar(points, q).withColumn("level", level).drop("_lo", "_hi")


def intensity_colours(level: Column) -> list[Column]:
    return [(level * 0.40).alias("r"), (level * 0.85).alias("g"), F.least(F.greatest(level * 0.45 + 0.55, F.lit(0.0)), F.lit(1.0)).alias("b")]


def transform(matrix: list[list[float]], x: Column, y: Column, z: Column) -> list[Column]:
    """Apply a 4 x 4 row-major affine matrix."""
    return [x * F.lit(r[0]) + y * F.lit(r[1]) + z * F.lit(r[2]) + F.lit(r[3]) for r in matrix[:3]]


def rotation_matrix(degrees: float, cx: float = 0.0, cy: float = 0.0, tx: float = 0.0, ty: float = 0.0) -> list[list[float]]:
    """Rotation about (cx, cy) in the plan, then a shift."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [[c, -s, 0.0, cx - c * cx + s * cy + tx], [s, c, 0.0, cy - s * cx - c * cy + ty], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]


def centred(points: DataFrame) -> DataFrame:
    """Coordinates less their centroid, which stays as ``cx, cy, cz``."""
    c = points.agg(*[F.avg(f"{k}_mm").alias(f"c{k}") for k in "xyz"])
    return with_scalar(points, c).withColumns({k: F.col(f"{k}_mm") - F.col(f"c{k}") for k in "xyz"})


def grid_index(v: Column, origin: Column | int, cell: int, top: int, truncating: bool = False) -> Column:
    """Cell of a coordinate, clipped to [0, top]; floor, or truncation toward zero."""
    d = v - origin
    raw = d / F.lit(float(cell))
    at = raw.cast("long") if truncating else F.floor(raw)
    return F.least(F.greatest(at, F.lit(0)), F.lit(top)).cast("long")


def to_pixel(v: Column, origin: int, res: int) -> Column:
    return F.floor((v - origin) / F.lit(float(res))).cast("long")


def to_world(pixel: Column, origin: int, res: int, centre: bool) -> Column:
    return (pixel + (0.5 if centre else 0.0)) * float(res) + float(origin)


def alignment_confidence(rmse: Column, inlier: Column, support: Column) -> Column:
    """0.5 rmse score (0 to 50 mm) + 0.3 inlier ratio + 0.2 support of 12."""
    near = F.greatest(1.0 - rmse * 1000.0 / 50.0, F.lit(0.0))
    return near * 0.5 + F.least(inlier, F.lit(1.0)) * 0.3 + F.least(support / 12.0, F.lit(1.0)) * 0.2


def percent(c: Column) -> Column:
    """Clip to 0..100, round half to even."""
    return F.bround(F.least(F.greatest(c * 100.0, F.lit(0.0)), F.lit(100.0)), 0).cast("long")


def confidence_label(pct: Column) -> Column:
    return F.when(pct >= 90, "high").when(pct >= 70, "medium").otherwise("low")


# keyword categories of labels, first match wins (fixed values)
CATEGORIES = [
    ("bathroom", ["rr", "restroom", "bathroom", "toilet", "wc", "lavatory", "lav"]),
    ("hallway", ["corridor", "hall", "hallway", "passage", "egress", "stair"]),
    ("common", ["lobby", "reception", "lounge", "break", "kitchen", "café", "cafe", "elev", "elevator", "lift", "mail", "copy", "server"]),
    ("office", ["office", "conf", "meeting", "board", "room", "suite"]),
]
# display colours and names of categories (fixed values)
CATEGORY_COLOURS = {"office": 0x3B82F6, "bathroom": 0x14B8A6, "hallway": 0xEAB308, "common": 0xA855F7, "unknown": 0x6B7280}
CATEGORY_NAMES = {"office": "Office / Meeting", "bathroom": "Bathroom", "hallway": "Hallway / Corridor", "common": "Common / Lobby", "unknown": "Unknown"}
# position and red, green, blue of the height ramp (fixed values)
HEIGHT_STOPS = [(0.00, 0.07, 0.12, 0.40), (0.30, 0.10, 0.47, 0.82), (0.60, 0.22, 0.74, 0.88), (1.00, 0.78, 0.94, 1.00)]


def category(text: Column) -> Column:
    """Category by substring of the lower-cased label; unknown if none."""
    out = F.lit("unknown")
    for name, words in reversed(CATEGORIES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def hsl_hue(depth: Column) -> Column:
    """Depth 0.02..0.30 m to hue 0.5..0."""
    t = F.least(F.greatest((depth - 0.02) / 0.28, F.lit(0.0)), F.lit(1.0))
    return 0.5 - t * 0.5


def height_ramp(t: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise-linear ramp through (position, value) stops."""
    out = F.lit(stops[-1][1])
    for (p0, v0), (p1, v1) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(t <= p1, F.lit(v0) + (t - p0) / (p1 - p0) * (v1 - v0)).otherwise(out)
    return F.when(t <= stops[0][0], F.lit(stops[0][1])).otherwise(out)


def voxel_estimate(points: DataFrame, target: int) -> DataFrame:
    """Voxel size (metres) that leaves about ``target`` points: cube root of volume per point,
    0.001 at least; corrected once where a trial count is off by more than 1.3."""
    ext = points.agg(*[((F.max(f"{k}_mm") - F.min(f"{k}_mm")) / 1000.0).alias(f"e{k}") for k in "xyz"], *[F.min(f"{k}_mm").alias(f"m{k}") for k in "xyz"])
    first = ext.select("*", F.greatest(F.pow(F.greatest(F.col("ex"), F.lit(0.001)) * F.greatest(F.col("ey"), F.lit(0.001)) * F.greatest(F.col("ez"), F.lit(0.001)) / target, F.lit(1 / 3)), F.lit(0.001)).alias("v0"))
    v = F.greatest(F.bround(F.col("v0") * 1000, 0).cast("long"), F.lit(1))
    cells = with_scalar(points, first.select("mx", "my", "mz", v.alias("v"))).select(*[F.floor((F.col(f"{k}_mm") - F.col(f"m{k}")) / F.col("v")).alias(k) for k in "xyz"]).distinct().agg(F.count("*").alias("trial"))
    ratio = F.col("trial") / float(target)
    return first.crossJoin(cells).select("v0", "trial", F.when(ratio > 1.3, F.col("v0") * F.pow(ratio, F.lit(1 / 3))).otherwise(F.col("v0")).alias("voxel"))


def safe_filename(name: Column, default: str = "") -> Column:
    """Base name with only letters, digits, dot, underscore and hyphen; no double dots."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    clean = F.replace(F.regexp_replace(base, r"[^\p{L}\p{N}._-]", ""), F.lit(".."), F.lit("_"))
    return F.when(clean == "", default).otherwise(clean)


def safe_scan_name(name: Column) -> Column:
    """The same for an upload to vectorise, which is never without a name."""
    return safe_filename(name, "scan.laz")


def hashed_id(cx: Column, cy: Column, prefix: str = "room-") -> Column:
    """A stable name from a centroid rounded to whole units: four hex digits of its hash."""
    whole = lambda c: F.round(c).cast("long").cast("string")
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws(":", whole(cx), whole(cy)).cast("binary")), 1, 4))


def lookup(key: Column, table: dict, default) -> Column:
    """Value of a small constant table."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out
