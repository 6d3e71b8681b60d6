"""Files written by the executors and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from ..sources import building as src
from ..sources import scan_files, writers
from .registry import query


def _written(df, kind: str, reader: str):
    spark = df.sparkSession
    scan_files.register(spark)
    writers.register(spark)
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    df.write.format(kind).mode("overwrite").save(folder)
    return spark.read.format(reader).load(folder)


@query("written_cloud", f"WITH {src.POINTS_SQL} SELECT x_mm, y_mm, z_mm, r, g, b, count(*) AS n FROM pts GROUP BY ALL")
def written_cloud(spark, d):
    """All points as PLY parts and back, in whole millimetres and colour levels."""
    p = src.points(spark, d).select(*[(F.col(f"{k}_mm") / 1000).alias(k) for k in "xyz"], *[((F.col(c) + 0.5) / 255).alias(c) for c in "rgb"])
    back = _written(p, "ply", "scan")
    return back.groupBy(*[F.round(F.col(k) * 1000).cast("long").alias(f"{k}_mm") for k in "xyz"], "r", "g", "b").agg(F.count("*").alias("n"))


@query("written_plan", f"WITH {src.SEGMENTS_SQL} SELECT CASE WHEN seg_id % 3 = 0 THEN 'MEP' ELSE 'WALLS' END AS layer, x1, y1, x2, y2, count(*) AS n FROM segs WHERE seg_id % 11 <> 0 GROUP BY ALL")
def written_plan(spark, d):
    """All segments of known classes as drawing parts and back; the class of the others is noted, not drawn."""
    kind = F.when(F.col("seg_id") % 11 == 0, "unknown").when(F.col("seg_id") % 3 == 0, "mep").otherwise("walls")
    s = src.segments(spark, d).select(kind.alias("class"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    back = scan_files.plan_edges(_written(s, "dxf_parts", "dxf"))
    return back.groupBy("layer", *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")]).agg(F.count("*").alias("n"))
