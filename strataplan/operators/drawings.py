"""From the entities of a drawing to labelled rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters, graph, rings, scalars, spatial


def closed_outlines(vertices: DataFrame, least: float = 0.5, cell: float = 5.0) -> DataFrame:
    """Edges ``(by, face, hole, place, ox, oy, dx, dy)`` of the closed polylines of a ``dxf`` table that have three
    corners, do not cross or touch themselves and enclose more than ``least``; ``by`` is the file, ``face``
    the entity."""
    from ..sources.scan_files import plan_edges

    v = vertices.where("closed AND kind IN ('LWPOLYLINE', 'POLYLINE')")
    enough = v.groupBy("file", "entity").agg(F.count("*").alias("_n")).where("_n >= 3").select("file", "entity")
    sides = graph.cut(plan_edges(v.join(enough, ["file", "entity"], "left_semi")).where("x1 <> x2 OR y1 <> y2"))
    ring = F.struct("file", "entity")
    met = rings.cuts(sides.select(ring.alias("by"), F.col("vertex").cast("long").alias("seg_id"), "x1", "y1", "x2", "y2"), cell).select("by.*")
    twice = sides.groupBy("file", "entity", "x1", "y1").agg(F.count("*").alias("_n")).where("_n > 1").select("file", "entity")
    area = sides.groupBy("file", "entity").agg((F.abs(F.sum(rings.shoelace("x1", "y1", "x2", "y2"))) / 2).alias("_a")).where(F.col("_a") > least).select("file", "entity")
    good = area.join(met.unionByName(twice).distinct(), ["file", "entity"], "left_anti")
    return sides.join(good, ["file", "entity"], "left_semi").select(
        F.col("file").alias("by"), F.col("entity").cast("long").alias("face"), F.lit(None).cast("long").alias("hole"), F.col("vertex").cast("long").alias("place"), F.col("x1").alias("ox"), F.col("y1").alias("oy"), F.col("x2").alias("dx"), F.col("y2").alias("dy"))


def line_faces(vertices: DataFrame, least: float = 0.5, cell: float = 5.0, snap: float = 1e-6) -> DataFrame:
    """Edges of the faces that all lines and polylines of each file enclose. Lines are stored, since faces count them
    first."""
    from ..sources.scan_files import plan_edges

    lines = plan_edges(vertices).where("x1 <> x2 OR y1 <> y2")
    # an edge's number within its file: entity and vertex, both below 2^31
    return rings.faces(graph.cut(lines.select(F.col("file").alias("by"), (F.shiftleft(F.col("entity").cast("long"), 31) + F.col("vertex")).alias("seg_id"), "x1", "y1", "x2", "y2")), cell, snap, least)


def texts(vertices: DataFrame) -> DataFrame:
    """``(file, entity, kind, text, x, y)``: TEXT and MTEXT entities, stripped."""
    return vertices.where("kind IN ('TEXT', 'MTEXT')").select("file", "entity", "kind", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "x", "y")


def first_labels(sides: DataFrame, labels: DataFrame, cell: int = 5) -> DataFrame:
    """``(by, face, text)``: the first label inside each face, TEXT before MTEXT, then by entity; holes are not
    inside."""
    spots = labels.select(F.col("file").alias("by"), F.struct((F.col("kind") == "MTEXT").alias("late"), "entity").alias("turn"), "text", F.col("x").alias("x_mm"), F.col("y").alias("y_mm"))
    around = sides.select("by", "face", F.col("ox").alias("x0"), F.col("oy").alias("y0"), F.col("dx").alias("x1"), F.col("dy").alias("y1"))
    return spatial.points_in_polygons(spots, around, "face", cell, "by").groupBy("by", "face").agg(F.min_by("text", "turn").alias("text"))


def rooms(vertices: DataFrame, least: float = 0.5) -> DataFrame:
    """``(file, room_id, label, category, cx, cy, area_m2, polygon)`` of each file of a ``dxf`` table: its closed
    outlines in their order, or, with fewer than two of them, the faces of its lines, the largest first. A room
    without a label is named by its number."""
    closed = graph.cut(closed_outlines(vertices, least))
    many = closed.groupBy("by").agg(F.count_distinct("face").alias("_n")).where("_n >= 2").select("by")
    found = line_faces(vertices.join(many.select(F.col("by").alias("file")), "file", "left_anti"), least)
    sides = graph.cut(closed.join(many, "by", "left_semi").withColumn("drawn", F.lit(True)).unionByName(found.withColumn("drawn", F.lit(False))))
    facts = rings.measured(sides).join(sides.select("by", "face", "drawn").distinct(), ["by", "face"]).join(first_labels(sides, texts(vertices)), ["by", "face"], "left").join(rings.outlines(sides), ["by", "face"])
    turn = [F.when(F.col("drawn"), F.col("face").cast("double")).otherwise(-F.round("area", 6)), F.round("cx", 6), F.round("cy", 6)]
    named = filters.numbered(facts, F.col("by"), turn, "n")
    label = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.format_string("Room-%03d", "n"))
    return named.withColumn("label", label).select(
        F.col("by").alias("file"), F.format_string("room-%03d", "n").alias("room_id"), "label", scalars.category(F.col("label")).alias("category"), "cx", "cy", F.col("area").alias("area_m2"), "corners", "polygon")
