"""Boundaries of labelled cells as rings, and their simplification, as joins: sides of cells that two cells of a
label share cancel, the rest are chained by pointer doubling; Douglas-Peucker goes in rounds of farthest corners."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import filters, graph, kernels, rings

# sides of a cell, its inside to their left: corner they start from, way they go (0 east, 1 north, 2 west, 3 south)
_SIDES = ((0, 0, 0), (1, 0, 1), (1, 1, 2), (0, 1, 3))
_STEP = ((1, 0), (0, 1), (-1, 0), (0, -1))


def sides(cells: DataFrame) -> DataFrame:
    """``(label, x, y, way)``: sides of the distinct cells ``(label, col, row)`` with no cell of the label beyond, by
    building where there is such a column."""
    own = [*filters.own_keys(cells), "label"]
    # a side between two cells is the same line for both: its lower left corner and whether it stands
    side = F.array(*[F.struct((F.col("col") + x).alias("x"), (F.col("row") + y).alias("y"), F.lit(w).alias("way"), (F.col("col") + x + min(0, _STEP[w][0])).alias("lx"), (F.col("row") + y + min(0, _STEP[w][1])).alias("ly")) for x, y, w in _SIDES])
    each = cells.select(*own, "col", "row").distinct().select(*own, F.explode(side).alias("s")).select(*own, "s.*")
    return each.groupBy(*own, "lx", "ly", (F.col("way") % 2).alias("_stands")).agg(F.count("*").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("way").alias("way")).where("n = 1").select(*own, "x", "y", "way")


def contours(cells: DataFrame, few: int = graph.FEW) -> DataFrame:
    """``(label, ring, place, size, x, y)``: corners of the rings around each label's cells, the cells to the left, so
    that holes run clockwise. A ring starts at its smallest corner. Where cells meet at a corner only, each keeps
    its own ring, as regions are joined by their sides."""
    own = [*filters.own_keys(cells), "label"]
    s = graph.cut(sides(cells).orderBy(*own, "x", "y", "way").withColumn("id", F.monotonically_increasing_id()))
    way = lambda i: F.element_at(F.array(*[F.lit(w[i]) for w in _STEP]), F.col("way") + 1)
    into = s.select(*own, "id", (F.col("x") + way(0)).alias("x"), (F.col("y") + way(1)).alias("y"), F.col("way").alias("_from"))
    out = s.select(*own, "x", "y", F.col("id").alias("next"), F.col("way").alias("_to"))
    # a left turn before straight on before a right turn
    turn = F.pmod(F.col("_from") + 1 - F.col("_to"), F.lit(4))
    steps = into.join(out, [*own, "x", "y"]).groupBy("id").agg(F.min_by("next", turn).alias("next"))
    return s.join(rings.cycles(steps, few), "id").select(*own, "ring", "place", "size", "x", "y")


def measured(corners: DataFrame) -> DataFrame:
    """``(label, ring, size, area)`` of rings, the area in cells: negative for holes."""
    own = [*filters.own_keys(corners), "label"]
    w = Window.partitionBy("ring").orderBy("place")
    # by ring start, so that products stay small; a ring's sum is the same from any corner
    first = corners.where("place = 0").select("ring", F.col("x").alias("_x"), F.col("y").alias("_y"))
    rel = corners.join(first, "ring").select(*own, "ring", "size", "place", (F.col("x") - F.col("_x")).alias("x"), (F.col("y") - F.col("_y")).alias("y"))
    nxt = rel.withColumns({"u": F.coalesce(F.lead("x").over(w), F.lit(0)), "v": F.coalesce(F.lead("y").over(w), F.lit(0))})
    return nxt.groupBy(*own, "ring").agg(F.max("size").alias("size"), (F.sum(F.expr("x * v - u * y")) / 2).alias("area"))


def longest(corners: DataFrame) -> DataFrame:
    """The rows of each label's longest ring; of equals the one of smallest corner."""
    own = [*filters.own_keys(corners), "label"]
    best = corners.groupBy(*own).agg(F.min(F.struct((-F.col("size")).alias("size"), "ring")).alias("m")).select(F.col("m.ring").alias("ring"))
    return corners.join(best, "ring", "left_semi").select(*corners.columns)


def _small(tolerance: float, names: list[str]):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place", ignore_index=True)
        places = f["place"].tolist()
        line = [(x, y) for x, y in zip(f["x"].tolist(), f["y"].tolist())]
        kept = kernels.simplify_at([*line, line[0]], tolerance)[:-1]
        out = f.iloc[kept].reset_index(drop=True)
        out["place"], out["size"] = [places[i] for i in kept], len(kept)
        return out[names]

    return run


def simplified(corners: DataFrame, tolerance: float = 1.0, few: int = graph.FEW) -> DataFrame:
    """Douglas-Peucker on closed rings: the rows that are kept, ``place`` as it was, ``size`` what is left. Of equally
    far corners the first splits. A ring of at most ``few`` corners is one group's work, a longer one goes in rounds:
    each splits every open stretch at its farthest corner, and a stretch within the tolerance ends."""
    names = corners.columns
    held = graph.cut(corners)
    small = held.where(F.col("size") <= few).groupBy("ring").applyInPandas(_small(float(tolerance), names), held.schema)
    long = held.where(F.col("size") > few)
    if not long.take(1):
        return small
    start = long.where("place = 0").select("ring", F.col("x").alias("ax"), F.col("y").alias("ay"))
    # a stretch: its first and last place, and their corners; a ring's first corner is also its end
    open_ = graph.cut(long.where("place > 0").select("ring", "place", "x", "y", F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi")).join(start, "ring").withColumns({"bx": F.col("ax"), "by_": F.col("ay")}))
    kept = [long.where("place = 0").select("ring", "place")]
    while open_.take(1):
        run = F.expr("sqrt(CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE))")
        point = F.expr("ax = bx AND ay = by_")
        off = F.when(point, F.expr("(x - ax) * (x - ax) + (y - ay) * (y - ay)")).otherwise(F.expr("abs((bx - ax) * (y - ay) - (by_ - ay) * (x - ax))")).cast("double")
        limit = F.when(point, F.lit(float(tolerance)) ** 2).otherwise(run * F.lit(float(tolerance)))
        far = open_.withColumns({"_off": off, "_limit": limit}).where("_off > _limit")
        cuts = graph.cut(far.groupBy("ring", "lo").agg(F.min(F.struct((-F.col("_off")).alias("o"), "place", "x", "y")).alias("m")).select("ring", "lo", F.col("m.place").alias("at"), F.col("m.x").alias("mx"), F.col("m.y").alias("my")))
        kept.append(cuts.select("ring", F.col("at").alias("place")))
        left = F.col("place") < F.col("at")
        pick = lambda c, low, high: F.when(left, F.col(low)).otherwise(F.col(high)).alias(c)
        nxt = open_.join(filters.if_small(cuts), ["ring", "lo"]).where("place <> at").select(
            "ring", "place", "x", "y", pick("lo", "lo", "at"), pick("hi", "at", "hi"), pick("ax", "ax", "mx"), pick("ay", "ay", "my"), pick("bx", "mx", "bx"), pick("by_", "my", "by_"))
        last, open_ = open_, graph.cut(nxt)
        graph.drop(last)
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    sizes = every.groupBy("ring").agg(F.count("*").alias("size"))
    return small.unionByName(long.drop("size").join(every, ["ring", "place"]).join(sizes, "ring").select(*names))
