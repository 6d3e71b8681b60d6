"""Sparse occupancy rasters ``cells(col, row, n)`` and morphology on them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .filters import with_scalar

PLUS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]  # 3 x 3 ellipse
#: 5 x 5 ellipse: rows of half-width 0, 2, 2, 2, 0
DISC5 = [(0, -2), (0, 2)] + [(dx, dy) for dy in (-1, 0, 1) for dx in range(-2, 3)]


def slice_to_raster(points: DataFrame, low: int, high: int, res: int, least: int = 4, most: int = 16384, up: str = "z", clamp: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cells of a closed height slab, and the one-row raster affine. The way up is z, or y for scans
    that lie on their side, whose plan is then x and z. Points on the far edge of an extent that is a whole
    number of cells are in the last cell, or without ``clamp`` in one beyond it. Raises on an empty slab or
    one too large for ``most`` pixels a side."""
    if res <= 0:
        raise ValueError("resolution must be positive")
    if up not in ("y", "z"):
        raise ValueError("the way up is y or z")
    slab = points.where(F.col(f"{up}_mm").between(low, high))
    if up == "y":
        slab = slab.withColumn("y_mm", F.col("z_mm"))
    ext = slab.agg(F.count("*").alias("n_points"), *[f(f"{k}_mm").alias(f"{k}{i}") for k in "xy" for i, f in ((0, F.min), (1, F.max))])
    side = lambda k: F.greatest(F.ceil((F.col(f"{k}1") - F.col(f"{k}0")) / float(res)), F.lit(least)).cast("long")
    affine = ext.select("n_points", "x0", "y0", F.lit(res).alias("res"), side("x").alias("width"), side("y").alias("height"))
    bad = F.when(F.col("n_points") == 0, F.raise_error(F.lit("the slab is empty"))).when(F.greatest("width", "height") > most, F.raise_error(F.lit("the raster is too large")))
    affine = affine.withColumn("res", F.coalesce(bad.cast("int"), F.col("res")))
    free = lambda k: F.floor((F.col(f"{k}_mm") - F.col(f"{k}0")) / F.col("res").cast("double"))
    at = lambda k, s: (F.least(free(k), F.col(s) - 1) if clamp else free(k)).cast("long")
    cells = with_scalar(slab, affine).select(at("x", "width").alias("col"), at("y", "height").alias("row")).groupBy("col", "row").agg(F.count("*").alias("n"))
    return cells, affine


def slice_metrics(cells: DataFrame, affine: DataFrame) -> DataFrame:
    return with_scalar(affine, cells.agg(F.count("*").alias("n_cells"))).select("n_points", "n_cells", "x0", "y0", "width", "height")


def _offsets(kernel):
    return F.explode(F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in kernel])).alias("o")


def _own(cells: DataFrame) -> list[str]:
    """The column ``building``, where there is one: cells of different buildings have nothing in common."""
    return [c for c in ("building",) if c in cells.columns]


def dilate(cells: DataFrame, kernel=PLUS) -> DataFrame:
    own = _own(cells)
    return cells.select(*own, "col", "row", _offsets(kernel)).select(*own, (F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row")).distinct()


def erode(cells: DataFrame, kernel=PLUS) -> DataFrame:
    """Cells whose whole kernel is set: each set cell votes for the cells it supports, and a cell
    stays with as many votes as the kernel has offsets. No self-join is needed."""
    own = _own(cells)
    votes = cells.select(*own, "col", "row").distinct().select(*own, "col", "row", _offsets(kernel)).select(*own, (F.col("col") - F.col("o.dx")).alias("col"), (F.col("row") - F.col("o.dy")).alias("row"))
    return votes.groupBy(*own, "col", "row").agg(F.count("*").alias("k")).where(F.col("k") == len(kernel)).select(*own, "col", "row")


def close(cells: DataFrame, kernel=PLUS, rounds: int = 1) -> DataFrame:
    """Dilated ``rounds`` times, then eroded as often."""
    out = cells
    for step in (dilate, erode):
        for _ in range(rounds):
            out = step(out, kernel)
    return out


def open_(cells: DataFrame, kernel=PLUS) -> DataFrame:
    return dilate(erode(cells, kernel), kernel)


def cell_id(col="col", row="row"):
    return F.shiftleft(F.col(row) + (1 << 30), 31) + F.col(col) + (1 << 30)


def named_id(cells: DataFrame, col="col", row="row") -> Column:
    """A cell's id, within its building where there is one."""
    own = _own(cells)
    return F.xxhash64(*own, cell_id(col, row)) if own else cell_id(col, row)


def labelled(cells: DataFrame, eight: bool = True) -> DataFrame:
    """Cells with the label of their connected component (smallest cell id)."""
    own = _own(cells)
    near = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if eight else [])
    ids = cells.select(*own, "col", "row").distinct().withColumn("id", named_id(cells))
    step = ids.select(*own, "id", "col", "row", _offsets(near)).select(*own, F.col("id").alias("a"), (F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row"))
    edges = step.join(ids, [*own, "col", "row"]).select("a", F.col("id").alias("b"))
    comp = graph.components(edges).withColumnRenamed("node", "id")
    return ids.join(comp, "id", "left").select(*own, "col", "row", F.coalesce("component", "id").alias("label"))


def largest_component(cells: DataFrame) -> DataFrame:
    """The cells of the largest component, of each building; the smallest label of equals."""
    own = _own(cells)
    lab = labelled(cells)
    sizes = lab.groupBy(*own, "label").agg(F.count("*").alias("k"))
    top = sizes.groupBy(*own).agg(F.min(F.struct((-F.col("k")).alias("k"), "label")).alias("m")).select(*own, "m.label")
    return lab.join(F.broadcast(top) if not own else top, [*own, "label"], "left_semi").select(*own, "col", "row")


def _hole_runs(cells: DataFrame, eight: bool) -> DataFrame:
    """``(a, b, row, label)``: the runs of unset cells between set ones of a row that set cells enclose, and which runs
    make one hole. Runs are labelled, not cells; whatever reaches past the first or last set cell of the row above
    or below is outside."""
    own = _own(cells)
    line = Window.partitionBy(*own, "row").orderBy("col")
    marked = cells.select(*own, "col", "row").distinct().withColumn("last", F.lag("col").over(line))
    gaps = graph.cut(marked.where("col > last + 1").select(*own, "row", (F.col("last") + 1).alias("a"), (F.col("col") - 1).alias("b")).withColumn("id", F.xxhash64(*own, "row", "a")))
    ends = marked.groupBy(*own, "row").agg(F.min("col").alias("first"), F.max("col").alias("end"))
    wide = 1 if eight else 0
    open_ = None
    for step in (-1, 1):
        beside = ends.withColumn("row", F.col("row") + step)
        got = gaps.join(beside, [*own, "row"], "left").where(F.col("first").isNull() | (F.col("a") - wide < F.col("first")) | (F.col("b") + wide > F.col("end"))).select("id")
        open_ = got if open_ is None else open_.unionByName(got)
    below = gaps.select(*own, (F.col("row") + 1).alias("row"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("id").alias("_id"))
    touch = gaps.join(below, [*own, "row"]).where((F.col("a") <= F.col("_b") + wide) & (F.col("_a") <= F.col("b") + wide)).select(F.col("id").alias("a"), F.col("_id").alias("b"))
    comp = graph.components(touch).withColumnRenamed("node", "id")
    named = graph.cut(gaps.join(comp, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"))
    outside = named.join(open_.distinct(), "id", "left_semi").select("label").distinct()
    return named.join(outside, "label", "left_anti")


def holes(cells: DataFrame, largest: int | None = None, eight: bool = False) -> DataFrame:
    """Background cells enclosed by the set ones; with ``largest``, only holes of fewer cells. The background
    is connected by sides, or with ``eight`` by corners too."""
    own = _own(cells)
    runs = _hole_runs(cells, eight)
    if largest is not None:
        small = runs.groupBy("label").agg(F.sum(F.col("b") - F.col("a") + 1).alias("k")).where(F.col("k") < largest).select("label")
        runs = runs.join(small, "label", "left_semi")
    return runs.select(*own, F.explode(F.sequence("a", "b")).alias("col"), "row")


def fill_holes(cells: DataFrame, largest: int | None = None, eight: bool = False) -> DataFrame:
    own = _own(cells)
    return cells.select(*own, "col", "row").distinct().unionByName(holes(cells, largest, eight))


def blur(cells: DataFrame, weights: dict[tuple[int, int], float]) -> DataFrame:
    """Weighted sum over a small kernel; only cells in reach of a set cell have a value."""
    own = _own(cells)
    table = F.explode(F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"), F.lit(w).alias("w")) for (dx, dy), w in weights.items()])).alias("o")
    return cells.select(*own, "col", "row", table).groupBy(*own, (F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row")).agg(F.sum("o.w").alias("v"))


def gradients(shades: DataFrame) -> DataFrame:
    """Sobel sums ``gx, gy`` of ``(col, row, v)``, v in 0..1 taken as 0..255 whole; unset cells are 0. Each cell adds to
    the eight around it; cells without a gradient have no row."""
    own = _own(shades)
    around = [(dx, dy, dx * (2 if dy == 0 else 1), dy * (2 if dx == 0 else 1)) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    o = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(a, ("dx", "dy", "sx", "sy"))]) for a in around])).alias("o")
    q = F.round(F.round(F.col("v"), 9) * 255).cast("long")
    return shades.select(*own, "col", "row", q.alias("q"), o).groupBy(*own, (F.col("col") - F.col("o.dx")).alias("col"), (F.col("row") - F.col("o.dy")).alias("row")).agg(
        F.sum(F.col("q") * F.col("o.sx")).alias("gx"), F.sum(F.col("q") * F.col("o.sy")).alias("gy")).where("gx <> 0 OR gy <> 0")


#: tangent of 22.5 degrees times 2^15 (fixed value)
TAN_22 = 13573


def thin_edges(slopes: DataFrame, low: int = 40, high: int = 120) -> DataFrame:
    """``(col, row, strong)``: cells whose gradient exceeds ``low`` and is a maximum across the edge; ``strong`` above
    ``high``. Magnitudes are compared squared, as integers; each cell tells its eight neighbours its own."""
    own = _own(slopes)
    m = slopes.withColumn("m", F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    near = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    told = m.select(*own, "col", "row", "gx", "gy", "m", _offsets(near)).select(*own, (F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row"), F.col("o.dx").alias("dx"), F.col("o.dy").alias("dy"), "gx", "gy", "m")
    name = lambda dx, dy: f"m{dx + 1}{dy + 1}"
    here = (F.col("dx") == 0) & (F.col("dy") == 0)
    # the cell at (dx, dy) told it from the other side
    seen = told.groupBy(*own, "col", "row").agg(
        *[F.coalesce(F.max(F.when((F.col("dx") == -dx) & (F.col("dy") == -dy), F.col("m"))), F.lit(0)).alias(name(dx, dy)) for dx, dy in near if dx or dy], *[F.max(F.when(here, F.col(c))).alias(c) for c in ("gx", "gy", "m")])
    x, y = F.abs("gx"), F.abs("gy") * 32768
    flat, steep = x * TAN_22, x * TAN_22 + x * 65536
    above = lambda a, b, tie: (F.col("m") > F.col(name(*a))) & ((F.col("m") >= F.col(name(*b))) if tie else (F.col("m") > F.col(name(*b))))
    keep = F.when(y < flat, above((-1, 0), (1, 0), True)).when(y > steep, above((0, -1), (0, 1), True)).when((F.col("gx") < 0) != (F.col("gy") < 0), above((1, -1), (-1, 1), False)).otherwise(above((-1, -1), (1, 1), False))
    return seen.where((F.col("m") > low * low) & keep).select(*own, "col", "row", (F.col("m") > high * high).alias("strong"))


def edge_cells(shades: DataFrame, low: int = 40, high: int = 120) -> DataFrame:
    """Edges of a grey raster ``(col, row, v)``: gradient, thinning across it, and of the thin cells those that touch,
    however far along the edge, one above ``high``."""
    thin = graph.cut(thin_edges(gradients(shades), low, high))
    own = _own(thin)
    lab = labelled(thin)
    strong = lab.join(thin.where("strong"), [*own, "col", "row"], "left_semi").select(*own, "label").distinct()
    return lab.join(strong, [*own, "label"], "left_semi").select(*own, "col", "row")


def gaussian(size: int, sigma: float) -> dict[tuple[int, int], float]:
    import math

    half = size // 2
    raw = {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) for dx in range(-half, half + 1) for dy in range(-half, half + 1)}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def ellipse(size: int) -> list[tuple[int, int]]:
    """The cells of a round kernel of odd size."""
    if size == 1:
        return [(0, 0)]
    return {3: PLUS, 5: DISC5}[size]


@dataclass(frozen=True)
class Preprocess:
    """Steps before line detection; a size or count of zero leaves a step out."""

    close_size: int = 3
    close_rounds: int = 2
    open_size: int = 0
    open_rounds: int = 0
    blur_size: int = 3
    fill_holes: bool = False


def preprocess(cells: DataFrame, params: Preprocess = Preprocess()) -> DataFrame:
    """``(col, row, v)``, v in 0..1: gaps closed, speckle opened, holes filled, edges softened."""
    out = cells.select(*_own(cells), "col", "row").distinct()
    for size, rounds, steps in ((params.close_size, params.close_rounds, (dilate, erode)), (params.open_size, params.open_rounds, (erode, dilate))):
        if size and rounds:
            for step in steps:
                for _ in range(rounds):
                    out = step(out, ellipse(size))
    if params.fill_holes:
        out = fill_holes(out)
    if not params.blur_size:
        return out.withColumn("v", F.lit(1.0))
    size = params.blur_size | 1
    return blur(out, gaussian(size, 0.3 * ((size - 1) * 0.5 - 1) + 0.8))


def image(cells: DataFrame) -> tuple[np.ndarray, int, int]:
    """The grey picture of ``(col, row, v)`` cells, north up, and its first column and row. A raster is
    bounded by its building and its resolution (see ``most`` in :func:`slice_to_raster`)."""
    f = cells.toPandas()
    c0, r0 = int(f["col"].min()), int(f["row"].min())
    out = np.zeros((int(f["row"].max()) - r0 + 1, int(f["col"].max()) - c0 + 1), np.uint8)
    out[f["row"] - r0, f["col"] - c0] = np.clip(np.round(f["v"] * 255), 0, 255)
    return out[::-1], c0, r0


def hough_votes(cells: DataFrame, step_deg: float = 5.0, rho: float = 1.0) -> DataFrame:
    """Votes of the cells for lines (theta bin, rho bin): a row a cell and angle, then a count."""
    n = round(180 / step_deg)
    t = F.radians(F.col("theta") * step_deg)
    return cells.select("col", "row", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("theta")).groupBy(
        "theta", F.floor(F.round((F.col("col") * F.cos(t) + F.col("row") * F.sin(t)) / rho, 6) + 0.5).alias("rho")).agg(F.count("*").alias("votes"))


def line_cells(segments: DataFrame) -> DataFrame:
    """Distinct cells of segments ``(ax, ay, bx, by_)`` in cell units: one step a cell of the
    longer side, rounded half up on the other."""
    n = segments.withColumn("n", F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by_") - F.col("ay"))))
    own = _own(segments)
    e = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = lambda a, b: F.expr(f"{a} + ((abs({b} - {a}) * i + n div 2) div greatest(n, 1)) * (case when {b} >= {a} then 1 else -1 end)")
    return e.select(*own, at("ax", "bx").alias("col"), at("ay", "by_").alias("row")).distinct()


def _envelope(at: np.ndarray, f: np.ndarray, x: np.ndarray) -> np.ndarray:
    """min over i of (x - at[i])^2 + f[i] for each x, all integers and in order: the lower envelope of parabolas."""
    at, f = at.tolist(), f.tolist()
    held: list[int] = []  # parabolas of the envelope, and where each one begins
    begin: list[float] = []
    for q in range(len(at)):
        while held:
            v = held[-1]
            s = ((f[q] + at[q] * at[q]) - (f[v] + at[v] * at[v])) / (2 * (at[q] - at[v]))
            if s > begin[-1]:
                break
            held.pop()
            begin.pop()
        held.append(q)
        begin.append(s if len(held) > 1 else -np.inf)
    k = np.searchsorted(np.array(begin), x, side="left") - 1
    a, g = np.array(at, np.int64)[held], np.array(f, np.int64)[held]
    return (x - a[k]) ** 2 + g[k]


def _along_rows(rows: DataFrame, run, schema: str) -> DataFrame:
    own = _own(rows)
    kind = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in own)

    def whole(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = run(f.sort_values("col"))
        out.insert(0, "row", int(key[-1]))
        for c, k in zip(own, key):
            out.insert(0, c, pd.Series([k] * len(out), dtype=object))
        return out

    return rows.groupBy(*own, "row").applyInPandas(whole, f"{kind}row long, {schema}")


def free_distance(cells: DataFrame) -> DataFrame:
    """Distance of each unset cell of the bounding box (of each building) to the nearest set one, in two passes:
    along each column to the set cells above and below, then along each row the lower envelope of the columns'
    parabolas. A group is a column, then a row."""
    own = _own(cells)
    box = cells.groupBy(*own).agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
    line = Window.partitionBy(*own, "col").orderBy("row")
    columns = cells.select(*own, "col", "row").distinct().withColumns({"last": F.lag("row").over(line), "next": F.lead("row").over(line)})
    columns = columns.join(F.broadcast(box), own) if own else with_scalar(columns, box)
    # a set cell speaks for the cells down to the middle of the gap before it and up to that of the gap after
    low = F.when(F.col("last").isNull(), F.col("r0")).otherwise(F.floor((F.col("last") + F.col("row")) / 2) + 1)
    high = F.when(F.col("next").isNull(), F.col("r1")).otherwise(F.floor((F.col("row") + F.col("next")) / 2))
    upright = columns.withColumn("y", F.explode(F.sequence(low, high))).select(*own, "col", F.col("y").alias("row"), F.abs(F.col("y") - F.col("row")).alias("g"), "c0", "c1")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        at, g = f["col"].to_numpy(np.int64), f["g"].to_numpy(np.int64)
        x = np.setdiff1d(np.arange(f["c0"].iloc[0], f["c1"].iloc[0] + 1), at[g == 0])
        return pd.DataFrame({"col": x, "dist": np.sqrt(_envelope(at, g * g, x))})

    return _along_rows(upright, run, "col long, dist double").select(*own, "col", "row", "dist")


def depth(cells: DataFrame) -> DataFrame:
    """``h``: squared distance of each set cell to the nearest unset one, in the same two passes, on set cells
    alone: runs of them along a column, then along a row."""
    own = _own(cells)
    up = Window.partitionBy(*own, "col").orderBy("row")
    runs = cells.select(*own, "col", "row").distinct().withColumn("_run", F.col("row") - F.row_number().over(up))
    span = Window.partitionBy(*own, "col", "_run")
    g = F.least(F.col("row") - F.min("row").over(span), F.max("row").over(span) - F.col("row")) + 1
    upright = runs.select(*own, "col", "row", g.alias("g"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        at, g = f["col"].to_numpy(np.int64), f["g"].to_numpy(np.int64)
        out = np.empty(len(at), np.int64)
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 1) + 1):
            x = at[part]
            out[part] = _envelope(np.concatenate([[x[0] - 1], x, [x[-1] + 1]]), np.concatenate([[0], g[part] ** 2, [0]]), x)
        return pd.DataFrame({"col": at, "h": out})

    return _along_rows(upright, run, "col long, h long").select(*own, "col", "row", "h")


def by_building(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """Apply a kernel to the rows of each building; its column, where there is one, comes first in the
    result. Without one all rows are one building's."""
    if "building" not in rows.columns:
        return rows.groupBy(F.lit(0).alias("_all")).applyInPandas(kernel, schema)

    def run(key: tuple, f) -> pd.DataFrame:
        out = kernel(f)
        out.insert(0, "building", pd.Series([key[0]] * len(out), index=out.index, dtype=object))
        return out

    return rows.groupBy("building").applyInPandas(run, f"building {rows.schema['building'].dataType.simpleString()}, {schema}")
