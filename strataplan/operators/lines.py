"""Line segments of a raster: Hough peaks split into runs, and regions of one orientation. Rows of different
``building``, where there is such a column, have nothing in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import filters, graph, raster, segments


def _lines_of(cells: DataFrame, bins: int) -> DataFrame:
    """Each cell with every line (theta bin, rho) through it."""
    own = raster._own(cells)
    t = F.radians(F.col("theta") * (180.0 / bins))
    spread = cells.select(*own, "col", "row", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("theta"))
    return spread.withColumn("rho", F.floor(F.round(F.col("col") * F.cos(t) + F.col("row") * F.sin(t), 6) + 0.5))


def _peaks(tally: DataFrame, bins: int) -> DataFrame:
    """The lines that none of the eight beside them exceeds; of equals the first. Past the last theta come the first
    ones, with rho turned."""
    own = raster._own(tally)
    rank = F.struct((-F.col("votes")).alias("v"), "theta", "rho")
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("dt"), F.lit(b).cast("long").alias("dr")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("o")
    there = F.col("theta") + F.col("o.dt")
    turned = (there < 0) | (there >= bins)
    told = tally.select(*own, "theta", "rho", rank.alias("rank"), near).select(*own, "rank", F.pmod(there, F.lit(bins)).alias("theta"), F.when(turned, -F.col("rho")).otherwise(F.col("rho")).alias("rho"), "o.dr").withColumn("rho", F.col("rho") + F.col("dr"))
    best = told.groupBy(*own, "theta", "rho").agg(F.min("rank").alias("best"))
    return tally.join(best, [*own, "theta", "rho"]).where(rank == F.col("best")).drop("best")


def _round(cells: DataFrame, votes: int, least: float, gap: float, bins: int) -> DataFrame:
    """Cells with the run they are in: every cell counts for the fullest peak line it is on (within one cell); a line's
    cells are split where they are more than ``gap`` apart."""
    own = raster._own(cells)
    line = [*own, "theta", "rho"]
    through = _lines_of(cells, bins)
    peaks = graph.cut(_peaks(through.groupBy(*line).agg(F.count("*").alias("votes")).where(F.col("votes") >= votes), bins))
    wide = peaks.select(*own, "theta", F.col("rho").alias("line"), F.explode(F.sequence(F.col("rho") - 1, F.col("rho") + 1)).alias("rho"), "votes")
    rank = F.struct((-F.col("votes")).alias("v"), "theta", F.col("line").alias("rho"))
    on = through.join(filters.if_small(wide), line).groupBy(*own, "col", "row").agg(F.min(rank).alias("r")).select(*own, "col", "row", "r.theta", "r.rho")
    t = F.radians(F.col("theta") * (180.0 / bins))
    on = on.withColumn("along", F.round(F.col("row") * F.cos(t) - F.col("col") * F.sin(t), 6))
    order = Window.partitionBy(*line).orderBy("along", "col", "row")
    new = (F.col("along") - F.lag("along").over(order) > gap).cast("int")
    return on.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("run", F.sum("new").over(order)).drop("new")


def hough_segments(cells: DataFrame, votes: int = 30, least: float = 20.0, gap: float = 5.0, bins: int = 360, rounds: int = 6) -> DataFrame:
    """Segments ``(theta, rho, x1, y1, x2, y2, n)`` in cells. A round takes the runs of at least ``least`` on all peak
    lines at once, and their cells leave; rounds end when none is found, at the latest after ``rounds``."""
    own = raster._own(cells)
    left, found = graph.cut(cells.select(*own, "col", "row").distinct()), []
    t = F.radians(F.col("theta") * (180.0 / bins))
    x, y = (lambda a: F.col("rho") * F.cos(t) - F.col(a) * F.sin(t)), (lambda a: F.col("rho") * F.sin(t) + F.col(a) * F.cos(t))
    for _ in range(rounds):
        on = graph.cut(_round(left, votes, least, gap, bins))
        runs = graph.cut(on.groupBy(*own, "theta", "rho", "run").agg(F.min("along").alias("a"), F.max("along").alias("b"), F.count("*").alias("n")).where(F.col("b") - F.col("a") >= least))
        if not runs.take(1):
            break
        found.append(runs.select(*own, "theta", "rho", x("a").alias("x1"), y("a").alias("y1"), x("b").alias("x2"), y("b").alias("y2"), "n"))
        gone = on.join(runs.select(*own, "theta", "rho", "run"), [*own, "theta", "rho", "run"], "left_semi")
        left = graph.cut(left.join(gone.select(*own, "col", "row"), [*own, "col", "row"], "left_anti"))
    if not found:
        return cells.limit(0).select(*own, F.lit(0).alias("theta"), F.lit(0).cast("long").alias("rho"), *[F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0).cast("long").alias("n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def regions(slopes: DataFrame, tolerance: float = 22.5) -> DataFrame:
    """``(col, row, label)`` of cells ``(col, row, gx, gy)``: neighbours whose gradients differ by at most ``tolerance``
    degrees are one region, however far it grows; opposite gradients are one orientation."""
    own = raster._own(slopes)
    turn = F.pmod(F.round(F.degrees(F.atan2(F.col("gy").cast("double"), F.col("gx").cast("double"))), 6), F.lit(180.0))
    cells = graph.cut(slopes.select(*own, "col", "row", turn.alias("turn"), raster.named_id(slopes).alias("id")))
    step = cells.select(*own, "turn", F.col("id").alias("a"), "col", "row", raster._offsets([(1, 0), (0, 1), (1, 1), (1, -1)])).select(*own, F.col("turn").alias("_turn"), "a", (F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row"))
    like = step.join(cells, [*own, "col", "row"]).where(filters.circular_diff(F.col("turn"), F.col("_turn")) <= tolerance).select("a", F.col("id").alias("b"))
    comp = graph.components(like).withColumnRenamed("node", "id")
    return cells.join(comp, "id", "left").select(*own, "col", "row", F.coalesce("component", "id").alias("label"))


def grown_segments(slopes: DataFrame, least_cells: int = 5, least: float = 10.0, tolerance: float = 22.5) -> DataFrame:
    """``(label, n, x1, y1, x2, y2)`` in cells: the principal line of each region."""
    own = raster._own(slopes)
    lab = regions(slopes, tolerance)
    key = F.struct(*own, "label") if own else F.col("label")
    lines = segments.pca_lines(lab.select(key.alias("label"), F.col("col").alias("x_mm"), F.col("row").alias("y_mm")), "label", least_cells, least)
    return lines.select(*[F.col(f"label.{c}").alias(c) for c in own], (F.col("label.label") if own else F.col("label")).alias("label"), "n", "x1", "y1", "x2", "y2")
