"""Peaks of a height raster and the basins around them: ``heights(col, row, h)``, h a long (squared
distance to the nearest wall), by building where there is such a column.

The watershed is the spanning forest of highest passes rooted in the seeds: of two neighbouring cells (by
sides) the pass is min(h), higher passes first, ties by the cells' places. That order is total within a building, so the
forest does not depend on how the raster is cut into tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, raster

TILE, FEW = 256, graph.FEW


def _window_max(heights: DataFrame, apart: int) -> DataFrame:
    """``top``: the greatest height within ``apart`` cells both ways; columns first, then rows."""
    own = raster._own(heights)
    reach = range(-apart, apart + 1)
    wide = heights.select(*own, "row", "h", F.explode(F.array(*[F.col("col") + i for i in reach])).alias("col")).groupBy(*own, "col", "row").agg(F.max("h").alias("h"))
    return wide.select(*own, "col", "h", F.explode(F.array(*[F.col("row") + i for i in reach])).alias("row")).groupBy(*own, "col", "row").agg(F.max("h").alias("top"))


def turn() -> Column:
    """The order in which cells of equal height are taken: scattered, so that few rounds settle a ridge."""
    return (F.col("col") * 73856093).bitwiseXOR(F.col("row") * 19349663).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def _first_apart(apart: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["t", "col", "row"])
        own = f["building"].tolist() if "building" in f.columns else [0] * len(f)
        near = [(x, y) for x in range(-apart, apart + 1) for y in range(-apart, apart + 1)]
        taken, keep = set(), []
        for b, c, r in zip(own, f["col"].tolist(), f["row"].tolist()):
            keep.append(not any((b, c + x, r + y) in taken for x, y in near))
            if keep[-1]:
                taken.add((b, c, r))
        out = f[np.array(keep, dtype=bool)][[c for c in ("building", "col", "row") if c in f.columns]]
        return out.astype({"building": object}) if "building" in f.columns else out

    return run


def peaks(heights: DataFrame, apart: int, least: int = 1, few: int = FEW) -> DataFrame:
    """Cells of at least ``least`` that no cell within ``apart`` both ways exceeds; of equals that near to each other
    the first by :func:`turn` stays. At most ``few`` cells as high as all around them, which are counted, are gone
    through in turn by one task. More go in rounds: cells that come before all others around them are taken, and
    those around them leave."""
    own = raster._own(heights)
    cells = [*own, "col", "row"]
    left = graph.cut(heights.where(F.col("h") >= least).join(_window_max(heights, apart), cells).where("h = top").select(*cells, F.struct(turn().alias("t"), "col", "row").alias("turn")))
    if graph.is_few(left, few):
        kind = "".join(f"{c} {left.schema[c].dataType.simpleString()}, " for c in own)
        return left.select(*cells, "turn.t").groupBy(F.lit(0).alias("_all")).applyInPandas(_first_apart(apart), f"{kind}col long, row long")
    around = raster._offsets([(dx, dy) for dx in range(-apart, apart + 1) for dy in range(-apart, apart + 1)])
    taken = []
    while left.take(1):
        moved = lambda df, *c: df.select(*own, *c, "col", "row", around).select(*own, *c, (F.col("col") + F.col("o.dx")).alias("col"), (F.col("row") + F.col("o.dy")).alias("row"))
        first = moved(left, "turn").groupBy(*cells).agg(F.min("turn").alias("first"))
        now = graph.cut(left.join(first, cells).where("turn = first").select(*cells))
        taken.append(now)
        rest = graph.cut(left.join(moved(now).distinct(), cells, "left_anti"))
        graph.drop(left)
        left = rest
    out = left.select(*cells)
    for t in taken:
        out = out.unionByName(t)
    return out


def room_seeds(heights: DataFrame, apart: int = 3, small: int = 3) -> DataFrame:
    """Seeds in two passes: peaks at least ``apart`` cells from each other, and, however near, peaks that lie
    ``small`` cells or more from any wall, so that small rooms beside large ones have their own."""
    return peaks(heights, apart).unionByName(peaks(heights, 1, small * small)).distinct()


def _better(w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Positions of passes, the best first."""
    return np.lexsort((hi, lo, -w))


def _jump(ptr: np.ndarray) -> np.ndarray:
    while (ptr[ptr] != ptr).any():
        ptr = ptr[ptr]
    return ptr


def _flood(f: pd.DataFrame) -> pd.DataFrame:
    """One tile with a rim of its neighbours' cells. Each own cell that is no seed goes to the neighbour of its best
    pass, which is in the forest for certain; chains are followed within the tile. Rows by kind: 0 a cell and its
    root, 1 a root that goes on to another tile's cell, 2 the best pass between two roots, 3 one between a root and
    another tile's cell."""
    f = f.sort_values("id", ignore_index=True)
    ids, spot, h, own, seed = f["id"].to_numpy(np.int64), f["spot"].to_numpy(np.int64), f["h"].to_numpy(np.int64), f["own"].to_numpy(bool), f["seed"].to_numpy(bool)
    col, row = f["col"].to_numpy(np.int64), f["row"].to_numpy(np.int64)
    at = {p: i for i, p in enumerate(zip(col.tolist(), row.tolist()))}
    a, b = [], []
    for i, (c, r) in enumerate(zip(col.tolist(), row.tolist())):
        for p in ((c + 1, r), (c, r + 1)):
            if (j := at.get(p)) is not None:
                a.append(i)
                b.append(j)
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    keep = own[a] | own[b]
    a, b = a[keep], b[keep]
    w, lo, hi = np.minimum(h[a], h[b]), np.minimum(spot[a], spot[b]), np.maximum(spot[a], spot[b])
    order = _better(w, lo, hi)
    a, b, w, lo, hi = a[order], b[order], w[order], lo[order], hi[order]
    # the first pass of each cell in this order is its best
    ends = np.stack([a, b], 1).ravel()
    cells, where = np.unique(ends, return_index=True)
    best = np.full(len(f), -1)
    best[cells] = where // 2
    goes = own & ~seed & (best >= 0)
    to = np.arange(len(f))
    to[goes] = a[best[goes]] + b[best[goes]] - np.flatnonzero(goes)
    out = goes & ~own[to]  # leaves the tile
    ptr = np.where(out, np.arange(len(f)), to)
    twin = (ptr[ptr] == np.arange(len(f))) & (ptr > np.arange(len(f)))
    ptr[twin] = np.flatnonzero(twin)
    root = _jump(ptr)
    mine = np.flatnonzero(own)
    parts = [pd.DataFrame({"kind": 0, "a": ids[mine], "b": ids[root[mine]], "w": 0, "lo": 0, "hi": 0})]
    gone = np.flatnonzero(out)
    parts.append(pd.DataFrame({"kind": 1, "a": ids[gone], "b": ids[to[gone]], "w": 0, "lo": 0, "hi": 0}))
    inner = own[a] & own[b]
    ra, rb = ids[root[a]], ids[root[b]]
    k = np.flatnonzero(inner & (ra != rb))
    parts.append(pd.DataFrame({"kind": 2, "a": np.minimum(ra, rb)[k], "b": np.maximum(ra, rb)[k], "w": w[k], "lo": lo[k], "hi": hi[k]}).drop_duplicates(["a", "b"]))
    # a pass across the rim is told by the tile of its first cell
    k = np.flatnonzero(own[a] & ~own[b])
    parts.append(pd.DataFrame({"kind": 3, "a": ra[k], "b": ids[b[k]], "w": w[k], "lo": lo[k], "hi": hi[k]}))
    return pd.concat(parts, ignore_index=True)


def _joined(f: pd.DataFrame) -> pd.DataFrame:
    """All passes of few basins: best first, two parts become one unless both have a seed."""
    f = f.iloc[_better(f["w"].to_numpy(), f["lo"].to_numpy(), f["hi"].to_numpy())]
    names = pd.unique(pd.concat([f["a"], f["b"]]))
    at = {n: i for i, n in enumerate(names.tolist())}
    rooted = np.zeros(len(names), bool)
    rooted[[at[x] for x in pd.concat([f.loc[f["ra"], "a"], f.loc[f["rb"], "b"]]).tolist()]] = True
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(f["a"].tolist(), f["b"].tolist()):
        x, y = find(at[x]), find(at[y])
        if x != y and not (rooted[x] and rooted[y]):
            parent[y] = x
            rooted[x] |= rooted[y]
    top = names[[find(i) for i in range(len(names))]]
    return pd.DataFrame({"node": names, "top": top})


def watershed(heights: DataFrame, seeds: DataFrame, tile: int = TILE, few: int = FEW) -> DataFrame:
    """``(col, row, label)``: the seed (its cell's id) of each cell that a seed reaches. Tiles are flooded one by one;
    their basins are joined over the passes between them: in one task while there are at most ``few`` passes, which
    are counted, else in rounds in which every basin without a seed takes its best pass."""
    own = raster._own(heights)
    cells = [*own, "col", "row"]
    base = heights.select(*cells, "h").join(seeds.select(*cells).distinct().withColumn("seed", F.lit(True)), cells, "left").withColumn("seed", F.coalesce("seed", F.lit(False))).withColumn("id", raster.named_id(heights)).withColumn("spot", raster.cell_id())
    base = graph.cut(base)
    tx, ty = F.floor(F.col("col") / tile), F.floor(F.col("row") / tile)
    away = F.array_distinct(F.array(*[F.struct(F.floor((F.col("col") + dx) / tile).alias("tx"), F.floor((F.col("row") + dy) / tile).alias("ty")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    dealt = base.withColumn("t", F.explode(away)).withColumn("own", (F.col("t.tx") == tx) & (F.col("t.ty") == ty))
    flooded = graph.cut(dealt.groupBy(*own, "t").applyInPandas(lambda f: _flood(f), "kind int, a long, b long, w long, lo long, hi long"))
    root = flooded.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("root"))
    # chains that go on in other tiles
    on = flooded.where("kind = 1").join(root, F.col("b") == F.col("id")).select(F.col("a"), F.col("root").alias("b"))
    chains = graph.components(on).select(F.col("node").alias("root"), "component")
    basin = graph.cut(root.join(chains, "root", "left").select("id", F.coalesce("component", "root").alias("basin")))
    seeded = graph.cut(base.where("seed").select("id").join(basin, "id").select(F.col("basin").alias("node"), F.col("id").alias("seed")))
    over = flooded.where("kind = 2").select("a", "b", "w", "lo", "hi").unionByName(flooded.where("kind = 3").join(root, F.col("b") == F.col("id")).select("a", F.col("root").alias("b"), "w", "lo", "hi"))
    named = lambda df, c: df.join(chains.select(F.col("root").alias(c), F.col("component").alias("_c")), c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    passes = graph.cut(_best_passes(named(named(over, "a"), "b")))
    moved = _merge(passes, seeded.select("node"), few)
    final = basin.join(moved, F.col("basin") == F.col("node"), "left").select("id", F.coalesce("top", "basin").alias("top"))
    labels = seeded.join(moved, "node", "left").select(F.coalesce("top", "node").alias("top"), F.col("seed").alias("label"))
    return base.select(*cells, "id").join(final, "id").join(labels, "top").select(*cells, "label")


def _best_passes(passes: DataFrame) -> DataFrame:
    """The best pass of each pair of parts, the smaller first."""
    key = F.struct((-F.col("w")).alias("w"), "lo", "hi")
    return passes.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(key).alias("k")).select("a", "b", (-F.col("k.w")).alias("w"), "k.lo", "k.hi")


def _merge(passes: DataFrame, rooted: DataFrame, few: int) -> DataFrame:
    """``(node, top)``: the part each basin ends up in; basins that stay alone may be missing."""
    spark = passes.sparkSession
    moved = None  # basins named so far
    while True:
        mark = rooted.withColumn("_r", F.lit(True))
        side = lambda df, c: df.join(mark.select(F.col("node").alias(c), F.col("_r").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", F.lit(False)))
        live = graph.cut(side(side(passes, "a"), "b").where("NOT (ra AND rb)"))  # two rooted parts never meet
        n = live.count()
        if n <= few:
            step = live.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda f: _joined(f), "node long, top long") if n else spark.createDataFrame([], "node long, top long")
        else:
            both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "lo", "hi", F.col("rb").alias("ra"), F.col("ra").alias("rb")))
            best = both.where("NOT ra").groupBy("a").agg(F.min_by("b", F.struct((-F.col("w")).alias("w"), "lo", "hi")).alias("b"))
            step = graph.components(best).select("node", F.col("component").alias("top"))
        step = graph.cut(step)
        moved = step if moved is None else graph.cut(moved.join(step.select(F.col("node").alias("top"), F.col("top").alias("_t")), "top", "left").select("node", F.coalesce("_t", "top").alias("top")).unionByName(step.join(moved.select("node"), "node", "left_anti")))
        if n <= few:
            return moved
        name = lambda df, c: df.join(step.select(F.col("node").alias(c), F.col("top").alias("_t")), c, "left").withColumn(c, F.coalesce("_t", c)).drop("_t")
        passes = graph.cut(_best_passes(name(name(passes, "a"), "b")))
        rooted = graph.cut(name(rooted, "node").distinct())
