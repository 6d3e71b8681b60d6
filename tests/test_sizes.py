"""Faults that show only on larger or denser tables, on small planted ones."""

import pytest
from pyspark.sql import functions as F

from strataplan.operators import filters, raster


@pytest.mark.parametrize("prefix, width, at", [("wall-", 5, 123456), ("-wall-", 6, 1234567)])
def test_numbers_longer_than_their_width_are_as_in_sql(spark, prefix, width, at):
    import duckdb

    got = spark.range(1).select(F.lit(at).alias("n")).select(filters.label(prefix, "n", width).alias("s")).first().s
    assert got == duckdb.sql(f"SELECT '{prefix}' || lpad(CAST({at} AS VARCHAR), {width}, '0')").fetchall()[0][0]


def test_slab_cells_on_the_far_edge(spark):
    p = spark.createDataFrame([(0, 0, 1), (95, 5, 1), (100, 50, 1)], "x_mm long, y_mm long, z_mm long")
    free, affine = raster.slice_to_raster(p, 0, 2, 10, clamp=False)
    assert raster.slice_metrics(free, affine).first().n_cells == 3  # an extent of 100 is ten cells; x = 100 is in the eleventh
    kept, _ = raster.slice_to_raster(p, 0, 2, 10)
    assert {(r.col, r.row) for r in kept.collect()} == {(0, 0), (9, 0), (9, 4)}


@pytest.mark.parametrize("dims", ["xy", "xyz"])
@pytest.mark.parametrize("block", [None, 20])
def test_nearest_on_crowded_places(spark, monkeypatch, dims, block):
    """Copies at one place, ties and crowded blocks, against brute force."""
    import numpy as np
    import pandas as pd

    from strataplan.operators import spatial

    monkeypatch.setattr(spatial, "BLOCK", block or spatial.BLOCK)
    rng = np.random.default_rng(3)
    a, b = (np.vstack([rng.integers(0, 8, (60, 3)), rng.integers(-900, 900, (60, 3))]) for _ in range(2))
    frame = lambda x: spark.createDataFrame(pd.DataFrame(dict(zip(("x_mm", "y_mm", "z_mm"), x.T))).assign(point_id=rng.permutation(len(x)) + 5))
    left, right = frame(a), frame(b)
    got = {r.a_id: (r.d2, r.b_id) for r in spatial.nearest(left, right, 320, dims=dims).collect()}
    rows = right.collect()
    d2 = lambda p, q: sum((p[f"{k}_mm"] - q[f"{k}_mm"]) ** 2 for k in dims)
    best = {p.point_id: min((d2(p, q), q.point_id) for q in rows) for p in left.collect()}
    assert got == {k: v for k, v in best.items() if v[0] <= 320 * 320}


def test_no_search_makes_a_table_of_pairs(spark):
    """Ten thousand points in a few square millimetres: each is told its nearest and its neighbourhood, and nothing is joined."""
    from strataplan.operators import planes, spatial

    p = spark.range(10000).selectExpr("id as point_id", "id % 9 as x_mm", "id % 7 as y_mm", "id % 5 as z_mm")
    near = spatial.nearest(p, p.withColumn("point_id", F.col("point_id") + 20000), 500)
    assert near.agg(F.count("*"), F.max("d2"), F.max("b_id")).first()[:] == (10000, 0, 20314)
    plan = planes.normals(p, 200, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_few_links_are_one_task(spark):
    """Few links take no rounds, whose stages the driver has to remember; many go by rounds, to the same result."""
    from strataplan.llm import common

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 13] + [(7, 7), (None, 3)], "a long, b long")
    made = common.stored()
    few = {tuple(r) for r in common.components(edges).select("node", "component").collect()}
    assert common.stored() - made <= 2
    assert few == {tuple(r) for r in common.components(edges, few=0).select("node", "component").collect()}


def test_merging_makes_its_pairs_once(spark, data, monkeypatch):
    from strataplan import plans
    from strataplan.operators import segments

    made, pairs = [], segments.collinear_pairs
    monkeypatch.setattr(segments, "collinear_pairs", lambda *a, **k: made.append(1) or pairs(*a, **k))
    plans.QUERIES["segments_merged"](spark, data)
    assert len(made) == 1


def test_candidates_are_made_once(spark):
    """Fixtures read their candidates, which may be dear, once."""
    from strataplan.operators import rooms

    read = spark.sparkContext.accumulator(0)

    def told(i):
        read.add(1)
        return i

    rows = spark.range(30).select(F.udf(told, "long")("id").alias("point_id"), F.lit(1).alias("wall_id"), (F.col("id") * 10).alias("x_mm"), F.col("id").alias("y_mm"), (F.col("id") * 9).alias("z_mm"), F.lit(50.0).alias("dist"))
    assert rooms.fixtures(rows, 400, 5).collect()[0].point_count == 30
    assert read.value == 30


def test_match_quality_reads_points_once(spark, monkeypatch):
    """Points at, within and beyond the tolerance of ends, many to a cell, against brute force; no search for the nearest."""
    import numpy as np

    from strataplan.operators import spatial
    from strataplan.plans import pipelines

    monkeypatch.setattr(spatial, "nearest", None)
    rng = np.random.default_rng(5)
    p = np.vstack([rng.integers(-200, 1200, (400, 2)), [[130, 100], [129, 100], [100, 71], [100, 70]] * 3])
    ends = np.vstack([[[100, 100], [100, 100]], rng.integers(-50, 1050, (12, 2))])
    frame = lambda a: spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(a)], "point_id long, x_mm long, y_mm long")
    edges = spark.createDataFrame([(r, *map(int, s)) for r, s in [(1, (0, 0, 1000, 0)), (1, (1000, 0, 1000, 1000)), (1, (1000, 1000, 0, 1000)), (1, (0, 1000, 0, 0)), (2, (1000, 0, 1010, 0)), (2, (1010, 0, 1010, 1000)), (2, (1010, 1000, 1000, 1000)), (2, (1000, 1000, 1000, 0))]], "room_id int, x0 long, y0 long, x1 long, y1 long")
    inside = p[(p[:, 0] >= 0) & (p[:, 0] < 1000) & (p[:, 1] >= 0) & (p[:, 1] < 1000)]
    hit = (((inside[:, None] - ends) ** 2).sum(2).min(1) < 900).mean()
    got = {r.room_id: (r.n, r.quality) for r in pipelines.match_quality(frame(p), edges, frame(ends), 30).collect()}
    assert got[1] == (len(inside), pytest.approx(hit)) and 0 < hit < 1
    assert got.get(2, (0, None))[1] is None


def test_the_nearest_beside_a_dense_wall():
    """Points 100 to 290 mm off a wall are compared with few of its points, however dense it is; answers equal brute force."""
    import time

    import numpy as np

    from strataplan.operators import neighbours

    rng = np.random.default_rng(2)
    wall = np.unique(np.stack([rng.integers(0, 1000, 400_000), rng.integers(-5, 6, 400_000), rng.integers(0, 1000, 400_000)], 1), axis=0)
    wall = wall[rng.permutation(len(wall))]
    off = np.stack([rng.integers(0, 1000, 1000), rng.integers(100, 290, 1000), rng.integers(0, 1000, 1000)], 1)
    begun = time.process_time()
    got = {i: (d, j) for rows, n, found, d2 in neighbours.search(off, wall, 1, 300) for i, j, d in zip(rows[n > 0].tolist(), found.tolist(), d2.tolist())}
    assert time.process_time() - begun < 3
    for i in range(0, 1000, 20):
        d2 = ((wall - off[i]) ** 2).sum(1)
        assert got.get(i) == ((d2.min(), d2.argmin()) if d2.min() <= 90000 else None)


@pytest.mark.parametrize("block", [None, 300])
@pytest.mark.parametrize("repeated", [False, True])
def test_neighbourhoods_of_crowded_points(spark, monkeypatch, block, repeated):
    """A table that is both sides moves once; crowded points are searched with a short reach first, and points at one place
    once. Neighbours equal brute force, lone points, copies and ids that two points have included."""
    import numpy as np
    import pandas as pd

    from strataplan.operators import spatial

    monkeypatch.setattr(spatial, "BLOCK", block or spatial.BLOCK)
    rng = np.random.default_rng(4)
    xyz = np.vstack([rng.integers(0, 12, (400, 3)), rng.integers(-700, 700, (60, 3))])
    ids = rng.permutation(len(xyz)) // (2 if repeated else 1)
    p = spark.createDataFrame(pd.DataFrame(dict(zip(("x_mm", "y_mm", "z_mm"), xyz.T))).assign(point_id=ids))
    found = spatial.neighbourhoods(p, p, 6, 160, lambda near, n, d2: (np.bincount(np.repeat(np.arange(len(n)), n), near @ [1, 1000, 10**6] + 0.0, len(n)), np.bincount(np.repeat(np.arange(len(n)), n), d2, len(n))), "s double, d double")
    if not block:
        assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for at, own in zip(xyz, ids):
        d2 = ((xyz - at) ** 2).sum(1)
        near = [j for j in np.lexsort((ids, d2)) if ids[j] != own and d2[j] <= 160 * 160][:6]
        want.append((int(own), len(near), float(d2[near].sum())) + (() if repeated else (float((xyz[near] @ [1, 1000, 10**6]).sum()),)))
    assert sorted((r.id, r.n, r.d) + (() if repeated else (r.s,)) for r in found.collect()) == sorted(want)
