"""Folders of PLY and DXF parts: written by tasks, committed by the driver, read back equal; a failure leaves nothing."""

import pytest
from pyspark.sql import functions as F

from strataplan.sources import scan_files, writers


@pytest.fixture(scope="module")
def ready(spark):
    scan_files.register(spark)
    writers.register(spark)
    return spark


def left(folder):
    return sorted(p.name for p in folder.rglob("*") if not p.name.endswith(".crc")) if folder.exists() else []


def test_ply_parts(ready, tmp_path):
    at = tmp_path / "cloud"
    pts = ready.range(1000, numPartitions=3).selectExpr("id / 8.0D as x", "id % 7 / 4.0D as y", "cast(null as double) as z", "id / 1000.0D as r", "1.0D as g", "-1.0D as b").withColumn("z", F.when(F.col("x") != 5.0, 2.5))
    pts.write.format("ply").option("rowsPerFile", 150).mode("overwrite").save(str(at))
    names = left(at)
    assert "_SUCCESS" in names and not any("staging" in n for n in names)
    assert sum(n.endswith(".ply") for n in names) == 9  # three tasks of 333 rows or so, 150 a file
    got = ready.read.format("scan").load(str(at)).select("x", "y", "z", "r", "g", "b").collect()
    want = [(i / 8, i % 7 / 4, 2.5, int(i / 1000 * 255), 255, 0) for i in range(1000) if i != 40]
    assert sorted(map(tuple, got)) == sorted(want)
    pts.limit(10).write.format("ply").mode("append").save(str(at))
    assert ready.read.format("scan").load(str(at)).count() == 1009
    pts.limit(10).write.format("ply").mode("overwrite").save(f"file://{at}")
    assert ready.read.format("scan").load(str(at)).count() == 10
    pts.limit(0).write.format("ply").mode("overwrite").save(str(at))
    assert left(at) == ["_SUCCESS"]


def test_dxf_parts(ready, tmp_path):
    at = tmp_path / "plan"
    s = ready.createDataFrame([("walls", 0.0, 0.0, 20.0, 0.0), ("text", 20.0, 0.0, 20.0, 15.5), ("ghost", 1.0, 1.0, 2.0, 2.0), (None, 1.0, 1.0, 2.0, 2.0), ("walls", None, 1.0, 2.0, 2.0)], "class string, x1 double, y1 double, x2 double, y2 double").repartition(3)
    s.write.format("dxf_parts").mode("overwrite").save(str(at))
    v = ready.read.format("dxf").load(str(at))
    assert sorted((r.layer, r.x1, r.y1, r.x2, r.y2) for r in scan_files.plan_edges(v).collect()) == [("TEXT", 20.0, 0.0, 20.0, 15.5), ("WALLS", 0.0, 0.0, 20.0, 0.0)]
    assert [r.text for r in v.where("text IS NOT NULL").collect()] == ["dropped classes: None, ghost"]


def test_a_failure_leaves_nothing(ready, tmp_path):
    at = tmp_path / "cloud"
    good = ready.range(300, numPartitions=3).selectExpr("double(id) as x", "0.0D as y", "0.0D as z")
    bad = good.withColumn("z", F.when(F.col("x") == 299, F.raise_error(F.lit("torn"))).otherwise(F.col("z")))
    with pytest.raises(Exception, match="torn"):
        bad.write.format("ply").option("rowsPerFile", 10).mode("append").save(str(at))
    assert not [n for n in left(at) if n.endswith(".ply") or "staging" in n or n == "_SUCCESS"]
    good.write.format("ply").mode("append").save(str(at))
    before = left(at)
    with pytest.raises(Exception, match="torn"):  # what an overwrite would replace stays until it commits
        bad.write.format("ply").option("rowsPerFile", 10).mode("overwrite").save(str(at))
    assert left(at) == before and ready.read.format("scan").load(str(at)).count() == 300
    with pytest.raises(Exception, match="needs the columns"):
        good.drop("z").write.format("ply").mode("append").save(str(at))


def test_drawing_parts_are_written_and_read_entity_by_entity(ready, tmp_path):
    """Neither side holds a part's text: what Python holds does not grow with the part."""
    import tracemalloc

    import pyarrow as pa

    n = 40_000
    ends = {c: [i / 8 + k for i in range(n)] for k, c in enumerate(("x1", "y1", "x2", "y2"))}
    rows = pa.table({"class": ["walls", "mep", "ghost", None] * (n // 4), **ends})
    part = writers.DxfParts({"path": str(tmp_path)}, ready.createDataFrame([], "class string, x1 double, y1 double, x2 double, y2 double").schema, False)
    tracemalloc.start()
    try:
        pieces, kept, dropped = part.body(rows)
        with open(tmp_path / "a.dxf", "wb") as f:
            for p in pieces:
                f.write(p)
        told = sum(1 for _ in scan_files.dxf_rows(str(tmp_path / "a.dxf")))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (kept, dropped, told) == (n // 2, {"ghost", "None"}, n)
    assert peak < 20_000_000
    last = list(scan_files.dxf_rows(str(tmp_path / "a.dxf")))[-2:]
    assert [r[1:8] for r in last] == [(n // 2 - 1, "LWPOLYLINE", last[0][3], False, k, ends[x][-3], ends[y][-3]) for k, (x, y) in enumerate((("x1", "y1"), ("x2", "y2")))]
