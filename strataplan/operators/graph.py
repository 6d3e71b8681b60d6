"""Tables that cut lineage, and connected components of an edge table by alternating large-star
and small-star steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only in local mode, where driver and executors are
    one process, may it be unset; a temporary folder is used then."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="strataplan-"))
    return f"file://{_local_dir[0]}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, and survives the
    loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that no later plan reads."""
    if path := getattr(df, "_cut_path", None):
        jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


#: rows that one task takes at once where they are counted first; more go on in rounds of joins
FEW = 200_000


def is_few(df: DataFrame, few: int = FEW) -> bool:
    return df.limit(few + 1).count() <= few


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each position reaches over the links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _at_once(f: pd.DataFrame) -> pd.DataFrame:
    names, at = np.unique(f[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    out = pd.DataFrame({"node": names, "component": names[smallest(len(names), at[:, 0], at[:, 1])]})
    return out[out["node"] != out["component"]]


def all_at_once(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of ``edges(u, v)`` in one task, for edges that were counted to be few."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if held:
            yield _at_once(pd.concat(held))

    return edges.coalesce(1).mapInPandas(run, "node long, component long")


def components(edges: DataFrame, max_rounds: int = 50, few: int = FEW) -> DataFrame:
    """``(node, component)`` for nodes that reach a smaller one; component is the smallest id. At most ``few`` edges,
    which are counted, are one task's work; more are joined in rounds."""
    cur = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if is_few(cur, few):
        return cut(all_at_once(cur))
    mark = None
    for _ in range(max_rounds):
        row = cur.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if tuple(row) == mark or row["n"] == 0:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = tuple(row)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, cur = cur, cut(small.distinct())
        drop(last)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
