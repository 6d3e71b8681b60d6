"""Shared plumbing of the training-data operators: table access, durable intermediate
tables and connected components.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (shared by driver and
executors) as Parquet, which cuts the lineage like ``checkpoint()`` does, survives a lost
executor, and is columnar and compressed. Only in local mode may the setting be absent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import FEW, all_at_once, shared_dir


#: paths of the tables made by store, in order (not the tables: they would keep their plans alive)
_stored: list[str] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back (lineage cut)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataplan-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # Spark deletes the shuffle files of a finished write when the driver's JVM collects its plan, which
    # a driver with a large heap may not do for hours. The listener bus holds the last plan that ended
    # until another one has; a plan of one row lets go of it.
    spark.range(0, 1, 1, 1).collect()
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    _stored.append(path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`store` that no later plan reads."""
    if path := getattr(df, "_stored_path", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    _stored[:] = [p for p in _stored if p != path]
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stored() -> int:
    """The number of tables that :func:`store` has made and nobody has deleted."""
    return len(_stored)


def sweep(since: int, keep: DataFrame) -> int:
    """Delete the tables that :func:`store` made after the first ``since`` ones, but for ``keep``: a
    step whose result is stored needs them no more. The number of tables that are left."""
    for path in _stored[since:]:
        if path != getattr(keep, "_stored_path", None):
            _delete(keep.sparkSession, path)
    return len(_stored)


def shield(docs: DataFrame, needed: list[str]):
    """Put the columns that an operator does not read into one struct, whose names cannot clash
    with the operator's own. Returns the table and a function that gives the columns back."""
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    rest = [quoted[c] for c in docs.columns if c not in needed]
    body = docs.select(*[quoted[c] for c in docs.columns if c in needed], (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("_rest"))

    def restore(df: DataFrame, extra: list[str] = ()) -> DataFrame:
        return df.select(*[quoted[c] if c in needed else F.col("_rest").getField(c).alias(c) for c in docs.columns], *extra)

    return body, restore


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, to be joined by sort and merge. Spark sizes what an explode or
    a Python function makes of a table like the table, and a stored table by its compressed files, so it would send
    through the driver what it takes for a few MB."""
    return df.hint("merge")


def evaluated(df: DataFrame, **columns) -> DataFrame:
    """``df`` with the given columns, each computed once a row. Later expressions that mention them
    often, or inside a lambda, would otherwise be merged with their making and repeat it."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def lean(run):
    """An Arrow function that gives its memory back when its partition is done: Python workers are
    reused, and what an idle one holds is lost to the executor."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` by alternating large-star and
    small-star steps. At most ``few`` distinct edges, which are counted, are one task's work: rounds of
    joins over so few cost the driver more memory for their stages and tasks than the edges hold.

    Returns ``(node, component)`` for every node that has an edge to another node; component is
    the smallest id reachable. Null ends and self loops are ignored; an empty input gives an
    empty result. Each round is two aggregations with map-side combining and two joins whose
    large keys AQE may split; a round's edges never exceed the distinct edges before it.
    Rounds stop when the edge set no longer changes (each node then points at its root).
    """
    cur = store(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = _edge_mark(cur)
    if mark[0] == 0:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if mark[0] <= few:
        return store(all_at_once(cur))
    for _ in range(max_rounds):
        nxt = store(_small_star(_large_star(cur)))
        new_mark = _edge_mark(nxt)
        discard(cur)
        cur = nxt
        if new_mark == mark:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = new_mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _edge_mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.count_distinct("u").alias("d"),
    ).first()
    return (row["n"], row["x"], row["d"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node's neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(by_key(low), "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        .unionByName(low.where("m < u").select("u", F.col("m").alias("v")))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(by_key(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(low.select("u", F.col("m").alias("v")))
        .distinct()
    )
