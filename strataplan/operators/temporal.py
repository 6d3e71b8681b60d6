"""Joins on time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, carry: list[str]) -> DataFrame:
    """The left rows with ``right_<c>`` for each of ``carry`` and for ``ts``: those of the last right row
    of the same key that is not later (of equal times the greatest by ``carry``); null where there is
    none. Both sides are sorted once, in one shuffle by key; a left row is never multiplied."""
    own = [c for c in left.columns if c not in (key, ts)]
    found = F.struct(F.col(ts), *carry)
    line = left.select(key, ts, F.lit(1).alias("_side"), F.struct(*(own or [F.lit(0).alias("_none")])).alias("_own"), F.lit(None).cast(right.select(found.alias("f")).schema["f"].dataType).alias("_f"))
    line = line.unionByName(right.select(key, ts, F.lit(0).alias("_side"), F.lit(None).cast(line.schema["_own"].dataType).alias("_own"), found.alias("_f")))
    w = Window.partitionBy(key).orderBy(ts, "_side", "_f").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = line.withColumn("_last", F.last("_f", ignorenulls=True).over(w)).where("_side = 1")
    return met.select(key, ts, *[F.col(f"_own.{c}").alias(c) for c in own], *[F.col(f"_last.{c}").alias(f"right_{c}") for c in (ts, *carry)])


def within(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Pairs of rows of one key with right times from 0 to ``seconds`` after the left ones. An equi-join on
    key and time slot: a left row meets its own slot and the next one, so a busy key is dealt by time."""
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(seconds * 1_000_000))
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns]).withColumn("_slot", F.explode(F.array(slot(f"a_{ts}"), slot(f"a_{ts}") + 1)))
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns]).withColumn("_slot2", slot(f"b_{ts}"))
    near = F.col(f"b_{ts}").between(F.col(f"a_{ts}"), F.col(f"a_{ts}") + F.make_dt_interval(secs=F.lit(seconds)))
    return a.join(b, (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col("_slot") == F.col("_slot2")) & near).drop("_slot", "_slot2")
