"""Progress and job-status streams over event tables ``(ts, user_id, event_type, value, ..)``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.filters import with_scalar
from ..operators.graph import shared_dir


def read_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The event table as a file stream; ``ts`` becomes a zoned timestamp for watermarks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def progress_events(events: DataFrame) -> DataFrame:
    """``job_id, stage, message, progress, ts`` of an event stream."""
    return events.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.format_string("%s at %.2f", "event_type", "value").alias("message"), F.col("value").alias("progress"), "ts")


def latest_progress(progress: DataFrame) -> DataFrame:
    """Latest stage and event count of each job (complete or update mode)."""
    last = progress.groupBy("job_id").agg(F.max(F.struct("ts", "progress", "stage")).alias("m"), F.count("*").alias("events"))
    return last.select("job_id", F.col("m.stage").alias("stage"), F.col("m.ts").alias("ts"), "events")


def tumbling_counts(progress: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by stage and window; rows later than the watermark are left out."""
    return progress.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "stage").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "stage", "n")


def sessions(progress: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return progress.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "job_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "job_id", "n")


STATUS = ["queued", "processing", "aligned", "failed", "approved"]  # fixed values, in order of life
_TERMINAL = {"complete", "error"}


def job_feed(progress: DataFrame, silence_ms: int | None = 30_000) -> DataFrame:
    """Per job: every event numbered, a keep-alive after ``silence_ms`` without one, and nothing
    more once a terminal stage was seen (the state is then dropped; late events start anew). With
    ``silence_ms`` None there are no keep-alives, and a bounded stream can end."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.setTimeoutDuration(silence_ms)
            yield pd.DataFrame({"job_id": [key[0]], "n": [n], "stage": ["keep-alive"], "done": [False]})
            return
        done = False
        for f in frames:
            f = f.sort_values(["ts", "stage"], kind="stable")
            for stage in f["stage"]:
                if done:
                    break
                n += 1
                done = stage in _TERMINAL
                yield pd.DataFrame({"job_id": [key[0]], "n": [n], "stage": [stage], "done": [done]})
        if done:
            state.remove()
        else:
            state.update((n,))
            if silence_ms is not None:
                state.setTimeoutDuration(silence_ms)

    return progress.groupBy("job_id").applyInPandasWithState(step, "job_id long, n long, stage string, done boolean", "n long", "append", GroupStateTimeout.NoTimeout if silence_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def status_stream(progress: DataFrame) -> DataFrame:
    """Last status of each job by stage order and time."""
    status = F.when(F.col("stage") == "error", "failed").when(F.col("stage") == "purchase", "approved").when(F.col("stage") == "signup", "queued").otherwise("processing")
    return progress.withColumn("status", status).groupBy("job_id").agg(F.max(F.struct("ts", "status")).alias("m")).select("job_id", F.col("m.status").alias("status"), F.col("m.ts").alias("ts"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a bounded stream to its end into Parquet in the shared folder, with a checkpoint beside it,
    and return the table. Started again on the same folder, the query goes on where it stopped."""
    root = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    return resumed(stream, root, mode)


def resumed(stream: DataFrame, root: str, mode: str) -> DataFrame:
    """Process what the stream's source holds and ``root/checkpoint`` has not seen. In append mode
    rows are added to ``root/rows``; in complete mode each batch writes the whole result to a folder
    of its own, and the last one counts."""
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    if mode == "append":
        writer.format("parquet").option("path", f"{root}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/rows")

    def whole(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/whole/batch={number}")

    writer.foreachBatch(whole).start().awaitTermination()
    every = spark.read.option("basePath", f"{root}/whole").parquet(f"{root}/whole")
    last = every.agg(F.max("batch").alias("_last"))
    return with_scalar(every, last).where(F.col("batch") == F.col("_last")).select(*stream.columns)
