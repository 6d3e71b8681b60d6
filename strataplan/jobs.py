"""Job tables: an append-only Parquet log of job updates with latest-row views."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "job_id string, kind string, status string, created_at string, updated_at string, params_json string, result_json string"
#: what may follow each status (fixed values); a job may be processed again from any that it ended in
STATUSES = {
    "align": {"queued": {"processing", "failed"}, "processing": {"aligned", "failed"}, "aligned": {"approved", "processing", "failed"}, "failed": {"processing", "queued"}, "approved": {"processing"}},
    "vectorize": {"queued": {"processing", "failed"}, "processing": {"complete", "failed"}, "complete": {"processing"}, "failed": {"processing", "queued"}},
}
#: jobs that are processed at a time
AT_A_TIME = 2


@dataclass(frozen=True)
class VectorizeParams:
    """Checked parameters of a vectorisation (metres)."""

    elevation: float | None = None
    slab: float = 0.10
    resolution: float = 0.01
    least_length: float = 0.50
    detector: str = "hough"

    def __post_init__(self):
        for name, value, low, high in (("slab", self.slab, 0.02, 2.0), ("resolution", self.resolution, 0.002, 0.10), ("least_length", self.least_length, 0.05, 10.0)):
            if not low <= value <= high:
                raise ValueError(f"{name} must be in {low}..{high}")
        if self.detector not in ("hough", "fld", "both"):
            raise ValueError(f"unknown detector {self.detector}")


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="microseconds")


def admitted(jobs: DataFrame, places: int = AT_A_TIME) -> DataFrame:
    """Of ``jobs(job_id, status, created_at, ..)`` the queued ones that may start: the oldest, at most
    ``places`` less those being processed."""
    busy = jobs.agg(F.count_if(F.col("status") == "processing").alias("_busy"))
    first = jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(places)
    line = first.withColumn("_place", F.row_number().over(Window.orderBy("created_at", "job_id")))  # of ``places`` rows
    return line.crossJoin(F.broadcast(busy)).where(F.col("_place") + F.col("_busy") <= places).drop("_place", "_busy")


class JobTable:
    """Updates are appended; the state of a job is its latest non-null values."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def create(self, job_id: str, kind: str, params_json: str = "{}") -> None:
        t = now()
        self._append(job_id, kind, "queued", t, t, params_json, None)

    def update(self, job_id: str, status: str | None = None, result_json: str | None = None, params_json: str | None = None) -> None:
        """Raises for an unknown job, a status its kind does not have, and one that may not follow
        the job's own. The same status again is allowed (its result or parameters may change)."""
        job = self.get(job_id)
        kind = job["kind"]
        if status is not None and status not in STATUSES[kind]:
            raise ValueError(f"{status} is no status of {kind} jobs")
        if status is not None and status != job["status"] and status not in STATUSES[kind][job["status"]]:
            raise ValueError(f"{status} may not follow {job['status']}")
        self._append(job_id, kind, status, None, now(), params_json, result_json)

    def log(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def latest(self) -> DataFrame:
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(c)
        return self.log().groupBy("job_id").agg(F.max("kind").alias("kind"), last("status"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), last("params_json"), last("result_json"))

    def get(self, job_id: str) -> dict:
        rows = self.latest().where(F.col("job_id") == job_id).take(1)
        if not rows:
            raise KeyError(job_id)
        return rows[0].asDict()

    def result(self, job_id: str) -> dict | None:
        """The job's result, or None while there is none."""
        import json

        text = self.get(job_id)["result_json"]
        return None if text is None else json.loads(text)

    def recent(self, n: int = 50, kind: str | None = None) -> DataFrame:
        """The newest jobs, of one kind or of all."""
        jobs = self.latest() if kind is None else self.latest().where(F.col("kind") == kind)
        return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)

    def expired(self, cutoff: str) -> DataFrame:
        return self.latest().where(F.col("created_at") < cutoff)

    def admitted(self) -> DataFrame:
        """Queued jobs that may start: first come, first served, as many as there are places left."""
        return admitted(self.latest())

    def recover(self) -> int:
        """After a restart: jobs that were being processed go back to the queue by way of ``failed``.
        The number of them."""
        lost = [r.job_id for r in self.latest().where("status = 'processing'").select("job_id").orderBy("job_id").collect()]  # AT_A_TIME at most
        for job_id in lost:
            self.update(job_id, "failed")
            self.update(job_id, "queued")
        return len(lost)

    def delete_expired(self, cutoff: str) -> int:
        """Take jobs created before ``cutoff`` out of the log; the number of them. The log is rewritten
        beside itself and then put in its place, so a reader sees either."""
        gone = self.expired(cutoff).select("job_id")
        n = gone.count()
        if n:
            fresh, old = f"{self.path}.fresh", f"{self.path}.old"
            self.log().join(gone, "job_id", "left_anti").select(*self.log().columns).write.mode("overwrite").parquet(fresh)
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            at = [jvm.org.apache.hadoop.fs.Path(p) for p in (self.path, old, fresh)]
            fs = at[0].getFileSystem(conf)
            fs.rename(at[0], at[1])
            fs.rename(at[2], at[0])
            fs.delete(at[1], True)
        return n

    def result_counts(self) -> DataFrame:
        r = F.from_json("result_json", "struct<rooms:array<string>,fixtures:array<string>>")
        size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
        return self.latest().select("job_id", "status", size(r["rooms"]).alias("rooms"), size(r["fixtures"]).alias("fixtures"))
