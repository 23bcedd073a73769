"""Job records: lifecycle, latest per source, resume point, purge."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotlake.session import materialize, path_exists
from slotlake.sources.datasets import JOB_SCHEMA, RESTART_MESSAGE, mark_interrupted

# Job states, and how long ended jobs are kept.
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = (
    "pending", "running", "completed", "failed", "cancelled",
)
TERMINAL = (COMPLETED, FAILED, CANCELLED)
KEEP_SECONDS = 24 * 3600

# Moves a job may make.
NEXT = {
    PENDING: {RUNNING, FAILED, CANCELLED},
    RUNNING: {RUNNING, COMPLETED, FAILED, CANCELLED},
}


# A log record is a job record plus the order in which it was written.
LOG_SCHEMA = T.StructType([*JOB_SCHEMA.fields, T.StructField("version", T.LongType())])


class JobStateError(RuntimeError):
    """The job cannot make this move from the state it is in."""


def latest_job(jobs: DataFrame, keys: tuple[str, ...] = ("table", "csvPath")) -> DataFrame:
    """Newest job per table and path (highest id on ties).

    The newest start is found first, in a hash aggregate; whole rows are compared
    only among the jobs that share it.
    """
    started = jobs.where("startedAt > 0")
    newest = started.groupBy(*keys).agg(F.max("startedAt").alias("startedAt"))
    tied = started.join(newest, [*keys, "startedAt"], "left_semi")
    row = F.struct(*[c for c in jobs.columns if c not in keys])
    return tied.groupBy(*keys).agg(F.max_by(row, "id").alias("_j")).select(*keys, "_j.*")


def resume_points(jobs: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Line to resume from per table and path: the newest earlier job's last line.

    `current` (`id`) names jobs that are just starting; they do not count.
    """
    if current is not None:
        jobs = jobs.join(current.select("id"), "id", "left_anti")
    last = latest_job(jobs)
    return last.select(
        "table", "csvPath", F.col("id").alias("job_id"),
        F.col("lastLineNum").alias("start_line"),
    )


def expired_jobs(jobs: DataFrame, now: int) -> DataFrame:
    """Ended more than a day ago."""
    return jobs.where(
        F.col("status").isin(*TERMINAL) & (F.col("endedAt") < now - KEEP_SECONDS)
    )


def kept_jobs(jobs: DataFrame, now: int) -> DataFrame:
    gone = F.col("status").isin(*TERMINAL) & (F.col("endedAt") < now - KEEP_SECONDS)
    return jobs.where(~F.coalesce(gone, F.lit(False)))


def interrupted_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.col("status") == FAILED) & (F.col("error") == RESTART_MESSAGE))


class JobLog:
    """Append-only job table: every change is one record, the newest one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._queries: dict[str, object] = {}

    def _append(self, record: dict) -> None:
        row = tuple(record.get(f.name) for f in JOB_SCHEMA) + (time.time_ns(),)
        entry = self.spark.createDataFrame([row], LOG_SCHEMA)
        entry.coalesce(1).write.mode("append").json(self.path)

    def all(self) -> DataFrame:
        """Current state of every job."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], JOB_SCHEMA)
        log = (
            self.spark.read.schema(LOG_SCHEMA).option("mode", "DROPMALFORMED").json(self.path)
        )
        row = F.struct(*[c for c in log.columns if c not in ("id", "version")])
        return (
            log.groupBy("id").agg(F.max_by(row, "version").alias("_j")).select("id", "_j.*")
        )

    def get(self, job_id: str) -> dict | None:
        hit = self.all().where(F.col("id") == job_id).head()
        return hit.asDict() if hit else None

    def create(self, table: str, path: str, **fields) -> str:
        job_id = str(uuid.uuid4())
        self._append(
            {
                "id": job_id, "table": table, "csvPath": path, "status": PENDING,
                "startedAt": int(time.time()), "method": "bulk", "workers": 4,
                "batchSize": 10_000, "lastLineNum": 0, "processedLines": 0,
                "failedLines": 0, **fields,
            }
        )
        return job_id

    def update(self, job_id: str, status: str, error: str | None = None, **fields) -> None:
        job = self.get(job_id)
        if job is None:
            raise KeyError(f"no record of job {job_id}")
        if status not in NEXT.get(job["status"], set()):
            raise JobStateError(f"a job cannot go from {job['status']} to {status}")
        job.update(fields, status=status)
        if error:
            job["error"] = error
        if status in TERMINAL:
            job["endedAt"] = int(time.time())
        self._append(job)

    def attach(self, job_id: str, query) -> None:
        """Tie a running streaming query to a job, so that cancel can stop it."""
        self._queries[job_id] = query

    def cancel(self, job_id: str) -> None:
        """Only pending or running jobs can be cancelled."""
        job = self.get(job_id)
        if job is None:
            raise KeyError(f"no record of job {job_id}")
        if job["status"] not in (PENDING, RUNNING):
            raise JobStateError(f"a job that is over cannot be cancelled: {job['status']}")
        query = self._queries.pop(job_id, None)
        if query is not None:
            query.stop()
        self.update(job_id, CANCELLED)

    def recover(self) -> int:
        """After a restart: jobs still open count as failed and can be resumed."""
        open_jobs = self.all().where(F.col("status").isin(PENDING, RUNNING))
        failed = mark_interrupted(open_jobs, int(time.time())).withColumn(
            "version", F.lit(time.time_ns())
        )
        seen = Observation("recovered")
        failed = materialize(failed.observe(seen, F.count("*").alias("n")), "recovered")
        failed.write.mode("append").json(self.path)
        return seen.get["n"]
