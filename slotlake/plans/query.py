"""Ad-hoc SQL with result metadata, against one copy of the data or all of them.

A copy is a database that holds the same table names (a slot, a restored snapshot,
another environment). The statement itself goes to Spark untouched.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from slotlake.operators.fleet import broadcast_outcome
from slotlake.session import delete_path, scratch_path


class QueryError(ValueError):
    """The request cannot be run."""


@dataclass
class QueryResult:
    """A result that stays distributed; `count()` and `page()` are the actions. That of
    a copy owns the rows that it wrote to the scratch folder: `close()` deletes them."""

    df: DataFrame | None
    source_index: int | None = None
    status: str = "success"
    error: str = ""
    columns: list[dict[str, str]] = field(default_factory=list)
    row_count: int | None = None
    elapsed_ms: int | None = None
    started: float | None = None
    path: str | None = None

    def close(self) -> None:
        if self.path:
            delete_path(self.df.sparkSession, self.path)
            self.path = None

    def count(self) -> "QueryResult":
        start = time.monotonic()
        self.row_count = self.df.count()
        self.elapsed_ms = int((time.monotonic() - start) * 1000)
        return self

    def page(self, size: int) -> list[dict]:
        """First rows as maps, for display."""
        return [row.asDict(recursive=True) for row in self.df.limit(size).collect()]


def query(spark: SparkSession, sql: str) -> QueryResult:
    """Run one statement; columns with names and types come with the result."""
    if not sql.strip():
        raise QueryError("there is no statement to run")
    df = spark.sql(sql)
    return QueryResult(
        df=df, columns=[{"name": n, "type": t} for n, t in df.dtypes]
    )


def _on(spark: SparkSession, sql: str, databases: list[str], i: int, tag: str | None = None) -> QueryResult:
    """Run the statement on a copy, once and to its end: rows go to the shared scratch
    folder, and status, row count and time are those of this run. Each run has a
    session of its own, so the caller's current database stays as it is."""
    if not sql.strip():
        raise QueryError("there is no statement to run")
    start, began, context, path = time.monotonic(), time.time(), spark.sparkContext, None
    tags = [tag, f"{tag}-{i}"] if tag else []
    try:
        for name in tags:
            context.addJobTag(name)
        own = spark.newSession()
        own.catalog.setCurrentDatabase(databases[i])
        df = own.sql(sql)
        rows, seen = df, Observation(f"copy-{uuid.uuid4().hex}")
        if df.columns:
            # Names may repeat in a result, but not in a file.
            plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
            void = [n for n, t in plain.dtypes if t == "void"]
            plain = plain.withColumns({n: F.col(n).cast("string") for n in void})
            path = scratch_path(spark, f"copy-{i}")
            plain.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
            rows = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
        count = seen.get["rows"] if df.columns else 0
    except Exception as exc:
        if path:
            delete_path(spark, path)
        status = "cancelled" if "cancelled" in str(exc) and tags else "error"
        return QueryResult(None, i, status, str(exc).split("\n")[0], elapsed_ms=_since(start), started=began)
    finally:
        for name in tags:
            context.removeJobTag(name)
    columns = [{"name": n, "type": t} for n, t in df.dtypes]
    return QueryResult(
        rows, i, columns=columns, row_count=count, elapsed_ms=_since(start), started=began, path=path
    )


def cancel(spark: SparkSession, tag: str, copy: int | None = None) -> None:
    """Stop a broadcast that runs under that tag, on all copies or on one. What has
    answered by then stays an answer."""
    spark.sparkContext.cancelJobsWithTag(tag if copy is None else f"{tag}-{copy}")


def _since(start: float) -> int:
    return int((time.monotonic() - start) * 1000)


def query_target(spark: SparkSession, sql: str, databases: list[str], target: int) -> QueryResult:
    """Run on one copy by its index."""
    if not 0 <= target < len(databases):
        raise QueryError(f"there is no copy {target} among {len(databases)}")
    return _on(spark, sql, databases, target)


def query_any(spark: SparkSession, sql: str, databases: list[str]) -> QueryResult:
    """Run on one copy after another, up to the first that answers in full."""
    for i in range(len(databases)):
        result = _on(spark, sql, databases, i)
        if result.status == "success":
            return result
    raise QueryError("no copy answered the query")


@dataclass
class BroadcastResult:
    results: list[QueryResult]
    status: str
    df: DataFrame | None

    def __enter__(self) -> "BroadcastResult":
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        """Delete the rows of all copies."""
        for result in self.results:
            result.close()

    def summary(self, spark: SparkSession) -> DataFrame:
        """source_index, status, error, row_count of each copy."""
        rows = [(r.source_index, r.status, r.error, r.row_count) for r in self.results]
        return spark.createDataFrame(
            rows, "source_index int, status string, error string, row_count bigint"
        )


def query_all(
    spark: SparkSession, sql: str, databases: list[str], tag: str | None = None, at_once: int = 16
) -> BroadcastResult:
    """Run on every copy, `at_once` of them at a time; the answers are one union, tagged
    with `source_index`. A copy that fails, before or while it runs, or is stopped by
    `cancel` under the tag, takes nothing from the others. The outcome is that of
    `broadcast_outcome`: copies that are not in use do not count."""
    if not sql.strip():
        raise QueryError("there is no statement to run")
    tag = tag or f"broadcast-{uuid.uuid4().hex}"
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        results = list(pool.map(lambda i: _on(spark, sql, databases, i, tag), range(len(databases))))
    out = BroadcastResult(results, "ok", None)
    good = [r for r in results if r.status == "success"]
    if results:
        tagged = out.summary(spark).withColumn("_all", F.lit(1))
        out.status = broadcast_outcome(tagged, "_all").head().status
    if good:
        answers = [r.df.withColumn("source_index", F.lit(r.source_index)) for r in good]
        # By name, unless a result has a name twice.
        plain = all(len(set(a.columns)) == len(a.columns) for a in answers)
        unite = DataFrame.unionByName if plain else DataFrame.union
        out.df = reduce(unite, answers)
    return out
