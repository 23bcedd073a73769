"""Prebuilt datasets, snapshots on storage, state files, metrics, commands, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotlake.functions.cells import INT_RE, trim_cell
from slotlake.session import path_exists

COMMAND_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("lifecycleStage", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField(
            "spec",
            T.StructType(
                [
                    T.StructField("location", T.StringType()),
                    T.StructField(
                        "containerOverrides",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("name", T.StringType()),
                                    T.StructField(
                                        "env",
                                        T.ArrayType(
                                            T.StructType(
                                                [
                                                    T.StructField("name", T.StringType()),
                                                    T.StructField("value", T.StringType()),
                                                ]
                                            )
                                        ),
                                    ),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
    ]
)

# Field names of a job record.
JOB_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("csvPath", T.StringType()),
        T.StructField("cluster", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("memLimit", T.StringType()),
        T.StructField("prebuiltIndexPath", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("startedAt", T.LongType()),
        T.StructField("endedAt", T.LongType()),
        T.StructField("workers", T.IntegerType()),
        T.StructField("batchSize", T.IntegerType()),
        T.StructField("lastLineNum", T.LongType()),
        T.StructField("processedLines", T.LongType()),
        T.StructField("failedLines", T.LongType()),
    ]
)


class MissingDatasetError(FileNotFoundError):
    """A prebuilt dataset without its completion marker."""


def load_prebuilt(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A published dataset; refuses one whose write never finished."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        raise MissingDatasetError(f"no completed dataset at {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def int_or(cell, default):
    """Integer text as bigint, anything else as the default."""
    return F.coalesce(F.when(cell.rlike(INT_RE), cell.try_cast("bigint")), default)


def parse_kv_lines(lines: DataFrame, by: str = "file", order: str | None = None) -> DataFrame:
    """`key: value` lines (`by`, `value`) to one row per file.

    Comments and lines without a colon are ignored, a bad number counts as absent,
    and of repeated keys the last good one holds (`order` is the line order).
    """
    text = trim_cell(F.col("value"))
    split = F.split(text, ":", 2)
    usable = (text != "") & ~text.startswith("#") & text.contains(":")
    pairs = lines.select(
        by,
        (F.col(order) if order else F.monotonically_increasing_id()).alias("_o"),
        F.when(usable, trim_cell(F.get(split, F.lit(0)))).alias("key"),
        F.when(usable, trim_cell(F.get(split, F.lit(1)))).alias("val"),
    )
    number = F.when(F.col("val").rlike(INT_RE), F.col("val").try_cast("bigint"))

    def last(key, value, default):
        at = F.when((F.col("key") == key) & value.isNotNull(), F.col("_o"))
        return F.coalesce(F.max_by(value, at), F.lit(default)).alias(key)

    return pairs.groupBy(by).agg(
        last("uuid", F.col("val"), ""),
        last("seqno", number, 0),
        last("safe_to_bootstrap", number, 0),
    )


def _text_with_file(spark: SparkSession, glob: str) -> DataFrame:
    return (
        spark.read.text(glob)
        .select("value", F.col("_metadata.file_path").alias("file"))
        .withColumn("_line", F.monotonically_increasing_id())
    )


def read_kv_files(spark: SparkSession, glob: str) -> DataFrame:
    """State files, many at once: `file`, `uuid`, `seqno`, `safe_to_bootstrap`."""
    return parse_kv_lines(_text_with_file(spark, glob), "file", "_line")


def parse_metrics(lines: DataFrame, name: str, by: str = "file", order: str | None = None) -> DataFrame:
    """First line starting with the metric name: its second field as integer.
    NULL where a file lacks the metric or its number is bad."""
    text = trim_cell(F.col("value"))
    hit = text.startswith(name)
    fields = F.split(text, r"\s+")
    usable = hit & (F.size(fields) >= 2)
    at = F.when(usable, F.col(order) if order else F.monotonically_increasing_id())
    first = lines.select(by, at.alias("_at"), F.get(fields, F.lit(1)).alias("_f"))
    return (
        first.groupBy(by)
        .agg(F.min_by("_f", "_at").alias("_f"))
        .select(by, int_or(F.col("_f"), F.lit(None).cast("bigint")).alias("metric"))
    )


def read_metrics(spark: SparkSession, glob: str, name: str) -> DataFrame:
    return parse_metrics(_text_with_file(spark, glob), name, "file", "_line")


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """Command log with nested overrides, under its declared schema."""
    return spark.read.schema(COMMAND_SCHEMA).json(path)


# Error text that marks a job as cut off by a restart.
RESTART_MESSAGE = "agent restarted during import (can resume from checkpoint)"


def read_jobs(spark: SparkSession, path: str, now: int | None = None) -> DataFrame:
    """Job records; unreadable ones are skipped, and jobs that were still pending
    or running count as failed by the restart."""
    jobs = (
        spark.read.schema(JOB_SCHEMA)
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", "*.json")
        .option("multiLine", True)
        .json(path)
    )
    return mark_interrupted(jobs, now)


def mark_interrupted(jobs: DataFrame, now: int | None = None) -> DataFrame:
    cut = F.col("status").isin("pending", "running")
    ended = F.lit(now).cast("bigint") if now is not None else F.unix_timestamp()
    return (
        jobs.withColumn("error", F.when(cut, F.lit(RESTART_MESSAGE)).otherwise(F.col("error")))
        .withColumn("endedAt", F.when(cut, ended).otherwise(F.col("endedAt")))
        .withColumn("status", F.when(cut, F.lit("failed")).otherwise(F.col("status")))
    )
