"""Streaming imports: new files flow into the delta table, resumable at any time.

Each micro-batch writes its own directory, keyed by batch id and replaced as a whole,
so a batch that is replayed after a failure leaves no duplicates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from slotlake.functions import rows as R
from slotlake.functions.records import delimiter_of, split_plain
from slotlake.operators import numbering as N
from slotlake.plans.lake import Lake
from slotlake.schema import Column, delta_name, struct_type
from slotlake.session import literal_path, path_exists
from slotlake.sinks.files import write_rejects
from slotlake.sources.delimited import cells_of_lines, has_header, layout_summary, line_layout

REJECTED = "rejected"
PROGRESS_DDL = (
    "batch_id bigint, processed bigint, failed bigint, last_line bigint, records bigint, upto bigint, files bigint"
)


@dataclass(frozen=True)
class Feed:
    """How the files of a stream are read.

    `header` None looks at the first file of each batch; with headers every file
    has one. Method `indexer` splits plain lines, makes ids from 0 and takes any
    boolean; `bulk` parses quotes, and `auto_id` makes ids from 1. Ids and line
    numbers run on over all batches. `sep` None goes by the source's extension.
    """

    columns: list[Column]
    target: str
    sep: str = ","
    auto_id: bool = False
    header: bool | None = False
    method: str = "bulk"


def _converted_batch(batch: DataFrame, batch_id: int, feed: Feed) -> tuple[DataFrame, int, int]:
    """Typed rows of one micro-batch, and its records and files so far in all batches."""
    spark = batch.sparkSession
    raw = batch.withColumn(N.POS, F.monotonically_increasing_id())
    scan = (
        batch.where(F.col("value") != "")
        .withColumnRenamed("value", "record")
        .withColumn(N.POS, F.monotonically_increasing_id())
    )
    if feed.method == "indexer":
        layout = N.block_layout(scan)
        head = layout.agg(F.count("*").alias("blocks"), F.min(N.FILE).alias("file")).head()
        scan = scan.select(split_plain(F.col("record"), feed.sep).alias("cells"), *N.SCAN_COLUMNS)
    else:
        layout = line_layout(scan, feed.sep)
        head = layout_summary(layout)
        scan, layout = cells_of_lines(raw, scan, layout, feed.sep, head.open > 0)
    header = feed.header
    if header is None:
        header = head.file is not None and has_header(spark, literal_path(unquote(head.file)), feed.sep)
    numbered = N.number_records(scan, layout, head.blocks)
    records, files = _totals_before(spark, feed.target, batch_id)
    line = F.col("record_no") + F.lit(records)
    number = line
    if header:
        numbered = numbered.where(F.col("file_record_no") > 1)
        number = line - F.col("file_no") - F.lit(files)
    if feed.method == "indexer":
        number = number - 1
    if feed.auto_id or feed.method == "indexer":
        numbered = numbered.withColumn("cells", F.concat(F.array(number.cast("string")), "cells"))
    seen = layout.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_distinct(N.FILE).alias("files")
    ).head()
    converted = R.convert_rows(
        numbered.select(line.alias("line_no"), "cells"), feed.columns, feed.method == "indexer"
    )
    return converted, records + seen.records, files + seen.files


def _totals_before(spark: SparkSession, target: str, batch_id: int) -> tuple[int, int]:
    """Records and files of all earlier batches. Each batch's progress has the running
    totals, so the one before tells; only if that is missing all are looked at."""
    last = f"{target}/progress/batch_id={batch_id - 1}"
    if path_exists(spark, last):
        row = spark.read.schema("upto bigint, files bigint").parquet(last).head()
        return row.upto, row.files
    # This batch's own entry does not count when it is replayed.
    earlier = progress(spark, target).where(F.col("batch_id") < batch_id)
    zero = F.lit(0)
    row = earlier.agg(F.coalesce(F.max("upto"), zero), F.coalesce(F.max("files"), zero)).head()
    return row[0], row[1]


def _write_rows(batch: DataFrame, batch_id: int, feed: Feed, out: str) -> tuple:
    """Write a batch's rows, good and rejected ones apart, in one pass; its progress."""
    converted, upto, files = _converted_batch(batch, batch_id, feed)
    seen = Observation(f"batch-{uuid.uuid4().hex}")
    (
        converted.withColumn(REJECTED, F.col(R.REJECT).isNotNull())
        .observe(
            seen,
            F.count_if(~F.col(REJECTED)).alias("processed"),
            F.count_if(F.col(REJECTED)).alias("failed"),
            F.coalesce(F.max("line_no"), F.lit(0)).alias("last_line"),
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy(REJECTED)
        .parquet(out)
    )
    done = seen.get
    return done["processed"], done["failed"], done["last_line"], done["processed"] + done["failed"], upto, files


def _write_batch(batch: DataFrame, batch_id: int, feed: Feed) -> None:
    """A batch under its id in the target, replaced as a whole, then its progress."""
    done = _write_rows(batch, batch_id, feed, f"{feed.target}/data/batch_id={batch_id}")
    _save_progress(batch.sparkSession, batch_id, feed, done)


def _save_progress(spark: SparkSession, batch_id: int, feed: Feed, row: tuple) -> None:
    schema = PROGRESS_DDL.removeprefix("batch_id bigint, ")
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(
        f"{feed.target}/progress/batch_id={batch_id}"
    )


def progress(spark: SparkSession, target: str) -> DataFrame:
    """Counters per finished batch: processed, failed, last line."""
    path = f"{target}/progress"
    if not path_exists(spark, path):
        return spark.createDataFrame([], PROGRESS_DDL)
    return spark.read.schema(PROGRESS_DDL).parquet(path).select(
        "batch_id", "processed", "failed", "last_line", "records", "upto", "files"
    )


def stream_import(
    spark: SparkSession,
    source: str,
    columns: list[Column],
    target: str,
    checkpoint: str,
    sep: str | None = None,
    auto_id: bool = False,
    max_files_per_batch: int | None = None,
    available_now: bool = True,
    header: bool | None = False,
    method: str = "bulk",
) -> StreamingQuery:
    """Import the files of a directory, and files that arrive later (see `Feed`).

    Batches follow the arrival of files, records in a batch the file order. A
    restart on the same checkpoint goes on after the last finished batch.
    """
    how = Feed(columns, target, sep or delimiter_of(source), auto_id, header, method)

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, batch_id, how)

    return _start(spark, source, write, checkpoint, max_files_per_batch, available_now)


def stream_into_delta(
    lake: Lake,
    table: str,
    source: str,
    target: str,
    checkpoint: str,
    sep: str | None = None,
    auto_id: bool = False,
    max_files_per_batch: int | None = None,
    available_now: bool = True,
    feed: str = "stream",
    header: bool | None = False,
    method: str = "bulk",
) -> StreamingQuery:
    """Live feed of a table: good rows go to its delta table, where the unified view
    shows them at once, and rejects to the lake's reject table.

    A batch is converted and written once, into a folder of its own, whose good half
    becomes a load of the delta table; `target` keeps the progress. Both tables take a
    batch under its own id, so a replay adds nothing, also after a compaction. Feeds of
    one table need different `feed` names.
    """
    spark = lake.spark
    columns = lake.registry.get(table).columns
    lake.create_table(delta_name(table))
    how = Feed(columns, target, sep or delimiter_of(source), auto_id, header, method)

    def write(batch: DataFrame, batch_id: int) -> None:
        load, out = f"{feed}-{batch_id}", lake.new_location(delta_name(table))
        done = _write_rows(batch, batch_id, how, out)
        rejects = _read_batches(spark, out, columns).where(F.col(REJECTED)).select(f"{R.REJECT}.*")
        write_rejects(rejects, lake.rejects_path, f"{table}-{load}")
        if done[0]:
            part = {"part": uuid.uuid4().hex, "path": f"{out}/{REJECTED}=false", "rows": done[0]}
            lake.delta(table).register(part, load)
        _save_progress(spark, batch_id, how, done)

    return _start(spark, source, write, checkpoint, max_files_per_batch, available_now)


def _start(
    spark: SparkSession,
    source: str,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    max_files_per_batch: int | None,
    available_now: bool,
) -> StreamingQuery:
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    value = F.col("value")
    lines = reader.text(source).select(
        F.when(value.endswith("\r"), F.left(value, F.length(value) - 1))
        .otherwise(value)
        .alias("value"),
        F.col("_metadata.file_path").alias(N.FILE),
        F.col("_metadata.file_block_start").alias(N.BLOCK),
    )
    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def delta_rows(spark: SparkSession, target: str, columns: list[Column]) -> DataFrame:
    """Good rows of all finished batches."""
    names = [f.name for f in struct_type(columns)]
    return _batches(spark, target, columns).where(~F.col(REJECTED)).select(*names)


def delta_rejects(spark: SparkSession, target: str, columns: list[Column]) -> DataFrame:
    return (
        _batches(spark, target, columns)
        .where(F.col(REJECTED))
        .select(f"{R.REJECT}.*", "batch_id")
    )


def _batches(spark: SparkSession, target: str, columns: list[Column]) -> DataFrame:
    return _read_batches(spark, f"{target}/data", columns, "batch_id bigint, ")


def _read_batches(
    spark: SparkSession, path: str, columns: list[Column], partition: str = ""
) -> DataFrame:
    fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in struct_type(columns)
    )
    schema = (
        f"line_no bigint, {fields}, {R.REJECT} {R.REJECT_TYPE}, "
        f"{partition}{REJECTED} boolean"
    )
    return spark.read.schema(schema).parquet(path)


def progress_listener(
    on_progress: Callable[[str, int, int], None],
) -> StreamingQueryListener:
    """Listener that hands on query name, batch id and input rows of every batch."""

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            p = event.progress
            on_progress(p.name, p.batchId, p.numInputRows)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    return Progress()
