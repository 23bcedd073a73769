"""Dense record numbers in file order, without shuffling the records.

A scan carries, per row, the file, the start of its block in that file and its
position in the scan task. One pass counts the records of each block; the running
total of these counts, in (file, block) order, is what each block's positions are
shifted by. Only the per-block counts are sorted, never the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotlake.session import broadcast_if_small, materialize

FILE, BLOCK, POS = "_file", "_block", "_pos"
# A hash of file and block; what rows carry from which the two are gone.
KEY = "_block_key"
# The number of a row's file among those that have records.
FILE_NO = "_file_no"
SCAN_COLUMNS = (FILE, BLOCK, POS)

# Memory of one broadcast layout row, all integers, taken generously: 3.7 million
# blocks (500 TB in blocks of 128 MiB) stay below the broadcast limit.
LAYOUT_ROW_BYTES = 72


def with_positions(scan: DataFrame) -> DataFrame:
    """Attach file, block and in-task position to a file scan. Must follow the
    scan directly (after row filters, before any exchange)."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
    ).withColumn(POS, F.monotonically_increasing_id())


def block_layout(scan: DataFrame, *extra) -> DataFrame:
    """One row per scanned block: records, first position, extra aggregates.
    Written once, so every later step sees the same counts."""
    layout = scan.groupBy(FILE, BLOCK).agg(
        F.count("*").alias("n"),
        F.min(POS).alias("first_pos"),
        F.max(POS).alias("last_pos"),
        *extra,
    )
    return materialize(layout, "layout")


def running_total(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add exclusive running totals (`values`: source column -> output column).

    One ordered window: the frame holds a row per file or block, never records.
    """
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.select(
        "*",
        *[
            F.coalesce(F.sum(src).over(before), F.lit(0)).alias(out)
            for src, out in values.items()
        ],
    )


def block_offsets(layout: DataFrame) -> DataFrame:
    """Layout plus `before` (records in earlier blocks), `file_before` (records in
    earlier files) and `file_no` (1-based)."""
    files = layout.groupBy(FILE).agg(F.sum("n").alias("file_n"), F.lit(1).alias("one"))
    files = running_total(
        files, [FILE], {"file_n": "file_before", "one": "files_before"}
    ).select(FILE, "file_before", (F.col("files_before") + 1).alias("file_no"))
    blocks = running_total(layout, [FILE, BLOCK], {"n": "before"})
    return blocks.join(files, FILE)


def number_records(
    scan: DataFrame, layout: DataFrame, blocks: int | None = None
) -> DataFrame:
    """Add `record_no` (dense, from 1, in file order), `file_record_no` and
    `file_no`; the scan columns are dropped.

    Both passes must see the same blocks. If the cluster changed in between and
    the input was split differently, the query fails instead of misnumbering.
    `blocks` is the number of layout rows, counted here if it is not known.
    """
    rows = layout.count() if blocks is None else blocks
    # Blocks go by a hash, so that the layout is small; should two share one, the
    # positions tell which is meant.
    key = F.xxhash64(FILE, BLOCK)
    if KEY in scan.columns:
        scan = scan.withColumn("_own", F.col(KEY))
    else:
        scan = scan.withColumn("_own", key)
    offsets = block_offsets(layout).select(
        key.alias("_key"), "first_pos", "last_pos", "before", "file_before", "file_no"
    )
    own_block = (F.col("_own") == F.col("_key")) & F.col(POS).between(F.col("first_pos"), F.col("last_pos"))
    joined = scan.join(broadcast_if_small(offsets, rows, LAYOUT_ROW_BYTES), own_block, "left")
    in_block = F.col(POS) - F.col("first_pos")
    record_no = F.when(F.col("before").isNotNull(), F.col("before") + in_block + 1).otherwise(
        F.raise_error(F.lit("input was split differently in the two passes; run again"))
        .cast("bigint")
    )
    keep = [c for c in scan.columns if c not in (*SCAN_COLUMNS, KEY, "_own")]
    return joined.select(
        *keep, record_no.alias("record_no"), "file_before", "file_no"
    ).select(
        *keep,
        "record_no",
        (F.col("record_no") - F.col("file_before")).alias("file_record_no"),
        "file_no",
    )


def dense_numbers(scan: DataFrame, column: str = "record_no", start: int = 1) -> DataFrame:
    """Number the rows of any file scan made with `with_positions`."""
    numbered = number_records(scan, block_layout(scan))
    keep = [c for c in scan.columns if c not in SCAN_COLUMNS]
    return numbered.select(*keep, (F.col("record_no") + (start - 1)).alias(column))


def batch_index(df: DataFrame, size: int, number: str, column: str = "batch_no") -> DataFrame:
    """0-based index of the N-row batch a dense 1-based number falls in."""
    size = max(size, 1)
    return df.withColumn(column, F.floor((F.col(number) - 1) / F.lit(size)).cast("bigint"))


def chunk_checkpoints(
    df: DataFrame,
    number: str,
    line: str,
    batch_size: int = 10_000,
    workers: int = 4,
    multiplier: int = 2,
) -> DataFrame:
    """Line to resume from at the end of each chunk of batch x workers x 2 records."""
    chunk = max(batch_size, 1) * max(workers, 1) * multiplier
    return (
        batch_index(df, chunk, number, "chunk_no")
        .groupBy("chunk_no")
        .agg(F.count("*").alias("records"), F.max(line).alias("last_line"))
    )
