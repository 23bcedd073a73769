"""Delimited files to `line_no` and `cells`, at any file size.

Lines are read with the splittable text source, also where a quoted field contains
line breaks: the state of the quotes is carried from block to block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake.functions import records as R
from slotlake.functions.cells import WHITE_SPACE
from slotlake.operators import numbering as N
from slotlake.session import broadcast_if_small, literal_path, materialize
from slotlake.sources.quotes import line_map, spanning_records


ROWS = f"line_no bigint, cells array<string>, {N.FILE_NO} bigint"


class EmptyInputError(ValueError):
    """There is no first line to look at."""


@dataclass(frozen=True)
class Before:
    """Records and files of the parts of a source that come before this one, and what
    was found out about the source in its first part."""

    records: int = 0
    files: int = 0
    header: bool | None = None
    auto_id: bool | None = None


def behind(layout: DataFrame, before: Before, header: bool, auto_id: bool) -> list[tuple[str, Before]]:
    """Each file of a layout, in order, with what comes before the one behind it."""
    files = layout.groupBy(N.FILE).agg(F.sum("n").alias("n")).orderBy(N.FILE).collect()
    ends = accumulate((f.n for f in files), initial=before.records)
    return [
        (f[N.FILE], Before(end, before.files + k, header, auto_id))
        for k, (f, end) in enumerate(zip(files, list(ends)[1:], strict=True), 1)
    ]


def source_parts(spark: SparkSession, path: str, part_bytes: int) -> DataFrame:
    """part, path, length, and the name as a scan gives it, by which it numbers records:
    the files of a source in parts of about `part_bytes` bytes, by name."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    files = files.select("path", "length", F.col("_metadata.file_path").alias(N.FILE))
    ahead = N.running_total(files, [N.FILE], {"length": "ahead"})
    return ahead.select(F.floor(F.col("ahead") / F.lit(part_bytes)).alias("part"), "path", "length", N.FILE)


def _lines(spark: SparkSession, paths) -> DataFrame:
    """Lines without their terminator; a single trailing carriage return is cut."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    value = F.col("value")
    return raw.withColumn(
        "value",
        F.when(value.endswith("\r"), F.left(value, F.length(value) - 1)).otherwise(value),
    )


def scan_lines(spark: SparkSession, paths) -> DataFrame:
    """Non-empty lines (`record`) with their scan position."""
    scan = _lines(spark, paths).where(F.col("value") != "")
    return N.with_positions(scan).withColumnRenamed("value", "record")


def preview(spark: SparkSession, path: str, n: int, sep: str | None = None) -> DataFrame:
    """line_no, cells: the first n records of a source, as they stand in its first files.
    No more is read than the first lines of as many files as it takes (a file whose
    first records go over more than 32,768 lines shows those that end before)."""
    sep, last, found = sep or R.delimiter_of(path), "", []
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")
    while len(found) < n:
        names = [r.path for r in files.where(F.col("path") > last).orderBy("path").limit(n).collect()]
        for name in names if names else ():
            found += _head_records(spark, name, n - len(found), sep)
            if len(found) >= n:
                break
        if not names:
            break
        last = names[-1]
    return spark.createDataFrame([(k + 1, c) for k, c in enumerate(found)], "line_no bigint, cells array<string>")


def _head_records(spark: SparkSession, file: str, n: int, sep: str) -> list[list[str]]:
    lines = _lines(spark, literal_path(file))
    for some in (2 * n, 16 * n, max(32_768, 16 * n)):
        values = [r.value for r in lines.head(some)]
        records = _first_records(spark, values, sep)
        whole = len(values) < some
        # The last record may go on behind these lines.
        if whole or len(records) > n:
            break
    return (records if whole else records[:-1])[:n]


def _is_int64(cell: str) -> bool:
    return bool(re.fullmatch(r"[+-]?[0-9]+", cell)) and -(2**63) <= int(cell) < 2**63


def first_file(spark: SparkSession, path: str) -> str:
    """The first file by name with any content under a path, as a pattern that only
    it matches."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    first = files.agg(F.min("path")).head()[0]
    if first is None:
        raise EmptyInputError("there is no line to look at")
    return literal_path(first)


def has_header(spark: SparkSession, path: str, sep: str | None = None) -> bool:
    """A first field that is not an integer means a header; a blank first line
    means none."""
    sep = sep or R.delimiter_of(path)
    first = _lines(spark, first_file(spark, path)).head(1)
    if not first:
        raise EmptyInputError("there is no line to look at")
    line = first[0].value
    return line != "" and not _is_int64(line.split(sep)[0].strip(WHITE_SPACE))


def _first_data_cell(spark: SparkSession, file: str, sep: str, header: bool) -> str | None:
    """First cell of a file's first data record, None if there is none. The line that it
    starts in is enough to know an integer; only a header over many lines asks for more
    lines (a header of over 32,768 lines counts as all there is)."""
    lines = _lines(spark, literal_path(file))
    for some in (8, 512, 32_768):
        values = [r.value for r in lines.head(some)]
        records = _first_records(spark, values, sep)
        if len(records) > header:
            return records[header][0]
        if len(values) < some:
            break
    return None


def _first_records(spark: SparkSession, values: list[str], sep: str) -> list[list[str]]:
    """The cells of the records of a few lines."""
    rows = spark.createDataFrame([(v,) for v in values], "value string") if values else None
    if rows is None:
        return []
    marked = rows.coalesce(1).select("value", line_map(F.col("value"), sep).alias("map")).collect()
    texts, inside = [], 0
    for row in marked:
        if inside:
            texts[-1] += "\n" + row.value
        elif row.value != "":
            texts.append(row.value)
        inside = row.map >> inside & 1
    cut = spark.createDataFrame(list(enumerate(texts)), "k int, text string") if texts else None
    if cut is None:
        return []
    return [r.cells for r in cut.select("k", R.split_record(F.col("text"), sep).alias("cells")).orderBy("k").collect()]


def line_layout(scan: DataFrame, sep: str) -> DataFrame:
    """Block layout of a line scan, with the lines that leave a quote open."""
    open_lines = F.count_if(~R.is_closed(F.col("record"), sep))
    return N.block_layout(scan, open_lines.alias("open_lines"))


def layout_summary(layout: DataFrame):
    """Blocks, first file and lines that leave a quote open, in one small job."""
    return layout.agg(
        F.count("*").alias("blocks"),
        F.min(N.FILE).alias("file"),
        F.coalesce(F.sum("open_lines"), F.lit(0)).alias("open"),
    ).head()


def cells_of_lines(
    raw: DataFrame, scan: DataFrame, layout: DataFrame, sep: str, any_open: bool
) -> tuple[DataFrame, DataFrame]:
    """Line scan to cell scan, with the layout of the result.

    `raw` has the same lines, blank ones too. Files in which some line leaves a quote
    open go through `spanning_records`; both paths cut records by the same rules.
    """
    cells = scan.select(
        R.split_record(F.col("record"), sep).alias("cells"), *N.SCAN_COLUMNS
    )
    if not any_open:
        return cells, layout.drop("open_lines")
    opened = layout.groupBy(N.FILE).agg(F.sum("open_lines").alias("open_lines"))
    opened = materialize(opened.where("open_lines > 0").select(N.FILE), "opened")
    layout = layout.drop("open_lines")
    plain = layout.join(opened, N.FILE, "left_anti").select("n", "first_pos", "last_pos", N.FILE, N.BLOCK)
    rows = opened.count()
    lines = raw.join(broadcast_if_small(opened, rows, N.LAYOUT_ROW_BYTES * 4), N.FILE, "left_semi")
    records, spanning = spanning_records(lines, sep)
    if plain.isEmpty():
        return records, spanning
    cells = cells.join(broadcast_if_small(opened, rows, N.LAYOUT_ROW_BYTES * 4), N.FILE, "left_anti")
    cells = cells.select("cells", F.xxhash64(N.FILE, N.BLOCK).alias(N.KEY), N.POS)
    return cells.unionByName(records), plain.unionByName(spanning)


def read_delimited(
    spark: SparkSession,
    path: str,
    width: int,
    sep: str | None = None,
    header: bool | None = None,
    auto_id: bool | None = None,
) -> DataFrame:
    """Quoted CSV/TSV to `line_no`, `cells` (id first); any row width is kept.

    `width` is the declared number of data columns. With `header=None` and
    `auto_id=None` both are detected from the first file: a first field that is not
    an integer is a header; a first data cell that is not an integer turns on ids
    1, 2, 3, ... in file order. Every file of a directory carries the header or
    none does. Line numbers count records over all files, headers included.
    """
    rows, _ = delimited_part(spark, path, width, sep or R.delimiter_of(path), header, auto_id)
    return rows.drop(N.FILE_NO)


def delimited_part(
    spark: SparkSession,
    path: str | list[str],
    width: int,
    sep: str,
    header: bool | None = None,
    auto_id: bool | None = None,
    before: Before | None = None,
) -> tuple[DataFrame, list[tuple[str, Before]]]:
    """`read_delimited` of some files of a source, whose numbers go on behind those of
    the files before; with that, also the files that have records, numbered from 1 in
    the rows, with what comes before the next one."""
    at = before or Before()
    header = at.header if at.header is not None else header
    auto_id = at.auto_id if at.auto_id is not None else auto_id
    scan = scan_lines(spark, path)
    layout = line_layout(scan, sep)
    head = layout_summary(layout)
    if head.file is None:
        if header is not False and not at.files:
            raise EmptyInputError("there is no line to look at")
        return spark.createDataFrame([], ROWS), []
    if header is None:
        header = has_header(spark, literal_path(unquote(head.file)), sep)
    raw = N.with_positions(_lines(spark, path))
    scan, layout = cells_of_lines(raw, scan, layout, sep, head.open > 0)
    if auto_id is None:
        cell = _first_data_cell(spark, unquote(head.file), sep, header)
        auto_id = cell is not None and not _is_int64(cell)
    numbered = N.number_records(scan, layout, head.blocks)
    if header:
        numbered = numbered.where(F.col("file_record_no") > 1)
    number = F.col("record_no") + at.records
    if auto_id:
        headers = F.col("file_no") + at.files if header else F.lit(0)
        new_id = (number - headers).cast("string")
        numbered = numbered.withColumn("cells", F.concat(F.array(new_id), "cells"))
    rows = numbered.select(number.alias("line_no"), "cells", F.col("file_no").alias(N.FILE_NO))
    return rows, behind(layout, before, header, auto_id) if before else []


def read_lines_split(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    header: bool | None = None,
) -> DataFrame:
    """Unquoted lines to `line_no` and `cells`; ids are always new, from 0.

    No quoting rule applies and blank lines are skipped, so every file splits.
    """
    rows, _ = lines_part(spark, path, sep or R.delimiter_of(path), header)
    return rows.drop(N.FILE_NO)


def lines_part(
    spark: SparkSession,
    path: str | list[str],
    sep: str,
    header: bool | None = None,
    before: Before | None = None,
) -> tuple[DataFrame, list[tuple[str, Before]]]:
    """`read_lines_split` of some files of a source, as `delimited_part`."""
    at = before or Before()
    header = at.header if at.header is not None else header
    scan = scan_lines(spark, path)
    layout = N.block_layout(scan)
    head = layout.agg(F.min(N.FILE).alias("file"), F.count("*").alias("blocks")).head()
    if head.file is None:
        if header is not False and not at.files:
            raise EmptyInputError("there is no line to look at")
        return spark.createDataFrame([], ROWS), []
    if header is None:
        header = has_header(spark, literal_path(unquote(head.file)), sep)
    scan = scan.select(
        R.split_plain(F.col("record"), sep).alias("cells"), *N.SCAN_COLUMNS
    )
    numbered = N.number_records(scan, layout, head.blocks)
    if header:
        numbered = numbered.where(F.col("file_record_no") > 1)
    number = F.col("record_no") + at.records
    headers = F.col("file_no") + at.files if header else F.lit(0)
    new_id = (number - headers - 1).cast("string")
    cells = F.concat(F.array(new_id), "cells").alias("cells")
    rows = numbered.select(number.alias("line_no"), cells, F.col("file_no").alias(N.FILE_NO))
    return rows, behind(layout, before, header, True) if before else []
