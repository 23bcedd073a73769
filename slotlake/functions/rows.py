"""Whole-row conversion under a declared schema, with a reject per bad row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.functions import cells as C
from slotlake.schema import Column

REJECT = "_reject"
REJECT_TYPE = "struct<line:bigint,column:string,value:string,reason:string>"
REJECT_DDL = "line bigint, column string, value string, reason string"


WRONG_WIDTH, BAD_ID = -1, 0


def convert_rows(
    df: DataFrame, columns: list[Column], lenient_bool: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Rows of text cells to typed rows plus `_reject`.

    Input: `line_no` and `cells`, the id first. Output: `line_no`, `id`, one typed
    column per declared column, and `_reject`, NULL on good rows. A reject names
    the first failing column from left to right: row width, then id, then cells.
    Columns in `keep` go along, in front.
    """
    width = len(columns)

    def parser(col: Column):
        if lenient_bool and col.type == "attr_bool":
            return C.parse_bool_lenient
        return C.PARSERS[col.type]

    # Trimmed cells (the id cell is taken as it is), then typed values; each step is
    # a projection of its own, so no cell is cut or trimmed twice.
    odd = F.array_join("cells", "").rlike(C.ODD_SPACE_RE)
    trimmed = df.select(*keep, "line_no", "cells", odd.alias("_odd")).select(
        *keep,
        "line_no",
        "cells",
        F.get("cells", F.lit(0)).alias("_t0"),
        *[
            C.trim_cell(F.get("cells", F.lit(i)), F.col("_odd")).alias(f"_t{i}")
            for i in range(1, width + 1)
        ],
    )
    typed = trimmed.select(
        *keep,
        "line_no",
        "cells",
        C.parse_bigint(F.col("_t0")).alias("_v0"),
        *[parser(c)(F.col(f"_t{i}")).alias(f"_v{i}") for i, c in enumerate(columns, 1)],
    )

    # Position of the first failure; its description is built from the position, so
    # the test of a good row stays short.
    can_fail = [i for i, c in enumerate(columns, 1) if not c.is_string]
    bad = F.when(F.size("cells") != width + 1, F.lit(WRONG_WIDTH)).when(
        F.col("_v0").isNull(), F.lit(BAD_ID)
    )
    for i in can_fail:
        bad = bad.when(F.col(f"_v{i}").isNull(), F.lit(i))
    # A row id is never negative: this branch only keeps the optimizer from copying
    # the whole conversion into every filter on `_reject`.
    bad = bad.when(F.monotonically_increasing_id() < 0, F.lit(WRONG_WIDTH))
    values = [F.col("_v0").alias("id")] + [
        F.col(f"_v{i}").alias(c.name) for i, c in enumerate(columns, 1)
    ]
    tested = typed.select(*keep, "line_no", "cells", *values, bad.alias("_bad"))
    return tested.select(
        *keep, "line_no", "id", *[f"`{c.name}`" for c in columns], _reject(columns).alias(REJECT)
    )


def _reject(columns: list[Column]) -> SparkColumn:
    """Description of the failure at position `_bad`."""
    bad = F.col("_bad")
    raw = F.get("cells", bad)
    # The texts are part of the reject table's format.
    wrong_width = F.concat(
        F.lit(f"expected {len(columns)} data columns (plus ID), got "),
        F.size("cells").cast("string"),
        F.lit(" total columns"),
    )
    reason = F.when(bad == WRONG_WIDTH, wrong_width).when(
        bad == BAD_ID, F.lit("invalid ID: invalid integer")
    )
    for logical_type in sorted({c.type for c in columns if not c.is_string}):
        at = [i for i, c in enumerate(columns, 1) if c.type == logical_type]
        reason = reason.when(bad.isin(at), C.reject_reason(logical_type, C.trim_cell(raw)))
    names = F.array(F.lit("id"), *[F.lit(c.name) for c in columns])
    described = F.struct(
        F.col("line_no").alias("line"),
        F.when(bad == WRONG_WIDTH, F.lit("")).otherwise(F.get(names, bad)).alias("column"),
        F.when(bad == WRONG_WIDTH, F.lit("")).otherwise(raw).alias("value"),
        reason.alias("reason"),
    )
    return F.when(bad.isNotNull(), described.cast(REJECT_TYPE))


def good_rows(converted: DataFrame) -> DataFrame:
    return converted.where(F.col(REJECT).isNull()).drop(REJECT)


def reject_rows(converted: DataFrame) -> DataFrame:
    return converted.where(F.col(REJECT).isNotNull()).select(f"{REJECT}.*")


def sql_rows(
    typed: DataFrame, columns: list[Column], escape_backslash: bool = True
) -> DataFrame:
    """Good typed rows as SQL literal texts: `id` and one text per column."""
    keep = [c for c in typed.columns if c == "line_no"]
    return typed.select(
        *keep,
        F.col("id").cast("string").alias("id"),
        *[
            C.sql_literal(c.type, F.col(c.name), escape_backslash).alias(c.name)
            for c in columns
        ],
    )


def reject_summary(rejects: DataFrame) -> DataFrame:
    """Rejected rows per column and reason kind, with the first line as a sample."""
    kind = F.regexp_replace("reason", r":.*\z|[0-9]+ total columns\z", "")
    return rejects.groupBy("column", F.trim(kind).alias("reason")).agg(
        F.count("*").alias("rows"), F.min("line").alias("first_line")
    )


def reject_text(rejects: DataFrame) -> DataFrame:
    """One log line per reject."""
    where = F.concat(
        F.lit("line "), F.col("line").cast("string"),
        F.lit(': column "'), F.col("column"), F.lit('": '), F.col("reason"),
    )
    value = F.when(
        F.col("value") != "", F.concat(F.lit(' (value: "'), F.col("value"), F.lit('")'))
    ).otherwise(F.lit(""))
    return rejects.select("line", F.concat(where, value).alias("message"))


def all_of(conditions: list[SparkColumn]) -> SparkColumn:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[SparkColumn]) -> SparkColumn:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def after_line(df: DataFrame, start_line: int) -> DataFrame:
    """Rows behind the line an earlier run got to."""
    return df.where(F.col("line_no") > start_line)


def import_counters(converted: DataFrame) -> DataFrame:
    """Processed and failed rows and the last line, in one pass."""
    bad = F.col(REJECT).isNotNull()
    return converted.agg(
        F.count_if(~bad).alias("processed"),
        F.count_if(bad).alias("failed"),
        F.coalesce(F.max("line_no"), F.lit(0)).alias("last_line"),
    )
