"""Result grid: search over all columns, sort, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlake.functions.names import display_text
from slotlake.functions.rows import any_of
from slotlake.operators.numbering import running_total
from slotlake.session import materialize


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column contains the text, upper and lower case alike."""
    if not text:
        return df
    needle = F.lower(F.lit(text))
    return df.where(
        any_of([F.lower(display_text(F.col(n), t)).contains(needle) for n, t in df.dtypes])
    )


def sort(df: DataFrame, column: str | None, direction: str | None = "asc") -> DataFrame:
    """Single-column sort: asc, desc or none."""
    if not column or direction is None:
        return df
    return df.orderBy(F.asc(column) if direction == "asc" else F.desc(column))


def _order(column: str, direction: str, tiebreak: str):
    first = F.asc(column) if direction == "asc" else F.desc(column)
    return [first] if tiebreak == column else [first, F.asc(tiebreak)]


def page(
    df: DataFrame,
    index: int,
    size: int = 10,
    column: str = "id",
    direction: str = "asc",
    tiebreak: str = "id",
) -> DataFrame:
    """Page `index` (from 0). The tie break makes pages disjoint and complete."""
    ordered = df.orderBy(*_order(column, direction, tiebreak))
    return ordered.offset(index * size).limit(size)


def page_after(
    df: DataFrame,
    last_value,
    last_tiebreak,
    size: int = 10,
    column: str = "id",
    direction: str = "asc",
    tiebreak: str = "id",
) -> DataFrame:
    """The page that follows a known last row. Unlike an offset, its cost does not
    grow with the page number: the condition is pushed to the scan."""
    ahead = F.col(column) > F.lit(last_value)
    if direction != "asc":
        ahead = F.col(column) < F.lit(last_value)
    tied = (F.col(column) == F.lit(last_value)) & (F.col(tiebreak) > F.lit(last_tiebreak))
    following = df.where(ahead if tiebreak == column else ahead | tied)
    return following.orderBy(*_order(column, direction, tiebreak)).limit(size)


class Pages:
    """Any page of a sorted table at the cost of a range of it.

    The sort keys are dealt into ranges of about `range_rows` rows once; a row for each
    range tells its first and last key and how many rows come before. A page looks up
    its range there, filters the table by the keys at its ends, which goes to the scan,
    and sorts what is left. The tie break must be without nulls and duplicates.

    A task sorts the keys of many ranges and cuts them by position, so there are no more
    tasks, and samples of keys for them, than for any other sort.
    """

    def __init__(
        self, df: DataFrame, column: str, direction: str = "asc", tiebreak: str = "id", range_rows: int = 100_000
    ):
        self.df, self.column, self.direction, self.tiebreak = df, column, direction, tiebreak
        self.order = _order(column, direction, tiebreak)
        keys = df.select(F.col(column).alias("value"), F.col(tiebreak).alias("tie"))
        order = _order("value", direction, "tie")
        # Equal keys are counted as one, so that no range begins amid them.
        dealt = keys.repartitionByRange(*order).groupBy("value", "tie").agg(F.count("*").alias("n"))
        # The task in the upper bits, the position in it in the lower 33.
        cut = dealt.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
        task, position = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        ends = [
            fn(name, "at").alias(f"{label}_{name}")
            for label, fn in (("first", F.min_by), ("last", F.max_by))
            for name in ("value", "tie")
        ]
        index = cut.groupBy(task.alias("task"), F.floor(position / F.lit(range_rows)).alias("k")).agg(
            F.min("at").alias("range"), F.sum("n").alias("n"), *ends
        )
        self.index = materialize(running_total(index.drop("task", "k"), ["range"], {"n": "before"}), "page-index")

    def _ahead(self, value, tie, strict: bool) -> Column:
        """Rows whose key stands before the given one, or is it unless `strict`. Nulls
        come first in ascending order and last in descending order."""
        v, t = F.col(self.column), F.col(self.tiebreak)
        tied = v.eqNullSafe(F.lit(value)) & ((t < F.lit(tie)) if strict else (t <= F.lit(tie)))
        if self.direction == "asc":
            before = F.lit(False) if value is None else v.isNull() | (v < F.lit(value))
        else:
            before = v.isNotNull() if value is None else v > F.lit(value)
        return F.coalesce(before, F.lit(False)) | tied

    def page(self, index: int, size: int = 10) -> DataFrame:
        """Page `index` (from 0); the same rows as `page`."""
        start, stop = index * size, (index + 1) * size
        hit = self.index.where((F.col("before") < stop) & (F.col("before") + F.col("n") > start))
        ranges = hit.orderBy("range").collect()
        if not ranges:
            return self.df.limit(0)
        low, high = ranges[0], ranges[-1]
        rows = self.df.where(
            ~self._ahead(low.first_value, low.first_tie, True) & self._ahead(high.last_value, high.last_tie, False)
        )
        return rows.orderBy(*self.order).offset(start - low.before).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.ceil(F.count("*") / F.lit(size)).cast("bigint").alias("pages"),
    )


def display(df: DataFrame) -> DataFrame:
    """Every cell as the text a grid shows."""
    return df.select(*[display_text(F.col(n), t).alias(n) for n, t in df.dtypes])
