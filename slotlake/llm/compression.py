"""Vector code compression: product codes whose nearest entries come from Orchard search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.llm import textkit as kit
from slotlake.llm.common import arrow_schema
from slotlake.llm.topk import usable
from slotlake.session import materialize

# Components beyond this are set to it, so that every squared distance of a part of up
# to 16 components, and every sum of 2**35 of them, is exact in 64 bits.
LARGEST = 1 << 28


@dataclass(frozen=True)
class Codes:
    """`parts` equal parts a vector, `entries` of a codebook, `rounds` of refinement,
    `scale` integer steps of a component's unit, and rows that are searched at a time."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    rows: int = 4096


# --- Orchard search ---------------------------------------------------------------


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows (of the last axis)."""
    step = a - b
    return np.einsum("...i,...i->...", step, step)


class Book:
    """A codebook with, for each entry, the other entries by distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = np.stack([squared(entries, e) for e in entries])
        np.fill_diagonal(apart, -1)  # an entry heads its own list, which is then cut off
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.lists = order
        self.apart = np.take_along_axis(apart, order, axis=1)
        sums = entries.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row; ties go to the
        lower index.

        A row starts at an entry of a like sum and walks that entry's list. A nearer
        entry (or one as near, of lower index) is jumped to, and its own list is
        walked from its head; entries that were looked at are marked and passed over.
        The walk ends at the first entry that is more than twice as far from the
        current one as the row is: by the triangle inequality all from there on are
        farther from the row than the current entry. All rows walk at the same time.
        """
        n, last = len(rows), len(self.entries) - 1
        at = self.by_sum[np.minimum(np.searchsorted(self.sums, rows.sum(axis=1)), last)]
        best = squared(rows, self.entries[at])
        marked = np.zeros((n, last + 1), bool)
        marked[np.arange(n), at] = True
        step = np.zeros(n, np.int64)
        live = np.arange(n) if last else np.zeros(0, np.int64)
        while len(live):
            here, k = at[live], step[live]
            live = live[self.apart[here, k] <= 4 * best[live]]
            entry = self.lists[at[live], step[live]]
            step[live] += 1
            new = ~marked[live, entry]
            seen, entry = live[new], entry[new]
            marked[seen, entry] = True
            far = squared(rows[seen], self.entries[entry])
            better = (far < best[seen]) | ((far == best[seen]) & (entry < at[seen]))
            jump = seen[better]
            at[jump], best[jump], step[jump] = entry[better], far[better], 0
            live = live[step[live] < last]
        return at, best


# --- jobs -------------------------------------------------------------------------


def whole_components(vectors: DataFrame, codes: Codes) -> DataFrame:
    """vec_id, label, vector: the rows that take part, as integers."""
    top = F.lit(float(LARGEST))
    whole = F.transform(
        "embedding",
        lambda x: F.least(F.greatest(F.floor(x.cast("double") * codes.scale).cast("double"), -top), top).cast("long"),
    )
    length = F.size("embedding")
    return vectors.filter(usable(F.col("embedding")) & (length > 0) & (length % codes.parts == 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("vector")
    )


def blocks(batches: Iterable[pa.RecordBatch], dim: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the rows with their vectors as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield part, part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sums_by_entry(books: np.ndarray, dim: int, codes: Codes):
    """mapInArrow function: rows and component sums of each entry over a task's rows."""
    schema = arrow_schema("part int, entry int, n long, total array<long>")
    width = dim // codes.parts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Book(b) for b in books]
        count = np.zeros(books.shape[:2], np.int64)
        total = np.zeros(books.shape, np.int64)
        for _, rows in blocks(batches, dim, codes.rows):
            for p, book in enumerate(found):
                own = rows[:, p * width : (p + 1) * width]
                entry, _ = book.nearest(own)
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                total[p, used] += np.add.reduceat(own[order], first, axis=0)
                count[p] += np.bincount(entry, minlength=books.shape[1])
        part, entry = np.nonzero(count)
        if len(part):
            yield kit.record(schema, part, entry, count[part, entry], list(total[part, entry]))

    return run


def refined(rows: DataFrame, books: np.ndarray, dim: int, codes: Codes) -> np.ndarray:
    """The codebooks after one round: parts * entries * width integers, whose number
    does not depend on the table."""
    width = dim // codes.parts
    partial = rows.select("vector").mapInArrow(
        sums_by_entry(books, dim, codes), "part int, entry int, n long, total array<long>"
    )
    means = partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"s{k}") for k in range(width)]
    )
    books = books.copy()
    for part, entry, n, *total in means.collect():
        books[part, entry] = [s // n for s in total]
    return books


def coded(books: np.ndarray, dim: int, codes: Codes):
    """mapInArrow function: code and error of each row."""
    schema = arrow_schema("vec_id long, label int, code string, error long")
    width = dim // codes.parts
    digits = max(2, len(f"{codes.entries - 1:x}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Book(b) for b in books]
        for block, rows in blocks(batches, dim, codes.rows):
            names, errors = [], np.zeros(len(rows), np.int64)
            for p, book in enumerate(found):
                entry, far = book.nearest(rows[:, p * width : (p + 1) * width])
                names.append([f"{e:0{digits}x}" for e in entry])
                errors += far
            yield kit.record(schema, block["vec_id"], block["label"], ["".join(x) for x in zip(*names)], errors)

    return run


def compress(vectors: DataFrame, codes: Codes = Codes()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error; codebooks as parts x entries x width integers).

    Components are floor(scale * x). The codebook of a part starts as that part of the
    rows of smallest vec_id; each round assigns every row to its nearest entries and
    replaces an entry by the floor of its rows' mean. Unused entries stay.

    Vectors that are null, empty, or hold a null or non-finite component take no part;
    nor do those whose length is no multiple of `parts`, or another than the length of
    most codebook rows (ties: the shorter). Components beyond 2**28 count as 2**28. Rows
    with a null vec_id are coded, and come last in the order; rows that share a vec_id
    come in the order of their components. Fewer rows than `entries` make smaller
    codebooks. An empty table gives no rows. Other columns are not looked at.
    """
    rows = whole_components(vectors, codes)
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = [r.vector for r in rows.select("vec_id", "vector").orderBy(*order).limit(codes.entries).collect()]
    if not first:
        empty = rows.select("vec_id", F.col("label").cast("int"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.limit(0), np.zeros((codes.parts, 0, 0), np.int64)
    lengths = [len(x) for x in first]
    dim = max(sorted(set(lengths)), key=lengths.count)
    if len(set(lengths)) > 1:
        rows = rows.filter(F.size("vector") == dim)
        first = [r.vector for r in rows.select("vec_id", "vector").orderBy(*order).limit(codes.entries).collect()]
    rows = materialize(rows.filter(F.size("vector") == dim).withColumn("label", F.col("label").cast("int")), "codes-rows")
    width = dim // codes.parts
    books = np.array(first, np.int64).reshape(len(first), codes.parts, width).transpose(1, 0, 2).copy()
    for _ in range(codes.rounds):
        books = refined(rows, books, dim, codes)
    return rows.mapInArrow(coded(books, dim, codes), "vec_id long, label int, code string, error long"), books


def digest(books: np.ndarray) -> str:
    """sha256 of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded_rows: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over the rows of equal label, nulls together.

    One row a label is joined back, so a label may have any share of the rows."""
    sums = coded_rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded_rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def code_table(vectors: DataFrame, codes: Codes = Codes()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label of `compress`."""
    found, books = compress(vectors, codes)
    found = with_label_error(materialize(found, "codes-found"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")
