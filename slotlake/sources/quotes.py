"""Records that go over several lines, in files that are split like any other.

Whether a line starts inside a quote depends on all lines before it, but each line maps
that state to the next in one of four ways, and such maps compose. One pass folds the
lines of each block to the block's map and to how many records start in it, for either
state at its start; a window over the blocks of a file, a row a block, tells which it is.
A second pass cuts the records, in place. Only what crosses the border of a block is
moved: the lines ahead of a block's first record, and the record that they belong to.

Both passes take the lines of a block in the order of the scan, which built-in
operators cannot; the lines go to them in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotlake.functions import records as R
from slotlake.operators import numbering as N
from slotlake.session import BROADCAST_LIMIT_BYTES, materialize, ship_package

# A block's row in memory, with the path of its file, taken generously.
BLOCK_ROW_BYTES = 400


def line_map(value: Column, sep: str) -> Column:
    """Whether the line ends inside a quote: bit 0 if it starts outside of one, bit 1 if
    it starts inside."""
    quoted = value.contains('"')
    outside = quoted & ~R.is_closed(value, sep)
    inside = ~quoted | ~R.is_closed(F.concat(F.lit('"'), value), sep)
    return (F.when(outside, 1).otherwise(0) + F.when(inside, 2).otherwise(0)).cast("tinyint")


def states(maps: np.ndarray, start: int) -> np.ndarray:
    """The state before each line, and behind the last one."""
    low, high = maps & 1, maps >> 1
    turns = np.concatenate([[0], np.cumsum((low == 1) & (high == 0))])
    sets = np.where(low == high, np.arange(len(maps)), -1)
    last = np.concatenate([[-1], np.maximum.accumulate(sets)]) if len(maps) else np.array([-1])
    base = np.where(last >= 0, low[last] if len(maps) else 0, start)
    since = turns - np.where(last >= 0, turns[last + 1 if len(maps) else last], 0)
    return (base + since) & 1


def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each block of a batch with the block's key."""
    for batch in batches:
        if batch.num_rows:
            key = batch[N.KEY].to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(key[a]), batch.slice(a, b - a)


FOLD = f"{N.KEY} long, from_outside int, from_inside int, n_outside long, n_inside long"


def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: a block's state at its end and the records that start in it,
    if it starts outside and if it starts inside of a quote."""
    rows: list[tuple] = []
    for key, part in segments(batches):
        if not rows or rows[-1][0] != key:
            rows.append((key, 0, 1, 0, 0))
        _, *ends, n_outside, n_inside = rows[-1]
        maps, full = part["map"].to_numpy(), ~part["blank"].to_numpy(zero_copy_only=False)
        after = [states(maps, s) for s in ends]
        counts = [int((full & (s[:-1] == 0)).sum()) for s in after]
        rows[-1] = (key, int(after[0][-1]), int(after[1][-1]), n_outside + counts[0], n_inside + counts[1])
    if rows:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in FOLD.split(", ")])


def cut(pieces: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: the records that lie in one block, with their number in it; or
    the pieces of those that do not, a block's last record and, under number -1, the
    lines ahead of its first."""
    names = [N.KEY, N.POS, "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = number = goes_on = None
        held: list[str] = []  # lines of the record that the next line may go on with

        def close() -> list[tuple]:
            crosses = bool(held) and (number < 0 or goes_on)
            done = [(now, number, "\n".join(held))] if held and crosses == pieces else []
            held.clear()
            return done

        def out(rows: list[tuple]) -> pa.RecordBatch:
            keys, numbers, texts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], names)

        for key, part in segments(batches):
            if key != now:
                if done := close():
                    yield out(done)
                now, number = key, -1
                state, goes_on = part["start"][0].as_py(), part["goes_on"][0].as_py()
            before = states(part["map"].to_numpy(), state)
            state = int(before[-1])
            inside = before[:-1] == 1
            keep = np.flatnonzero(inside | ~part["blank"].to_numpy(zero_copy_only=False))
            if not len(keep):
                continue
            values, inside = part["value"].take(pa.array(keep)), inside[keep]
            starts = np.flatnonzero(~inside)
            first = int(starts[0]) if len(starts) else len(keep)
            held += values.slice(0, first).to_pylist()
            if not len(starts):
                continue
            done = close()
            if done:
                yield out(done)
            # All but the last record of the segment are whole.
            ends = np.append(starts[1:], len(keep))
            if not pieces and len(starts) > 1:
                lengths = (ends - starts)[:-1]
                whole = values.take(pa.array(starts[:-1])).to_pylist() if (lengths > 1).any() else None
                if whole is None:
                    texts = values.take(pa.array(starts[:-1]))
                else:
                    lines = values.to_pylist()
                    for k in np.flatnonzero(lengths > 1).tolist():
                        whole[k] = "\n".join(lines[starts[k] : ends[k]])
                    texts = pa.array(whole, pa.string())
                numbers = np.arange(number + 1, number + len(starts), dtype=np.int64)
                keys = np.full(len(numbers), key, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(numbers), texts.cast(pa.string())], names)
            number += len(starts)
            held += values.slice(int(starts[-1])).to_pylist()
        if done := close():
            yield out(done)

    return run


def spanning_records(lines: DataFrame, sep: str) -> tuple[DataFrame, DataFrame]:
    """(cells, key of the block, number in it; layout) of files whose records may go over
    several lines. A record belongs to the block in which it starts. `lines` has all
    lines, blank ones too, as the scan gives them."""
    spark = lines.sparkSession
    ship_package(spark)
    value = F.col("value")
    key = F.xxhash64(N.FILE, N.BLOCK).alias(N.KEY)
    marked = lines.select("value", key, N.FILE, N.BLOCK, line_map(value, sep).alias("map"), (value == "").alias("blank"))
    folded = marked.select(N.KEY, "map", "blank").mapInArrow(fold, FOLD)
    names = marked.groupBy(N.KEY).agg(F.min(N.FILE).alias(N.FILE), F.min(N.BLOCK).alias(N.BLOCK))
    blocks = materialize(folded.join(names, N.KEY), "quote-blocks")

    # The maps of a file's blocks, composed: the last that sets the state, and the turns since.
    before = Window.partitionBy(N.FILE).orderBy(N.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(N.FILE).orderBy(N.BLOCK)
    sets = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    turned = F.sum(((F.col("from_outside") == 1) & (F.col("from_inside") == 0)).cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    blocks = blocks.withColumn("turned", turned)
    setting = F.when(sets.isNotNull(), F.struct(sets.alias("state"), F.col("turned").alias("turned")))
    blocks = blocks.withColumn("last", F.last(setting, ignorenulls=True).over(before)).withColumn(
        "behind", F.coalesce(F.lag("turned").over(order), F.lit(0))
    )
    state = F.coalesce("last.state", F.lit(0)) + F.col("behind") - F.coalesce("last.turned", F.lit(0))
    blocks = blocks.withColumn("start", F.pmod(state, F.lit(2)).cast("int"))
    blocks = blocks.withColumn("goes_on", F.coalesce(F.lead("start").over(order), F.lit(0)) == 1)
    blocks = blocks.withColumn("n", F.when(F.col("start") == 1, F.col("n_inside")).otherwise(F.col("n_outside")))
    owner = F.last(F.when(F.col("n") > 0, F.struct(N.KEY, "n")), ignorenulls=True)
    blocks = materialize(blocks.withColumn("owner", owner.over(before)).drop("last", "behind", "turned"), "quote-states")

    count, crossing = blocks.agg(F.count(F.lit(1)), F.count_if("goes_on")).first()
    records = cut_records(marked, blocks, count, pieces=False)
    if crossing:
        files = materialize(blocks.filter("goes_on").select(N.FILE).distinct(), "quote-files")
        pieces = cut_records(marked.join(files, N.FILE, "left_semi"), blocks, count, pieces=True)
        owners = blocks.select(F.col(N.KEY).alias("at"), N.BLOCK, F.col(f"owner.{N.KEY}").alias("owner"), F.col("owner.n").alias("last"))
        pieces = pieces.join(owners, F.col(N.KEY) == F.col("at"))
        ahead = F.col(N.POS) < 0
        pieces = pieces.select(
            F.when(ahead, F.col("owner")).otherwise(F.col(N.KEY)).alias(N.KEY),
            F.when(ahead, F.col("last") - 1).otherwise(F.col(N.POS)).alias(N.POS),
            F.struct(N.BLOCK, "text").alias("piece"),
        )
        text = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["text"]), "\n")
        joined = pieces.groupBy(N.KEY, N.POS).agg(text.alias("text"))
        records = records.unionByName(joined)
    layout = blocks.where("n > 0").select(
        "n", F.lit(0).cast("long").alias("first_pos"), (F.col("n") - 1).alias("last_pos"), N.FILE, N.BLOCK
    )
    return records.select(R.split_record(F.col("text"), sep).alias("cells"), N.KEY, N.POS), layout


def cut_records(marked: DataFrame, blocks: DataFrame, count: int, pieces: bool) -> DataFrame:
    """`cut` over lines that know how their block starts."""
    known = blocks.select(F.col(N.KEY).alias("_at"), "start", "goes_on")
    match = F.col(N.KEY) == F.col("_at")
    if count * BLOCK_ROW_BYTES <= BROADCAST_LIMIT_BYTES:
        lines = marked.join(F.broadcast(known), match, "left")
    else:  # a shuffle would lose the order of the scan
        lines = marked.withColumn(N.POS, F.monotonically_increasing_id()).join(known, match, "left")
        lines = lines.repartition(N.KEY).sortWithinPartitions(N.KEY, N.POS)
    changed = F.raise_error(F.lit("input was split differently in the two passes; run again")).cast("int")
    lines = lines.select(
        "value", N.KEY, "map", "blank", F.coalesce("start", changed).alias("start"), "goes_on"
    )
    return lines.mapInArrow(cut(pieces), f"{N.KEY} long, {N.POS} long, text string")
