"""Texts of Arrow batches as numpy arrays: words, hashes and runs, many rows at a time.

Everything here is a pure function of one bounded block of rows; Spark does the
partitioning. Blocks hold whole texts: a text longer than the block size makes a
block of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

# The word separators of the contracts: [\x20\x09-\x0D].
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)


def blocks(
    batches: Iterable[pa.RecordBatch], column: str, size: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts stay below `size` bytes (or are one row)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(_lengths(batch.column(at)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(texts: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(texts.buffers()[1], np.int32) if len(texts) else np.zeros(1, np.int32)
    return np.diff(offsets[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, their offsets); a null text is empty."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def code_points(texts: list[str], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets of the texts): `gap` zeros stand before each text and at the end."""
    sep = "\0" * gap
    joined = sep + sep.join(texts) + sep
    values = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + gap for t in texts])
    return values, np.concatenate([[0], ends]).astype(np.int64)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the maximal runs of True that stay within a text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[offsets < len(inside)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text that each position lies in."""
    return np.searchsorted(offsets, positions, "right") - 1


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        factors = np.full(max(n, 1024), _STEP, np.uint64)
        factors[0] = 1
        _POWERS = np.cumprod(factors, dtype=np.uint64)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values; runs are ascending and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    taken = values[within + np.repeat(starts, lengths)].astype(np.uint64)
    taken = (mix(taken + _STEP)) * _powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(taken, first) ^ lengths.astype(np.uint64))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` consecutive values (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + hashes[k : k + n]) * _STEP
    return mix(out)


def per_text(weights: np.ndarray | None, texts: np.ndarray, n: int) -> np.ndarray:
    """Sum (or count) per text as integers."""
    if weights is None:
        return np.bincount(texts, minlength=n).astype(np.int64)
    return np.bincount(texts, weights=weights, minlength=n).astype(np.int64)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of the given schema from arrays or lists."""
    arrays = [
        c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
