"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from slotlake.llm import textkit as kit
from slotlake.llm.common import arrow_schema, extended

# A random value for each byte, from a rule.
GEAR = (kit.mix(np.arange(1, 257, dtype=np.uint64) * kit._STEP) >> np.uint64(32)).astype(np.uint32)

# Texts that are encoded together; a piece is looked up once for all of them.
BLOCK_BYTES = 1 << 19

# A word that stands between pieces that are encoded in one, and how many are.
MARK, JOINED = "^", 64


@dataclass(frozen=True)
class Chunking:
    """A chunk ends where the hash of the last 16 bytes has `bits` zeros: about
    2**bits bytes. A worker keeps at most `chunks` and twice `pieces` results; it has
    no bearing on results."""

    bits: int = 7
    chunks: int = 20_000
    pieces: int = 250_000


@lru_cache(2)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark uses the cores
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def cut_points(data: np.ndarray, bits: int) -> np.ndarray:
    """Positions behind which a chunk ends: a rolling hash of 16 bytes, so equal
    passages are cut alike wherever they stand."""
    rolled = GEAR[data]
    for step in (1, 2, 4, 8):  # doubles the window each time
        older = np.zeros_like(rolled)
        older[step:] = rolled[:-step] << np.uint32(step)
        rolled = rolled + older
    return np.flatnonzero((rolled >> np.uint32(32 - bits)) == 0) + 1


class ChunkCache:
    """Encodings of the chunks met so far, as texts of decimal ids and of tokens.

    Encoding is local to stretches between ASCII white space: the tokenizer drops
    white space, lower-cases and composes code points without looking across a
    blank, and its merges stay within a pre-token, which holds no blank. So a join
    of two chunks is in exact agreement with the whole text where a window around
    it begins and ends at white space. A chunk is encoded from its first blank to
    its last; the window between that and the next chunk is widened on both sides
    to the nearest blanks (over further chunks if they hold none) and encoded as one.
    """

    def __init__(self, path: str, chunking: Chunking):
        self.tokenizer = tokenizer(path)
        self.limits = chunking
        self.chunks: dict[bytes, tuple[str, str]] = {}
        self.pieces: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.reused = 0
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that end at blanks. They are encoded many in one, with the mark
        between them; where its id is met more often than it was set, one by one."""
        out: list[list[int]] = []
        for start in range(0, len(texts), JOINED * 256):
            groups = [texts[k : k + JOINED] for k in range(start, min(start + JOINED * 256, len(texts)), JOINED)]
            joined = self._encoded([f" {MARK} ".join(g) for g in groups])
            for group, ids in zip(groups, joined, strict=True):
                parts = self._parted(ids, len(group)) if len(group) > 1 else [ids]
                out += parts if parts else self._encoded(group)
        return out

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parted(self, ids: list[int], n: int) -> list[list[int]] | None:
        """The ids between n - 1 marks; None if it is not clear where these are."""
        if len(self.mark) != 1 or ids.count(self.mark[0]) != n - 1:
            return None
        parts, at = [], 0
        for _ in range(n - 1):
            end = ids.index(self.mark[0], at)
            parts.append(ids[at:end])
            at = end + 1
        parts.append(ids[at:])
        return parts

    def learn(self, pieces: list[str]) -> None:
        """Encode the pieces not yet known. When full, what was known is kept until the
        next time, and goes over as it is met. A result is one text, ids and tokens with
        a line break between them."""
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > self.limits.pieces:
            self.older, self.pieces = self.pieces, {}
            new = pieces
        if self.older:
            self.pieces.update((p, self.older[p]) for p in new if p in self.older)
            new = [p for p in new if p not in self.pieces]
        ids = self.ids_of(new)
        decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        for piece, own, text in zip(new, ids, decoded, strict=True):
            self.pieces[piece] = " ".join(map(str, own)) + "\n" + (text if own else "")

    def joined(self, words: pa.ListArray) -> list[tuple[str, str]]:
        """Ids and tokens of lists of pieces; a piece may have none."""
        coded = words.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(pieces)
        known = pa.array([self.pieces[p] for p in pieces], pa.string())
        both = pc.split_pattern(known, "\n", max_splits=1).flatten()
        ids, tokens = (both.take(pa.array(np.arange(k, len(both), 2))) for k in (0, 1))
        at = coded.indices.to_numpy()
        full = pc.not_equal(ids, "").to_numpy(zero_copy_only=False)[at]
        at = pa.array(at[full])
        ends = np.concatenate([[0], np.cumsum(full)])[words.offsets.to_numpy()]
        ends = pa.array(ends, pa.int32())
        ids, tokens = (
            pc.binary_join(pa.ListArray.from_arrays(ends, column.take(at)), " ").to_numpy(zero_copy_only=False)
            for column in (ids, tokens)
        )
        return list(zip(ids.tolist(), tokens.tolist(), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[str, str, int]]:
        """(ids, decoded text, number of ids) of each text of a block."""
        raw = data.tobytes()
        blanks = np.flatnonzero(kit.SEPARATOR[data])
        cuts = cut_points(data, self.limits.bits)
        # of each cut: the end of the last blank before it (0: there is none) and the
        # start of the next one
        k = np.searchsorted(blanks, cuts)
        ends = np.concatenate([[0], blanks + 1])[k].tolist()
        nexts = np.append(blanks, len(data))[k].tolist()
        if len(self.chunks) > self.limits.chunks:
            self.chunks.clear()
        plans: list[list[bytes]] = []
        fresh: dict[bytes, None] = {}
        windows: dict[bytes, None] = {}
        of, at_text = np.searchsorted(cuts, offsets).tolist(), offsets.tolist()
        for t in range(len(at_text) - 1):
            at, stop = at_text[t], at_text[t + 1]
            plan: list[bytes] = []  # in turn a chunk and a window
            for c in range(of[t], of[t + 1]):
                low = ends[c]
                if low <= at:
                    continue  # no blank in this chunk: the window goes on
                high = max(low, min(nexts[c], stop))
                plan += raw[at:low], raw[low:high]
                at = high
            plan.append(raw[at:stop])
            for chunk in plan[::2]:
                if chunk in self.chunks or chunk in fresh:
                    self.reused += 1
                else:
                    fresh[chunk] = None
            windows.update(dict.fromkeys(plan[1::2]))
            plans.append(plan)
        texts = pa.array([*fresh, *windows], pa.binary()).cast(pa.string())
        coded = self.joined(pc.ascii_split_whitespace(texts)) if len(texts) else []
        self.chunks.update(zip(fresh, coded))
        windows = dict(zip(windows, coded[len(fresh) :], strict=True))
        rows = []
        for plan in plans:
            parts = [(windows if k % 2 else self.chunks)[p] for k, p in enumerate(plan)]
            parts = [p for p in parts if p[0]]
            ids, text = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])
            rows.append((ids, text, ids.count(" ") + 1 if ids else 0))
        return rows


_CACHES: dict[tuple, ChunkCache] = {}


def cache_of(path: str, chunking: Chunking) -> ChunkCache:
    """This worker's cache; it lives as long as the worker."""
    key = (path, chunking)
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = ChunkCache(path, chunking)
    return _CACHES[key]


def encode_column(docs: DataFrame, path: str, chunking: Chunking = Chunking()) -> DataFrame:
    """The rows and columns of `docs` with n_tokens, ids (array<int>) and decoded.

    Columns of `docs` with these names are replaced.
    """
    kept = docs.drop("n_tokens", "ids", "decoded")
    ddl = extended(kept.schema, "n_tokens long, ids array<int>, decoded string")
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(path, chunking)
        for block in kit.blocks(batches, "text", BLOCK_BYTES):
            rows = cache.encode(*kit.utf8(block["text"]))
            ids = [np.array(r[0].split(), np.int32) if r[2] else np.zeros(0, np.int32) for r in rows]
            sizes = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield kit.record(
                schema, *block.columns, [r[2] for r in rows], pa.ListArray.from_arrays(sizes, flat),
                [r[1] for r in rows],
            )

    return kept.mapInArrow(run, ddl)


def digests(docs: DataFrame, path: str, chunking: Chunking = Chunking()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Ids are those of the whole text without special tokens added; the digests are
    of the decimal ids joined by one blank, and of the decoded text. A null text is
    empty: no ids, the digest of nothing. Texts are never cut; repeated rows give
    repeated results; other columns are not looked at; an empty table gives no rows.

    `path` is the tokenizer's file on every executor. No row leaves its task: each
    worker keeps the encodings of the chunks it has met.
    """
    ddl = extended(
        docs.select("doc_id").schema, "n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cache_of(path, chunking)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for block in kit.blocks(batches, "text", BLOCK_BYTES):
            rows = cache.encode(*kit.utf8(block["text"]))
            yield kit.record(
                schema, block["doc_id"], [r[2] for r in rows], [sha(r[0]) for r in rows],
                [sha(r[1]) for r in rows],
            )

    return docs.select("doc_id", "text").mapInArrow(run, ddl)
