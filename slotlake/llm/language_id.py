"""Language identification by words, backing off to shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlake.llm import textkit as kit
from slotlake.llm.common import arrow_schema, extended
from slotlake.session import broadcast_if_small, materialize

WORD_LEVEL = 0  # of the model's entries; other levels are n-gram lengths
UNDETERMINED = "und"


@dataclass(frozen=True)
class Profile:
    """sample_docs: about how many labelled texts of a language the model is fitted
    on, chosen by a hash of the text (all, if fewer). words, ngrams: most entries of
    a language that are kept at a level, the most frequent first. longest: n-grams
    go from this length down to 1. smoothing: count of an entry never seen."""

    sample_docs: int = 4000
    words: int = 50_000
    ngrams: int = 50_000
    longest: int = 5
    smoothing: float = 0.5


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point below 2**16 is a letter (or a mark within a word)."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)], bool)


def letters(points: np.ndarray) -> np.ndarray:
    out = _letters()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        out = out.copy()
        out[high] = [chr(c).isalpha() for c in points[high]]
    return out


@dataclass
class Words:
    """The words of a block (maximal runs of letters, lower case)."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray  # text of each word
    hashes: np.ndarray

    @classmethod
    def read(cls, texts: list[str | None]) -> Words:
        points, offsets = kit.code_points([(t or "").lower() for t in texts], 1)
        inside = letters(points)
        starts, ends = kit.runs(inside, offsets)
        return cls(points, starts, ends, kit.owner(starts, offsets), kit.hash_runs(points, starts, ends))

    def ngrams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, position in `words`) of the n-grams of the given words, each with a
        blank before and behind it. A word shorter than n - 2 has none."""
        lengths = self.ends[words] - self.starts[words] + 2 - (n - 1)
        has = np.flatnonzero(lengths > 0)
        lengths = lengths[has]
        if not len(has):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        at = within + np.repeat(self.starts[words[has]] - 1, lengths)
        last = np.repeat(self.ends[words[has]], lengths)
        begin = np.repeat(self.starts[words[has]], lengths)
        out = np.full(len(at), n, np.uint64)
        for k in range(n):
            here = at + k
            value = np.where((here < begin) | (here >= last), 0x20, self.points[here]).astype(np.uint64)
            out = (out + value + np.uint64(1)) * kit._STEP
        return kit.mix(out), np.repeat(has, lengths)


# --- fitting ---------------------------------------------------------------------


def count_entries(profile: Profile):
    """mapInArrow function: counts of words and n-grams of labelled texts."""
    out = pa.schema([("lang", pa.string()), ("level", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kit.blocks(batches, "text"):
            words = Words.read(block["text"].to_pylist())
            langs = block["lang"].to_pylist()
            codes = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
            lang_of = np.array([codes[x] for x in langs], np.int64)[words.of]
            for lang, code in codes.items():
                mine = np.flatnonzero(lang_of == code)
                levels = [(WORD_LEVEL, words.hashes[mine])]
                levels += [(n, words.ngrams(mine, n)[0]) for n in range(1, profile.longest + 1)]
                for level, hashes in levels:
                    keys, counts = np.unique(hashes, return_counts=True)
                    yield kit.record(
                        out, [lang] * len(keys), np.full(len(keys), level, np.int32),
                        keys.view(np.int64), counts,
                    )

    return run


def fit(labelled: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """lang, level, key, log_p of the entries kept, and for each language and level
    the log probability `floor` of an entry that it lacks.

    labelled: text and lang; rows without a label or text are left out. The sample
    is about `sample_docs` texts of each language at any input size.
    """
    rows = labelled.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    scale = 1 << 40
    share = F.least(F.lit(1.0), F.lit(float(profile.sample_docs)) / F.col("docs"))
    limits = sizes.select("lang", (share * scale).cast("long").alias("limit"))
    # A row a language: broadcast while their number is small, so no text is shuffled
    # by language before the sample is drawn.
    limits = materialize(limits, "language-limits")
    limits = broadcast_if_small(limits, limits.count(), 200)
    drawn = rows.join(limits, "lang").filter(F.pmod(F.xxhash64("text"), F.lit(scale)) < F.col("limit"))
    counts = (
        drawn.select("text", "lang")
        .mapInArrow(count_entries(profile), "lang string, level int, key long, n long")
        .groupBy("lang", "level", "key")
        .agg(F.sum("n").alias("n"))
    )
    counts = materialize(counts, "language-counts")
    room = F.when(F.col("level") == WORD_LEVEL, profile.words).otherwise(profile.ngrams)
    rank = F.row_number().over(Window.partitionBy("lang", "level").orderBy(F.col("n").desc(), "key"))
    totals = counts.groupBy("lang", "level").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    mass = F.col("total") + profile.smoothing * (F.col("kinds") + 1)
    return (
        counts.withColumn("rank", rank)
        .filter(F.col("rank") <= F.greatest(F.lit(profile.words), F.lit(profile.ngrams)))
        .filter(F.col("rank") <= room)
        .join(totals, ["lang", "level"])
        .select(
            "lang", "level", "key",
            F.log((F.col("n") + profile.smoothing) / mass).alias("log_p"),
            F.log(F.lit(profile.smoothing) / mass).alias("floor"),
        )
    )


class Model:
    """Entries of each level as sorted keys with a run of (language, gain) each: the
    gain is what a language that has the entry scores above its floor."""

    def __init__(self, table: pa.Table):
        langs = table["lang"].to_numpy(zero_copy_only=False)
        self.langs = sorted(set(langs))  # by code point
        code = {x: k for k, x in enumerate(self.langs)}
        of = np.array([code[x] for x in langs], np.int16)
        level = table["level"].to_numpy()
        keys = table["key"].to_numpy().view(np.uint64)
        log_p, floor = table["log_p"].to_numpy(), table["floor"].to_numpy()
        self.levels = {}
        for n in sorted(set(level.tolist())):
            at = np.flatnonzero(level == n)
            at = at[np.lexsort((of[at], keys[at]))]
            unique, first = np.unique(keys[at], return_index=True)
            floors = np.full(len(self.langs), floor[at].min(initial=0.0))
            floors[of[at]] = floor[at]
            gains = (log_p[at] - floor[at]).astype(np.float32)
            self.levels[n] = (unique, np.append(first, len(at)), of[at], gains, floors)

    def look_up(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether known, index) of keys at a level."""
        known = self.levels.get(level)
        if known is None or not len(known[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known[0], keys), len(known[0]) - 1)
        return known[0][at] == keys, at

    def gains(self, level: int, index: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
        """Sum of log probabilities per (group, language) of known entries."""
        _, first, of, gains, floors = self.levels[level]
        lengths = first[index + 1] - first[index]
        start = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(start, lengths) + np.repeat(first[index], lengths)
        width = len(self.langs)
        cells = np.repeat(group, lengths) * width + of[at]
        out = np.bincount(cells, weights=gains[at], minlength=n * width).reshape(n, width)
        return out + np.bincount(group, minlength=n)[:, None] * floors[None, :]

    def classify(self, texts: list[str | None], longest: int) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        words, n = Words.read(texts), len(texts)
        count = np.bincount(words.of, minlength=n)
        if not self.langs:
            return [UNDETERMINED] * n, np.zeros(n)
        unique, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        known, index = self.look_up(WORD_LEVEL, unique)
        total = np.zeros((n, len(self.langs)))
        hit = known[inverse]
        if hit.any():
            total += self.gains(WORD_LEVEL, index[inverse[hit]], words.of[hit], n)
        # Unseen words, each once: the longest n-grams of which one is known decide.
        open_ = np.flatnonzero(~known)
        value = np.zeros((len(unique), len(self.langs)))
        for length in range(longest, 0, -1):
            if not len(open_):
                break
            keys, of = words.ngrams(first[open_], length)
            seen, at = self.look_up(length, keys)
            if not seen.any():
                continue
            of = of[seen]
            sums = self.gains(length, at[seen], of, len(open_))
            got = np.bincount(of, minlength=len(open_))
            done = got > 0
            value[open_[done]] = sums[done] / got[done, None]
            open_ = open_[~done]
        miss = np.flatnonzero(~hit)
        for lang in range(len(self.langs)):
            total[:, lang] += np.bincount(
                words.of[miss], weights=value[inverse[miss], lang], minlength=n
            )
        mean = total / np.maximum(count, 1)[:, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)  # ties: the first language by code point
        return (
            [self.langs[b] if c else UNDETERMINED for b, c in zip(best, count, strict=True)],
            np.where(count > 0, share[np.arange(n), best], 0.0),
        )


def predict(docs: DataFrame, model: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """doc_id, lang_pred, score of every document, from its text alone.

    Words are runs of letters in lower case, of the whole text. A known word scores
    the log of its frequency in each language; an unseen one the mean over its
    character n-grams (with a blank at both ends) of the greatest length of which
    the model knows any. score is the winner's share of the geometric mean
    probabilities of a word. Text that is null or has no letter is `und` with score
    0, as is every text if the model is empty. Repeated rows are judged alike; other
    columns are not looked at; an empty table gives no rows.

    The model has at most (words + longest * ngrams) entries a language whatever the
    input's size, and is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model(model.toArrow()))
    ddl = extended(docs.select("doc_id").schema, "lang_pred string, score double")
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for block in kit.blocks(batches, "text"):
            langs, scores = known.classify(block["text"].to_pylist(), profile.longest)
            yield kit.record(schema, block["doc_id"], langs, scores)

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by a checksum of doc_id as text."""
    remainder = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4
    return F.coalesce(remainder == 2, F.lit(False))
