"""Quality rules with a modified Kneser-Ney model of each language.

The model is of 4-grams of code points; only white space is one symbol, however it is
written. Each code point is of one of 64 classes (blank, 26 letters, digit, and 36
hashed ones for all others), and its probability is that of its class after the three
classes before it, times that of the code point among its class after the three code
points before it. Both are modified Kneser-Ney models. The first has at most 64**4
entries a language, the second as many as there are different 4-grams in the texts.

Spark counts the 4-grams of all documents and derives the lower orders, discounts and
probabilities as tables. Texts are scored against sorted arrays of 4-grams that are
broadcast, or, where a language has too many of them, by a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slotlake.llm import textkit as kit
from slotlake.llm.common import arrow_schema, extended
from slotlake.session import materialize

BITS = 6  # of a symbol
ORDER = 4
SYMBOLS = 1 << BITS
POINT_BITS = 21  # of a code point
POINTS = 0x110000
TYPE_BYTES = 20  # of a 4-gram of code points in a task's arrays
MARKS = np.zeros(256, bool)
MARKS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules, of the texts that the models count (at most
    `train_symbol_percent` marks for 100 words), and of the perplexity bands.

    A language's band reaches from the middle of the shortest range that holds half of
    its log perplexities by `below` and `above` times the width of that range (at least
    `least_range` nats), for long texts. The mean
    over few symbols scatters more, so for a text of n symbols the band is wider by
    sqrt(1 + short / n)."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    train_symbol_percent: int = 10
    below: float = 6.0
    above: float = 8.0
    short: int = 400
    least_range: float = 0.02
    model_bytes: int = 64 << 20  # of the models that are broadcast at once
    block_bytes: int = 4 << 20  # of the texts that look up a model together, where none is broadcast
    bin_width: float = 0.001  # nats, of binned perplexities


# --- one block of texts ----------------------------------------------------------


def base_counts(texts: pa.Array, rules: Rules, lines: bool = True) -> dict[str, np.ndarray]:
    """Per text: n_words, n_repeat_words, n_symbols, and unless `lines` is off
    word_chars and n_dup_lines."""
    data, offsets = kit.utf8(texts)
    n = len(texts)
    inside = ~kit.SEPARATOR[data]
    starts, ends = kit.runs(inside, offsets)
    of = kit.owner(starts, offsets)
    out = {"n_words": kit.per_text(None, of, n)}

    windows = kit.window_hashes(kit.hash_runs(data, starts, ends), rules.window)
    last = len(windows)
    whole = of[:last] == of[rules.window - 1 :] if last else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    keys = kit.mix(windows[at] ^ kit.mix(of[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    repeated = np.zeros(len(at), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edges = np.zeros(len(of) + 1, np.int64)
    edges[at[repeated]] += 1
    np.add.at(edges, at[repeated] + rules.window, -1)
    covered = np.cumsum(edges)[:-1] > 0
    out["n_repeat_words"] = kit.per_text(None, of[covered], n)

    def counted(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    out["n_symbols"] = counted(MARKS[data])
    if not lines:
        return out
    out["word_chars"] = counted(inside & ((data & 0xC0) != 0x80))
    begins, stops = kit.runs(data != 0x0A, offsets)
    is_start = np.zeros(len(data) + 1, np.int64)
    is_start[starts + 1] = 1
    words_before = np.cumsum(is_start)
    worded = words_before[stops] > words_before[begins]
    begins, stops = begins[worded], stops[worded]
    line_of = kit.owner(begins, offsets)
    lines_ = kit.mix(kit.hash_runs(data, begins, stops) ^ kit.mix(line_of.astype(np.uint64)))
    _, first = np.unique(lines_, return_index=True)
    out["n_dup_lines"] = kit.per_text(None, line_of, n) - kit.per_text(None, line_of[first], n)
    return out


def failed(counts: dict[str, np.ndarray], rules: Rules) -> np.ndarray:
    words, repeats = counts["n_words"], counts["n_repeat_words"]
    return (words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * words)


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    """Symbol of each code point below 2**16; 0 for blanks and text borders."""
    table = np.zeros(1 << 16, np.int32)
    for cp in range(1, 1 << 16):
        if 0xD800 <= cp < 0xE000:
            table[cp] = 28 + cp % 36
            continue
        c = chr(cp).lower()[0]
        if c.isspace():
            table[cp] = 0
        elif "a" <= c <= "z":
            table[cp] = ord(c) - 96
        elif c.isdigit():
            table[cp] = 27
        else:
            table[cp] = 28 + (ord(c) * 2654435761 >> 12) % 36
    return table


def symbols_of(points: np.ndarray) -> np.ndarray:
    """Symbol of each code point."""
    symbols = _symbol_table()[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        symbols[high] = 28 + points[high].astype(np.int64) % 36
    return symbols


@lru_cache(1)
def members() -> list[int]:
    """Number of code points of each symbol; white space is one."""
    points = np.arange(POINTS)
    points = points[(points < 0xD800) | (points >= 0xE000)]
    return [1, *np.bincount(symbols_of(points), minlength=SYMBOLS)[1:].tolist()]


def spelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, symbols, index of the text, whether it is the border before a text)
    of a block. Blanks and borders are 0; blanks in a row count once."""
    points, offsets = kit.code_points([t or "" for t in texts.to_pylist()], 1)
    symbols = symbols_of(points)
    kept = symbols != 0
    kept[1:] |= symbols[:-1] != 0
    kept[offsets[:-1]] = True  # the border before each text
    at = np.flatnonzero(kept[: offsets[-1]])
    symbols = symbols[at]
    of = kit.owner(at, offsets)
    border = np.zeros(len(at), bool)
    if len(at):
        border[0] = True
        border[1:] = of[1:] != of[:-1]
    return np.where(symbols == 0, 0, points[at]), symbols, of, border


def packed(values: np.ndarray, of: np.ndarray, bits: int) -> np.ndarray:
    """Each value in the low bits and the three before it in its text above them."""
    key = values.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(values)
        before[back:] = np.where(of[back:] == of[:-back], values[:-back], 0)
        key |= before << values.dtype.type(bits * back)
    return key


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram keys, index of the text) of a block; blanks in a row count once. A key
    holds the symbol in its low bits and the three before it above them."""
    _, symbols, of, border = spelled(texts)
    return packed(symbols, of, BITS)[~border], of[~border]


class Types:
    """The 4-grams of code points of a block: `keys`, and the index `of` the text. A key
    is of the numbers that the block's pairs of code points have in it."""

    def __init__(self, texts: pa.Array):
        points, _, of, border = spelled(texts)
        pair = points.astype(np.int64)
        pair[1:] |= np.where(of[1:] == of[:-1], pair[:-1] & (1 << POINT_BITS) - 1, 0) << POINT_BITS
        found = pa.array(pair).dictionary_encode()  # the first is the border's, of two blanks
        self.pairs, at = found.dictionary.to_numpy(), found.indices.to_numpy().astype(np.int64)
        before = np.zeros_like(at)
        before[2:] = np.where(of[2:] == of[:-2], at[:-2], 0)
        self.keys, self.of = (before << 32 | at)[~border], of[~border]

    def different(self, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, code point, symbol key, index) of the 4-grams at `mine`: the first
        three of the different ones, and for each at `mine` which of them it is. A
        context is of the three code points before."""
        found = pa.array(self.keys[mine]).dictionary_encode()
        keys = found.dictionary.to_numpy()
        first, second = self.pairs[keys >> 32], self.pairs[keys & 0xFFFFFFFF]
        mask = (1 << POINT_BITS) - 1
        key = np.zeros(len(keys), np.int32)
        for points in (first >> POINT_BITS, first & mask, second >> POINT_BITS, second & mask):
            key = key << BITS | symbols_of(points)
        context = first << POINT_BITS | second >> POINT_BITS
        return context, (second & mask).astype(np.int32), key, found.indices.to_numpy()


def by_lang(block: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """(languages, number of its language for each row); a null is the empty name."""
    found = block["lang"].fill_null("").dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy()


TYPE = ("context", "point", "key")
TYPES = pa.schema(
    [("context", pa.int64()), ("point", pa.int32()), ("key", pa.int32()), ("n", pa.int64()), ("texts", pa.int64())]
)


def count_grams(rules: Rules):
    """mapInArrow function: the 4-grams of all documents, how often they come in those
    that pass the base rules and have few marks, and in how many of these, summed in
    parts of bounded size."""
    out = pa.schema([("lang", pa.string()), *TYPES])

    def merged(parts: list[pa.Table]) -> pa.Table:
        sums = [("n", "sum"), ("texts", "sum")]
        table = pa.concat_tables(parts).group_by(TYPE, use_threads=False).aggregate(sums)
        return table.select([*TYPE, "n_sum", "texts_sum"]).rename_columns(TYPES.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        pending = 0

        def flush():
            for lang, parts in held.items():
                for batch in merged(parts).to_batches():
                    yield kit.record(out, [lang] * batch.num_rows, *[batch[c] for c in TYPES.names])

        for block in kit.blocks(batches, "text"):
            counts = base_counts(block["text"], rules, lines=False)
            marks = 100 * counts["n_symbols"] > rules.train_symbol_percent * counts["n_words"]
            fine = ~failed(counts, rules) & ~marks
            langs, lang_of = by_lang(block)
            found = Types(block["text"])
            for k, lang in enumerate(langs):
                mine = np.flatnonzero((lang_of == k)[found.of])
                context, point, key, index = found.different(mine)
                of = found.of[mine]
                n = np.bincount(index, weights=fine[of], minlength=len(key)).astype(np.int64)
                once = pc.unique(pa.array((index * np.int64(len(fine)) + of)[fine[of]])).to_numpy()
                texts = np.bincount(once // len(fine), minlength=len(key))
                held.setdefault(lang, []).append(pa.table([context, point, key, n, texts], schema=TYPES))
                pending += len(n)
            if pending > 600_000:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                pending = sum(p[0].num_rows for p in held.values())
                if pending > 400_000:
                    yield from flush()
                    held, pending = {}, 0
        yield from flush()

    return run


# --- the model as tables -----------------------------------------------------------


def discounted(rows: DataFrame) -> DataFrame:
    """rows (lang, order, n and others) with `off`, what modified Kneser-Ney takes off a
    count n; nothing off 0."""

    def having(k: int) -> Column:
        return F.count_if(F.col("n") == k).cast("double")

    counted = rows.groupBy("lang", "order").agg(*[having(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)

    def discount(k: int) -> Column:
        raw = F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        usual = F.lit(0.5 * k)  # where counts of counts are missing
        return F.when(enough, F.greatest(F.lit(0.05), F.least(raw, F.lit(k - 0.05)))).otherwise(usual)

    discounts = counted.select("lang", "order", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])
    off = F.when(F.col("n") == 0, F.lit(0.0))
    off = off.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return rows.join(discounts, ["lang", "order"]).withColumn("off", off)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, order, key, p, rest: probability of each n-gram of orders 1 to 4, and of
    each context the weight it leaves to the lower order.

    counts: lang, key, n of 4-grams. Lower orders count the different symbols before
    an n-gram. Discounts for counts of 1, 2 and more come from the counts of counts
    of a language and order.
    """
    tables = {ORDER: counts.select("lang", "key", "n")}
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND((1 << (BITS * order)) - 1)
        tables[order] = (
            tables[order + 1].groupBy("lang", suffix.alias("key")).agg(F.count(F.lit(1)).alias("n"))
        )
    rows = None
    for order, table in tables.items():
        tagged = table.select("lang", F.lit(order).alias("order"), "key", "n")
        rows = tagged if rows is None else rows.unionByName(tagged)
    rows = materialize(rows, "quality-counts")

    context = Window.partitionBy("lang", "order", "context")
    rows = (
        discounted(rows)
        .withColumn("context", F.shiftright("key", BITS))
        .withColumn("total", F.sum("n").over(context))
        .withColumn("rest", F.sum("off").over(context) / F.col("total"))
        .withColumn("own", (F.col("n") - F.col("off")) / F.col("total"))
        .select("lang", "order", "key", "own", "rest")
    )
    rows = materialize(rows, "quality-orders")
    lower = None
    out = None
    for order in range(1, ORDER + 1):
        table = rows.filter(F.col("order") == order)
        if lower is None:
            table = table.withColumn("p", F.col("own") + F.col("rest") / SYMBOLS)
        else:
            shorter = lower.select("lang", F.col("key").alias("suffix"), F.col("p").alias("q"))
            mask = (1 << (BITS * (order - 1))) - 1
            table = (
                table.withColumn("suffix", F.col("key").bitwiseAND(mask))
                .join(shorter, ["lang", "suffix"])
                .withColumn("p", F.col("own") + F.col("rest") * F.col("q"))
            )
        lower = table.select("lang", "order", "key", "p", "rest")
        out = lower if out is None else out.unionByName(lower)
    return out


def spelling(counts: DataFrame) -> DataFrame:
    """lang, context, point, key, p of each 4-gram of counts: the probability of the code
    point among those of its symbol, after the three before it.

    counts: lang, context, point, key, texts of 4-grams of code points. A 4-gram counts
    once for each text that has it but one: a text is judged by what others have. With
    its own counts in, any text with 4-grams that no other has would foretell itself.
    The model is as in kneser_ney(), with the symbol as a part of each context; below
    order 1 all code points of a symbol are alike. White space is always its symbol.
    """
    symbol = F.col("key").bitwiseAND(SYMBOLS - 1)
    others = F.greatest(F.col("texts") - 1, F.lit(0)).alias("n")
    tables = {ORDER: counts.filter(symbol != 0).select("lang", "context", "point", symbol.alias("symbol"), others)}

    def shorter(order: int) -> Column:
        """Context of an n-gram of that order from that of a longer one."""
        return F.col("context").bitwiseAND(F.lit((1 << (POINT_BITS * (order - 1))) - 1).cast("long"))

    for order in range(ORDER - 1, 0, -1):
        tables[order] = (
            tables[order + 1]
            .groupBy("lang", shorter(order).alias("context"), "point", "symbol")
            .agg(F.count_if(F.col("n") > 0).alias("n"))
        )
    rows = reduce(DataFrame.unionByName, (t.withColumn("order", F.lit(k)) for k, t in tables.items()))
    rows = materialize(rows, "quality-points")
    context = Window.partitionBy("lang", "order", "context", "symbol")
    known = F.col("total") > 0
    rows = (
        discounted(rows)
        .withColumn("total", F.sum("n").over(context))
        .withColumn("rest", F.when(known, F.sum("off").over(context) / F.col("total")).otherwise(1.0))
        .withColumn("own", F.when(known, (F.col("n") - F.col("off")) / F.col("total")).otherwise(0.0))
        .select("lang", "order", "context", "point", "symbol", "own", "rest")
    )
    rows = materialize(rows, "quality-point-orders")
    alike = F.element_at(F.array(*[F.lit(float(n)) for n in members()]), F.col("symbol") + 1)
    lower = rows.filter(F.col("order") == 1).withColumn("p", F.col("own") + F.col("rest") / alike)
    for order in range(2, ORDER + 1):
        below = lower.select("lang", F.col("context").alias("suffix"), "point", F.col("p").alias("q"))
        lower = (
            rows.filter(F.col("order") == order)
            .withColumn("suffix", shorter(order - 1))
            .join(below, ["lang", "suffix", "point"])
            .withColumn("p", F.col("own") + F.col("rest") * F.col("q"))
        )
    fields = ["lang", "context", "point"]
    points = lower.select(*fields, "p").join(counts.select(*fields, "key"), fields)
    blanks = counts.filter(symbol == 0).select(*fields, F.lit(1.0).alias("p"), "key")
    return points.unionByName(blanks)


class Model:
    """One language's probabilities as sorted arrays.

    `keys` holds the 4-grams that occur, sorted, `logs` their log probabilities.
    Orders up to 3 have at most 64**3 n-grams and are filled in for all of them, so
    a 4-gram that never occurred costs one look in each dense array.
    """

    def __init__(self, orders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        lower = np.full(SYMBOLS, 1.0 / SYMBOLS)
        for order in range(1, ORDER):
            keys, p, rest = orders.get(order, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
            left = np.ones(SYMBOLS ** (order - 1))
            left[keys >> BITS] = rest
            at = np.arange(SYMBOLS**order)
            base = lower[at & (len(lower) - 1)] if order > 1 else lower
            full = left[at >> BITS] * base
            full[keys] = p
            lower = full
        keys, p, rest = orders.get(ORDER, (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
        sort = np.argsort(keys)
        self.keys = keys[sort].astype(np.int32)
        self.logs = np.log(p[sort]).astype(np.float32)
        left = np.ones(SYMBOLS ** (ORDER - 1))
        left[keys >> BITS] = rest
        self.left = np.log(left).astype(np.float32)
        self.lower = np.log(lower).astype(np.float32)

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        out = self.left[keys >> BITS] + self.lower[keys & (len(self.lower) - 1)]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out = np.where(self.keys[at] == keys, self.logs[at], out)
        return out


def load_models(rows: pa.Table) -> dict[str, Model]:
    """Models from the rows of kneser_ney()."""
    langs = rows["lang"].to_numpy(zero_copy_only=False)
    columns = {c: rows[c].to_numpy() for c in ("order", "key", "p", "rest")}
    out = {}
    for lang in dict.fromkeys(langs):
        mine = langs == lang
        orders = {}
        for order in range(1, ORDER + 1):
            at = np.flatnonzero(mine & (columns["order"] == order))
            orders[order] = tuple(columns[c][at] for c in ("key", "p", "rest"))
        out[lang] = Model(orders)
    return out


class Known:
    """Log probabilities of one language's 4-grams of code points as sorted arrays."""

    def __init__(self, context: np.ndarray, point: np.ndarray, logs: np.ndarray):
        self.contexts, at = np.unique(context, return_inverse=True)
        keys, first = np.unique(at << POINT_BITS | point, return_index=True)
        self.keys, self.logs = keys, logs[first].astype(np.float32)

    def log_p(self, context: np.ndarray, point: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        keys = at << POINT_BITS | point
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        if (self.contexts[at] != context).any() or (self.keys[place] != keys).any():
            raise ValueError("a text differs from those that the model was made from")
        return self.logs[place]


def load_known(rows: pa.Table) -> dict[str, Known]:
    """By language from rows of lang, context, point, log_p."""
    found = rows["lang"].combine_chunks().dictionary_encode()
    lang_of = found.indices.to_numpy()
    columns = [rows[c].to_numpy() for c in ("context", "point", "log_p")]
    return {
        lang: Known(*[c[lang_of == k] for c in columns]) for k, lang in enumerate(found.dictionary.to_pylist())
    }


def both_models(models):
    """mapInArrow function: `log_p` of 4-grams of code points from their `p` and that of
    their symbols. Those of a language without a model are dropped."""
    out = arrow_schema(KNOWN)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lang_of = by_lang(batch)
            for k, lang in enumerate(langs):
                if lang not in models.value:
                    continue
                mine = batch.filter(pa.array(lang_of == k))
                logs = models.value[lang].log_p(mine["key"].to_numpy()) + np.log(mine["p"].to_numpy())
                yield kit.record(out, mine["lang"], mine["context"], mine["point"], logs)

    return run


KNOWN = "lang string, context long, point int, log_p double"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, length long, log_perplexity double"


def keep(models, limits: dict[str, tuple[float, float]], rules: Rules):
    """mapInArrow function: the rows whose text passes the base rules and lies in the
    band of its language, unchanged."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = models.value
        for block in kit.blocks(batches, "text"):
            length, perplexity = perplexities(block, known)
            langs = block["lang"].fill_null("").to_pylist()
            middle, spread = (
                np.array([limits.get(x, (np.nan, np.nan))[k] for x in langs]) for k in (0, 1)
            )
            width = spread * np.sqrt(1 + rules.short / np.maximum(length, 1))
            inside = (perplexity >= middle - rules.below * width) & (
                perplexity <= middle + rules.above * width
            )
            fine = inside & ~failed(base_counts(block["text"], rules, lines=False), rules)
            yield block.filter(pa.array(fine))

    return run


def perplexities(block: pa.RecordBatch, known: dict[str, Known]) -> tuple[np.ndarray, np.ndarray]:
    """(number of symbols, log perplexity) of each text; not a number for a text
    without symbols or of a language without a model."""
    n = block.num_rows
    langs, lang_of = by_lang(block)
    found = Types(block["text"])
    total, length = np.zeros(n), kit.per_text(None, found.of, n)
    for k, lang in enumerate(langs):
        mine = np.flatnonzero((lang_of == k)[found.of])
        if lang not in known or not len(mine):
            continue
        context, point, _, index = found.different(mine)
        total += np.bincount(found.of[mine], weights=known[lang].log_p(context, point)[index], minlength=n)
    has = np.array([x in known for x in langs], bool)[lang_of] & (length > 0)
    return length, np.where(has, -total / np.maximum(length, 1), np.nan)


def measured(block: pa.RecordBatch, known: dict[str, Known], rules: Rules) -> list:
    """The columns MEASURES of a block. A text without symbols, or of a language without
    a model, has no perplexity."""
    counts = base_counts(block["text"], rules)
    length, perplexity = perplexities(block, known)
    return [
        *[counts[c] for c in COUNTS], failed(counts, rules), length,
        pa.array(perplexity, mask=np.isnan(perplexity)),
    ]


def score(models, rules: Rules, schema: pa.Schema):
    """mapInArrow function: doc_id, lang, base counts and log perplexity of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kit.blocks(batches, "text"):
            yield kit.record(schema, block["doc_id"], block["lang"], *measured(block, models.value, rules))

    return run


# --- languages whose model no task can hold ------------------------------------------


def in_blocks(rules: Rules, schema: pa.Schema):
    """mapInArrow function: the rows with the number of a block as last column, which
    holds the texts of `block_bytes` of one task or a single longer one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, room = TaskContext.get().partitionId() << 32, rules.block_bytes
        for block in kit.blocks(batches, "text", min(kit.BLOCK_BYTES, rules.block_bytes)):
            size = kit.utf8(block["text"])[1][-1]
            if size > room:
                number, room = number + 1, rules.block_bytes
            room -= size
            yield kit.record(schema, *block.columns, np.full(block.num_rows, number))

    return run


BLOCK_TYPES = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("context", pa.int64()), ("point", pa.int32())])


def block_types(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: block, lang, context, point of the different 4-grams of the
    texts of a block; those that come in several batches may be repeated."""
    held: dict[tuple[int, str], pa.Table] = {}
    for batch in batches:
        for slice_ in kit.blocks([batch], "text"):
            numbers = slice_["block"].to_numpy()
            langs, lang_of = by_lang(slice_)
            for key in [x for x in held if x[0] not in numbers]:
                done = held.pop(key)
                for out in done.to_batches():
                    yield kit.record(BLOCK_TYPES, [key[0]] * out.num_rows, [key[1]] * out.num_rows, *out.columns)
            found = Types(slice_["text"])
            for number in np.unique(numbers).tolist():
                for k, lang in enumerate(langs):
                    mine = np.flatnonzero(((lang_of == k) & (numbers == number))[found.of])
                    context, point, _, _ = found.different(mine)
                    new = pa.table({"context": context, "point": point})
                    both = [new, *([held[number, lang]] if (number, lang) in held else [])]
                    held[number, lang] = (
                        pa.concat_tables(both).group_by(["context", "point"], use_threads=False).aggregate([])
                    )
    for key, done in held.items():
        for out in done.to_batches():
            yield kit.record(BLOCK_TYPES, [key[0]] * out.num_rows, [key[1]] * out.num_rows, *out.columns)


def score_block(rules: Rules, schema: pa.Schema):
    """Cogroup function: rows of a block with their measures, from its 4-grams' log_p."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        known = load_known(found)
        batches = rows.combine_chunks().to_batches()
        return pa.Table.from_batches(
            [
                kit.record(schema, *block.columns[:-1], *measured(block, known, rules))
                for block in kit.blocks(batches, "text")
            ],
            schema,
        )

    return run


def looked_up(docs: DataFrame, known: DataFrame, rules: Rules) -> tuple[DataFrame, dict[str, str]]:
    """docs with MEASURES as further columns, whose names are returned, by a join of the
    different 4-grams of blocks of texts with the rows of fit(). No task holds a model."""
    block, *names = [f.name for f in arrow_schema(f"block long, {MEASURES}")]
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    numbered = extended(docs.schema, f"{free(block)} long")
    stored = materialize(docs.mapInArrow(in_blocks(rules, arrow_schema(numbered)), numbered), "quality-blocks")
    number = F.col(free(block))
    wanted = stored.select(number.alias("block"), "lang", "text").mapInArrow(
        block_types, "block long, lang string, context long, point int"
    )
    found = wanted.join(known, ["lang", "context", "point"])
    fields = [f"{free(f.name)} {f.dataType.simpleString()}" for f in StructType.fromDDL(MEASURES)]
    schema = extended(docs.schema, ", ".join(fields))
    rows = stored.groupBy(number).cogroup(found.groupBy("block"))
    return rows.applyInArrow(score_block(rules, arrow_schema(schema)), schema), {x: free(x) for x in names}


def language_groups(sizes: list[tuple[str, int]], limit: int) -> list[list[str]]:
    """Languages in groups whose models fit `limit` bytes together (or one language)."""
    groups: list[list[str]] = []
    room = 0
    for lang, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if not groups or size > room:
            groups.append([])
            room = limit
        groups[-1].append(lang)
        room -= size
    return groups


def by_model(
    rows: DataFrame, model: DataFrame, sizes: list[tuple[str, int]], load, rules: Rules
) -> Iterator[tuple[DataFrame, object]]:
    """(rows, broadcast models) of groups of languages whose models are broadcast
    together; every row is in one group."""
    spark = rows.sparkSession
    groups = language_groups(sizes, rules.model_bytes) or [[]]
    lang = F.coalesce("lang", F.lit(""))
    # The last group also takes what has no model.
    others = [x for g in groups[:-1] for x in g]
    for k, group in enumerate(groups):
        of_group = model.filter(F.col("lang").isin(group)) if group else model.limit(0)
        models = spark.sparkContext.broadcast(load(of_group.toArrow()))
        if len(groups) == 1:
            yield rows, models
        else:
            yield rows.filter(lang.isin(group) if k < len(groups) - 1 else ~lang.isin(others)), models


def bytes_by_lang(model: DataFrame, row: int, fixed: int = 0) -> list[tuple[str, int]]:
    """(language, bytes of its model) of `row` bytes an entry."""
    sizes = model.groupBy("lang").agg((F.count(F.lit(1)) * row + fixed).alias("size"))
    return [(r.lang, r.size) for r in sizes.collect()]


def fit(docs: DataFrame, rules: Rules) -> DataFrame:
    """lang, context, point, log_p: the log probability of every 4-gram of code points in
    the documents under the model of its language, from all documents."""
    counts = (
        docs.select("text", "lang")
        .mapInArrow(count_grams(rules), "lang string, context long, point int, key int, n long, texts long")
        .groupBy("lang", "context", "point", "key")
        .agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    )
    counts = materialize(counts, "quality-grams")
    of_symbols = counts.filter("n > 0").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    model = materialize(kneser_ney(of_symbols), "quality-model")
    # 12 bytes an entry, and the dense arrays of a model
    sizes = bytes_by_lang(model, 12, 8 * SYMBOLS**3)
    points = materialize(spelling(counts), "quality-spelling")
    known = union(
        part.mapInArrow(both_models(models), KNOWN)
        for part, models in by_model(points, model, sizes, load_models, rules)
    )
    return materialize(known, "quality-known")


def apart(
    docs: DataFrame, known: DataFrame, rules: Rules
) -> tuple[list[tuple[DataFrame, object]], DataFrame | None]:
    """(documents with their broadcast models, documents of the languages whose model is
    beyond `model_bytes`)."""
    sizes = bytes_by_lang(known, TYPE_BYTES)
    large = [lang for lang, size in sizes if size > rules.model_bytes]
    if not large:
        return list(by_model(docs, known, sizes, load_known, rules)), None
    lang = F.coalesce("lang", F.lit(""))
    small = [(x, size) for x, size in sizes if x not in large]
    return list(by_model(docs.filter(~lang.isin(large)), known, small, load_known, rules)), docs.filter(lang.isin(large))


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scored(docs: DataFrame, parts: Iterable[tuple[DataFrame, object]], rules: Rules) -> DataFrame:
    """doc_id, lang, base counts and log perplexity of every document of the parts."""
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, {MEASURES}"
    schema = arrow_schema(ddl)
    return union(
        part.select("doc_id", "text", "lang").mapInArrow(score(models, rules, schema), ddl) for part, models in parts
    )


def bands(rows: DataFrame, rules: Rules) -> DataFrame:
    """band_lang, middle, spread of the log perplexity of each language, from all its
    documents that pass the base rules: of the shortest range that holds half of them.
    Values are cut to bins."""
    binned = (
        rows.filter(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
        .select(
            F.coalesce("lang", F.lit("")).alias("lang"),
            F.floor(F.col("log_perplexity") / rules.bin_width).alias("bin"),
        )
        .groupBy("lang", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ddl = "band_lang string, middle double, spread double"
    return binned.groupBy("lang").applyInArrow(shortest_half(rules, arrow_schema(ddl)), ddl)


def shortest_half(rules: Rules, schema: pa.Schema):
    """Group function: middle and width of the shortest range of bins that holds half
    of a language's documents. Of equally short ones the mean is taken.

    Documents that are less than half of all can not move it away from the others,
    on whichever side they lie: a half must still reach over a part of the others."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["bin"].to_numpy())
        bins, n = table["bin"].to_numpy()[order], table["n"].to_numpy()[order]
        upto = np.cumsum(n)
        last = np.searchsorted(upto, upto - n + (upto[-1] + 1) // 2)
        first = np.flatnonzero(last < len(bins))
        low, high = bins[first], bins[last[first]] + 1
        least = (high - low).min()
        middle = (low + high)[high - low == least].mean() / 2 * rules.bin_width
        spread = max(least * rules.bin_width, rules.least_range)
        return pa.table([[table["lang"][0].as_py()], [middle], [spread]], schema=schema)

    return run


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, log_perplexity, low, high, kept of every document.

    Words are runs of anything but ASCII white space. A document is kept if it
    passes the base rules and its log perplexity (nats a symbol) lies in the band of
    its language. A null or empty text has no words and fails; a null language is
    that of the empty name; repeated rows are judged alike; other columns are not
    looked at. An empty table gives no rows. The models count all documents that
    pass the base rules and have few marks; the bands those that pass the base rules.
    """
    docs = docs.select("doc_id", "text", "lang")
    known = fit(docs, rules)
    parts, large = apart(docs, known, rules)
    rows = scored(docs, parts, rules)
    if large is not None:
        joined, _ = looked_up(large, known, rules)
        rows = rows.unionByName(joined.drop("text"))
    rows = materialize(rows, "quality-scored")
    return within(rows, bands(rows, rules), rules).drop("band_lang", "middle", "spread", "length")


def within(rows: DataFrame, limits: DataFrame, rules: Rules) -> DataFrame:
    """rows with low, high and kept, from the rows of bands()."""
    width = F.col("spread") * F.sqrt(1 + F.lit(float(rules.short)) / F.greatest("length", F.lit(1)))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return (
        rows.join(limits, F.coalesce("lang", F.lit("")) == F.col("band_lang"), "left")
        .withColumn("low", F.col("middle") - rules.below * width)
        .withColumn("high", F.col("middle") + rules.above * width)
        .withColumn("kept", ~F.col("base_failed") & inside)
    )


def kept_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows that judge() keeps, with all columns of `docs`.

    Each row is judged where it is read, so rows that repeat a doc_id need no telling
    apart and no text is shuffled, but for languages whose model is beyond `model_bytes`.
    The bands (two numbers a language) go along with the models.
    """
    known = fit(docs, rules)
    parts, large = apart(docs, known, rules)
    rows = scored(docs, parts, rules).select("lang", "base_failed", "length", "log_perplexity")
    if large is not None:
        joined, names = looked_up(large, known, rules)
        joined = materialize(joined, "quality-joined")
        rows = rows.unionByName(
            joined.select("lang", *[F.col(names[c]).alias(c) for c in ("base_failed", "length", "log_perplexity")])
        )
    rows = materialize(rows, "quality-scored")
    limits = {r.band_lang: (r.middle, r.spread) for r in bands(rows, rules).collect()}
    kept = [part.mapInArrow(keep(models, limits, rules), docs.schema) for part, models in parts]
    if large is not None:
        ddl = "band_lang string, middle double, spread double"
        of_lang = docs.sparkSession.createDataFrame([(x, *y) for x, y in limits.items()], ddl)
        plain = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        judged = joined.select(plain, "lang", *[F.col(names[c]).alias(c) for c in ("base_failed", "length", "log_perplexity")])
        kept.append(within(judged, F.broadcast(of_lang), rules).filter("kept").select("row.*"))
    return union(kept)
