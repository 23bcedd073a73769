"""Spelling variant grouping: a trie over letter-group counts, searched with a budget of
one surplus and one deficit."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlake.llm import textkit as kit
from slotlake.llm.common import arrow_schema
from slotlake.session import materialize

LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
# Bytes of texts that are counted at a time.
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Trie:
    """Words have `least_length` code points and `least_count` occurrences or more, and
    take a form that is `ratio` times as frequent. A letter belongs to the group of its
    code point modulo `groups`. A subtree of at most `words` words is searched by one
    task for about `queries` visiting words. Nodes of at most `bucket` words are not
    divided further."""

    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    groups: int = 16
    words: int = 16384
    queries: int = 16384
    bucket: int = 64


# --- words ------------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc32_of_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run behind a text whose crc32 is `before`; a byte of all runs at a
    time, the few long runs one after another."""
    table, lengths = _crc_table(), ends - starts
    state = before ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-lengths, kind="stable")
    order = order[np.searchsorted(-lengths[order], -48) :]
    falling = -lengths[order]
    for k in range(48):
        order = order[: np.searchsorted(falling, -k)]
        if not len(order):
            break
        now = state[order]
        state[order] = table[(now ^ data[starts[order] + k]) & 0xFF] ^ (now >> np.uint32(8))
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(lengths > 48):
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    return out


def count_runs(trie: Trie):
    """mapInArrow function: word, n of the words of each block of texts."""
    schema = arrow_schema("word string, n long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kit.blocks(batches, "text", BLOCK_BYTES):
            data, offsets = kit.utf8(block["text"])
            lead = data == 0xC3  # of the letters from U+00C0 to U+00FF
            inside = (((data | 32) >= 97) & ((data | 32) <= 122)) | lead
            inside[1:] |= lead[:-1]
            starts, ends = kit.runs(inside, offsets)
            if not len(starts):
                continue
            data = np.where((data >= 65) & (data <= 90), data | 32, data)
            pairs = np.concatenate([[0], np.cumsum(lead)])
            length = ends - starts - (pairs[ends] - pairs[starts])
            docs = [zlib.crc32(f"{d}:".encode()) for d in block["doc"].to_pylist()]
            h = crc32_of_runs(data, starts, ends, np.array(docs, np.uint32)[kit.owner(starts, offsets)])
            whole = data.tobytes()
            found: Counter[str] = Counter()
            for k in np.flatnonzero(h % 97 == 0):
                word = whole[starts[k] : ends[k]].decode()
                at = int(h[k]) % len(word)
                found[word[:at] + word[at + 1 :]] += 1
            found = Counter({w: n for w, n in found.items() if len(w) >= trie.least_length})
            plain = (h % 97 != 0) & (length >= trie.least_length)
            starts, ends = starts[plain], ends[plain]
            _, first, count = np.unique(kit.hash_runs(data, starts, ends), return_index=True, return_counts=True)
            for a, b, n in zip(starts[first].tolist(), ends[first].tolist(), count.tolist(), strict=True):
                found[whole[a:b].decode()] += n
            yield kit.record(schema, list(found), list(found.values()))

    return run


def word_counts(docs: DataFrame, trie: Trie) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z as a-z. A run whose crc32 with its
    doc_id is a multiple of 97 loses one letter, as misprints for the search."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    counts = texts.mapInArrow(count_runs(trie), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= trie.least_count)


def letter_counts(word: Column, trie: Trie) -> Column:
    """How many letters of each group a word has."""
    groups = ["".join(c for c in LETTERS if ord(c) % trie.groups == g) for g in range(trie.groups)]
    return F.array(*[(F.length(word) - F.length(F.translate(word, g, ""))).cast("int") for g in groups])


# --- the upper trie: which subtrees a word has to visit ----------------------------


def nodes_of(words: DataFrame, trie: Trie) -> DataFrame:
    """node (counts of the first groups), n: all nodes of the trie, with their words."""
    depth = F.explode(F.sequence(F.lit(0), F.lit(trie.groups)))
    prefix = F.slice("counts", F.lit(1), F.col("depth"))
    return (
        words.select("counts", depth.alias("depth"))
        .groupBy(prefix.alias("node"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def visits(words: DataFrame, trie: Trie) -> DataFrame:
    """word, n, node, held, home: the subtrees that hold all that is near a word.

    The word walks down from the root. Each group of a child may hold one letter more
    (once) or one less (once) than the word; children that do not exist are not gone
    to. Nodes of at most `words` words end the walk. home tells the own subtree. Of two
    words one finds the other: the one that has less in the first group in which they
    differ, so a walk leaves the own path by a surplus only. A round takes the walk one
    group further, for all words.
    """
    words = words.withColumn("counts", letter_counts(F.col("word"), trie))
    nodes = materialize(nodes_of(words, trie), "trie-nodes")
    root = F.array().cast("array<int>")
    walk = words.withColumns({"node": root, "surplus": F.lit(1), "deficit": F.lit(1), "held": F.lit(words.count()).cast("long")})
    done = []
    for depth in range(trie.groups + 1):
        done.append(walk.filter((F.col("held") <= trie.words) | F.lit(depth == trie.groups)).drop("counts"))
        walk = walk.filter(F.col("held") > trie.words).drop("held")
        if depth == trie.groups or walk.isEmpty():
            break
        unspent = F.col("surplus") + F.col("deficit") == 2
        step = F.explode(
            F.when(unspent, F.array(F.lit(0), F.lit(1))).otherwise(
                F.filter(
                    F.array(F.lit(-1), F.lit(0), F.lit(1)),
                    lambda s: (F.col("surplus") - s >= 0) & (F.col("deficit") + s >= 0),
                )
            )
        )
        walk = walk.select("*", step.alias("step")).select(
            "word", "n", "counts",
            F.concat("node", F.array(F.element_at("counts", depth + 1) + F.col("step"))).alias("node"),
            (F.col("surplus") - F.greatest("step", F.lit(0))).alias("surplus"),
            (F.col("deficit") + F.least("step", F.lit(0))).alias("deficit"),
        )
        here = nodes.filter(F.size("node") == depth + 1).withColumnRenamed("n", "held")
        walk = materialize(walk.join(here, "node"), "trie-walk")
    home = F.col("surplus") + F.col("deficit") == 2
    return reduce(DataFrame.unionByName, done).select("word", "n", "node", "held", home.alias("home"))


# --- search within a subtree --------------------------------------------------------


def depth_first(counts: np.ndarray, queries: np.ndarray, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first and last row of a leaf, queries) of the trie over `counts`, whose rows are
    sorted: a node is a range of rows. All queries walk together; each carries what is
    left of its surplus and deficit, and leaves where a child asks for more. Its first
    step aside is a surplus, as in `visits`."""
    n, groups = counts.shape
    everyone = np.arange(len(queries))
    stack = [(0, n, 0, everyone, np.ones(len(queries), np.int8), np.ones(len(queries), np.int8))]
    while stack:
        start, stop, depth, who, surplus, deficit = stack.pop()
        if depth == groups or stop - start <= bucket:
            yield start, stop, who
            continue
        column = counts[start:stop, depth]
        own = queries[who, depth]
        firsts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [len(column)]])
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            more = column[a] - own
            goes = (more <= surplus) & (-more <= deficit) & ((more >= 0) | (surplus == 0))
            if goes.any():
                more = more[goes].astype(np.int8)
                left = surplus[goes] - np.maximum(more, 0), deficit[goes] - np.maximum(-more, 0)
                stack.append((start + a, start + b, depth + 1, who[goes], *left))


class Letters:
    """Words as matrices of code points, from the left and from the right; those of more
    than `width` - 1 points are compared one at a time."""

    width = 33

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.array([len(w) for w in words])
        self.left = np.zeros((len(words), self.width), np.uint16)
        self.right = np.zeros((len(words), self.width), np.uint16)
        for k, w in enumerate(words):
            if len(w) < self.width:
                points = np.frombuffer(w.encode("utf-16-le"), np.uint16)
                self.left[k, : len(w)] = points
                self.right[k, : len(w)] = points[::-1]


def one_apart(letters: Letters, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one inserted, deleted or replaced code point."""
    la, lb = letters.lengths[a], letters.lengths[b]
    shorter, equal = np.minimum(la, lb), la == lb
    same = letters.left[a] == letters.left[b]
    replaced = equal & ((~same).sum(axis=1) == 1)
    # Of words of unequal length, one goes on where the other is filled up with zeros.
    head = np.minimum(np.argmin(same, axis=1), shorter)
    tail = np.minimum(np.argmin(letters.right[a] == letters.right[b], axis=1), shorter)
    out = replaced | ((np.abs(la - lb) == 1) & (head + tail >= shorter))
    for k in np.flatnonzero(np.maximum(la, lb) >= letters.width):
        x, y = sorted((letters.words[a[k]], letters.words[b[k]]), key=len)
        at = next((p for p, (c, d) in enumerate(zip(x, y)) if c != d), len(x))
        out[k] = len(y) - len(x) <= 1 and x != y and x[at + (len(x) == len(y)) :] == y[at + 1 :]
    return out


NEAR = "word string, near string, near_n long"


def counts_of(words: list[str], trie: Trie) -> np.ndarray:
    """`letter_counts` as a matrix."""
    points = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.bincount(row * trie.groups + points % trie.groups, minlength=len(words) * trie.groups)
    flat = flat.reshape(len(words), trie.groups)
    return flat.astype(np.int16 if flat.max(initial=0) < 1 << 14 else np.int32)


def packed_counts(counts: np.ndarray) -> np.ndarray:
    """Four bits for each of the first 16 groups; more than 15 letters count as 15."""
    shift = np.arange(min(16, counts.shape[1]), dtype=np.uint64) * np.uint64(4)
    return (np.minimum(counts[:, :16], 15).astype(np.uint64) << shift).sum(axis=1, dtype=np.uint64)


def few_changes(x: np.ndarray) -> np.ndarray:
    """Where two packed counts (as their exclusive or) differ in two groups at most."""
    x = x | (x >> np.uint64(1))
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)) <= 2


def search(trie: Trie):
    """Group function: the words near each guest among the words at home in a subtree,
    both ways. Of two words of equal counts, the lesser one finds the other."""
    schema = arrow_schema(NEAR)

    def run(key, table):
        words, n = table["word"].to_pylist(), table["n"].to_numpy()
        if len(table["home"].unique()) < 2:  # a block that no word of a leaf fell into
            return schema.empty_table()
        counts, letters = counts_of(words, trie), Letters(words)
        packed = packed_counts(counts)
        ranks = {w: k for k, w in enumerate(sorted(set(words)))}
        rank = np.array([ranks[w] for w in words])
        home = table["home"].to_numpy(zero_copy_only=False)
        guests, home = np.flatnonzero(~home), np.flatnonzero(home)
        home = home[np.lexsort(counts[home].T[::-1])]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start, stop, who in depth_first(counts[home], counts[guests], trie.bucket):
            some = max(1, (1 << 18) // (stop - start))
            for at in range(0, len(who), some):
                own, there = guests[who[at : at + some]], home[start:stop]
                x, y = np.nonzero(few_changes(packed[own][:, None] ^ packed[there]))
                a, b = own[x], there[y]
                step = counts[b] - counts[a]
                change = np.abs(step).sum(axis=1)
                total = step.sum(axis=1)
                fits = np.flatnonzero((change <= 2) & (np.abs(total) <= 1) & ((change < 2) | (total == 0)))
                step, a, b = step[fits], a[fits], b[fits]
                first = step[np.arange(len(a)), np.argmax(step != 0, axis=1)]
                mine = (first > 0) | ((first == 0) & (rank[a] < rank[b]))
                a, b = a[mine], b[mine]
                near = one_apart(letters, a, b)
                found.append((a[near], b[near]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        names = table["word"].combine_chunks()
        return pa.table([names.take(pa.array(a)), names.take(pa.array(b)), n[b]], schema=schema)

    return run


def near_words(words: DataFrame, trie: Trie) -> DataFrame:
    """word, near, near_n of all pairs of words that differ by one code point, both ways.

    A subtree is dealt to as many tasks as its visitors ask for (its own words visit it,
    too); the words at home in it, at most `words` of them, go to each. A leaf of more
    words than that, all of equal counts, is dealt in blocks of words as well.
    """
    every = materialize(visits(words, trie), "trie-visits")
    sizes = every.groupBy("node").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(trie.queries)).cast("int").alias("tables"),
        F.ceil(F.max("held") / F.lit(trie.words)).cast("int").alias("blocks"),
    )
    part = lambda n, seed: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = every.join(sizes, "node")
    hosts = every.filter("home").withColumn("block", part("blocks", 2)).withColumn("guest_of", all_of("tables"))
    guests = every.withColumn("guest_of", part("tables", 1)).withColumn("block", all_of("blocks"))
    keys = ["node", "guest_of", "block"]
    both = hosts.select(*keys, "word", "n", F.lit(True).alias("home")).unionByName(
        guests.select(*keys, "word", "n", F.lit(False).alias("home"))
    )
    return both.groupBy(*keys).applyInArrow(search(trie), NEAR)


# --- forms ------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each word's chain of forms.

    Every round each word jumps to where its goal pointed, so a chain is halved; n at
    least doubles along it, so there are few rounds at any input size."""
    state = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = state.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = materialize(moved, "forms")
        if not moved.agg(F.count_if("moved")).first()[0]:
            return moved.select("word", "root")
        state = moved.select("word", "root")


def group_variants(docs: DataFrame, trie: Trie = Trie()) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    Words are the distinct results of `word_counts`. A word's form is its near word of
    largest n (ties: the least in code-point order), if that is at least twice the
    word's own n; root is the last of the chain of forms, the word itself if it has none.

    Null and empty texts have no words; a null doc_id counts as an empty text in the
    hash. Rows that repeat count again. Other columns are not looked at. An empty table,
    and one without frequent words, gives no rows.
    """
    words = materialize(word_counts(docs, trie), "words")
    near = near_words(words, trie)
    # Of equal n the least word: UTF-8 sorts like code points.
    best = F.min_by("near", F.struct(-F.col("near_n"), F.col("near")))
    near = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.max("near_n").alias("best_n")
    )
    has = F.col("best_n") >= trie.ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"),
    )
    found = materialize(found, "variants")
    ends = roots(found.filter(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
