"""Shared parts of the near-duplicate operators: shingle sets, buckets, components and
exact similarities.

What meets in a bucket is never written out as pairs. A bucket yields its members'
pairs with one of them, then the edges of a spanning forest between what is still
apart; both are as many rows as the bucket has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from slotlake.llm import textkit as kit
from slotlake.llm.common import arrow_schema
from slotlake.session import broadcast_if_small, materialize, scratch_path

# A task compares at most this many sets, or so many bytes of them, with each other.
BLOCK_SETS = 2048
BLOCK_BYTES = 8 << 20
# Memory of a broadcast row of ids and a fingerprint, taken generously; four times that
# is reckoned, so that at most 64 MB are broadcast.
ROW_BYTES = 120
# Sets of a candidate component that all of its blocks get, to hold them together.
PIVOTS = 16


# --- shingles and signatures ------------------------------------------------------


def shingle_sets(texts: pa.Array, width: int, lower: bool = False) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are runs of anything but
    ASCII white space, with A-Z as a-z if `lower`; a text of fewer words than `width`
    has one shingle of all its words, one without words none."""
    data, offsets = kit.utf8(texts)
    starts, ends = kit.runs(~kit.SEPARATOR[data], offsets)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
    words = kit.hash_runs(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    windows = kit.window_hashes(words, width)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(windows[a : b - width + 1]))
        elif b > a:
            out.append(kit.window_hashes(words[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * n + 1, dtype=np.uint64) * kit._STEP
    return kit.mix(seeds[:n]) | np.uint64(1), kit.mix(seeds[n:])


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The minima of n multiply-add hashes of the shingles."""
    a, b = _coefficients(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        part = shingles[start : start + 1024]
        least = np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(axis=1))
    return least


# --- runs of equal keys -----------------------------------------------------------


def run_tables(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def by_key(rows: DataFrame, keys: list[str], within: list[str], fn: Callable, ddl: str) -> DataFrame:
    """fn(table) over the rows of each key, without a group for each in the JVM: a key's
    rows arrive one after another in the batches of a partition."""
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[list[np.ndarray]] = []
        n = 0
        for table in run_tables(batches, keys):
            found = fn(table)
            if found is not None and len(found[0]):
                pending.append(found)
                n += len(found[0])
            if n > 8192:
                yield kit.record(schema, *[np.concatenate(c) for c in zip(*pending, strict=True)])
                pending, n = [], 0
        if pending:
            yield kit.record(schema, *[np.concatenate(c) for c in zip(*pending, strict=True)])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *within).mapInArrow(run, ddl)


# --- candidate components ---------------------------------------------------------


def shared(rows: DataFrame) -> DataFrame:
    """key, id, center: the rows (key, id) whose key others share, each with the least
    id of its key. A key may have any number of rows: one at a time is looked at."""
    schema = arrow_schema("key long, id long, center long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # first row of the key that the last batch ended with, if it is alone yet
        key = center = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, i = batch["key"].to_numpy(), batch["id"].to_numpy()
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[0] = key is None or k[0] != key
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            centers = np.where(start >= 0, i[np.maximum(start, 0)], center if center is not None else 0)
            alone = new & np.append(new[1:], True)
            keep = ~alone
            if held is not None and not new[0]:
                yield kit.record(schema, *[np.array([x]) for x in held])
            held = (k[-1], i[-1], i[-1]) if alone[-1] else None
            yield kit.record(schema, k[keep], i[keep], centers[keep])
            key, center = k[-1], centers[-1]

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(
        run, "key long, id long, center long"
    )


STEP = "a long, b long, moved boolean"


def least_of_runs(large: bool):
    """mapInArrow function over edges (a, b) that are sorted: one step of `components` at
    each node a. Nothing but the node's least neighbour is held."""
    schema = arrow_schema(STEP)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = other = least = None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
            new, again = np.ones(len(a), bool), np.zeros(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            new[0], again[0] = a[0] != node, a[0] == node and b[0] == other
            start = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
            first = np.where(start >= 0, b[np.maximum(start, 0)], 0 if least is None else least)
            node, other, least = a[-1], b[-1], first[-1]
            if large:  # greater neighbours go to the least around, be it the node itself
                goal, keep = np.minimum(first, a), ~again & (b > a)
                yield kit.record(schema, b[keep], goal[keep], (goal < a)[keep])
            else:  # the node and its other smaller neighbours go to the least of them
                head = b == first
                keep = np.where(head, new, ~again)
                yield kit.record(schema, np.where(head, a, b)[keep], first[keep], ~head[keep])

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of the component of each node that has a link.

    Alternates two steps until nothing moves: every node hands its greater neighbours,
    then its smaller ones, to the least node around it. Each is one shuffle by node
    and a pass over the sorted edges, so a node may have any number of neighbours; a
    number of rounds about the logarithm of the longest path is needed.
    """
    spark = links.sparkSession
    state = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if state.isEmpty():  # Spark would drop the steps, and what they tell
        return state.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        steps, moved = both, []
        for large in (True, False):
            seen = Observation()
            steps = steps.repartition("a").sortWithinPartitions("a", "b").mapInArrow(least_of_runs(large), STEP)
            steps = steps.observe(seen, F.count_if("moved").alias("moved")).select("a", "b")
            moved.append(seen)
        path = scratch_path(spark, "links")
        steps.write.parquet(path)
        state = spark.read.schema("a long, b long").parquet(path)
        if not any(seen.get["moved"] for seen in moved):
            break
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def different(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many values each row of a differs from each row of b."""
    return np.count_nonzero(a[:, None, :] != b[None, :, :], axis=2)


def pair_distances(pairs: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """Adds to rows (id, center) in how many signature values, of numpy type `kind`,
    the two differ."""
    a = sets.select("id", F.col("sig").alias("sig_a"))
    b = sets.select(F.col("id").alias("center"), F.col("sig").alias("sig_b"))
    ddl = "id long, center long, far int"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (
                    np.frombuffer(b"".join(batch[c].to_pylist()), kind).reshape(batch.num_rows, -1)
                    for c in ("sig_a", "sig_b")
                )
                yield kit.record(schema, batch["id"], batch["center"], np.count_nonzero(left != right, axis=1))

    return pairs.join(a, "id").join(b, "center").select("id", "center", "sig_a", "sig_b").mapInArrow(run, ddl)


def spanning(kind: str, most: int):
    """by_key function: rows (id, label, sig) that differ in at most `most` values and
    have different labels are joined; edges of a spanning forest over the labels."""

    def run(table: pa.Table):
        ids, at = np.unique(table["id"].to_numpy(), return_index=True)
        names, label = np.unique(table["label"].to_numpy()[at], return_inverse=True)
        if len(names) < 2:
            return None
        sig = np.frombuffer(b"".join(table["sig"].take(pa.array(at)).to_pylist()), kind).reshape(len(ids), -1)
        root, found = np.arange(len(names)), []
        step = max(1, (1 << 22) // (len(ids) * sig.shape[1]))
        for start in range(0, len(ids), step):
            near = different(sig[start : start + step], sig) <= most
            mine = root[label]
            a, b = np.nonzero(near & (mine[start : start + step, None] != mine[None, :]))
            for x, y in zip((a + start).tolist(), b.tolist(), strict=True):
                u, v = root[label[x]], root[label[y]]
                if u != v:
                    root[root == max(u, v)] = min(u, v)
                    found.append((ids[x], ids[y]))
        if not found:
            return None
        return [np.array(c, np.int64) for c in zip(*found, strict=True)]

    return run


def candidate_components(
    keyed: DataFrame, sets: DataFrame, kind: str, most: int, block: int = BLOCK_SETS
) -> tuple[DataFrame, DataFrame]:
    """(node, label; far): components over all pairs of sets that share a key (rows key,
    id) and differ in at most `most` signature values, and in how many those differ that
    were compared first. Sets without such a pair are left out.

    Every member of a key is compared with the least one. Keys whose members are in one
    component by then are done with, copies of each other among them. The members of the
    others are compared with each other in tasks of bounded size, which tell a spanning
    forest; no row is made for a pair.
    """
    met = materialize(shared(keyed), "near-met")
    pairs = met.filter("id <> center").select("id", "center").distinct()
    star = pair_distances(pairs, sets, kind).filter(F.col("far") <= most)
    star = materialize(star.select(F.col("id").alias("a"), F.col("center").alias("b"), "far"), "near-star")
    far, star = star.select("far"), star.select("a", "b")
    first = materialize(components(star), "near-first")
    named = met.select("key", "id").join(first.withColumnRenamed("node", "id"), "id", "left")
    named = materialize(named.select("key", "id", F.coalesce("label", "id").alias("label")), "near-named")
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.filter("low < high").select("key", F.ceil(F.col("n") / F.lit(block)).alias("blocks"))
    rows = block_pairs(named.join(mixed, "key"), "id").select(
        F.xxhash64("key", "one", "two").alias("key"), "id", "label"
    )
    rows = rows.join(sets.select("id", "sig"), "id").select("key", "id", "label", "sig")
    more = materialize(by_key(rows, ["key"], ["id"], spanning(kind, most), "a long, b long"), "near-more")
    if more.isEmpty():
        return first, far
    return materialize(components(star.unionByName(more)), "near-graph"), far


def block_pairs(rows: DataFrame, name: str) -> DataFrame:
    """Rows with a number of blocks, once for each pair (one, two) that their own block,
    by a hash of `name`, is part of."""
    own = F.pmod(F.xxhash64(name), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", every)
    return rows.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))


# --- exact similarities -----------------------------------------------------------


class Sets:
    """The shingle sets of a task; overlaps of one with many are gathers and a sum."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.size)
        keep = count[inverse] > 1
        self.values, owner = inverse[keep], owner[keep]
        self.starts = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.mark = np.zeros(len(count), np.int8)

    def linked(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of the others have a similarity of `percent` % or more with set x."""
        own = self.values[self.starts[x] : self.starts[x + 1]]
        # Sets of too unlike sizes cannot reach it.
        fits = 100 * np.minimum(self.size[others], self.size[x]) >= percent * np.maximum(self.size[others], self.size[x])
        out = np.zeros(len(others), bool)
        some = others[fits]
        lengths = self.starts[some + 1] - self.starts[some]
        total = int(lengths.sum())
        if not total or not len(own):
            return out
        first = np.cumsum(lengths) - lengths
        at = np.arange(total) + np.repeat(self.starts[some] - first, lengths)
        self.mark[own] = 1
        seen = np.concatenate([[0], np.cumsum(self.mark[self.values[at]], dtype=np.int64)])
        self.mark[own] = 0
        both = seen[first + lengths] - seen[first]
        out[fits] = both * 100 >= percent * (self.size[some] + self.size[x] - both)
        return out


def read_sets(table: pa.Table, at: np.ndarray) -> Sets:
    return Sets([np.frombuffer(x, np.uint64) for x in table["shingles"].take(pa.array(at)).to_pylist()])


def exact_components(percent: int):
    """by_key function: id, label of the exact components of a task's sets. Sets that
    were reached are not compared again."""

    def run(table: pa.Table):
        ids, at = np.unique(table["id"].to_numpy(), return_index=True)
        if len(ids) < 2:
            return None
        sets, label = read_sets(table, at), np.full(len(ids), -1)
        left = np.arange(len(ids))
        while len(left):
            todo, left = [left[0]], left[1:]
            name = todo[0]
            while todo:
                x = todo.pop()
                label[x] = name
                hit = sets.linked(x, left, percent)
                todo += left[hit].tolist()
                left = left[~hit]
        return [ids, ids[label]]

    return run


def count_links(percent: int):
    """by_key function: id, links, label of the sets of a block, or of two: to how many
    documents each is linked, and the least set of its component in this task."""

    def run(table: pa.Table):
        ids, at = np.unique(table["id"].to_numpy(), return_index=True)
        if len(ids) < 2:
            return None
        one, two = (table[c].to_numpy()[0] for c in ("one", "two"))
        own, weight = (table[c].to_numpy()[at] for c in ("own", "copies"))
        sets, label, links = read_sets(table, at), np.arange(len(ids)), np.zeros(len(ids), np.int64)
        rest = np.arange(len(ids))
        for x in rest:
            others = rest[x + 1 :]
            if one != two:
                others = others[own[others] != own[x]]
            hit = others[sets.linked(x, others, percent)]
            if len(hit):
                links[x] += weight[hit].sum()
                links[hit] += weight[x]
                names = np.unique(label[np.append(hit, x)])
                label[np.isin(label, names)] = names[0]
        return [ids, links, ids[label]]

    return run


def cross_links(percent: int):
    """by_key function: the pairs of labels that a link between a guest and a host joins."""

    def run(table: pa.Table):
        label, guest = table["label"].to_numpy(), table["guest"].to_numpy(zero_copy_only=False)
        if guest.all() or not guest.any():
            return None
        sets, found = read_sets(table, np.arange(len(label))), set()
        hosts = np.flatnonzero(~guest)
        for x in np.flatnonzero(guest):
            others = hosts[label[hosts] != label[x]]
            for y in np.unique(label[others[sets.linked(x, others, percent)]]).tolist():
                found.add((int(label[x]), y))
        return [np.array(c, np.int64) for c in zip(*found, strict=True)] if found else None

    return run


def with_shingles(
    docs: DataFrame, wanted: DataFrame, make: Callable[[pa.Array], list[np.ndarray]]
) -> DataFrame:
    """id, shingles of the wanted sets (id, fp, first_doc), from one text of each."""
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("first_doc")))
    ddl = "id long, shingles binary"
    schema = arrow_schema(ddl)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kit.blocks(batches, "text"):
            found = make(block["text"])
            # Rows may repeat a doc_id with other texts.
            same = [len(s) and fingerprint(s) == fp.as_py() for s, fp in zip(found, block["fp"], strict=True)]
            at = np.flatnonzero(same)
            yield kit.record(schema, block["id"].take(pa.array(at)), [found[k].tobytes() for k in at])

    return texts.select("text", "fp", "id").mapInArrow(read, ddl)


def block_count(sets: Column, shingles: Column, block: int) -> Column:
    """Into how many blocks of bounded size a component is dealt."""
    return F.greatest(
        F.ceil(sets / F.lit(block)), F.ceil(shingles * 8 / F.lit(BLOCK_BYTES)), F.lit(1)
    ).cast("long")


def wanted_sets(
    docs: DataFrame, sets: DataFrame, graph: DataFrame, make: Callable, block: int
) -> tuple[DataFrame, DataFrame]:
    """(id, part, n, blocks; id, shingles) of the sets of candidate components (node,
    label), with how many sets a component has and in how many blocks it is dealt."""
    plan = sets.select(F.col("id").alias("node"), "n_shingles").join(graph, "node")
    blocks = block_count(F.count(F.lit(1)), F.sum("n_shingles"), block)
    sizes = plan.groupBy("label").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks"))
    wanted = graph.join(sizes, "label").select(F.col("node").alias("id"), F.col("label").alias("part"), "n", "blocks")
    wanted = materialize(wanted, "near-wanted")
    lookup = wanted.select("id").join(sets.select("id", "fp", "first_doc"), "id")
    lookup = small_side(materialize(lookup, "near-lookup"), "first_doc")
    return wanted, materialize(with_shingles(docs, lookup, make), "near-shingles")


def small_side(rows: DataFrame, name: str) -> DataFrame:
    """Broadcast rows of a few numbers if they are small; of any other kind (a doc_id
    may be text of any length) Spark decides by their size."""
    if rows.schema[name].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return rows
    return broadcast_if_small(rows, rows.count(), 4 * ROW_BYTES)


def linked_components(
    docs: DataFrame, sets: DataFrame, graph: DataFrame, percent: int, make: Callable, block: int = BLOCK_SETS
) -> DataFrame:
    """node, label: the exact components within the candidate components of graph (node,
    label); sets (id, fp, first_doc, n_shingles). Sets without a link are left out.

    A component of more sets than a task takes is dealt in blocks. A few of its sets go
    to each block, so that what belongs together is found to in the first pass. Then
    what lies outside of the largest part is compared with all blocks. Every pair of a
    component is in one task unless a path of links joins it already.
    """
    wanted, shingles = wanted_sets(docs, sets, graph, make, block)
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    pivot = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("n") / F.lit(PIVOTS))) == 0
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = wanted.select("id", "part", F.explode(F.when(pivot, every).otherwise(F.array(own))).alias("block"))
    rows = dealt.join(shingles, "id").select("part", "block", "id", "shingles")
    found = by_key(rows, ["part", "block"], ["id"], exact_components(percent), "a long, b long")
    edges = materialize(found, "near-found")
    labels = materialize(components(edges), "near-labels")

    split = wanted.filter("blocks > 1").join(labels.withColumnRenamed("node", "id"), "id", "left")
    split = materialize(split.select("id", "part", "blocks", F.coalesce("label", "id").alias("label")), "near-split")
    parts = split.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("part").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("n"))
    main = main.filter("all > n").select("part", "main", F.ceil((F.col("all") - F.col("n")) / F.lit(block)).cast("long").alias("rows"))
    if main.isEmpty():
        return labels
    split = split.join(main, "part")
    row = F.pmod(F.xxhash64("id", F.lit(2)), F.col("rows"))
    of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hosts = split.select("part", own.alias("block"), of("rows").alias("row"), "id", "label", F.lit(False).alias("guest"))
    guests = split.filter("label <> main").select(
        "part", of("blocks").alias("block"), row.alias("row"), "id", "label", F.lit(True).alias("guest")
    )
    rows = hosts.unionByName(guests).join(shingles, "id")
    more = by_key(rows, ["part", "block", "row"], ["guest", "id"], cross_links(percent), "a long, b long")
    return components(edges.unionByName(materialize(more, "near-cross")))
