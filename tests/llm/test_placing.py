"""Sharding, mixing and license scans against plain Python."""

import hashlib
import math
import struct
import textwrap
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from llm_rows import edge_rows, words
from oracle import compare, connect
from pyspark.sql import functions as F

from slotlake.llm import licenses, mixing, sharding
from slotlake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(spark, sf_dir, name):
    problem, rows = compare(spark, connect(sf_dir), name, QUERIES[name], ORACLE_SQL[name], sf_dir)
    assert not problem
    assert rows > 0


# --- sharding ---------------------------------------------------------------------


def shards(docs, tree, grown):
    return sharding.shard_documents(docs, tree, grown).collect()


def test_sizes_slots_and_growth(documents):
    tree = sharding.uniform_tree(40)
    rows = shards(documents, tree, sharding.grow(tree))
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        assert r.grown_shard in (r.shard, 40)
        assert (r.region, r.rack) == (r.shard // 16, r.shard // 4)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_place(key, tree):
    """The descent, key by key, with the hash of another library."""
    at = ()
    for depth, level in enumerate(("region", "rack", "shard")):
        weights = Counter()
        for leaf in tree:
            path = (leaf.region, leaf.rack, leaf.shard)
            if path[:depth] == at:
                weights[path[depth]] += leaf.weight
        draws = []
        for child, weight in weights.items():
            h = 42
            for part in (struct.pack("<q", key), struct.pack("<i", depth), struct.pack("<i", child)):
                h = xxhash.xxh64_intdigest(part, h)
            draws.append((-math.log(((h >> 11) + 0.5) / 2**53) / weight, child))
        at += (min(draws)[1],)
    return at


def placed(spark, tree, n=20_000):
    rows = spark.range(n).select("id", sharding.place(F.col("id"), tree).alias("at")).collect()
    return {r.id: tuple(r["at"]) for r in rows}


def weighted(tree, **weights):
    return [sharding.Shard(x.region, x.rack, x.shard, weights.get(f"s{x.shard}", x.weight)) for x in tree]


def test_places_equal_brute_force(spark):
    tree = weighted(sharding.uniform_tree(40), s3=2.5, s17=0.25, s39=4.0)
    got = placed(spark, tree, 3000)
    assert got == {k: brute_place(k, tree) for k in range(3000)}


def test_the_shape_of_the_tree_matters(spark):
    deep = sharding.uniform_tree(40)
    flat = [sharding.Shard(0, 0, x.shard) for x in deep]
    a, b = placed(spark, deep, 5000), placed(spark, flat, 5000)
    assert sum(a[k][2] != b[k][2] for k in a) > 2500
    with pytest.raises(ValueError):
        sharding.place(F.lit(1), [sharding.Shard(0, 0, 0), sharding.Shard(1, 0, 1)])


def test_keys_move_only_into_what_grows(spark):
    tree = sharding.uniform_tree(40)
    before, after = placed(spark, tree), placed(spark, sharding.grow(tree))
    assert all(before[k] == after[k] or after[k] == (3, 10, 40) for k in before)
    share = Counter(at[2] for at in after.values())
    assert all(abs(n / 20_000 - 1 / 41) < 0.005 for n in share.values()) and len(share) == 41


def test_movement_stays_in_the_subtrees_whose_weights_change(spark):
    tree = sharding.uniform_tree(40)
    before, after = placed(spark, tree), placed(spark, weighted(tree, s9=3.0))  # region 0, rack 2
    for k, old in before.items():
        new = after[k]
        if old[0] == new[0] != 0 or (old[:2] == new[:2] and old[:2] != (0, 2)):
            assert old == new
        elif old[0] != new[0]:
            assert new[0] == 0
        elif old[1] != new[1]:
            assert new[1] == 2
        elif old[2] != new[2]:
            assert new[2] == 9
    share = Counter(at[2] for at in after.values())
    assert abs(share[9] / 20_000 - 3 / 42) < 0.008


def test_odd_rows_get_shards(edge_docs, no_docs):
    tree = sharding.uniform_tree(2)
    grown = sharding.grow(tree)
    rows = shards(edge_docs, tree, grown)
    want = Counter(
        (r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in edge_rows()
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert shards(no_docs, tree, grown) == []
    with pytest.raises(ValueError):
        sharding.place(F.lit(1), [])


# --- mixing -----------------------------------------------------------------------


def water_fill(sizes, mix):
    """Targets by resharing what stops at its cap until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(names)}
    total, capped = mix.share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] >= mix.repeats * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in rest}
        capped |= {s: float(mix.repeats * sizes[s]) for s in over}


def brute_mix(rows, mix):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = water_fill(dict(sizes), mix)
    out, streams = [], defaultdict(list)
    for r in rows:
        text = f"{mix.seed}:{r[0]}" if r[0] is not None else mix.seed
        key = int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
        streams[r[3]].append((key, r[0] is not None, r[0] or 0, len(words(r[1])), r))
    for source, stream in streams.items():
        stream.sort(key=lambda x: x[:4])
        quota, at = int(targets[source] + 0.5), 0
        for *_, size, r in stream:
            starts = (at, sizes[source] + at)
            taken = sum(max(0, min(s + size, quota) - s) for s in starts)
            out.append((r[0], size, sizes[source], round(targets[source], 6), taken))
            at += size
    return Counter(out)


@pytest.mark.parametrize("slots", [1 << 18, 7])
def test_mix_equals_brute_force(documents, edge_docs, slots):
    mix = mixing.Mix(max_slots=slots, buckets=16, bins=8)
    for docs in (documents, edge_docs):
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        got = mixing.taken_words(docs, mix).collect()
        assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == brute_mix(rows, mix)
        assert all(r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_words(docs, mix).collect()))


def test_slots_interleave_the_sources(documents):
    """Any stretch of the schedule holds a source about as often as its share says."""
    docs, pieces = mixing.plan_mix(documents)
    slots = pieces.select("slot", "idx").distinct().orderBy("slot").collect()
    total = Counter(r.idx for r in slots)
    half = Counter(r.idx for r in slots[: len(slots) // 2])
    assert all(abs(half[s] - n / 2) <= 4 for s, n in total.items())


def test_mixed_documents_are_whole_or_cut_to_the_taken_words(documents, edge_docs, no_docs):
    for docs in (documents, edge_docs):
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        got = Counter()
        for r in mixed.collect():
            got[r.doc_id] += len(words(r.text))
            assert r.n_chars == len(r.text)
        want = Counter()
        for r in mixing.taken_words(docs).collect():
            want[r.doc_id] += r.taken
        assert +got == +want
    assert mixing.mixed_documents(no_docs).collect() == []
    assert mixing.taken_words(no_docs).collect() == []


# --- licenses ---------------------------------------------------------------------

APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n"


@pytest.mark.parametrize(
    ("text", "licenses_", "permissive"),
    [
        (None, "", None),
        ("", "", None),
        ("words only. Nothing else", "", None),
        ("x\nReleased under the MIT License.\ny", "MIT", True),
        ("RELEASED   under the MIT license!", "MIT", True),
        (APACHE, "Apache-2.0", True),
        ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", "CC-BY-NC-4.0,All-Rights-Reserved", False),
        ("You may obtain a copy of the License at\nyou may not use this file except in compliance with the License.", "", None),
        ("We released it under the MIT License yesterday.", "", None),
        ("a b. " * 40_000 + "\nReleased under the MIT License.", "MIT", True),
    ],
)
def test_license_rules(spark, text, licenses_, permissive):
    docs = spark.createDataFrame([(1, text, "clash")], "doc_id long, text string, ids string")
    (row,) = licenses.scan(docs).collect()
    assert (row.licenses, row.permissive) == (licenses_, permissive)


WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""


def styled(text, style):
    """A licence as written, or wrapped anew."""
    paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
    if style in ("narrow", "comment"):
        paragraphs = [textwrap.fill(p, 44, break_on_hyphens=False) for p in paragraphs]
    if style == "shouting":
        paragraphs = [p.upper() for p in paragraphs]
    text = text if style == "whole" else "\n\n".join(paragraphs)
    if style == "comment":
        text = "\n".join(f" * {line}" if line else "" for line in text.split("\n"))
    return text


@pytest.mark.parametrize("style", ["whole", "unwrapped", "narrow", "comment", "shouting"])
def test_real_wording_is_found_however_it_is_wrapped(spark, style):
    rows, want = [(0, WARRANTY)], {0: ""}
    for k, (license_, _, text) in enumerate(licenses.TEXTS.values(), 1):
        text = styled(text, style)
        before = "This program is free software: " if text.startswith("you can") else "Copyright (c) 2020 A. Person\n\n"
        rows += [(k, f"{before}{text}\n\n{WARRANTY}\n")]
        want[k] = license_
        if len(licenses._sentences(text)) == 1:  # without its first word it is none
            rows += [(100 + k, text.split(" ", 3 if style == "comment" else 1)[-1])]
            want[100 + k] = ""
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == want


def test_longer_rules_cover_shorter_ones():
    two, three = (next(r for r in licenses.RULES if r.license == f"BSD-{n}-Clause") for n in (2, 3))
    assert two.within(three) and not three.within(two) and not two.within(two)
    assert len(set(licenses.SENTENCES.values())) >= 30 and all(r.sentences for r in licenses.RULES)


def test_license_scan_of_odd_rows(edge_docs, no_docs):
    rows = licenses.scan(edge_docs).collect()
    assert len(rows) == len(edge_rows())
    assert all(r.n_licenses == 0 for r in rows)
    assert licenses.scan(no_docs).collect() == []
