"""Near duplicates and top-k search against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_rows import SCHEMA, edge_rows, words

from slotlake.llm import linking, near_dup, topk


def brute_links(rows):
    """(class, number of links) of each row, and rows' classes by least doc_id."""
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        if len(w) >= 5:
            sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
        else:
            sets.append(frozenset([tuple(w)]) if w else frozenset())
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for k in range(n):
        if rows[k][0] is not None:
            least[find(k)].append(rows[k][0])
    return sorted(
        ((rows[k][0], min(least[find(k)], default=None), links[k]) for k in range(n)), key=str
    )


def family(rng, doc_id, n_words, members):
    """A text and copies of it with a word changed at one end or in the middle."""
    vocabulary = [f"w{k}" for k in range(500)]
    base = [rng.choice(vocabulary) for _ in range(n_words)]
    out = []
    for k in range(members):
        text = list(base)
        if k:
            text[rng.choice([0, len(text) - 1, len(text) // 2])] = f"new{k}"
        out.append((doc_id + k, " ".join(text), "en", "s", 0))
    return out


def found(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [3, 256])
def test_join_equals_brute_force(spark, block):
    rng = random.Random(2)
    rows = []
    for k in range(12):
        rows += family(rng, 100 * k, rng.choice([6, 12, 30, 80, 200]), rng.choice([1, 2, 3, 9]))
    rows += [(5000 + k, rows[0][1], "en", "s", 0) for k in range(20)]  # copies
    rows += [(6000, None, "en", "s", 0), (6001, "", "en", "s", 0), (6002, "two words", "en", "s", 0), (6003, "two  words", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(near_dup.link(df, near_dup.Forest(block=block))) == brute_links(rows)


def test_join_of_odd_rows(edge_docs, no_docs):
    assert found(near_dup.link(edge_docs)) == brute_links(edge_rows())
    assert near_dup.link(no_docs).collect() == []


def test_one_document_of_each_class_stays(edge_docs, no_docs):
    kept = near_dup.distinct_documents(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 6, None, 8, 9], key=str)
    assert near_dup.distinct_documents(no_docs).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.label for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)}


def test_prefixes_are_shortened_to_the_recall(spark):
    rng = random.Random(9)
    rows = []
    for k in range(30):  # pairs just above the threshold
        base = [f"q{rng.randrange(400)}" for _ in range(49)]
        other = list(base)
        other[0] = "changed"
        other[-1] = "too"
        other[24] = other[24] if k % 2 else "mid"
        rows += [(2 * k, " ".join(base), "en", "s", 0), (2 * k + 1, " ".join(other), "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(near_dup.link(df)) == brute_links(rows)


def test_pairs_at_the_threshold_reach_the_recall(spark, monkeypatch):
    depths, plain = [], near_dup.prefixes
    monkeypatch.setattr(near_dup, "prefixes", lambda sets, f, depth: depths.append(depth) or plain(sets, f, depth))
    df = spark.createDataFrame(family(random.Random(4), 0, 200, 9), SCHEMA)  # easy copies
    near_dup.link(df).collect()
    forest = near_dup.Forest()
    assert forest.chance(0.8, min(depths)) >= forest.recall > forest.chance(0.8, min(depths) + 1)


def brute_graph(rows, most):
    """Components over sets that share a key and differ in few values."""
    root = {i: i for _, i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for ka, a, sa in rows:
        for kb, b, sb in rows:
            if ka == kb and a < b and sum(x != y for x, y in zip(sa, sb)) <= most:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in root}


@pytest.mark.parametrize("block", [2, 2048])
def test_candidate_components_equal_brute_force(spark, block):
    rng = random.Random(block)
    sigs = {i: [rng.randrange(3) for _ in range(6)] for i in range(60)}
    rows = [(rng.randrange(12), i, sigs[i]) for i in range(60) for _ in range(2)]
    sets = spark.createDataFrame([(i, bytes(s)) for i, s in sigs.items()], "id long, sig binary")
    keyed = spark.createDataFrame([(k, i) for k, i, _ in set((k, i, tuple(s)) for k, i, s in rows)], "key long, id long")
    graph, _ = linking.candidate_components(keyed, sets, "u1", 2, block)
    got = {r.node: r.label for r in graph.collect()}
    want = brute_graph(rows, 2)
    assert {i: got.get(i, i) for i in sigs} == want and len(set(want.values())) < 60


@pytest.mark.parametrize("members", [300, 3000])
def test_unlike_sets_behind_one_prefix_make_few_rows(spark, monkeypatch, members):
    """Work in proportion: no row for a pair, whatever the group's size."""
    made, plain = [], linking.materialize

    def counted(df, name):
        out = plain(df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(linking, "materialize", counted)
    rng = np.random.default_rng(1)
    sigs = rng.integers(0, 1 << 30, (members, 8)).astype(">u4")
    sets = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sigs)], "id long, sig binary")
    keyed = sets.selectExpr("5L AS key", "id")
    graph, _ = linking.candidate_components(keyed, sets, ">u4", 2)
    assert graph.count() == 0 and max(made) <= members and sum(made) <= 3 * members


def test_rows_with_one_doc_id_and_other_texts_stay(spark):
    text = {c: " ".join(f"{c}{k}" for k in range(30)) for c in "abc"}
    rows = [(1, text["a"]), (1, text["b"]), (2, text["b"]), (3, text["c"]), (3, text["c"])]
    rows += [(None, text["c"]), (None, "a text without an id and with enough words"), (None, " "), (4, None), (4, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("__fp", F.lit(1))
    keys = {r.class_key for r in near_dup.link(df).collect() if r.class_key}
    kept = near_dup.distinct_documents(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(1, text["a"]), (1, text["b"]), (3, text["c"]), (None, rows[6][1]), (None, " "), (4, None), (4, None)]
    assert got == sorted(want, key=str) and len(keys) == 4


# --- top-k ------------------------------------------------------------------------


def brute_top(rows, k=5):
    usable = {}
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.setdefault(vec_id, []).append([math.floor(256.0 * x) for x in v])
    out = []
    for q in sorted(usable):
        if q % 50:
            continue
        scores = []
        for c, vectors in usable.items():
            if c == q:
                continue
            s = [sum(x * y for x, y in zip(a, b, strict=True)) for a in usable[q] for b in vectors if len(a) == len(b)]
            if s:
                scores.append((-max(s), c))
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def search(spark, rows, tiling):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    df = df.selectExpr("*", "'clash' AS shard", "1 AS score", "2 AS id", "3 AS q")
    got = topk.search(df, df["vec_id"] % 50 == 0, tiling=tiling).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


@pytest.mark.parametrize("tiling", [topk.Tiling(), topk.Tiling(queries=2, rows=7, product=2, fan_in=2)])
def test_top_k_equals_brute_force(spark, tiling):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 4) / 8]) for k in range(0, 260)]  # many ties
    rows += [(50, [0.5, 0.25, 0.0, 1.0]), (7, rows[7][1])]  # an id with two vectors, a repeated row
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan"), 1.0]), (303, [float("inf")]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(350, []), (351, []), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (450, [1.0] * 7)]
    assert search(spark, rows, tiling) == brute_top(rows)


def test_products_beyond_double_precision_are_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 1.0]), (2, [1e6, 1.0 + 1 / 256])]
    assert search(spark, rows, topk.Tiling()) == brute_top(rows)


def test_empty_table(spark):
    assert search(spark, [], topk.Tiling()) == []
