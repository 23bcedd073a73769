"""Spelling variants, the Hamming join and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import CLASHING, SCHEMA, edge_rows, words
from pyspark.sql import functions as F

from slotlake.llm import compression, hamming_join, linking, spelling

# --- spelling variants ------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    count, out = brute_words(rows), {}
    for w, n in count.items():
        near = [x for x in count if apart(w, x)]
        best = min(near, key=lambda x: (-count[x], x), default=None)
        form = best if best and count[best] >= 2 * n else None
        out[w] = [form, None, n, len(near), count[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return sorted((w, *row) for w, row in out.items())


def found_variants(docs, trie=spelling.Trie()):
    rows = spelling.group_variants(docs, trie).collect()
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows)


def variant_rows(seed, texts=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randrange(5, 9))) for _ in range(40)]
    base += ["x" * 40, "x" * 39 + "y", "x" * 41, "q" * 70, "q" * 69, "ABCDE", "abcde", "déjàvu", "abcdéf×÷"]
    rows = []
    for k in range(texts):
        out = []
        for _ in range(80):
            w = rng.choice(base)
            at = rng.randrange(len(w))
            out.append(rng.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + rng.choice("abc") + w[at:], w[:at] + "é" + w[at + 1 :]]))
        rows.append((k, rng.choice([" ", "\n", "1", "-"]).join(out), "en", "s", 0))
    chain = ["kettle"] * 18 + ["kettles"] * 7 + ["kettlese"] * 3
    return rows + [(texts, " ".join(chain), "en", "s", 0)]


@pytest.mark.parametrize("trie", [spelling.Trie(), spelling.Trie(words=5, queries=7, bucket=2), spelling.Trie(words=3, queries=4, groups=2)])
def test_variants_equal_brute_force(spark, trie):
    rows = variant_rows(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute_variants(rows)
    assert found_variants(df, trie) == want
    assert any(r[1] for r in want) and any(r[1] != r[2] != r[0] for r in want)


def test_variants_of_odd_rows(edge_docs, no_docs):
    assert found_variants(edge_docs) == brute_variants(edge_rows())
    assert found_variants(no_docs) == []


def test_crc_of_runs():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 7, 47, 48, 49, 300]))) for _ in range(200)]
    ends = np.cumsum([len(p) for p in parts])
    before = [zlib.crc32(str(k).encode()) for k in range(200)]
    got = spelling.crc32_of_runs(
        np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends, np.array(before, np.uint32)
    )
    assert got.tolist() == [zlib.crc32(str(k).encode() + p) for k, p in enumerate(parts)]


def test_a_walk_meets_all_that_is_near(spark):
    """Of two near words one visits the other's subtree, wherever the trie is cut."""
    rng = random.Random(8)
    texts = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))) for _ in range(300)})
    trie = spelling.Trie(words=6, groups=3)
    df = spark.createDataFrame([(w, 3) for w in texts], "word string, n long")
    rows = spelling.visits(df, trie).collect()
    home = {r.word: tuple(r.node) for r in rows if r.home}
    seen = {(r.word, tuple(r.node)) for r in rows}
    assert set(home) == set(texts) and len(seen) == len(rows)
    for a in texts:
        for b in texts:
            if a < b and apart(a, b):
                assert (a, home[b]) in seen or (b, home[a]) in seen


# --- Hamming join -----------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, text, *_ in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for k, row in enumerate(rows):
        named = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        component = min(named, default=None)
        out.append((row[0], len(sets[k]), component, row[0] == component))
    return sorted(out, key=str)


def found_components(docs, multi=hamming_join.Multi()):
    rows = hamming_join.find_components(docs, multi).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=str)


def edited(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def component_rows(seed):
    """Groups of edits of one text, at and around the threshold; some only linked over
    others; copies in other case; short texts."""
    rng = random.Random(seed)
    rows = []
    for g in range(10):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 20, 60, 120]))]
        for k in range(12):
            text = edited(rng, base, rng.choice([0, 1, 1, 2, 3, 4]))
            base = text if rng.random() < 0.3 else base  # chains
            rows.append((100 * g + k, " ".join(text).upper() if k % 5 == 0 else " ".join(text), "en", "s", 0))
    return rows + [(5000, "One", "en", "s", 0), (5001, "one", "en", "s", 0), (5002, "one two", "en", "s", 0)]


@pytest.mark.parametrize("block", [3, 2048])
def test_components_equal_brute_force(spark, block):
    rows = component_rows(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_components(rows)
    assert found_components(df, hamming_join.Multi(block=block)) == want
    assert 10 < sum(r[3] for r in want) < len(rows) - 10


def test_components_of_odd_rows(edge_docs, no_docs):
    assert found_components(edge_docs) == brute_components(edge_rows())
    assert found_components(no_docs) == []


def test_all_pairs_within_the_distance_share_a_key(spark):
    """The pigeonhole: whatever 25 values differ, some chunk has one error at most."""
    multi, rng = hamming_join.Multi(), np.random.default_rng(2)
    base = rng.integers(0, 256, multi.values).astype(np.uint8)
    rows = [base]
    bounds = multi.bounds()
    for k in range(40):
        other = base.copy()
        at = rng.permutation(multi.values)[: multi.most]
        if k % 2:  # two errors in as many chunks as there are errors for, one in the last
            spread = [bounds[c] + i for c in range(multi.chunks) for i in range(2)]
            at = np.array(spread[: multi.most])
        other[at] ^= rng.integers(1, 256, len(at)).astype(np.uint8)
        rows.append(other)
    sets = spark.createDataFrame([(k, r.tobytes()) for k, r in enumerate(rows)], "id long, sig binary")
    keyed = sets.mapInArrow(hamming_join.chunk_keys(multi), "key long, id long").collect()
    own = {r.key for r in keyed if r.id == 0}
    assert {r.id for r in keyed if r.key in own} == set(range(41)) and len(own) == multi.values
    graph, _ = linking.candidate_components(spark.createDataFrame(keyed), sets, "u1", multi.most)
    assert {r.node for r in graph.collect()} == set(range(41))
    with pytest.raises(ValueError):
        hamming_join.Multi(most=26).bounds()


# --- vector codes -----------------------------------------------------------------


def brute_codes(rows, codes):
    kept = []
    for vec_id, v, label in rows:
        if v is None or not v or len(v) % codes.parts or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((vec_id, [max(-(1 << 28), min(1 << 28, math.floor(codes.scale * x))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    sizes = [len(v) for _, v, _ in kept[: codes.entries]]
    dim = max(sorted(set(sizes)), key=sizes.count)
    kept = [r for r in kept if len(r[1]) == dim]
    width = dim // codes.parts
    part = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[part(v, p) for _, v, _ in kept[: codes.entries]] for p in range(codes.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, p: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(codes.rounds):
        new = []
        for p in range(codes.parts):
            of = [[] for _ in books[p]]
            for _, v, _ in kept:
                of[nearest(part(v, p), p)[1]].append(part(v, p))
            new.append([tuple(sum(c) // len(xs) for c in zip(*xs)) if xs else e for xs, e in zip(of, books[p])])
        books = new
    out, total = [], Counter()
    for vec_id, v, label in kept:
        hits = [nearest(part(v, p), p) for p in range(codes.parts)]
        error = sum(d for d, _ in hits)
        total[label] += error
        out.append((vec_id, "".join(f"{k:02x}" for _, k in hits), error, label))
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], name, label) for i, c, e, label in out), key=str)


def found_codes(df, codes):
    rows = compression.code_table(df, codes).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256, r.label) for r in rows), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, spread, (6, dim))
    out = []
    for k in range(n):
        v = (centers[k % 6] + rng.normal(0, 0.1, dim)).astype(np.float32)
        out.append((k * 7 % n, [float(x) for x in v], None if k % 5 == 0 else k % 3))
    return out


@pytest.mark.parametrize("spread, scale", [(1.0, 1024), (0.0, 1024), (0.01, 4)])
def test_codes_equal_brute_force(spark, spread, scale):
    codes = compression.Codes(entries=20, rounds=3, scale=scale, rows=64)
    rows = vector_rows(150, 8, 1, spread)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert found_codes(df, codes) == brute_codes(rows, codes)


def test_codes_of_odd_rows(spark):
    codes = compression.Codes(entries=5, rounds=2)
    nan, inf = float("nan"), float("inf")
    rows = [
        (3, [1.0, 2.0, 3.0, 4.0], 1), (3, [1.0, 2.0, 3.0, 4.0], 1), (3, [0.0, 2.0, 3.0, 4.0], None),
        (4, None, 1), (5, [], 1), (6, [1.0, None, 2.0, 3.0], 1), (7, [nan, 1.0, 1.0, 1.0], 1), (8, [inf, 0.0, 0.0, 0.0], 2),
        (9, [1.0, 2.0, 3.0], 1), (1, [1.0] * 8, 2), (None, [-0.5, 0.25, -0.0001, 7.0], 2), (10, [3e38, -3e38, 1.0, 1.0], None),
        (11, [0.0, 0.0, 0.0, 0.0], 1), (12, [0.0, 0.0, 0.0, 0.0], 3),
    ]
    df = spark.createDataFrame(rows, VECTORS).repartition(2)
    for name in ("vector", "id", "code", "entry", "part", "of", "error"):
        df = df.withColumn(name, F.lit("clash"))
    assert found_codes(df, codes) == brute_codes(rows, codes)
    assert found_codes(df.limit(0), codes) == []
    assert found_codes(df.filter("vec_id = 8"), codes) == []
    assert CLASHING


def test_orchard_search_looks_at_a_part_of_the_entries(monkeypatch):
    rng = np.random.default_rng(5)
    entries = rng.integers(-1000, 1000, (256, 4))
    rows = entries[rng.integers(0, 256, 500)] + rng.integers(-20, 20, (500, 4))
    looked, plain = [0], compression.squared
    book = compression.Book(entries)
    monkeypatch.setattr(compression, "squared", lambda a, b: looked.__setitem__(0, looked[0] + len(a)) or plain(a, b))
    at, far = book.nearest(rows)
    exact = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (far == exact.min(axis=1)).all() and (at == exact.argmin(axis=1)).all()
    assert looked[0] < 500 * 256 / 4
