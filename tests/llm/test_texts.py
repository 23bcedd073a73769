"""Language id, quality rules, personal data, WARC and BPE against plain Python."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import edge_rows, words
from pyspark.sql import functions as F

from slotlake.llm import bpe, language_id, pii, quality, textkit, warc

# --- language ---------------------------------------------------------------------


def test_held_out_accuracy(documents):
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(documents.filter(~held))
    rows = language_id.predict(documents, model).join(documents.select("doc_id", "lang"), "doc_id")
    rows = [r for r in rows.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert rows
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_words_come_before_ngrams_and_shorter_ngrams_last(spark):
    rows = [("the cat sat", "en"), ("le chat noir", "fr"), (None, "en"), ("no label", None)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    table = model.toArrow()
    assert set(table["level"].to_pylist()) == {0, 1, 2, 3, 4, 5}
    known = language_id.Model(table)
    langs, scores = known.classify(["cat", "CHATS", "no-one sat", "q", "", None, "12 ...", "漢字"], 5)
    assert langs[:3] == ["en", "fr", "en"]
    assert langs[4:7] == ["und"] * 3 and list(scores[4:7]) == [0, 0, 0]
    assert langs[7] in ("en", "fr")
    # an unseen word scores by its longest known n-grams
    read = language_id.Words.read(["chats"])
    keys, _ = read.ngrams(np.array([0]), 5)
    assert known.look_up(5, keys)[0].any()


def test_language_of_odd_rows(spark, edge_docs, no_docs):
    model = language_id.fit(edge_docs)
    rows = language_id.predict(edge_docs, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in edge_rows())
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {1, 2, 3}
    assert language_id.predict(no_docs, model).collect() == []
    empty = language_id.fit(no_docs)
    assert {r.lang_pred for r in language_id.predict(edge_docs, empty).collect()} == {"und"}


# --- quality ----------------------------------------------------------------------


def brute_counts(text):
    w = words(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    many = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def counts_of(df):
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return {(r.doc_id, tuple(r[f] for f in fields), r.base_failed) for r in df.collect()}


def brute_rows(rows):
    out = set()
    for doc_id, text, *_ in rows:
        c = brute_counts(text)
        out.add((doc_id, c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    return out


def test_base_counts_equal_brute_force(documents, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert counts_of(quality.judge(documents)) == brute_rows(rows)
    assert counts_of(quality.judge(edge_docs)) == brute_rows(edge_rows())
    assert quality.judge(no_docs).collect() == []


@given(st.lists(st.text(alphabet="ab \n#|é", max_size=60), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_counts_of_texts_side_by_side(texts):
    got = quality.base_counts(pa.array(texts), quality.Rules())
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[f][k]) for f in fields) for k in range(len(texts))] == [brute_counts(t) for t in texts]


def brute_grams(text):
    symbols = [int(quality._symbol_table()[min(ord(c), 0xFFFF)]) if ord(c) <= 0xFFFF else 28 + ord(c) % 36 for c in text]
    packed, last = [], 0
    for s in symbols:
        if s or last:
            packed.append(s)
        last = s
    padded = [0, 0, 0, *packed]
    return [
        padded[k] << 18 | padded[k + 1] << 12 | padded[k + 2] << 6 | padded[k + 3]
        for k in range(len(packed))
    ]


@given(st.lists(st.text(alphabet="abÉ \n.7😀漢", max_size=20), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_grams_of_texts_side_by_side(texts):
    keys, of = quality.grams(pa.array(texts))
    assert [[int(x) for x in keys[of == k]] for k in range(len(texts))] == [brute_grams(t) for t in texts]


def brute_kneser_ney(grams):
    """p(symbol | three before) of interpolated modified Kneser-Ney, as a function."""
    counts = {4: Counter(grams)}
    for order in (3, 2, 1):
        counts[order] = Counter(k & ((1 << 6 * order) - 1) for k in counts[order + 1])
    discounts = {}
    for order, table in counts.items():
        n = [sum(v == k for v in table.values()) for k in range(1, 5)]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
            discounts[order] = [max(0.05, min(r, k - 0.05)) for k, r in zip((1, 2, 3), raw, strict=True)]
        else:
            discounts[order] = [0.5, 1.0, 1.5]

    def p(key, order):
        if not order:
            return 1 / 64
        key &= (1 << 6 * order) - 1
        context = {k: v for k, v in counts[order].items() if k >> 6 == key >> 6}
        lower = p(key, order - 1)
        if not context:
            return lower
        off = lambda v: discounts[order][min(v, 3) - 1]
        total = sum(context.values())
        own = max(context[key] - off(context[key]), 0) / total if key in context else 0
        return own + sum(map(off, context.values())) / total * lower

    return p


def test_model_equals_brute_force_and_sums_to_one(spark):
    text = "the cat sat on the mat and the dog ran to the cat while a hen ate the corn " * 3 + "zebra quick."
    grams = brute_grams(text)
    rows = [("en", k, n) for k, n in Counter(grams).items()]
    table = quality.kneser_ney(spark.createDataFrame(rows, "lang string, key int, n long")).toArrow()
    model = quality.load_models(table)["en"]
    p = brute_kneser_ney(grams)
    keys = np.array(grams[:60] + [0x3FFFF, 5 << 18 | 9, 20 << 12 | 8 << 6 | 5], np.int64)
    assert np.allclose(np.exp(model.log_p(keys)), [p(int(k), 4) for k in keys], rtol=1e-4)
    for context in {k >> 6 for k in grams[:20]} | {0x3FFFF}:
        assert abs(np.exp(model.log_p((context << 6) + np.arange(64))).sum() - 1) < 1e-3


def test_verdicts(spark, documents, edge_docs, no_docs):
    judged = quality.judge(documents).collect()
    assert not any(r.kept and r.base_failed for r in judged)
    kept = quality.kept_documents(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in judged if r.kept)
    odd = quality.kept_documents(edge_docs)
    assert odd.columns == edge_docs.columns
    want = Counter(str(r.doc_id) for r in quality.judge(edge_docs).collect() if r.kept)
    assert Counter(str(r.doc_id) for r in odd.collect()) == want
    assert quality.kept_documents(no_docs).collect() == []


def test_noise_is_rejected_and_clean_text_kept(spark, documents):
    clean = documents
    noise = documents.filter("lang = 'en' AND n_chars BETWEEN 600 AND 1200").limit(1).selectExpr(
        "doc_id + 100000 AS doc_id",
        "concat_ws(' ', transform(sequence(1, 200), i -> substr(base64(unhex(sha2(string(i), 256))), 1, 7))) AS text",
        "lang", "source", "n_chars",
    )
    kept = {r.doc_id for r in quality.kept_documents(clean.unionByName(noise)).collect()}
    assert not any(k >= 100_000 for k in kept)
    assert len(kept) > 0.8 * clean.count()


def test_a_third_of_junk_leaves_the_filter_on(documents):
    clean = documents.filter("lang = 'en' AND n_chars > 300")
    marked = clean.withColumn("text", F.regexp_replace("text", r"(\w)(\s|$)", "$1%%%$2"))
    junk = marked.withColumn("doc_id", F.col("doc_id") + 100_000).limit(clean.count() // 2)
    judged = quality.judge(clean.unionByName(junk)).filter("NOT base_failed").collect()
    kept = lambda rows: sum(r.kept for r in rows) / len(rows)
    assert kept([r for r in judged if r.doc_id >= 100_000]) < 0.05
    assert kept([r for r in judged if r.doc_id < 100_000]) > 0.8


def test_small_model_budget_gives_the_same_verdicts(documents):
    few = quality.Rules(model_bytes=1)  # a language at a time
    rows = lambda df: sorted((r.doc_id, r.kept, round(r.log_perplexity or 0, 9)) for r in df.collect())
    assert rows(quality.judge(documents, few)) == rows(quality.judge(documents))


def respelled(text):
    """Every code point beyond white space replaced by another one of the same symbol."""
    other = {}
    for c in dict.fromkeys(text):
        if not c.isspace():
            symbol = quality.symbols_of(np.array([ord(c)]))[0]
            points = np.arange(0x4E00, 0xA000) if symbol > 27 else np.arange(0x100, 0xD800)
            points = points[quality.symbols_of(points) == symbol]
            other[c] = chr(points[0]) if len(points) else c.upper()
    return "".join(other.get(c, c) for c in text)


def cyrillic_rows(n):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(chr(0x430 + k) for k in rng.integers(0, 32, rng.integers(2, 9))) for _ in range(60)]
    return [(k, " ".join(rng.choice(vocabulary, 80)), "ru") for k in range(n)]


def test_code_points_of_one_symbol_are_told_apart(spark):
    rows = cyrillic_rows(40)
    other = respelled(rows[0][1])
    assert brute_grams(other) == brute_grams(rows[0][1]) and not set(other) & set(rows[0][1]) - {" "}
    docs = spark.createDataFrame([*rows, (100, other, "ru")], "doc_id long, text string, lang string")
    for rules in (quality.Rules(), quality.Rules(model_bytes=1, block_bytes=2000)):
        got = {r.doc_id: r for r in quality.judge(docs, rules).collect()}
        assert got[0].kept and not got[100].kept and not got[100].base_failed
        assert got[100].log_perplexity > got[0].log_perplexity + 0.5
        assert {r.doc_id for r in quality.kept_documents(docs, rules).collect()} == {k for k, r in got.items() if r.kept}


def brute_points(text):
    """The 4-grams of a text as tuples; white space in a row is one blank, as is its start."""
    packed = ["" if quality.symbols_of(np.array([ord(c)]))[0] == 0 else c for c in text]
    packed = [c for k, c in enumerate(packed) if c or (k and packed[k - 1])]
    padded = ["", "", "", *packed]
    return [tuple(padded[k : k + 4]) for k in range(len(packed))]


def brute_spelling(texts):
    """p(code point | its symbol and the three before it), as a function. A 4-gram counts
    once for each text that has it but one."""
    having = Counter(g for text in texts for g in set(brute_points(text)))
    counts = {4: Counter({g: n - 1 for g, n in having.items() if n > 1})}
    for order in (3, 2, 1):
        counts[order] = Counter(g[-order:] for g in counts[order + 1])
    symbol = lambda c: int(quality.symbols_of(np.array([ord(c)]))[0])
    own = {order: Counter({g: n for g, n in table.items() if g[-1]}) for order, table in counts.items()}
    discounts = {}
    for order, table in own.items():
        n = [sum(v == k for v in table.values()) for k in range(1, 5)]
        discounts[order] = [0.5, 1.0, 1.5]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
            discounts[order] = [max(0.05, min(r, k - 0.05)) for k, r in zip((1, 2, 3), raw, strict=True)]

    def p(gram, order=4):
        if not order:
            return 1 / quality.members()[symbol(gram[-1])]
        gram = gram[-order:]
        alike = {g: n for g, n in own[order].items() if g[:-1] == gram[:-1] and symbol(g[-1]) == symbol(gram[-1])}
        if not alike:
            return p(gram, order - 1)
        off = lambda v: discounts[order][min(v, 3) - 1]
        found = alike[gram] - off(alike[gram]) if gram in alike else 0
        return (found + sum(map(off, alike.values())) * p(gram, order - 1)) / sum(alike.values())

    return lambda gram: p(gram) if gram[-1] else 1.0


def test_perplexity_equals_brute_force(spark):
    texts = [
        "The Cat sat on the MAT, and the Dog ran to the cat while 12 hens ate 345 corns of 1 mat.",
        "Ünïcode wörds and 漢字 and 漢語 and emoji 😀 or 😁 in a\t text of several words\n\nhere, here",
        "the DOG and the 漢 mat: a Hen of the Corn \0 sat on 9 mats in several words and 7 texts",
    ]
    marked = "#a #b %ц $d &e |f <g> #h *i the Mat 漢7 and 77 new ones 😀 are not counted but judged"
    docs = [*enumerate(texts), (3, marked)]
    symbols = brute_kneser_ney([g for t in texts for g in brute_grams(t)])
    points = brute_spelling(texts)
    want = {}
    for k, text in docs:
        logs = [np.log(symbols(a, 4)) + np.log(points(b)) for a, b in zip(brute_grams(text), brute_points(text), strict=True)]
        want[k] = -sum(logs) / len(logs)
    df = spark.createDataFrame([(k, t, "en") for k, t in docs], "doc_id long, text string, lang string")
    for rules in (quality.Rules(), quality.Rules(model_bytes=1, block_bytes=150)):
        got = {r.doc_id: r.log_perplexity for r in quality.judge(df, rules).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in got)


def test_code_points_of_all_planes_side_by_side():
    text = "".join(map(chr, [*range(0x3400, 0xD7A0), *range(0x20000, 0x2B000)]))
    types = quality.Types(pa.array(["a b", text]))
    context, point, _, index = types.different(np.arange(len(types.keys)))
    found = [*zip(types.of.tolist(), context[index].tolist(), point[index].tolist(), strict=True)]
    values = [0, 0, 0, *map(ord, text)]
    want = [(1, values[k] << 42 | values[k + 1] << 21 | values[k + 2], values[k + 3]) for k in range(len(text))]
    assert found[:3] == [(0, 0, 97), (0, 97, 0), (0, 97 << 21, 98)]
    assert found[3:] == want


def test_models_that_are_joined_keep_the_same_rows(documents, edge_docs):
    few = quality.Rules(model_bytes=1, block_bytes=50_000)
    for docs in (documents, edge_docs):
        got = quality.kept_documents(docs, few)
        assert got.columns == docs.columns
        rows = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
        assert rows(got) == rows(quality.kept_documents(docs))


# --- personal data ----------------------------------------------------------------

# The base grammars of the contract.
GRAMMARS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def brute_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(GRAMMARS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19
                and sum(int(c) if j % 2 == 0 else sum(divmod(2 * int(c), 10)) for j, c in enumerate(reversed(d))) % 10 == 0,
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if fine:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


@given(st.text(alphabet="0123456789.+-() @ab_%é\n", max_size=50))
@settings(max_examples=3000, deadline=None)
def test_base_spans_equal_the_grammars(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE] == brute_spans(text)


def test_detected_rows(documents, edge_docs, no_docs):
    for rows, df in (([(r.doc_id, r.text) for r in documents.collect()], documents), (edge_rows(), edge_docs)):
        want = Counter()
        for doc_id, text, *_ in rows:
            spans = brute_spans(text or "")
            digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            want[(doc_id, *[sum(s[0] == k for s in spans) for k in pii.BASE], digest)] += 1
        got = pii.detect(df).collect()
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.detect(no_docs).collect() == []


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00.", {"iban"}),
        ("iban DE89370400440532013001", set()),  # fails its check
        ("Account number: 12345678 is closed", {"account"}),
        ("the account of 12345678 days", set()),
        ("ssn: 078-05-1120", {"account"}),
        ("ftp://bob:secret@host/x", {"login"}),
        ("http://host/a:b@c", set()),
        ("no data here", set()),
    ],
)
def test_added_kinds(text, kinds):
    assert {s[0] for s in pii.find(text) if s[0] not in pii.BASE} == kinds


def test_redaction(edge_docs):
    out = pii.redact(edge_docs)
    assert out.columns == edge_docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[8].text == "Write to <EMAIL> or <PHONE>, card <CARD>, host <IP>."
    assert rows[8].n_chars == len(rows[8].text)
    assert rows[1].text is None and rows[2].text == ""


# --- WARC -------------------------------------------------------------------------


def test_pages_come_back(spark, sf_dir, tmp_path):
    odd = [
        (7_000_001, "http://A.example.org/x y\n", "same"), (7_000_002, "http://a.example.org/x", "same"),
        (7_000_000, None, "same"), (7_000_003, "", None), (7_000_004, "u", ""),
        (7_000_005, "https://b.example.org", "WARC/1.1\r\nContent-Length: 5\r\n\r\nbody\r\n\r\nWARC/1.1\r\n\r\n"),
        (7_000_006, "https://b.example.org", "é漢😀" * 50_000),
        (7_000_007, "x", "twice"), (7_000_007, "x", "twice"), (7_000_008, "y", "twice"), (None, "z", "twice"), (None, "z", "alone"),
    ]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    pages = pages.unionByName(spark.createDataFrame(odd, pages.schema)).withColumn("payload", F.lit("clash"))
    archive = warc.Archive(records_per_file=5, range_rows=7, sample=2)
    got = warc.archive_round_trip(pages.repartition(3), archive, str(tmp_path / "w")).collect()
    first, want = {}, Counter()
    rows = [(r.page_id, r.html) for r in pages.collect()]
    for page_id, html in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    for page_id, html in rows:
        data = (html or "").encode()
        lead = first.get(html or "")
        revisit = lead is not None and page_id != lead
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[page_id, len(data), digest, "revisit" if revisit else "response", lead if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.intact for r in got)
    ordered = sorted(got, key=lambda r: r.position)
    assert [r.position for r in ordered] == list(range(len(got)))
    keys = [(r.urlkey, r.date, r.page_id is not None, r.page_id or 0) for r in ordered]
    assert keys == sorted(keys)


def test_small_payloads_are_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = warc.archive_round_trip(pages, warc.Archive(min_bytes=3), str(tmp_path / "w")).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages, path=str(tmp_path / "w")).collect() == []


def test_records_over_several_members():
    one = b"WARC/1.1\r\nContent-Length: 3\r\n\r\na\n\n\r\n\r\n"
    packed = gzip.compress(one) + gzip.compress(one * 2)
    assert [b for _, b in warc.records(packed)] == [b"a\n\n"] * 3
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(one[:-6])))


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
@settings(max_examples=300, deadline=None)
def test_loser_tree_merges(runs):
    assert list(warc.LoserTree([iter([(x,) for x in sorted(r)]) for r in runs])) == sorted((x,) for r in runs for x in r)


# --- BPE --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def library(path, text):
    tokens = bpe.tokenizer(path)
    ids = tokens.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), tokens.decode(ids, skip_special_tokens=False), len(ids)


ODD_TEXTS = (
    "", " ", "\n\n", "Hello World's can't", "<|endoftext|> a <|startoftext|>b<|endoftext|>", "á ́b   c d",
    "İstanbul ΣΑΣ", "漢字かな 1234567 ... !!!", "x" * 3000, "no blank" * 700, "tab\tand\rline\x0bfeed\x0c", "😀" * 400, "a\x1cb \x85 c",
)


@pytest.mark.parametrize("bits", [2, 5, 7])
def test_texts_equal_the_library(vocabulary, bits):
    cache = bpe.ChunkCache(vocabulary, bpe.Chunking(bits=bits))
    texts = [*ODD_TEXTS, " ".join(ODD_TEXTS), *ODD_TEXTS]
    got = cache.encode(*textkit.utf8(pa.array(texts)))
    assert got == [library(vocabulary, t) for t in texts]


@given(st.lists(st.text(alphabet="abT' \n.7é́<|> 😀", max_size=60), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_random_texts_equal_the_library(vocabulary, texts):
    cache = bpe.cache_of(vocabulary, bpe.Chunking(bits=3, chunks=20, pieces=20))
    assert cache.encode(*textkit.utf8(pa.array(texts))) == [library(vocabulary, t) for t in texts]


def test_shared_passages_are_encoded_once(vocabulary):
    passage = " ".join(f"word{k}" for k in range(400))
    cache = bpe.ChunkCache(vocabulary, bpe.Chunking())
    cache.encode(*textkit.utf8(pa.array(["first " + passage, "another start " + passage])))
    assert cache.reused > 5


def test_pieces_are_encoded_many_in_one(vocabulary, monkeypatch):
    """Also where the mark between them is one of them; words met before the cache was
    full are not encoded again."""
    cache = bpe.ChunkCache(vocabulary, bpe.Chunking(pieces=300))
    calls, plain = [], cache._encoded
    monkeypatch.setattr(cache, "_encoded", lambda texts: calls.append(texts) or plain(texts))
    often = " ".join(f"often{k}x" for k in range(100))
    texts = [often + " " + " ".join(f"{t}w{k} {bpe.MARK}" for k in range(150)) for t in "abcdefgh"]
    for text in texts:
        assert cache.encode(*textkit.utf8(pa.array([text]))) == [library(vocabulary, text)]
    assert sum(map(len, calls)) < 600  # of 1301 words
    assert sum(t.count("often7x") for c in calls for t in c) == 1 + sum(c.count("often7x") for c in calls)
    assert len(cache.pieces) <= 300 and len(cache.older) <= 300


def test_encoded_rows(vocabulary, documents, edge_docs, no_docs):
    for df in (documents, edge_docs):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids, decoded, n = library(vocabulary, r.text or "")
            want[r.doc_id, n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
        got = bpe.digests(df, vocabulary).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
        for r in bpe.encode_column(df, vocabulary).collect():
            assert r.n_tokens == len(r.ids)
    assert bpe.digests(no_docs, vocabulary).collect() == []
