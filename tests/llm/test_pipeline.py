"""The stages of the pipeline, one after another."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
from llm_rows import words

import __spark_entry__ as entry
from slotlake.llm import bpe, mixing, near_dup, pii, quality
from slotlake.session import materialize


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_stages_take_effect(spark, sf_dir, documents):
    docs, columns = documents, documents.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "test-stage")
        seen[name] = (before, docs)
        if name != "BPE encoding":
            assert docs.columns == columns

    before, after = seen["quality rules"]
    kept = {r.doc_id for r in quality.judge(before).collect() if r.kept}
    assert {r.doc_id for r in after.collect()} == kept and len(kept) < before.count()

    before, after = seen["n-gram Jaccard join"]
    classes = {r.class_id for r in near_dup.link(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(classes)

    before, after = seen["personal data"]
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.text == pii.redacted(texts[r.doc_id])

    before, after = seen["mixing sources"]
    taken = {r.doc_id: r.taken for r in mixing.taken_words(before).collect()}
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += len(words(r.text))
    assert +got == +Counter(taken)

    before, after = seen["BPE encoding"]
    tokens = bpe.tokenizer(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = Counter((r.doc_id, tuple(tokens.encode(r.text, add_special_tokens=False).ids)) for r in before.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in after.collect()) == want


def test_whole_pipeline(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "source", "lang", "n_tokens", "ids"]
    assert rows.count() > 0


def test_pipeline_over_odd_rows(spark, edge_docs, no_docs, tmp_path):
    """Nulls, empty and very long texts, repeated rows and doc_ids, other columns."""
    edge_docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in rows} <= {None, *range(1, 10)} and all(len(r.ids) == r.n_tokens for r in rows)
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), "test-odd")
        assert docs.columns == edge_docs.columns, name
    no_docs.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
