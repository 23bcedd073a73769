"""Documents to training tokens in five stages.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor left them, and
returns a DataFrame that is written as Parquet and read again for the next one. All
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotlake.llm import bpe, mixing, near_dup, pii, quality
from slotlake.llm.common import ship_package, table
from slotlake.session import materialize

TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship_package(spark)
    return quality.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    ship_package(spark)
    return near_dup.distinct_documents(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    ship_package(spark)
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each time that its source is read."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids: doc_id, source, lang, n_tokens, ids."""
    ship_package(spark)
    encoded = bpe.encode_column(docs, public_tokenizers.path(TOKENIZER))
    return encoded.select("doc_id", "source", "lang", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", encoding_stage),
]

# The model of the first stage and the tokenizer are beyond SQL; the tests compare
# the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
