"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.llm import linking
from slotlake.llm import textkit as kit
from slotlake.llm.common import arrow_schema, extended
from slotlake.session import materialize


@dataclass(frozen=True)
class Multi:
    """Shingles of `width` lower-cased words; pairs of at least `percent` % similarity
    are linked.

    A signature holds `values` MinHash values of eight bits. All pairs that differ in
    at most `most` of them are found: of `chunks` chunks, one must have at most
    most // chunks = 1 error, so each value of a chunk is left out once and what is
    left of the chunk is a key. At 85 % similarity the number of differences has mean
    10.8 and deviation 3.0, and exceeds 25 for 6 pairs in a million. A task compares
    `block` sets with as many others.
    """

    width: int = 3
    percent: int = 85
    values: int = 72
    chunks: int = 13
    most: int = 25
    block: int = linking.BLOCK_SETS

    def bounds(self) -> list[int]:
        """Where the chunks begin and end."""
        if self.most // self.chunks != 1:
            raise ValueError("a chunk must be allowed one error")
        return [self.values * k // self.chunks for k in range(self.chunks + 1)]


def signature(shingles: np.ndarray, n: int) -> bytes:
    """n MinHash values, eight bits of each."""
    return kit.mix(linking.minima(shingles, n)).astype(np.uint8).tobytes()


def sign(multi: Multi, schema: pa.Schema):
    """mapInArrow function: fingerprint, size and signature of each shingle set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kit.blocks(batches, "text"):
            sets = linking.shingle_sets(block["text"], multi.width, lower=True)
            yield kit.record(
                schema, block["doc_id"],
                [linking.fingerprint(s) if len(s) else None for s in sets],
                [len(s) for s in sets],
                [signature(s, multi.values) if len(s) else None for s in sets],
            )

    return run


def chunk_keys(multi: Multi):
    """mapInArrow function: key, id for each chunk and each value of it that may err."""
    schema = arrow_schema("key long, id long")
    bounds = multi.bounds()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint8).reshape(-1, multi.values)
            ids = batch["id"].to_numpy()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                place = kit.mix(np.arange(a, b, dtype=np.uint64) + np.uint64(1))
                part = kit.mix(sig[:, a:b].astype(np.uint64) + place[None, :])
                # A sum of mixed values, so that a value is left out by taking it off.
                total = part.sum(axis=1, dtype=np.uint64)
                for k in range(b - a):
                    key = kit.mix((total - part[:, k]) ^ place[k])
                    yield kit.record(schema, key.view(np.int64), ids)

    return run


def find_components(docs: DataFrame, multi: Multi = Multi()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Two documents are linked if the Jaccard similarity of their sets of 3-word shingles
    (A-Z as a-z) is at least 0.85; component_id is the smallest doc_id that links lead
    to, and kept says that it is the row's own.

    A null or empty text, or one without words, has no shingle and is linked with
    nothing; one of 1 or 2 words has one shingle of them all. Rows without a doc_id take
    part; their component_id is null if no row of their component has a doc_id, and kept
    then. Repeated rows are copies of each other. Other columns are not looked at; an
    empty table gives no rows.

    Copies count once in the search. Sets that meet in a chunk are compared by
    signature, and every pair of a component of those exactly, by their sets.
    """
    ddl = extended(docs.select("doc_id").schema, "fp binary, n_shingles long, sig binary")
    signed = docs.select("doc_id", "text").mapInArrow(sign(multi, arrow_schema(ddl)), ddl)
    signed = materialize(signed, "near-signed")
    sets = (
        signed.filter(F.col("fp").isNotNull())
        .groupBy("fp")
        .agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("first_doc"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    sets = materialize(sets, "near-sets")  # ids are fixed by writing them
    keyed = sets.select("id", "sig").mapInArrow(chunk_keys(multi), "key long, id long")
    graph, _ = linking.candidate_components(keyed, sets, "u1", multi.most, multi.block)
    make = lambda texts: linking.shingle_sets(texts, multi.width, lower=True)
    labels = linking.linked_components(docs, sets, graph, multi.percent, make, multi.block)
    named = sets.select("id", "fp", "first_doc").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = materialize(named.select("fp", "first_doc", F.coalesce("label", "id").alias("label")), "near-classes")
    least = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    found = signed.select("doc_id", "fp", "n_shingles").join(named.join(least, "label").drop("label", "first_doc"), "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
