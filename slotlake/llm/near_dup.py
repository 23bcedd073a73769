"""N-gram Jaccard join by a forest of MinHash prefix trees, with exact verification."""

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

VALUE = 4  # bytes of a MinHash value in a signature


@dataclass(frozen=True)
class Forest:
    """Shingles of `width` words; pairs of at least `percent` % similarity are linked.

    Each of `trees` tries sorts the signatures by labels of `depth` values. Sets that
    share a prefix of a label meet; prefixes are shortened by one value at a time until
    the chance to meet in some trie reaches `recall`, both for pairs at the threshold
    itself and for the pairs that were found. Sets that meet are candidates if they
    agree in `prune` of the values or more (at 80 % similarity, less is five standard
    deviations away). A task compares `block` sets with as many others.
    """

    width: int = 5
    percent: int = 80
    trees: int = 24
    depth: int = 7
    recall: float = 0.999
    prune: float = 0.65
    block: int = linking.BLOCK_SETS

    @property
    def values(self) -> int:
        return self.trees * self.depth

    def chance(self, similarity, depth: int):
        """That a pair shares a prefix in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values, the high halves of minima of multiply-add hashes."""
    return (linking.minima(shingles, n) >> np.uint64(32)).astype(">u4")


def sign(forest: Forest, schema: pa.Schema):
    """mapInArrow function: fingerprint, size and signature of each shingle set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kit.blocks(batches, "text"):
            sets = linking.shingle_sets(block["text"], forest.width)
            yield kit.record(
                schema, block["doc_id"],
                [linking.fingerprint(s) if len(s) else None for s in sets],
                [len(s) for s in sets],
                [signature(s, forest.values).tobytes() if len(s) else None for s in sets],
            )

    return run


def prefixes(sets: DataFrame, forest: Forest, depth: int) -> DataFrame:
    """id, key: the prefix of `depth` values of a set's label in each tree. Sorted by
    key, the sets below a node of a trie stand next to each other."""
    keys = F.array(
        *[
            F.xxhash64(
                F.lit(t), F.substring("sig", 1 + t * forest.depth * VALUE, depth * VALUE)
            )
            for t in range(forest.trees)
        ]
    )
    return sets.select("id", F.explode(keys).alias("key"))


def candidates(sets: DataFrame, forest: Forest) -> DataFrame:
    """node, label: candidate components, from prefixes that are as long as the target
    recall allows. A found pair of similarity s stands for 1 / chance(s) pairs."""
    threshold = forest.percent / 100
    most = int(forest.values * (1 - forest.prune))
    for depth in range(forest.depth, 0, -1):
        if depth > 1 and forest.chance(threshold, depth) < forest.recall:
            continue
        graph, far = linking.candidate_components(prefixes(sets, forest, depth), sets, ">u4", most, forest.block)
        near = F.greatest(1 - F.col("far") / forest.values, F.lit(threshold))
        chance = 1 - F.pow(1 - F.pow(near, depth), F.lit(float(forest.trees)))
        close = far.filter(F.col("far") <= forest.values * (1 - threshold))
        found, stand_for = close.agg(F.count(F.lit(1)), F.sum(1 / chance)).first()
        if depth == 1 or found >= forest.recall * (stand_for or 0.0):
            return graph


def verified(docs: DataFrame, sets: DataFrame, graph: DataFrame, forest: Forest) -> DataFrame:
    """id, links, label of each task that a candidate is in: all pairs of a component are
    compared exactly, block by block, as each link is counted."""
    make = lambda texts: linking.shingle_sets(texts, forest.width)
    wanted, shingles = linking.wanted_sets(docs, sets, graph, make, forest.block)
    rows = wanted.join(sets.select("id", "copies"), "id").select("id", "part", "blocks", "copies")
    rows = linking.block_pairs(rows, "id").select("part", "one", "two", "id", "own", "copies").join(shingles, "id")
    return linking.by_key(
        rows, ["part", "one", "two"], ["id"], linking.count_links(forest.percent), "id long, links long, label long"
    )


def classes(docs: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp of every row; fp, label, first_doc, copies, links of every set)."""
    ddl = extended(docs.select("doc_id").schema, "fp binary, n_shingles long, sig binary")
    signed = docs.select("doc_id", "text").mapInArrow(sign(forest, arrow_schema(ddl)), ddl)
    signed = materialize(signed, "near-signed")
    sets = (
        signed.filter(F.col("fp").isNotNull())
        .groupBy("fp")
        .agg(
            F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"),
            F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"),
        )
        .withColumn("id", F.monotonically_increasing_id())
    )
    sets = materialize(sets, "near-sets")  # ids are fixed by writing them
    found = materialize(verified(docs, sets, candidates(sets, forest), forest), "near-found")
    labels = linking.components(found.select(F.col("id").alias("a"), F.col("label").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = (
        sets.select("id", "fp", "copies", "first_doc")
        .join(links, "id", "left")
        .join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select("fp", F.coalesce("label", "id").alias("label"), "first_doc", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
    return signed.select("doc_id", "fp"), materialize(named, "near-classes")


def link(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, class_key of every document.

    Two documents are linked if the Jaccard similarity of their sets of 5-word
    shingles is at least 0.8; classes are the connected components. class_id is the
    smallest doc_id of the class (null if it has none), class_key a name that no other
    class has, even if rows with one doc_id have texts of different classes. n_links
    counts the documents that a document is linked to, copies included; n_copies those
    with the same set (its own row too).

    A null or empty text, or one without words, has no shingle, links to nothing and
    is a class of its own, with a null class_key; one of 1 to 4 words has one shingle of
    them all. Repeated rows are copies. Other columns are not looked at; an empty table
    gives no rows.

    Copies count once in the search. Every pair of a candidate component is compared
    exactly, block by block, so a component's links do not depend on which of its
    prefixes met.
    """
    signed, named = classes(docs, forest)
    least = named.groupBy("label").agg(F.min("first_doc").alias("class_id"), F.hex(F.min("fp")).alias("class_key"))
    named = named.join(least, "label").select(
        "fp", "class_id", "copies", "class_key", (F.col("copies") - 1 + F.col("links")).alias("n_links")
    )
    return signed.join(named, "fp", "left").select(
        "doc_id",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        "class_key",
    )


def distinct_documents(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row of each class of `link`, with all columns: one with the class's smallest
    doc_id, with null if no row of it has one. If several sets of the class have that
    doc_id, the one of least fingerprint is meant, and of rows that repeat it the least
    one stays. So every class keeps a row, also if its doc_id is that of another class.

    Rows without a word are classes of their own and all stay. Columns may have any
    names; an empty table gives no rows.

    The rows to drop are told by doc_id, so texts are not moved. Only rows whose doc_id
    is null or repeated are told by their shingles, too.
    """
    signed, named = classes(docs, forest)
    # Nulls are the largest here, so a row with a doc_id is taken if there is one.
    order = F.struct(F.col("first_doc").isNull(), F.col("first_doc"), F.col("fp"))
    chosen = named.groupBy("label").agg(F.min_by(F.struct("first_doc", "fp"), order).alias("c"))
    chosen = materialize(chosen.select(F.col("c.first_doc").alias("__doc"), F.col("c.fp").alias("__fp"), F.lit(True).alias("__kept")), "near-chosen")
    seen = signed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"))
    again = (F.col("n") > 1) | F.col("doc_id").isNull()
    seen = materialize(seen.select(F.col("doc_id").alias("__doc"), F.col("fp").alias("__fp"), again.alias("__again")), "near-seen")
    once = seen.filter(~F.col("__again") & F.col("__fp").isNotNull()).join(chosen, ["__doc", "__fp"], "left_anti").select("__doc")
    repeated = materialize(seen.filter("__again").select("__doc"), "near-repeated")
    gone = linking.small_side(materialize(once.unionByName(repeated), "near-gone"), "__doc")
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_anti")
    if repeated.isEmpty():
        return kept
    rows = docs.join(linking.small_side(repeated, "__doc"), F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    ddl = extended(rows.select(F.col("text").alias("text"), row.alias("row")).schema, "__fp binary")
    schema = arrow_schema(ddl)

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in kit.blocks(batches, "text"):
            sets = linking.shingle_sets(block["text"], forest.width)
            yield kit.record(
                schema, block["text"], block["row"], [linking.fingerprint(s) if len(s) else None for s in sets]
            )

    told = materialize(rows.select("text", row.alias("row")).mapInArrow(tell, ddl), "near-told")
    at = f"row.c{docs.columns.index('doc_id')}"
    match = F.col(at).eqNullSafe(F.col("__doc")) & (told["__fp"] == chosen["__fp"])
    taken = told.join(chosen, match).groupBy("__doc", chosen["__fp"]).agg(F.min("row").alias("row"))
    blank = told.filter(F.col("__fp").isNull()).select("row")
    back = [F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return kept.unionByName(taken.select("row").unionByName(blank).select(*back))
