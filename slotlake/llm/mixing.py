"""Mixing sources to target weights by a low-discrepancy schedule (native)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotlake.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949  # fractional part of the golden ratio


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in code point order (null last), repeating. The mix
    takes `share` of all words; no source gives more than `repeats` times its own."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    repeats: int = 2
    seed: str = "mix"
    max_slots: int = 1 << 18  # sets the words per block; all blocks are of one size
    buckets: int = 4096  # for ranking a source's documents in parts
    bins: int = 1024  # of the unit interval, for the join of points and intervals


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """idx, source, source_size, target, quota and the share of the unit interval [lo, hi).

    With level L, a source's target is the lesser of its cap and L times its weight;
    sorted by cap / weight, those at their cap come first, and L follows from what
    these leave for the others. The table has one row per source.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    sources = sources.withColumn("idx", F.row_number().over(in_order) - 1).withColumn(
        "weight", F.get(weights, F.col("idx") % len(mix.weights))
    )
    by_ratio = Window.orderBy("ratio", "idx")
    everything = Window.partitionBy()
    cap = mix.repeats * F.col("source_size")
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    return (
        sources.withColumn("cap", cap.cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(mix.share))
        .withColumn(
            "before",
            F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        )
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
        .withColumn("capped", capped)
        .withColumn(
            "level",
            F.max(F.when(~F.col("capped"), F.col("level"))).over(everything),
        )
        .withColumn(
            "target",
            F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight")),
        )
        .withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("cap").cast("long")))
        .withColumn("sum", F.sum("quota").over(everything))
        .withColumn("hi", F.sum("quota").over(in_order) / F.greatest("sum", F.lit(1)))
        .withColumn("lo", F.col("hi") - F.col("quota") / F.greatest("sum", F.lit(1)))
        .select("idx", "source", "source_size", "target", "quota", "sum", "lo", "hi")
    )


def schedule(sources: DataFrame, block: int, slots: int, mix: Mix) -> DataFrame:
    """slot, idx, rank: which block of which source each slot of the mix takes.

    Slot i takes the source in whose interval the point frac((i + 1/2) * golden)
    falls, and of it the next block. The points give every source its share up to a
    few slots over any stretch; blocks of the quota that they leave over at the end
    take slots behind the others, and a source past its quota takes no more.
    """
    spark = sources.sparkSession
    point = (F.col("id") + 0.5) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point"))
    points = points.withColumn("bin", F.floor(F.col("point") * mix.bins))
    needed = F.ceil(F.col("quota") / F.lit(block)).cast("long")
    taking = sources.filter("quota > 0").select("idx", "lo", "hi", needed.alias("needed"))
    bins = F.sequence(
        F.floor(F.col("lo") * mix.bins), F.least(F.floor(F.col("hi") * mix.bins), F.lit(mix.bins - 1))
    )
    intervals = taking.withColumn("bin", F.explode(bins))
    hit = (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))
    ranked = (
        points.join(intervals, "bin")
        .filter(hit)
        .withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy("slot")) - 1)
        .filter(F.col("rank") < F.col("needed"))
        .select("slot", "idx", F.col("rank").cast("long").alias("rank"))
    )
    given = ranked.groupBy("idx").agg(F.count(F.lit(1)).alias("given"))
    left = (
        taking.join(given, "idx", "left")
        .withColumn("given", F.coalesce("given", F.lit(0)))
        .filter(F.col("given") < F.col("needed"))
        .select("idx", F.explode(F.sequence(F.col("given"), F.col("needed") - 1)).alias("rank"))
    )
    # (rank, idx) pairs in one number, behind all scheduled slots
    tail = left.select(
        (F.lit(slots) + F.col("rank") * F.lit(1 << 24) + F.col("idx")).alias("slot"), "idx", "rank"
    )
    return ranked.unionByName(tail)


def shuffled(sized: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """Adds idx, quota, source_size, target, `ordinal` and the first word `at` of each
    document in its source's shuffled stream.

    The order is that of a hash of doc_id. A source may hold any share of the rows,
    so its documents are summed within hash ranges, and the ranges' sums give the
    offsets of each range.
    """
    joined = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(
        sized["*"], "idx", "source_size", "target", "quota"
    )
    joined = joined.withColumn("range", F.floor(F.col("key") / F.lit((1 << 60) // mix.buckets)))
    sums = joined.groupBy("idx", "range").agg(F.sum("size").alias("n_words"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("idx").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = sums.select(
        "idx",
        "range",
        F.coalesce(F.sum("n_words").over(before), zero).alias("base_words"),
        F.coalesce(F.sum("n").over(before), zero).alias("base"),
    )
    inside = Window.partitionBy("idx", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        joined.withColumn("words_ahead", F.coalesce(F.sum("size").over(ahead), zero))
        .withColumn("number", F.row_number().over(inside) - 1)
        .join(bases, ["idx", "range"])
        .withColumn("at", F.col("base_words") + F.col("words_ahead"))
        .withColumn("ordinal", F.col("base") + F.col("number"))
        .drop("range", "base_words", "base", "words_ahead", "number")
    )


def plan_mix(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: doc_id, size, source, source_size, target, idx, ordinal, one row per
    document. pieces: slot, idx, ordinal, doc_id, epoch, first, last: the words
    [first, last) of a document that a slot's block takes; a source whose quota is
    above its size is read again from its start (epoch 1 and so on).

    Size counts the words of the whole text; a null or empty text has size 0 and is
    taken 0 times. A null source is a source. Repeated rows are documents of their
    own; which of two equal rows comes first makes no difference. Without words the
    mix is empty. Other columns are not looked at.
    """
    sized = docs.select(
        "doc_id", "source", words_of(F.col("text")).alias("size"),
        F.conv(
            F.substring(F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("doc_id").cast("string"))), 1, 15),
            16, 10,
        ).cast("long").alias("key"),
    )
    sized = materialize(sized, "mix-sizes")
    sources = materialize(source_targets(sized, mix).coalesce(1), "mix-sources")
    total = sources.agg(F.max("sum")).first()[0] or 0
    block = max(1, -(-total // mix.max_slots))
    slots = schedule(sources, block, -(-total // block), mix)
    stream = materialize(shuffled(sized, sources, mix), "mix-stream")
    start = F.col("epoch") * F.col("source_size") + F.col("at")
    pieces = (
        stream.filter("size > 0")
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(mix.repeats)])))
        .withColumn("start", start)
        .withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("quota")))
        .filter("start < stop")
        .withColumn("block", F.lit(block).cast("long"))
        .withColumn("rank", F.explode(F.expr("sequence(start div block, (stop - 1) div block)")))
        .join(slots, ["idx", "rank"])
        .select(
            "slot", "idx", "ordinal", "doc_id", "epoch",
            (F.greatest("start", F.col("rank") * F.col("block")) - F.col("start")).alias("first"),
            (F.least("stop", (F.col("rank") + 1) * F.col("block")) - F.col("start")).alias("last"),
        )
    )
    documents = stream.select("doc_id", "size", "source", "source_size", "target", "idx", "ordinal")
    return documents, pieces


def taken_words(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every document."""
    documents, pieces = plan_mix(docs, mix)
    words = pieces.select("idx", "ordinal", (F.col("last") - F.col("first")).alias("taken"))
    # A document's own row adds 0, so none is lost and one aggregate does.
    rows = documents.withColumn("taken", F.lit(0).cast("long")).unionByName(words, allowMissingColumns=True)
    attributes = ("doc_id", "size", "source", "source_size", "target")
    return (
        rows.groupBy("idx", "ordinal")
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in attributes], F.sum("taken").alias("taken"))
        .select(*attributes, "taken")
    )


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of the mix, with the columns of `docs`.

    A document comes once for each epoch that takes words of it. It keeps its text
    if all are taken, and otherwise has the taken words, joined by single blanks
    (only the last document of each source's stream is cut); n_chars follows.
    """
    documents, pieces = plan_mix(docs, mix)
    keys = ("doc_id", "source", "size")
    taken = pieces.groupBy("idx", "ordinal", "epoch").agg(F.max("last").alias("__last"))
    # Rows that agree in doc_id, source and size are told apart by a number.
    numbered = documents.withColumn(
        "__copy", F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal"))
    ).select(*[F.col(k).alias(f"__{k}") for k in keys], "__copy", "idx", "ordinal")
    wanted = numbered.join(taken, ["idx", "ordinal"]).drop("idx", "ordinal").withColumnsRenamed(
        {"__copy": "__number"}
    )
    rows = docs.withColumn("__words", words_of(F.col("text")))
    rows = rows.withColumn(
        "__copy",
        F.row_number().over(
            Window.partitionBy("doc_id", "source", "__words").orderBy(F.crc32(F.encode("text", "UTF-8")))
        ),
    )
    joined = rows.join(
        wanted,
        F.col("doc_id").eqNullSafe(F.col("__doc_id"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
        & (F.col("__copy") == F.col("__number")),
    )
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("__last").cast("int")), " ")
    text = F.when(F.col("__last") < F.col("__words"), cut).otherwise(F.col("text"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
