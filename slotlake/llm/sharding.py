"""Sharding by a weighted hash tree: region, rack, shard (native)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree. `weight` is its share of the rows."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(shards: int, racks_per_region: int = 4, shards_per_rack: int = 4) -> list[Shard]:
    """Equal shards numbered from 0, filling one rack after another."""
    return [
        Shard(s // (racks_per_region * shards_per_rack), s // shards_per_rack, s)
        for s in range(shards)
    ]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and a rack of its own: no other node's
    weight changes, so rows move into the new shard and nowhere else."""
    last = [max((getattr(x, level) for x in tree), default=-1) + 1 for level in ("region", "rack", "shard")]
    return [*tree, Shard(*last, weight)]


LEVELS = ("region", "rack", "shard")


def children(tree: list[Shard], depth: int) -> dict[tuple[int, ...], dict[int, float]]:
    """By path of a node `depth` levels down: its children with their weights, a child's
    being the sum of those of its shards."""
    found: dict[tuple[int, ...], dict[int, float]] = {}
    for leaf in tree:
        path = tuple(getattr(leaf, level) for level in LEVELS[: depth + 1])
        own = found.setdefault(path[:-1], {})
        own[path[-1]] = own.get(path[-1], 0.0) + leaf.weight
    return found


def place(key: Column, tree: list[Shard]) -> Column:
    """struct(region, rack, shard) of a key.

    The key goes down the tree. At a node each child draws an exponential variate of
    its weight from hash(key, level, child), and the least draw is gone to; only the
    children of the nodes on the way draw. A draw depends on the key, the child and its
    weight alone, so if a weight changes, keys move at its ancestors only: into the
    subtree that grew, or out of the one that shrank. Within a subtree whose own
    weights stay the same no key that stays in it moves.
    """
    if not tree:
        raise ValueError("the tree has no shard")
    if any(leaf.weight <= 0 for leaf in tree):
        raise ValueError("weights must be positive")

    def least(depth: int, known: Column) -> Column:
        """Of an array of (child, weight): the child that the key goes to."""

        def draw(child: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(depth), child["id"]), 11)
            uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
            return F.struct((-F.log(uniform) / child["weight"]).alias("draw"), child["id"].alias("id"))

        return F.array_min(F.transform(known, draw))["id"]

    def options(of: dict[int, float]) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("weight")) for c, w in sorted(of.items())])

    def below(depth: int, parent: Column) -> Column:
        """The children of a node, looked up by its number."""
        pairs = [x for path, of in sorted(children(tree, depth).items()) for x in (F.lit(path[-1]), options(of))]
        return F.element_at(F.create_map(*pairs), parent)

    for depth in (1, 2):
        parents = list(children(tree, depth))
        if len({path[-1] for path in parents}) < len(parents):
            raise ValueError("a rack's number may be used in one region only")
    region = least(0, options(children(tree, 0)[()]))
    at = F.transform(F.array(region), lambda r: F.struct(r.alias("region"), least(1, below(1, r)).alias("rack")))
    at = F.transform(at, lambda x: F.struct(x["region"], x["rack"], least(2, below(2, x["rack"])).alias("shard")))
    return F.get(at, F.lit(0))


def with_slots(df: DataFrame, shard: str, order: list[Column], slot: str, buckets: int = 4096) -> DataFrame:
    """Adds a gapless number from 0 within each shard.

    Shards may hold any number of rows, so none is ranked in one task: rows are
    ranked within (shard, hash bucket), and the buckets' counts give the offsets.
    """
    bucket = "__bucket"
    cut = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = cut.groupBy(shard, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard).alias("__s"), F.col(bucket).alias("__b"), "__n").withColumn(
        "__base", F.coalesce(F.sum("__n").over(before), F.lit(0))
    )
    ranked = cut.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(shard, bucket).orderBy(*order))
    )
    joined = ranked.join(offsets, (F.col(shard) == F.col("__s")) & (F.col(bucket) == F.col("__b")))
    return joined.withColumn(slot, F.col("__base") + F.col("__rank") - 1).drop(
        bucket, "__s", "__b", "__n", "__base", "__rank"
    )


def shard_documents(docs: DataFrame, tree: list[Shard], grown: list[Shard]) -> DataFrame:
    """doc_id, size, text_crc32, region, rack, shard, slot, grown_shard of every document.

    size: UTF-8 bytes of the text plus 16. A null text has no bytes (size 16,
    checksum 0). Placement depends on doc_id alone: repeated rows share a shard
    and take slots of their own, a null doc_id is a key like any other. Other
    columns are not looked at. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        place(F.col("doc_id"), tree).alias("at"),
        place(F.col("doc_id"), grown)["shard"].alias("grown_shard"),
    ).select(
        "doc_id", "size", "text_crc32", "at.region", "at.rack", "at.shard", "grown_shard"
    )
    order = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    return with_slots(rows, "shard", order, "slot")
