"""Table status over replicas: presence per component, health, summaries.

`configured` has one row per table (`name`, optional `csv_path`), `listings` one row
per table a replica holds (`idx`, `name`, `in_cluster`), `replicas` one row per
replica (`idx`, `online`, `error`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.functions import names as NM


def with_defaults(
    configured: DataFrame, configs: DataFrame, slots: DataFrame
) -> DataFrame:
    """Attach cluster setting and live slot, with their defaults where unknown."""
    return (
        configured.join(configs.select("name", "cluster_main"), "name", "left")
        .join(slots.select("name", "slot"), "name", "left")
        .withColumn("cluster_main", F.coalesce("cluster_main", F.lit(True)))
        .withColumn("slot", F.when(F.col("slot") != "", F.col("slot")).otherwise(F.lit("a")))
    )


def with_membership(listings: DataFrame, members: DataFrame) -> DataFrame:
    """`in_cluster` flag from a list of clustered table names (`name`)."""
    flag = members.select("name").distinct().withColumn("_in", F.lit(True))
    return listings.join(flag, "name", "left").select(
        *listings.columns, F.coalesce("_in", F.lit(False)).alias("in_cluster")
    )


def with_schema(derived: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry row of a derived table name, through its base name."""
    return derived.withColumn("base", NM.base_name(F.col("name"))).join(
        registry.withColumnRenamed("name", "base"), "base", "left"
    )


def held_components(configured: DataFrame, listings: DataFrame) -> DataFrame:
    """Components of configured tables that replicas hold, one row per table and
    replica: presence and cluster flags of main, delta and unified table.

    Listings of tables nobody configured, and of the idle slot, drop out. Repeated
    listings are folded before the join.
    """
    held = listings.groupBy(
        "idx", NM.base_name(F.col("name")).alias("base"), F.col("name").alias("held")
    ).agg(F.bool_or("in_cluster").alias("in_cluster"))
    live = configured.select(F.col("name").alias("base"), "slot")
    tagged = held.join(live, "base").select(
        F.col("base").alias("name"),
        "idx",
        "in_cluster",
        (F.col("held") == NM.main_name(F.col("base"), F.col("slot"))).alias("main"),
        (F.col("held") == NM.delta_name(F.col("base"))).alias("delta"),
        (F.col("held") == F.col("base")).alias("unified"),
    )
    return (
        tagged.where("main or delta or unified")
        .groupBy("name", "idx")
        .agg(
            F.bool_or("main").alias("main_present"),
            F.bool_or(F.col("main") & F.col("in_cluster")).alias("main_in_cluster"),
            F.bool_or("delta").alias("delta_present"),
            F.bool_or(F.col("delta") & F.col("in_cluster")).alias("delta_in_cluster"),
            F.bool_or("unified").alias("unified_present"),
        )
    )


def table_status(
    configured: DataFrame, listings: DataFrame, replica_count: int
) -> DataFrame:
    """Status matrix: one row per configured table and replica index."""
    spread = configured.withColumn(
        "idx", F.explode(F.sequence(F.lit(0), F.lit(replica_count - 1)))
    ).withColumn("idx", F.col("idx").cast("bigint"))
    held = held_components(configured, listings)
    flags = [c for c in held.columns if c not in ("name", "idx")]
    return spread.join(held, ["name", "idx"], "left").select(
        *spread.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in flags]
    )


def with_replica_state(status: DataFrame, replicas: DataFrame) -> DataFrame:
    """Add `online` and `error`; an offline replica shows no component."""
    flags = [c for c in status.columns if c.endswith(("_present", "_in_cluster"))]
    joined = status.join(replicas.select("idx", "online", "error"), "idx", "left")
    online = F.coalesce("online", F.lit(False))
    return joined.select(
        *[c for c in status.columns if c not in flags],
        *[(F.col(c) & online).alias(c) for c in flags],
        online.alias("online"),
        "error",
    )


def table_health(status: DataFrame) -> DataFrame:
    """Per table: offline, healthy, partial or empty, over its online replicas."""
    complete = (
        F.col("main_present")
        & F.col("delta_present")
        & F.col("unified_present")
        & (~F.col("cluster_main") | F.col("main_in_cluster"))
        & F.col("delta_in_cluster")
    )
    online = F.col("online")
    counted = status.groupBy("name").agg(
        F.count_if(online).alias("online"),
        F.bool_and(~online | complete).alias("all_complete"),
        F.bool_or(online & (F.col("main_present") | F.col("delta_present"))).alias("any"),
    )
    return counted.select(
        "name",
        F.when(F.col("online") == 0, F.lit("offline"))
        .when(F.col("all_complete"), F.lit("healthy"))
        .when(F.col("any"), F.lit("partial"))
        .otherwise(F.lit("empty"))
        .alias("health"),
    )


def summary_counts(configured: DataFrame, health: DataFrame) -> DataFrame:
    """Totals over all tables: healthy ones and tables per live slot."""
    return configured.join(health, "name", "left").agg(
        F.count("*").alias("tables"),
        F.count_if(F.col("health") == "healthy").alias("healthy"),
        F.count_if(F.col("slot") == "a").alias("slot_a"),
        F.count_if(F.col("slot") == "b").alias("slot_b"),
    )


def missing_replicas(replicas: DataFrame, listings: DataFrame, table: str) -> DataFrame:
    """Replicas that lack one table; empty means it is everywhere."""
    holders = listings.where(F.col("name") == table).select("idx")
    return replicas.select("idx").join(holders, "idx", "left_anti")


def replication_gaps(listings: DataFrame, replica_count: int) -> DataFrame:
    """For every listed table: replicas that hold it and whether all do."""
    per_holder = listings.select("name", "idx").distinct()
    return per_holder.groupBy("name").agg(F.count("*").alias("holders")).select(
        "name", "holders", (F.col("holders") >= replica_count).alias("replicated")
    )
