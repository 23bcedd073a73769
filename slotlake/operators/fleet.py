"""Status analytics over replicas: groups, winners, quorum, health.

Input rows are replicas: `cluster_id`, `idx`, `reachable`, `cluster_status`, `uuid`,
`seqno`, `has_valid_uuid`. Every result is an aggregate with partial aggregation, so
one cluster may hold any share of the rows; members are never collected into lists.
"""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.functions.names import deployment_message, error_class, replication_address

# Cluster states that count as good.
PRIMARY = "primary"
GOOD_STATES = ("primary", "synced")
MEMBER_STATES = ("primary", "non-primary")
SYNCED = "synced"


def valid_members(replicas: DataFrame) -> DataFrame:
    return replicas.where(F.col("has_valid_uuid") & (F.col("cluster_status") == PRIMARY))


def _newest_member() -> SparkColumn:
    """Index of the member with the highest seqno, the lowest index on ties.

    Both are packed into one decimal: an aggregate with a fixed-width buffer hashes
    its groups, one over a struct would sort all replicas.
    """
    digits = F.lit("1" + "0" * 19).cast("decimal(20,0)")
    top = F.lit(2**63 - 1).cast("decimal(19,0)")
    packed = F.col("seqno").cast("decimal(19,0)") * digits + (top - F.col("idx"))
    return (top - F.pmod(F.max(packed.cast("decimal(38,0)")), digits)).cast("bigint")


def cluster_groups(replicas: DataFrame) -> DataFrame:
    """Groups by uuid within a cluster: size, lowest seqno, and the member with the
    highest seqno (lowest index on ties)."""
    return (
        valid_members(replicas)
        .groupBy("cluster_id", "uuid")
        .agg(
            F.count("*").alias("node_count"),
            F.min("seqno").alias("min_seqno"),
            _newest_member().alias("source_idx"),
        )
    )


def cluster_members(replicas: DataFrame) -> DataFrame:
    """Members of every group, one row each, with the size of their group."""
    sizes = cluster_groups(replicas).select("cluster_id", "uuid", "node_count")
    members = valid_members(replicas).select("cluster_id", "uuid", "idx")
    return members.join(sizes, ["cluster_id", "uuid"])


def winning_cluster(
    replicas: DataFrame,
    workload: str = "",
    preferred_uuid: SparkColumn | None = None,
) -> DataFrame:
    """Group to join, one row per cluster that has one: the largest; on ties the
    preferred uuid if it is among them, then the lowest seqno, then the lowest uuid.
    """
    preferred = (
        F.when(F.col("uuid") == preferred_uuid, F.lit(0)).otherwise(F.lit(1))
        if preferred_uuid is not None
        else F.lit(0)
    )
    best = F.min(
        F.struct(
            (-F.col("node_count")).alias("size"),
            preferred.alias("preferred"),
            F.col("min_seqno"),
            F.col("uuid"),
            F.col("source_idx"),
        )
    )
    return (
        cluster_groups(replicas)
        .groupBy("cluster_id")
        .agg(best.alias("best"))
        .select(
            "cluster_id",
            F.col("best.uuid").alias("uuid"),
            F.col("best.source_idx").alias("source_idx"),
            replication_address(F.lit(workload), F.col("best.source_idx")).alias(
                "source_addr"
            ),
            (-F.col("best.size")).alias("node_count"),
        )
    )


def split_brain(replicas: DataFrame) -> DataFrame:
    """Per cluster: number of groups, and whether there is more than one."""
    return (
        cluster_groups(replicas)
        .groupBy("cluster_id")
        .agg(F.count("*").alias("groups"))
        .select("cluster_id", "groups", (F.col("groups") > 1).alias("split_brain"))
    )


def quorum(replicas: DataFrame) -> DataFrame:
    """Per cluster: reachable and primary replicas and distinct uuids among the
    latter."""
    primary = F.col("reachable") & (F.col("cluster_status") == PRIMARY)
    per_uuid = replicas.groupBy(
        "cluster_id", F.when(primary & (F.col("uuid") != ""), F.col("uuid")).alias("u")
    ).agg(
        F.count_if(F.col("reachable")).alias("reachable"),
        F.count_if(primary).alias("primary"),
    )
    return (
        per_uuid.groupBy("cluster_id")
        .agg(
            F.sum("reachable").alias("reachable"),
            F.sum("primary").alias("primary"),
            F.count("u").alias("uuids"),
        )
        .select(
            "cluster_id",
            "reachable",
            "primary",
            "uuids",
            ((F.col("reachable") > 0) & (F.col("primary") == F.col("reachable"))).alias(
                "has_quorum"
            ),
        )
    )


def lowest_available(replicas: DataFrame) -> DataFrame:
    """Lowest reachable index per cluster."""
    return (
        replicas.where("reachable")
        .groupBy("cluster_id")
        .agg(F.min("idx").alias("lowest_idx"))
    )


def healthy_sources(replicas: DataFrame) -> DataFrame:
    """Replicas that may answer for a cluster: member of it and fully synced."""
    return replicas.where(
        F.col("cluster_status").isin(*MEMBER_STATES) & (F.col("node_state") == SYNCED)
    )


# --- replica status: idx, status, cluster_status (may be NULL) -----------------


def replica_status(probes: DataFrame) -> DataFrame:
    """Probe results (`error` NULL on success) to `status` and a plain message."""
    kind = error_class(F.col("error"))
    return probes.withColumn(
        "status", F.when(F.col("error").isNull(), F.lit("online")).otherwise(kind)
    ).withColumn(
        "message",
        F.when(F.col("status") == "not_in_use", F.lit("not in use at present"))
        .when(F.col("status") == "error", F.lit("answered with an error"))
        .when(F.col("status") == "offline", F.lit("does not answer")),
    )


def _good_state() -> SparkColumn:
    return F.coalesce(F.col("cluster_status").isin(*GOOD_STATES), F.lit(False))


def fleet_status(replicas: DataFrame) -> DataFrame:
    """Per cluster: healthy, degraded or uninitialized."""
    online = F.col("status") == "online"
    has_state = online & F.col("cluster_status").isNotNull()
    counted = replicas.groupBy("cluster_id").agg(
        F.count_if(online).alias("online"),
        F.count_if(F.col("status") != "not_in_use").alias("in_use"),
        F.bool_or(has_state).alias("has_cluster"),
        F.bool_and(~has_state | _good_state()).alias("all_good"),
    )
    return counted.select(
        "cluster_id",
        "online",
        "in_use",
        F.when(~F.col("has_cluster"), F.lit("uninitialized"))
        .when((F.col("online") == F.col("in_use")) & F.col("all_good"), F.lit("healthy"))
        .otherwise(F.lit("degraded"))
        .alias("status"),
    )


def version_positions(deployments: DataFrame) -> DataFrame:
    """Nested versions (`cluster_id`, `versions` array<struct<message, containers>>) to
    a row per version; `idx` is its position, from 0."""
    return deployments.select("cluster_id", F.posexplode("versions").alias("idx", "_version")).select(
        "cluster_id", F.col("idx").cast("bigint").alias("idx"), "_version.message", "_version.containers"
    )


def with_deployment_messages(replicas: DataFrame, versions: DataFrame) -> DataFrame:
    """Add the deployment message of the same position to unhealthy replicas.

    `versions` holds one row per deployment version: `cluster_id`, `idx`,
    `message`, `containers` (array of texts), or one row per cluster with the array
    `versions`, whose positions count as `idx`.
    """
    if "versions" in versions.columns:
        versions = version_positions(versions)
    texts = versions.select(
        "cluster_id",
        "idx",
        deployment_message(F.col("message"), F.col("containers")).alias("_text"),
    )
    skip = (F.col("status") == "not_in_use") | (
        (F.col("status") == "online") & _good_state()
    )
    return (
        replicas.join(texts, ["cluster_id", "idx"], "left")
        .withColumn(
            "deployment_message",
            F.when(~skip & (F.col("_text") != ""), F.col("_text")),
        )
        .drop("_text")
    )


def query_counts(probes: DataFrame) -> DataFrame:
    """Queries answered per replica; errors of unused replicas are not shown."""
    unused = error_class(F.col("error")) == "not_in_use"
    return probes.select(
        "idx",
        F.when(F.col("error").isNull(), F.col("metric")).alias("query_count"),
        F.when(~unused, F.col("error")).alias("error"),
    )


def broadcast_outcome(results: DataFrame, by: str) -> DataFrame:
    """Per broadcast: ok, partial or error, from the status of its answers."""
    status = F.when(
        F.coalesce(F.col("error").contains("no such host"), F.lit(False)),
        F.lit("not_in_use"),
    ).otherwise(F.col("status"))
    counted = results.groupBy(by).agg(
        F.count_if(status == "success").alias("succeeded"),
        F.count_if(~status.isin("success", "not_in_use")).alias("failed"),
    )
    return counted.select(
        by,
        "succeeded",
        "failed",
        F.when((F.col("failed") > 0) & (F.col("succeeded") == 0), F.lit("error"))
        .when(F.col("failed") > 0, F.lit("partial"))
        .otherwise(F.lit("ok"))
        .alias("status"),
    )
