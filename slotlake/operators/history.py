"""Command log: active operations, guards, merged history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.functions.names import env_int, env_list, env_value

# Command type, stages and variable names in the log.
RUN_TYPE = "runCronWorkload"
ACTIVE_STAGES = ("pending", "running")
BACKUP_ACTIONS = ("backup", "restore")


def with_env(commands: DataFrame) -> DataFrame:
    """Add the named variables as columns: action, table, dataset, kind, file and
    source replica. The nested list is flattened once for all of them."""
    env = F.col("_env")
    return commands.withColumn("_env", env_list(F.col("spec.containerOverrides"))).select(
        *commands.columns,
        env_value(env, "ACTION").alias("action"),
        env_value(env, "TABLE_NAME").alias("table_name"),
        env_value(env, "DATASET").alias("dataset"),
        env_value(env, "TYPE").alias("kind"),
        env_value(env, "RESTORE_FILE").alias("filename"),
        env_int(env, "REPAIR_SOURCE_REPLICA").alias("source_replica"),
    )


def match_terms(df: DataFrame, terms: dict[str, object], match: str = "all") -> DataFrame:
    """Rows where all (or any) of `column = value` hold; no terms, no filter."""
    if not terms:
        return df
    tests = [F.col(k) == F.lit(v) for k, v in terms.items()]
    join = (lambda a, b: a & b) if match == "all" else (lambda a, b: a | b)
    return df.where(reduce(join, tests))


def active_commands(commands: DataFrame) -> DataFrame:
    return commands.where(F.col("lifecycleStage").isin(*ACTIVE_STAGES))


def active_imports(commands: DataFrame) -> DataFrame:
    """Pending or running imports of a named table."""
    return (
        with_env(active_commands(commands).where(F.col("type") == RUN_TYPE))
        .where((F.col("action") == "import") & (F.col("table_name") != ""))
        .select("table_name", F.col("id").alias("command_id"), "lifecycleStage")
    )


def active_repairs(commands: DataFrame) -> DataFrame:
    return (
        with_env(active_commands(commands).where(F.col("type") == RUN_TYPE))
        .where(F.col("action") == "repair")
        .select(F.col("id").alias("command_id"), "source_replica", "lifecycleStage")
    )


def untracked_operations(local_ops: DataFrame, tracked: DataFrame) -> DataFrame:
    """Local operations (`table_name`, `action`, `phase`) whose table is not in the
    command log yet."""
    return local_ops.join(tracked.select("table_name"), "table_name", "left_anti")


def is_busy(commands: DataFrame, actions: tuple[str, ...], table: str | None = None) -> bool:
    """Guard against a second operation: is one of these actions active (for this
    table)? Stops at the first hit."""
    hits = with_env(active_commands(commands)).where(F.col("action").isin(*actions))
    if table is not None:
        named = F.when(F.col("dataset") != "", F.col("dataset")).otherwise(
            F.col("table_name")
        )
        hits = hits.where(named == table)
    return not hits.isEmpty()


def command_history(imports: DataFrame, backups: DataFrame) -> DataFrame:
    """Import and repair commands with backup and restore commands, one shape.

    Rows without the table they need drop out; a file name is kept on restores only.
    """
    first = (
        with_env(imports)
        .where(
            (F.col("action") == "repair")
            | ((F.col("action") == "import") & (F.col("table_name") != ""))
        )
        .select(
            "id",
            "action",
            F.when(F.col("action") == "import", F.col("table_name")).alias("table_name"),
            F.when(F.col("action") == "repair", F.col("source_replica")).alias(
                "source_replica"
            ),
            "lifecycleStage",
            "created",
        )
    )
    second = (
        with_env(backups)
        .where(F.col("action").isin(*BACKUP_ACTIONS) & (F.col("dataset") != ""))
        .select(
            "id",
            "action",
            F.col("dataset").alias("table_name"),
            F.col("kind").alias("type"),
            F.when(F.col("action") == "restore", F.col("filename")).alias("filename"),
            "lifecycleStage",
            "created",
        )
    )
    return first.unionByName(second, allowMissingColumns=True)


def newest(history: DataFrame, n: int = 50) -> DataFrame:
    """Top-n report, newest first; ids break ties."""
    return history.orderBy(F.desc("created"), F.desc("id")).limit(n)


def history_of(history: DataFrame, action: str = "all", n: int = 15) -> DataFrame:
    """Newest entries of one action, or of all."""
    if action != "all":
        history = history.where(F.col("action") == action)
    return newest(history, n)


def merge_pages(pages: list[DataFrame], limit: int = 0) -> DataFrame:
    """Pages appended in order, cut at `limit` if it is set."""
    merged = reduce(lambda a, b: a.unionByName(b), pages)
    return merged.limit(limit) if limit > 0 else merged
