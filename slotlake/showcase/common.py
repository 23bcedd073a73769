"""Inputs of the registered queries: the given tables, and texts and logs derived
from them by fixed rules (so that SQL can derive the same)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake.plans.lake import Lake
from slotlake.schema import Registry, TableSchema, columns_of
from slotlake.session import scratch_path
from slotlake.sources.datasets import RESTART_MESSAGE

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(*parts) -> Column:
    """Concatenation of columns and literal texts; columns are cast to string."""
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    )


def write_lines(
    df: DataFrame,
    line: Column,
    order: str,
    label: str,
    header: str | None = None,
    suffix: str = "",
) -> str:
    """Text files whose file and line order is the order of a key column; with a
    header line in every file if one is given."""
    path = scratch_path(df.sparkSession, label) + suffix
    lines = df.orderBy(order).select(line.alias("value"))
    if header is None:
        lines.write.text(path)
    else:
        # One unquoted CSV column is a text file with a header per file.
        lines.withColumnRenamed("value", header).write.csv(
            path, header=True, sep="\x01", quote="\x00"
        )
    return path


def seconds_of(ts: Column) -> Column:
    """Unix seconds of a timestamp column, whatever the session's time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", epoch, ts.cast("timestamp_ntz"))


def new_lake(spark: SparkSession, name: str, columns: list[tuple[str, str]]) -> Lake:
    """A lake of its own database and folder, with one registered table."""
    registry = Registry().add(TableSchema(name, columns_of(*columns)))
    tag = uuid.uuid4().hex[:12]
    return Lake(spark, scratch_path(spark, "lake"), registry, f"slotlake_{tag}")


# --- replicas from events ------------------------------------------------------

REPLICAS_SQL = """replicas AS (
  SELECT user_id % 20 AS cluster_id, event_id AS idx, event_id % 5 <> 0 AS reachable,
         CASE WHEN event_id % 7 = 0 THEN 'non-primary' ELSE 'primary' END AS cluster_status,
         event_type AS uuid, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS seqno,
         event_id % 11 <> 0 AS has_valid_uuid,
         CASE WHEN event_id % 3 = 0 THEN 'donor' ELSE 'synced' END AS node_state
  FROM events)"""


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("cluster_id"),
        F.col("event_id").alias("idx"),
        (F.col("event_id") % 5 != 0).alias("reachable"),
        F.when(F.col("event_id") % 7 == 0, "non-primary").otherwise("primary").alias(
            "cluster_status"
        ),
        F.col("event_type").alias("uuid"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("seqno"),
        (F.col("event_id") % 11 != 0).alias("has_valid_uuid"),
        F.when(F.col("event_id") % 3 == 0, "donor").otherwise("synced").alias("node_state"),
    )


# --- probes from events: error text NULL on success -----------------------------

PROBES_SQL = """probes AS (
  SELECT user_id AS cluster_id, event_id AS idx,
         CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'dial tcp: lookup r' || event_id || ': no such host'
              WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'API error (503): busy'
              WHEN event_type = 'error' THEN 'read tcp: connection reset by peer' END AS error,
         CASE WHEN event_type = 'error' OR user_id % 4 = 0 THEN NULL
              WHEN event_type = 'view' AND user_id % 4 = 1 THEN 'non-primary'
              WHEN event_type = 'click' THEN 'synced' ELSE 'primary' END AS cluster_status,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS metric
  FROM events)"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_error = F.col("event_type") == "error"
    kind = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("cluster_id"),
        F.col("event_id").alias("idx"),
        F.when(
            is_error & (kind == 0),
            text_of("dial tcp: lookup r", F.col("event_id"), ": no such host"),
        )
        .when(is_error & (kind == 1), F.lit("API error (503): busy"))
        .when(is_error, F.lit("read tcp: connection reset by peer"))
        .alias("error"),
        F.when(is_error | (F.col("user_id") % 4 == 0), F.lit(None).cast("string"))
        .when((F.col("event_type") == "view") & (F.col("user_id") % 4 == 1), F.lit("non-primary"))
        .when(F.col("event_type") == "click", F.lit("synced"))
        .otherwise(F.lit("primary"))
        .alias("cluster_status"),
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("metric"),
    )


# --- commands from events --------------------------------------------------------

ACTION_SQL = """CASE event_type WHEN 'click' THEN 'import' WHEN 'view' THEN 'backup'
         WHEN 'purchase' THEN 'restore' WHEN 'error' THEN 'repair' ELSE 'other' END"""
COMMANDS_SQL = f"""commands AS (
  SELECT CAST(event_id AS VARCHAR) AS id, {ACTION_SQL} AS action,
         CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running'
              WHEN 2 THEN 'completed' ELSE 'failed' END AS stage,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created,
         CASE WHEN user_id % 10 = 0 THEN '' ELSE 't' || user_id END AS tname,
         CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'delta' END AS kind,
         CASE WHEN user_id % 3 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS replica,
         't' || user_id || '_main_a-' || event_id || '.tar.gz' AS file
  FROM events)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command log in its nested shape; the variables sit in the second override."""
    action = (
        F.when(F.col("event_type") == "click", "import")
        .when(F.col("event_type") == "view", "backup")
        .when(F.col("event_type") == "purchase", "restore")
        .when(F.col("event_type") == "error", "repair")
        .otherwise("other")
    )
    name = F.when(F.col("user_id") % 10 == 0, F.lit("")).otherwise(text_of("t", F.col("user_id")))
    variables = {
        "ACTION": action,
        "TABLE_NAME": F.when(action == "import", name),
        "DATASET": F.when(action.isin("backup", "restore"), name),
        "TYPE": F.when(F.col("user_id") % 2 == 0, "main").otherwise("delta"),
        "REPAIR_SOURCE_REPLICA": F.when(F.col("user_id") % 3 == 0, F.lit("x")).otherwise(
            F.col("user_id").cast("string")
        ),
        "RESTORE_FILE": text_of(
            "t", F.col("user_id"), "_main_a-", F.col("event_id"), ".tar.gz"
        ),
    }
    env = F.array(
        *[
            F.struct(F.lit(k).alias("name"), v.alias("value"))
            for k, v in variables.items()
        ]
    )
    overrides = F.array(
        F.struct(F.lit("first").alias("name"), F.slice(env, 1, 0).alias("env")),
        F.struct(F.lit("second").alias("name"), env.alias("env")),
    )
    stage = F.element_at(
        F.array(*[F.lit(s) for s in ("pending", "running", "completed", "failed")]),
        (F.col("event_id") % 4 + 1).cast("int"),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.lit("runCronWorkload").alias("type"),
        stage.alias("lifecycleStage"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"),
        F.struct(F.lit("here").alias("location"), overrides.alias("containerOverrides")).alias(
            "spec"
        ),
    )


# --- jobs from orders --------------------------------------------------------------

NOW = 1_000_000_000  # between the oldest and the newest order date

JOBS_SQL = f"""jobs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS tbl, o_orderstatus AS path,
         CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed'
              WHEN 3 THEN 'cancelled' ELSE 'failed' END AS status,
         CAST(epoch(o_orderdate) AS BIGINT) AS started,
         CASE WHEN o_orderkey % 6 >= 2 THEN CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 7200 END AS ended,
         o_orderkey AS last_line
  FROM orders)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    started = seconds_of(F.col("o_orderdate"))
    status = F.element_at(
        F.array(
            *[F.lit(s) for s in ("pending", "running", "completed", "cancelled", "failed", "failed")]
        ),
        (k % 6 + 1).cast("int"),
    )
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"),
        F.col("o_orderpriority").alias("table"),
        F.col("o_orderstatus").alias("csvPath"),
        status.alias("status"),
        F.when(k % 6 == 4, F.lit(RESTART_MESSAGE)).alias("error"),
        started.alias("startedAt"),
        F.when(k % 6 >= 2, started + k % 7200).alias("endedAt"),
        k.alias("lastLineNum"),
    )


# --- main and delta from orders ------------------------------------------------------

ORDER_COLUMNS = [
    ("cust", "attr_bigint"), ("status", "attr_string"), ("price", "attr_float"),
    ("day", "attr_timestamp"),
]


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
        seconds_of(F.col("o_orderdate")).alias("day"),
    )


def order_line() -> Column:
    """CSV text of an order, the date as a date."""
    return text_of(
        F.col("id"), ",", F.col("cust"), ",", F.col("status"), ",", F.col("price"), ",",
        F.date_format(F.timestamp_seconds("day"), "yyyy-MM-dd"),
    )


ORDERS_SQL = """SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status,
       o_totalprice AS price, CAST(epoch(o_orderdate) AS BIGINT) AS day FROM orders"""
