"""Queries: column configs, registries and job files, made from the given tables and
read back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotlake.operators import tables as TB
from slotlake.schema import DDL_TYPES, create_table_text, load_columns, load_registry
from slotlake.session import scratch_path
from slotlake.showcase.common import NOW, table, text_of
from slotlake.sources import datasets as DS

TYPES = tuple(DDL_TYPES)


def _text_file(df, label):
    """One line of text as a file; the path of its folder."""
    path = scratch_path(df.sparkSession, label)
    df.coalesce(1).write.text(path)
    return path


def _type_of(key):
    return F.get(F.array(*[F.lit(t) for t in TYPES]), F.col(key) % len(TYPES))


def column_config(spark, sf_dir):
    """A column config with a column for each nation, read back: types, their classes and
    the DDL text of all, looked up for the nation of every customer."""
    columns = F.struct(
        F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("name"),
        _type_of("n_nationkey").alias("type"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("n_nationkey", columns.alias("c"))))
    doc = F.to_json(F.struct(F.transform(in_order, lambda x: x["c"]).alias("columns")))
    path = _text_file(table(spark, sf_dir, "nation").agg(doc.alias("value")), "columns")
    read = load_columns(path, spark)
    rows = [(k, c.name, c.type, c.is_string, c.is_numeric) for k, c in enumerate(read)]
    schema = "position bigint, name string, type string, is_string boolean, is_numeric boolean"
    known = spark.createDataFrame(rows, schema).withColumn("ddl", F.md5(F.lit(create_table_text("nations", read))))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("position"))
    return customers.join(known, "position")


def registry_file(spark, sf_dir):
    """A registry with a table for each region; each customer's table looked up by the
    name of one of its slots."""
    config = F.when(
        F.col("r_regionkey") % 2 == 0,
        F.struct(F.lit("indexer").alias("importMethod"), (F.col("r_regionkey") > 2).alias("hasHeader"),
                 F.col("r_regionkey").cast("int").alias("agentRetryCount")),
    )
    body = F.struct(
        config.alias("config"),
        F.struct(F.array(F.struct(F.lit("x").alias("name"), _type_of("r_regionkey").alias("type"))).alias("columns")).alias("schema"),
    )
    doc = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.lower("r_name").alias("k"), body.alias("v")))))
    path = _text_file(table(spark, sf_dir, "region").agg(doc.alias("value")), "registry")
    known = load_registry(path, spark).to_df(spark)
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    slots = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(F.lower("r_name"), F.lit("_main_b")).alias("name")
    )
    return TB.with_schema(slots, known).select(
        "c_custkey", "name", "import_method", "cluster_main", "agent_retry_count", "has_header", "n_columns"
    )


def job_files(spark, sf_dir):
    """A job record for each supplier, a JSON file each, read after a restart."""
    key = F.col("s_suppkey")
    jobs = table(spark, sf_dir, "supplier").select(
        text_of("job-", key).alias("id"), F.col("s_name").alias("table"), text_of("/in/", key, ".csv").alias("csvPath"),
        F.get(F.array(*[F.lit(s) for s in ("pending", "running", "completed", "failed")]), (key % 4).cast("int")).alias("status"),
        (key + 1).alias("startedAt"), F.when(key % 4 > 1, key + 2).alias("endedAt"), (key * 10).alias("lastLineNum"),
    )
    path = scratch_path(spark, "job-files")
    jobs.repartition(16, "id").write.option("maxRecordsPerFile", 1).json(path)
    return DS.read_jobs(spark, path, NOW).select("id", "table", "csvPath", "status", "error", "startedAt", "endedAt", "lastLineNum")


_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_DDL_LIST = "[" + ", ".join(f"'{t}'" for t in DDL_TYPES.values()) + "]"
_TYPE = f"{_TYPE_LIST}[CAST(k % {len(TYPES)} AS INTEGER) + 1]"

QUERIES = {
    "column_config": (
        column_config,
        f"""WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, lower(replace(n_name, ' ', '_')) AS name FROM nation),
          d AS (SELECT md5('CREATE TABLE IF NOT EXISTS nations (id bigint, ' || string_agg(name || ' ' ||
            {_DDL_LIST}[CAST(k % {len(TYPES)} AS INTEGER) + 1], ', ' ORDER BY k) || ')') AS ddl FROM n)
        SELECT c_custkey, k AS position, name, {_TYPE} AS type, {_TYPE} IN ('field', 'field_string', 'attr_string') AS is_string,
          {_TYPE} IN ('attr_uint', 'attr_bigint', 'attr_float', 'attr_timestamp') AS is_numeric, ddl
        FROM customer JOIN n ON c_nationkey = k, d""",
    ),
    "registry_file": (
        registry_file,
        """SELECT c_custkey, lower(r_name) || '_main_b' AS name,
          CASE WHEN r_regionkey % 2 = 0 THEN 'indexer' ELSE 'bulk' END AS import_method, true AS cluster_main,
          CASE WHEN r_regionkey % 2 = 0 THEN CAST(r_regionkey AS INTEGER) ELSE 0 END AS agent_retry_count,
          CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey > 2 END AS has_header, 1 AS n_columns
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "job_files": (
        job_files,
        f"""WITH j AS (SELECT s_suppkey AS k, s_name FROM supplier)
        SELECT 'job-' || k AS id, s_name AS "table", '/in/' || k || '.csv' AS "csvPath",
          CASE WHEN k % 4 = 2 THEN 'completed' ELSE 'failed' END AS status,
          CASE WHEN k % 4 < 2 THEN '{DS.RESTART_MESSAGE}' END AS error, CAST(k + 1 AS BIGINT) AS "startedAt",
          CASE WHEN k % 4 < 2 THEN CAST({NOW} AS BIGINT) ELSE CAST(k + 2 AS BIGINT) END AS "endedAt",
          CAST(k * 10 AS BIGINT) AS "lastLineNum" FROM j""",
    ),
}
