"""Queries: fleet and table status, command history, jobs, names, result grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotlake.functions import names as NM
from slotlake.operators import fleet as FL
from slotlake.operators import grid as G
from slotlake.operators import history as H
from slotlake.operators import jobs as J
from slotlake.operators import tables as TB
from slotlake.session import scratch_path
from slotlake.showcase.common import (
    COMMANDS_SQL,
    JOBS_SQL,
    NOW,
    PROBES_SQL,
    REPLICAS_SQL,
    commands,
    jobs,
    probes,
    replicas,
    table,
    text_of,
)
from slotlake.sources import datasets as DS

# --- replicas ---------------------------------------------------------------------


def cluster_groups(spark, sf_dir):
    return FL.cluster_groups(replicas(spark, sf_dir))


def cluster_members(spark, sf_dir):
    return FL.cluster_members(replicas(spark, sf_dir))


def winner_per_cluster(spark, sf_dir):
    return FL.winning_cluster(replicas(spark, sf_dir), "search")


def winner_preferred(spark, sf_dir):
    """Few members per cluster, so that ties occur and the preference decides."""
    small = replicas(spark, sf_dir).withColumn(
        "cluster_id", F.floor(F.col("idx") / 4).cast("bigint")
    )
    return FL.winning_cluster(small, "search", F.lit("purchase"))


def split_brain(spark, sf_dir):
    return FL.split_brain(
        replicas(spark, sf_dir).withColumn("cluster_id", F.floor(F.col("idx") / 2).cast("bigint"))
    )


def quorum(spark, sf_dir):
    return FL.quorum(
        replicas(spark, sf_dir).withColumn("cluster_id", F.floor(F.col("idx") / 3).cast("bigint"))
    )


def lowest_available(spark, sf_dir):
    return FL.lowest_available(replicas(spark, sf_dir))


def healthy_sources(spark, sf_dir):
    return FL.healthy_sources(replicas(spark, sf_dir)).select("cluster_id", "idx")


def fleet_status(spark, sf_dir):
    small = probes(spark, sf_dir).withColumn("cluster_id", F.floor(F.col("idx") / 3).cast("bigint"))
    return FL.fleet_status(FL.replica_status(small))


def replica_errors(spark, sf_dir):
    status = FL.replica_status(probes(spark, sf_dir))
    return status.select(
        "idx", "status", "message", NM.is_retryable(F.col("error")).alias("retryable")
    )


def deployment_messages(spark, sf_dir):
    """Versions nested by cluster; a replica takes the one at its own position."""
    position = F.row_number().over(Window.partitionBy("cluster_id").orderBy("idx")) - 1
    status = FL.replica_status(probes(spark, sf_dir)).withColumn("idx", position.cast("bigint"))
    version = F.struct(
        F.when(F.col("event_id") % 2 == 0, F.lit("pulling")).otherwise(F.lit("")).alias("message"),
        F.array(F.lit("pulling"), F.lit(""), text_of("exit ", F.col("event_id") % 7)).alias("containers"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("event_id", version.alias("v"))))
    versions = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("cluster_id"))
        .agg(F.transform(in_order, lambda x: x["v"]).alias("versions"))
    )
    return FL.with_deployment_messages(status, versions).select(
        "cluster_id", "idx", "status", "deployment_message"
    )


def query_counts(spark, sf_dir):
    return FL.query_counts(probes(spark, sf_dir))


def broadcast_outcome(spark, sf_dir):
    results = probes(spark, sf_dir).select(
        F.floor(F.col("idx") / 2).cast("bigint").alias("query_id"),
        F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"),
        "error",
    )
    return FL.broadcast_outcome(results, "query_id")


def valid_uuids(spark, sf_dir):
    uuid = (
        F.when(F.col("event_id") % 5 == 0, F.lit(""))
        .when(F.col("event_id") % 5 == 1, F.lit(NM.ZERO_UUID))
        .otherwise(text_of("u-", F.col("user_id")))
    )
    return table(spark, sf_dir, "events").select(
        "event_id", NM.is_valid_uuid(F.col("event_id") % 3 != 0, uuid).alias("valid")
    )


def _text_files(spark, sf_dir, text, label):
    """Text files in a directory per nation, lines in key order. A nation may have
    any number of files."""
    path = scratch_path(spark, label)
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("k"), text.alias("value")
    )
    ordered = rows.repartitionByRange("k").sortWithinPartitions("nation", "k")
    ordered.select("nation", "value").write.partitionBy("nation").text(path)
    return path


def _nation_of_file():
    return F.regexp_extract("file", "nation=([0-9]+)", 1).cast("bigint").alias("nation")


def state_files(spark, sf_dir):
    """Many state files, of which the last good line of a key counts; then the
    highest state per nation."""
    k = F.col("c_custkey")
    text = (
        F.when(k % 5 == 0, text_of("# seqno: ", k))
        .when(k % 5 == 1, text_of("  uuid :  u:", k, "  "))
        .when(k % 5 == 2, text_of("seqno: ", k))
        .when(k % 5 == 3, text_of("seqno: bad", k))
        .otherwise(text_of("no colon ", k))
    )
    files = DS.read_kv_files(spark, f"{_text_files(spark, sf_dir, text, 'states')}/*/*.txt")
    return files.groupBy(_nation_of_file()).agg(
        F.max(F.regexp_extract("uuid", "^u:([0-9]+)$", 1).try_cast("bigint")).alias("uuid_no"),
        F.max("seqno").alias("seqno"),
        F.max("safe_to_bootstrap").alias("safe_to_bootstrap"),
    )


def metric_files(spark, sf_dir):
    """First usable line of the metric in each of many files, then the lowest per
    nation."""
    k = F.col("c_custkey")
    text = (
        F.when(k % 3 == 0, text_of("other_metric ", k))
        .when(k % 3 == 1, F.lit("queries_count"))
        .otherwise(text_of(" queries_count\t", k, " 0"))
    )
    path = _text_files(spark, sf_dir, text, "metrics")
    files = DS.read_metrics(spark, f"{path}/*/*.txt", "queries_count")
    return files.groupBy(_nation_of_file()).agg(F.min("metric").alias("metric"))


# --- tables over replicas -------------------------------------------------------------

N_REPLICAS = 5


def _configured(spark, sf_dir):
    """A table per customer; some without a config, slots by the nation."""
    customer = table(spark, sf_dir, "customer")
    name = text_of("t", F.col("c_custkey"))
    configs = customer.where("c_nationkey % 3 = 0").select(
        name.alias("name"), (F.col("c_nationkey") % 2 == 0).alias("cluster_main")
    )
    slots = customer.where("c_nationkey % 4 <> 3").select(
        name.alias("name"),
        F.when(F.col("c_nationkey") % 4 == 0, "b").when(F.col("c_nationkey") % 4 == 1, "a")
        .otherwise("").alias("slot"),
    )
    return TB.with_defaults(customer.select(name.alias("name")), configs, slots)


def _listings(spark, sf_dir):
    """What the replicas hold: components by order, clustered names by customer."""
    k = F.col("o_orderkey")
    part = F.when(k % 4 == 0, "_main_a").when(k % 4 == 1, "_main_b").when(k % 4 == 2, "_delta")
    held = table(spark, sf_dir, "orders").select(
        (k % N_REPLICAS).alias("idx"),
        F.concat(text_of("t", F.col("o_custkey")), part.otherwise("")).alias("name"),
    )
    customer = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    members = customer.select(
        F.explode(
            F.array(*[text_of("t", F.col("c_custkey"), s) for s in ("_main_a", "_main_b", "_delta")])
        ).alias("name")
    )
    return TB.with_membership(held.distinct(), members)


def _replica_state(spark, sf_dir):
    """Five replicas; one of them does not answer."""
    regions = table(spark, sf_dir, "region")
    down = F.col("r_regionkey") == 3
    return regions.select(
        F.col("r_regionkey").cast("bigint").alias("idx"),
        (~down).alias("online"),
        F.when(down, text_of("no answer from ", F.col("r_name"))).alias("error"),
    )


def _matrix(spark, sf_dir):
    status = TB.table_status(_configured(spark, sf_dir), _listings(spark, sf_dir), N_REPLICAS)
    return TB.with_replica_state(status, _replica_state(spark, sf_dir))


def table_status_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


def table_health(spark, sf_dir):
    return TB.table_health(_matrix(spark, sf_dir))


def slot_counts(spark, sf_dir):
    return TB.summary_counts(_configured(spark, sf_dir), TB.table_health(_matrix(spark, sf_dir)))


def table_defaults(spark, sf_dir):
    return _configured(spark, sf_dir)


def cluster_membership(spark, sf_dir):
    return _listings(spark, sf_dir)


def missing_replicas(spark, sf_dir):
    return TB.missing_replicas(
        _replica_state(spark, sf_dir), _listings(spark, sf_dir), "t7_delta"
    )


def replicated_everywhere(spark, sf_dir):
    return TB.replication_gaps(_listings(spark, sf_dir), N_REPLICAS)


def schema_of_derived(spark, sf_dir):
    """Derived names to the registry row of their base table."""
    registry = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(
        text_of("t", F.col("c_custkey")).alias("name"), F.col("c_mktsegment").alias("method")
    )
    derived = _listings(spark, sf_dir).select("name").distinct()
    return TB.with_schema(derived, registry)


# --- commands and history -------------------------------------------------------------


def env_extract(spark, sf_dir):
    return H.with_env(commands(spark, sf_dir)).select(
        "id", "action", "table_name", "dataset", "kind", "filename", "source_replica"
    )


def command_log(spark, sf_dir):
    """The log written and read back as nested JSON."""
    path = scratch_path(spark, "commands")
    commands(spark, sf_dir).write.json(path)
    log = DS.read_commands(spark, path)
    return H.with_env(log).groupBy("type", "lifecycleStage", "action").agg(
        F.count("*").alias("commands")
    )


def active_imports(spark, sf_dir):
    return H.active_imports(commands(spark, sf_dir))


def active_repairs(spark, sf_dir):
    return H.active_repairs(commands(spark, sf_dir))


def command_history(spark, sf_dir):
    log = commands(spark, sf_dir)
    return H.command_history(log, log)


def history_top50(spark, sf_dir):
    log = commands(spark, sf_dir)
    return H.newest(H.command_history(log, log)).select("id", "action", "table_name", "created")


def history_restores(spark, sf_dir):
    log = commands(spark, sf_dir)
    return H.history_of(H.command_history(log, log), "restore").select("id", "filename")


def untracked_ops(spark, sf_dir):
    ops = table(spark, sf_dir, "customer").select(
        text_of("t", F.col("c_custkey")).alias("table_name"),
        F.lit("import").alias("action"),
        F.lit("scaling").alias("phase"),
    )
    return H.untracked_operations(ops, H.active_imports(commands(spark, sf_dir)))


def term_filters(spark, sf_dir):
    log = commands(spark, sf_dir)
    any_of = H.match_terms(log, {"lifecycleStage": "failed", "id": "17"}, "any")
    all_of = H.match_terms(log, {"lifecycleStage": "running", "type": H.RUN_TYPE})
    return H.merge_pages(
        [any_of.select("id", F.lit("any").alias("matched")), all_of.select("id", F.lit("all").alias("matched"))]
    )


def busy_guard(spark, sf_dir):
    """Guards as one row, with the size of the log they looked at."""
    log = commands(spark, sf_dir)
    return log.agg(
        F.count("*").alias("commands"),
        F.lit(H.is_busy(log, ("import",), "t1")).alias("import_t1"),
        F.lit(H.is_busy(log, ("import",), "t10")).alias("import_t10"),
        F.lit(H.is_busy(log, ("repair",))).alias("repair"),
    )


# --- jobs -----------------------------------------------------------------------------


def latest_job(spark, sf_dir):
    return J.latest_job(jobs(spark, sf_dir)).select("table", "csvPath", "id", "lastLineNum")


def resume_points(spark, sf_dir):
    all_jobs = jobs(spark, sf_dir)
    return J.resume_points(all_jobs, all_jobs.where("status = 'pending'"))


def expired_jobs(spark, sf_dir):
    return J.expired_jobs(jobs(spark, sf_dir), NOW).select("id", "status", "endedAt")


def kept_jobs(spark, sf_dir):
    return J.kept_jobs(jobs(spark, sf_dir), NOW).select("id", "status")


def interrupted_jobs(spark, sf_dir):
    return J.interrupted_jobs(jobs(spark, sf_dir)).select("id", "lastLineNum")


def restarted_jobs(spark, sf_dir):
    """Job records written as JSON, one of them cut short, and read after a restart."""
    path = scratch_path(spark, "jobs")
    lines = jobs(spark, sf_dir).select("id", F.to_json(F.struct("*")).alias("value"))
    cut = F.when(F.col("id").cast("bigint") % 10 == 0, F.left("value", F.lit(20))).otherwise(
        F.col("value")
    )
    lines.select(cut.alias("value")).write.text(path)
    log = (
        spark.read.schema(DS.JOB_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    )
    return DS.mark_interrupted(log, NOW).select("id", "status", "endedAt")


# --- names ----------------------------------------------------------------------------


def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        NM.url_host(F.col("url")).alias("host"),
        NM.sql_address(F.col("url")).alias("address"),
        NM.last_segment(F.split("url", "[?#]")[0]).alias("last"),
    )


def replication_addresses(spark, sf_dir):
    url = text_of("http://", F.col("c_mktsegment"), "-", F.col("c_custkey"), ".search:8080")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        NM.replication_address_of_url(url).alias("from_url"),
        NM.replication_address(F.lower("c_mktsegment"), F.col("c_custkey")).alias("built"),
    )


def _derived(key):
    suffix = F.when(key % 5 == 0, "_main_a").when(key % 5 == 1, "_main_b").when(key % 5 == 2, "_delta")
    return F.concat(text_of("tab", key), suffix.when(key % 5 == 3, "_main_c").otherwise(""))


def base_names(spark, sf_dir):
    name = _derived(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(
        name.alias("name"), NM.base_name(name).alias("base"), NM.delta_name(name).alias("delta")
    )


def locals_from_ddl(spark, sf_dir):
    k = F.col("c_custkey")
    ddl = text_of(
        "CREATE TABLE t", k, " type='distributed' local='",
        F.concat(text_of("t", k), F.when(k % 3 == 0, "_main_a").when(k % 3 == 1, "_main_b").otherwise("_old")),
        "' local='t", k, "_delta' agent='x:t'",
    )
    locals_ = NM.locals_of_ddl(ddl)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.array_join(locals_, ",").alias("locals"),
        NM.active_slot(text_of("t", k), locals_).alias("slot"),
    )


def name_sets(spark, sf_dir):
    text = text_of(" ", F.col("c_mktsegment"), ", x", F.col("c_nationkey"), ",,x", F.col("c_nationkey"), " , ")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(NM.name_set(text), "|").alias("names")
    )


def snapshot_names(spark, sf_dir):
    """File names from table and time, and the slot read back from them."""
    name = _derived(F.col("o_custkey"))
    file = NM.snapshot_name(name, F.timestamp_seconds(F.col("o_orderkey") * 100003))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        file.alias("filename"),
        NM.snapshot_slot(file, text_of("tab", F.col("o_custkey"))).alias("slot"),
    )


def display_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.encode("c_name", "UTF-8").alias("bytes"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("maybe"),
        F.array("c_custkey", F.lit(1)).alias("list"),
    )
    return G.display(rows)


# --- result grid ------------------------------------------------------------------------


def grid_search(spark, sf_dir):
    return G.search(table(spark, sf_dir, "customer"), "mAch")


def grid_sort(spark, sf_dir):
    return G.sort(table(spark, sf_dir, "customer"), "c_acctbal", "desc")


def grid_page(spark, sf_dir):
    return G.page(
        table(spark, sf_dir, "customer"), 3, 25, "c_mktsegment", "desc", tiebreak="c_custkey"
    )


def grid_next_page(spark, sf_dir):
    """The page behind a known last row, without an offset."""
    return G.page_after(
        table(spark, sf_dir, "customer"), "HOUSEHOLD", 50, 25, "c_mktsegment", "asc", "c_custkey"
    )


def grid_ranked_pages(spark, sf_dir):
    """Three pages of orders by status and key, each found by its range of the order."""
    pages = G.Pages(table(spark, sf_dir, "orders"), "o_orderstatus", "desc", "o_orderkey", range_rows=400)
    return reduce(DataFrame.unionByName, [pages.page(k, 25).withColumn("page", F.lit(k)) for k in (0, 31, 59)])


def grid_pages(spark, sf_dir):
    return G.page_count(table(spark, sf_dir, "lineitem"), 25)


# --- oracles ------------------------------------------------------------------------------


def _winner_sql(replica_cte: str, preferred: str = "") -> str:
    pref = f"CASE WHEN uuid = '{preferred}' THEN 0 ELSE 1 END," if preferred else ""
    return f"""WITH {replica_cte}, ok AS (SELECT * FROM replicas WHERE has_valid_uuid AND cluster_status = 'primary'),
      g AS (SELECT cluster_id, uuid, count(*) AS node_count, min(seqno) AS min_seqno FROM ok GROUP BY 1, 2),
      w AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY node_count DESC, {pref} min_seqno, uuid) AS r FROM g),
      m AS (SELECT ok.cluster_id, ok.uuid, ok.idx, row_number() OVER (PARTITION BY ok.cluster_id, ok.uuid
            ORDER BY seqno DESC, idx) AS r FROM ok)
    SELECT w.cluster_id, w.uuid, m.idx AS source_idx, 'search-' || m.idx || '.search:9312' AS source_addr, w.node_count
    FROM w JOIN m ON w.cluster_id = m.cluster_id AND w.uuid = m.uuid AND w.r = 1 AND m.r = 1"""


def _by(cte: str, n: int) -> str:
    """Same rows, clusters of n consecutive indexes."""
    return cte.replace("user_id % 20 AS cluster_id", f"event_id // {n} AS cluster_id").replace(
        "user_id AS cluster_id", f"event_id // {n} AS cluster_id"
    )


_OK = "ok AS (SELECT * FROM replicas WHERE has_valid_uuid AND cluster_status = 'primary')"
_STATUS = """CASE WHEN error IS NULL THEN 'online' WHEN error LIKE '%no such host%' THEN 'not_in_use'
  WHEN error LIKE '%API error (503)%' THEN 'error' ELSE 'offline' END"""

_CONF = """conf AS (SELECT 't' || c_custkey AS name,
    CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey % 2 = 0 ELSE true END AS cluster_main,
    CASE WHEN c_nationkey % 4 = 0 THEN 'b' ELSE 'a' END AS slot FROM customer)"""
_HELD = """held AS (SELECT DISTINCT o_orderkey % 5 AS idx, 't' || o_custkey ||
    CASE o_orderkey % 4 WHEN 0 THEN '_main_a' WHEN 1 THEN '_main_b' WHEN 2 THEN '_delta' ELSE '' END AS name,
    't' || o_custkey AS base, o_custkey % 2 = 0 AND o_orderkey % 4 <> 3 AS in_cluster FROM orders)"""
_MATRIX = f"""{_CONF}, {_HELD}, rep AS (SELECT CAST(r_regionkey AS BIGINT) AS idx, r_regionkey <> 3 AS online,
    CASE WHEN r_regionkey = 3 THEN 'no answer from ' || r_name END AS error FROM region),
  m AS (SELECT c.name, c.cluster_main, c.slot, r.idx, r.online, r.error,
    r.online AND coalesce(bool_or(h.name = c.name || '_main_' || c.slot), false) AS main_present,
    r.online AND coalesce(bool_or(h.name = c.name || '_main_' || c.slot AND h.in_cluster), false) AS main_in_cluster,
    r.online AND coalesce(bool_or(h.name = c.name || '_delta'), false) AS delta_present,
    r.online AND coalesce(bool_or(h.name = c.name || '_delta' AND h.in_cluster), false) AS delta_in_cluster,
    r.online AND coalesce(bool_or(h.name = c.name), false) AS unified_present
    FROM conf c CROSS JOIN rep r LEFT JOIN held h ON h.base = c.name AND h.idx = r.idx
    GROUP BY 1, 2, 3, 4, 5, 6),
  health AS (SELECT name, CASE WHEN count(*) FILTER (WHERE online) = 0 THEN 'offline'
      WHEN bool_and(NOT online OR (main_present AND delta_present AND unified_present
        AND (NOT cluster_main OR main_in_cluster) AND delta_in_cluster)) THEN 'healthy'
      WHEN bool_or(main_present OR delta_present) THEN 'partial' ELSE 'empty' END AS health FROM m GROUP BY 1)"""

_HISTORY = f"""{COMMANDS_SQL}, h AS (
  SELECT id, action, CASE WHEN action <> 'repair' THEN tname END AS table_name,
    CASE WHEN action = 'repair' THEN TRY_CAST(replica AS BIGINT) END AS source_replica,
    stage AS "lifecycleStage", created,
    CASE WHEN action IN ('backup', 'restore') THEN kind END AS type,
    CASE WHEN action = 'restore' THEN file END AS filename
  FROM commands WHERE action = 'repair' OR (action <> 'other' AND tname <> ''))"""

_LAST = """SELECT *, row_number() OVER (PARTITION BY tbl, path ORDER BY started DESC, id DESC) AS r"""
_STATES = """t AS (SELECT c_nationkey, c_custkey AS k FROM customer)"""

QUERIES = {
    "cluster_groups": (
        cluster_groups,
        f"""WITH {REPLICAS_SQL}, {_OK}, m AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, uuid
          ORDER BY seqno DESC, idx) AS r FROM ok)
        SELECT cluster_id, uuid, count(*) AS node_count, min(seqno) AS min_seqno,
          max(idx) FILTER (WHERE r = 1) AS source_idx FROM m GROUP BY 1, 2""",
    ),
    "cluster_members": (
        cluster_members,
        f"""WITH {REPLICAS_SQL}, {_OK} SELECT cluster_id, uuid, idx,
          count(*) OVER (PARTITION BY cluster_id, uuid) AS node_count FROM ok""",
    ),
    "winner_per_cluster": (winner_per_cluster, _winner_sql(REPLICAS_SQL)),
    "winner_preferred": (winner_preferred, _winner_sql(_by(REPLICAS_SQL, 4), "purchase")),
    "split_brain": (
        split_brain,
        f"""WITH {_by(REPLICAS_SQL, 2)}, {_OK} SELECT cluster_id, count(DISTINCT uuid) AS groups,
          count(DISTINCT uuid) > 1 AS split_brain FROM ok GROUP BY 1""",
    ),
    "quorum": (
        quorum,
        f"""WITH {_by(REPLICAS_SQL, 3)}, c AS (SELECT cluster_id, count(*) FILTER (WHERE reachable) AS reachable,
          count(*) FILTER (WHERE reachable AND cluster_status = 'primary') AS "primary",
          count(DISTINCT CASE WHEN reachable AND cluster_status = 'primary' THEN uuid END) AS uuids
          FROM replicas GROUP BY 1)
        SELECT *, reachable > 0 AND "primary" = reachable AS has_quorum FROM c""",
    ),
    "lowest_available": (
        lowest_available,
        f"WITH {REPLICAS_SQL} SELECT cluster_id, min(idx) AS lowest_idx FROM replicas WHERE reachable GROUP BY 1",
    ),
    "healthy_sources": (
        healthy_sources, f"WITH {REPLICAS_SQL} SELECT cluster_id, idx FROM replicas WHERE node_state = 'synced'",
    ),
    "fleet_status": (
        fleet_status,
        f"""WITH {_by(PROBES_SQL, 3)}, s AS (SELECT *, {_STATUS} AS status FROM probes),
          c AS (SELECT cluster_id, count(*) FILTER (WHERE status = 'online') AS online,
            count(*) FILTER (WHERE status <> 'not_in_use') AS in_use,
            count(*) FILTER (WHERE status = 'online' AND cluster_status IS NOT NULL) AS known,
            count(*) FILTER (WHERE status = 'online' AND cluster_status = 'non-primary') AS bad FROM s GROUP BY 1)
        SELECT cluster_id, online, in_use, CASE WHEN known = 0 THEN 'uninitialized'
          WHEN online = in_use AND bad = 0 THEN 'healthy' ELSE 'degraded' END AS status FROM c""",
    ),
    "replica_errors": (
        replica_errors,
        f"""WITH {PROBES_SQL} SELECT idx, {_STATUS} AS status,
          CASE {_STATUS} WHEN 'not_in_use' THEN 'not in use at present' WHEN 'error' THEN 'answered with an error'
            WHEN 'offline' THEN 'does not answer' END AS message,
          coalesce(error LIKE '%connection reset%', false) AS retryable FROM probes""",
    ),
    "deployment_messages": (
        deployment_messages,
        f"""WITH {PROBES_SQL}, s AS (SELECT *, {_STATUS} AS status FROM probes)
        SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY idx) - 1 AS idx, status, CASE WHEN status = 'not_in_use' OR (status = 'online'
            AND coalesce(cluster_status IN ('primary', 'synced'), false)) THEN NULL
          ELSE 'pulling' || chr(10) || 'exit ' || (idx % 7) END AS deployment_message FROM s""",
    ),
    "query_counts": (
        query_counts,
        f"""WITH {PROBES_SQL} SELECT idx, CASE WHEN error IS NULL THEN metric END AS query_count,
          CASE WHEN {_STATUS} <> 'not_in_use' THEN error END AS error FROM probes""",
    ),
    "broadcast_outcome": (
        broadcast_outcome,
        f"""WITH {PROBES_SQL}, c AS (SELECT idx // 2 AS query_id, count(*) FILTER (WHERE error IS NULL) AS succeeded,
          count(*) FILTER (WHERE error IS NOT NULL AND error NOT LIKE '%no such host%') AS failed FROM probes GROUP BY 1)
        SELECT *, CASE WHEN failed = 0 THEN 'ok' WHEN succeeded = 0 THEN 'error' ELSE 'partial' END AS status FROM c""",
    ),
    "valid_uuids": (
        valid_uuids, "SELECT event_id, event_id % 3 <> 0 AND event_id % 5 > 1 AS valid FROM events",
    ),
    "state_files": (
        state_files,
        f"""WITH {_STATES} SELECT CAST(c_nationkey AS BIGINT) AS nation,
          max(k) FILTER (WHERE k % 5 = 1) AS uuid_no,
          coalesce(max(k) FILTER (WHERE k % 5 = 2), 0) AS seqno, CAST(0 AS BIGINT) AS safe_to_bootstrap
        FROM t GROUP BY 1""",
    ),
    "metric_files": (
        metric_files,
        f"""WITH {_STATES} SELECT CAST(c_nationkey AS BIGINT) AS nation,
          min(k) FILTER (WHERE k % 3 = 2) AS metric FROM t GROUP BY 1""",
    ),
    "table_status_matrix": (table_status_matrix, f"WITH {_MATRIX} SELECT * FROM m"),
    "table_health": (table_health, f"WITH {_MATRIX} SELECT * FROM health"),
    "slot_counts": (
        slot_counts,
        f"""WITH {_MATRIX} SELECT count(*) AS tables, count(*) FILTER (WHERE health = 'healthy') AS healthy,
          count(*) FILTER (WHERE slot = 'a') AS slot_a, count(*) FILTER (WHERE slot = 'b') AS slot_b
        FROM conf JOIN health USING (name)""",
    ),
    "table_defaults": (table_defaults, f"WITH {_CONF} SELECT * FROM conf"),
    "cluster_membership": (cluster_membership, f"WITH {_HELD} SELECT idx, name, in_cluster FROM held"),
    "missing_replicas": (
        missing_replicas,
        f"""WITH {_HELD} SELECT CAST(r_regionkey AS BIGINT) AS idx FROM region
        WHERE r_regionkey NOT IN (SELECT idx FROM held WHERE name = 't7_delta')""",
    ),
    "replicated_everywhere": (
        replicated_everywhere,
        f"""WITH {_HELD} SELECT name, count(DISTINCT idx) AS holders, count(DISTINCT idx) >= 5 AS replicated
        FROM held GROUP BY 1""",
    ),
    "schema_of_derived": (
        schema_of_derived,
        f"""WITH {_HELD}, d AS (SELECT DISTINCT name, base FROM held)
        SELECT d.base, d.name, c.c_mktsegment AS method FROM d
        LEFT JOIN customer c ON d.base = 't' || c.c_custkey AND c.c_custkey % 3 <> 0""",
    ),
    "env_extract": (
        env_extract,
        f"""WITH {COMMANDS_SQL} SELECT id, action, CASE WHEN action = 'import' THEN tname ELSE '' END AS table_name,
          CASE WHEN action IN ('backup', 'restore') THEN tname ELSE '' END AS dataset, kind, file AS filename,
          TRY_CAST(replica AS BIGINT) AS source_replica FROM commands""",
    ),
    "command_log": (
        command_log,
        f"""WITH {COMMANDS_SQL} SELECT 'runCronWorkload' AS type, stage AS "lifecycleStage", action,
          count(*) AS commands FROM commands GROUP BY 1, 2, 3""",
    ),
    "active_imports": (
        active_imports,
        f"""WITH {COMMANDS_SQL} SELECT tname AS table_name, id AS command_id, stage AS "lifecycleStage"
        FROM commands WHERE action = 'import' AND tname <> '' AND stage IN ('pending', 'running')""",
    ),
    "active_repairs": (
        active_repairs,
        f"""WITH {COMMANDS_SQL} SELECT id AS command_id, TRY_CAST(replica AS BIGINT) AS source_replica,
          stage AS "lifecycleStage" FROM commands WHERE action = 'repair' AND stage IN ('pending', 'running')""",
    ),
    "command_history": (command_history, f"WITH {_HISTORY} SELECT * FROM h"),
    "history_top50": (
        history_top50,
        f"""WITH {_HISTORY} SELECT id, action, table_name, created FROM h
        ORDER BY created DESC, id DESC LIMIT 50""",
    ),
    "history_restores": (
        history_restores,
        f"""WITH {_HISTORY} SELECT id, filename FROM h WHERE action = 'restore'
        ORDER BY created DESC, id DESC LIMIT 15""",
    ),
    "untracked_ops": (
        untracked_ops,
        f"""WITH {COMMANDS_SQL} SELECT 't' || c_custkey AS table_name, 'import' AS action, 'scaling' AS phase
        FROM customer WHERE 't' || c_custkey NOT IN (SELECT tname FROM commands
          WHERE action = 'import' AND stage IN ('pending', 'running'))""",
    ),
    "term_filters": (
        term_filters,
        f"""WITH {COMMANDS_SQL} SELECT id, 'any' AS matched FROM commands WHERE stage = 'failed' OR id = '17'
        UNION ALL SELECT id, 'all' FROM commands WHERE stage = 'running'""",
    ),
    "busy_guard": (
        busy_guard,
        f"""WITH {COMMANDS_SQL}, a AS (SELECT * FROM commands WHERE stage IN ('pending', 'running'))
        SELECT (SELECT count(*) FROM commands) AS commands,
          EXISTS (SELECT 1 FROM a WHERE action = 'import' AND tname = 't1') AS import_t1,
          EXISTS (SELECT 1 FROM a WHERE action = 'import' AND tname = 't10') AS import_t10,
          EXISTS (SELECT 1 FROM a WHERE action = 'repair') AS repair""",
    ),
    "latest_job": (
        latest_job,
        f"""WITH {JOBS_SQL}, l AS ({_LAST} FROM jobs) SELECT tbl AS "table", path AS "csvPath", id,
          last_line AS "lastLineNum" FROM l WHERE r = 1""",
    ),
    "resume_points": (
        resume_points,
        f"""WITH {JOBS_SQL}, l AS ({_LAST} FROM jobs WHERE status <> 'pending')
        SELECT tbl AS "table", path AS "csvPath", id AS job_id, last_line AS start_line FROM l WHERE r = 1""",
    ),
    "expired_jobs": (
        expired_jobs,
        f"""WITH {JOBS_SQL} SELECT id, status, ended AS "endedAt" FROM jobs WHERE ended < {NOW} - 86400""",
    ),
    "kept_jobs": (
        kept_jobs,
        f"WITH {JOBS_SQL} SELECT id, status FROM jobs WHERE ended IS NULL OR ended >= {NOW} - 86400",
    ),
    "interrupted_jobs": (
        interrupted_jobs,
        f"""WITH {JOBS_SQL} SELECT id, last_line AS "lastLineNum" FROM jobs WHERE last_line % 6 = 4""",
    ),
    "restarted_jobs": (
        restarted_jobs,
        f"""WITH {JOBS_SQL} SELECT id, CASE WHEN ended IS NULL THEN 'failed' ELSE status END AS status,
          coalesce(ended, {NOW}) AS "endedAt" FROM jobs WHERE last_line % 10 <> 0""",
    ),
    "url_hosts": (
        url_hosts,
        """SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
          regexp_extract(url, '^https?://([^/?#]+)', 1) || ':9306' AS address,
          regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/]*$') AS last FROM pages""",
    ),
    "replication_addresses": (
        replication_addresses,
        """SELECT c_custkey, c_mktsegment || '-' || c_custkey || '.search:9312' AS from_url,
          lower(c_mktsegment) || '-' || c_custkey || '.' || lower(c_mktsegment) || ':9312' AS built FROM customer""",
    ),
    "base_names": (
        base_names,
        """WITH n AS (SELECT 'tab' || c_custkey AS t, CASE c_custkey % 5 WHEN 0 THEN '_main_a' WHEN 1 THEN '_main_b'
          WHEN 2 THEN '_delta' WHEN 3 THEN '_main_c' ELSE '' END AS s FROM customer)
        SELECT t || s AS name, CASE WHEN s = '_main_c' THEN t || s ELSE t END AS base,
          t || s || '_delta' AS delta FROM n""",
    ),
    "locals_from_ddl": (
        locals_from_ddl,
        """SELECT c_custkey, 't' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '_main_a' WHEN 1 THEN '_main_b'
          ELSE '_old' END || ',t' || c_custkey || '_delta' AS locals,
          CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS slot FROM customer""",
    ),
    "name_sets": (
        name_sets, "SELECT c_custkey, c_mktsegment || '|x' || c_nationkey AS names FROM customer",
    ),
    "snapshot_names": (
        snapshot_names,
        """SELECT o_orderkey, 'tab' || o_custkey || CASE o_custkey % 5 WHEN 0 THEN '_main_a' WHEN 1 THEN '_main_b'
          WHEN 2 THEN '_delta' WHEN 3 THEN '_main_c' ELSE '' END || '-'
          || strftime(TIMESTAMP '1970-01-01' + to_seconds(o_orderkey * 100003), '%Y-%m-%dT%H-%M-%SZ') || '.tar.gz' AS filename,
          CASE o_custkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS slot FROM orders""",
    ),
    "display_texts": (
        display_texts,
        """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name AS bytes,
          CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'NULL' END AS maybe,
          '[' || c_custkey || ',1]' AS list FROM customer""",
    ),
    "grid_search": (
        grid_search, "SELECT * FROM customer WHERE lower(c_name) LIKE '%mach%' OR lower(c_mktsegment) LIKE '%mach%'",
    ),
    "grid_sort": (grid_sort, "SELECT * FROM customer"),
    "grid_page": (
        grid_page, "SELECT * FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 25 OFFSET 75",
    ),
    "grid_next_page": (
        grid_next_page,
        """SELECT * FROM customer WHERE c_mktsegment > 'HOUSEHOLD' OR (c_mktsegment = 'HOUSEHOLD' AND c_custkey > 50)
        ORDER BY c_mktsegment, c_custkey LIMIT 25""",
    ),
    "grid_ranked_pages": (
        grid_ranked_pages,
        """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderkey) - 1 AS n FROM orders)
        SELECT n.* EXCLUDE (n), CAST(n // 25 AS INTEGER) AS page FROM n WHERE n // 25 IN (0, 31, 59)""",
    ),
    "grid_pages": (
        grid_pages, "SELECT count(*) AS rows, CAST(ceil(count(*) / 25.0) AS BIGINT) AS pages FROM lineitem",
    ),
}
