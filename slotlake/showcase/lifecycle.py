"""Queries: slot tables, swaps, snapshots, ad-hoc SQL, streaming imports."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.functions.names import last_segment
from slotlake.plans import query as Q
from slotlake.plans import snapshots as S
from slotlake.plans.lake import DuplicateImportError, ImportFailedError, Lake
from slotlake.schema import columns_of, delta_name, main_name
from slotlake.session import delete_path, hadoop_path, materialize, scratch_path
from slotlake.showcase.common import (
    ORDER_COLUMNS,
    ORDERS_SQL,
    new_lake,
    order_line,
    order_rows,
    table,
    text_of,
    write_lines,
)
from slotlake.sinks import files as K
from slotlake.streaming import imports as ST


def _orders_file(spark, sf_dir, condition=None, line=None):
    rows = order_rows(spark, sf_dir)
    if condition is not None:
        rows = rows.where(condition)
    return write_lines(rows, order_line() if line is None else line, "id", "orders")


def _live_lake(spark, sf_dir):
    """Orders imported into slot a."""
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    lake.import_table("orders", _orders_file(spark, sf_dir))
    return lake


def import_and_read(spark, sf_dir):
    """CSV text through the whole import into the unified view."""
    return _live_lake(spark, sf_dir).table("orders")


def import_report(spark, sf_dir):
    """Counters of an import with a bad cell in every row of status P."""
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    bad = F.when(F.col("status") == "P", F.concat(order_line(), F.lit("?"))).otherwise(order_line())
    report = lake.import_table("orders", _orders_file(spark, sf_dir, line=bad))
    rejected = lake.rejects(report.job_id)
    return rejected.agg(F.count("*").alias("rejects"), F.min("column").alias("column")).select(
        F.lit(report.slot).alias("slot"),
        F.lit(report.processed).cast("bigint").alias("processed"),
        F.lit(report.failed).cast("bigint").alias("failed"),
        F.lit(report.last_line).cast("bigint").alias("last_line"),
        "rejects",
        "column",
    )


def indexer_import(spark, sf_dir):
    """Index method: own ids from 0, the order key as a plain column."""
    lake = new_lake(spark, "orders", [("key", "attr_bigint"), *ORDER_COLUMNS])
    lake.import_table("orders", _orders_file(spark, sf_dir), method="indexer", header=False)
    return lake.table("orders")


def main_delta_union(spark, sf_dir):
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    lake.import_table("orders", _orders_file(spark, sf_dir, "id % 10 < 9"))
    lake.append_delta("orders", order_rows(spark, sf_dir).where("id % 10 = 9"))
    return lake.table("orders")


def delta_compaction(spark, sf_dir):
    """Orders appended in three loads, one of them repeated under its id, then compacted."""
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    lake.ensure_tables()
    rows = order_rows(spark, sf_dir)
    for k in (0, 1, 2, 1):
        lake.append_delta("orders", rows.where(F.col("id") % 3 == k), f"load-{k}")
    before = lake.compact_delta("orders")
    after = lake.compact_delta("orders")
    return lake.table("orders").withColumns({"loads": F.lit(before), "remaining": F.lit(after)})


class _BusyLake(Lake):
    """A lake to which something happens while a compaction has read its loads."""

    meanwhile = None

    def delta(self, table):
        ledger = super().delta(table)
        plain = ledger.write

        def write(df):
            part, task = plain(df), self.meanwhile
            self.meanwhile = None
            if task:
                task()
            return part

        ledger.write = write
        return ledger


def _busy_lake(spark):
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    busy = _BusyLake(spark, lake.root, lake.registry, lake.database)
    busy.ensure_tables()
    return busy


def append_during_compaction(spark, sf_dir):
    """Two loads are compacted; a third one comes while they are being rewritten, and one
    of the two is repeated then. Every row is there once, and the third is a load still."""
    lake, rows = _busy_lake(spark), order_rows(spark, sf_dir)
    for k in (0, 1):
        lake.append_delta("orders", rows.where(F.col("id") % 3 == k), f"feed-{k}")
    lake.meanwhile = lambda: lake.append_delta("orders", rows.where("id % 3 = 2"), "feed-2")
    before = lake.compact_delta("orders")
    return lake.table("orders").withColumns(
        {"loads": F.lit(before), "remaining": F.lit(lake.compact_delta("orders"))}
    )


def replay_after_compaction(spark, sf_dir):
    """Batches of a feed that are repeated after they were compacted, as a stream does
    that lost its driver: they are known. A load replaced during a compaction stops it."""
    lake, rows = _busy_lake(spark), order_rows(spark, sf_dir)
    part = lambda k: rows.where(F.col("id") % 3 == k)
    for k in (0, 1):
        lake.append_delta("orders", part(k), f"feed-{k}")
    lake.meanwhile = lambda: lake.append_delta("orders", part(1), "feed-1")
    lake.compact_delta("orders")
    stopped = lake.compact_delta("orders")
    taken = [lake.append_delta("orders", part(k), f"feed-{k}") for k in (0, 1, 2)]
    return lake.table("orders").withColumns(
        {"loads_left": F.lit(stopped), "taken": F.lit(sum(taken)), "remaining": F.lit(lake.compact_delta("orders"))}
    )


def tiered_compaction(spark, sf_dir):
    """Eight loads of like size, compacted by twos after each: the rows are there once,
    in as many loads as eight has bits set, and a row was rewritten three times."""
    lake, rows = new_lake(spark, "orders", ORDER_COLUMNS), order_rows(spark, sf_dir)
    lake.ensure_tables()
    for k in range(8):
        lake.append_delta("orders", rows.where(F.pmod(F.hash("id"), F.lit(8)) == k), f"feed-{k}")
        while True:
            before = lake.delta("orders").log.latest()[1]["loads"]
            lake.compact_delta("orders", fan_in=2)
            if lake.delta("orders").log.latest()[1]["loads"].keys() == before.keys():
                break
    few = len(lake.delta("orders").log.latest()[1]["loads"]) <= 4
    return lake.table("orders").withColumn("few_loads", F.lit(few))


def interrupted_import(spark, sf_dir):
    """An import whose driver is lost right behind its swap, taken over and resumed: the
    record says completed, the table is whole, and the lost driver's next write is refused."""
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    path = _orders_file(spark, sf_dir)
    refused, plain = [], lake.swap

    def swap_and_vanish(table, slot):
        plain(table, slot)
        lake.unlock_import(table)  # by another driver

    lake.swap = swap_and_vanish
    try:
        lake.import_table("orders", path)
    except ImportFailedError as error:
        refused.append(str(error))
    lake.swap = plain
    interrupted = lake.import_jobs().head().status
    report = lake.import_table("orders", path, resume=None)
    return lake.table("orders").withColumns(
        {
            "refused": F.lit(len(refused)), "interrupted": F.lit(interrupted),
            "record": F.lit(lake.import_jobs().head().status), "slot": F.lit(report.slot),
        }
    )


def swap_then_read(spark, sf_dir):
    """Two imports; the second one is live and in the other slot."""
    lake = _live_lake(spark, sf_dir)
    second = F.concat(order_line(), F.lit(" 12:00:00"))
    report = lake.import_table("orders", _orders_file(spark, sf_dir, line=second))
    return lake.table("orders").withColumn("slot", F.lit(report.slot))


def failed_import_keeps_old(spark, sf_dir):
    """An import that rejects rows fails before its swap; the old rows stay."""
    lake = _live_lake(spark, sf_dir)
    try:
        broken = F.concat(order_line(), F.lit(",x"))
        lake.import_table("orders", _orders_file(spark, sf_dir, line=broken), max_failed=0)
    except ImportFailedError:
        pass
    return lake.table("orders").withColumns(
        {
            "slot": F.lit(lake.active_slot("orders")),
            "half_built": F.lit(lake.exists(main_name("orders", "b"))),
        }
    )


def resume_import(spark, sf_dir):
    """An import in parts fails at a bad line; with the line mended it goes on behind
    the finished parts, and the table holds all rows."""
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    last = F.col("id") == table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).head()[0]
    broken = F.when(last, F.concat(order_line(), F.lit("?"))).otherwise(order_line())
    path = _orders_file(spark, sf_dir, line=broken)
    part_lines = max(1, table(spark, sf_dir, "orders").count() // 3)
    try:
        lake.import_table("orders", path, max_failed=0, part_lines=part_lines)
    except ImportFailedError:
        pass
    done = lake.import_jobs().head().processed
    delete_path(spark, path)
    order_rows(spark, sf_dir).orderBy("id").select(order_line().alias("value")).write.text(path)
    report = lake.import_table("orders", path, max_failed=0, part_lines=part_lines, resume=True)
    return lake.table("orders").withColumns(
        {
            "resumed": F.lit(0 < done < report.processed),
            "slot": F.lit(report.slot),
            "processed": F.lit(report.processed).cast("bigint"),
        }
    )


def import_in_parts(spark, sf_dir):
    """Whole files in parts of some KB; the last part fails at a bad line, and the import
    resumes behind the finished ones."""
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    last = F.col("id") == table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).head()[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # several files
        path = _orders_file(spark, sf_dir, line=F.when(last, F.concat(order_line(), F.lit("?"))).otherwise(order_line()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    bad = spark.read.text(path).where("value LIKE '%?'").select(F.col("_metadata.file_path")).head()[0]
    try:
        lake.import_table("orders", path, max_failed=0, part_bytes=1 << 14)
    except ImportFailedError:
        pass
    done = lake.import_jobs().head().processed
    # The list of files is that of the beginning, so the bad one is mended in place.
    mended = materialize(spark.read.text(bad).select(F.rtrim("value", F.lit("?")).alias("value")), "mended")
    draft = scratch_path(spark, "draft")
    mended.coalesce(1).write.text(draft)
    made = spark.read.text(draft).select(F.col("_metadata.file_path")).head()[0]
    fs, old = hadoop_path(spark, bad)
    fs.delete(old, False)
    fs.rename(hadoop_path(spark, made)[1], old)
    report = lake.import_table("orders", path, max_failed=0, part_bytes=1 << 14, resume=True)
    return lake.table("orders").withColumns(
        {"resumed": F.lit(0 < done < report.processed), "last_line": F.lit(report.last_line).cast("bigint")}
    )


def duplicate_import_refused(spark, sf_dir):
    """While an import of a table runs, another one of it is refused."""
    lake = _live_lake(spark, sf_dir)
    refused = False
    with lake._only_import("orders"):
        try:
            lake.import_table("orders", _orders_file(spark, sf_dir, "status = 'F'"))
        except DuplicateImportError:
            refused = True
    return lake.table("orders").withColumn("refused", F.lit(refused))


def delta_restore_failure_keeps_old(spark, sf_dir):
    """A delta whose new rows cannot be written keeps its old ones, in view."""
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    lake.ensure_tables()
    lake.append_delta("orders", order_rows(spark, sf_dir))
    failing = order_rows(spark, sf_dir).withColumn(
        "cust", F.when(F.col("id") > 0, F.raise_error(F.lit("broken file")).cast("bigint"))
    )
    failed = False
    try:
        lake.load_table(failing, delta_name("orders"))
    except Exception:
        failed = True
    return lake.table("orders").withColumn("failed", F.lit(failed))


def ensure_tables(spark, sf_dir):
    """Empty typed tables, then the delta filled: the view shows it."""
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    lake.ensure_tables()
    lake.ensure_tables()
    lake.append_delta("orders", order_rows(spark, sf_dir))
    return lake.table("orders")


def table_listing(spark, sf_dir):
    """Every table of the database with its rows."""
    lake = _live_lake(spark, sf_dir)
    names = ("orders", main_name("orders", "a"), delta_name("orders"))
    counts = [
        lake.table(n).agg(F.count("*").alias("rows")).withColumn("name", F.lit(n)) for n in names
    ]
    return lake.tables().join(reduce(DataFrame.unionByName, counts), "name", "left")


def backup_restore(spark, sf_dir):
    """Back up, import something else, restore: the first rows are live again."""
    lake = _live_lake(spark, sf_dir)
    root = scratch_path(spark, "snapshots")
    name = S.backup(lake, main_name("orders", "a"), root)
    lake.import_table("orders", _orders_file(spark, sf_dir, "status = 'F'"))
    S.restore(lake, "orders", root, name)
    return lake.table("orders").withColumn("slot", F.lit(lake.active_slot("orders")))


def delta_restore(spark, sf_dir):
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    lake.ensure_tables()
    lake.append_delta("orders", order_rows(spark, sf_dir))
    root = scratch_path(spark, "snapshots")
    name = S.backup(lake, delta_name("orders"), root)
    lake.append_delta("orders", order_rows(spark, sf_dir))
    S.restore(lake, "orders", root, name, kind="delta")
    return lake.table("orders")


def snapshot_list(spark, sf_dir):
    """Listing by table and kind, with the rows each snapshot holds."""
    lake = _live_lake(spark, sf_dir)
    root = scratch_path(spark, "snapshots")
    for hour in (1, 2):
        now = datetime(2025, 1, 2, hour, tzinfo=timezone.utc)
        S.backup(lake, main_name("orders", "a"), root, now)
    S.backup(lake, delta_name("orders"), root, datetime(2025, 1, 2, 3, tzinfo=timezone.utc))
    # one that was never completed
    open_ = S.backup(lake, main_name("orders", "a"), root, datetime(2025, 1, 2, 4, tzinfo=timezone.utc))
    delete_path(spark, f"{root}/{open_}/_SUCCESS")
    listed = S.list_snapshots(spark, root, "orders", "main")
    rows = (
        spark.read.option("recursiveFileLookup", "true")
        .schema(lake.schema_of("orders"))
        .parquet(root)
        .groupBy(last_segment(F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).alias("filename"))
        .agg(F.count("*").alias("rows"))
    )
    return listed.select("filename", (F.col("size") > 0).alias("has_data")).join(
        rows, "filename", "left"
    )


def rotate_slots(spark, sf_dir):
    lake = _live_lake(spark, sf_dir)
    later = order_rows(spark, sf_dir).withColumn("day", F.col("day") + 1)
    lake.load_table(later, main_name("orders", "b"))
    lake.rotate("orders", "b", "a")
    return lake.table("orders").withColumn("slot", F.lit(lake.active_slot("orders")))


def prebuilt_import(spark, sf_dir):
    lake = _live_lake(spark, sf_dir)
    later = order_rows(spark, sf_dir).withColumn("day", F.col("day") + 1)
    path = K.publish(later, scratch_path(spark, "built"))
    lake.import_prebuilt("orders", path)
    return lake.table("orders")


def stored_schema(spark, sf_dir):
    lake = _live_lake(spark, sf_dir)
    fields = [(f.name, f.dataType.simpleString()) for f in lake.schema_of("orders")]
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in fields])
    rows = lake.table("orders").agg(F.count("*").alias("rows"))
    return rows.select(F.explode(pairs).alias("c"), "rows").select("c.name", "c.type", "rows")


LINEITEM_COLUMNS = [
    ("part", "attr_bigint"), ("supplier", "attr_uint"), ("line", "attr_uint"),
    ("quantity", "attr_float"), ("price", "attr_float"), ("discount", "attr_float"),
    ("tax", "attr_float"), ("returned", "attr_string"), ("status", "field"),
    ("shipped", "attr_timestamp"), ("keys", "attr_multi"), ("express", "attr_bool"),
]


def lineitem_file(spark, sf_dir):
    """`lineitem` as CSV text with a date, a list and a boolean; every order whose
    key ends in 7 has a bad supplier."""
    supplier = F.when(F.col("l_orderkey") % 10 == 7, F.lit("none")).otherwise(
        F.col("l_suppkey").cast("string")
    )
    line = F.concat(
        text_of(F.col("l_orderkey"), ",", F.col("l_partkey"), ","), supplier,
        text_of(",", F.col("l_linenumber"), ",", F.col("l_quantity"), ",", F.col("l_extendedprice")),
        text_of(",", F.col("l_discount"), ",", F.col("l_tax"), ",", F.col("l_returnflag")),
        text_of(",", F.col("l_linestatus"), ","), F.date_format("l_shipdate", "yyyy-MM-dd"),
        text_of(',"', F.col("l_partkey"), ",", F.col("l_suppkey"), '",'),
        F.when(F.col("l_linenumber") == 1, "yes").otherwise("no"),
    )
    return write_lines(table(spark, sf_dir, "lineitem"), line, "l_orderkey", "lineitem")


def import_lineitem_file(spark, path):
    lake = new_lake(spark, "lineitem", LINEITEM_COLUMNS)
    lake.import_table("lineitem", path)
    return lake.table("lineitem")


def import_lineitem(spark, sf_dir):
    """The largest table through the whole import: twelve columns, a tenth rejected."""
    rows = import_lineitem_file(spark, lineitem_file(spark, sf_dir))
    return rows.withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), "|"))


# --- ad-hoc SQL ------------------------------------------------------------------

SUMMARY = (
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity "
    "FROM lineitem WHERE l_discount > 0.02 GROUP BY l_returnflag, l_linestatus"
)


def _copies(spark, sf_dir, conditions):
    """Databases that hold the table `lineitem`, one copy per condition. In a copy of
    the condition None one quantity is no number, so that a sum fails as it runs."""
    names = []
    for condition in conditions:
        lake = new_lake(spark, "unused", [("x", "field")])
        rows = table(spark, sf_dir, "lineitem")
        if condition is None:
            spoiled = F.when(F.col("l_orderkey") % 7 == 1, "n/a").otherwise(F.col("l_quantity").cast("string"))
            rows = rows.withColumn("l_quantity", spoiled)
        else:
            rows = rows.where(condition)
        rows.write.option("path", scratch_path(spark, "copy")).saveAsTable(
            f"{lake.database}.lineitem"
        )
        names.append(lake.database)
    return names


def sql_passthrough(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("slotlake_lineitem")
    return Q.query(spark, SUMMARY.replace("FROM lineitem", "FROM slotlake_lineitem")).df


def sql_metadata(spark, sf_dir):
    """Column names, types and the row count of a result."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("slotlake_lineitem")
    result = Q.query(spark, "SELECT l_orderkey, l_tax, l_returnflag FROM slotlake_lineitem").count()
    return spark.createDataFrame(
        [(c["name"], c["type"], result.row_count) for c in result.columns],
        "name string, type string, row_count bigint",
    )


def sql_target(spark, sf_dir):
    copies = _copies(spark, sf_dir, ["true", "l_linestatus = 'O'"])
    return Q.query_target(spark, SUMMARY, copies, 1).df


def sql_fallback(spark, sf_dir):
    """The first copy has no such table and the second fails while it runs, so the
    third one answers."""
    empty = new_lake(spark, "unused", [("x", "field")]).database
    copies = [empty, *_copies(spark, sf_dir, [None, "true"])]
    result = Q.query_any(spark, SUMMARY, copies)
    return result.df.withColumns(
        {"source_index": F.lit(result.source_index), "row_count": F.lit(result.row_count).cast("bigint")}
    )


def broadcast_union(spark, sf_dir):
    """A copy that fails while it runs and one without the table take nothing from the
    answers of the others."""
    copies = _copies(spark, sf_dir, ["true", None, "l_linestatus = 'O'"])
    copies.append(new_lake(spark, "unused", [("x", "field")]).database)
    out = Q.query_all(spark, SUMMARY, copies)
    rows = out.summary(spark).select("source_index", F.col("row_count").alias("copy_rows"))
    return out.df.withColumn("status", F.lit(out.status)).join(rows, "source_index")


# --- streaming ---------------------------------------------------------------------

EVENT_COLUMNS = columns_of(
    ("user", "attr_bigint"), ("kind", "attr_string"), ("value", "attr_float"), ("props", "attr_json")
)


def _event_files(spark, sf_dir, dirty=True):
    """`events` as CSV text; the value of every error is not a number."""
    value = F.col("value").cast("string")
    if dirty:
        value = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(value)
    line = F.concat(
        text_of(F.col("event_id"), ",", F.col("user_id"), ",", F.col("event_type"), ","),
        value, F.lit(',"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'),
    )
    return write_lines(table(spark, sf_dir, "events"), line, "event_id", "events")


def _stream(spark, source, target, checkpoint, **kw):
    run = ST.stream_import(spark, source, EVENT_COLUMNS, target, checkpoint, **kw)
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()


def stream_import(spark, sf_dir):
    target, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    _stream(spark, _event_files(spark, sf_dir), target, checkpoint)
    return ST.delta_rows(spark, target, EVENT_COLUMNS)


def _headed_events(spark, sf_dir):
    """`events` as lines without quotes or ids, a header on top of every file."""
    line = text_of(F.col("user_id"), ",", F.col("event_type"), ",", F.col("value"), ",{}")
    return write_lines(
        table(spark, sf_dir, "events"), line, "event_id", "events", header="user,kind,value,props"
    )


def stream_with_header(spark, sf_dir):
    """Files with headers, found out, in several batches: ids run on from 1."""
    target, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    source = _headed_events(spark, sf_dir)
    _stream(spark, source, target, checkpoint, header=None, auto_id=True, max_files_per_batch=3)
    return ST.delta_rows(spark, target, EVENT_COLUMNS).drop("id")


def stream_indexer(spark, sf_dir):
    """The indexer method: ids from 0, without a gap over batches and headers."""
    target, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    source = _headed_events(spark, sf_dir)
    _stream(spark, source, target, checkpoint, header=True, method="indexer", max_files_per_batch=3)
    ids = ST.delta_rows(spark, target, EVENT_COLUMNS)
    return ids.select("id")


def stream_rejects(spark, sf_dir):
    target, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    _stream(spark, _event_files(spark, sf_dir), target, checkpoint)
    return ST.delta_rejects(spark, target, EVENT_COLUMNS).groupBy("column", "reason").agg(
        F.count("*").alias("rows")
    )


def stream_resume(spark, sf_dir):
    """Two runs on one checkpoint, more files before the second: each row once."""
    source = scratch_path(spark, "incoming")
    target, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    lines = spark.read.text(_event_files(spark, sf_dir, dirty=False))
    kind = F.split("value", ",")[2]
    lines.where(kind < "m").write.mode("append").text(source)
    _stream(spark, source, target, checkpoint)
    lines.where(kind >= "m").write.mode("append").text(source)
    _stream(spark, source, target, checkpoint)
    return ST.delta_rows(spark, target, EVENT_COLUMNS)


def stream_progress(spark, sf_dir):
    target, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    _stream(spark, _event_files(spark, sf_dir), target, checkpoint, max_files_per_batch=2)
    return ST.progress(spark, target).agg(
        F.sum("processed").alias("processed"),
        F.sum("failed").alias("failed"),
        F.max("last_line").alias("last_line"),
    )


def stream_delta(spark, sf_dir):
    """Orders: all but status O imported, status O streamed into the delta table with
    a bad date in a tenth of them; the view shows both."""
    lake = new_lake(spark, "orders", ORDER_COLUMNS)
    lake.import_table("orders", _orders_file(spark, sf_dir, "status <> 'O'"))
    dirty = F.when(F.col("id") % 10 == 0, F.concat(order_line(), F.lit("T"))).otherwise(order_line())
    source = _orders_file(spark, sf_dir, "status = 'O'", dirty)
    target, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    run = ST.stream_into_delta(lake, "orders", source, target, checkpoint, max_files_per_batch=4)
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return lake.table("orders")


_EVENTS_SQL = """SELECT event_id AS id, user_id AS "user", event_type AS kind, value, props FROM events"""
_SUMMARY_SQL = SUMMARY.replace("WHERE", "WHERE {where} AND")

QUERIES = {
    "import_lineitem": (
        import_lineitem,
        """SELECT l_orderkey AS id, l_partkey AS part, l_suppkey AS supplier,
          CAST(l_linenumber AS BIGINT) AS line, l_quantity AS quantity, l_extendedprice AS price,
          l_discount AS discount, l_tax AS tax, l_returnflag AS returned, l_linestatus AS status,
          CAST(epoch(l_shipdate) AS BIGINT) AS shipped, l_partkey || '|' || l_suppkey AS keys,
          l_linenumber = 1 AS express FROM lineitem WHERE l_orderkey % 10 <> 7""",
    ),
    "import_and_read": (import_and_read, ORDERS_SQL),
    "import_report": (
        import_report,
        """SELECT 'a' AS slot, count(*) FILTER (WHERE o_orderstatus <> 'P') AS processed,
          count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) AS last_line,
          count(*) FILTER (WHERE o_orderstatus = 'P') AS rejects, 'day' AS "column" FROM orders""",
    ),
    "indexer_import": (
        indexer_import,
        f"""WITH o AS ({ORDERS_SQL}) SELECT row_number() OVER (ORDER BY id) - 1 AS id, id AS key,
          cust, status, price, day FROM o""",
    ),
    "main_delta_union": (main_delta_union, ORDERS_SQL),
    "delta_compaction": (
        delta_compaction,
        f"WITH o AS ({ORDERS_SQL}) SELECT *, CAST(3 AS INTEGER) AS loads, CAST(1 AS INTEGER) AS remaining FROM o",
    ),
    "swap_then_read": (
        swap_then_read,
        f"WITH o AS ({ORDERS_SQL}) SELECT id, cust, status, price, day + 43200 AS day, 'b' AS slot FROM o",
    ),
    "failed_import_keeps_old": (
        failed_import_keeps_old,
        f"WITH o AS ({ORDERS_SQL}) SELECT *, 'a' AS slot, false AS half_built FROM o",
    ),
    "resume_import": (
        resume_import,
        f"""WITH o AS ({ORDERS_SQL}) SELECT *, true AS resumed, 'a' AS slot,
          (SELECT count(*) FROM orders) AS processed FROM o""",
    ),
    "import_in_parts": (
        import_in_parts,
        f"""WITH o AS ({ORDERS_SQL}) SELECT *, true AS resumed, (SELECT count(*) FROM orders) AS last_line FROM o""",
    ),
    "duplicate_import_refused": (
        duplicate_import_refused, f"WITH o AS ({ORDERS_SQL}) SELECT *, true AS refused FROM o"
    ),
    "delta_restore_failure_keeps_old": (
        delta_restore_failure_keeps_old, f"WITH o AS ({ORDERS_SQL}) SELECT *, true AS failed FROM o"
    ),
    "ensure_tables": (ensure_tables, ORDERS_SQL),
    "table_listing": (
        table_listing,
        """SELECT t.name, t.type, t.slot,
          CASE t.name WHEN 'orders_delta' THEN 0 ELSE n.rows END AS rows
          FROM (VALUES ('orders','distributed','a'),
          ('orders_main_a','rt',''), ('orders_delta','rt','')) AS t(name, type, slot),
          (SELECT count(*) AS rows FROM orders) n""",
    ),
    "backup_restore": (backup_restore, f"WITH o AS ({ORDERS_SQL}) SELECT *, 'a' AS slot FROM o"),
    "delta_restore": (delta_restore, ORDERS_SQL),
    "append_during_compaction": (
        append_during_compaction,
        f"WITH o AS ({ORDERS_SQL}) SELECT *, 2 AS loads, 2 AS remaining FROM o",
    ),
    "replay_after_compaction": (
        replay_after_compaction,
        f"WITH o AS ({ORDERS_SQL}) SELECT *, 2 AS loads_left, 1 AS taken, 2 AS remaining FROM o",
    ),
    "tiered_compaction": (tiered_compaction, f"WITH o AS ({ORDERS_SQL}) SELECT *, true AS few_loads FROM o"),
    "interrupted_import": (
        interrupted_import,
        f"""WITH o AS ({ORDERS_SQL}) SELECT *, 1 AS refused, 'failed' AS interrupted,
          'completed' AS record, 'a' AS slot FROM o""",
    ),
    "snapshot_list": (
        snapshot_list,
        """SELECT t.filename, true AS has_data, n.rows FROM (VALUES
          ('orders_main_a-2025-01-02T02-00-00Z.parquet'), ('orders_main_a-2025-01-02T01-00-00Z.parquet')) AS t(filename),
          (SELECT count(*) AS rows FROM orders) n""",
    ),
    "rotate_slots": (
        rotate_slots,
        f"WITH o AS ({ORDERS_SQL}) SELECT id, cust, status, price, day + 1 AS day, 'b' AS slot FROM o",
    ),
    "prebuilt_import": (prebuilt_import, f"WITH o AS ({ORDERS_SQL}) SELECT id, cust, status, price, day + 1 AS day FROM o"),
    "stored_schema": (
        stored_schema,
        """SELECT t.name, t.type, n.rows FROM (VALUES ('id','bigint'), ('cust','bigint'),
          ('status','string'), ('price','double'), ('day','bigint')) AS t(name, type),
          (SELECT count(*) AS rows FROM orders) n""",
    ),
    "sql_passthrough": (sql_passthrough, SUMMARY),
    "sql_metadata": (
        sql_metadata,
        """SELECT t.name, t.type, n.row_count FROM (VALUES ('l_orderkey','bigint'), ('l_tax','double'),
          ('l_returnflag','string')) AS t(name, type), (SELECT count(*) AS row_count FROM lineitem) n""",
    ),
    "sql_target": (sql_target, _SUMMARY_SQL.format(where="l_linestatus = 'O'")),
    "sql_fallback": (
        sql_fallback,
        f"""WITH s AS ({SUMMARY}) SELECT *, CAST(2 AS INTEGER) AS source_index,
          (SELECT count(*) FROM s) AS row_count FROM s""",
    ),
    "broadcast_union": (
        broadcast_union,
        f"""WITH a AS ({SUMMARY}), b AS ({_SUMMARY_SQL.format(where="l_linestatus = 'O'")})
        SELECT *, CAST(0 AS INTEGER) AS source_index, 'partial' AS status,
          (SELECT count(*) FROM a) AS copy_rows FROM a
        UNION ALL SELECT *, 2, 'partial', (SELECT count(*) FROM b) FROM b""",
    ),
    "stream_import": (stream_import, f"{_EVENTS_SQL} WHERE event_type <> 'error'"),
    "stream_with_header": (
        stream_with_header,
        """SELECT user_id AS "user", event_type AS kind, value, '{}' AS props FROM events""",
    ),
    "stream_indexer": (stream_indexer, "SELECT row_number() OVER () - 1 AS id FROM events"),
    "stream_rejects": (
        stream_rejects,
        """SELECT 'value' AS "column", 'invalid float' AS reason, count(*) AS rows
        FROM events WHERE event_type = 'error'""",
    ),
    "stream_resume": (stream_resume, _EVENTS_SQL),
    "stream_delta": (
        stream_delta,
        f"WITH o AS ({ORDERS_SQL}) SELECT * FROM o WHERE status <> 'O' OR id % 10 <> 0",
    ),
    "stream_progress": (
        stream_progress,
        """SELECT count(*) FILTER (WHERE event_type <> 'error') AS processed,
          count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS last_line FROM events""",
    ),
}
