"""Queries: reading, numbering and converting delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotlake.functions import rows as R
from slotlake.operators import numbering as N
from slotlake.schema import columns_of, struct_type
from slotlake.showcase.common import ORDERS_SQL, order_line, order_rows, table, text_of, write_lines
from slotlake.sinks import files as K
from slotlake.sources import datasets as DS
from slotlake.sources import delimited as D
from slotlake.session import scratch_path

PART_COLUMNS = columns_of(
    ("name", "attr_string"), ("size", "attr_uint"), ("price", "attr_float")
)


def part_file(spark: SparkSession, sf_dir: str) -> str:
    """`part` as CSV text with dirty rows: bad numbers, dropped and empty cells."""
    k = F.col("p_partkey")
    name = text_of('"', F.col("p_name"), ', ""', F.col("p_brand"), '"""')
    size = (
        F.when(k % 17 == 0, text_of("x", F.col("p_size")))
        .when(k % 23 == 0, F.lit(""))
        .otherwise(F.col("p_size").cast("string"))
    )
    price = F.when(k % 19 == 0, F.lit("")).otherwise(text_of(",", F.col("p_retailprice")))
    line = F.concat(text_of(k, ","), name, F.lit(","), size, price)
    return write_lines(table(spark, sf_dir, "part"), line, "p_partkey", "part")


def part_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = D.read_delimited(spark, part_file(spark, sf_dir), len(PART_COLUMNS))
    return R.convert_rows(raw, PART_COLUMNS)


PART_SQL = """p AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS line_no FROM part)"""
PART_REJECTS_SQL = f"""{PART_SQL}, r AS (
  SELECT line_no AS line, '' AS "column", '' AS value,
         'expected 3 data columns (plus ID), got 3 total columns' AS reason
  FROM p WHERE p_partkey % 19 = 0
  UNION ALL
  SELECT line_no, 'size', 'x' || p_size, 'invalid unsigned integer'
  FROM p WHERE p_partkey % 17 = 0 AND p_partkey % 19 <> 0)"""


def import_good_rows(spark, sf_dir):
    return R.good_rows(part_converted(spark, sf_dir))


def import_rejects(spark, sf_dir):
    return R.reject_rows(part_converted(spark, sf_dir))


def reject_summary(spark, sf_dir):
    return R.reject_summary(R.reject_rows(part_converted(spark, sf_dir)))


def reject_log(spark, sf_dir):
    return R.reject_text(R.reject_rows(part_converted(spark, sf_dir)))


def rejects_written(spark, sf_dir):
    path = scratch_path(spark, "rejects")
    rejects = R.reject_rows(part_converted(spark, sf_dir))
    K.write_rejects(rejects, path, "job-1")
    return spark.read.schema(f"{R.REJECT_DDL}, job_id string").parquet(path)


def import_counters(spark, sf_dir):
    return R.import_counters(part_converted(spark, sf_dir))


# --- numbering ---------------------------------------------------------------

CUSTOMER_COLUMNS = columns_of(
    ("name", "attr_string"), ("nation", "attr_uint"), ("balance", "attr_float")
)


def customer_file(spark, sf_dir, header="name,nation,balance", suffix=""):
    """`customer` without its key, so ids have to be made."""
    line = text_of(F.col("c_name"), ",", F.col("c_nationkey"), ",", F.col("c_acctbal"))
    return write_lines(
        table(spark, sf_dir, "customer"), line, "c_custkey", "customer", header, suffix
    )


def auto_id_from_one(spark, sf_dir):
    raw = D.read_delimited(spark, customer_file(spark, sf_dir, None), 3, header=False)
    return R.good_rows(R.convert_rows(raw, CUSTOMER_COLUMNS))


def auto_id_from_zero(spark, sf_dir):
    raw = D.read_lines_split(spark, customer_file(spark, sf_dir, None), header=False)
    return R.good_rows(R.convert_rows(raw, CUSTOMER_COLUMNS, lenient_bool=True))


def headers_skipped(spark, sf_dir):
    """Header found by itself in every file of a directory, ids still dense."""
    raw = D.read_delimited(spark, customer_file(spark, sf_dir), 3)
    return R.good_rows(R.convert_rows(raw, CUSTOMER_COLUMNS)).drop("line_no")


def line_numbers(spark, sf_dir):
    raw = D.read_delimited(spark, customer_file(spark, sf_dir, None), 3, header=False)
    return raw.select("line_no", F.col("cells")[1].alias("name"))


def table_row_numbers(spark, sf_dir):
    """Rows of a parquet table numbered in file order, row by row."""
    numbered = N.dense_numbers(N.with_positions(table(spark, sf_dir, "orders")))
    return numbered.select("o_orderkey", "record_no")


def chunk_checkpoints(spark, sf_dir):
    """The line to resume from behind each chunk, and the row that stands there."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "_metadata")
    numbered = N.dense_numbers(N.with_positions(rows), "line_no").drop("_metadata")
    points = N.chunk_checkpoints(numbered, "line_no", "line_no", batch_size=1000, workers=4)
    return points.join(numbered, F.col("last_line") == F.col("line_no")).drop("line_no")


def resume_from_line(spark, sf_dir):
    path = write_lines(order_rows(spark, sf_dir), order_line(), "id", "orders")
    raw = D.read_delimited(spark, path, 4)
    columns = columns_of(
        ("cust", "attr_bigint"), ("status", "attr_string"), ("price", "attr_float"),
        ("day", "attr_timestamp"),
    )
    return R.good_rows(R.convert_rows(R.after_line(raw, 1000), columns))


# --- scans -------------------------------------------------------------------


def variable_width(spark, sf_dir):
    """Rows of one to four cells, all kept."""
    k = F.col("c_custkey")
    line = F.concat(
        text_of(k),
        F.when(k % 4 >= 1, text_of(",", F.col("c_name"))).otherwise(""),
        F.when(k % 4 >= 2, text_of(',"', F.col("c_mktsegment"), ',x"')).otherwise(""),
        F.when(k % 4 >= 3, F.lit(",")).otherwise(""),
    )
    path = write_lines(table(spark, sf_dir, "customer"), line, "c_custkey", "wide")
    raw = D.read_delimited(spark, path, 2)
    return raw.select(
        "line_no", F.size("cells").alias("width"), F.array_join("cells", "|").alias("cells")
    )


def records_over_lines(spark, sf_dir):
    """Whole documents as quoted cells, line breaks and quotes included."""
    line = F.concat(
        text_of(F.col("doc_id"), ',"'),
        F.replace("text", F.lit('"'), F.lit('""')),
        text_of('",', F.col("lang")),
    )
    path = write_lines(table(spark, sf_dir, "documents"), line, "doc_id", "docs")
    raw = D.read_delimited(spark, path, 2)
    return raw.select(
        "line_no",
        F.col("cells")[0].cast("bigint").alias("doc_id"),
        F.md5(F.col("cells")[1]).alias("text_md5"),
        F.length(F.col("cells")[1]).cast("bigint").alias("chars"),
        F.col("cells")[2].alias("lang"),
    )


def raw_lines(spark, sf_dir):
    """No quoting rule: quotes stay, every delimiter splits, blank lines drop out."""
    line = F.concat(
        text_of('"', F.col("c_name"), '"\t', F.col("c_mktsegment"), ', "x"\t'),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("\n")).otherwise(""),
    )
    path = write_lines(
        table(spark, sf_dir, "customer"), line, "c_custkey", "raw", suffix=".tsv"
    )
    raw = D.read_lines_split(spark, path, header=False)
    return raw.select(
        "line_no", F.size("cells").alias("width"), F.array_join("cells", "|").alias("cells")
    )


def tsv_scan(spark, sf_dir):
    """Tab separated by its extension; commas are plain text."""
    line = text_of(F.col("s_suppkey"), "\t", F.col("s_name"), ", x\t", F.col("s_acctbal"))
    path = write_lines(
        table(spark, sf_dir, "supplier"), line, "s_suppkey", "supp", suffix=".TSV"
    )
    columns = columns_of(("name", "field"), ("balance", "attr_float"))
    return R.good_rows(R.convert_rows(D.read_delimited(spark, path, 2), columns))


def header_detection(spark, sf_dir):
    """The same data with and without a header line: what detection says."""
    customer = table(spark, sf_dir, "customer")
    numbers = text_of(F.col("c_custkey"), ",", F.col("c_name"))
    with_header = write_lines(customer, numbers, "c_custkey", "h1", "key,name")
    without = write_lines(customer, numbers, "c_custkey", "h2")
    return customer.agg(
        F.count("*").alias("rows"),
        F.lit(D.has_header(spark, with_header)).alias("with_header"),
        F.lit(D.has_header(spark, without)).alias("without_header"),
    )


def preview_rows(spark, sf_dir):
    first = D.preview(spark, part_file(spark, sf_dir), 25)
    return first.select("line_no", F.array_join("cells", "|").alias("cells"))


def typed_schema(spark, sf_dir):
    """Converted columns with their Spark and logical types, next to a row count."""
    good = R.good_rows(part_converted(spark, sf_dir)).drop("line_no")
    logical = {f.name: f.metadata.get("logical_type", "id") for f in struct_type(PART_COLUMNS)}
    pairs = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(logical[n]).alias("logical"))
            for n, t in good.dtypes
        ]
    )
    return good.agg(F.count("*").alias("rows")).select(
        F.explode(pairs).alias("c"), "rows"
    ).select("c.name", "c.type", "c.logical", "rows")


# --- sinks -------------------------------------------------------------------

SUPPLIER_COLUMNS = columns_of(("balance", "attr_float"), ("name", "attr_string"))


def _suppliers(spark, sf_dir):
    """`supplier` as typed rows with a quote in each name, numbered in file order."""
    rows = N.dense_numbers(N.with_positions(table(spark, sf_dir, "supplier")), "row_no")
    return rows.select(
        F.col("s_suppkey").alias("id"),
        text_of(F.col("s_name"), "'s").alias("name"),
        F.col("s_acctbal").alias("balance"),
        "row_no",
    )


def insert_batches(spark, sf_dir):
    return K.insert_statements(_suppliers(spark, sf_dir), SUPPLIER_COLUMNS, "supplier", batch=7)


def insert_file(spark, sf_dir):
    path = scratch_path(spark, "inserts")
    K.write_insert_sql(_suppliers(spark, sf_dir), path, SUPPLIER_COLUMNS, "supplier", batch=1)
    return spark.read.text(path).withColumnRenamed("value", "statement")


def sql_literals(spark, sf_dir):
    return R.sql_rows(_suppliers(spark, sf_dir).drop("row_no"), SUPPLIER_COLUMNS)


EVENT_COLUMNS = columns_of(
    ("kind", "attr_string"), ("props", "attr_json"), ("user", "attr_bigint")
)


def ndjson_docs(spark, sf_dir):
    """Bulk documents; props nest as an object, and JSON null leaves the key out."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 9 == 0, F.lit("null")).otherwise(F.col("props")).alias("props"),
        F.col("user_id").alias("user"),
    )
    return K.bulk_documents(events, EVENT_COLUMNS, "events", cluster="main").select(
        "id", "value"
    )


def ndjson_file(spark, sf_dir):
    path = scratch_path(spark, "bulk")
    K.write_bulk_ndjson(
        _suppliers(spark, sf_dir), path, SUPPLIER_COLUMNS, "supplier", batch=1000
    )
    schema = (
        "insert struct<index:string,id:bigint,doc:struct<name:string,balance:double>>"
    )
    return spark.read.schema(schema).json(path).select(
        "insert.index", "insert.id", "insert.doc.name", "insert.doc.balance"
    )


def tsv_rewrite(spark, sf_dir):
    """Index path: new ids from 0, any boolean spelling to 0 or 1, no quoting."""
    flag = F.when(F.col("c_custkey") % 3 == 0, "YES").when(F.col("c_custkey") % 3 == 1, "on")
    line = F.concat(
        text_of(F.col("c_name"), ","), flag.otherwise(" t "), text_of(",", F.col("c_nationkey"))
    )
    path = write_lines(table(spark, sf_dir, "customer"), line, "c_custkey", "rw")
    columns = columns_of(("name", "field"), ("flag", "attr_bool"), ("nation", "attr_uint"))
    out = scratch_path(spark, "tsv")
    K.write_tsv(D.read_lines_split(spark, path, header=False), out, columns)
    return spark.read.text(out).withColumnRenamed("value", "line")


def publish_and_load(spark, sf_dir):
    path = K.publish(order_rows(spark, sf_dir), scratch_path(spark, "built"))
    return DS.load_prebuilt(spark, path)


def loaded_row_count(spark, sf_dir):
    path = K.publish(table(spark, sf_dir, "lineitem"), scratch_path(spark, "loaded"))
    return DS.load_prebuilt(spark, path).agg(F.count("*").alias("rows"))


_PLAIN = "regexp_replace(CAST(s_acctbal AS VARCHAR), '\\.0$', '')"
_SUPP = "s AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier)"
_TUPLE = f"'(' || s_suppkey || ', ' || {_PLAIN} || ', ''' || s_name || '\\''s'')'"
_HEAD = "'INSERT INTO supplier (id, balance, name) VALUES '"
_CUST = "c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)"

QUERIES = {
    "import_good_rows": (
        import_good_rows,
        f"""WITH {PART_SQL} SELECT line_no, p_partkey AS id,
          p_name || ', "' || p_brand || '"' AS name,
          CAST(CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE p_size END AS BIGINT) AS size,
          p_retailprice AS price
        FROM p WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0""",
    ),
    "import_rejects": (
        import_rejects,
        f'WITH {PART_REJECTS_SQL} SELECT line, "column", value, reason FROM r',
    ),
    "reject_summary": (
        reject_summary,
        f"""WITH {PART_REJECTS_SQL} SELECT "column",
          CASE WHEN "column" = '' THEN 'expected 3 data columns (plus ID), got' ELSE reason END AS reason,
          count(*) AS rows, min(line) AS first_line FROM r GROUP BY 1, 2""",
    ),
    "reject_log": (
        reject_log,
        f"""WITH {PART_REJECTS_SQL} SELECT line, 'line ' || line || ': column "' || "column" || '": '
          || reason || CASE WHEN value <> '' THEN ' (value: "' || value || '")' ELSE '' END AS message FROM r""",
    ),
    "rejects_written": (
        rejects_written,
        f"""WITH {PART_REJECTS_SQL} SELECT line, "column", value, reason, 'job-1' AS job_id FROM r""",
    ),
    "import_counters": (
        import_counters,
        """SELECT count(*) FILTER (WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0) AS processed,
          count(*) FILTER (WHERE p_partkey % 17 = 0 OR p_partkey % 19 = 0) AS failed,
          count(*) AS last_line FROM part""",
    ),
    "auto_id_from_one": (
        auto_id_from_one,
        f"""WITH {_CUST} SELECT n AS line_no, n AS id, c_name AS name,
          CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM c""",
    ),
    "auto_id_from_zero": (
        auto_id_from_zero,
        f"""WITH {_CUST} SELECT n AS line_no, n - 1 AS id, c_name AS name,
          CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM c""",
    ),
    "headers_skipped": (
        headers_skipped,
        f"""WITH {_CUST} SELECT n AS id, c_name AS name,
          CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM c""",
    ),
    "line_numbers": (
        line_numbers, f"WITH {_CUST} SELECT n AS line_no, c_name AS name FROM c",
    ),
    "table_row_numbers": (
        table_row_numbers,
        "SELECT o_orderkey, row_number() OVER () AS record_no FROM orders",
    ),
    "chunk_checkpoints": (
        chunk_checkpoints,
        """WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER () AS n FROM lineitem)
        SELECT CAST((n - 1) // 8000 AS BIGINT) AS chunk_no, count(*) AS records, max(n) AS last_line,
          arg_max(l_orderkey, n) AS l_orderkey, arg_max(l_linenumber, n) AS l_linenumber FROM n GROUP BY 1""",
    ),
    "resume_from_line": (
        resume_from_line,
        f"""WITH o AS ({ORDERS_SQL}), n AS (SELECT *, row_number() OVER (ORDER BY id) AS line_no FROM o)
        SELECT line_no, id, cust, status, price, day FROM n WHERE line_no > 1000""",
    ),
    "variable_width": (
        variable_width,
        f"""WITH {_CUST} SELECT n AS line_no, CAST(1 + c_custkey % 4 AS INTEGER) AS width,
          c_custkey || CASE WHEN c_custkey % 4 >= 1 THEN '|' || c_name ELSE '' END
          || CASE WHEN c_custkey % 4 >= 2 THEN '|' || c_mktsegment || ',x' ELSE '' END
          || CASE WHEN c_custkey % 4 >= 3 THEN '|' ELSE '' END AS cells FROM c""",
    ),
    "records_over_lines": (
        records_over_lines,
        """SELECT row_number() OVER (ORDER BY doc_id) AS line_no, doc_id, md5(text) AS text_md5,
          CAST(length(text) AS BIGINT) AS chars, lang FROM documents""",
    ),
    "raw_lines": (
        raw_lines,
        f"""WITH {_CUST} SELECT n AS line_no, CAST(4 AS INTEGER) AS width,
          (n - 1) || '|"' || c_name || '"|' || c_mktsegment || ', "x"|' AS cells FROM c""",
    ),
    "tsv_scan": (
        tsv_scan,
        f"""WITH {_SUPP} SELECT n AS line_no, s_suppkey AS id, s_name || ', x' AS name,
          s_acctbal AS balance FROM s""",
    ),
    "header_detection": (
        header_detection,
        "SELECT count(*) AS rows, true AS with_header, false AS without_header FROM customer",
    ),
    "preview_rows": (
        preview_rows,
        f"""WITH {PART_SQL} SELECT line_no, p_partkey || '|' || p_name || ', "' || p_brand || '"|'
          || CASE WHEN p_partkey % 17 = 0 THEN 'x' || p_size WHEN p_partkey % 23 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END
          || CASE WHEN p_partkey % 19 = 0 THEN '' ELSE '|' || p_retailprice END AS cells
        FROM p ORDER BY line_no LIMIT 25""",
    ),
    "typed_schema": (
        typed_schema,
        """WITH n AS (SELECT count(*) AS rows FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0)
        SELECT t.name, t.type, t.logical, n.rows FROM (VALUES ('id','bigint','id'),
          ('name','string','attr_string'), ('size','bigint','attr_uint'),
          ('price','double','attr_float')) AS t(name, type, logical), n""",
    ),
    "insert_batches": (
        insert_batches,
        f"""WITH {_SUPP} SELECT CAST((n - 1) // 7 AS BIGINT) AS batch_no, CAST(count(*) AS INTEGER) AS rows,
          {_HEAD} || string_agg({_TUPLE}, ', ' ORDER BY n) || ';' AS statement FROM s GROUP BY 1""",
    ),
    "insert_file": (
        insert_file, f"WITH {_SUPP} SELECT {_HEAD} || {_TUPLE} || ';' AS statement FROM s",
    ),
    "sql_literals": (
        sql_literals,
        f"""SELECT CAST(s_suppkey AS VARCHAR) AS id, {_PLAIN} AS balance,
          '''' || s_name || '\\''s''' AS name FROM supplier""",
    ),
    "ndjson_docs": (
        ndjson_docs,
        """SELECT event_id AS id, '{"insert":{"cluster":"main","doc":{"kind":"' || event_type || '",'
          || CASE WHEN event_id % 9 = 0 THEN '' ELSE '"props":' || replace(props, ' ', '') || ',' END
          || '"user":' || user_id || '},"id":' || event_id || ',"index":"events"}}' AS value FROM events""",
    ),
    "ndjson_file": (
        ndjson_file,
        """SELECT 'supplier' AS index, s_suppkey AS id, s_name || '''s' AS name,
          s_acctbal AS balance FROM supplier""",
    ),
    "tsv_rewrite": (
        tsv_rewrite,
        f"""WITH {_CUST} SELECT (n - 1) || chr(9) || c_name || chr(9)
          || CASE WHEN c_custkey % 3 = 1 THEN '0' ELSE '1' END || chr(9) || c_nationkey AS line FROM c""",
    ),
    "publish_and_load": (publish_and_load, ORDERS_SQL),
    "loaded_row_count": (loaded_row_count, "SELECT count(*) AS rows FROM lineitem"),
}
