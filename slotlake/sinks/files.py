"""File sinks: bulk documents, INSERT statements, tab files, rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotlake.functions.cells import parse_bool_lenient, trim_cell
from slotlake.functions.rows import sql_rows
from slotlake.operators.numbering import batch_index
from slotlake.schema import Column


def bulk_documents(
    df: DataFrame, columns: list[Column], index: str, cluster: str | None = None
) -> DataFrame:
    """One `{"insert":{...}}` JSON text per typed row; NULL values are left out.

    Keys are in name order. JSON cells become nested values, not strings.
    """

    def value(col: Column):
        if col.type == "attr_json":
            # A JSON null is no value at all.
            parsed = F.parse_json(F.when(F.col(col.name) != "null", F.col(col.name)))
            return parsed.alias(col.name)
        return F.col(col.name)

    doc = F.struct(*[value(c) for c in sorted(columns, key=lambda c: c.name)])
    parts = [doc.alias("doc"), F.col("id"), F.lit(index).alias("index")]
    if cluster:
        parts.insert(0, F.lit(cluster).alias("cluster"))
    insert = F.struct(F.struct(*parts).alias("insert"))
    keep = [c for c in ("line_no",) if c in df.columns]
    return df.select(*keep, "id", F.to_json(insert).alias("value"))


def write_bulk_ndjson(
    df: DataFrame,
    path: str,
    columns: list[Column],
    index: str,
    cluster: str | None = None,
    batch: int = 10_000,
) -> None:
    """NDJSON files of at most `batch` documents each; no shuffle."""
    (
        bulk_documents(df, columns, index, cluster)
        .select("value")
        .write.option("maxRecordsPerFile", max(batch, 1))
        .text(path)
    )


def insert_statements(
    df: DataFrame,
    columns: list[Column],
    table: str,
    batch: int = 1,
    number: str = "row_no",
    escape_backslash: bool = True,
) -> DataFrame:
    """Multi-row INSERT statements of `batch` rows each, in the order of the dense
    1-based `number` column. A group never holds more than `batch` rows."""
    names = ["id", *[c.name for c in columns]]
    ordered = df.select(F.col(number).alias("line_no"), *names)
    literals = sql_rows(ordered, columns, escape_backslash)
    tuples = literals.select(
        F.col("line_no").alias("_n"),
        F.concat(F.lit("("), F.concat_ws(", ", *names), F.lit(")")).alias("_row"),
    )
    head = f"INSERT INTO {table} ({', '.join(names)}) VALUES "
    return (
        batch_index(tuples, batch, "_n")
        .groupBy("batch_no")
        .agg(F.array_sort(F.collect_list(F.struct("_n", "_row"))).alias("_rows"))
        .select(
            "batch_no",
            F.size("_rows").alias("rows"),
            F.concat(
                F.lit(head), F.array_join(F.col("_rows._row"), ", "), F.lit(";")
            ).alias("statement"),
        )
    )


def write_insert_sql(
    df: DataFrame,
    path: str,
    columns: list[Column],
    table: str,
    batch: int = 1,
    number: str = "row_no",
) -> None:
    """INSERT statements as text files, in batch order over the files."""
    statements = insert_statements(df, columns, table, batch, number)
    statements.orderBy("batch_no").select("statement").write.text(path)


def tsv_lines(df: DataFrame, columns: list[Column]) -> DataFrame:
    """`line_no`, `id` and `cells` to tab lines. The id leads, cells stay as they
    are except booleans, which become 0 or 1; nothing is quoted."""
    bools = [i + 1 for i, c in enumerate(columns) if c.type == "attr_bool"]

    def cell(x, i):
        flag = F.when(parse_bool_lenient(trim_cell(x)), F.lit("1")).otherwise(F.lit("0"))
        return F.when(i.isin(bools), flag).otherwise(x) if bools else x

    cells = F.transform("cells", cell)
    return df.select("line_no", F.array_join(cells, "\t").alias("value"))


def write_tsv(df: DataFrame, path: str, columns: list[Column]) -> None:
    tsv_lines(df, columns).select("value").write.text(path)


def write_rejects(rejects: DataFrame, path: str, job_id: str) -> None:
    """Add the rejects of one job; a rerun of the job replaces only its own rows."""
    (
        rejects.withColumn("job_id", F.lit(job_id))
        .write.partitionBy("job_id")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def publish(df: DataFrame, uri: str) -> str:
    """Write a built dataset to any URI Spark can reach; `_SUCCESS` marks it whole."""
    df.write.mode("overwrite").parquet(uri)
    return uri
