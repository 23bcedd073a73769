"""Names, paths, addresses and environment values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from slotlake.functions.cells import INT_RE, trim_cell
from slotlake.schema import SLOTS

# Ports of the SQL and the replication endpoint.
SQL_PORT = 9306
REPLICATION_PORT = 9312

ZERO_UUID = "00000000-0000-0000-0000-000000000000"


def base_name(name: SparkColumn) -> SparkColumn:
    return F.regexp_replace(name, r"(?:_main_a|_main_b|_delta)\z", "")


def main_name(table: SparkColumn, slot: SparkColumn) -> SparkColumn:
    return F.concat(table, F.lit("_main_"), slot)


def delta_name(table: SparkColumn) -> SparkColumn:
    return F.concat(table, F.lit("_delta"))


def locals_of_ddl(ddl: SparkColumn) -> SparkColumn:
    """Values of the `local='x'` tokens of a table's DDL text, in order."""
    tokens = F.filter(F.split(ddl, " "), lambda t: t.startswith("local='"))
    return F.transform(tokens, lambda t: F.regexp_extract(t, r"^local='(.*?)'?\z", 1))


def name_set(text: SparkColumn) -> SparkColumn:
    """Comma list to distinct, trimmed, non-empty names."""
    names = F.transform(F.split(text, ","), lambda p: trim_cell(p))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def active_slot(table: SparkColumn, locals_: SparkColumn) -> SparkColumn:
    """Slot of the first local that is a main table of `table`, else empty."""
    mains = F.filter(
        locals_, lambda n: n.isin(*[main_name(table, F.lit(s)) for s in SLOTS])
    )
    return F.coalesce(F.right(F.get(mains, F.lit(0)), F.lit(1)), F.lit(""))


def snapshot_slot(filename: SparkColumn, table: SparkColumn) -> SparkColumn:
    """Slot letter in a snapshot name, NULL unless it is a valid one."""
    mark = F.concat(table, F.lit("_main_"))
    at = F.instr(filename, mark)
    slot = filename.substr(at + F.length(mark), F.lit(1))
    return F.when((at > 0) & slot.isin(*SLOTS), slot)


def snapshot_name(table: SparkColumn, at: SparkColumn) -> SparkColumn:
    """`<table>-<UTC time>.tar.gz`, whatever the session's time zone."""
    seconds = F.unix_seconds(at)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    clock = [
        F.lpad(part.cast("string"), 2, "0")
        for part in (F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    ]
    stamp = F.concat(day.cast("string"), F.lit("T"), F.concat_ws("-", *clock), F.lit("Z"))
    return F.concat(table, F.lit("-"), stamp, F.lit(".tar.gz"))


def last_segment(path: SparkColumn) -> SparkColumn:
    return F.element_at(F.split(path, "/"), -1)


def url_host(url: SparkColumn) -> SparkColumn:
    return F.try_parse_url(url, F.lit("HOST"))


def sql_address(url: SparkColumn, port: int = SQL_PORT) -> SparkColumn:
    """`host:port` of the SQL endpoint behind a URL, empty without a host."""
    host = url_host(url)
    return F.coalesce(F.concat(host, F.lit(f":{port}")), F.lit(""))


def replication_address(
    workload: SparkColumn, index: SparkColumn, port: int = REPLICATION_PORT
) -> SparkColumn:
    """`workload-index.workload:port`."""
    return F.concat(
        workload, F.lit("-"), index.cast("string"), F.lit("."), workload, F.lit(f":{port}")
    )


def replication_address_of_url(url: SparkColumn, port: int = REPLICATION_PORT) -> SparkColumn:
    """Scheme and everything after the last colon are replaced."""
    rest = F.regexp_replace(F.regexp_replace(url, "^http://", ""), "^https://", "")
    return F.concat(F.regexp_replace(rest, r":[^:]*\z", ""), F.lit(f":{port}"))


def is_valid_uuid(exists: SparkColumn, uuid: SparkColumn) -> SparkColumn:
    return F.coalesce(exists & (uuid != "") & (uuid != ZERO_UUID), F.lit(False))


def env_list(overrides: SparkColumn) -> SparkColumn:
    """Variables of all overrides in one list, in order."""
    return F.flatten(F.transform(overrides, lambda o: F.coalesce(o["env"], F.array())))


def env_value(env: SparkColumn, name: str) -> SparkColumn:
    """First value of a named variable in a list of them, empty if there is none."""
    hits = F.filter(env, lambda e: (e["name"] == name) & e["value"].isNotNull())
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))


def env_int(env: SparkColumn, name: str) -> SparkColumn:
    """Like `env_value`, as integer; NULL if it is none."""
    text = env_value(env, name)
    return F.when(text.rlike(INT_RE), text.try_cast("bigint"))


def error_class(error: SparkColumn) -> SparkColumn:
    """Replica state behind an error text."""
    return (
        F.when(error.contains("no such host"), F.lit("not_in_use"))
        .when(error.contains("API error (503)"), F.lit("error"))
        .otherwise(F.lit("offline"))
    )


# Error texts worth another try.
RETRYABLE = (
    "connection reset", "connection refused", "i/o timeout", "EOF", "broken pipe",
)


def is_retryable(error: SparkColumn) -> SparkColumn:
    hit = F.lit(False)
    for text in RETRYABLE:
        hit = hit | F.coalesce(error.contains(text), F.lit(False))
    return hit


def deployment_message(version: SparkColumn, containers: SparkColumn) -> SparkColumn:
    """Version message, then container messages, one per line; blanks and repeats
    of the version message are left out."""
    own = F.filter(F.array(F.coalesce(version, F.lit(""))), lambda m: m != "")
    rest = F.filter(
        F.coalesce(containers, F.array().cast("array<string>")),
        lambda m: (m != "") & (m != F.coalesce(version, F.lit(""))),
    )
    return F.array_join(F.concat(own, rest), "\n")


def display_text(value: SparkColumn, data_type: str) -> SparkColumn:
    """Cell text for a result grid: bytes as UTF-8, objects as JSON, NULL spelled."""
    if data_type == "binary":
        text = F.decode(value, "UTF-8")
    elif data_type.startswith(("array", "map", "struct", "variant")):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("NULL"))
