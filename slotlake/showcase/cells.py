"""Queries: cell grammars over whole tables. Texts are made by the key, so the right
value is known without parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotlake.functions import cells as C
from slotlake.functions import records as REC
from slotlake.functions import rows as R
from slotlake.schema import columns_of
from slotlake.showcase.common import seconds_of, table, text_of


def _pick(key, *choices):
    """choices[key % n]"""
    n = len(choices)
    out = F.when(key % n == 0, choices[0])
    for i, c in enumerate(choices[1:], start=1):
        out = out.when(key % n == i, c)
    return out


def _parsed(df, cell, parse, *keys):
    return df.select(*keys, cell.alias("cell")).select(
        *keys, "cell", parse(C.trim_cell(F.col("cell"))).alias("value")
    )


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )


def convert_uint(spark, sf_dir):
    p = F.col("l_partkey")
    cell = _pick(
        F.col("l_orderkey"),
        text_of("  ", p, "\t"), text_of("-", p), text_of(p, ".5"), F.lit(""),
        text_of(p + 4294966000), text_of("00", p), text_of(p),
    )
    return _parsed(_lineitem(spark, sf_dir), cell, C.parse_uint, "l_orderkey")


def convert_bigint(spark, sf_dir):
    p = F.col("l_partkey")
    cell = _pick(
        F.col("l_orderkey"),
        text_of("-", p), text_of("+", p), text_of(p, "e1"), F.lit(" "),
        text_of("99999999999999", p, "99999"), text_of(p, "-"), text_of(" ", p, " "),
    )
    return _parsed(_lineitem(spark, sf_dir), cell, C.parse_bigint, "l_orderkey")


def convert_float(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    cell = _pick(
        F.col("l_orderkey"),
        text_of(F.col("l_extendedprice")), text_of(q, "e3"), text_of("-", q, "."), F.lit(""),
        text_of(q, "e400"), F.lit("NaN"), text_of(q, "d"), text_of(".", q), text_of(q, "_000.25"),
        text_of("0x", q + 100, "p-2"),
    )
    return _parsed(_lineitem(spark, sf_dir), cell, C.parse_float, "l_orderkey")


WORDS = ("1", "TRUE", "yes", "On", " t ", "y", "0", "False", "no", "off", "f", "N", "", "2", "maybe", "yess")


def convert_bool_strict(spark, sf_dir):
    cell = _pick(F.col("l_orderkey"), *[F.lit(w) for w in WORDS])
    return _parsed(_lineitem(spark, sf_dir), cell, C.parse_bool, "l_orderkey", "l_partkey")


def convert_bool_lenient(spark, sf_dir):
    cell = _pick(F.col("l_orderkey"), *[F.lit(w) for w in WORDS])
    return _parsed(_lineitem(spark, sf_dir), cell, C.parse_bool_lenient, "l_orderkey", "l_partkey")


def convert_timestamp(spark, sf_dir):
    """Integer seconds, the eight layouts, zones, fractions, and days that do not
    exist."""
    key = F.col("o_orderkey")
    day_ts = F.timestamp_seconds(F.col("day"))
    at = F.timestamp_seconds(F.col("day") + key % 86400)

    def fmt(ts, pattern):
        return F.date_format(ts, pattern)

    east = F.timestamp_seconds(F.col("day") + key % 86400 + 5 * 3600 + 1800)
    west = F.timestamp_seconds(F.col("day") + key % 86400 - 8 * 3600)
    cell = _pick(
        key,
        text_of(F.col("day")),
        fmt(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        fmt(at, "yyyy-MM-dd HH:mm:ss"),
        fmt(at, "yyyy-MM-dd'T'HH:mm:ss"),
        fmt(day_ts, "yyyy-MM-dd"),
        fmt(day_ts, "MM/dd/yyyy"),
        fmt(at, "MM/dd/yyyy HH:mm:ss"),
        fmt(day_ts, "dd-MMM-yyyy"),
        fmt(at, "dd-MMM-yyyy H:mm:ss"),
        F.concat(fmt(east, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")),
        F.concat(fmt(west, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".75-08:00")),
        F.concat(fmt(day_ts, "yyyy-MM"), F.lit("-32")),
        F.lit(""),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", seconds_of(F.col("o_orderdate")).alias("day")
    )
    typed = orders.select("o_orderkey", cell.alias("cell")).select(
        "o_orderkey", C.parse_timestamp(C.trim_cell(F.col("cell"))).alias("value")
    )
    return typed


def _list_cell():
    a, b, c = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return _pick(
        a,
        text_of("[", a, ", ", b, ",", c, "]"), text_of(a, ",", b, ", ,", c, ","), text_of(a, " ", b, "  ", c),
        text_of(b), F.lit(""), text_of("[", a, ",", b), text_of(a, ",x,", b), text_of("[", a, ".5]"),
        text_of("[null,", b, "]"), text_of("-", b, ",", c), text_of("[-", b, "]"),
    )


def convert_multi(spark, sf_dir):
    cells = _lineitem(spark, sf_dir).select("l_orderkey", _list_cell().alias("cell"))
    return cells.select(
        "l_orderkey", "cell", C.int_list_text(C.parse_int_list(F.col("cell"), 32)).alias("value")
    )


def convert_multi_64(spark, sf_dir):
    cells = _lineitem(spark, sf_dir).select("l_orderkey", _list_cell().alias("cell"))
    return cells.select(
        "l_orderkey", "cell", C.int_list_text(C.parse_int_list(F.col("cell"), 64)).alias("value")
    )


def convert_json(spark, sf_dir):
    """Valid props as they are, and eleven ways to break them."""
    p = F.col("props")
    cell = _pick(
        F.col("event_id"),
        p, F.lit(""), F.concat(F.lit(" ["), p, F.lit(",1.5e3,null] ")), F.concat(p, F.lit(" x")),
        F.replace(p, F.lit('"'), F.lit("'")), F.replace(p, F.lit("}"), F.lit(",}")),
        F.replace(p, F.lit(": "), F.lit(": 0")), F.replace(p, F.lit('"'), F.lit("")),
        F.replace(p, F.lit("k"), F.lit("\t")), F.concat(p, F.lit(","), p), F.lit("NaN"),
        F.replace(p, F.lit("k"), F.lit("it's \\u00e9")),
    )
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return _parsed(events, cell, C.parse_json, "event_id")


def trim_cells(spark, sf_dir):
    cell = text_of("　\t", F.col("role"), " \xa0", F.col("conv_id"), " \n")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", C.trim_cell(cell).alias("value")
    )


def quote_text(spark, sf_dir):
    """Whole documents as SQL literals."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(C.quote_string(F.col("text"))).alias("literal_md5"),
        F.md5(C.quote_string(F.col("text"), escape_backslash=False)).alias("plain_md5"),
    )


def float_text(spark, sf_dir):
    return _lineitem(spark, sf_dir).select(
        "l_orderkey",
        C.plain_decimal(F.col("l_extendedprice")).alias("price"),
        C.plain_decimal(F.col("l_quantity") * 100000000.0).alias("large"),
        C.plain_decimal(F.col("l_quantity") / 4096 / 1024).alias("small"),
    )


MIXED = columns_of(
    ("word", "field"), ("title", "field_string"), ("u", "attr_uint"), ("b", "attr_bigint"),
    ("f", "attr_float"), ("flag", "attr_bool"), ("at", "attr_timestamp"), ("s", "attr_string"),
    ("m", "attr_multi"), ("m64", "attr_multi_64"), ("j", "attr_json"),
)


def _mixed_cells(spark, sf_dir):
    """All eleven types in one row, from orders."""
    k = F.col("o_orderkey")
    line = F.concat(
        text_of(k, ",", F.col("o_orderstatus"), ",", F.col("o_orderpriority"), ","),
        text_of(F.col("o_custkey"), ",-", F.col("o_custkey"), ",", F.col("o_totalprice"), ","),
        F.when(k % 2 == 0, "yes").otherwise("off"),
        F.date_format("o_orderdate", "',\"'yyyy-MM-dd HH:mm:ss'\",'"),
        text_of("it's ", k, ',"', k, ",", F.col("o_custkey"), '","[', k, ',-1]","{""k"": ', k, '}"'),
    )
    orders = table(spark, sf_dir, "orders").select(k.alias("line_no"), line.alias("line"))
    return orders.select("line_no", REC.split_record(F.col("line"), ",").alias("cells"))


def all_types_typed(spark, sf_dir):
    good = R.good_rows(R.convert_rows(_mixed_cells(spark, sf_dir), MIXED)).drop("line_no")
    lists = {n: F.array_join(F.col(n).cast("array<string>"), "|") for n in ("m", "m64")}
    return good.withColumns(lists)


def all_types_sql(spark, sf_dir):
    good = R.good_rows(R.convert_rows(_mixed_cells(spark, sf_dir), MIXED))
    return R.sql_rows(good, MIXED).drop("line_no")


_LI = "l_orderkey"


def _case(key, *choices):
    n = len(choices)
    arms = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE {key} % {n} {arms} END"


_UINT = _case(
    _LI, "'  ' || l_partkey || chr(9)", "'-' || l_partkey", "l_partkey || '.5'", "''",
    "CAST(l_partkey + 4294966000 AS VARCHAR)", "'00' || l_partkey", "CAST(l_partkey AS VARCHAR)",
)
_UINT_V = _case(
    _LI, "l_partkey", "NULL", "NULL", "0",
    "CASE WHEN l_partkey + 4294966000 <= 4294967295 THEN l_partkey + 4294966000 END",
    "l_partkey", "l_partkey",
)
_BIG = _case(
    _LI, "'-' || l_partkey", "'+' || l_partkey", "l_partkey || 'e1'", "' '",
    "'99999999999999' || l_partkey || '99999'", "l_partkey || '-'", "' ' || l_partkey || ' '",
)
_BIG_V = _case(
    _LI, "-l_partkey", "l_partkey", "NULL", "0",
    "TRY_CAST('99999999999999' || l_partkey || '99999' AS BIGINT)", "NULL", "l_partkey",
)
_Q = "CAST(l_quantity AS INTEGER)"
_FLOAT = _case(
    _LI, "CAST(l_extendedprice AS VARCHAR)", f"{_Q} || 'e3'", f"'-' || {_Q} || '.'", "''",
    f"{_Q} || 'e400'", "'NaN'", f"{_Q} || 'd'", f"'.' || {_Q}", f"{_Q} || '_000.25'",
    f"'0x' || ({_Q} + 100) || 'p-2'",
)
_FLOAT_V = _case(
    _LI, "l_extendedprice", "l_quantity * 1000", "-l_quantity", "0", "NULL", "NULL", "NULL",
    f"CAST('0.' || {_Q} AS DOUBLE)", "l_quantity * 1000 + 0.25",
    # the three decimal digits read as hexadecimal digits, over four
    f"(({_Q} + 100) // 100 * 256 + ({_Q} + 100) % 100 // 10 * 16 + ({_Q} + 100) % 10) / 4.0",
)
_WORD = _case(_LI, *[f"'{w}'" for w in WORDS])
_STRICT = _case(_LI, *["true"] * 6, *["false"] * 7, "NULL", "NULL", "NULL")
_LENIENT = _case(
    _LI, "true", "true", "true", "false", "true", *["false"] * 11
)
_DAY = "CAST(epoch(o_orderdate) AS BIGINT)"
_AT = f"{_DAY} + o_orderkey % 86400"
_TS_V = _case(
    "o_orderkey", _DAY, _AT, _AT, _AT, _DAY, _DAY, _AT, _DAY, _AT, _AT, _AT, "NULL", "0"
)
_A, _B, _C = "l_orderkey", "l_partkey", "l_suppkey"
_LIST = _case(
    _LI, f"'[' || {_A} || ', ' || {_B} || ',' || {_C} || ']'", f"{_A} || ',' || {_B} || ', ,' || {_C} || ','",
    f"{_A} || ' ' || {_B} || '  ' || {_C}", f"CAST({_B} AS VARCHAR)", "''", f"'[' || {_A} || ',' || {_B}",
    f"{_A} || ',x,' || {_B}", f"'[' || {_A} || '.5]'", f"'[null,' || {_B} || ']'",
    f"'-' || {_B} || ',' || {_C}", f"'[-' || {_B} || ']'",
)
_THREE = f"'(' || {_A} || ',' || {_B} || ',' || {_C} || ')'"
_NEG = f"'(' || -{_B} || ')'"
_LIST_V = _case(
    _LI, _THREE, _THREE, _THREE, f"'(' || {_B} || ')'", "'()'", "NULL", "NULL", "NULL",
    f"'(0,' || {_B} || ')'", "{minus}", _NEG,
)
_LIST_32 = _LIST_V.replace("{minus}", f"CASE WHEN {_B} < 0 THEN '' END")
_LIST_64 = _LIST_V.replace("{minus}", f"'(' || -{_B} || ',' || {_C} || ')'")
_JSON = _case(
    "event_id", "props", "''", "' [' || props || ',1.5e3,null] '", "props || ' x'",
    "replace(props, '\"', '''')", "replace(props, '}', ',}')", "replace(props, ': ', ': 0')",
    "replace(props, '\"', '')", "replace(props, 'k', chr(9))", "props || ',' || props", "'NaN'",
    "replace(props, 'k', 'it''s \\u00e9')",
)
_JSON_V = _case(
    "event_id", "props", "'{}'", "'[' || props || ',1.5e3,null]'", "NULL", "NULL", "NULL",
    "CASE WHEN props = '{\"k\": }' THEN props END", "NULL", "NULL", "NULL", "NULL",
    "replace(props, 'k', 'it''s \\u00e9')",
)

QUERIES = {
    "convert_uint": (convert_uint, f"SELECT l_orderkey, {_UINT} AS cell, {_UINT_V} AS value FROM lineitem"),
    "convert_bigint": (convert_bigint, f"SELECT l_orderkey, {_BIG} AS cell, {_BIG_V} AS value FROM lineitem"),
    "convert_float": (
        convert_float,
        f"SELECT l_orderkey, {_FLOAT} AS cell, CAST({_FLOAT_V} AS DOUBLE) AS value FROM lineitem",
    ),
    "convert_bool_strict": (
        convert_bool_strict, f"SELECT l_orderkey, l_partkey, {_WORD} AS cell, {_STRICT} AS value FROM lineitem",
    ),
    "convert_bool_lenient": (
        convert_bool_lenient, f"SELECT l_orderkey, l_partkey, {_WORD} AS cell, {_LENIENT} AS value FROM lineitem",
    ),
    "convert_timestamp": (convert_timestamp, f"SELECT o_orderkey, {_TS_V} AS value FROM orders"),
    "convert_multi": (convert_multi, f"SELECT l_orderkey, {_LIST} AS cell, {_LIST_32} AS value FROM lineitem"),
    "convert_multi_64": (convert_multi_64, f"SELECT l_orderkey, {_LIST} AS cell, {_LIST_64} AS value FROM lineitem"),
    "convert_json": (convert_json, f"SELECT event_id, {_JSON} AS cell, {_JSON_V} AS value FROM events"),
    "trim_cells": (
        trim_cells, "SELECT conv_id, turn, role || ' ' || chr(160) || conv_id AS value FROM conversations",
    ),
    "quote_text": (
        quote_text,
        r"""SELECT doc_id, md5('''' || replace(replace(text, '\', '\\'), '''', '\''') || '''') AS literal_md5,
          md5('''' || replace(text, '''', '\''') || '''') AS plain_md5 FROM documents""",
    ),
    "float_text": (
        float_text,
        """WITH t AS (SELECT *, string_split(CAST(l_quantity / 4096 / 1024 AS VARCHAR), 'e-') AS s FROM lineitem)
        SELECT l_orderkey, regexp_replace(CAST(l_extendedprice AS VARCHAR), '\\.0$', '') AS price,
          CAST(CAST(l_quantity * 100000000 AS BIGINT) AS VARCHAR) AS large,
          '0.' || repeat('0', CAST(s[2] AS INTEGER) - 1) || replace(regexp_replace(s[1], '\\.0$', ''), '.', '') AS small FROM t""",
    ),
    "all_types_typed": (
        all_types_typed,
        """SELECT o_orderkey AS id, o_orderstatus AS word, o_orderpriority AS title, o_custkey AS u,
          -o_custkey AS b, o_totalprice AS f, o_orderkey % 2 = 0 AS flag,
          CAST(epoch(o_orderdate) AS BIGINT) AS at, 'it''s ' || o_orderkey AS s,
          o_orderkey || '|' || o_custkey AS m, o_orderkey || '|-1' AS m64,
          '{"k": ' || o_orderkey || '}' AS j FROM orders""",
    ),
    "all_types_sql": (
        all_types_sql,
        r"""SELECT CAST(o_orderkey AS VARCHAR) AS id, '''' || o_orderstatus || '''' AS word,
          '''' || o_orderpriority || '''' AS title, CAST(o_custkey AS VARCHAR) AS u,
          CAST(-o_custkey AS VARCHAR) AS b, regexp_replace(CAST(o_totalprice AS VARCHAR), '\.0$', '') AS f,
          CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS flag,
          CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS at, '''it\''s ' || o_orderkey || '''' AS s,
          '(' || o_orderkey || ',' || o_custkey || ')' AS m, '(' || o_orderkey || ',-1)' AS m64,
          '''{"k": ' || o_orderkey || '}''' AS j FROM orders""",
    ),
}
