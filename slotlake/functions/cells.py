"""Cell parsers: text column in, typed column out, NULL where the text is invalid.

Every parser takes a cell that was already trimmed (see `trim_cell`); the empty
cell becomes the type's default, so NULL always means "reject". All of them are
plain column expressions that stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

# Unicode White_Space, the characters cut from both ends of a cell.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Accepted spellings of booleans (compared in lower case).
TRUE_WORDS = ("1", "true", "yes", "on", "t", "y")
FALSE_WORDS = ("0", "false", "no", "off", "f", "n", "")
LENIENT_TRUE_WORDS = ("t", "true", "1", "yes")

UINT32_MAX = 4294967295

# Number grammars. Digits may be grouped by single underscores in floats.
UINT_RE = r"^[0-9]+\z"
INT_RE = r"^[+-]?[0-9]+\z"
_D = r"[0-9]+(?:_[0-9]+)*+"
_H = r"[0-9A-Fa-f]+(?:_[0-9A-Fa-f]+)*+"
FLOAT_RE = (
    rf"^[+-]?(?:(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:[eE][+-]?{_D})?"
    rf"|0[xX]_?(?:{_H}(?:\.(?:{_H})?)?|\.{_H})[pP][+-]?{_D})\z"
)

# The accepted date layouts, one pattern per family. A fraction of a
# second may follow the seconds; the hour may have one digit.
_CLOCK = r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?"
_ZONE = r"[+-](?:[01][0-9]|2[0-4]):(?:[0-5][0-9]|60)"
ISO_RE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    rf"(?: {_CLOCK}|T{_CLOCK}(?:Z|{_ZONE})?)?\z"
)
US_RE = rf"^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}(?: {_CLOCK})?\z"
NAMED_RE = rf"^[0-9]{{2}}-[A-Za-z]{{3}}-[0-9]{{4}}(?: {_CLOCK})?\z"
ZONE_RE = rf"T.*{_ZONE}\z"
DATE_RE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# JSON tokens. Possessive loops keep the matcher iterative on long texts.
_JSON_ESCAPE = r'\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})'
JSON_STRING_RE = rf'"[^"\\\x00-\x1f]*+(?:{_JSON_ESCAPE}[^"\\\x00-\x1f]*+)*+"'
JSON_SKELETON_RE = (
    r'^(?:[ \t\r\n\[\]{},:]|""|(?:true|false|null|'
    r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9A-Za-z.+-]))*+\z"
)
# Texts with none of these characters cannot hold what Spark's JSON reader lets pass.
JSON_LENIENT_RE = r"['\x00-\x1f]"
JSON_INT_RE = r"^(?:-?(?:0|[1-9][0-9]*)|null)\z"
_JSON_INT = "-?(?:0|[1-9][0-9]{0,17})"
PLAIN_JSON_LIST_RE = rf"^\[{_JSON_INT}(?:,{_JSON_INT})*+\]\z"
JSON_SPACE = " \t\r\n"


# White space that a plain trim, which cuts spaces only, would leave.
ODD_SPACE_RE = r"[\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def trim_cell(c: SparkColumn, odd: SparkColumn | None = None) -> SparkColumn:
    """Cut white space at both ends. `odd` may say that a row holds none but spaces;
    the plain trim is many times cheaper than the search in a character set."""
    full = F.trim(c, F.lit(WHITE_SPACE))
    return full if odd is None else F.when(odd, full).otherwise(F.trim(c))


def parse_text(c: SparkColumn) -> SparkColumn:
    return c


def parse_uint(c: SparkColumn) -> SparkColumn:
    n = F.when(c.rlike(UINT_RE), c.try_cast("bigint"))
    return F.when(c == "", F.lit(0).cast("bigint")).when(n <= UINT32_MAX, n)


def parse_bigint(c: SparkColumn) -> SparkColumn:
    return F.when(c == "", F.lit(0).cast("bigint")).when(
        c.rlike(INT_RE), c.try_cast("bigint")
    )


def parse_float(c: SparkColumn) -> SparkColumn:
    """Finite doubles only: `inf`, `nan` and overflow are rejected."""
    v = F.replace(c, F.lit("_"), F.lit("")).try_cast("double")
    finite = F.when(F.abs(v) < float("inf"), v)
    return F.when(c == "", F.lit(0.0)).when(c.rlike(FLOAT_RE), finite)


def parse_bool(c: SparkColumn) -> SparkColumn:
    # Lower case as written is the common case; lower() is costly.
    result = F.when(c.isin(*TRUE_WORDS), F.lit(True)).when(c.isin(*FALSE_WORDS), F.lit(False))
    word = F.lower(c)
    return result.when(word.isin(*TRUE_WORDS), F.lit(True)).when(
        word.isin(*FALSE_WORDS), F.lit(False)
    )


def parse_bool_lenient(c: SparkColumn) -> SparkColumn:
    """Anything that is not a true word is false; never rejects."""
    return F.coalesce(F.lower(c).isin(*LENIENT_TRUE_WORDS), F.lit(False))


def _seconds(date: SparkColumn, rest: SparkColumn) -> SparkColumn:
    """Unix seconds of a `y-m-d` text and whatever clock text `rest` begins with,
    both taken as UTC; NULL for a day or clock that does not exist."""
    clock = F.regexp_extract(rest, r"^.([0-9:]+)", 1)
    clock = F.when(clock == "", F.lit("00:00:00")).otherwise(clock)
    stamp = F.concat(date, F.lit(" "), clock, F.lit("Z"))
    return stamp.try_cast("timestamp").cast("bigint")


def parse_timestamp(c: SparkColumn) -> SparkColumn:
    """Unix seconds from integer text or one of eight date layouts (UTC unless the
    text carries a zone)."""
    rest = c.substr(F.lit(11), F.length(c))
    zone = F.right(c, F.lit(6))
    zone_seconds = (
        zone.substr(2, 2).try_cast("bigint") * 3600
        + zone.substr(5, 2).try_cast("bigint") * 60
    )
    iso = _seconds(c.substr(1, 10), rest) + F.when(
        ~c.rlike(ZONE_RE), F.lit(0)
    ).otherwise(F.when(zone.startswith("-"), zone_seconds).otherwise(-zone_seconds))
    us = _seconds(
        F.concat_ws("-", c.substr(7, 4), c.substr(1, 2), c.substr(4, 2)), rest
    )
    month = (F.instr(F.lit(MONTHS), F.lower(c.substr(4, 3))) + 2) / 3
    named = F.when(
        month == F.floor(month),
        _seconds(
            F.concat_ws(
                "-",
                c.substr(8, 4),
                F.lpad(month.cast("int").cast("string"), 2, "0"),
                c.substr(1, 2),
            ),
            c.substr(F.lit(12), F.length(c)),
        ),
    )
    day = F.unix_date(c.try_cast("date")).cast("bigint") * 86400
    return (
        F.when(c == "", F.lit(0).cast("bigint"))
        .when(c.rlike(DATE_RE), day)
        .when(c.rlike(INT_RE), c.try_cast("bigint"))
        .when(c.rlike(ISO_RE), iso)
        .when(c.rlike(US_RE), us)
        .when(c.rlike(NAMED_RE), named)
    )


def parse_int_list(c: SparkColumn, bits: int = 64) -> SparkColumn:
    """Integers from a JSON array, else comma separated, else space separated.

    The unsigned 32-bit check applies to the separated forms only.
    """

    def ints(parts: SparkColumn, valid: Callable) -> SparkColumn:
        numbers = F.transform(parts, lambda p: F.when(valid(p), p.try_cast("bigint")))
        return F.when(~F.exists(numbers, lambda n: n.isNull()), numbers)

    inner = F.trim(c.substr(F.lit(2), F.length(c) - 2), F.lit(JSON_SPACE))
    elements = F.transform(
        F.split(inner, ","),
        lambda p: F.trim(p, F.lit(JSON_SPACE)),
    )
    json_numbers = ints(
        F.transform(
            elements,
            lambda p: F.when(p.rlike(JSON_INT_RE), F.when(p == "null", F.lit("0")).otherwise(p)),
        ),
        lambda p: p.isNotNull(),
    )
    empty = F.array().cast("array<bigint>")
    from_json_form = F.when(
        c.endswith("]"), F.when(inner == "", empty).otherwise(json_numbers)
    )

    comma = c.contains(",") | ~c.contains(" ")
    pieces = F.when(comma, F.split(c, ",")).otherwise(F.split(c, " "))
    pieces = F.filter(F.transform(pieces, lambda p: trim_cell(p)), lambda p: p != "")
    if bits == 32:
        separated = ints(
            pieces,
            lambda p: p.rlike(UINT_RE) & (p.try_cast("bigint") <= UINT32_MAX),
        )
    else:
        separated = ints(pieces, lambda p: p.rlike(INT_RE))

    # Plain lists, which are most, need no test per element.
    plain_digits, plain_sign = ("9", "") if bits == 32 else ("18", "[+-]?")
    plain = rf"^{plain_sign}[0-9]{{1,{plain_digits}}}(?:,{plain_sign}[0-9]{{1,{plain_digits}}})*+\z"
    return (
        F.when(c == "", empty)
        .when(c.rlike(plain), F.split(c, ",").cast("array<bigint>"))
        .when(c.rlike(PLAIN_JSON_LIST_RE), F.split(inner, ",").cast("array<bigint>"))
        .when(c.startswith("["), from_json_form)
        .otherwise(separated)
    )


def parse_json(c: SparkColumn) -> SparkColumn:
    """The text itself if it is strict JSON; the empty cell is an empty object.

    Nesting and separators are checked by Spark's own JSON functions. They stop at
    the end of the first value and let single quotes and raw control characters
    pass. So the text is wrapped both as an array element and as an object member,
    and where it holds such characters its tokens are checked apart.
    """
    one_element = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    one_member = (
        F.array_join(
            F.json_object_keys(F.concat(F.lit('{"v":'), c, F.lit("}"))), ","
        )
        == "v"
    )
    tokens = ~c.rlike(JSON_LENIENT_RE) | F.regexp_replace(c, JSON_STRING_RE, '""').rlike(
        JSON_SKELETON_RE
    )
    return F.when(c == "", F.lit("{}")).when(tokens & one_element & one_member, c)


PARSERS: dict[str, Callable[[SparkColumn], SparkColumn]] = {
    "field": parse_text,
    "field_string": parse_text,
    "attr_uint": parse_uint,
    "attr_bigint": parse_bigint,
    "attr_float": parse_float,
    "attr_bool": parse_bool,
    "attr_timestamp": parse_timestamp,
    "attr_string": parse_text,
    "attr_multi": lambda c: parse_int_list(c, 32),
    "attr_multi_64": lambda c: parse_int_list(c, 64),
    "attr_json": parse_json,
}


def reject_reason(logical_type: str, cell: SparkColumn) -> SparkColumn:
    """Why a cell of this type was rejected. `cell` is the trimmed text."""
    # These texts are part of the reject table's format.
    quoted = F.concat(F.lit('"'), cell, F.lit('"'))
    if logical_type == "attr_uint":
        return F.lit("invalid unsigned integer")
    if logical_type == "attr_bigint":
        return F.lit("invalid integer")
    if logical_type == "attr_float":
        return F.lit("invalid float")
    if logical_type == "attr_bool":
        return F.concat(F.lit("invalid boolean value: "), quoted)
    if logical_type == "attr_timestamp":
        return F.concat(F.lit("unrecognized timestamp format: "), quoted)
    if logical_type in ("attr_multi", "attr_multi_64"):
        return F.when(cell.startswith("["), F.lit("invalid JSON array")).otherwise(
            F.lit("invalid integer in list")
        )
    return F.lit("invalid JSON")


# --- text forms --------------------------------------------------------------

# Fixed value: the least double with full precision.
SMALLEST_NORMAL = 2.2250738585072014e-308


def quote_string(c: SparkColumn, escape_backslash: bool = True) -> SparkColumn:
    """SQL string literal; `'` becomes `\\'`.

    Backslashes are doubled first, so text that ends in one cannot swallow the
    closing quote; pass False to leave them alone.
    """
    if escape_backslash:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))


def shortest_text(v: SparkColumn) -> SparkColumn:
    """The double's text with the fewest digits; its exponent stands behind an E.

    Up to 15 digits identify a normal double, so a text of that length is the
    shortest. Longer ones of older Java versions may not be: the first of 15 and 16
    digits that reads back is. Subnormal doubles have less precision, so for them
    every number of digits is tried.
    """
    text = v.cast("string")

    def rounded(digits: SparkColumn) -> SparkColumn:
        form = F.concat(F.lit("%."), (digits - 1).cast("string"), F.lit("e"))
        short = F.call_function("format_string", form, v)
        return F.replace(F.replace(short, F.lit("e+"), F.lit("E")), F.lit("e"), F.lit("E"))

    subnormal = (F.abs(v) > 0) & (F.abs(v) < SMALLEST_NORMAL)
    # With a point and a digit on either side, 16 characters hold 15 digits at most.
    digits = F.length(F.regexp_replace(text, r"E.*\z|^-?0\.0*|[-.]|\.0\z", ""))
    long = (F.length(text) > 16) & (digits > 15)
    tried = F.transform(F.sequence(F.when(subnormal, 1).otherwise(15), F.lit(16)), rounded)
    short = F.get(F.filter(tried, lambda s: s.try_cast("double") == v), F.lit(0))
    return F.when(subnormal | long, F.coalesce(short, text)).otherwise(text)


def plain_decimal(v: SparkColumn) -> SparkColumn:
    """Double as plain decimal text: no exponent, no trailing `.0`, and the fewest
    digits that read back as the same double."""
    text = shortest_text(v)
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(text, r"^-?([0-9.]+)", 1)
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"0+\z", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)\z", 1).try_cast("int")
    n = F.length(digits)
    large = F.when(n <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(
        F.concat(
            digits.substr(F.lit(1), power + 1),
            F.lit("."),
            digits.substr(power + 2, n),
        )
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    scientific = F.concat(sign, F.when(power >= 0, large).otherwise(small))
    return F.when(text.contains("E"), scientific).otherwise(
        F.regexp_replace(text, r"\.0\z", "")
    )


def int_list_text(v: SparkColumn) -> SparkColumn:
    return F.concat(F.lit("("), F.array_join(v.cast("array<string>"), ","), F.lit(")"))


def sql_literal(
    logical_type: str, value: SparkColumn, escape_backslash: bool = True
) -> SparkColumn:
    """SQL literal text of an already converted value."""
    if logical_type in ("attr_uint", "attr_bigint", "attr_timestamp"):
        return value.cast("string")
    if logical_type == "attr_float":
        return plain_decimal(value)
    if logical_type == "attr_bool":
        return F.when(value, F.lit("1")).otherwise(F.lit("0"))
    if logical_type in ("attr_multi", "attr_multi_64"):
        return int_list_text(value)
    return quote_string(value, escape_backslash)
