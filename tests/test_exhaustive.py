"""Grammars against brute force: every short text over a small alphabet."""

import itertools
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotlake.functions import cells as C
from slotlake.functions import records as REC
from slotlake.functions import rows as R
from slotlake.schema import columns_of
from slotlake.sources import delimited as D


def texts(alphabet, longest):
    for n in range(longest + 1):
        for t in itertools.product(alphabet, repeat=n):
            yield "".join(t)


def run(spark, alphabet, longest, expr):
    df = spark.createDataFrame([(t,) for t in texts(alphabet, longest)], "c string").repartition(8)
    return {r.c: r.v for r in df.select("c", expr(F.col("c")).alias("v")).collect()}


def lenient_fields(line):
    """(fields, closed) of one line: a quote is only special at the start of a
    field; inside, it ends the field before a comma or the end, and two are one."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i, out = i + 1, ""
            while True:
                if i >= n:
                    return fields + [out], False
                if line[i] != '"':
                    out, i = out + line[i], i + 1
                elif line[i + 1 : i + 2] == '"':
                    out, i = out + '"', i + 2
                elif line[i + 1 : i + 2] in (",", ""):
                    i += 1
                    break
                else:
                    out, i = out + '"', i + 1
        else:
            end = line.find(",", i)
            end = n if end < 0 else end
            out, i = line[i:end], end
        fields.append(out)
        if i >= n:
            return fields, True
        i += 1


def test_every_short_record(spark):
    def expr(c):
        return F.struct(REC.split_record(c, ",").alias("f"), REC.is_closed(c, ",").alias("closed"))

    for line, got in run(spark, 'a," ', 7, expr).items():
        fields, closed = lenient_fields(line)
        assert got.closed == closed, line
        if closed:
            assert list(got.f) == fields, line


def test_every_short_float(spark):
    for text, got in run(spark, "01.e+-_", 5, C.parse_float).items():
        try:
            want = float(text) if text else 0.0
        except ValueError:
            want = None
        if want in (float("inf"), float("-inf")):
            want = None
        assert got == want, text


def test_every_short_integer(spark):
    def both(c):
        return F.struct(C.parse_bigint(c).alias("i"), C.parse_uint(c).alias("u"))

    for text, got in run(spark, "09+-.e", 5, both).items():
        digits = text.lstrip("+-") if text[:1] in "+-" and text[1:2] not in "+-" else text
        want = int(text) if digits.isdigit() else (0 if text == "" else None)
        assert got.i == want, text
        assert got.u == (want if text.isdigit() or text == "" else None), text


def test_every_short_json(spark):
    for text, got in run(spark, "[]{}\",:1'", 5, C.parse_json).items():
        try:
            json.loads(text)
            want = text
        except ValueError:
            want = None if text else "{}"
        assert got == want, text


def test_every_short_json_with_odd_characters(spark):
    for text, got in run(spark, '["\\u0\t\n', 5, C.parse_json).items():
        try:
            json.loads(text)
            want = text
        except ValueError:
            want = None if text else "{}"
        assert got == want, repr(text)


def test_every_short_list(spark):
    def value(text):
        if text == "":
            return []
        if text.startswith("["):
            try:
                items = json.loads(text)
            except ValueError:
                return None
            flat = all(type(x) is int for x in items)
            return items if flat else None
        sep = "," if "," in text or " " not in text else " "
        parts = [p.strip(" ") for p in text.split(sep)]
        parts = [p for p in parts if p]
        try:
            return [int(p) for p in parts]
        except ValueError:
            return None

    for text, got in run(spark, "[], 1-", 6, C.parse_int_list).items():
        if text != text.strip(" "):
            continue  # cells are trimmed before they get here
        assert (None if got is None else list(got)) == value(text), text


COLS = columns_of(("s", "attr_string"), ("n", "attr_uint"))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.text('ab,"\n ', max_size=5), st.sampled_from(["1", "22", "x", "", "-1"]), st.booleans()),
        min_size=1, max_size=12,
    )
)
def test_good_and_rejects_make_up_the_input(spark, tmp_path_factory, rows):
    """Quoted cells with any content, bad numbers and missing cells: nothing is lost,
    ids are dense, and cells come back as they were written."""
    text = ""
    for s, n, short in rows:
        cell = '"' + s.replace('"', '""') + '"'
        text += cell + ("" if short else f",{n}") + "\n"
    path = tmp_path_factory.mktemp("h") / "f.csv"
    path.write_bytes(text.encode())
    raw = D.read_delimited(spark, str(path), 2, header=False, auto_id=True)
    conv = R.convert_rows(raw, COLS)
    good = {r.line_no: r for r in R.good_rows(conv).collect()}
    bad = {r.line for r in R.reject_rows(conv).collect()}
    assert not good.keys() & bad and sorted(good.keys() | bad) == list(range(1, len(rows) + 1))
    for line, (s, n, short) in enumerate(rows, 1):
        assert (line in bad) == (short or n in ("x", "-1"))
        if line in good:
            assert (good[line].id, good[line].s, good[line].n) == (line, s.strip(), int(n or 0))
