"""Delimited reading: quoting, widths, headers, ids and line numbers."""

import pytest
from pyspark.sql import functions as F

from slotlake.functions import records as R
from slotlake.functions import rows as rows_mod
from slotlake.operators import numbering as N
from slotlake.schema import columns_of
from slotlake.sources import delimited as D


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def read(spark, path, width, **kw):
    rows = D.read_delimited(spark, path, width, **kw).orderBy("line_no").collect()
    return [(r.line_no, list(r.cells)) for r in rows]


SPLITS = [
    ("a,b,c", ["a", "b", "c"]),
    ("", [""]),
    (",", ["", ""]),
    (",a,", ["", "a", ""]),
    ('"a,b",c', ["a,b", "c"]),
    ('"say ""hi""",x', ['say "hi"', "x"]),
    ('1,"{""k"":1}",z', ["1", '{"k":1}', "z"]),
    ('5" pipe,x', ['5" pipe', "x"]),
    ('"a"b",c', ['a"b', "c"]),
    ('"a"b""c",d', ['a"b"c', "d"]),
    ('"",x', ["", "x"]),
    ('x,""', ["x", ""]),
    ('"a"",b",c', ['a",b', "c"]),
    ('a "q",b', ['a "q"', "b"]),
    ('é,"ü,ö"', ["é", "ü,ö"]),
]


def test_split_record(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SPLITS)], "i int, s string")
    got = {r.i: list(r.v) for r in df.select("i", R.split_record(F.col("s"), ",").alias("v")).collect()}
    assert [got[i] for i in range(len(SPLITS))] == [want for _, want in SPLITS]


def test_closed_lines(spark):
    cases = [
        ("a,b", True), ('"a,b",c', True), ('"a', False), ('a"b,"c', False),
        ('5" pipe,x', True), ('"a""', False), ('x,"', False), ('x,""', True),
        ('"a"b', False), ('"a"b"', True), ('a,"b,c""', False),
    ]
    df = spark.createDataFrame(cases, "s string, want boolean")
    for r in df.select("s", "want", R.is_closed(F.col("s"), ",").alias("got")).collect():
        assert r.got == r.want, r.s


def test_tsv_split(spark):
    df = spark.createDataFrame([('a\t"b\tc"\td,e',)], "s string")
    assert list(df.select(R.split_record(F.col("s"), "\t")).head()[0]) == ["a", "b\tc", "d,e"]
    assert R.delimiter_of("/x/A.TSV") == "\t" and R.delimiter_of("a.csv") == ","


def test_ids_and_lines(spark, tmp_path):
    path = put(tmp_path, "p.csv", "1,Kettle,12.75\n2,Ladle,31.5\n")
    assert read(spark, path, 2) == [(1, ["1", "Kettle", "12.75"]), (2, ["2", "Ladle", "31.5"])]


def test_header_and_auto_id(spark, tmp_path):
    path = put(tmp_path, "p.csv", "name,price\r\n\r\nKettle,1\r\nLadle,2\r\n")
    assert read(spark, path, 2) == [(2, ["1", "Kettle", "1"]), (3, ["2", "Ladle", "2"])]
    # Text first and no header: only an explicit flag keeps the first row.
    path = put(tmp_path, "q.csv", "Kettle,1\nLadle,2\n")
    assert read(spark, path, 2, header=False) == [
        (1, ["1", "Kettle", "1"]), (2, ["2", "Ladle", "2"])
    ]
    assert read(spark, path, 2) == [(2, ["1", "Ladle", "2"])]


def test_blank_first_line_is_no_header(spark, tmp_path):
    path = put(tmp_path, "b.csv", "\nx,1\ny,2\n")
    assert not D.has_header(spark, path)
    assert read(spark, path, 2) == [(1, ["1", "x", "1"]), (2, ["2", "y", "2"])]


def test_empty_file(spark, tmp_path):
    path = put(tmp_path, "e.csv", "")
    with pytest.raises(D.EmptyInputError):
        D.read_delimited(spark, path, 2)
    assert D.read_delimited(spark, path, 2, header=False).count() == 0


def test_variable_width_is_kept(spark, tmp_path):
    path = put(tmp_path, "w.csv", "1,a,b\n2,a\n3,a,b,c\n \n4,,\n")
    assert read(spark, path, 2) == [
        (1, ["1", "a", "b"]), (2, ["2", "a"]), (3, ["3", "a", "b", "c"]),
        (4, [" "]), (5, ["4", "", ""]),
    ]


def test_record_over_several_lines(spark, tmp_path):
    path = put(
        tmp_path, "m.csv",
        'id,note\n1,"two\nlines, one ""cell"""\n2,"x"\n3,"a\n\nb",extra\n4,plain\n',
    )
    assert read(spark, path, 1) == [
        (2, ["1", 'two\nlines, one "cell"']), (3, ["2", "x"]),
        (4, ["3", "a\n\nb", "extra"]), (5, ["4", "plain"]),
    ]


def test_mixed_directory(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    put(d, "f1.csv", "h,v\na,1\nb,2\n")
    put(d, "f2.csv", 'h,v\n"c\nc",3\nd,4\n')
    put(d, "f3.csv", "h,v\ne,5\n")
    assert read(spark, str(d), 2) == [
        (2, ["1", "a", "1"]), (3, ["2", "b", "2"]), (5, ["3", "c\nc", "3"]),
        (6, ["4", "d", "4"]), (8, ["5", "e", "5"]),
    ]


def test_numbers_are_dense_over_many_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        path = str(tmp_path / "big")
        spark.range(0, 20000, 1, 7).selectExpr("concat('r', id, ',', id)").write.text(path)
        df = D.read_delimited(spark, path, 2, header=False).select(
            "line_no", F.col("cells")[0].cast("bigint").alias("id"),
            F.col("cells")[2].cast("bigint").alias("v"),
        )
        bad = df.where("line_no <> v + 1 or id <> v + 1").count()
        assert bad == 0 and df.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_running_total(spark):
    df = spark.range(0, 5000).selectExpr("id as k", "id % 7 as n", "1 as one")
    out = N.running_total(df, ["k"], {"n": "before", "one": "ahead"})
    rows = {r.k: (r.before, r.ahead) for r in out.collect()}
    total = 0
    for k in range(5000):
        assert rows[k] == (total, k)
        total += k % 7


def test_lines_split(spark, tmp_path):
    path = put(tmp_path, "l.csv", 'name,active\n"a,t\n\nb,f\n')
    rows = D.read_lines_split(spark, path).orderBy("line_no").collect()
    assert [(r.line_no, list(r.cells)) for r in rows] == [
        (2, ["0", '"a', "t"]), (3, ["1", "b", "f"])
    ]


def test_good_plus_rejects_is_input(spark, tmp_path):
    cols = columns_of(("name", "attr_string"), ("n", "attr_uint"), ("ok", "attr_bool"))
    path = put(
        tmp_path, "r.csv",
        "1,a,5,yes\n2,b,-5,yes\n3,c\nx,d,5,no\n 4,e,5,no\n,f,6,no\n5,g,7,perhaps\n",
    )
    conv = rows_mod.convert_rows(D.read_delimited(spark, path, 3, header=False), cols)
    good = rows_mod.good_rows(conv).orderBy("line_no").collect()
    bad = rows_mod.reject_rows(conv).orderBy("line").collect()
    assert [(r.line_no, r.id, r["name"], r.n, r.ok) for r in good] == [
        (1, 1, "a", 5, True), (6, 0, "f", 6, False)
    ]
    assert [(r.line, r.column, r.value, r.reason) for r in bad] == [
        (2, "n", "-5", "invalid unsigned integer"),
        (3, "", "", "expected 3 data columns (plus ID), got 2 total columns"),
        (4, "id", "x", "invalid ID: invalid integer"),
        (5, "id", " 4", "invalid ID: invalid integer"),
        (7, "ok", "perhaps", 'invalid boolean value: "perhaps"'),
    ]
    texts = [r.message for r in rows_mod.reject_text(rows_mod.reject_rows(conv)).orderBy("line").collect()]
    assert texts[0] == 'line 2: column "n": invalid unsigned integer (value: "-5")'


def test_layout_of_a_large_input_is_broadcast(spark, tmp_path):
    """At a million blocks the scan itself is neither sorted nor shuffled."""
    path = str(tmp_path / "lines")
    spark.range(10).selectExpr("concat('r', id)").write.text(path)
    scan = D.scan_lines(spark, path)
    numbered = N.number_records(scan, N.block_layout(scan), 1_000_000)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r.record_no for r in numbered.collect()) == list(range(1, 11))


def test_numbers_with_many_blocks(spark, tmp_path, monkeypatch):
    """Without a broadcast of the layout the numbers are the same."""
    monkeypatch.setattr("slotlake.session.BROADCAST_LIMIT_BYTES", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        path = str(tmp_path / "many")
        spark.range(0, 3000, 1, 5).selectExpr("concat('r', id, ',', id)").write.option(
            "header", True
        ).csv(path, sep="\x01", quote="\x00")
        rows = D.read_delimited(spark, path, 2).select(
            "line_no", F.col("cells")[0].cast("bigint").alias("id"),
            F.col("cells")[2].cast("bigint").alias("v"),
        )
        assert rows.count() == 3000
        assert rows.where("id <> v + 1 or line_no <> v + 2 + floor(v / 600)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# --- records over lines, in small blocks ------------------------------------------


def brute_records(text):
    """One pass over the lines: a record goes on while a quote is open."""
    import re

    field = r',(?:"[^"]*(?:(?:""|"(?!,|\Z|"))[^"]*)*"(?=,|\Z)|(?!")[^,]*)'
    closed = re.compile(rf"(?:{field})*\Z")
    cut = re.compile(r',("[^"]*(?:(?:""|"(?!,|\Z|"))[^"]*)*"(?=,|\Z)|(?!")[^,]*|"[^,]*)')
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    if lines and lines[-1] == "":
        lines.pop()
    out, held = [], None
    for line in lines:
        if held is None and line == "":
            continue
        held = line if held is None else f"{held}\n{line}"
        if closed.match("," + held):
            out.append(held)
            held = None
    if held is not None:
        out.append(held)
    return [
        [f[1:-1].replace('""', '"') if f.startswith('"') else f for f in cut.findall("," + r)] for r in out
    ]


@pytest.mark.parametrize("seed", range(4))
def test_any_text_gives_the_same_records_in_any_blocks(spark, tmp_path, seed):
    import random

    rng = random.Random(seed)
    path = tmp_path / "r"
    path.mkdir()
    want = []
    for k in range(2):
        pieces = ["a", "b", ",", '"', '""', "\n", "\r\n", '","', '"x', 'y"', " ", "\n\n", ',"q",']
        body = "".join(rng.choice(pieces) for _ in range(400)) + '"\n1,2\n'
        text = f'k{k},"v"\n' + body
        (path / f"f{k}.csv").write_bytes(text.encode())
        want += brute_records(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = D.read_delimited(spark, str(path), 2, header=False, auto_id=False).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.line_no for r in got] == list(range(1, len(want) + 1))
    closed = len(want) - 1  # a record that never ends is cut by its own rules
    assert [list(r.cells) for r in got][:closed] == want[:closed]


def test_cells_do_not_depend_on_other_lines(spark, tmp_path):
    plain = 'id,t\n1," a "\n2,x\r\n'
    path = put(tmp_path, "a.csv", plain + '3,"p\r\nq"\n')
    rows = read(spark, path, 1, header=True)
    assert rows[-1] == (4, ["3", "p\nq"])
    alone = read(spark, put(tmp_path, "b.csv", plain), 1, header=True)
    assert rows[: len(alone)][1:] == alone[1:]


def test_one_stray_quote_leaves_the_file_split(spark, tmp_path):
    path = str(tmp_path / "big")
    line = F.when(F.col("id") == 10_000, F.lit('7,"bad"x,1')).otherwise(F.concat(F.col("id"), F.lit(',"t",1')))
    spark.range(0, 20_000, 1, 1).select(line.alias("value")).write.text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32768")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = D.read_delimited(spark, path, 2, header=False)
        assert df.count() == 19_999
        spread = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(spread) > 3 and max(r["count"] for r in spread) < 15_000


def test_header_of_a_directory_is_that_of_its_first_file(spark, tmp_path):
    (tmp_path / "d[1]").mkdir()
    (tmp_path / "d[1]" / "a.csv").write_text("name,n\n")
    (tmp_path / "d[1]" / "b.csv").write_text("1,2\n" * 1000)
    from slotlake.session import literal_path

    assert D.has_header(spark, literal_path(str(tmp_path / "d[1]")))
