"""Schemas, sinks, grid, ad-hoc SQL, streaming."""

import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from slotlake import schema as SC
from slotlake.functions import rows as R
from slotlake.operators import grid as G
from slotlake.operators import numbering as N
from slotlake.plans import query as Q
from slotlake.plans.lake import Lake
from slotlake.sinks import files as K
from slotlake.sources import datasets as DS
from slotlake.sources import delimited as D
from slotlake.streaming import imports as ST


# --- schema ------------------------------------------------------------------

@pytest.mark.parametrize(
    "text, message",
    [
        ('{"columns":[]}', "there is no column"), ("{}", "there is no column"),
        ('{"columns":[{"name":"","type":"field"}]}', "empty name"),
        ('{"columns":[{"name":"id","type":"invalid_type"}]}', "unknown type"),
        ('{"columns":[}', "parsing config JSON"),
    ],
)
def test_bad_columns(text, message):
    with pytest.raises(SC.SchemaError, match=message):
        SC.parse_columns(text)


def test_registry(spark, tmp_path):
    path = tmp_path / "schemas.yaml"
    path.write_text(
        "b:\n  schema:\n    columns:\n      - {name: x, type: attr_uint}\n"
        "  config: {importMethod: indexer, clusterMain: false, hasHeader: true}\n"
        "a:\n  schema:\n    columns:\n      - {name: t, type: field}\n"
    )
    reg = SC.load_registry(str(path))
    assert reg.names() == ["a", "b"]
    a, b = reg.get("a"), reg.for_derived("b_main_a")
    assert (a.import_method, a.cluster_main, a.ha_strategy, a.agent_retry_count, a.mem_limit, a.has_header) == (
        "bulk", True, "nodeads", 0, "2G", None
    )
    assert (b.import_method, b.cluster_main, b.has_header) == ("indexer", False, True)
    with pytest.raises(KeyError, match="its base zzz"):
        reg.for_derived("zzz_delta")
    assert [r.name for r in reg.to_df(spark).collect()] == ["a", "b"]
    cols = SC.columns_of(*[(f"c{i}", t) for i, t in enumerate(SC.DDL_TYPES)])
    assert SC.create_table_text("t", cols[:3]) == (
        "CREATE TABLE IF NOT EXISTS t (id bigint, c0 text, c1 text, c2 uint)"
    )
    assert [c.name for c in cols if c.is_numeric] == ["c2", "c3", "c4", "c6"]
    assert SC.struct_type(cols)["c10"].metadata == {"logical_type": "attr_json"}
    assert SC.parse_datasets('{"b":"2.csv","a":"1.csv"}') == [("a", "1.csv"), ("b", "2.csv")]


# --- sinks -------------------------------------------------------------------

ALL = SC.columns_of(
    ("title", "field"), ("body", "field_string"), ("stock", "attr_uint"), ("seller", "attr_bigint"),
    ("weight", "attr_float"), ("listed", "attr_bool"), ("added", "attr_timestamp"),
    ("shelf", "attr_string"), ("tags", "attr_multi"), ("parts", "attr_multi_64"), ("extra", "attr_json"),
)
LINE = (
    '310,oak table,seats six,17,-9223372036854775808,0.625,on,86400,'
    'row 9,"4,5","60,70,80","{""maker"":""joe\'s""}"\n'
    "311,,,,,,,,,,,\n312,,,,,,,,,,,null\n"
)


def typed(spark, tmp_path):
    (tmp_path / "all.csv").write_text(LINE)
    raw = D.read_delimited(spark, str(tmp_path / "all.csv"), len(ALL))
    return R.good_rows(R.convert_rows(raw, ALL))


def test_all_types_as_sql(spark, tmp_path):
    df = typed(spark, tmp_path).withColumn("row_no", F.col("line_no"))
    rows = K.insert_statements(df, ALL, "items", batch=2).orderBy("batch_no").collect()
    names = "id, " + ", ".join(c.name for c in ALL)
    assert rows[0].statement == (
        f"INSERT INTO items ({names}) VALUES (310, 'oak table', 'seats six', 17, "
        "-9223372036854775808, 0.625, 1, 86400, 'row 9', (4,5), "
        "(60,70,80), '{\"maker\":\"joe\\'s\"}'), (311, '', '', 0, 0, 0, 0, 0, '', (), (), '{}');"
    )
    assert (rows[0].rows, rows[1].rows) == (2, 1)
    K.write_insert_sql(df, str(tmp_path / "sql"), ALL, "items", batch=1)
    assert spark.read.text(str(tmp_path / "sql")).count() == 3


def test_bulk_documents(spark, tmp_path):
    df = typed(spark, tmp_path)
    docs = [json.loads(r.value) for r in K.bulk_documents(df, ALL, "items").orderBy("line_no").collect()]
    first = docs[0]["insert"]
    assert first["index"] == "items" and first["id"] == 310
    assert first["doc"]["extra"] == {"maker": "joe's"} and first["doc"]["tags"] == [4, 5]
    assert first["doc"]["listed"] is True and first["doc"]["seller"] == -9223372036854775808
    assert docs[1]["insert"]["doc"]["extra"] == {} and "extra" not in docs[2]["insert"]["doc"]
    K.write_bulk_ndjson(df, str(tmp_path / "nd"), ALL, "items", cluster="main", batch=2)
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "nd")).collect()]
    assert len(lines) == 3 and all(x["insert"]["cluster"] == "main" for x in lines)
    assert len(list((tmp_path / "nd").glob("part-*.txt"))) == 2


def test_tsv_rewrite(spark, tmp_path):
    cols = SC.columns_of(("name", "field"), ("active", "attr_bool"), ("score", "attr_float"))
    (tmp_path / "p.csv").write_text("name,active,score\nann,TRUE,1.5\nbob,no,\nzed,on\n")
    raw = D.read_lines_split(spark, str(tmp_path / "p.csv"))
    got = [r.value for r in K.tsv_lines(raw, cols).orderBy("line_no").collect()]
    assert got == ["0\tann\t1\t1.5", "1\tbob\t0\t", "2\tzed\t0"]


def test_rejects_replace_own_job(spark, tmp_path):
    path = str(tmp_path / "rej")
    one = spark.createDataFrame([(1, "c", "v", "r")], R.REJECT_DDL)
    for job in ("j1", "j2", "j1"):
        K.write_rejects(one, path, job)
    assert spark.read.parquet(path).count() == 2


# --- numbering ---------------------------------------------------------------

def test_numbers_of_a_parquet_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 5000, 1, 3).write.parquet(path)
    df = N.dense_numbers(N.with_positions(spark.read.parquet(path)), start=0)
    assert df.where("id <> record_no").count() == 0
    chunks = N.chunk_checkpoints(
        df.withColumn("n", F.col("record_no") + 1), "n", "id", batch_size=100, workers=2
    ).orderBy("chunk_no").collect()
    assert [(c.records, c.last_line) for c in chunks[:2]] == [(400, 399), (400, 799)]
    assert sum(c.records for c in chunks) == 5000


# --- grid and SQL ------------------------------------------------------------

@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_pages_by_rank_equal_pages_by_offset(spark, direction):
    rows = [(k, None if k % 7 == 0 else ["b", "a", "c'", ""][k % 4]) for k in range(203)]
    df = spark.createDataFrame(rows, "id long, v string").repartition(5)
    pages = G.Pages(df, "v", direction, "id", range_rows=20)
    assert pages.index.count() > 5
    for k in (0, 1, 7, 19, 20, 21):
        assert pages.page(k).collect() == G.page(df, k, 10, "v", direction).collect()
    own = G.Pages(df, "id", direction, "id", range_rows=50)
    assert own.page(3, 7).collect() == G.page(df, 3, 7, "id", direction).collect()
    assert G.Pages(df.limit(0), "v").page(0).collect() == []


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_ranges_of_a_few_rows_take_no_more_tasks(spark, direction):
    """One task cuts many ranges; also where keys come many times."""
    rows = [(k // 3, None if k % 11 == 0 else "ab"[k % 2]) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, v string").repartition(3)
    spark.sparkContext.setJobGroup("few-rows-" + direction, "")
    try:
        pages = G.Pages(df, "v", direction, "id", range_rows=5)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("few-rows-" + direction) for s in tracker.getJobInfo(j).stageIds]
    assert max(info.numTasks for info in map(tracker.getStageInfo, stages) if info) <= 8
    assert pages.index.count() > 200
    for k in (0, 3, 27, 28, 150, 299, 300):
        assert pages.page(k).collect() == G.page(df, k, 10, "v", direction).collect()


def test_a_ranked_page_filters_the_scan(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id % 100 AS v").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    page = G.Pages(df, "id", "asc", "id", range_rows=500).page(400)
    assert [r.id for r in page.collect()] == list(range(4000, 4010))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan


def test_grid(spark):
    df = spark.createDataFrame(
        [(i, f"Name {i % 4}", i % 3 == 0 or None) for i in range(25)], "id long, n string, f boolean"
    )
    assert G.search(df, "NAME 3").count() == 6
    assert G.search(df, "null").count() == 16 and G.search(df, "").count() == 25
    assert [r.id for r in G.sort(df, "id", "desc").limit(2).collect()] == [24, 23]
    pages = [[r.id for r in G.page(df, i, 10, "n").collect()] for i in range(3)]
    assert sorted(sum(pages, [])) == list(range(25)) and len(pages[2]) == 5
    last = G.page(df, 0, 10, "n").collect()[-1]
    assert [r.id for r in G.page_after(df, last.n, last.id, 10, "n").collect()] == pages[1]
    down = [r.id for r in G.page(df, 0, 7, "n", "desc").collect()]
    nxt = G.page_after(df, "Name 3", 23, 10, "n", "desc").collect()
    assert down[6] == nxt[0].id
    assert tuple(G.page_count(df).head()) == (25, 3)
    blob = spark.createDataFrame([(bytearray(b"ab"), [1])], "b binary, a array<int>")
    assert tuple(G.display(blob).head()) == ("ab", "[1]")


def test_query_copies(spark):
    names = ["q" + uuid.uuid4().hex[:8] for _ in range(3)]
    for i, n in enumerate(names):
        spark.sql(f"CREATE DATABASE {n}")
        if i != 1:
            spark.sql(f"CREATE VIEW {n}.t AS SELECT id, id * {i + 1} AS v FROM range(5)")
    sql = "SELECT sum(v) AS s FROM t"
    with pytest.raises(Q.QueryError):
        Q.query(spark, "  ")
    with pytest.raises(Q.QueryError, match="no copy 3 among 3"):
        Q.query_target(spark, sql, names, 3)
    one = Q.query_target(spark, sql, names, 2).count()
    assert one.columns == [{"name": "s", "type": "bigint"}] and one.row_count == 1
    assert one.page(5) == [{"s": 30}]
    assert Q.query_any(spark, sql, [names[1], names[2]]).source_index == 1
    out = Q.query_all(spark, sql, names)
    assert out.status == "partial" and out.results[1].status == "error"
    assert {(r.source_index, r.s) for r in out.df.collect()} == {(0, 10), (2, 30)}
    assert Q.query_all(spark, sql, [names[0], names[2]]).status == "ok"
    assert Q.query_all(spark, sql, [names[1]]).status == "error"
    # a copy that fails only as it runs, and a result whose names repeat
    spark.sql(f"CREATE VIEW {names[1]}.t AS SELECT id, CAST(concat('x', id) AS INT) AS v FROM range(5)")
    assert Q.query_any(spark, sql, [names[1], names[2]]).source_index == 1
    out = Q.query_all(spark, "SELECT id, id FROM t WHERE v >= 0", names)
    assert out.status == "partial" and [r.row_count for r in out.results] == [5, None, 5]
    assert out.results[0].df.columns == ["id", "id"]
    assert spark.catalog.currentDatabase() == "default"


# --- streaming ---------------------------------------------------------------

COLS = SC.columns_of(("name", "attr_string"), ("n", "attr_uint"))


def run(spark, src, tmp_path, **kw):
    q = ST.stream_import(
        spark, str(src), COLS, str(tmp_path / "out"), str(tmp_path / "cp"), **kw
    )
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_resumes_and_numbers_on(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.csv").write_text("a,1\nb,2\n")
    (src / "2.csv").write_text('"c,\nc",3\nd,x\n')
    os.utime(src / "1.csv", (1_700_000_000, 1_700_000_000))
    run(spark, src, tmp_path, auto_id=True, max_files_per_batch=1)
    (src / "3.csv").write_text("e,5\n")
    run(spark, src, tmp_path, auto_id=True, max_files_per_batch=1)
    out = str(tmp_path / "out")
    got = sorted((r.id, r["name"], r.n) for r in ST.delta_rows(spark, out, COLS).collect())
    assert got == [(1, "a", 1), (2, "b", 2), (3, "c,\nc", 3), (5, "e", 5)]
    rej = ST.delta_rejects(spark, out, COLS).collect()
    assert [(r.line, r.column, r.value) for r in rej] == [(4, "n", "x")]
    prog = ST.progress(spark, out).orderBy("batch_id").collect()
    assert [(p.processed, p.failed, p.last_line) for p in prog] == [(2, 0, 2), (1, 1, 4), (1, 0, 5)]


def test_replayed_batch_leaves_no_duplicates(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.csv").write_text("1,a,1\n2,b,2\n")
    out = str(tmp_path / "out")
    lines = spark.read.option("lineSep", "\n").text(str(src)).select(
        "value", F.col("_metadata.file_path").alias(N.FILE),
        F.col("_metadata.file_block_start").alias(N.BLOCK),
    )
    for _ in range(2):
        ST._write_batch(lines, 0, ST.Feed(COLS, out))
    assert ST.delta_rows(spark, out, COLS).count() == 2
    assert ST.progress(spark, out).head().records == 2


def test_stream_into_delta_is_replay_safe(spark, tmp_path):
    reg = SC.Registry().add(SC.TableSchema("t", COLS))
    lake = Lake(spark, str(tmp_path / "lake"), reg, "s" + uuid.uuid4().hex[:8])
    lake.ensure_tables()
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.csv").write_text("1,a,1\n2,b,x\n")
    for i in range(2):  # a lost checkpoint replays the batch under the same id
        q = ST.stream_into_delta(
            lake, "t", str(src), str(tmp_path / "out"), str(tmp_path / f"cp{i}")
        )
        q.awaitTermination(120)
        assert q.exception() is None
    assert [(r.id, r["name"], r.n) for r in lake.table("t").collect()] == [(1, "a", 1)]
    assert [(r.line, r.column, r.job_id) for r in lake.rejects().collect()] == [
        (2, "n", "t-stream-0")
    ]


def test_progress_listener(spark, tmp_path):
    seen = []
    listener = ST.progress_listener(lambda name, batch, rows: seen.append((batch, rows)))
    spark.streams.addListener(listener)
    try:
        src = tmp_path / "src"
        src.mkdir()
        (src / "1.csv").write_text("1,a,1\n2,b,2\n")
        run(spark, src, tmp_path)
        for _ in range(100):
            if seen:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert seen and seen[0][0] == 0


def test_prebuilt_marker(spark, tmp_path):
    with pytest.raises(DS.MissingDatasetError):
        DS.load_prebuilt(spark, str(tmp_path))
