"""Blue/green tables, imports, snapshots."""

import os
import uuid
from datetime import datetime, timezone

import pytest

from slotlake.plans import snapshots as S
from slotlake.plans.lake import DuplicateImportError, ImportFailedError, Lake
from slotlake.schema import Registry, TableSchema, columns_of
from slotlake.sources.datasets import MissingDatasetError
from slotlake.sinks.files import publish

COLS = columns_of(("name", "attr_string"), ("price", "attr_float"))


@pytest.fixture
def lake(spark, tmp_path):
    reg = Registry().add(TableSchema("products", COLS)).add(TableSchema("other", COLS))
    return Lake(spark, str(tmp_path / "lake"), reg, "db" + uuid.uuid4().hex[:8])


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(lake, table="products"):
    return sorted((r.id, r["name"], r.price) for r in lake.table(table).collect())


def test_ensure_tables_twice(lake):
    lake.ensure_tables()
    lake.ensure_tables()
    assert lake.active_slot("products") == "a"
    assert rows(lake) == []
    names = {r.name: (r.type, r.slot) for r in lake.tables().collect()}
    assert names["products"] == ("distributed", "a")
    assert names["products_main_a"] == ("rt", "")
    assert "products_main_b" not in names


def test_import_swaps_and_drops(lake, tmp_path):
    first = put(tmp_path, "a.csv", "1,Kettle,12.75\n2,Ladle,bad\n3,Thing,1\n")
    report = lake.import_table("products", first)
    assert (report.slot, report.processed, report.failed, report.last_line) == ("a", 2, 1, 3)
    assert rows(lake) == [(1, "Kettle", 12.75), (3, "Thing", 1.0)]
    rej = lake.rejects(report.job_id).collect()
    assert [(r.line, r.column, r.value) for r in rej] == [(2, "price", "bad")]

    second = put(tmp_path, "b.csv", "9,New,5\n")
    assert lake.import_table("products", second).slot == "b"
    assert rows(lake) == [(9, "New", 5.0)]
    assert not lake.exists("products_main_a") and lake.active_slot("products") == "b"
    assert lake.import_table("products", first).slot == "a"


def test_readers_keep_the_old_slot_until_vacuum(lake, tmp_path):
    lake.import_table("products", put(tmp_path, "a.csv", "1,Kettle,12.75\n"))
    reader = lake.table("products").select("id", "name", "price")
    files = reader.inputFiles()
    lake.import_table("products", put(tmp_path, "b.csv", "2,New,5\n"))
    assert [tuple(r) for r in reader.collect()] == [(1, "Kettle", 12.75)]
    assert lake.vacuum() == 0
    assert lake.vacuum(grace_seconds=0) >= 1
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert rows(lake) == [(2, "New", 5.0)]


def test_failed_import_keeps_old(lake, tmp_path):
    good = put(tmp_path, "a.csv", "1,Kettle,12.75\n")
    lake.import_table("products", good)
    before = rows(lake)
    bad = put(tmp_path, "b.csv", "1,x,y\n2,z,1\n")
    with pytest.raises(ImportFailedError):
        lake.import_table("products", bad, max_failed=0)
    assert rows(lake) == before
    assert lake.active_slot("products") == "a" and not lake.exists("products_main_b")
    with pytest.raises(Exception):
        lake.import_table("products", str(tmp_path / "missing.csv"))
    assert rows(lake) == before


def test_all_rows_rejected(lake, tmp_path):
    report = lake.import_table("products", put(tmp_path, "x.csv", "1,a,b\n2,c,d\n"))
    assert (report.processed, report.failed) == (0, 2)
    assert rows(lake) == []


def test_delta_is_unioned(lake, tmp_path):
    lake.import_table("products", put(tmp_path, "a.csv", "1,Kettle,12.75\n"))
    extra = lake.spark.createDataFrame([(1, "again", 2.0), (7, "live", 3.0)], "id long, name string, price double")
    lake.append_delta("products", extra)
    assert rows(lake) == [(1, "Kettle", 12.75), (1, "again", 2.0), (7, "live", 3.0)]


def test_resume_keeps_the_finished_parts(lake, tmp_path):
    put(tmp_path, "a.csv", "1,old,1\n")
    lake.import_table("products", str(tmp_path / "a.csv"))
    path = put(tmp_path, "b.csv", "1,a,1\n2,b,2\n3,c,3\n4,d,x\n5,e,5\n")
    with pytest.raises(ImportFailedError):
        lake.import_table("products", path, max_failed=0, part_lines=2)
    assert rows(lake) == [(1, "old", 1.0)] and lake.active_slot("products") == "a"
    job = lake.import_jobs().head()
    assert (job.status, job.processed, job.last_line) == ("failed", 2, 2)
    put(tmp_path, "b.csv", "1,a,1\n2,b,2\n3,c,3\n4,d,4\n5,e,5\n")
    report = lake.import_table("products", path, max_failed=0, part_lines=2, resume=True)
    assert (report.processed, report.slot, report.last_line) == (5, "b", 5)
    assert [r[0] for r in rows(lake)] == [1, 2, 3, 4, 5]
    assert lake.import_jobs().head().status == "completed"
    with pytest.raises(ImportFailedError):
        lake.import_table("products", path, resume=True)  # nothing failed


def many_files(tmp_path, n, bad=()):
    folder = tmp_path / "many"
    folder.mkdir(exist_ok=True)
    for k in range(n):
        lines = [f"g{k}x{j},{'?' if (k, j) in bad else j}" for j in range(k % 3 + 1)]
        (folder / f"f{k:02}.csv").write_text("name,price\n" + "".join(x + "\n" for x in lines))
    (folder / "f03a.csv").write_text("\n\n")
    return str(folder)


@pytest.mark.parametrize("method", ["bulk", "indexer"])
def test_parts_of_files_read_each_file_once(lake, tmp_path, monkeypatch, method):
    """Ids, line numbers and rejects are those of an import in one part, and each part
    reads its own files: once to count, once to convert."""
    from slotlake.sources import delimited

    path = many_files(tmp_path, 9, bad={(2, 1), (5, 0)})
    whole = lake.import_table("products", path, method=method)
    want, rejects = rows(lake), {r.line for r in lake.rejects(whole.job_id).collect()}
    read, plain = [], delimited._lines
    monkeypatch.setattr(
        delimited, "_lines", lambda spark, paths: (isinstance(paths, list) and read.extend(paths)) or plain(spark, paths)
    )
    report = lake.import_table("products", path, method=method, part_bytes=60)
    assert rows(lake) == want and {r.line for r in lake.rejects(report.job_id).collect()} == rejects
    assert (report.processed, report.failed, report.last_line) == (whole.processed, whole.failed, whole.last_line)
    parts = lake._imports("products").latest()[1]["parts"]
    assert len(parts) > 3 and len(set(read)) == 10
    # the scan to count and the one to convert are one frame; `raw` is for open quotes
    assert max(read.count(f) for f in set(read)) <= 2


def test_resume_of_parts_of_files(lake, tmp_path):
    path = many_files(tmp_path, 9, bad={(7, 1)})
    with pytest.raises(ImportFailedError):
        lake.import_table("products", path, max_failed=0, part_bytes=60)
    job = lake._imports("products").latest()[1]
    assert job["status"] == "failed" and len(job["parts"]) >= 2 and job["before"]["files"] > 2
    with pytest.raises(ImportFailedError):
        lake.import_table("products", path, max_failed=0, resume=True)  # begun in another way
    path = many_files(tmp_path, 9)
    (tmp_path / "many" / "f00.csv").write_text("broken")  # finished: not read again
    report = lake.import_table("products", path, max_failed=0, part_bytes=60, resume=None)
    assert report.processed == 18 and [r[0] for r in rows(lake)] == list(range(1, 19))
    with pytest.raises(ValueError):
        lake.import_table("products", path, part_bytes=1, part_lines=1)


def test_small_parts_are_written_together(lake, tmp_path, spark, monkeypatch):
    """The jobs of Spark do not grow with the parts; where some cannot be read, those
    ahead of them are finished all the same."""
    def jobs_of(n, group):
        path = many_files(tmp_path, n)
        spark.sparkContext.setJobGroup(group, "")
        try:
            report = lake.import_table("products", path, part_bytes=1)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(lake._imports("products").latest()[1]["parts"]) == n + 1
        assert [r[0] for r in rows(lake)] == list(range(1, report.processed + 1))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few = jobs_of(5, "few-parts")
    assert jobs_of(30, "many-parts") < few + 10
    whole, read = rows(lake), type(lake)._read

    def failing(self, table, paths, *args):
        if any("f20" in p for p in paths):
            raise OSError("broken disk")
        return read(self, table, paths, *args)

    with monkeypatch.context() as m:
        m.setattr(type(lake), "_read", failing)
        with pytest.raises(OSError):
            lake.import_table("products", str(tmp_path / "many"), part_bytes=1)
    job = lake._imports("products").latest()[1]
    assert job["status"] == "failed" and len(job["parts"]) == 21 and rows(lake) == whole
    lake.import_table("products", str(tmp_path / "many"), part_bytes=1, resume=True)
    assert rows(lake) == whole


def test_parts_are_in_the_order_of_the_numbers(lake, tmp_path):
    """Names that are written otherwise in a scan come in the same order."""
    folder = tmp_path / "odd names"
    folder.mkdir()
    for k, name in enumerate(["a b.csv", "a!b.csv", "a%b.csv", "é.csv", "[x].csv"]):
        (folder / name).write_text(f"n{k}a,{k}\nn{k}b,{k}\n")
    lake.import_table("products", str(folder), header=False)
    want = rows(lake)
    lake.import_table("products", str(folder), header=False, part_bytes=1)
    assert rows(lake) == want and len(want) == 10


def test_parts_of_header_lines_only(lake, tmp_path):
    path = put(tmp_path, "a.csv", "id,name,price\n1,a,1\n2,b,?\n3,c,3\n")
    report = lake.import_table("products", path, part_lines=1)
    assert (report.processed, report.failed) == (2, 1)
    assert [r.line for r in lake.rejects(report.job_id).collect()] == [3]
    assert [r[0] for r in rows(lake)] == [1, 3]


def test_one_import_at_a_time(lake, tmp_path):
    path = put(tmp_path, "a.csv", "1,a,1\n")
    with lake._only_import("products"):
        with pytest.raises(DuplicateImportError):
            lake.import_table("products", path)
    lake.import_table("products", path)
    lake._only_import("products").__enter__()  # of a driver that is gone
    lake.unlock_import("products")
    lake.import_table("products", path)
    assert rows(lake) == [(1, "a", 1.0)]


def test_delta_restore_that_fails_keeps_the_rows(lake, tmp_path):
    lake.import_table("products", put(tmp_path, "a.csv", "1,a,1\n"))
    lake.append_delta("products", lake.table("products_main_a").limit(1))
    bad = lake.table("products_delta").selectExpr("id", "name", "double(raise_error('no')) AS price")
    with pytest.raises(Exception):
        lake.load_table(bad, "products_delta")
    assert rows(lake) == [(1, "a", 1.0)] * 2
    lake.load_table(lake.table("products"), "products_delta")  # reads what it replaces
    assert rows(lake) == [(1, "a", 1.0)] * 3
    lake.append_delta("products", lake.table("products_main_a").limit(1))
    assert rows(lake) == [(1, "a", 1.0)] * 4


def test_indexer_method(lake, tmp_path):
    path = put(tmp_path, "a.tsv", 'name\tprice\n"x\t1\n\ny\t2\n')
    lake.import_table("products", path, method="indexer")
    assert rows(lake) == [(0, '"x', 1.0), (1, "y", 2.0)]


def test_rotate_checks(lake, tmp_path):
    lake.import_table("products", put(tmp_path, "a.csv", "1,a,1\n"))
    for new, old in (("a", "a"), ("c", "a"), ("b", "a")):
        with pytest.raises(ValueError):
            lake.rotate("products", new, old)
    assert rows(lake) == [(1, "a", 1.0)]


def test_backup_and_restore(lake, tmp_path):
    lake.import_table("products", put(tmp_path, "a.csv", "1,a,1\n2,b,2\n"))
    root = str(tmp_path / "snaps")
    now = datetime(2025, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    one = S.backup(lake, "products_main_a", root, now)
    two = S.backup(lake, "products_main_a", root, now)
    delta = S.backup(lake, "products_delta", root, now)
    assert one == "products_main_a-2025-01-02T03-04-05Z.parquet" and one != two
    listed = [r.filename for r in S.list_snapshots(lake.spark, root, "products", "main").collect()]
    assert sorted(listed) == sorted([one, two])
    assert [r.filename for r in S.list_snapshots(lake.spark, root, "products", "delta").collect()] == [delta]

    lake.import_table("products", put(tmp_path, "b.csv", "9,z,9\n"))
    assert lake.active_slot("products") == "b"
    assert S.restore(lake, "products", root, one) == "products_main_a"
    assert rows(lake) == [(1, "a", 1.0), (2, "b", 2.0)]
    assert lake.active_slot("products") == "a" and not lake.exists("products_main_b")

    lake.append_delta("products", lake.table("products_main_a").limit(1))
    S.restore(lake, "products", root, delta, kind="delta")
    assert rows(lake) == [(1, "a", 1.0), (2, "b", 2.0)]
    with pytest.raises(MissingDatasetError):
        S.restore(lake, "products", root, "products_main_a-2000-01-01T00-00-00Z.parquet")
    with pytest.raises(ValueError):
        S.restore(lake, "products", root, "products_main_c-2000.parquet")


def test_prebuilt(lake, tmp_path):
    df = lake.spark.createDataFrame([(5, "p", 1.5)], "id long, name string, price double")
    path = publish(df, str(tmp_path / "built"))
    assert lake.import_prebuilt("products", path) == "a"
    assert rows(lake) == [(5, "p", 1.5)]
    with pytest.raises(MissingDatasetError):
        lake.import_prebuilt("products", str(tmp_path / "nothing"))


def test_pruning_through_the_view(lake, tmp_path):
    lake.import_table("products", put(tmp_path, "a.csv", "1,a,1\n2,b,2\n"))
    plan = lake.table("products").where("price > 1").select("id")._jdf.queryExecution().toString()
    assert plan.count("PushedFilters: [IsNotNull(price), GreaterThan(price,1.0)]") == 2
    assert "ReadSchema: struct<id:bigint,price:double>" in plan
