"""The commit log, and the delta's ledger over it."""

import os
import threading
import uuid

import pytest

from slotlake.plans.commits import CommitError, CommitLog, Store
from slotlake.plans.lake import Lake
from slotlake.schema import Registry, TableSchema, columns_of
from slotlake.streaming import imports as ST

COLS = columns_of(("name", "attr_string"), ("price", "attr_float"))


class Bucket(Store):
    """Like an object store: whole files only, refused if present; no rename at all."""

    def __init__(self):
        self.files, self.lock, self.fail = {}, threading.Lock(), None

    def names(self, folder):
        return [k.rpartition("/")[2] for k in list(self.files) if k.rpartition("/")[0] == folder]

    def read(self, path):
        return self.files.get(path)

    def delete(self, path):
        self.files.pop(path, None)

    def put_if_absent(self, path, text):
        if self.fail == "before":
            raise OSError("gone")
        with self.lock:
            if path in self.files:
                return False
            self.files[path] = text
        if self.fail == "after":
            raise OSError("gone")
        return True


def add_one(state):
    return state | {"n": state.get("n", 0) + 1}


@pytest.mark.parametrize("kind", ["bucket", "files"])
def test_every_change_of_many_writers_counts(spark, tmp_path, kind):
    store = Bucket() if kind == "bucket" else None
    log = CommitLog(spark, str(tmp_path / "log"), keep=5, store=store)
    errors = []

    def work():
        try:
            for _ in range(10):
                CommitLog(spark, log.folder, keep=5, store=store).update(add_one, tries=10_000)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=work) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    version, state = log.latest()
    # A writer whose record was cleared away meanwhile is told that it cannot know.
    assert all(isinstance(e, CommitError) for e in errors)
    assert state["n"] == version and (errors or version == 40)
    assert len(log.versions()) <= 15


def test_one_winner_of_a_version(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    won = []
    go = threading.Barrier(8)

    def work(k):
        go.wait()
        if log.put(0, {"by": k}):
            won.append(k)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and log.latest() == (1, {"by": won[0]})
    assert not [n for n in os.listdir(tmp_path / "log") if n.endswith(".draft")]


def test_crashes_leave_the_old_record_or_the_new_one(spark):
    bucket = Bucket()
    log = CommitLog(spark, "b/log", store=bucket)
    log.update(add_one)
    bucket.fail = "before"
    with pytest.raises(OSError):
        log.update(add_one)
    bucket.fail = None
    assert log.latest() == (1, {"n": 1})
    bucket.fail = "after"
    with pytest.raises(OSError):
        log.update(add_one)
    bucket.fail = None
    assert log.latest() == (2, {"n": 2})
    assert log.update(lambda state: None) == {"n": 2} and log.latest()[0] == 2


def test_a_number_that_was_cleared_away_is_not_taken_again(spark):
    log = CommitLog(spark, "b/log", keep=3, store=Bucket())
    log.update(add_one)
    version, state = log.latest()
    for _ in range(20):
        log.update(add_one)
    with pytest.raises(CommitError):
        log.put(version, add_one(state))
    assert log.latest() == (21, {"n": 21})


def test_rename_without_replacing(spark, tmp_path):
    """The way of HDFS and its like, over local files."""
    store = Store(spark)
    path = f"file://{tmp_path}/x.json"
    from slotlake.session import hadoop_path

    fs, jpath = hadoop_path(spark, path)
    assert store._rename(fs, jpath, path, "one") is True
    assert store._rename(fs, jpath, path, "two") is False
    assert store.read(path) == "one" and store.read(path + "?") is None
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".")] == ["x.json"]


@pytest.fixture
def lake(spark, tmp_path):
    reg = Registry().add(TableSchema("goods", COLS))
    made = Lake(spark, str(tmp_path / "lake"), reg, "db" + uuid.uuid4().hex[:8])
    made.ensure_tables()
    return made


def frame(lake, *ids):
    return lake.spark.createDataFrame([(k, f"n{k}", float(k)) for k in ids], "id long, name string, price double")


def ids(lake):
    return sorted(r.id for r in lake.table("goods").collect())


def test_loads_are_replaced_compacted_and_known(lake):
    ledger = lake.delta("goods")
    for k in (0, 1, 2):
        assert lake.append_delta("goods", frame(lake, k), f"feed-{k}")
    assert lake.append_delta("goods", frame(lake, 11), "feed-1")  # repeated: replaced
    assert ids(lake) == [0, 2, 11]
    held = lake.table("goods")  # planned before, read after
    assert lake.compact_delta("goods") == 3
    assert sorted(r.id for r in held.collect()) == ids(lake) == [0, 2, 11]
    state = ledger.log.latest()[1]
    assert state["merged"] == [] and state["upto"] == {"feed": 2} and len(state["loads"]) == 1
    assert not lake.append_delta("goods", frame(lake, 5), "feed-2")
    assert lake.append_delta("goods", frame(lake, 5), "feed-02")  # another id
    assert lake.append_delta("goods", frame(lake, 7), "feed-4")
    assert lake.compact_delta("goods") == 3
    assert ledger.log.latest()[1]["merged"] == ["feed-02", "feed-4"]
    assert ids(lake) == [0, 2, 5, 7, 11]
    assert lake.vacuum() == 0 and lake.vacuum(grace_seconds=0) == 7
    assert ids(lake) == [0, 2, 5, 7, 11] and ledger.log.latest()[1]["hidden"] == {}
    lake.load_table(frame(lake, 1), "goods_delta")
    assert lake.append_delta("goods", frame(lake, 2), "feed-0")  # a restore forgets
    assert ids(lake) == [1, 2]


def test_empty_loads(lake):
    lake.append_delta("goods", frame(lake, 1).limit(0), "e-0")
    assert ids(lake) == []
    lake.append_delta("goods", frame(lake, 3), "e-1")
    assert lake.compact_delta("goods") == 2 and ids(lake) == [3]


def test_appends_from_many_threads(lake):
    def work(k):
        for n in range(3):
            lake.append_delta("goods", frame(lake, 10 * k + n), f"t{k}-{n}")

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    threads.append(threading.Thread(target=lambda: [lake.compact_delta("goods") for _ in range(3)]))
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    lake.delta("goods").repair()
    assert ids(lake) == sorted(10 * k + n for k in range(4) for n in range(3))


def test_a_driver_lost_behind_the_record(lake):
    """The record is made, the view is not: the next one who looks brings it up."""
    ledger = lake.delta("goods")
    ledger.show = lambda: None
    ledger.append(frame(lake, 4), "x-0")
    assert ids(lake) == []
    lake.delta("goods").repair()
    assert ids(lake) == [4]


def test_a_stream_that_replays_a_compacted_batch(lake, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.csv").write_text(f"{k},a,1\n{k + 10},b,bad\n")

    def run(checkpoint):
        q = ST.stream_into_delta(
            lake, "goods", str(source), str(tmp_path / "target"), str(tmp_path / checkpoint), max_files_per_batch=1
        )
        q.awaitTermination()
        assert q.exception() is None

    run("one")
    assert ids(lake) == [0, 1, 2] and lake.rejects().count() == 3
    lake.compact_delta("goods")
    run("two")  # a lost checkpoint: every batch again, under its id
    assert ids(lake) == [0, 1, 2] and lake.rejects().count() == 3
