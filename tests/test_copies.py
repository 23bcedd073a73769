"""One statement on several copies at the same time."""

import os
import threading
import time
import uuid

import pytest

from slotlake.plans import query as Q


@pytest.fixture
def copies(spark):
    names = []
    for k in range(3):
        name = f"copy{uuid.uuid4().hex[:8]}"
        spark.sql(f"CREATE DATABASE {name}")
        spark.range(k + 1).selectExpr("id AS k").write.saveAsTable(f"{name}.t")
        names.append(name)
    yield names
    for name in names:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def sleeping(ms):
    """A statement that takes this long for a row."""
    nap = f"reflect('java.util.concurrent.locks.LockSupport', 'parkNanos', {ms * 1_000_000}L)"
    return f"SELECT k, sum(s) AS s FROM (SELECT k, length(coalesce({nap}, '')) AS s FROM t) GROUP BY k"


def test_copies_run_at_the_same_time(spark, copies):
    out = Q.query_all(spark, sleeping(1500), copies)
    assert out.status == "ok" and [r.row_count for r in out.results] == [1, 2, 3]
    ends = [r.started + r.elapsed_ms / 1000 for r in out.results]
    assert max(r.started for r in out.results) < min(ends)
    assert sorted((r.source_index, r.k) for r in out.df.collect()) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_results_are_deleted_by_their_owner(spark, copies):
    with Q.query_all(spark, "SELECT k FROM t", [*copies, "nowhere"]) as out:
        paths = [r.path for r in out.results if r.path]
        assert len(paths) == 3 and all(os.path.isdir(p.removeprefix("file:")) for p in paths)
        assert out.status == "partial" and out.df.count() == 6
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)
    out.close()
    one = Q.query_target(spark, "SELECT k FROM t", copies, 1)
    one.close()
    assert one.path is None


def test_one_copy_can_be_stopped(spark, copies):
    tag = uuid.uuid4().hex
    found = []
    run = threading.Thread(target=lambda: found.append(Q.query_all(spark, sleeping(6000), copies[:2], tag)))
    run.start()
    until = time.time() + 40
    while run.is_alive() and time.time() < until:
        Q.cancel(spark, tag, copy=1)  # until its job has begun
        time.sleep(0.2)
    run.join()
    status = [r.status for r in found[0].results]
    assert status == ["success", "cancelled"] and found[0].status == "partial"
    assert found[0].df.count() == 1
    # The next run under the tag is not touched, and an empty statement is refused.
    assert Q.query_all(spark, "SELECT k FROM t", copies[:2], tag).status == "ok"
    with pytest.raises(Q.QueryError):
        Q.query_all(spark, " ", copies)


def test_nothing_left_of_a_copy_that_fails_midway(spark, copies):
    out = Q.query_all(spark, "SELECT if(k = 1, raise_error('no'), k) AS k FROM t", copies)
    assert [r.status for r in out.results] == ["success", "error", "error"]
    assert [bool(r.path) for r in out.results] == [True, False, False]
