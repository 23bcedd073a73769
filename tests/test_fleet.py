"""Replica groups, winner rule, table status, history, jobs, names."""

import time

import pytest
from pyspark.sql import functions as F

from slotlake.functions import names as NM
from slotlake.operators import fleet as FL
from slotlake.operators import history as H
from slotlake.operators import jobs as J
from slotlake.operators import tables as TB
from slotlake.sources import datasets as DS

REPLICA = (
    "cluster_id string, idx long, reachable boolean, cluster_status string, "
    "uuid string, seqno long, has_valid_uuid boolean"
)


def replicas(spark, *rows):
    return spark.createDataFrame(
        [("c", i, True, status, uuid, seqno, valid) for i, (status, uuid, seqno, valid) in enumerate(rows)],
        REPLICA,
    )


def winner(spark, *rows, preferred=None):
    df = FL.winning_cluster(
        replicas(spark, *rows), "w", F.lit(preferred) if preferred else None
    ).collect()
    return (df[0].uuid, df[0].source_idx, df[0].node_count) if df else None


def test_winner_rule(spark):
    p, n = "primary", "non-primary"
    assert winner(spark, (n, "a", 100, True), (p, "a", 50, True)) == ("a", 1, 1)
    assert winner(spark, (n, "a", 100, True), ("donor", "a", 50, True)) is None
    assert winner(spark, (n, "a", 100, True), (p, "a", 80, True), (p, "a", 90, True)) == ("a", 2, 2)
    assert winner(
        spark, (p, "a", 100, True), (n, "a", 90, True), (p, "b", 80, True), (p, "b", 70, True)
    ) == ("b", 2, 2)
    assert winner(spark, (p, "a", 9, True), (p, "b", 3, True)) == ("b", 1, 1)
    assert winner(spark, (p, "a", 9, True), (p, "b", 3, True), preferred="a") == ("a", 0, 1)
    assert winner(spark, (p, "b", 3, True), (p, "b", 1, True), (p, "a", 9, True), preferred="a") == ("b", 0, 2)
    assert winner(spark, (p, "a", 5, True), (p, "a", 5, True)) == ("a", 0, 2)
    assert winner(spark, (p, "x", 1, False), (p, "a", -1, True)) == ("a", 1, 1)


def test_split_brain_and_quorum(spark):
    df = replicas(spark, ("primary", "a", 1, True), ("primary", "b", 2, True))
    assert FL.split_brain(df).head().split_brain
    q = FL.quorum(df).head()
    assert (q.reachable, q.primary, q.uuids, q.has_quorum) == (2, 2, 2, True)
    assert {(r.uuid, r.idx, r.node_count) for r in FL.cluster_members(df).collect()} == {
        ("a", 0, 1), ("b", 1, 1)
    }
    assert FL.lowest_available(df).head().lowest_idx == 0


def test_fleet_status(spark):
    schema = "cluster_id string, idx long, error string, cluster_status string"
    rows = [
        ("ok", 0, None, "primary"), ("ok", 1, None, "synced"), ("ok", 2, "x: no such host", None),
        ("deg", 0, None, "primary"), ("deg", 1, "timeout", None),
        ("bad", 0, None, "non-primary"), ("new", 0, None, None), ("gone", 0, "API error (503)", None),
    ]
    status = FL.replica_status(spark.createDataFrame(rows, schema))
    got = {r.cluster_id: (r.online, r.in_use, r.status) for r in FL.fleet_status(status).collect()}
    assert got == {
        "ok": (2, 2, "healthy"), "deg": (1, 2, "degraded"), "bad": (1, 1, "degraded"),
        "new": (1, 1, "uninitialized"), "gone": (0, 1, "uninitialized"),
    }
    versions = spark.createDataFrame(
        [("deg", 1, "pull", ["pull", "", "crash"]), ("ok", 0, "fine", []), ("ok", 2, "n", [])],
        "cluster_id string, idx long, message string, containers array<string>",
    )
    msgs = {
        (r.cluster_id, r.idx): r.deployment_message
        for r in FL.with_deployment_messages(status, versions).collect()
    }
    assert msgs[("deg", 1)] == "pull\ncrash"
    assert msgs[("ok", 0)] is None and msgs[("ok", 2)] is None


def test_broadcast_outcome(spark):
    rows = [
        (1, "success", None), (1, "success", None), (2, "success", None), (2, "error", "x"),
        (3, "error", "x"), (4, "error", "no such host"), (4, "success", None), (5, "error", "no such host"),
    ]
    df = spark.createDataFrame(rows, "q int, status string, error string")
    got = {r.q: r.status for r in FL.broadcast_outcome(df, "q").collect()}
    assert got == {1: "ok", 2: "partial", 3: "error", 4: "ok", 5: "ok"}


def test_table_status(spark):
    configured = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",)], "name string")
    configs = spark.createDataFrame([("t2", False)], "name string, cluster_main boolean")
    slots = spark.createDataFrame([("t2", "b"), ("t1", "")], "name string, slot string")
    conf = TB.with_defaults(configured, configs, slots)
    names = {
        0: ["t1_main_a", "t1_delta", "t1", "t2_main_b", "t2_delta", "t2", "t3_main_b", "zz"],
        1: ["t1_main_a", "t1_delta", "t1", "t2_main_b", "t2_delta", "t2", "t4_delta"],
    }
    listed = spark.createDataFrame([(i, n) for i in names for n in names[i]], "idx long, name string")
    members = spark.createDataFrame([("t1_main_a",), ("t1_delta",), ("t2_delta",)], "name string")
    listings = TB.with_membership(listed, members)
    state = spark.createDataFrame([(0, True, None), (1, True, None), (2, False, "down")], "idx long, online boolean, error string")
    matrix = TB.with_replica_state(TB.table_status(conf, listings, 3), state)
    assert matrix.count() == 12
    health = TB.table_health(matrix)
    assert {r.name: r.health for r in health.collect()} == {
        "t1": "healthy", "t2": "healthy", "t3": "empty", "t4": "partial"
    }
    s = TB.summary_counts(conf, health).head()
    assert (s.tables, s.healthy, s.slot_a, s.slot_b) == (4, 2, 3, 1)
    assert [r.idx for r in TB.missing_replicas(state, listings, "t4_delta").orderBy("idx").collect()] == [0, 2]


def command(i, action, stage="completed", **env):
    pairs = [("ACTION", action)] + list(env.items())
    return {
        "id": f"c{i}", "type": "runCronWorkload", "lifecycleStage": stage,
        "created": f"2025-01-{i:02d}T00:00:00Z",
        "spec": {"location": "x", "containerOverrides": [
            {"name": "one", "env": None}, {"name": "two", "env": [{"name": k, "value": v} for k, v in pairs]},
        ]},
    }


def test_history(spark):
    first = spark.createDataFrame(
        [
            command(1, "import", TABLE_NAME="t1"), command(2, "import"),
            command(3, "repair", REPAIR_SOURCE_REPLICA="4"), command(4, "other"),
            command(5, "import", "running", TABLE_NAME="t2"), command(6, "repair", REPAIR_SOURCE_REPLICA="x"),
        ], DS.COMMAND_SCHEMA,
    )
    second = spark.createDataFrame(
        [
            command(7, "backup", DATASET="t1", TYPE="main", RESTORE_FILE="no"),
            command(8, "restore", "pending", DATASET="t1", TYPE="delta", RESTORE_FILE="f.tar.gz"),
            command(9, "backup"),
        ], DS.COMMAND_SCHEMA,
    )
    got = [
        (r.id, r.action, r.table_name, r.type, r.filename, r.source_replica)
        for r in H.newest(H.command_history(first, second)).collect()
    ]
    assert got == [
        ("c8", "restore", "t1", "delta", "f.tar.gz", None), ("c7", "backup", "t1", "main", None, None),
        ("c6", "repair", None, None, None, None), ("c5", "import", "t2", None, None, None),
        ("c3", "repair", None, None, None, 4), ("c1", "import", "t1", None, None, None),
    ]
    assert [r.table_name for r in H.active_imports(first).collect()] == ["t2"]
    assert H.is_busy(first, ("import",), "t2") and not H.is_busy(first, ("import",), "t1")
    assert H.is_busy(second, ("backup", "restore")) and not H.is_busy(first, ("repair",))
    ops = spark.createDataFrame([("t2", "import", "scaling"), ("t9", "import", "scaling")], "table_name string, action string, phase string")
    assert [r.table_name for r in H.untracked_operations(ops, H.active_imports(first)).collect()] == ["t9"]
    assert H.match_terms(first, {"id": "c1", "lifecycleStage": "running"}, "any").count() == 2
    assert H.match_terms(first, {"id": "c1", "lifecycleStage": "running"}).count() == 0
    pages = [first.where("id <= 'c3'"), first.where("id > 'c3'")]
    assert H.merge_pages(pages).count() == 6 and H.merge_pages(pages, 4).count() == 4


def test_job_log(spark, tmp_path):
    log = J.JobLog(spark, str(tmp_path / "jobs"))
    one = log.create("t", "p.csv")
    log.update(one, J.RUNNING, lastLineNum=80000)
    two = log.create("t", "p.csv", startedAt=int(time.time()) + 5)
    points = J.resume_points(log.all(), spark.createDataFrame([(two,)], "id string")).head()
    assert (points.job_id, points.start_line) == (one, 80000)
    with pytest.raises(J.JobStateError):
        log.update(two, J.COMPLETED)
    log.cancel(two)
    with pytest.raises(J.JobStateError):
        log.cancel(two)
    assert log.recover() == 1
    assert [r.id for r in J.interrupted_jobs(log.all()).collect()] == [one]
    now = int(time.time()) + 2 * J.KEEP_SECONDS
    assert J.expired_jobs(log.all(), now).count() == 2 and J.kept_jobs(log.all(), now).count() == 0


def test_read_jobs_skips_bad_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "id": "a", "table": "t", "status": "running", "lastLineNum": 7\n}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.txt").write_text('{"id": "c"}')
    (tmp_path / "d.json").write_text('{"id": "d", "status": "completed", "endedAt": 5}')
    rows = {r.id: r for r in DS.read_jobs(spark, str(tmp_path), now=99).collect()}
    assert set(rows) == {"a", "d"}
    assert (rows["a"].status, rows["a"].endedAt, rows["a"].error) == ("failed", 99, DS.RESTART_MESSAGE)
    assert rows["d"].status == "completed"


def test_state_and_metric_files(spark, tmp_path):
    (tmp_path / "s1").write_text("# saved\nuuid:  abc-1 \nseqno: 12\nsafe_to_bootstrap: 1\nnonsense\n")
    (tmp_path / "s2").write_text("uuid: x:y\nseqno: bad\n\n")
    (tmp_path / "s3").write_text("# nothing\n")
    got = {r.file[-2:]: (r.uuid, r.seqno, r.safe_to_bootstrap) for r in DS.read_kv_files(spark, str(tmp_path / "s*")).collect()}
    assert got == {"s1": ("abc-1", 12, 1), "s2": ("x:y", 0, 0), "s3": ("", 0, 0)}
    (tmp_path / "m1").write_text("other 1\n  queries_count 123\nqueries_count 5\n")
    (tmp_path / "m2").write_text("queries_count\nqueries_count x\n")
    got = {r.file[-2:]: r.metric for r in DS.read_metrics(spark, str(tmp_path / "m*"), "queries_count").collect()}
    assert got == {"m1": 123, "m2": None}


def test_names(spark):
    df = spark.createDataFrame(
        [("addresses_main_a", "addresses"), ("p_main_b", "p"), ("p_delta", "p"), ("plain", "plain"), ("x_main_c", "x_main_c")],
        "n string, want string",
    )
    for r in df.select("n", "want", NM.base_name(F.col("n")).alias("got")).collect():
        assert r.got == r.want
    ddl = "CREATE TABLE x type='distributed' local='x_main_b' local='x_delta'"
    one = spark.createDataFrame([(ddl, " a, b ,,a", "http://h.example.com:8080/x/y.csv", "x_main_b-2025.tar.gz")], "d string, l string, u string, f string")
    r = one.select(
        NM.locals_of_ddl(F.col("d")).alias("locals"),
        NM.active_slot(F.lit("x"), NM.locals_of_ddl(F.col("d"))).alias("slot"),
        NM.active_slot(F.lit("y"), NM.locals_of_ddl(F.col("d"))).alias("none"),
        NM.name_set(F.col("l")).alias("names"),
        NM.sql_address(F.col("u")).alias("addr"),
        NM.replication_address_of_url(F.lit("https://m-0.m:8080")).alias("rep"),
        NM.replication_address(F.lit("search"), F.lit(2)).alias("rep2"),
        NM.last_segment(F.col("u")).alias("last"),
        NM.snapshot_slot(F.col("f"), F.lit("x")).alias("snap"),
        NM.snapshot_slot(F.lit("x_main_q-1"), F.lit("x")).alias("badsnap"),
        NM.snapshot_name(F.lit("t"), F.lit("2025-01-02 03:04:05").cast("timestamp")).alias("sn"),
        NM.is_retryable(F.lit("read: connection reset by peer")).alias("retry"),
        NM.is_retryable(F.lit("bad request")).alias("noretry"),
        NM.is_valid_uuid(F.lit(True), F.lit(NM.ZERO_UUID)).alias("zero"),
    ).head()
    assert list(r.locals) == ["x_main_b", "x_delta"] and r.slot == "b" and r.none == ""
    assert list(r.names) == ["a", "b"] and r.addr == "h.example.com:9306" and r.rep == "m-0.m:9312"
    assert r.rep2 == "search-2.search:9312" and r["last"] == "y.csv" and r.snap == "b" and r.badsnap is None
    assert r.sn == "t-2025-01-02T03-04-05Z.tar.gz" and r.retry and not r.noretry and not r.zero


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_snapshot_name_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        at = F.timestamp_seconds(F.col("s"))
        rows = spark.createDataFrame([(0,), (1_741_505_403,), (-1,)], "s long")
        got = [r.n for r in rows.select(NM.snapshot_name(F.lit("t"), at).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [
        "t-1970-01-01T00-00-00Z.tar.gz", "t-2025-03-09T07-30-03Z.tar.gz", "t-1969-12-31T23-59-59Z.tar.gz"
    ]
