from pyspark.sql import functions as F

from foliate.operators import classify as C
from foliate.operators import jobs as J
from foliate.streaming import events as S

EVENT = "job_id bigint, event_id bigint, ts timestamp_ntz, status string, reason string"


def drop(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def events(spark, folder, *batches):
    """Each batch as its own file, so that each makes its own micro-batch."""
    import datetime as dt

    start, n = dt.datetime(2024, 1, 1), 0
    for i, rows in enumerate(batches):
        out = []
        for job, minute, status, reason in rows:
            n += 1
            out.append((job, n, start + dt.timedelta(minutes=minute), status, reason))
        drop(spark, folder, f"part{i}", out, EVENT)
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_state_machine_and_stuck_alert(spark, tmp_path):
    stream = events(
        spark, tmp_path / "in",
        [(1, 0, "PENDING", None), (2, 0, "PENDING", None), (1, 1, "RUNNING", None), (2, 1, "RUNNING", None)],
        [(1, 5, "COMPLETED", None), (1, 6, "RUNNING", None), (3, 40, "PENDING", None)],
        [(3, 120, "RUNNING", None)],
        [(3, 121, "PENDING", "reset after timeout")],
    )
    got = S.run_available(S.job_states(stream, "1 minute"), "test-states").collect()
    view = sorted((r["job_id"], r["previous_status"] or "", r["status"], r["verdict"]) for r in got)
    assert (1, "COMPLETED", "RUNNING", "illegal") in view
    assert (2, "RUNNING", "RUNNING", "stuck") in view
    assert (3, "RUNNING", "PENDING", "accepted") in view
    assert sum(v[3] == "stuck" for v in view) == 1
    assert sum(v[3] == "accepted" for v in view) == 8


def test_finished_jobs_are_forgotten(spark, tmp_path):
    day = 24 * 60
    stream = events(
        spark, tmp_path / "in",
        [(1, 0, "PENDING", None), (1, 1, "RUNNING", None), (1, 2, "COMPLETED", None)],
        [(2, 3 * day, "PENDING", None)],
        [(2, 4 * day, "RUNNING", None)],
        [(1, 5 * day, "RUNNING", None)],
    )
    got = S.run_available(S.job_states(stream, "1 minute", retain_days=2), "test-forget").filter("job_id = 1").collect()
    assert sorted((r["previous_status"] or "", r["status"], r["verdict"]) for r in got) == [
        ("", "PENDING", "accepted"), ("", "RUNNING", "accepted"), ("PENDING", "RUNNING", "accepted"), ("RUNNING", "COMPLETED", "accepted"),
    ]


JOB = "job_id bigint, job_type string, status string, payload string, created_at timestamp_ntz"


def job(i, version, day=0, status="COMPLETED", kind="PARSE"):
    import datetime as dt

    return (i, kind, status, f'{{"template_version_id":"{version}"}}', dt.datetime(2024, 1, 1) + dt.timedelta(days=day))


def test_next_jobs_are_sent_once(spark, tmp_path):
    first = [job(1, "v1"), job(2, "v1"), job(3, "v2", status="RUNNING"), job(6, "v3", kind="CLASSIFY")]
    for name, rows in (("a", first), ("b", [job(4, "v1", 1), job(5, "v2", 1)]), ("c", [job(7, "v9", 20)]), ("d", [job(8, "v9", 21)]), ("e", [job(9, "v1", 22), job(10, "v9", 22)])):
        drop(spark, tmp_path / "in", name, rows, JOB)
    read = lambda: spark.readStream.schema(JOB).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sent = lambda **k: sorted(r["template_version_id"] for r in S.run_available(S.next_jobs(read(), **k), "test-next").collect())
    assert sent() == ["v1", "v2", "v9"]
    # v1 was forgotten in between
    assert sent(retain_days=5) == ["v1", "v1", "v2", "v9"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "s", t) for i, t in enumerate(["Confidential\nDear {x}", "plain words only here", "Tel: 1"])]
    drop(spark, tmp_path / "in", "a", rows, "doc_id bigint, source string, text string")
    from foliate.sources import tables as T

    schema = "doc_id bigint, source string, text string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = S.run_available(S.classified(T.text_blocks_of(stream)), "test-classify")
    batch = C.classify(T.text_blocks_of(spark.read.option("recursiveFileLookup", True).schema(schema).parquet(str(tmp_path / "in"))))
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count() == 4
    v = S.run_available(S.validated(stream, "text").select("doc_id", "is_valid"), "test-validate")
    assert v.count() == 3


def test_notifications_and_dedupe(spark, tmp_path):
    lines = spark.createDataFrame([("7:PARSE",), ("x",), ("8:OTHER",), (":PARSE",)], "value string")
    assert [tuple(r) for r in S.notifications(lines).collect()] == [("7", "PARSE")]
    stream = events(spark, tmp_path / "in", [(1, 0, "PENDING", None), (1, 1, "PENDING", None)], [(1, 2, "PENDING", None), (2, 2, "PENDING", None)])
    got = S.run_available(S.once_per_key(stream, ["job_id", "status"], "1 hour"), "test-dedupe")
    assert sorted(r["job_id"] for r in got.collect()) == [1, 2]


def test_heartbeats(spark):
    rows = [("w", s) for s in (0, 30, 89, 150, 300)]
    df = spark.createDataFrame(rows, "worker_id string, s int").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s)"))
    got = S.heartbeat_sessions(df).orderBy("alive_from").collect()
    assert [r["beats"] for r in got] == [3, 1, 1]


def test_life_spans_equal_session_windows(spark):
    import random

    rng, t, rows = random.Random(3), 0, []
    for _ in range(400):
        t += rng.choice([1, 20, 59, 60, 61, 500, 4000])
        rows.append((rng.choice(["hot", "hot", "w1", "w2"]), t))
    df = spark.createDataFrame(rows, "worker_id string, s int").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:59:00' + make_dt_interval(0, 0, 0, s)"))
    a, b = J.life_spans(df), S.heartbeat_sessions(df)
    assert a.count() > 20
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
