import hashlib
import json

from pyspark.sql import functions as F

from foliate.operators import audit as U
from foliate.operators import jobs as J
from foliate.operators import regenerate as X
from foliate.operators import versions as N

ARRIVAL = "document_id string, arrival bigint, content_hash string"


def test_versions_dedupe_and_number(spark):
    a = spark.createDataFrame([("d", 10, "h1"), ("d", 20, "h2"), ("d", 30, "h1"), ("d", 200000, "h3"), ("e", 15, "h1")], ARRIVAL)
    got = {(r["document_id"], r["arrival"]): (r["version_number"], r["is_duplicate"]) for r in N.place_arrivals(a).collect()}
    assert got == {("d", 10): (1, False), ("d", 20): (2, False), ("d", 30): (1, True), ("d", 200000): (3, False), ("e", 15): (1, False)}
    hot = {(r["document_id"], r["arrival"]): (r["version_number"], r["is_duplicate"]) for r in N.place_arrivals(a).collect()}
    assert hot == got
    stored = N.new_versions(N.place_arrivals(a))
    again = N.place_arrivals(a.unionByName(spark.createDataFrame([("d", 300001, "h9")], ARRIVAL)), stored)
    assert {(r["arrival"], r["version_number"], r["is_duplicate"]) for r in again.filter("document_id = 'd'").collect()} == {
        (10, 1, True), (20, 2, True), (30, 1, True), (200000, 3, True), (300001, 4, False)
    }
    assert stored.filter("arrival = 20").first()["output_path"] == "documents/d/2/output.docx"


def test_version_lookups(spark):
    v = spark.createDataFrame([("d", 1, "h1"), ("d", 2, "h2"), ("e", 1, "h1")], "document_id string, version_number int, content_hash string")
    docs = spark.createDataFrame([("d", 1), ("e", 0), ("f", 0)], "document_id string, current_version int")
    assert {r["document_id"]: r["next_version"] for r in N.next_numbers(v, docs).collect()} == {"d": 3, "e": 2, "f": 1}
    assert [(r["document_id"], r["version_number"]) for r in N.current_rows(docs, v).collect()] == [("d", 1)]
    assert sorted((r["version_number"], r["total_versions"], r["current_version"]) for r in N.history(v).filter("document_id = 'd'").collect()) == [(1, 2, 2), (2, 2, 2)]
    text = "x"
    good = hashlib.sha256(text.encode()).hexdigest()
    w = spark.createDataFrame([("d", 1, good), ("d", 2, "bad"), ("d", 3, good)], "document_id string, version_number int, content_hash string")
    c = spark.createDataFrame([("d", 1, text), ("d", 2, text)], "document_id string, version_number int, content string")
    assert {r["version_number"]: r["is_intact"] for r in N.integrity(w, c).collect()} == {1: True, 2: False, 3: False}
    m = spark.createDataFrame([('{"content_hash":"h","file_size_bytes":5}',), ("{}",)], "generation_metadata string")
    assert [tuple(r)[1:] for r in N.metadata(m).collect()] == [("h", 5), ("", 0)]
    assert N.existing_versions(v.limit(1), v).count() == 1 and N.version_of(v, "d", 2).count() == 1
    assert N.duplicate_numbers(v.union(v), "document_id", "version_number").count() == 3
    assert {r["document_id"]: r["versions"] for r in N.version_counts(v).collect()} == {"d": 2, "e": 1}


# --- regeneration -----------------------------------------------------------------------------
def request(spark):
    s = spark.createDataFrame([("d", 1, "DYNAMIC"), ("d", 2, "DYNAMIC"), ("d", 3, "DYNAMIC"), ("d", 4, "STATIC"), ("e", 1, "DYNAMIC")], "document_id string, section_id bigint, section_type string")
    t = spark.createDataFrame(
        [("d", 1, 0, False, None), ("d", 2, 0, True, None), ("d", 3, 0, False, {"tone": "dry"}), ("e", 4, 0, False, None)],
        "document_id string, section_id bigint, pos int, force boolean, override map<string,string>",
    )
    data = spark.createDataFrame([("d", {"b": "2", "a": "1"}), ("e", {})], "document_id string, client_data map<string,string>")
    fp = lambda i, d: hashlib.sha256(json.dumps({"client_data": d, "section_id": i}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    prev = spark.createDataFrame(
        [("d", i, fp(i, {"a": "1", "b": "2"}), f"c{i}", f"old {i}") for i in (1, 2, 3)],
        "document_id string, section_id bigint, input_hash string, content_hash string, generated_content string",
    )
    return s, t, prev, data


def test_plan(spark):
    s, t, prev, data = request(spark)
    planned = X.plan(s, t, prev, data)
    got = {r["section_id"]: r["action"] for r in planned.collect()}
    assert got == {1: "reuse", 2: "regenerate", 3: "regenerate"}
    assert [tuple(r) for r in X.target_errors(t, s).collect()] == [("e", 4, "SECTION_NOT_FOUND")]
    forced = X.plan(s, t, prev, data, force_all=True)
    assert {r["action"] for r in forced.collect()} == {"regenerate"}
    bare = X.plan(s, t, prev.filter("section_id > 1"), data)
    assert {r["section_id"]: r["action"] for r in bare.collect()}[1] == "regenerate"
    results = X.section_results(planned)
    row = {r["section_id"]: r for r in results.collect()}
    assert (row[1]["new_content_hash"], row[2]["new_content_hash"], row[2]["previous_content_hash"]) == ("c1", None, "c2")
    status = X.result_status(results).first()
    assert (status["sections_regenerated"], status["sections_reused"], status["status"]) == (2, 1, "COMPLETED")
    broken = results.withColumn("error", F.when(F.col("section_id") == 1, "x"))
    assert X.result_status(broken).first()["status"] == "PARTIALLY_COMPLETED"
    assert X.result_status(broken.withColumn("was_regenerated", F.lit(False))).first()["status"] == "FAILED"
    fresh = spark.createDataFrame([("d", 2, "new 2"), ("d", 3, "new 3")], "document_id string, section_id bigint, generated_content string")
    merged = {r["section_id"]: (r["generated_content"], r["is_reused"]) for r in X.merge_reused(fresh, planned, prev).collect()}
    assert merged == {1: ("old 1", True), 2: ("new 2", False), 3: ("new 3", False)}


def test_regeneration_errors_and_history(spark):
    req = spark.createDataFrame([("d",), ("e",), ("f",)], "document_id string")
    docs = spark.createDataFrame([("d", "t"), ("e", "t")], "document_id string, template_version_id string")
    v = spark.createDataFrame([("d", 4)], "document_id string, version_number int")
    assert {r["document_id"]: r["error_code"] for r in X.document_errors(req, docs, v).collect()} == {"e": "NO_VERSION_EXISTS", "f": "DOCUMENT_NOT_FOUND"}
    s, t, prev, data = request(spark)
    planned = X.plan(s, t, prev, data)
    logs = X.audit_rows(planned, X.result_status(X.section_results(planned), v), docs)
    row = X.transitions(logs).first()
    assert (row["old_version_number"], row["new_version_number"], row["scope"]) == (4, 5, "SECTION")
    assert (sorted(row["regenerated_section_ids"]), row["reused_section_ids"]) == ([2, 3], [1])
    thin = spark.createDataFrame([("DOCUMENT", "d", "REGENERATE", '{"new_version":2}')], "entity_type string, entity_id string, action string, metadata string")
    row = X.transitions(thin).first()
    assert (row["scope"], row["intent"], row["new_version_id"], row["reused_section_ids"]) == ("FULL", "CONTENT_UPDATE", X.NO_ID, [])
    upd = spark.createDataFrame([("d", "v1", "v2"), ("e", "v1", "v9")], "document_id string, old_version string, new_version string")
    secs = spark.createDataFrame([("v1", "p1", "STATIC"), ("v1", "p2", "STATIC"), ("v2", "p2", "DYNAMIC"), ("v2", "p3", "STATIC")], "template_version_id string, structural_path string, section_type string")
    versions = secs.select("template_version_id").distinct()
    got = {r["document_id"]: (r["sections_regenerated"], r["error_code"]) for r in X.template_update(upd, versions, secs).collect()}
    assert got == {"d": (1, None), "e": (0, "TEMPLATE_VERSION_NOT_FOUND")}
    diff = {r["structural_path"]: r["change"] for r in X.template_diff(upd, secs).filter("document_id = 'd'").collect()}
    assert diff == {"p1": "removed", "p2": "retyped", "p3": "added"}


# --- jobs -------------------------------------------------------------------------------------
def jobs(spark, *rows):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "job_id int, job_type string, status string, payload string, created string, started string, result string, error string"
    )
    return df.withColumns({"created_at": F.to_timestamp("created"), "started_at": F.to_timestamp("started")}).drop("created", "started")


def test_stage_cascade(spark):
    cases = {
        "NOT_STARTED": [("REGENERATE", "FAILED")],
        "PARSE": [("PARSE", "RUNNING")],
        "READY_FOR_CLASSIFY": [("PARSE", "FAILED"), ("PARSE", "COMPLETED")],
        "CLASSIFY": [("PARSE", "COMPLETED"), ("CLASSIFY", "PENDING")],
        "READY_FOR_GENERATE": [("PARSE", "COMPLETED"), ("CLASSIFY", "COMPLETED")],
        "GENERATE": [("CLASSIFY", "COMPLETED"), ("GENERATE", "RUNNING")],
        "COMPLETE": [("PARSE", "COMPLETED"), ("GENERATE", "COMPLETED")],
        "failed PARSE": [("PARSE", "FAILED"), ("GENERATE", "COMPLETED")],
        "failed CLASSIFY": [("CLASSIFY", "FAILED"), ("GENERATE", "FAILED")],
        "failed GENERATE": [("GENERATE", "FAILED")],
    }
    rows = [
        (t, s, json.dumps({"template_version_id": name}), f"2024-01-01 00:00:{i:02d}", None, None, None)
        for name, steps in cases.items() for i, (t, s) in enumerate(steps)
    ]
    got = {r["template_version_id"]: r for r in J.current_stage(J.latest_per_stage(jobs(spark, *rows))).collect()}
    assert "NOT_STARTED" not in got
    for name, r in got.items():
        assert r["current_stage"] == name.split()[-1]
        assert r["has_failed"] == name.startswith("failed")
    stages = J.current_stage(J.latest_per_stage(jobs(spark, *rows)))
    req = spark.createDataFrame([(n,) for n in cases], "template_version_id string")
    assert {r[0] for r in J.ready_requests(req, stages).collect()} == {"READY_FOR_GENERATE", "GENERATE", "COMPLETE"}


def test_stuck_and_cancel(spark):
    j = jobs(
        spark,
        ("PARSE", "RUNNING", "{}", "2024-01-01 00:00:00", "2024-01-01 00:28:00", None, None),
        ("PARSE", "RUNNING", "{}", "2024-01-01 00:00:00", "2024-01-01 00:31:00", None, None),
        ("PARSE", "PENDING", "{}", "2024-01-01 00:00:00", None, None, None),
        ("PARSE", "COMPLETED", "{}", "2024-01-01 00:00:00", "2024-01-01 00:00:00", None, None),
    )
    now = F.to_timestamp(F.lit("2024-01-01 01:00:00"))
    assert [r["job_id"] for r in J.stuck(j, now).collect()] == [0]
    back = J.recovered(j, now).first()
    assert (back["status"], back["started_at"], back["error"]) == ("PENDING", None, "Reset: Worker timeout after 30 minutes")
    gone = J.cancelled(j, j.select("job_id")).collect()
    assert {r["job_id"] for r in gone} == {0, 1, 2} and gone[0]["error"] == "Cancelled by user"
    assert J.next_jobs(j).count() == 0


def test_transitions(spark):
    rows = [("a", 1, "PENDING", None), ("a", 2, "RUNNING", None), ("a", 3, "COMPLETED", None), ("a", 4, "RUNNING", None), ("b", 5, "RUNNING", None), ("b", 6, "PENDING", "timeout"), ("c", 7, "RUNNING", None), ("c", 8, "PENDING", None)]
    e = spark.createDataFrame(rows, "job_id string, event_id bigint, status string, reason string").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, event_id)"))
    got = {(r["job_id"], r["previous_status"], r["status"]) for r in J.illegal_transitions(e).collect()}
    assert got == {("a", "COMPLETED", "RUNNING"), ("c", "RUNNING", "PENDING")}


def test_board_and_cards(spark):
    j = jobs(
        spark,
        ("GENERATE", "COMPLETED", '{"template_version_id":"v1"}', "2024-01-01 00:00:00", None, '{"document_id":"d9","version_number":3}', None),
        ("PARSE", "FAILED", '{"template_id":"t1","document_id":"d1"}', "2024-01-01 00:00:00", None, None, "x"),
        ("PARSE", "FAILED", "{}", "2024-01-01 00:00:00", None, "{}", None),
        ("PARSE", "RUNNING", '{"template_version_id":"v2"}', "2024-01-01 00:00:00", None, None, None),
    )
    v = spark.createDataFrame([("v1", "Offer")], "template_version_id string, template_name string")
    t = spark.createDataFrame([("t1", "Letter")], "template_id string, template_name string")
    got = {r["job_id"]: (r["template_name"], r["progress"], r["document_id"], r["version_number"]) for r in J.board(j, v, t).collect()}
    assert got == {0: ("Offer", 100, "d9", 3), 1: ("Letter", 20, "d1", None), 2: ("Unknown Template", 50, None, None), 3: ("Unknown Template", 50, None, None)}
    c = J.counters(j).first()
    assert (c["completed"], c["running"], c["failed"], c["pending_or_running"]) == (1, 1, 2, 1)
    versions = spark.createDataFrame([("t1", "v1", 1, "COMPLETED"), ("t2", "v2", 1, "COMPLETED"), ("t3", "v3", 2, "IN_PROGRESS")], "template_id string, template_version_id string, version_number int, parsing_status string")
    names = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t4",)], "template_id string")
    n = spark.createDataFrame([("v1", 3, 2, 1)], "template_version_id string, total_sections int, static_sections int, dynamic_sections int")
    cards = {r["template_id"]: (r["status"], r["sections"]) for r in J.template_cards(names, versions, j, n).collect()}
    assert cards == {"t1": ("ready", 3), "t2": ("analyzing", 0), "t3": ("analyzing", 0), "t4": ("pending", 0)}


def test_run_outcomes(spark):
    rows = [("ok", s, True, s[:2], None) for s in ("INPUT_PREPARATION", "SECTION_GENERATION", "DOCUMENT_ASSEMBLY", "DOCUMENT_RENDERING", "VERSIONING")]
    rows += [("bad", "INPUT_PREPARATION", True, "i", None), ("bad", "SECTION_GENERATION", False, None, "boom"), ("bad", "DOCUMENT_ASSEMBLY", True, "late", None)]
    df = spark.createDataFrame(rows, "run_id string, stage string, ok boolean, artifact string, error string")
    got = {r["run_id"]: r for r in J.run_outcomes(df).collect()}
    assert got["ok"]["success"] and got["ok"]["current_stage"] == "COMPLETED" and got["ok"]["versioning_id"] == "VE"
    bad = got["bad"]
    assert (bad["failed_stage"], bad["error"], bad["input_preparation_id"], bad["document_assembly_id"]) == ("SECTION_GENERATION", "boom", "i", None)


# --- audit ------------------------------------------------------------------------------------
def test_audit_search(spark):
    rows = [(i, "DOCUMENT" if i % 2 else "JOB", i % 3, "CREATE", json.dumps({"document_id": "d", ("version", "version_number", "version_intent")[i % 3]: i % 2})) for i in range(12)]
    logs = spark.createDataFrame(rows, "id int, entity_type string, entity_id int, action string, metadata string").withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, id)"))
    at = lambda h: F.lit(f"2024-01-01 0{h}:00:00").cast("timestamp_ntz")
    assert [r["id"] for r in U.search(logs, "DOCUMENT", since=at(3), until=at(9), skip=1, limit=2).collect()] == [7, 5]
    assert [r["id"] for r in U.by_version(logs, "d", 1, limit=10).collect()] == [11, 9, 7, 5, 3, 1]
    # without a page no order is made
    assert sorted(r["id"] for r in U.by_version(logs, "d", 1).collect()) == [1, 3, 5, 7, 9, 11]
    assert U.by_key(logs, "document_id", "nobody").count() == 0
    assert U.promote(logs).filter("version_number = 1").count() == 6


def test_audit_checks(spark):
    rows = [("a", "X_STARTED", 1), ("a", "X_COMPLETED", 2), ("b", "X_COMPLETED", 1), ("b", "X_STARTED", 3), ("c", "X_COMPLETED", 5), ("c", "X_COMPLETED", 6)]
    logs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, entity_id string, action string, h int").withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, h)"))
    assert {r["entity_id"] for r in U.completed_before_started(logs, "entity_id").collect()} == {"b", "c"}
    assert [r["entity_id"] for r in U.duplicates(logs, "entity_id", "action").collect()] == ["c"]
    assert U.out_of_order(logs.withColumn("timestamp", F.when(F.col("id") == 1, F.expr("timestamp_ntz'2023-01-01'")).otherwise(F.col("timestamp")))).count() == 1
    assert [r["entity_id"] for r in U.gaps(logs, ["entity_id"], 90).collect()] == ["b"]
    done = logs.withColumn("metadata", F.lit('{"job_id":"0"}'))
    j = spark.createDataFrame([(0, "COMPLETED"), (1, "COMPLETED"), (2, "FAILED")], "job_id int, status string")
    assert [r["job_id"] for r in U.unaudited_jobs(j, done).collect()] == [1]


def test_emitted_rows_leave_out_nulls(spark):
    df = spark.createDataFrame([("b", 7, None, 3), ("c", 8, 2.5, 4)], "batch string, document_id int, generation_duration_ms double, section_id int")
    got = {r["entity_id"]: json.loads(r["metadata"]) for r in U.emit(df, "section_completed", "batch").collect()}
    assert got == {"b": {"section_id": 3, "document_id": "7"}, "c": {"section_id": 4, "document_id": "8", "generation_duration_ms": 2.5}}


def test_catalogue(spark):
    rows = spark.createDataFrame([("JOB_CRASH",), ("NEW",)], "error_code string")
    got = {r["error_code"]: (r["severity"], r["is_retryable"]) for r in U.with_error_details(rows, U.error_catalogue(spark)).collect()}
    assert got == {"JOB_CRASH": ("HIGH", True), "NEW": (None, None)}
