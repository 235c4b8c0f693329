import hashlib
import json

from pyspark.sql import functions as F

from foliate.operators import attempts as R
from foliate.operators import inputs as G

GOOD = "The quarterly figures improved in every region we looked at."
SECTION = "template_version_id string, section_id bigint, structural_path string, section_type string, prompt_config struct<classification_confidence:double,classification_method:string,justification:string,prompt_template:string>"


def sections(spark):
    cfg = (0.95, "rule_based", "because", None)
    rows = [("v", 1, "body/introduction", "STATIC", None), ("v", 2, "body/a/content", "DYNAMIC", cfg), ("v", 3, "body/a/notes", "DYNAMIC", cfg), ("v", 4, "closing", "DYNAMIC", cfg)]
    return spark.createDataFrame(rows, SECTION)


def test_context(spark):
    got = {r["section_id"]: r for r in G.dynamic_inputs(sections(spark)).collect()}
    assert sorted(got) == [2, 3, 4]
    two, four = got[2], got[4]
    assert (two["sequence_order"], two["preceding_type"], two["preceding_content"], two["following_content"]) == (0, "STATIC", "body/introduction", "body/a/notes")
    assert two["section_boundary_hint"] == "Section at position 2 of 4"
    assert (two["parent_heading"], two["depth"], two["sibling_index"], two["total_siblings"]) == ("a", 2, 0, 2)
    assert (four["parent_heading"], four["depth"], four["sibling_index"], four["total_siblings"], four["following_type"]) == (None, 0, 0, 1, None)


def full_inputs(spark, name="Acme"):
    rows = G.dynamic_inputs(sections(spark)).withColumns({"template_id": F.lit("t"), "client_id": F.lit(1)})
    clients = spark.createDataFrame([(1, name, {"b": "2", "a": "1"})], "client_id int, client_name string, data_fields map<string,string>")
    return G.with_input_hash(G.attach_client(rows, clients))


def test_input_hash_is_canonical_json(spark):
    row = full_inputs(spark).filter("section_id = 2").first()
    want = {
        "client_data": {"client_id": "1", "client_name": "Acme", "custom_context": {}, "data_fields": {"a": "1", "b": "2"}},
        "hierarchy_context": {"depth": 2, "parent_heading": "a", "parent_level": 2, "path_segments": ["body", "a", "content"], "sibling_index": 0, "total_siblings": 2},
        "prompt_config": {"classification_confidence": 0.95, "classification_method": "rule_based", "justification": "because", "prompt_template": None},
        "section_id": 2, "structural_path": "body/a/content",
        "surrounding_context": {"following_content": "body/a/notes", "following_type": "DYNAMIC", "preceding_content": "body/introduction", "preceding_type": "STATIC", "section_boundary_hint": "Section at position 2 of 4"},
        "template_id": "t", "template_version_id": "v",
    }
    assert row["input_hash"] == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_batch_hash_ignores_order_and_sees_changes(spark):
    a = G.batches(full_inputs(spark), "template_version_id").first()
    b = G.batches(full_inputs(spark).repartition(3), "template_version_id").first()
    c = G.batches(full_inputs(spark, "Other"), "template_version_id").first()
    assert a["content_hash"] == b["content_hash"] != c["content_hash"]
    hashes = sorted(r["input_hash"] for r in full_inputs(spark).collect())
    assert a["content_hash"] == hashlib.sha256(json.dumps(hashes, separators=(",", ":")).encode()).hexdigest()


def test_prompt_leaves_out_what_is_missing(spark):
    rows = full_inputs(spark)
    text = rows.filter("section_id = 4").select(G.prompt_text(rows)).first()[0].split("\n")
    assert text == [
        "Generate content for section at path: closing", "Classification confidence: 0.95", "Justification: because",
        "Document structure: closing", "Client: Acme", "a: 1", "b: 2", "Preceding section: body/a/notes",
    ]


def test_input_checks_first_failure(spark):
    uuid = "00000000-0000-4000-8000-000000000000"
    schema = "section_id bigint, template_id string, template_version_id string, structural_path string, prompt_config struct<classification_confidence:double>"
    rows = [(0, "x", "x", "", (2.0,)), (1, "x", uuid, "p", (0.5,)), (1, uuid, uuid, " ", (0.5,)), (1, uuid, uuid, "p", (1.5,)), (1, uuid, uuid, "p", (1.0,))]
    got = [r["input_error"]["field"] if r["input_error"] else None for r in G.check_input(spark.createDataFrame(rows, schema)).collect()]
    assert got == ["section_id", "template_id", "structural_path", "prompt_config.classification_confidence", None]


def test_write_once(spark):
    new = spark.createDataFrame([("d", 1), ("d", 2), ("e", 0)], "document_id string, version_intent int")
    old = spark.createDataFrame([("d", 1, True), ("d", 2, False)], "document_id string, version_intent int, is_immutable boolean")
    assert sorted(tuple(r) for r in G.accepted_batches(new, old, "document_id", "version_intent").collect()) == [("d", 2), ("e", 0)]
    assert [r["version_intent"] for r in G.write_violations(new, old, "document_id", "version_intent").collect()] == [1]
    assert [r["document_id"] for r in G.bad_intents(new).collect()] == ["e"]


# --- attempts ---------------------------------------------------------------------------------
def chain(spark, **chains):
    rows = [(key, i, ok, text) for key, tries in chains.items() for i, (ok, text) in enumerate(tries)]
    df = spark.createDataFrame(rows, "section_id string, attempt_no int, llm_ok boolean, raw_output string")
    return {r["section_id"]: r for r in R.outcomes(R.judge(df), "section_id").collect()}


def test_chains(spark):
    ok, fail, short, tags = (True, GOOD), (False, ""), (True, "short"), (True, f"{GOOD} <b>")
    got = chain(
        spark, first=[ok, tags], second=[short, ok], stops=[tags, ok], dead=[fail] * 4, thin=[short] * 5, open=[fail, short], repeats=[(True, "again " * 12), ok]
    )
    def view(k):
        r = got[k]
        return r["status"], r["error_code"], r["failure_category"], r["retry_count"], len(r["retry_history"])
    assert view("first") == ("VALIDATED", None, None, 0, 0)
    assert view("second") == ("VALIDATED", None, None, 1, 1)
    assert view("stops") == ("FAILED", "CONTAINS_TAGS", "STRUCTURAL_VIOLATION", 0, 0)
    assert view("dead") == ("FAILED", "RETRY_EXHAUSTED", "RETRY_EXHAUSTION", 3, 3)
    assert got["dead"]["error_message"] == "Retry exhausted after 4 attempts: LLM invocation failed"
    assert view("thin") == ("FAILED", "NEAR_EMPTY_CONTENT", "BOUNDS_VIOLATION", 3, 3)
    assert view("open") == ("RETRYING", "NEAR_EMPTY_CONTENT", "BOUNDS_VIOLATION", 2, 2)
    assert view("repeats")[0:3] == ("FAILED", "NEAR_EMPTY_CONTENT", "QUALITY_FAILURE")
    assert got["second"]["content_hash"] == hashlib.sha256(GOOD.encode()).hexdigest()
    assert got["second"]["last_attempt"]["attempt"] == 0
    flags = {r["section_id"]: r for r in R.flags(_frame(spark, got)).collect()}
    assert flags["first"]["is_ready_for_assembly"] and not flags["open"]["is_ready_for_assembly"]
    assert flags["open"]["can_retry"] and not flags["dead"]["can_retry"] and flags["dead"]["is_retry_exhausted"]


def _frame(spark, got):
    names = ("section_id", "status", "generated_content", "content_hash", "content_length", "error_code", "error_message", "failure_category", "retry_count", "max_retries", "is_validated", "is_immutable")
    schema = "section_id string, status string, generated_content string, content_hash string, content_length int, error_code string, error_message string, failure_category string, retry_count bigint, max_retries int, is_validated boolean, is_immutable boolean"
    return spark.createDataFrame([tuple(r[n] for n in names) for r in got.values()], schema)


def test_batches(spark):
    got = chain(spark, a=[(True, GOOD)], b=[(True, "<b> " + GOOD)], c=[(False, "")])
    df = _frame(spark, got).withColumn("batch_key", F.when(F.col("section_id") == "c", "open").otherwise("done"))
    progress = {r["batch_key"]: r for r in R.batch_progress(df, "batch_key").collect()}
    assert (progress["done"]["status"], progress["done"]["is_immutable"]) == ("COMPLETED", True)
    assert progress["open"]["status"] == "IN_PROGRESS"
    ready = {r["batch_key"]: r["is_ready"] for r in R.readiness(df, "batch_key").collect()}
    assert ready == {"done": False, "open": False}
    counts = {r["batch_key"]: r for r in R.status_counts(df, "batch_key").collect()}
    assert (counts["done"]["validated"], counts["done"]["failed"], counts["open"]["retrying"], counts["open"]["pending"]) == (1, 1, 1, 0)
    known = df.filter("section_id <> 'a'")
    missing = {r["section_id"]: r["error_code"] for r in R.with_missing_inputs(df, known, "section_id").collect()}
    assert missing == {"a": "MISSING_INPUT", "b": "CONTAINS_TAGS", "c": "LLM_INVOCATION_FAILED"}
    reset = {r["section_id"]: (r["status"], r["error_code"]) for r in R.reset_for_retry(df).collect()}
    assert reset["c"] == ("IN_PROGRESS", None) and reset["b"] == ("FAILED", "CONTAINS_TAGS")
    bad = R.unexpected_errors(df, F.when(F.col("section_id") == "a", F.lit("boom")))
    assert {r["section_id"]: r["error_code"] for r in bad.collect()}["a"] == "UNEXPECTED_ERROR"
    assert R.validated(df).count() == 1 and R.retrying(df).count() == 1 and R.by_failure(df, "STRUCTURAL_VIOLATION").count() == 1


def test_output_batch_guards(spark):
    inputs = spark.createDataFrame([("a", "VALIDATED", True), ("b", "VALIDATED", True), ("c", "PENDING", False)], "batch_key string, status string, is_immutable boolean")
    out = spark.createDataFrame([("a",)], "batch_key string")
    assert [r["batch_key"] for r in R.new_output_batches(inputs, out).collect()] == ["b"]
    assert [r["batch_key"] for r in R.duplicate_output_batches(inputs, out).collect()] == ["a"]


def test_generators(spark):
    df = spark.range(1, 4).withColumnRenamed("id", "section_id")
    made = {r["section_id"]: (r["llm_ok"], r["raw_output"]) for r in R.generate(df, failing=F.col("section_id") == 2).collect()}
    assert made == {1: (True, "Deterministic content for section 1"), 2: (False, ""), 3: (True, "Deterministic content for section 3")}
    answers = spark.createDataFrame([(1, "mine")], "section_id bigint, text string")
    assert {r["section_id"]: r["raw_output"] for r in R.generate(df, responses=answers, on=["section_id"]).collect()}[2] == "Generated content for section."
    assert R.generate(df, text=F.upper(F.lit("x"))).first()["raw_output"] == "X"


def test_responses_of_two_documents(spark):
    """Section ids repeat between documents; texts must not mix."""
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "template_version_id string, section_id bigint")
    answers = spark.createDataFrame([("a", 1, "of a"), ("b", 1, "of b")], "template_version_id string, section_id bigint, text string")
    made = {tuple(r)[:2]: r["raw_output"] for r in R.generate(rows, responses=answers).collect()}
    assert made == {("a", 1): "of a", ("a", 2): "Generated content for section.", ("b", 1): "of b"}


def test_backoff_and_eligibility(spark):
    df = spark.range(6)
    assert [r[0] for r in df.select(R.backoff_seconds(F.col("id"))).collect()] == [1, 2, 4, 8, 16, 16]
    e = spark.createDataFrame([("BOUNDS_VIOLATION", 0), ("QUALITY_FAILURE", 0), ("BOUNDS_VIOLATION", 3)], "f string, n int")
    assert [r[0] for r in e.select(R.retry_eligibility(F.col("f"), F.col("n"))).collect()] == ["ELIGIBLE", "NOT_ELIGIBLE", "EXHAUSTED"]
