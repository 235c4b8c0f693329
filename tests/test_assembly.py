import hashlib

from pyspark.sql import functions as F

from foliate.operators import assemble as A
from foliate.operators import materialise as D

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,font_name:string,font_size:double,color:string,highlight:string>"
BLOCK = (
    f"doc string, block_id string, position bigint, sequence bigint, block_type string, level int, style_name string, text string, runs array<{RUN}>, "
    "list_type string, items array<struct<text:string>>, column_count int, "
    "rows array<struct<cells:array<struct<content:array<struct<runs:array<struct<text:string>>>>>>>>"
)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def blocks(spark):
    run = lambda t: [(t, True, False, False, False, None, None, None, None)]
    cell = lambda t: ([([(t,)],)],)
    rows = [
        ("d", "p0", 0, 0, "paragraph", None, None, "fixed", run("fixed"), None, None, None, None),
        ("d", "p1", 1, 1, "paragraph", None, "Body", "about {x}", run("about {x}"), None, None, None, None),
        ("d", "h2", 2, 2, "heading", 11, None, "Head", run("Head"), None, None, None, None),
        ("d", "t3", 3, 3, "table", None, None, None, None, None, None, 2, [([cell("a"), cell("b"), cell("over")],), ([cell("c")],)]),
        ("d", "l4", 4, 4, "list", None, None, None, None, "numbered", [("x",), ("y",)], None, None),
        ("d", "b5", 5, 5, "page_break", None, None, None, None, None, None, None, None),
        ("d", "t6", 6, 6, "table", None, None, None, None, None, None, 0, []),
    ]
    return spark.createDataFrame(rows, BLOCK)


def assembled(spark):
    sections = spark.createDataFrame(
        [("d", 1, "body/block/1", "DYNAMIC"), ("d", 2, "body/block/2", "DYNAMIC"), ("d", 3, "body/block/3", "DYNAMIC"), ("d", 4, "body/block/0", "STATIC")],
        "doc string, section_id int, structural_path string, section_type string",
    )
    outputs = spark.createDataFrame([("d", 1, "new text"), ("d", 2, ""), ("d", 3, "for a table")], "doc string, section_id int, generated_content string")
    return A.assemble(blocks(spark), sections, outputs, "doc")


def test_injection(spark):
    got = {r["block_id"]: r for r in assembled(spark).collect()}
    assert len(got) == 7
    p1 = got["p1"]
    assert (p1["text"], p1["was_modified"], p1["style_name"], p1["runs"][0]["bold"]) == ("new text", True, "Body", False)
    assert (p1["original_content_hash"], p1["assembled_content_hash"]) == (h("about {x}"), h("new text"))
    assert got["h2"]["is_dynamic"] and not got["h2"]["was_modified"] and got["h2"]["assembled_content_hash"] == h("Head")
    assert got["t3"]["injection_error"] == "Unsupported block type for injection: table"
    assert (got["t3"]["assembled_content_hash"], got["l4"]["assembled_content_hash"], got["b5"]["assembled_content_hash"]) == (h("table:2x2"), h("x|y"), h("b5"))
    assert got["p0"]["runs"][0]["bold"] is True
    n = A.counts(assembled(spark), "doc").first()
    assert (n["total_blocks"], n["dynamic_blocks_count"], n["static_blocks_count"], n["injected_sections_count"]) == (7, 3, 4, 1)
    report = {r["section_id"]: r["was_injected"] for r in A.injection_report(assembled(spark), "doc").collect()}
    assert report == {1: True, 3: False}


def test_hash_is_stable_and_sees_content(spark):
    one = lambda df: A.assembly_hash(df, F.lit("D"), F.lit("T"), F.lit(1), F.lit("B"), "doc").first()["assembly_hash"]
    a = assembled(spark)
    rows = sorted(a.collect(), key=lambda r: r["sequence"])
    want = hashlib.sha256("|".join(["D", "T", "1", "B", *[f"{r['block_id']}:{r['assembled_content_hash']}" for r in rows]]).encode()).hexdigest()
    assert one(a) == one(a.repartition(5)) == want
    changed = a.withColumn("assembled_content_hash", F.when(F.col("block_id") == "p0", "0").otherwise(F.col("assembled_content_hash")))
    assert one(changed) != want
    assert A.differences(a, changed, "doc").first()["different_positions"] == 1
    assert A.differences(a, a.repartition(3), "doc").count() == 0


def test_integrity_checks_fail_on_changed_input(spark):
    b, a = blocks(spark), assembled(spark)
    assert A.structure_errors(b, a, "doc").count() == 0
    assert A.changed_static_blocks(b, a, "doc").count() == 0
    codes = lambda df: {r["error_code"]: r["errors"] for r in A.structure_errors(b, df, "doc").collect()}
    assert codes(a.filter("position < 6")) == {"BLOCK_COUNT_MISMATCH": 1}
    swapped = a.withColumn("position", F.when(F.col("position") == 0, 1).when(F.col("position") == 1, 0).otherwise(F.col("position")))
    assert codes(swapped) == {"BLOCK_ORDER_MISMATCH": 2}
    renamed = a.withColumn("block_id", F.when(F.col("block_id") == "p0", "zz").otherwise(F.col("block_id")))
    assert codes(renamed) == {"ORPHANED_BLOCK": 1, "STRUCTURAL_MISMATCH": 1, "BLOCK_ORDER_MISMATCH": 1}
    touched = a.withColumn("assembled_content_hash", F.lit("0"))
    assert {r["block_id"] for r in A.changed_static_blocks(b, touched, "doc").collect()} == {"p0", "l4", "b5", "t6"}


def test_preconditions(spark):
    s = spark.createDataFrame([("d", 1, "DYNAMIC"), ("d", 2, "DYNAMIC"), ("d", 3, "STATIC")], "doc string, section_id int, section_type string")
    o = spark.createDataFrame([("d", 2, None, False)], "doc string, section_id int, generated_content string, is_validated boolean")
    got = sorted((r["section_id"], r["error_code"]) for r in A.preconditions(s, o, "doc").collect())
    assert got == [(1, "MISSING_VALIDATED_CONTENT"), (2, "INVALID_SECTION_OUTPUT"), (2, "MISSING_VALIDATED_CONTENT")]


def test_stored_assemblies(spark):
    stored = spark.createDataFrame(
        [("d", 1, "b1", "VALIDATED", True, "x"), ("d", 2, "b2", "FAILED", False, None), ("e", 1, "b3", "COMPLETED", True, "x")],
        "document_id string, version_intent int, batch_key string, status string, is_immutable boolean, assembled_structure string",
    )
    req = spark.createDataFrame([("b1", False), ("b1", True), ("b2", False), ("b9", False)], "batch_key string, force boolean")
    assert [r["batch_key"] for r in A.already_assembled(req, stored).collect()] == ["b1"]
    assert sorted((r["batch_key"], r["force"]) for r in A.accepted_requests(req, stored).collect()) == [("b1", True), ("b2", False), ("b9", False)]
    assert {r["document_id"]: r["version_intent"] for r in A.latest(stored).collect()} == {"d": 2, "e": 1}
    flags = [(r["is_complete"], r["is_failed"], r["can_be_rendered"]) for r in A.status_flags(stored).orderBy("batch_key").collect()]
    assert flags == [(True, False, True), (False, True, False), (True, False, False)]
    assert A.renderable(stored).count() == 1
    assert [r["version_intent"] for r in A.find(stored, "d").collect()] == [2, 1]
    assert [r["batch_key"] for r in A.find(stored, "d", validated=True).collect()] == ["b1"]
    assert A.find(stored, status="FAILED", batch="b2").count() == 1


def test_rendition(spark):
    heads = spark.createDataFrame([("d", "header", 8, [("top",)]), ("d", "footer", 9, [("end",)])], "doc string, block_type string, sequence bigint, content array<struct<text:string>>")
    row = D.render(assembled(spark), "doc", headers=heads).first()
    assert row["rendition"].split("\n") == ["top", "fixed", "new text", "######### Head", "a | b", "c", "1. x", "2. y", "[page break]", "end"]
    assert row["content_hash"] == hashlib.sha256(row["rendition"].encode()).hexdigest()
    assert row["file_size_bytes"] == len(row["rendition"].encode())
    s = D.statistics(assembled(spark), "doc").first()
    assert (s["paragraphs"], s["headings"], s["tables"], s["lists"], s["page_breaks"], s["total_blocks"]) == (2, 1, 1, 1, 1, 6)


def test_missing_content_against_brute_force(spark):
    want = [("d", "alpha beta"), ("d", "gamma"), ("d", "delta epsilon"), ("d", "zeta"), ("d", " "), ("e", "gamma")]
    shown = [("d", "x alpha beta y"), ("d", "gamma"), ("d", "epsilon"), ("d", "  "), ("f", "zeta")]
    schema = "doc string, text string"
    got = {tuple(r) for r in D.missing_content(spark.createDataFrame(want, schema), spark.createDataFrame(shown, schema), "doc").collect()}
    brute = {(d, t) for d, t in want if t.strip() and not any(d == e and s.strip() and (t in s.strip() or s.strip() in t) for e, s in shown)}
    assert got == brute == {("d", "zeta"), ("e", "gamma")}
    missing = D.missing_texts(spark.createDataFrame(want, schema), spark.createDataFrame(shown, schema), "doc")
    w = D.missing_warning(missing, "doc").orderBy("doc").first()
    assert (w["missing_texts"], w["samples"]) == (1, ["zeta"])


def test_missing_texts_of_random_strings(spark):
    import random

    rng = random.Random(9)
    text = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
    for _ in range(200):
        want, shown = {text() for _ in range(rng.randrange(6))}, {text() for _ in range(rng.randrange(6))}
        brute = sorted(t for t in want if not any(t in s or s in t for s in shown))
        assert D._without_a_match([*want], [*shown]) == brute


def test_missing_texts_of_a_long_document():
    import random
    import time

    rng = random.Random(1)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(34_000)]
    started = time.perf_counter()
    # 1 MB wanted against 1 MB shown; every other line was cut
    missing = D._without_a_match(lines[:17_000], [x[:40] if i % 2 else x[20:] for i, x in enumerate(lines[8_000:25_000])])
    assert missing == sorted(lines[:8_000]) and time.perf_counter() - started < 10


def test_comparison_reasons(spark):
    schema = "doc string, position int, block_type string, rendered string"
    base = [("d", 0, "paragraph", "a"), ("d", 1, "table", "t")]
    first = spark.createDataFrame(base, schema)
    cases = {
        "Content is byte-identical": base,
        "Paragraph content differs between renders": [("d", 0, "paragraph", "b"), base[1]],
        "Table at position 1 content differs": [base[0], ("d", 1, "table", "u")],
        "Table count differs: 1 vs 0": [base[0]],
    }
    for reason, rows in cases.items():
        assert D.compare(first, spark.createDataFrame(rows, schema), "doc").first()["reason"] == reason


def test_render_preconditions(spark):
    rows = [("a", False, "VALIDATED", True), ("b", True, "FAILED", True), ("c", True, "VALIDATED", False), ("d", True, "VALIDATED", True), ("e", True, "VALIDATED", True)]
    stored = spark.createDataFrame(rows, "assembled_document_id string, is_immutable boolean, status string, has_structure boolean")
    done = spark.createDataFrame([("d", True)], "assembled_document_id string, is_immutable boolean")
    got = {r["assembled_document_id"]: r["error_code"] for r in D.render_error(stored, done).collect()}
    assert got == {"a": "DOCUMENT_NOT_IMMUTABLE", "b": "DOCUMENT_NOT_VALIDATED", "c": "MISSING_ASSEMBLED_STRUCTURE", "d": "ALREADY_RENDERED", "e": None}
    assert D.render_error(stored.withColumn("force", F.lit(True)), done).filter("error_code = 'ALREADY_RENDERED'").count() == 0
    found = spark.createDataFrame([("d", 3, 3, 0)], "doc string, total_blocks int, paragraphs int, tables int")
    want = spark.createDataFrame([("d", 4, 3, 1), ("e", 1, 1, 0)], "doc string, total_blocks int, paragraphs int, tables int")
    got = {r["doc"]: (r["error_code"], r["warnings"]) for r in D.check_statistics(want, found, "doc").collect()}
    assert got == {"d": (None, ["Expected 4 blocks but found 3", "Expected 1 tables but found 0"]), "e": ("VALIDATION_FAILED", [])}
