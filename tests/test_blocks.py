import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliate.operators import blocks as B
from foliate.sources import docx, files

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,font_name:string,font_size:double,color:string,highlight:string>"
SCHEMA = (
    f"template_version_id string, ord bigint, kind string, style_name string, outline_level int, has_numbering boolean, "
    f"list_level int, page_break boolean, runs array<{RUN}>, text string, "
    f"table array<array<array<struct<text:string,runs:array<{RUN}>>>>>"
)


def run(text):
    return (text, False, False, False, False, None, None, None, None)


def p(text, style="Normal", numbered=False, brk=False, outline=None, level=None):
    return ("p", style, outline, numbered, level, brk, [run(text)] if text else [], text, None)


def tbl(*rows):
    cells = [[[(t, [run(t)]) for t in cell] for cell in row] for row in rows]
    return ("tbl", None, None, False, None, False, None, None, cells)


def blocks(spark, *elements):
    rows = [("d", i, *e) for i, e in enumerate(elements)]
    return B.blocks(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()


def shape(rows):
    return [(r["block_type"], r["sequence"]) for r in rows]


def test_numbers_have_gaps_and_lists_follow_the_paragraph_that_ends_them(spark):
    got = blocks(spark, p("Intro"), p("one", "List Bullet"), p("two", "List Bullet"), p("Outro"), p("x", "List Number"))
    assert shape(got) == [("paragraph", 1), ("list", 5), ("paragraph", 4), ("list", 7)]
    assert [i["text"] for i in got[1]["items"]] == ["one", "two"]
    assert (got[1]["list_type"], got[3]["list_type"]) == ("bullet", "numbered")


def test_table_ends_a_list_after_it_is_numbered(spark):
    got = blocks(spark, p("a", numbered=True), tbl([["h"], ["i"]], [["1", " ", "2"]]), p("end"))
    assert shape(got) == [("list", 2), ("table", 3), ("paragraph", 4)]
    table = got[1]
    assert table["column_count"] == 2
    assert [r["is_header"] for r in table["rows"]] == [True, False]
    assert [c["sequence"] for c in table["rows"][1]["cells"][0]["content"]] == [0, 1]
    digest = hashlib.sha256(b"cell:100:").hexdigest()[:12]
    assert table["rows"][1]["cells"][0]["cell_id"] == f"blk_cel_0100_{digest}"


def test_blank_paragraphs_do_not_break_a_list(spark):
    got = blocks(spark, p("a", "List"), p(""), p("b", "List"))
    assert shape(got) == [("list", 3)]
    assert len(got[0]["items"]) == 2


def test_page_break_beats_heading_and_list_beats_both(spark):
    got = blocks(spark, p("h", "Heading 1", brk=True), p("x", "List Bullet", brk=True), p("Title", "Title"))
    assert shape(got) == [("page_break", 1), ("list", 4), ("heading", 3)]


@pytest.mark.parametrize("style,outline,level", [
    ("Heading 2", None, 2), ("heading3", None, 3), ("Title", None, 1), ("Subtitle", None, 2), ("subtitle", None, 1),
    ("SubTitle", None, 1), ("Heading 0", None, None), ("Body", 0, 1), ("Body", 9, None), ("Body", None, None),
])
def test_heading_level(spark, style, outline, level):
    df = spark.createDataFrame([(style, outline)], "s string, o int")
    assert df.select(B.heading_level(F.col("s"), F.col("o"))).first()[0] == level


def test_long_sequences_keep_all_digits(spark):
    got = blocks(spark, *[p(str(i)) for i in range(3)])
    assert got[0]["block_id"].startswith("blk_par_0001_")


def test_cells_and_statistics(spark):
    rows = spark.createDataFrame([("d", 0, *tbl([["a"], ["b", "c"]])), ("d", 1, *p("t"))], SCHEMA)
    b = B.blocks(rows)
    cells = [(r["row_index"], r["col_index"], r["text"]) for r in B.cells(b).orderBy("col_index").collect()]
    assert cells == [(0, 0, "a"), (0, 1, "bc")]
    s = B.statistics(b, "template_version_id").first()
    assert (s["total_blocks"], s["table_count"], s["paragraph_count"], s["list_count"]) == (2, 1, 1, 0)


def test_headers_continue_the_numbers(spark):
    el = spark.createDataFrame([("d", 0, *p("t")), ("d", 1, *p("x", "List"))], SCHEMA)
    paragraphs = spark.createDataFrame(
        [("d", 0, "footer", "default", 0, "foot", None), ("d", 0, "header", "first", 0, "head", None), ("d", 0, "header", "default", 0, "  ", None)],
        f"template_version_id string, section_no int, part string, variant string, ord int, text string, runs array<{RUN}>",
    )
    got = B.headers_footers(paragraphs, B.last_number(el)).orderBy("sequence").collect()
    assert [(r["block_type"], r["header_footer_type"], r["sequence"]) for r in got] == [("header", "first", 4), ("footer", "default", 5)]


def test_suggestions_last_write_wins(spark):
    b = spark.createDataFrame(
        [("d", "b1", "paragraph", None), ("d", "b2", "heading", 3), ("d", "b3", "list", None)],
        "template_version_id string, block_id string, block_type string, level int",
    )
    reply = """```json
    [{"block_id": "b1", "suggestion_type": "promote_to_heading", "confidence": 0.9, "new_level": 4},
     {"block_id": "b1", "suggestion_type": "promote_to_heading", "confidence": 0.95},
     {"block_id": "b2", "suggestion_type": "adjust_level", "confidence": 0.9, "new_level": 5},
     {"block_id": "b2", "suggestion_type": "adjust_level", "confidence": 0.2, "new_level": 6},
     {"block_id": "b3", "suggestion_type": "merge_list", "confidence": 0.99},
     {"block_id": "b2", "suggestion_type": "adjust_level", "confidence": 0.9, "new_level": 12},
     {"block_id": "zz", "suggestion_type": "adjust_level", "confidence": 0.9, "new_level": 2}]
    ```"""
    texts = spark.createDataFrame([("d", reply), ("e", "no json")], "template_version_id string, content string")
    s = B.valid_suggestions(B.parse_suggestions(texts), b)
    assert s.count() == 5
    got = {r["block_id"]: (r["block_type"], r["level"]) for r in B.apply_suggestions(b, s).collect()}
    assert got == {"b1": ("heading", 2), "b2": ("heading", 5), "b3": ("list", None)}
    n = B.suggestion_counts(b, s).first()
    assert (n["applied_count"], n["skipped_count"]) == (3, 2)


def test_outline_names_only_fifty_blocks(spark):
    rows = [("d", f"b{i}", "paragraph", None, i, f"text {i}") for i in range(53)]
    b = spark.createDataFrame(rows, "template_version_id string, block_id string, block_type string, level int, position int, text string")
    lines = B.outline(b).first()["outline"].split("\n")
    assert lines[0] == "Document has 53 blocks:" and lines[-1] == "  ... and 3 more blocks"
    assert len(lines) == 7 + 50 + 1


# --- files ------------------------------------------------------------------------------------
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def make_docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><w:body>{body}</w:body></w:document>')
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


BODY = (
    '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Report</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:jc w:val="center"/><w:ind w:left="720"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="24"/></w:rPr><w:t>Bold</w:t></w:r><w:r><w:t> text</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    '<w:sectPr><w:headerReference w:type="default" r:id="r1"/></w:sectPr>'
)
STYLES = f'<w:styles xmlns:w="{W}"><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'


def test_word_files_end_to_end(spark):
    content = make_docx(BODY, **{
        "word/styles.xml": STYLES,
        "word/_rels/document.xml.rels": '<R><Relationship Id="r1" Target="header1.xml"/></R>',
        "word/header1.xml": f'<w:hdr xmlns:w="{W}"><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>',
        "docProps/core.xml": '<c xmlns:dc="u"><dc:title>T</dc:title><dc:creator>A</dc:creator><revision>3</revision></c>',
    })
    df = spark.createDataFrame([("good", content), ("bad", b"junk")], "key string, content binary")
    rows = docx.elements(df).cache()
    got = B.blocks(docx.body(rows)).orderBy("position").collect()
    assert shape(got) == [("heading", 1), ("paragraph", 2), ("list", 4), ("table", 5), ("page_break", 6)]
    bold = got[1]["runs"][0]
    assert (bold["bold"], bold["font_size"], got[1]["alignment"], got[1]["indent_left"]) == (True, 12.0, "center", 36.0)
    assert got[2]["items"][0]["level"] == 1
    head = B.headers_footers(docx.header_paragraphs(rows), B.last_number(docx.body(rows))).first()
    assert (head["block_type"], head["sequence"], head["content"][0]["text"]) == ("header", 7, "Head")
    props = docx.properties(rows).first()
    assert (props["title"], props["author"], props["revision"]) == ("T", "A", 3)
    err = docx.errors(rows).first()
    assert (err["template_version_id"], err["error_type"], err["recoverable"]) == ("bad", "parse_failure", False)


def test_quality_gate(spark):
    no_types, no_body = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(no_types, "w") as z:
        z.writestr("x", "y")
    with zipfile.ZipFile(no_body, "w") as z:
        z.writestr("[Content_Types].xml", "y")
    cases = {"empty": b"", "junk": b"abc", "types": no_types.getvalue(), "body": no_body.getvalue(), "fine": make_docx("")}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "key string, content binary")
    got = {r["key"]: r["error_type"] for r in files.quality_gate(df).collect()}
    assert got == {"empty": "empty_file", "junk": "invalid_format", "types": "invalid_format", "body": "missing_content", "fine": None}


def test_scan_and_artefacts(spark, tmp_path):
    folder = tmp_path / "templates" / "t1" / "2"
    folder.mkdir(parents=True)
    (folder / "source.docx").write_bytes(make_docx(BODY))
    rows = files.scan(spark, str(tmp_path))
    ids = rows.select(*[c.alias(n) for n, c in files.key_ids(F.col("path")).items()]).first()
    assert (ids["kind"], ids["owner_id"], ids["version_number"]) == ("templates", "t1", 2)
    (folder.parent / "3 +%").mkdir()
    (folder.parent / "3 +%" / "source.docx").write_bytes(b"")
    (folder.parent / "4").mkdir()
    (folder.parent / "4" / "source.docx").write_bytes(b"x" * 5000)
    gate = files.gated_scan(spark, str(tmp_path), limit=4000)
    got = {r["path"].split("/")[-2]: r["error_type"] for r in gate.collect()}
    assert got == {"2": None, "3 +%": "empty_file", "4": "file_too_large"}
    assert [r["path"].split("/")[-2] for r in files.accepted_files(spark, str(tmp_path), gate, limit=4000).collect()] == ["2"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gate_opens_only_files_of_a_fitting_size(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"abc")
    large = files.scan(spark, str(tmp_path)).filter("length > 10").select("path", "length")
    scans = [line for line in plan_of(files.gated_scan(spark, str(tmp_path), limit=10)).splitlines() if "FileScan binaryFile" in line]
    assert "content" not in plan_of(large).split("ReadSchema")[1]
    assert any("content" in s.split("ReadSchema")[1] for s in scans) and any("content" not in s.split("ReadSchema")[1] for s in scans)
    for s in scans:
        if "content" in s.split("ReadSchema")[1]:
            assert "GreaterThan(length,0)" in s and "LessThanOrEqual(length,10)" in s


def test_batches_are_idempotent(spark, tmp_path):
    schema = "template_id string, template_version_id string, block_id string"
    b = spark.createDataFrame([("t1", "v1", "b1"), ("t1", "v2", "b2")], schema)
    for form in ("parquet", "json"):
        path = str(tmp_path / form)
        for _ in range(3):
            files.write_batch(b, path, 1, form)
        files.write_batch(b.filter("block_id = 'b1'").withColumn("block_id", F.lit("b9")), path, 2, form)
        rows = files.read_batches(spark, path, schema, form)
        assert rows.count() == 3
        versions = spark.createDataFrame([("t1", "v1"), ("t1", "v2"), ("t1", "v3")], "template_id string, template_version_id string")
        got = files.parsed_of(versions, files.latest(rows, "template_id", "template_version_id")).orderBy("template_version_id").collect()
        assert [(r["block_id"], r["batch"]) for r in got] == [("b9", 2), ("b2", 1), (None, None)]
    out = files.output_rows(spark.createDataFrame([("d1", 1, "text")], "document_id string, version_number int, rendition string"))
    assert out.first()["output_path"] == "documents/d1/1/output.docx"


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"level":"ERROR","correlation_id":"c","extra":{"k":"v"}}\nnot json\n{"level":"INFO","correlation_id":"c"}\n')
    logs = files.read_logs(spark, str(tmp_path / "a.log")).cache()
    got = files.logs_by_correlation(logs).first()
    assert (got["lines"], got["errors"]) == (2, 1)
    assert logs.filter("_corrupt IS NOT NULL").count() == 1
