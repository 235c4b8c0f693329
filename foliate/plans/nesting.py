"""Queries: nested lists, tables with spans, runs and layout, in pages and files that each document's id decides."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from foliate.operators import assemble as A
from foliate.operators import blocks as B
from foliate.operators import materialise as D
from foliate.plans.registry import query
from foliate.session import stored
from foliate.sources import docx, markup
from foliate.sources import tables as T

KEY = "template_version_id"


def _pages(spark, sf_dir):
    """A page per document with lists of three levels, and a table with spans; by its id in two forms."""
    n = F.col("doc_id").cast("string")
    first = F.concat(
        F.lit("<body><h2>Page "), n, F.lit("</h2><ol><li>one<ul class='x'><li>a &amp; b</li><li>c<ol><li>deep "), n,
        F.lit("</li></ol></li></ul></li><li>two</li></ol><p>end</p><UL><LI>last</UL>"),
    )
    table = F.concat(
        F.lit("<table border=1><tr><th colspan='2'>wide</th><th rowspan=2>tall "), n,
        F.lit("</th></tr><tr><td>x</td><td><b>y</b></td></tr><tr><td rowspan=\"2\" colspan=2>block</td><td></td></tr><tr><td>z</td></tr></table>"),
    )
    html = F.when(F.col("doc_id") % 2 == 0, F.concat(first, table, F.lit("<p>after</p></body>"))).otherwise(F.concat(table, F.lit("<ul><li>only "), n, F.lit("</li></ul>")))
    return T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias(KEY), html.alias("html"))


def _blocks(spark, sf_dir):
    return B.blocks(markup.elements(_pages(spark, sf_dir)))


@query(
    "nested_lists",
    """SELECT doc_id AS template_version_id, l.position, l.list_type, l.index, l.level, l.text FROM documents, LATERAL (VALUES
  (1, 'numbered', 0, 0, 'one'), (1, 'numbered', 1, 1, 'a & b'), (1, 'numbered', 2, 1, 'c'), (1, 'numbered', 3, 2, 'deep ' || doc_id), (1, 'numbered', 4, 0, 'two'),
  (3, 'bullet', 0, 0, 'last')) l(position, list_type, index, level, text) WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 1, 'bullet', 0, 0, 'only ' || doc_id FROM documents WHERE doc_id % 2 = 1""",
)
def nested_lists(spark, sf_dir):
    lists = _blocks(spark, sf_dir).filter("block_type = 'list'").select(KEY, "position", "list_type", F.explode("items").alias("i"))
    return lists.select(KEY, F.col("position").cast("int").alias("position"), "list_type", "i.index", "i.level", "i.text")


@query(
    "table_grid",
    """SELECT doc_id AS template_version_id, 3 AS column_count, r AS row_index, c AS col_index, r = 0 AS is_header,
  [['wide', 'wide', 'tall ' || doc_id], ['x', 'y', 'tall ' || doc_id], ['block', 'block', ''], ['block', 'block', 'z']][r + 1][c + 1] AS text
FROM documents, range(4) rows(r), range(3) cols(c)""",
)
def table_grid(spark, sf_dir):
    cells = B.cells(_blocks(spark, sf_dir), KEY)
    return cells.select(KEY, F.col("column_count").cast("int").alias("column_count"), "row_index", "col_index", "is_header", "text")


@query(
    "page_layout",
    """SELECT doc_id AS template_version_id, array_to_string(CASE WHEN doc_id % 2 = 0 THEN ['heading', 'list', 'paragraph', 'list', 'table', 'paragraph'] ELSE ['table', 'list'] END, ',') AS kinds
FROM documents""",
)
def page_layout(spark, sf_dir):
    """Block types of each page in order: a table or a paragraph ends a list."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "block_type")))
    return _blocks(spark, sf_dir).groupBy(KEY).agg(F.array_join(F.transform(ordered, lambda x: x["block_type"]), ",").alias("kinds"))


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _file(number: int) -> bytes:
    """Three paragraphs: runs of several looks, one of them empty; an alignment and measures by the number; a linked run."""
    align, indent = ("left", "center", "right", "both")[number % 4], (number % 3) * 360
    body = (
        f'<w:p><w:pPr><w:jc w:val="{align}"/><w:ind w:left="{indent}" w:firstLine="240"/><w:spacing w:before="0" w:after="{number % 5 * 20}"/></w:pPr>'
        f'<w:r><w:rPr><w:b/><w:sz w:val="{20 + number % 10}"/><w:color w:val="FF0000"/></w:rPr><w:t>Bold {number}</w:t></w:r><w:r><w:t></w:t></w:r>'
        '<w:r><w:rPr><w:i/><w:u w:val="single"/><w:b w:val="0"/><w:rFonts w:ascii="Serif"/></w:rPr><w:t xml:space="preserve"> and more</w:t></w:r></w:p>'
        '<w:p><w:hyperlink><w:r><w:rPr><w:strike/></w:rPr><w:t>link</w:t></w:r></w:hyperlink><w:r><w:t xml:space="preserve"> text</w:t></w:r></w:p>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


#: Files that a task holds while it makes them.
_FILES = 200


def _packed(spark, sf_dir, make):
    """A file per document, made a few at a time."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _FILES):
                keys = batch["doc_id"].iloc[at : at + _FILES]
                yield pd.DataFrame({"key": keys, "content": [make(k) for k in keys]})

    return T.table(spark, sf_dir, "documents").select("doc_id").mapInPandas(pack, "key bigint, content binary")


def _styled(spark, sf_dir):
    return B.blocks(docx.body(docx.elements(_packed(spark, sf_dir, _file))))


@query(
    "block_runs",
    """SELECT CAST(doc_id AS VARCHAR) AS template_version_id, r.position, r.run, r.text, r.bold, r.italic, r.underline, r.strike, r.font_name, r.font_size, r.color FROM documents, LATERAL (VALUES
  (0, 0, 'Bold ' || doc_id, true, false, false, false, NULL, (20 + doc_id % 10) / 2.0, 'FF0000'), (0, 1, ' and more', false, true, true, false, 'Serif', NULL, NULL),
  (1, 0, 'link', false, false, false, true, NULL, NULL, NULL), (1, 1, ' text', false, false, false, false, NULL, NULL, NULL))
  r(position, run, text, bold, italic, underline, strike, font_name, font_size, color)""",
)
def block_runs(spark, sf_dir):
    """Runs with text, with their looks; those inside links too."""
    runs = _styled(spark, sf_dir).select(KEY, F.col("position").cast("int").alias("position"), F.posexplode("runs").alias("run", "r"))
    return runs.select(KEY, "position", "run", *[f"r.{c}" for c in ("text", "bold", "italic", "underline", "strike", "font_name", "font_size", "color")])


@query(
    "block_layout",
    """SELECT CAST(doc_id AS VARCHAR) AS template_version_id, ['left', 'center', 'right', 'both'][doc_id % 4 + 1] AS alignment, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 * 18.0 END AS indent_left,
  12.0 AS indent_first_line, CAST(NULL AS DOUBLE) AS spacing_before, CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 * 1.0 END AS spacing_after FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL FROM documents""",
)
def block_layout(spark, sf_dir):
    """Alignment, indents and spacings in points; what is zero or absent is NULL."""
    return _styled(spark, sf_dir).select(KEY, "alignment", "indent_left", "indent_first_line", "spacing_before", "spacing_after")


def _headed(number: int) -> bytes:
    """Two paragraphs, a header for every page, one for the first page, and a footer for every second document."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    refs = '<w:headerReference w:type="default" r:id="r1"/><w:headerReference w:type="first" r:id="r2"/>' + ('<w:footerReference w:type="default" r:id="r3"/>' if number % 2 else "")
    parts = {
        "[Content_Types].xml": "<Types/>",
        "word/document.xml": f'<w:document xmlns:w="{_W}" xmlns:r="{rel}"><w:body>{p(f"Line {number}")}{p("End")}<w:sectPr>{refs}</w:sectPr></w:body></w:document>',
        "word/_rels/document.xml.rels": "<R>" + "".join(f'<Relationship Id="r{i}" Target="part{i}.xml"/>' for i in (1, 2, 3)) + "</R>",
        "word/part1.xml": f'<w:hdr xmlns:w="{_W}">{p(f"Head {number}")}{p(" ")}</w:hdr>',
        "word/part2.xml": f'<w:hdr xmlns:w="{_W}">{p("First page")}{p("of all")}</w:hdr>',
        "word/part3.xml": f'<w:ftr xmlns:w="{_W}">{p("Foot")}</w:ftr>',
        "docProps/core.xml": f'<c xmlns:dc="u"><dc:title>Title {number}</dc:title><dc:creator>A</dc:creator><keywords>k</keywords><revision>{number % 7 or "x"}</revision>'
        "<created>2024-01-02T03:04:05Z</created></c>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _headed_elements(spark, sf_dir):
    return stored(docx.elements(_packed(spark, sf_dir, _headed)), "headed")


@query(
    "headed_renditions",
    """SELECT CAST(doc_id AS VARCHAR) AS template_version_id, array_to_string(['Head ' || doc_id, 'First page', 'of all', 'Line ' || doc_id, 'End'] ||
  CASE WHEN doc_id % 2 = 1 THEN ['Foot'] ELSE [] END, chr(10)) AS rendition FROM documents""",
)
def headed_renditions(spark, sf_dir):
    """Renditions with headers before and footers behind the body."""
    rows = _headed_elements(spark, sf_dir)
    heads = B.headers_footers(docx.header_paragraphs(rows), B.last_number(docx.body(rows)))
    return D.render(B.blocks(docx.body(rows)), KEY, headers=heads).select(KEY, "rendition")


@query(
    "file_properties",
    """SELECT CAST(doc_id AS VARCHAR) AS template_version_id, 'Title ' || doc_id AS title, 'A' AS author, CAST(NULL AS VARCHAR) AS subject, 'k' AS keywords,
  TIMESTAMP '2024-01-02 03:04:05' AS created, CAST(NULL AS TIMESTAMP) AS modified, CASE WHEN doc_id % 7 > 0 THEN doc_id % 7 END AS revision FROM documents""",
)
def file_properties(spark, sf_dir):
    """The seven properties of files; a revision that is no number is NULL."""
    found = docx.properties(_headed_elements(spark, sf_dir))
    return found.withColumns({c: F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz") for c in ("created", "modified")})


@query(
    "rendition_lookups",
    """WITH r AS (SELECT source AS document_id, doc_id AS version_number, CASE doc_id % 3 WHEN 0 THEN 'FAILED' ELSE 'VALIDATED' END AS status, doc_id % 2 = 0 AS is_immutable, sha256(text) AS h FROM documents)
SELECT 'document' AS lookup, document_id, version_number FROM r WHERE document_id = 'src3' UNION ALL
SELECT 'validated', document_id, version_number FROM r WHERE document_id = 'src3' AND status = 'VALIDATED' AND is_immutable UNION ALL
SELECT 'failed', document_id, version_number FROM r WHERE status = 'FAILED' UNION ALL
SELECT 'hash', document_id, version_number FROM r WHERE h = sha256('') UNION ALL
SELECT 'latest', document_id, max(version_number) FROM r GROUP BY document_id UNION ALL
SELECT 'count', document_id, count(*) FROM r GROUP BY document_id""",
)
def rendition_lookups(spark, sf_dir):
    """Stored renditions by document, state and hash; the newest and the number of each document."""
    n = F.col("doc_id")
    r = T.table(spark, sf_dir, "documents").select(
        F.col("source").alias("document_id"), n.alias("version_number"), F.when(n % 3 == 0, "FAILED").otherwise("VALIDATED").alias("status"),
        (n % 2 == 0).alias("is_immutable"), F.sha2("text", 256).alias("content_hash"),
    )
    columns = {"version_column": "version_number", "hash_column": "content_hash"}
    found = {
        "document": A.find(r, "src3", **columns), "validated": A.find(r, "src3", validated=True, **columns), "failed": A.find(r, status="FAILED", **columns),
        "hash": A.find(r, content_hash=hashlib.sha256(b"").hexdigest(), **columns), "latest": A.latest(r, "version_number"),
        "count": A.stored_counts(r).withColumnRenamed("assemblies", "version_number"),
    }
    out = None
    for name, rows in found.items():
        rows = rows.select(F.lit(name).alias("lookup"), "document_id", "version_number")
        out = rows if out is None else out.unionByName(rows)
    return out


_MIXED = """mixed AS (
  SELECT doc_id AS template_version_id, b.position, b.block_type, b.hashed FROM documents, LATERAL (VALUES (0, 'heading', 'Page ' || doc_id), (1, 'list', 'one|a & b|c|deep ' || doc_id || '|two'),
    (2, 'paragraph', 'end'), (3, 'list', 'last'), (4, 'table', 'table:4x3'), (5, 'paragraph', 'after')) b(position, block_type, hashed) WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, b.position, b.block_type, b.hashed FROM documents, LATERAL (VALUES (0, 'table', 'table:4x3'), (1, 'list', 'only ' || doc_id)) b(position, block_type, hashed) WHERE doc_id % 2 = 1)"""


def _dynamic(spark, sf_dir):
    """The blocks of the pages, every one of a dynamic section; the third has no output."""
    blocks = _blocks(spark, sf_dir).withColumns({"section_id": F.col("position") + 1, "section_type": F.lit("DYNAMIC")})
    content = F.concat(F.lit("new "), F.col("section_id").cast("string"))
    outputs = blocks.filter("section_id <> 3").select(KEY, "section_id", content.alias("generated_content"), F.lit(True).alias("is_validated"))
    return blocks, outputs


@query(
    "assembly_mixed",
    "WITH " + _MIXED
    + """ SELECT template_version_id, position, block_type, block_type IN ('heading', 'paragraph') AND position <> 2 AS was_injected,
  CASE WHEN block_type IN ('list', 'table') THEN 'Unsupported block type for injection: ' || block_type END AS injection_error, left(sha256(hashed), 16) AS original_content_hash,
  left(sha256(CASE WHEN block_type IN ('heading', 'paragraph') AND position <> 2 THEN 'new ' || (position + 1) ELSE hashed END), 16) AS assembled_content_hash FROM mixed""",
)
def assembly_mixed(spark, sf_dir):
    """Headings take text; lists and tables keep theirs, with a message, and are hashed by items and size."""
    blocks, outputs = _dynamic(spark, sf_dir)
    rows = A.assemble(blocks, None, outputs, KEY)
    return rows.select(
        KEY, F.col("position").cast("int").alias("position"), "block_type", "was_injected", "injection_error", "original_content_hash", "assembled_content_hash"
    )


@query("assembly_without_outputs", "WITH " + _MIXED + " SELECT template_version_id, position + 1 AS section_id, 'MISSING_VALIDATED_CONTENT' AS error_code FROM mixed WHERE position = 2")
def assembly_without_outputs(spark, sf_dir):
    """Dynamic sections that have no output row."""
    blocks, outputs = _dynamic(spark, sf_dir)
    rows = A.preconditions(blocks.select(KEY, "section_id", "section_type"), outputs, KEY)
    return rows.select(KEY, F.col("section_id").cast("int").alias("section_id"), "error_code")
