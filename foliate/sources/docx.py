"""Raw elements of word-processor files.

Only unpacking happens in Python, one file at a time inside ``mapInArrow``; numbering, typing, list
grouping and ids are Spark work on the element table (see ``operators.blocks``).
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,font_name:string,font_size:double,color:string,highlight:string>"
_PARAGRAPH = (
    f"text:string,runs:array<{_RUN}>,style_name:string,outline_level:int,has_numbering:boolean,list_level:int,"
    "page_break:boolean,alignment:string,indent_left:double,indent_right:double,indent_first_line:double,"
    "spacing_before:double,spacing_after:double"
)
PAYLOAD = f"struct<{_PARAGRAPH},table:array<array<array<struct<text:string,runs:array<{_RUN}>>>>>,properties:map<string,string>,error:string>"
RAW = "key string, part string, section_no int, variant string, ord bigint, kind string, payload string"
_RAW = pa.schema([
    ("key", pa.string()), ("part", pa.string()), ("section_no", pa.int32()), ("variant", pa.string()),
    ("ord", pa.int64()), ("kind", pa.string()), ("payload", pa.string()),
])
#: Characters of payloads that a task holds.
HELD = 1 << 20


def _on(node, name: str) -> bool:
    child = None if node is None else node.find(W + name)
    return child is not None and child.get(W + "val", "true") not in ("0", "false", "none", "off")


def _val(node, path: str, attr: str = "val"):
    child = None if node is None else node.find("/".join(W + p for p in path.split("/")))
    return None if child is None else child.get(W + attr)


def _points(value, per_point: int) -> float | None:
    return float(value) / per_point if value and value.lstrip("-").isdigit() and int(value) else None


def _text(run) -> str:
    marks = {"t": None, "tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
    out = []
    for child in run:
        name = child.tag.replace(W, "")
        if name == "br" and child.get(W + "type", "textWrapping") != "textWrapping":
            continue
        if name in marks:
            out.append(child.text or "" if marks[name] is None else marks[name])
    return "".join(out)


def _runs(p):
    """Runs of a paragraph in order, those inside hyperlinks included."""
    for node in p:
        if node.tag == W + "r":
            yield node
        elif node.tag == W + "hyperlink":
            yield from node.findall(W + "r")


def _cells(row):
    """Cells of a table row by grid column: a cell that spans several counts for each."""
    for cell in row.findall(W + "tc"):
        span = _val(cell.find(W + "tcPr"), "gridSpan")
        yield from [cell] * (int(span) if span and span.isdigit() else 1)


def _paragraph(p, styles: dict) -> dict:
    props, runs, broken = p.find(W + "pPr"), [], False
    for run in _runs(p):
        broken |= any(b.get(W + "type") == "page" for b in run.findall(W + "br"))
        look = run.find(W + "rPr")
        size = _val(look, "sz")
        runs.append({
            "text": _text(run),
            "bold": _on(look, "b"), "italic": _on(look, "i"), "underline": _on(look, "u"), "strike": _on(look, "strike"),
            "font_name": _val(look, "rFonts", "ascii"),
            "font_size": _points(size, 2),
            "color": _val(look, "color") if _val(look, "color") != "auto" else None,
        })
    style, outline = styles.get(_val(props, "pStyle"), styles.get(None, ("Normal", None)))
    level = _val(props, "numPr/ilvl")
    own = _val(props, "outlineLvl")
    return {
        "text": "".join(r["text"] for r in runs),
        "runs": runs,
        "style_name": style,
        "outline_level": int(own) if own and own.isdigit() else outline,
        "has_numbering": props is not None and props.find(W + "numPr") is not None,
        "list_level": int(level) if level and level.isdigit() else 0,
        "page_break": broken,
        "alignment": _val(props, "jc"),
        "indent_left": _points(_val(props, "ind", "left"), 20),
        "indent_right": _points(_val(props, "ind", "right"), 20),
        "indent_first_line": _points(_val(props, "ind", "firstLine"), 20),
        "spacing_before": _points(_val(props, "spacing", "before"), 20),
        "spacing_after": _points(_val(props, "spacing", "after"), 20),
    }


def _styles(archive: zipfile.ZipFile) -> dict:
    """Style id → (name, outline level); None → default paragraph style."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    out: dict = {}
    for style in ET.fromstring(archive.read("word/styles.xml")).findall(W + "style"):
        level = _val(style, "pPr/outlineLvl")
        name = _val(style, "name") or style.get(W + "styleId")
        entry = (name[:1].upper() + name[1:], int(level) if level and level.isdigit() else None)
        out[style.get(W + "styleId")] = entry
        if style.get(W + "default") == "1" and style.get(W + "type") == "paragraph":
            out[None] = entry
    return out


def _elements(content: bytes) -> Iterator[tuple]:
    """(part, section_no, variant, ord, kind, payload) of one file."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    styles = _styles(archive)
    root = ET.fromstring(archive.read("word/document.xml"))
    body = root.find(W + "body")
    for ord_, node in enumerate(body):
        try:
            if node.tag == W + "p":
                yield "body", 0, None, ord_, "p", _paragraph(node, styles)
            elif node.tag == W + "tbl":
                table = [
                    [[_paragraph(p, styles) for p in cell.findall(W + "p")] for cell in _cells(row)]
                    for row in node.findall(W + "tr")
                ]
                slim = [[[{"text": p["text"], "runs": p["runs"]} for p in cell] for cell in row] for row in table]
                yield "body", 0, None, ord_, "tbl", {"table": slim}
        except Exception as e:  # the rest of the file is still read
            yield "error", 0, None, ord_, "element_parse_error", {"error": str(e)}
    links = {}
    if "word/_rels/document.xml.rels" in archive.namelist():
        for rel in ET.fromstring(archive.read("word/_rels/document.xml.rels")):
            links[rel.get("Id")] = "word/" + rel.get("Target", "").lstrip("/")
    # A section without a header or footer of its own has that of the section before.
    shown: dict[tuple[str, str], str | None] = {}
    for number, section in enumerate(body.iter(W + "sectPr")):
        for kind in ("header", "footer"):
            for ref in section.findall(f"{W}{kind}Reference"):
                shown[kind, ref.get(W + "type", "default")] = links.get(ref.get(R + "id"))
        for (kind, name), target in shown.items():
            if target in archive.namelist():
                for i, p in enumerate(ET.fromstring(archive.read(target)).findall(W + "p")):
                    yield kind, number, name, i, "p", _paragraph(p, styles)
    if "docProps/core.xml" in archive.namelist():
        names = {"title", "creator", "subject", "keywords", "created", "modified", "revision"}
        found = {n.tag.split("}")[-1]: n.text or "" for n in ET.fromstring(archive.read("docProps/core.xml"))}
        yield "properties", 0, None, 0, "properties", {"properties": {k: v for k, v in found.items() if k in names}}


def elements(files: DataFrame, key: str = "key") -> DataFrame:
    """Elements of every file ``(key, content)``; a file that cannot be read gives one error row."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            # Contents stay in their batch; one at a time is taken out, and what comes of the files leaves in small batches.
            for i in range(batch.num_rows):
                name, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    out = [(name, *row[:5], json.dumps(row[5])) for row in _elements(bytes(content))]
                except Exception as e:
                    out = [(name, "error", 0, None, -1, "parse_failure", json.dumps({"error": str(e)}))]
                for row in out:
                    rows.append(row)
                    held += len(row[6])
                    if held > HELD:
                        yield pa.RecordBatch.from_pylist([dict(zip(_RAW.names, r)) for r in rows], _RAW)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist([dict(zip(_RAW.names, r)) for r in rows], _RAW)

    raw = files.select(F.col(key).cast("string").alias("key"), "content").mapInArrow(unpack, RAW)
    return raw.withColumn("payload", F.from_json("payload", PAYLOAD)).select("*", "payload.*").drop("payload").withColumnRenamed(
        "key", "template_version_id"
    )


def body(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("part") == "body")


def header_paragraphs(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("part").isin("header", "footer")).select(
        "template_version_id", "section_no", "part", "variant", "ord", "text", "runs"
    )


def errors(rows: DataFrame) -> DataFrame:
    """Element errors (recoverable) and whole-file failures."""
    return rows.filter(F.col("part") == "error").select(
        "template_version_id",
        F.col("kind").alias("error_type"),
        F.col("error").alias("message"),
        F.when(F.col("ord") >= 0, F.col("ord")).alias("block_index"),
        (F.col("kind") != "parse_failure").alias("recoverable"),
    )


def properties(rows: DataFrame) -> DataFrame:
    """Core properties as columns."""
    p = F.col("properties")
    return rows.filter(F.col("part") == "properties").select(
        "template_version_id",
        p["title"].alias("title"), p["creator"].alias("author"), p["subject"].alias("subject"), p["keywords"].alias("keywords"),
        p["created"].try_cast("timestamp").alias("created"), p["modified"].try_cast("timestamp").alias("modified"),
        p["revision"].try_cast("int").alias("revision"),
    )
