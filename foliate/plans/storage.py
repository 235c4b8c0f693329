"""Queries: files in storage, their gate, and what is written back, with faults planted on the way."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import blocks as B
from foliate.operators import classify as C
from foliate.plans import ddl
from foliate.plans.registry import query
from foliate.session import scratch_dir, stored
from foliate.sources import docx, files
from foliate.sources import tables as T

_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: Largest file of these queries.
LIMIT = 256 << 10


def _archive(parts: dict[str, str], plain: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if plain else zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _body(text: str, odd: int | None = None) -> str:
    """One paragraph per line; that at ``odd`` has a level that no number can be read from."""
    level = '<w:pPr><w:outlineLvl w:val="²"/></w:pPr>'
    lines = "".join(
        f'<w:p>{level if i == odd else ""}<w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for i, line in enumerate(text.split("\n"))
    )
    return f'<w:document xmlns:w="{_WORD}"><w:body>{lines}</w:body></w:document>'


def _file(number: int, text: str) -> bytes:
    """A document as a file; by its number some are faulty, each in one of six ways."""
    types, body = {"[Content_Types].xml": "<Types/>"}, {"word/document.xml": _body(text)}
    kind = number % 50
    if kind == 7:
        return b""
    if kind == 8:
        return b"no archive " + text.encode()
    if kind == 9:
        return _archive(types | body | {"media": "x" * LIMIT}, plain=True)
    if kind == 10:
        return _archive(body)
    if kind == 11:
        return _archive(types)
    if kind == 12:
        return _archive({**types, "word/document.xml": "<w>" + "y" * 99}, plain=True).replace(b"y" * 99, b"z" * 99)
    return _archive(types | body)


def _local(folder: str) -> str:
    """The shared folder as executors see it; other stores have no call for single files in a task."""
    path = folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{folder} is not mounted on the executors")
    return path


def written_corpus(spark, sf_dir) -> str:
    """Every document as a file ``templates/<source>/<doc_id>/source.docx`` below the shared folder; a repeated task writes the same."""
    folder = scratch_dir(spark, "corpus")
    root = _local(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, number, text in zip(batch["key"], batch["doc_id"], batch["text"]):
                path = os.path.join(root, key)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(_file(number, text))
            yield batch[["doc_id"]]

    rows = T.documents(spark, sf_dir).filter("text IS NOT NULL AND source IS NOT NULL")
    key = files.source_key(F.col("source"), F.col("doc_id")).alias("key")
    rows.select(key, "doc_id", "text").mapInPandas(write, "doc_id bigint").write.format("noop").mode("overwrite").save()
    return folder


_FAULTS = """CASE doc_id % 50 WHEN 7 THEN 'empty_file' WHEN 8 THEN 'invalid_format' WHEN 9 THEN 'file_too_large' WHEN 10 THEN 'invalid_format'
  WHEN 11 THEN 'missing_content' WHEN 12 THEN 'corrupted_file' END"""


def _keys(rows: DataFrame) -> DataFrame:
    ids = files.key_ids(F.col("path"))
    return rows.withColumns({"owner_id": ids["owner_id"], "version_number": ids["version_number"]})


@query("corpus_gate", f"SELECT source AS owner_id, CAST(doc_id AS INT) AS version_number, {_FAULTS} AS error_type FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def corpus_gate(spark, sf_dir):
    """Files in storage: sizes judged from the listing, the rest from the archive."""
    folder = written_corpus(spark, sf_dir)
    gate = files.gated_scan(spark, folder, limit=LIMIT, listed=files.listing(spark, folder))
    return _keys(gate).select("owner_id", "version_number", "error_type")


@query(
    "corpus_blocks",
    ddl.with_(ddl.BLOCKS)
    + """SELECT template_id AS owner_id, CAST(template_version_id AS INT) AS version_number, block_id, text FROM blocks
WHERE template_version_id % 50 NOT IN (7, 8, 9, 10, 11, 12)""",
)
def corpus_blocks(spark, sf_dir):
    """Files that pass the gate, read and parsed: the blocks of the texts they were made from."""
    folder = written_corpus(spark, sf_dir)
    gate = stored(files.gated_scan(spark, folder, limit=LIMIT, listed=files.listing(spark, folder)), "gate")
    good = files.accepted_files(spark, folder, gate, limit=LIMIT)
    rows = docx.body(docx.elements(good.select(F.col("path").alias("key"), "content")))
    kept = rows.filter((F.regexp_count("text", F.lit(r"\S")) > 0) | F.col("table").isNotNull())
    blocks = B.blocks(kept).withColumnRenamed("template_version_id", "path")
    return _keys(blocks).select("owner_id", "version_number", "block_id", "text")


@query(
    "parsed_store",
    ddl.with_(ddl.BLOCKS)
    + """SELECT CAST(template_version_id AS VARCHAR) AS template_version_id, CASE WHEN template_version_id % 3 = 0 THEN 2 ELSE 1 END AS batch, count(*) AS blocks,
  string_agg(CASE WHEN template_version_id % 3 = 0 THEN sequence * 2 ELSE sequence END, ',' ORDER BY sequence) AS numbers FROM blocks GROUP BY template_version_id
UNION ALL SELECT NULL, 3, count(*), NULL FROM labels""",
)
def parsed_store(spark, sf_dir):
    """Parsed blocks as JSON: a batch written twice, a later one for some versions, and lines that are no JSON."""
    folder = scratch_dir(spark, "parsed")
    blocks = T.text_blocks(spark, sf_dir).select("template_id", F.col("template_version_id").cast("string").alias("template_version_id"), "block_id", "sequence")
    for _ in range(2):
        files.write_batch(blocks, folder, 1, "json")
    again = blocks.filter(F.col("template_version_id").cast("bigint") % 3 == 0).withColumn("sequence", F.col("sequence") * 2)
    files.write_batch(again, folder, 2, "json")
    T.table(spark, sf_dir, "labels").select(F.format_string('{"template_id": "%d", broken', "doc_id")).write.text(f"{folder}/batch=3")
    # stored, as rows of broken lines cannot be read by themselves from text
    rows = stored(files.read_batches(spark, folder, "template_id string, template_version_id string, block_id string, sequence bigint", "json"), "parsed-rows")
    numbers = F.array_join(F.sort_array(F.collect_list("sequence")), ",")
    good = files.latest(rows, "template_id", "template_version_id").groupBy("template_version_id", "batch").agg(F.count(F.lit(1)).alias("blocks"), numbers.alias("numbers"))
    bad = files.broken(rows).groupBy("batch").agg(F.count(F.lit(1)).alias("blocks"))
    return good.unionByName(bad, allowMissingColumns=True)


@query(
    "output_store",
    """SELECT doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS version_number,
  'documents/' || doc_id || '/' || CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END || '/output.docx' AS output_path, text AS rendition FROM documents""",
)
def output_store(spark, sf_dir):
    """Renditions: a batch written twice, then new versions of some."""
    folder = scratch_dir(spark, "outputs")
    docs = T.documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version_number"), F.col("text").alias("rendition"))
    for _ in range(2):
        files.write_batch(files.output_rows(docs), folder, 1)
    files.write_batch(files.output_rows(docs.filter("document_id % 5 = 0").withColumn("version_number", F.lit(2))), folder, 2)
    rows = files.read_batches(spark, folder, "document_id bigint, version_number int, rendition string, output_path string, bucket int")
    return files.latest(rows, "document_id").select("document_id", "version_number", "output_path", "rendition")


@query(
    "parse_errors",
    f"""WITH l AS (SELECT doc_id, doc_id % 20 AS m, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
good AS (SELECT doc_id, any_value(m) AS m, count(*) AS n_lines, count(*) FILTER (NOT (m = 4 AND i = 1) AND {ddl.strip('line')} <> '') AS blocks FROM l GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS template_version_id, CASE WHEN m = 3 THEN 0 ELSE blocks END AS blocks,
  CASE WHEN m = 3 THEN 'parse_failure' WHEN m = 4 AND n_lines > 1 THEN 'element_parse_error' END AS error_type,
  CASE WHEN m = 4 AND n_lines > 1 THEN 1 END AS block_index, CASE WHEN m = 3 THEN false WHEN m = 4 AND n_lines > 1 THEN true END AS recoverable FROM good""",
)
def parse_errors(spark, sf_dir):
    """One pass over files with planted faults, stored once: good blocks from it, and errors beside them."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content = []
            for k, text in zip(batch["doc_id"], batch["text"]):
                body = _body(text, 1 if k % 20 == 4 else None)
                content.append(_archive({"[Content_Types].xml": "<Types/>", "word/document.xml": body[:-9] if k % 20 == 3 else body}))
            yield pd.DataFrame({"key": batch["doc_id"], "content": content})

    packed = T.documents(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", "text").mapInPandas(pack, "key bigint, content binary")
    rows = stored(docx.elements(packed), "elements")
    fine = (F.col("part") == "body") & (F.regexp_count("text", F.lit(r"\S")) > 0)
    counts = rows.groupBy("template_version_id").agg(F.count_if(fine).alias("blocks"))
    faults = docx.errors(rows).select("template_version_id", "error_type", "block_index", "recoverable")
    return counts.join(faults, "template_version_id", "left")


@query(
    "classify_isolated",
    ddl.with_(ddl.BLOCKS, ddl.classified(0.85))
    + """, judged AS (SELECT *, CASE WHEN sequence % 7 = 3 THEN 'block has no type' WHEN sequence % 11 = 5 THEN 'text is not valid UTF-8' END AS fault FROM classified)
SELECT template_version_id, block_id, CASE WHEN fault IS NULL THEN section_type ELSE 'STATIC' END AS section_type, CASE WHEN fault IS NULL THEN confidence ELSE 0.5 END AS confidence,
  CASE WHEN fault IS NULL THEN method ELSE 'fallback' END AS method, 'Failed to classify block ' || block_id || ': ' || fault AS error FROM judged""",
)
def classify_isolated(spark, sf_dir):
    """Blocks without a type and texts that are no text: each falls back by itself, with a message."""
    n = F.col("sequence")
    blocks = T.text_blocks(spark, sf_dir).withColumns({
        "block_type": F.when(n % 7 != 3, F.col("block_type")),
        "text": F.when(n % 11 == 5, F.concat(F.col("text").cast("binary"), F.lit(bytearray(b"\xff"))).cast("string")).otherwise(F.col("text")),
    })
    fault = C.block_fault(F.col("block_type"), F.col("text"))
    # what is not text goes no further than the fault
    judged = blocks.withColumn("_fault", fault).withColumn("text", F.when(F.col("_fault").isNull(), F.col("text")))
    return C.isolated(C.classify(judged), F.col("_fault")).select("template_version_id", "block_id", "section_type", "confidence", "method", "error")


@query(
    "sections_of_labelled",
    ddl.with_(ddl.SECTIONS) + "SELECT template_version_id, section_id AS section_no, structural_path, section_type FROM sections WHERE template_version_id IN (SELECT doc_id FROM labels)",
)
def sections_of_labelled(spark, sf_dir):
    """Sections of all versions in a table of keys."""
    sections = C.sections(C.classify(T.text_blocks(spark, sf_dir), ddl.SECTION_THRESHOLD))
    wanted = T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("template_version_id"))
    return C.sections_of(sections, wanted).select("template_version_id", "section_no", "structural_path", "section_type")
