"""Queries: every rule, code and pattern at least once, in texts that each document's id decides.

The documents rarely hold forbidden markup, placeholders or boilerplate. Here each row of the table gets a text of its
own, with one marker out of a cycle; the SQL states the expected outcome by position in the cycle and knows no pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.operators import audit as U
from foliate.operators import classify as C
from foliate.operators import validate as V
from foliate.plans.registry import query
from foliate.sources import tables as T
from foliate.streaming import events as S

_PLAIN = "'Entry ' || doc_id || ' with ' || n_chars || ' letters was read again'"


def _cycle(spark, sf_dir, texts: list[Column], name: str, rows=None):
    """Documents (or the given rows of them) with ``_m``, their place in the cycle, and its text."""
    rows = T.table(spark, sf_dir, "documents") if rows is None else rows
    rows = rows.withColumn("_m", F.pmod("doc_id", F.lit(len(texts))).cast("int"))
    chosen = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        chosen = F.when(F.col("_m") == i, t).otherwise(chosen)
    return rows.select("doc_id", "_m", chosen.alias(name))


def _plain() -> Column:
    return F.expr(_PLAIN)


def _with(before: str = "", after: str = "") -> Column:
    return F.concat(F.lit(before), _plain(), F.lit(after))


_CONTENTS = [
    _with,
    lambda: _with(after=" <b>x</b>"),
    lambda: _with("## Title\n"),
    lambda: _with(after=" **bold**"),
    lambda: _with(after=" [name](target)"),
    lambda: _with(after=" `code`"),
    lambda: _with(after="\n---"),
    lambda: _with(after="\n| a | b |"),
    lambda: _with("1. "),
    lambda: F.lit("again " * 20),
    lambda: _with("lorem ipsum "),
    lambda: F.lit(""),
    lambda: F.lit("short"),
    lambda: _with(after=" more words of the entry" * 30),
    lambda: F.lit(None).cast("string"),
    lambda: _with(after=" [CLIENT-7]"),
]
_EXPECTED = """expected AS (
  SELECT doc_id, ['', 'CONTAINS_TAGS', 'CONTAINS_HEADERS', 'CONTAINS_FORMATTING', 'CONTAINS_MARKUP', 'CONTAINS_MARKUP',
      'STRUCTURAL_MODIFICATION', 'STRUCTURAL_MODIFICATION', 'CONTAINS_HEADERS', 'NEAR_EMPTY_CONTENT,REPETITIVE_CONTENT',
      'BOILERPLATE_ONLY', 'EMPTY_CONTENT', 'NEAR_EMPTY_CONTENT,CONTENT_TOO_SHORT', 'CONTENT_TOO_LONG', 'EMPTY_CONTENT',
      'STRUCTURAL_MODIFICATION'][doc_id % 16 + 1] AS error_codes,
    CASE WHEN doc_id % 16 = 0 THEN NULL WHEN doc_id % 16 IN (9, 10) THEN 'QUALITY_FAILURE'
      WHEN doc_id % 16 IN (11, 12, 13, 14) THEN 'BOUNDS_VIOLATION' ELSE 'STRUCTURAL_VIOLATION' END AS failure_type
  FROM documents)
"""


def _judged(spark, sf_dir):
    """With limits of 20 and 500 characters and one pattern of the caller's own."""
    rows = _cycle(spark, sf_dir, [make() for make in _CONTENTS], "content")
    return V.verdict(rows, min_length=20, max_length=500, custom=(r"\[client-\d+\]",))


@query("verdict_codes", "WITH " + _EXPECTED + "SELECT doc_id, error_codes, failure_type, error_codes = '' AS is_valid FROM expected")
def verdict_codes(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", F.array_join("error_codes", ",").alias("error_codes"), "failure_type", "is_valid")


@query(
    "switched_checks",
    "SELECT doc_id, CASE doc_id % 16 WHEN 1 THEN 'CONTAINS_TAGS' WHEN 15 THEN 'STRUCTURAL_MODIFICATION' ELSE '' END AS codes FROM documents",
)
def switched_checks(spark, sf_dir):
    """Only tags are looked for, and the caller's own pattern."""
    rows = _cycle(spark, sf_dir, [make() for make in _CONTENTS], "content")
    judged = V.structural(rows, checks=("html_tags",), custom=(r"\[client-\d+\]",), findings=False)
    return judged.select("doc_id", F.array_join("structural_codes", ",").alias("codes"))


@query(
    "failure_classes",
    "WITH " + _EXPECTED + """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'UNEXPECTED_ERROR' WHEN doc_id % 11 = 0 THEN 'GENERATION_FAILURE'
  ELSE coalesce(failure_type, 'VALIDATION_FAILURE') END AS failure_class FROM expected""",
)
def failure_classes(spark, sf_dir):
    kind = V.failure_classification(F.col("doc_id") % 11 == 0, F.col("doc_id") % 13 == 0, F.col("failure_type"))
    return _judged(spark, sf_dir).select("doc_id", kind.alias("failure_class"))


@query(
    "verdict_metadata",
    "WITH " + _EXPECTED + """SELECT doc_id, 'h' || doc_id AS input_hash, 'body/block/' || doc_id AS structural_path, doc_id % 4 AS attempt_number, error_codes = '' AS is_valid,
  coalesce(failure_type, '') <> 'STRUCTURAL_VIOLATION' AS structural_valid, doc_id % 16 NOT IN (11, 12, 13, 14) AS bounds_valid FROM expected""",
)
def verdict_metadata(spark, sf_dir):
    """What is stored beside a judged output."""
    doc = F.col("doc_id").cast("string")
    meta = V.validation_metadata(F.concat(F.lit("h"), doc), F.concat(F.lit("body/block/"), doc), F.col("doc_id") % 4)
    return _judged(spark, sf_dir).select("doc_id", meta.alias("m")).select(
        "doc_id", "m.input_hash", "m.structural_path", "m.attempt_number",
        *[F.col("m.validation")[c].alias(c) for c in ("is_valid", "structural_valid", "bounds_valid")],
    )


@query("boilerplate_rules", "SELECT doc_id, CASE WHEN doc_id % 8 < 7 THEN CAST(doc_id % 8 + 1 AS VARCHAR) ELSE '' END AS rules FROM documents")
def boilerplate_rules(spark, sf_dir):
    marks = ("lorem ipsum dolor", "Placeholder here", "TODO:", "tbd", "[insert a name]", "Content goes here", "sample text of it", "No lorem ipsum")
    rows = _cycle(spark, sf_dir, [_with(after="\n" + m) for m in marks], "content")
    return rows.select("doc_id", F.array_join(V.boilerplate_hits("content").cast("array<string>"), ",").alias("rules"))


@query(
    "rules_fired",
    f"""SELECT doc_id, CASE WHEN m < 15 THEN m + 1 END AS rule_number, CASE WHEN m IN (6, 7, 8, 9, 14) THEN 'DYNAMIC' ELSE 'STATIC' END AS section_type,
  [0.95, 0.92, 0.95, 0.90, 0.92, 0.90, 0.95, 0.92, 0.88, 0.85, 0.95, 0.70, 0.75, 0.80, 0.72, 0.5][m + 1]::DOUBLE AS confidence,
  CASE WHEN m < 15 THEN 'rule_based' ELSE 'fallback' END AS method,
  CASE m WHEN 0 THEN {_PLAIN} || ' Confidential' WHEN 1 THEN {_PLAIN} || ' prepared by us' WHEN 2 THEN 'Page 12 of it' WHEN 3 THEN {_PLAIN} || ' tel: 123'
    WHEN 4 THEN 'Agenda:' WHEN 5 THEN 'Introduction' WHEN 6 THEN {_PLAIN} || ' {{name}}' WHEN 7 THEN {_PLAIN} || ' to be completed'
    WHEN 8 THEN {_PLAIN} || ' company name' WHEN 9 THEN {_PLAIN} || ' we recommend it' END AS text_sample,
  ['Confidential', 'prepared by', 'Page 12', 'tel:', 'Agenda:', 'Introduction', '{{name}}', 'to be completed', 'company name', 'we recommend'][m + 1] AS matched_text
FROM (SELECT *, doc_id % 16 AS m FROM documents)""",
)
def rules_fired(spark, sf_dir):
    """Each text rule, header, top heading, the three heuristics and the fallback."""
    texts = [
        _with(after=" Confidential"), _with(after=" prepared by us"), F.lit("Page 12 of it"), _with(after=" tel: 123"),
        F.lit("Agenda:"), F.lit("Introduction"), _with(after=" {name}"), _with(after=" to be completed"),
        _with(after=" company name"), _with(after=" we recommend it"), _plain(), _plain(), F.lit("Ok then"),
        F.upper(_plain()), _with(after=" and another word follows" * 30), _plain(),
    ]
    rows = _cycle(spark, sf_dir, texts, "text")
    kinds = F.when(F.col("_m") == 10, "header").when(F.col("_m") == 11, "heading").otherwise("paragraph")
    blocks = rows.select("doc_id", kinds.alias("block_type"), F.when(F.col("_m") == 11, 1).alias("level"), "text")
    return C.classify(blocks, K.TOP_HEADING_RULE[1]).select(
        "doc_id", F.col("rule_number").cast("bigint").alias("rule_number"), "section_type", "confidence", "method", "text_sample", "matched_text"
    )


@query("stream_validate", "WITH " + _EXPECTED + "SELECT doc_id, error_codes, failure_type, error_codes = '' AS is_valid FROM expected")
def stream_validate(spark, sf_dir):
    """The verdicts of ``verdict_codes`` on arriving texts."""
    rows = _cycle(spark, sf_dir, [make() for make in _CONTENTS], "content", S.read_stream(spark, sf_dir, "documents.parquet"))
    judged = S.validated(rows, "content", min_length=20, max_length=500, custom=(r"\[client-\d+\]",))
    out = judged.select("doc_id", F.array_join("error_codes", ",").alias("error_codes"), "failure_type", "is_valid")
    return S.run_available(out, "validate")


_EVENT_ROWS = """(0, 'GENERATION_BATCH', 'GENERATION_INITIATED', 'document_id template_version_id version_intent total_sections job_id'),
  (1, 'SECTION_OUTPUT', 'SECTION_GENERATION_COMPLETED', 'batch_id section_id document_id content_hash content_length generation_duration_ms job_id'),
  (2, 'SECTION_OUTPUT', 'SECTION_GENERATION_FAILED', 'batch_id section_id document_id error_code error_message retry_count job_id'),
  (3, 'SECTION_OUTPUT_BATCH', 'BATCH_GENERATION_COMPLETED', 'document_id completed_sections failed_sections total_sections job_id'),
  (4, 'SECTION_OUTPUT_BATCH', 'BATCH_GENERATION_FAILED', 'document_id error_code error_message job_id'),
  (5, 'ASSEMBLED_DOCUMENT', 'DOCUMENT_ASSEMBLY_COMPLETED', 'document_id template_version_id version_intent total_blocks dynamic_blocks_count static_blocks_count injected_sections_count assembly_hash assembly_duration_ms job_id'),
  (6, 'ASSEMBLED_DOCUMENT', 'DOCUMENT_ASSEMBLY_FAILED', 'document_id template_version_id version_intent error_code error_message job_id'),
  (7, 'RENDERED_DOCUMENT', 'DOCUMENT_RENDERING_COMPLETED', 'document_id version output_path content_hash file_size_bytes total_blocks_rendered rendering_duration_ms job_id'),
  (8, 'RENDERED_DOCUMENT', 'DOCUMENT_RENDERING_FAILED', 'document_id version error_code error_message job_id'),
  (9, 'DOCUMENT_VERSION', 'DOCUMENT_VERSION_CREATED', 'document_id version_number output_path content_hash job_id'),
  (10, 'TEMPLATE', 'CREATE', 'name'), (11, 'TEMPLATE_VERSION', 'CREATE', 'template_id version_number'), (12, 'DOCUMENT', 'CREATE', 'template_version_id'),
  (13, 'DOCUMENT', 'UPDATE_TEMPLATE_VERSION', 'old_template_version_id new_template_version_id'),
  (14, 'DOCUMENT_VERSION', 'CREATE', 'document_id version_number output_path content_hash'), (15, 'DOCUMENT', 'UPDATE_CURRENT_VERSION', 'document_id new_current_version'),
  (16, 'template_version', 'sections_classified', 'total_sections static_sections dynamic_sections high_confidence_count rule_based_count llm_assisted_count fallback_count duration_ms success_rate')"""


@query(
    "audit_events",
    f"""WITH e(i, entity_type, action, keys) AS (VALUES {_EVENT_ROWS})
SELECT entity_type, CAST(doc_id AS VARCHAR) AS entity_id, action,
  '{{' || array_to_string(list_transform(string_split(keys, ' '), lambda k: '"' || k || '":"' || k || '-' || doc_id || '"'), ',') || '}}' AS metadata
FROM documents JOIN e ON e.i = doc_id % 17""",
)
def audit_events(spark, sf_dir):
    """Each of the 17 events, with all its keys, for the documents whose id has its place in the cycle."""
    names = sorted({k for _, _, keys in K.AUDIT_EVENTS.values() for k in keys})
    docs = T.table(spark, sf_dir, "documents").select("doc_id", *[F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")).alias(k) for k in names])
    out = None
    for i, event in enumerate(K.AUDIT_EVENTS):
        rows = U.emit(docs.filter(F.col("doc_id") % len(K.AUDIT_EVENTS) == i), event, "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out
