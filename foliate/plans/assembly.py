"""Queries: assembly, integrity and renditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.operators import assemble as A
from foliate.operators import attempts as R
from foliate.operators import classify as C
from foliate.operators import materialise as D
from foliate.plans import ddl
from foliate.plans.generation import sections
from foliate.plans.parsing import html_blocks
from foliate.plans.parsing import _HTML_BLOCKS as HTML_BLOCKS
from foliate.plans.registry import query
from foliate.session import stored
from foliate.sources import tables as T

KEY = "template_version_id"


def section_outputs(spark, sf_dir):
    """Outputs of the deterministic generator; every seventh section fails without content."""
    return _outputs(sections(spark, sf_dir))


def _outputs(section_rows):
    rows = section_rows.filter(F.col("section_type") == "DYNAMIC").select(KEY, "section_id")
    made = R.generate(rows, failing=F.col("section_id") % 7 == 0)
    return made.select(
        KEY, "section_id",
        F.when(F.col("llm_ok"), F.col("raw_output")).alias("generated_content"),
        F.col("llm_ok").alias("is_validated"),
    )


_BLOCK = (KEY, "block_id", "position", "sequence", "block_type", "level", "text", "total_blocks")


def assembled(spark, sf_dir):
    """Classified blocks carry their section and its output, so nothing is joined."""
    rows = C.classify(T.text_blocks(spark, sf_dir), ddl.SECTION_THRESHOLD)
    rows = rows.select(*_BLOCK, "section_type", (F.col("position") + 1).alias("section_id"))
    made = R.generate(rows, failing=F.col("section_id") % 7 == 0)
    content = F.when((F.col("section_type") == "DYNAMIC") & F.col("llm_ok"), F.col("raw_output"))
    return A.assemble(made.select(*rows.columns, content.alias("generated_content")), None, None, KEY)


def assembled_by_path(spark, sf_dir):
    """The same from stored sections that know only the path of their block, and stored outputs; the texts are classified once."""
    rows = stored(C.classify(T.text_blocks(spark, sf_dir), ddl.SECTION_THRESHOLD), "classified")
    known = C.sections(rows)
    return A.assemble(rows.select(*_BLOCK), known, _outputs(known), KEY)


ASSEMBLED = """assembled AS (
  SELECT *, section_type = 'DYNAMIC' AS is_dynamic, section_type = 'DYNAMIC' AND section_id % 7 <> 0 AS injected,
    left(sha256(text), 16) AS original_content_hash,
    CASE WHEN section_type = 'DYNAMIC' AND section_id % 7 <> 0 THEN 'Deterministic content for section ' || section_id ELSE text END AS new_text
  FROM sections)"""


@query(
    "assembly_preconditions",
    ddl.with_(ddl.SECTIONS)
    + """SELECT template_version_id, section_id, unnest(['INVALID_SECTION_OUTPUT', 'MISSING_VALIDATED_CONTENT']) AS error_code
FROM sections WHERE section_type = 'DYNAMIC' AND section_id % 7 = 0""",
)
def assembly_preconditions(spark, sf_dir):
    return A.preconditions(sections(spark, sf_dir), section_outputs(spark, sf_dir), KEY).drop("message")


@query(
    "assembly_blocks",
    ddl.with_(ddl.SECTIONS, ASSEMBLED)
    + """SELECT template_version_id, block_id, position, is_dynamic, injected AS was_modified, original_content_hash,
  left(sha256(new_text), 16) AS assembled_content_hash, new_text AS text FROM assembled""",
)
def assembly_blocks(spark, sf_dir):
    return assembled_by_path(spark, sf_dir).select(
        KEY, "block_id", "position", "is_dynamic", "was_modified", "original_content_hash", "assembled_content_hash", "text"
    )


@query(
    "injection_report",
    ddl.with_(ddl.SECTIONS, ASSEMBLED)
    + """SELECT template_version_id, section_id, structural_path, true AS was_injected, original_content_hash,
  left(sha256(new_text), 16) AS injected_content_hash, length(new_text) AS content_length FROM assembled WHERE injected""",
)
def injection_report(spark, sf_dir):
    return A.injection_report(assembled(spark, sf_dir), KEY).drop("error_message")


@query(
    "assembly_counts",
    ddl.with_(ddl.SECTIONS, ASSEMBLED)
    + """SELECT template_version_id, count(*) AS total_blocks, count(*) FILTER (is_dynamic) AS dynamic_blocks_count,
  count(*) FILTER (NOT is_dynamic) AS static_blocks_count, count(*) FILTER (injected) AS injected_sections_count
FROM assembled GROUP BY template_version_id""",
)
def assembly_counts(spark, sf_dir):
    return A.counts(assembled(spark, sf_dir), KEY)


@query(
    "assembly_hash",
    ddl.with_(ddl.SECTIONS, ASSEMBLED)
    + """SELECT template_version_id, count(*) AS total_blocks, sha256(template_version_id || '|' || template_version_id || '|1|' || template_version_id
  || '|' || string_agg(block_id || ':' || left(sha256(new_text), 16), '|' ORDER BY sequence)) AS assembly_hash
FROM assembled GROUP BY template_version_id""",
)
def assembly_hash(spark, sf_dir):
    v = F.col(KEY)
    return A.assembly_hash(assembled(spark, sf_dir), v, v, F.lit(1), v, KEY)


def _mutated(spark, sf_dir):
    """Per version (id mod 5): a static text changed, last block lost, first id or type changed, untouched."""
    rows = assembled(spark, sf_dir)
    m = F.col(KEY) % 5
    first = F.col("position") == 0
    rows = rows.filter(~((m == 1) & (F.col("position") == F.col("total_blocks") - 1)))
    return rows.withColumns({
        "assembled_content_hash": F.when((m == 0) & first, F.lit("0")).otherwise(F.col("assembled_content_hash")),
        "block_id": F.when((m == 2) & first, F.lit("blk_new")).otherwise(F.col("block_id")),
        "block_type": F.when((m == 3) & first, F.lit("heading")).otherwise(F.col("block_type")),
    })


@query(
    "structure_errors",
    ddl.with_(ddl.BLOCKS)
    + """SELECT DISTINCT template_version_id, error_code, 1 AS errors FROM (
  SELECT template_version_id, unnest(CASE template_version_id % 5 WHEN 1 THEN ['BLOCK_COUNT_MISMATCH']
    WHEN 2 THEN ['ORPHANED_BLOCK', 'STRUCTURAL_MISMATCH', 'BLOCK_ORDER_MISMATCH'] WHEN 3 THEN ['STRUCTURAL_MISMATCH'] ELSE [] END) AS error_code
  FROM blocks)""",
)
def structure_errors(spark, sf_dir):
    return A.structure_errors(T.text_blocks(spark, sf_dir), _mutated(spark, sf_dir), KEY)


@query(
    "changed_static_blocks",
    ddl.with_(ddl.SECTIONS)
    + """SELECT template_version_id, block_id, 'STATIC_SECTION_MODIFIED' AS error_code FROM sections
WHERE template_version_id % 5 = 0 AND position = 0 AND section_type = 'STATIC'""",
)
def changed_static_blocks(spark, sf_dir):
    return A.changed_static_blocks(T.text_blocks(spark, sf_dir), _mutated(spark, sf_dir), KEY)


@query(
    "assembly_differences",
    ddl.with_(ddl.BLOCKS)
    + """SELECT template_version_id, 1 AS different_positions FROM blocks WHERE template_version_id % 5 IN (0, 1, 2) GROUP BY template_version_id""",
)
def assembly_differences(spark, sf_dir):
    return A.differences(assembled(spark, sf_dir), _mutated(spark, sf_dir), KEY)


# --- renditions -------------------------------------------------------------------------------
_LINE = """CASE block_type WHEN 'paragraph' THEN text WHEN 'heading' THEN repeat('#', level) || ' ' || text
    WHEN 'list' THEN '- ' || replace(items, '|', chr(10) || '- ') END"""


@query(
    "rendered_documents",
    ddl.with_(ddl.SECTIONS, ASSEMBLED)
    + """SELECT template_version_id, sha256(rendition) AS content_hash, strlen(rendition) AS file_size_bytes FROM (
  SELECT template_version_id, string_agg(new_text, chr(10) ORDER BY position) AS rendition FROM assembled GROUP BY template_version_id)""",
)
def rendered_documents(spark, sf_dir):
    return D.render(assembled(spark, sf_dir), KEY).drop("rendition")


@query(
    "rendered_pages",
    ddl.with_(HTML_BLOCKS)
    + f"""SELECT template_version_id, string_agg({_LINE}, chr(10) ORDER BY position) AS rendition FROM html_blocks
WHERE template_version_id NOT IN (SELECT template_version_id FROM html_blocks WHERE block_type = 'list' AND length(items) - length(replace(items, '|', '')) <> item_count - 1)
GROUP BY template_version_id""",
)
def rendered_pages(spark, sf_dir):
    return D.render(html_blocks(spark, sf_dir), KEY).select(KEY, "rendition")


@query(
    "rendition_statistics",
    ddl.with_(HTML_BLOCKS)
    + """SELECT template_version_id, count(*) FILTER (block_type = 'paragraph') AS paragraphs, count(*) FILTER (block_type = 'heading') AS headings,
  0 AS tables, count(*) FILTER (block_type = 'list') AS lists, 0 AS page_breaks, 0 AS section_breaks, count(*) AS total_blocks
FROM html_blocks GROUP BY template_version_id""",
)
def rendition_statistics(spark, sf_dir):
    return D.statistics(html_blocks(spark, sf_dir), KEY)


@query(
    "rendition_checks",
    ddl.with_(ddl.BLOCKS)
    + """SELECT template_version_id, CASE WHEN total = lost THEN 'VALIDATION_FAILED' END AS error_code,
  CASE WHEN lost > 0 AND lost < total THEN 'Expected ' || total || ' blocks but found ' || (total - lost) || '; Expected ' || total || ' paragraphs but found ' || (total - lost) ELSE '' END AS warnings
FROM (SELECT template_version_id, count(*) AS total, count(*) FILTER (sequence % 9 = 0 OR (template_version_id % 50 = 0)) AS lost FROM blocks GROUP BY 1)""",
)
def rendition_checks(spark, sf_dir):
    """Expected numbers against a rendition that lost every ninth block, and some documents whole."""
    blocks = T.text_blocks(spark, sf_dir)
    kept = blocks.filter(~((F.col("sequence") % 9 == 0) | (F.col(KEY) % 50 == 0)))
    checked = D.check_statistics(D.statistics(blocks, KEY), D.statistics(kept, KEY), KEY)
    return checked.select(KEY, "error_code", F.array_join("warnings", "; ").alias("warnings"))


_MISSING = ddl.with_(ddl.BLOCKS, f"""expected AS (SELECT DISTINCT template_version_id, {ddl.strip('text')} AS text FROM blocks),
shown AS (SELECT DISTINCT template_version_id, {ddl.strip("CASE WHEN sequence % 4 = 1 THEN left(text, 40) ELSE text END")} AS text FROM blocks WHERE sequence % 4 <> 2),
missing AS (SELECT e.template_version_id, e.text FROM expected e WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.template_version_id = e.template_version_id
  AND s.text <> '' AND (contains(s.text, e.text) OR contains(e.text, s.text))))""")


def _incomplete(spark, sf_dir):
    """Blocks, and a rendition that cut some of them to 40 characters and lost others."""
    blocks = T.text_blocks(spark, sf_dir)
    shown = blocks.filter(F.col("sequence") % 4 != 2).withColumn(
        "text", F.when(F.col("sequence") % 4 == 1, F.substring("text", 1, 40)).otherwise(F.col("text"))
    )
    return blocks, shown


@query("content_missing", _MISSING + "SELECT * FROM missing")
def content_missing(spark, sf_dir):
    return D.missing_content(*_incomplete(spark, sf_dir), KEY)


@query(
    "content_warnings",
    _MISSING + "SELECT template_version_id, count(*) AS missing_texts, array_to_string(list(left(text, 50) ORDER BY text)[1:3], '|') AS samples FROM missing GROUP BY template_version_id",
)
def content_warnings(spark, sf_dir):
    """Number of missing texts and up to three samples per document."""
    found = D.missing_warning(D.missing_texts(*_incomplete(spark, sf_dir), KEY), KEY)
    return found.select(KEY, "missing_texts", F.array_join("samples", "|").alias("samples"))


@query(
    "rendition_comparison",
    ddl.with_(ddl.BLOCKS)
    + """SELECT template_version_id, template_version_id % 3 <> 0 AS is_identical,
  CASE WHEN template_version_id % 3 = 0 THEN 'Paragraph content differs between renders' ELSE 'Content is byte-identical' END AS reason
FROM blocks GROUP BY template_version_id""",
)
def rendition_comparison(spark, sf_dir):
    blocks = T.text_blocks(spark, sf_dir)
    first = blocks.select(KEY, "position", "block_type", D.rendered_text(blocks).alias("rendered"))
    second = first.withColumn(
        "rendered", F.when((F.col(KEY) % 3 == 0) & (F.col("position") == 0), F.lit("changed")).otherwise(F.col("rendered"))
    )
    return D.compare(first, second, KEY)
