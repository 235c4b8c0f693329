"""Queries: the remaining operators, over the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions.ordered import id_bucket, ranked
from foliate.functions.text import run_of, sha
from foliate.operators import assemble as A
from foliate.operators import attempts as R
from foliate.operators import audit as U
from foliate.operators import blocks as B
from foliate.operators import classify as C
from foliate.operators import inputs as G
from foliate.operators import jobs as J
from foliate.operators import materialise as D
from foliate.operators import regenerate as X
from foliate.operators import versions as N
from foliate.plans import ddl
from foliate.plans.generation import _CHAINS, outputs
from foliate.plans.operations import _JOBS
from foliate.plans.parsing import _HTML_BLOCKS, html_blocks
from foliate.plans.registry import query
from foliate.plans.versioning import _PLACED, versions
from foliate.sources import tables as T

KEY = "template_version_id"

# --- blocks of every kind ---------------------------------------------------------------------
# Lines of all documents as elements whose kind follows from document and line number.
_MIX = f"""mix_lines AS (
  SELECT doc_id AS template_version_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
mixed AS (
  SELECT template_version_id, ord, text, (template_version_id * 7 + ord * 3 + length(text)) % 10 AS m FROM mix_lines WHERE {ddl.strip('text')} <> ''),
walk AS (
  SELECT *, m <= 3 AS item, row_number() OVER w AS n, lead(m) OVER w AS next_m,
    (coalesce(lag(m) OVER w, 9) <= 3 AND m > 3)::INT AS closes FROM mixed WINDOW w AS (PARTITION BY template_version_id ORDER BY ord)),
counted AS (SELECT *, sum(closes) OVER (PARTITION BY template_version_id ORDER BY ord) AS k FROM walk),
mix_blocks AS (
  SELECT template_version_id, ord AS first_ord, n + k - CASE WHEN m <> 6 THEN closes ELSE 0 END AS sequence,
    CASE WHEN m = 4 THEN 'heading' WHEN m = 5 THEN 'page_break' WHEN m = 6 THEN 'table' ELSE 'paragraph' END AS block_type,
    CASE WHEN m = 4 THEN 2 END AS level, CASE WHEN m IN (4, 7, 8, 9) THEN text END AS text, NULL AS list_type, NULL AS items,
    CASE WHEN m = 6 THEN len(string_split(text, ' | ')) END AS column_count FROM counted WHERE NOT item
  UNION ALL
  SELECT template_version_id, min(ord), max(n) + max(k) + CASE WHEN arg_max(coalesce(next_m, -1), ord) IN (4, 5, 7, 8, 9) THEN 2 ELSE 1 END, 'list', NULL, NULL,
    CASE WHEN arg_min(m, ord) = 3 THEN 'numbered' ELSE 'bullet' END, string_agg(text, '|' ORDER BY ord), NULL
  FROM counted WHERE item GROUP BY template_version_id, k),
mixed_blocks AS (
  SELECT *, row_number() OVER (PARTITION BY template_version_id ORDER BY first_ord) - 1 AS position,
    printf('blk_%s_%04d_%s', left(block_type, 3), CAST(sequence AS BIGINT), left(sha256(block_type || ':' || CAST(sequence AS BIGINT) || ':' ||
      left(coalesce({ddl.strip('text')}, ''), 50)), 12)) AS block_id FROM mix_blocks)"""


def mixed_elements(spark, sf_dir):
    lines = T.documents(spark, sf_dir).select(F.col("doc_id").alias(KEY), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    m = (F.col(KEY) * 7 + F.col("ord") * 3 + F.length("text")) % 10
    rows = lines.withColumns({"m": m, "ord": F.col("ord").cast("bigint")})
    style = F.when(F.col("m") <= 2, "List Bullet").when(F.col("m") == 3, "List Number").when(F.col("m") == 4, "Heading 2").otherwise("Normal")
    blank = F.regexp_count("text", F.lit(r"\S")) == 0
    cells = F.transform(F.split("text", r" \| "), lambda t: F.array(F.struct(t.alias("text"), run_of(t).alias("runs"))))
    is_table = F.col("m") == 6
    return rows.filter(~blank).select(
        KEY, "ord", F.when(is_table, "tbl").otherwise("p").alias("kind"), style.alias("style_name"),
        F.lit(None).cast("int").alias("outline_level"), F.lit(False).alias("has_numbering"), F.lit(None).cast("int").alias("list_level"),
        (F.col("m") == 5).alias("page_break"), run_of(F.col("text")).alias("runs"), "text",
        F.when(is_table, F.array(cells)).alias("table"),
    )


def mixed_blocks(spark, sf_dir):
    return B.blocks(mixed_elements(spark, sf_dir))


@query(
    "mixed_blocks",
    ddl.with_(_MIX)
    + "SELECT template_version_id, block_id, position, CAST(sequence AS BIGINT) AS sequence, block_type, level, list_type, column_count, text, items FROM mixed_blocks",
)
def mixed_block_rows(spark, sf_dir):
    """Lists ended by paragraphs, tables, page breaks and document ends."""
    return mixed_blocks(spark, sf_dir).select(
        KEY, "block_id", "position", "sequence", "block_type", "level", "list_type", "column_count", "text",
        F.when(F.col("block_type") == "list", F.array_join(F.transform("items", lambda x: x["text"]), "|")).alias("items"),
    )


@query(
    "table_cells",
    ddl.with_(_MIX)
    + """SELECT b.template_version_id, b.block_id, i - 1 AS col_index, printf('blk_cel_%04d_%s', i - 1, left(sha256('cell:' || (i - 1) || ':'), 12)) AS cell_id,
  true AS is_header, column_count, CASE WHEN """ + ddl.strip("c") + """ = '' THEN '' ELSE c END AS text
FROM mixed_blocks b JOIN (SELECT template_version_id, ord, unnest(string_split(text, ' | ')) AS c, generate_subscripts(string_split(text, ' | '), 1) AS i FROM mixed WHERE m = 6) t
  ON t.template_version_id = b.template_version_id AND t.ord = b.first_ord""",
)
def table_cells(spark, sf_dir):
    return B.cells(mixed_blocks(spark, sf_dir)).select(KEY, "block_id", "col_index", "cell_id", "is_header", "column_count", "text")


@query(
    "headers_footers",
    ddl.with_(_MIX)
    + """, last AS (SELECT template_version_id, max(n) + max(k) + arg_max(item::INT, ord) AS last FROM counted GROUP BY 1),
heads AS (SELECT template_version_id, 'header' AS part, 'default' AS variant, 0 AS o FROM last UNION ALL
  SELECT template_version_id, 'footer', 'default', 2 FROM last WHERE template_version_id % 2 = 0 UNION ALL SELECT template_version_id, 'header', 'first', 1 FROM last WHERE template_version_id % 3 = 0)
SELECT template_version_id, part AS block_type, variant AS header_footer_type, CAST(last + row_number() OVER (PARTITION BY template_version_id ORDER BY o) AS BIGINT) AS sequence FROM heads JOIN last USING (template_version_id)""",
)
def headers_footers(spark, sf_dir):
    el = mixed_elements(spark, sf_dir)
    last = B.last_number(el)
    part = F.struct
    variants = F.array_compact(F.array(
        part(F.lit("header").alias("part"), F.lit("default").alias("variant"), F.lit("Title page").alias("text")),
        part(F.lit("footer").alias("part"), F.lit("default").alias("variant"), F.when(F.col(KEY) % 2 == 0, "End note").otherwise("  ").alias("text")),
        F.when(F.col(KEY) % 3 == 0, part(F.lit("header").alias("part"), F.lit("first").alias("variant"), F.lit("First page").alias("text"))),
    ))
    rows = last.select(KEY, F.inline(variants)).select(
        KEY, F.lit(0).alias("section_no"), "part", "variant", F.lit(0).alias("ord"), "text", run_of(F.col("text")).alias("runs")
    )
    return B.headers_footers(rows, last).select(KEY, "block_type", "header_footer_type", "sequence")


@query(
    "parse_summary",
    ddl.with_(_HTML_BLOCKS)
    + """SELECT page_id AS template_version_id, sha256(html) AS content_hash, coalesce(b.total_blocks, 0) AS total_blocks, coalesce(b.h, 0) AS heading_count,
  coalesce(b.p, 0) AS paragraph_count, 0 AS table_count, coalesce(b.l, 0) AS list_count, (page_id % 2 = 0)::INT AS header_count, 0 AS footer_count
FROM pages LEFT JOIN (SELECT template_version_id, count(*) AS total_blocks, count(*) FILTER (block_type = 'heading') AS h, count(*) FILTER (block_type = 'paragraph') AS p,
  count(*) FILTER (block_type = 'list') AS l FROM html_blocks GROUP BY 1) b ON b.template_version_id = page_id""",
)
def parse_summary(spark, sf_dir):
    pages = T.table(spark, sf_dir, "pages")
    v = pages.select(F.col("page_id").alias(KEY), sha("html").alias("content_hash"))
    heads = v.filter(F.col(KEY) % 2 == 0).select(KEY, F.lit("header").alias("block_type"))
    return B.parse_summary(html_blocks(spark, sf_dir), heads, v)


@query(
    "rendered_mixed",
    ddl.with_(_MIX)
    + """SELECT template_version_id, sha256(string_agg(CASE block_type WHEN 'paragraph' THEN text WHEN 'heading' THEN '## ' || text WHEN 'page_break' THEN '[page break]' WHEN 'table' THEN cells
  ELSE lines END, chr(10) ORDER BY position)) AS content_hash
FROM (SELECT b.*, t.cells, l.lines FROM mixed_blocks b
  LEFT JOIN (SELECT template_version_id, ord, string_agg(CASE WHEN """ + ddl.strip("c") + """ = '' THEN '' ELSE c END, ' | ' ORDER BY i) AS cells FROM (SELECT template_version_id, ord, unnest(string_split(text, ' | ')) AS c,
    generate_subscripts(string_split(text, ' | '), 1) AS i FROM mixed WHERE m = 6) GROUP BY 1, 2) t ON t.template_version_id = b.template_version_id AND t.ord = b.first_ord
  LEFT JOIN (SELECT template_version_id, min(ord) AS ord, CASE WHEN arg_min(m, ord) = 3 THEN string_agg(r || '. ' || text, chr(10) ORDER BY ord) ELSE string_agg('- ' || text, chr(10) ORDER BY ord) END AS lines
    FROM (SELECT *, row_number() OVER (PARTITION BY template_version_id, k ORDER BY ord) AS r FROM counted WHERE item) GROUP BY template_version_id, k) l
  ON l.template_version_id = b.template_version_id AND l.ord = b.first_ord AND b.block_type = 'list')
GROUP BY template_version_id""",
)
def rendered_mixed(spark, sf_dir):
    """Renditions with tables, page breaks and both list types."""
    return D.render(mixed_blocks(spark, sf_dir), KEY).select(KEY, "content_hash")


# --- model tier -------------------------------------------------------------------------------
_MODEL = """model AS (
  SELECT *, CASE (template_version_id + sequence) % 4 WHEN 0 THEN 'DYNAMIC' WHEN 1 THEN 'STATIC' WHEN 2 THEN 'DYNAMIC' END AS answer,
    CASE (template_version_id + sequence) % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.5 END AS score FROM classified)"""


@query(
    "classify_with_model",
    ddl.with_(ddl.BLOCKS, ddl.classified(0.85), _MODEL)
    + """SELECT template_version_id, block_id, CASE WHEN method = 'fallback' AND score >= 0.85 THEN answer ELSE section_type END AS section_type,
  CASE WHEN method = 'fallback' AND score >= 0.85 THEN score ELSE confidence END AS confidence,
  CASE WHEN method = 'fallback' AND score >= 0.85 THEN 'llm_assisted' ELSE method END AS method FROM model""",
)
def classify_with_model(spark, sf_dir):
    """Replies derived per block: over-confident, fine, unsure, no JSON."""
    blocks = T.text_blocks(spark, sf_dir)
    m = (F.col(KEY) + F.col("sequence")) % 4
    content = (
        F.when(m == 0, 'Answer: {"classification": "dynamic", "confidence": 1.5, "reasoning": "a"}')
        .when(m == 1, '{"classification": "STATIC", "confidence": 0.9}')
        .when(m == 2, '{"classification": "DYNAMIC", "confidence": 0.5}')
        .otherwise("no idea")
    )
    replies = C.model_replies(blocks.select(KEY, "block_id", content.alias("content")))
    return C.classify(blocks, replies=replies).select(KEY, "block_id", "section_type", "confidence", "method")


@query(
    "model_features",
    ddl.with_(_HTML_BLOCKS)
    + """SELECT template_version_id, block_id, block_type, left(coalesce(text, ''), 1000) AS content, length(coalesce(text, '')) AS text_length,
  level AS heading_level, position AS position_in_document FROM html_blocks""",
)
def model_features(spark, sf_dir):
    return C.model_features(html_blocks(spark, sf_dir)).select(
        KEY, "block_id", "block_type", "content", "structural_metadata.text_length", "structural_metadata.heading_level",
        "structural_metadata.position_in_document",
    )


# --- guards and states ------------------------------------------------------------------------
@query(
    "input_batch_guard",
    """SELECT o_orderkey AS document_id, 1 AS version_intent, o_orderkey % 3 = 0 AS is_violation FROM orders""",
)
def input_batch_guard(spark, sf_dir):
    """Candidate batches of all documents against a store that has a third of them."""
    docs = T.document_instances(spark, sf_dir).select("document_id", F.lit(1).alias("version_intent"))
    stored = docs.filter(F.col("document_id") % 3 == 0).withColumn("is_immutable", F.lit(True))
    key = ("document_id", "version_intent")
    fresh = G.accepted_batches(docs, stored, *key).withColumn("is_violation", F.lit(False))
    return fresh.unionByName(G.write_violations(docs, stored, *key).select(*key, F.lit(True).alias("is_violation")))


@query("bad_intents", "SELECT o_orderkey AS document_id, o_orderkey % 5 - 1 AS version_intent FROM orders WHERE o_orderkey % 5 - 1 < 1")
def bad_intents(spark, sf_dir):
    return G.bad_intents(T.document_instances(spark, sf_dir).select("document_id", (F.col("document_id") % 5 - 1).alias("version_intent")))


@query(
    "missing_inputs",
    ddl.with_(_CHAINS)
    + """SELECT section_id, CASE WHEN section_id % 6 = 0 THEN 'FAILED' ELSE status END AS status, CASE WHEN section_id % 6 = 0 THEN 'MISSING_INPUT' ELSE error_code END AS error_code,
  section_id % 6 <> 0 AND validated AS is_validated FROM outputs""",
)
def missing_inputs(spark, sf_dir):
    out = outputs(spark, sf_dir)
    known = T.attempts(spark, sf_dir).select("section_id").filter(F.col("section_id") % 6 != 0)
    return R.with_missing_inputs(out, known, "section_id").select("section_id", "status", "error_code", "is_validated")


@query(
    "unexpected_errors",
    ddl.with_(_CHAINS)
    + """SELECT section_id, CASE WHEN section_id % 8 = 0 THEN 'FAILED' ELSE status END AS status, CASE WHEN section_id % 8 = 0 THEN 'UNEXPECTED_ERROR' ELSE error_code END AS error_code,
  CASE WHEN section_id % 8 = 0 THEN 'UNEXPECTED_ERROR' ELSE failure_category END AS failure_category FROM outputs""",
)
def unexpected_errors(spark, sf_dir):
    raised = F.when(F.col("section_id") % 8 == 0, F.lit("worker died"))
    return R.unexpected_errors(outputs(spark, sf_dir), raised).select("section_id", "status", "error_code", "failure_category")


@query(
    "reset_outputs",
    ddl.with_(_CHAINS)
    + "SELECT section_id, CASE WHEN done THEN status ELSE 'IN_PROGRESS' END AS status, CASE WHEN done THEN error_code END AS error_code, CASE WHEN done THEN content_hash END AS content_hash FROM outputs",
)
def reset_outputs(spark, sf_dir):
    return R.reset_for_retry(outputs(spark, sf_dir)).select("section_id", "status", "error_code", "content_hash")


@query(
    "failures_by_category",
    ddl.with_(_CHAINS) + "SELECT coalesce(failure_category, 'NONE') AS failure_category, status, count(*) AS outputs FROM outputs GROUP BY ALL",
)
def failures_by_category(spark, sf_dir):
    return outputs(spark, sf_dir).groupBy(F.coalesce("failure_category", F.lit("NONE")).alias("failure_category"), "status").agg(
        F.count(F.lit(1)).alias("outputs")
    )


@query(
    "output_batch_guard",
    "SELECT o_orderkey AS batch_key, o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0 AS may_start FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0 OR o_orderkey % 5 = 0",
)
def output_batch_guard(spark, sf_dir):
    """Input batches of which half are validated and a fifth have outputs already."""
    ins = T.document_instances(spark, sf_dir).select(
        F.col("document_id").alias("batch_key"),
        F.when(F.col("document_id") % 2 == 1, "VALIDATED").otherwise("PENDING").alias("status"),
        (F.col("document_id") % 2 == 1).alias("is_immutable"),
    )
    done = ins.filter(F.col("batch_key") % 5 == 0).select("batch_key")
    go = R.new_output_batches(ins, done).select("batch_key", F.lit(True).alias("may_start"))
    return go.unionByName(R.duplicate_output_batches(ins, done).select("batch_key", F.lit(False).alias("may_start")))


_STORED = """stored AS (
  SELECT o_orderkey AS assembled_document_id, o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_intent,
    o_orderkey AS batch_key, CASE o_orderkey % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'COMPLETED' ELSE 'VALIDATED' END AS status, o_orderkey % 3 <> 0 AS is_immutable, o_orderkey % 7 <> 0 AS has_structure FROM orders)"""


def _stored(spark, sf_dir):
    """Assemblies of customers' documents, one per order, numbered by order key."""
    docs = T.document_instances(spark, sf_dir).select(
        F.col("document_id").alias("assembled_document_id"), F.col("client_id").alias("document_id"), F.col("document_id").alias("batch_key")
    )
    rows = ranked(docs, ["document_id"], [F.col("batch_key")], id_bucket("batch_key"), "version_intent")
    k = F.col("batch_key")
    return rows.withColumns({
        "status": F.when(k % 4 == 0, "FAILED").when(k % 4 == 1, "COMPLETED").otherwise("VALIDATED"),
        "is_immutable": k % 3 != 0,
        "has_structure": k % 7 != 0,
        "assembled_structure": F.when(k % 7 != 0, "{}"),
    })


@query(
    "assembly_guard",
    ddl.with_(_STORED) + "SELECT batch_key, batch_key % 2 = 0 AS force FROM stored WHERE batch_key % 2 = 0 OR NOT is_immutable",
)
def assembly_guard(spark, sf_dir):
    s = _stored(spark, sf_dir)
    return A.accepted_requests(s.select("batch_key", (F.col("batch_key") % 2 == 0).alias("force")), s)


@query(
    "latest_assemblies",
    ddl.with_(_STORED) + "SELECT document_id, max(version_intent) AS version_intent, arg_max(status, version_intent) AS status, arg_max(batch_key, version_intent) AS batch_key FROM stored GROUP BY 1",
)
def latest_assemblies(spark, sf_dir):
    return A.latest(_stored(spark, sf_dir)).select("document_id", "version_intent", "status", "batch_key")


@query(
    "assembly_flags",
    ddl.with_(_STORED)
    + """SELECT batch_key, status <> 'FAILED' AS is_complete, status = 'FAILED' AS is_failed, status = 'VALIDATED' AS is_validated,
  is_immutable AND status = 'VALIDATED' AND has_structure AS can_be_rendered FROM stored""",
)
def assembly_flags(spark, sf_dir):
    return A.status_flags(_stored(spark, sf_dir)).select("batch_key", "is_complete", "is_failed", "is_validated", "can_be_rendered")


@query(
    "render_preconditions",
    ddl.with_(_STORED)
    + """SELECT assembled_document_id, CASE WHEN NOT is_immutable THEN 'DOCUMENT_NOT_IMMUTABLE' WHEN status <> 'VALIDATED' THEN 'DOCUMENT_NOT_VALIDATED'
  WHEN NOT has_structure THEN 'MISSING_ASSEMBLED_STRUCTURE' WHEN batch_key % 5 = 0 THEN 'ALREADY_RENDERED' END AS error_code FROM stored""",
)
def render_preconditions(spark, sf_dir):
    s = _stored(spark, sf_dir)
    done = s.filter(F.col("batch_key") % 5 == 0).select("assembled_document_id", F.lit(True).alias("is_immutable"))
    return D.render_error(s, done).select("assembled_document_id", "error_code")


# --- versions, documents, regeneration --------------------------------------------------------
@query(
    "current_versions",
    ddl.with_(_PLACED)
    + """SELECT document_id, version_number, content_hash FROM placed p WHERE NOT is_duplicate AND version_number = (SELECT max(version_number) FROM placed q WHERE q.document_id = p.document_id)""",
)
def current_versions(spark, sf_dir):
    v = versions(spark, sf_dir)
    return N.current_rows(N.current_versions(v), v).select("document_id", "version_number", "content_hash")


@query(
    "version_metadata",
    ddl.with_(_PLACED)
    + "SELECT document_id, version_number, CASE WHEN arrival % 3 = 0 THEN '' ELSE content_hash END AS content_hash, CASE WHEN arrival % 3 = 0 THEN 0 ELSE arrival END AS file_size_bytes FROM placed WHERE NOT is_duplicate",
)
def version_metadata(spark, sf_dir):
    """Hash and size as JSON metadata, some of it empty, read back with defaults."""
    v = versions(spark, sf_dir)
    meta = F.when(F.col("arrival") % 3 == 0, "{}").otherwise(F.to_json(F.struct("content_hash", F.col("arrival").alias("file_size_bytes"))))
    return N.metadata(v.select("document_id", "version_number", meta.alias("generation_metadata"))).drop("generation_metadata")


@query(
    "document_page",
    "SELECT o_orderkey AS document_id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 20",
)
def document_page(spark, sf_dir):
    return N.listing(T.document_instances(spark, sf_dir).select("document_id", "created_at"), skip=20, limit=50)


@query(
    "regen_document_errors",
    """SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 4 = 0 THEN 'DOCUMENT_NOT_FOUND' ELSE 'NO_VERSION_EXISTS' END AS error_code
FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0""",
)
def regen_document_errors(spark, sf_dir):
    docs = T.document_instances(spark, sf_dir).select("document_id")
    return X.document_errors(docs, docs.filter(F.col("document_id") % 4 != 0), docs.filter(F.col("document_id") % 3 != 0))


@query(
    "cancelled_jobs",
    ddl.with_(_JOBS) + "SELECT job_id, 'FAILED' AS status, 'Cancelled by user' AS error FROM jobs WHERE job_id % 2 = 0 AND status IN ('PENDING', 'RUNNING')",
)
def cancelled_jobs(spark, sf_dir):
    j = T.jobs(spark, sf_dir)
    return J.cancelled(j, j.filter(F.col("job_id") % 2 == 0)).select("job_id", "status", "error")


@query(
    "audit_template_events",
    ddl.with_(ddl.VERSIONS)
    + """SELECT 'TEMPLATE_VERSION' AS entity_type, template_version_id::VARCHAR AS entity_id, 'CREATE' AS action, '{"template_id":"' || template_id || '","version_number":' || version_number || '}' AS metadata FROM versions
UNION ALL SELECT 'DOCUMENT', template_id, 'UPDATE_CURRENT_VERSION', '{"document_id":"' || template_id || '","new_current_version":' || max(version_number) || '}' FROM versions GROUP BY template_id""",
)
def audit_template_events(spark, sf_dir):
    v = T.template_versions(spark, sf_dir)
    moved = v.groupBy(F.col("template_id").alias("document_id")).agg(F.max("version_number").alias("new_current_version"))
    return U.emit(v, "template_version_created", KEY).unionByName(U.emit(moved, "current_version_moved", "document_id"))
