"""Queries: generation inputs, attempts and output batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.operators import attempts as R
from foliate.operators import classify as C
from foliate.operators import inputs as G
from foliate.plans import ddl
from foliate.plans.registry import query
from foliate.plans.validation import judged
from foliate.sources import tables as T

CLIENTS_PER_CYCLE = 150


def sections(spark, sf_dir):
    """Sections of every document; at 0.70 long narrative lines count as dynamic."""
    return C.sections(C.classify(T.text_blocks(spark, sf_dir), ddl.SECTION_THRESHOLD))


_CONTEXT = """context AS (
  SELECT *, lag(structural_path) OVER w AS preceding_content, lag(section_type) OVER w AS preceding_type,
    lead(structural_path) OVER w AS following_content, lead(section_type) OVER w AS following_type,
    'Section at position ' || row_number() OVER w || ' of ' || count(*) OVER (PARTITION BY template_version_id) AS section_boundary_hint,
    row_number() OVER w - 1 AS sibling_index, count(*) OVER (PARTITION BY template_version_id) AS total_siblings
  FROM sections WINDOW w AS (PARTITION BY template_version_id ORDER BY section_id)),
dynamic AS (
  SELECT *, row_number() OVER (PARTITION BY template_version_id ORDER BY section_id) - 1 AS sequence_order
  FROM context WHERE section_type = 'DYNAMIC')"""


@query(
    "sections",
    ddl.with_(ddl.SECTIONS)
    + "SELECT template_version_id, section_id, structural_path, section_type, CASE WHEN section_type = 'DYNAMIC' THEN confidence END AS stored_confidence FROM sections",
)
def section_rows(spark, sf_dir):
    return sections(spark, sf_dir).select(
        "template_version_id", "section_id", "structural_path", "section_type",
        F.col("prompt_config.classification_confidence").alias("stored_confidence"),
    )


@query(
    "section_statistics",
    ddl.with_(ddl.SECTIONS)
    + """SELECT template_version_id, count(*) AS total_sections, count(*) FILTER (section_type = 'STATIC') AS static_sections,
  count(*) FILTER (section_type = 'DYNAMIC') AS dynamic_sections,
  count(*) FILTER (section_type = 'STATIC' OR confidence >= 0.9) AS high_confidence_count,
  count(*) FILTER (section_type = 'DYNAMIC' AND confidence >= 0.7 AND confidence < 0.9) AS medium_confidence_count,
  count(*) FILTER (section_type = 'DYNAMIC' AND confidence < 0.7) AS low_confidence_count,
  round(count(*) FILTER (section_type = 'STATIC') / count(*) * 100, 2) AS static_percentage,
  round(count(*) FILTER (section_type = 'DYNAMIC') / count(*) * 100, 2) AS dynamic_percentage
FROM sections GROUP BY template_version_id""",
)
def section_statistics(spark, sf_dir):
    return C.stored_statistics(sections(spark, sf_dir), "template_version_id")


@query(
    "versions_without_dynamic",
    ddl.with_(ddl.SECTIONS)
    + """SELECT doc_id AS template_version_id, 'NoDynamicSectionsError' AS error_type FROM documents
WHERE doc_id NOT IN (SELECT template_version_id FROM sections WHERE section_type = 'DYNAMIC')""",
)
def versions_without_dynamic(spark, sf_dir):
    versions = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("template_version_id"))
    return G.versions_without_dynamic(versions, sections(spark, sf_dir))


@query(
    "surrounding_context",
    ddl.with_(ddl.SECTIONS, _CONTEXT)
    + """SELECT template_version_id, section_id, sequence_order, preceding_content, preceding_type, following_content,
  following_type, section_boundary_hint FROM dynamic""",
)
def surrounding_context(spark, sf_dir):
    return G.dynamic_inputs(sections(spark, sf_dir)).select(
        "template_version_id", "section_id", "sequence_order", "preceding_content", "preceding_type",
        "following_content", "following_type", "section_boundary_hint",
    )


@query(
    "hierarchy_context",
    ddl.with_(ddl.SECTIONS, _CONTEXT)
    + """SELECT template_version_id, section_id, 'block' AS parent_heading, 2 AS parent_level, 2 AS depth,
  sibling_index, total_siblings FROM dynamic""",
)
def hierarchy_context(spark, sf_dir):
    return G.dynamic_inputs(sections(spark, sf_dir)).select(
        "template_version_id", "section_id", "parent_heading", "parent_level", "depth", "sibling_index", "total_siblings"
    )


_NESTED = ddl.with_(ddl.SECTIONS) + """, nested AS (SELECT template_version_id, section_id, section_id % 4 AS m, count(*) OVER (PARTITION BY template_version_id) AS total FROM sections)
"""


def _nested(spark, sf_dir):
    """Sections in threes, each inside the one before, and every fourth beside the others: ``part1``, ``part1/block/2``, ``part1/block/2/item/3``, ``body/4``."""
    s = sections(spark, sf_dir)
    m, at = F.col("section_id") % 4, lambda k: (F.col("section_id") - k).cast("string")
    path = (
        F.when(m == 1, F.concat(F.lit("part"), at(0))).when(m == 2, F.concat(F.lit("part"), at(1), F.lit("/block/"), at(0)))
        .when(m == 3, F.concat(F.lit("part"), at(2), F.lit("/block/"), at(1), F.lit("/item/"), at(0))).otherwise(F.concat(F.lit("body/"), at(0)))
    )
    return s.withColumn("structural_path", path)


@query(
    "hierarchy_depths",
    _NESTED
    + """SELECT template_version_id, section_id, ['body', NULL, 'block', 'item'][m + 1] AS parent_heading, [1, 0, 2, 4][m + 1] AS depth, [1, NULL, 2, 4][m + 1] AS parent_level,
  CASE WHEN m = 0 THEN section_id // 4 - 1 ELSE 0 END AS sibling_index, CASE WHEN m = 0 THEN total // 4 ELSE 1 END AS total_siblings FROM nested""",
)
def hierarchy_depths(spark, sf_dir):
    """Paths of one to five segments."""
    return G.with_context(_nested(spark, sf_dir)).select(
        "template_version_id", "section_id", "parent_heading", "depth", "parent_level", "sibling_index", "total_siblings"
    )


@query(
    "section_ancestors",
    _NESTED
    + """SELECT template_version_id, section_id, section_id - 1 AS ancestor_id, 2 AS distance FROM nested WHERE m IN (2, 3)
UNION ALL SELECT template_version_id, section_id, section_id - 2, 4 FROM nested WHERE m = 3""",
)
def section_ancestors(spark, sf_dir):
    """Every section above another one."""
    return G.ancestors(_nested(spark, sf_dir)).select("template_version_id", "section_id", "ancestor_id", "distance")


_BATCHES = """batch AS (SELECT o_custkey AS document_id, o_orderkey AS batch_key, o_orderkey % 3 AS version_intent, CASE WHEN o_orderkey % 2 = 0 THEN 'VALIDATED' ELSE 'PENDING' END AS status,
  o_orderkey % 5 <> 0 AS is_immutable FROM orders)"""


@query(
    "batch_lookups",
    ddl.with_(_BATCHES)
    + """SELECT 'usable' AS lookup, batch_key FROM batch WHERE status = 'VALIDATED' AND is_immutable UNION ALL
SELECT 'documents', batch_key FROM batch WHERE document_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) UNION ALL
SELECT 'intents', batch_key FROM batch WHERE document_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) AND version_intent = 1 UNION ALL
SELECT 'inputs', l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT batch_key FROM batch WHERE status = 'VALIDATED' AND is_immutable)""",
)
def batch_lookups(spark, sf_dir):
    """Batches that may be used, batches of a table of documents, with and without an intent, and inputs of batches."""
    k = F.col("o_orderkey")
    batch = T.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), k.alias("batch_key"), (k % 3).alias("version_intent"),
        F.when(k % 2 == 0, "VALIDATED").otherwise("PENDING").alias("status"), (k % 5 != 0).alias("is_immutable"),
    )
    wanted = T.table(spark, sf_dir, "customer").filter("c_nationkey = 7").select(F.col("c_custkey").alias("document_id"))
    usable = G.usable_batches(batch)
    lines = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_key"), "l_linenumber")
    found = {
        "usable": usable.select("batch_key"),
        "documents": G.batches_of(batch, wanted).select("batch_key"),
        "intents": G.batches_of(batch, wanted.withColumn("version_intent", F.lit(1))).select("batch_key"),
        "inputs": G.inputs_of(lines, usable, "batch_key").select(F.col("l_linenumber").alias("batch_key")),
    }
    out = None
    for name, rows in found.items():
        rows = rows.select(F.lit(name).alias("lookup"), F.col("batch_key").cast("bigint").alias("batch_key"))
        out = rows if out is None else out.unionByName(rows)
    return out


def inputs(spark, sf_dir):
    """Dynamic sections with context, the version's client and the input hash."""
    rows = G.dynamic_inputs(sections(spark, sf_dir)).withColumns({
        "client_id": F.col("template_version_id") % CLIENTS_PER_CYCLE,
    })
    return G.with_input_hash(G.attach_client(rows, T.clients(spark, sf_dir)))


def _j(expr: str) -> str:
    return f"coalesce(to_json({expr})::VARCHAR, 'null')"


INPUTS = f"""client_rows AS (
  SELECT c_custkey AS client_id, c_name AS client_name, n_name AS nation, r_name AS region, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
joined AS (
  SELECT d.*, c.* FROM dynamic d LEFT JOIN client_rows c ON c.client_id = d.template_version_id % {CLIENTS_PER_CYCLE}),
inputs AS (
  SELECT *, sha256('{{"client_data":{{"client_id":' || {_j('client_id::VARCHAR')} || ',"client_name":' || {_j('client_name')}
    || ',"custom_context":{{}},"data_fields":{{"nation":' || {_j('nation')} || ',"region":' || {_j('region')} || ',"segment":' || {_j('segment')}
    || '}}}},"hierarchy_context":{{"depth":2,"parent_heading":"block","parent_level":2,"path_segments":["body","block",' || {_j('section_id::VARCHAR')}
    || '],"sibling_index":' || sibling_index || ',"total_siblings":' || total_siblings
    || '}},"prompt_config":{{"classification_confidence":' || {_j('confidence')} || ',"classification_method":' || {_j('method')}
    || ',"justification":' || {_j('justification')} || ',"prompt_template":null}},"section_id":' || section_id
    || ',"structural_path":' || {_j('structural_path')} || ',"surrounding_context":{{"following_content":' || {_j('following_content')}
    || ',"following_type":' || {_j('following_type')} || ',"preceding_content":' || {_j('preceding_content')}
    || ',"preceding_type":' || {_j('preceding_type')} || ',"section_boundary_hint":' || {_j('section_boundary_hint')}
    || '}},"template_id":' || {_j('template_id')} || ',"template_version_id":' || {_j('template_version_id::VARCHAR')} || '}}') AS input_hash
  FROM joined)"""


@query("input_hash", ddl.with_(ddl.SECTIONS, _CONTEXT, INPUTS) + "SELECT template_version_id, section_id, input_hash FROM inputs")
def input_hash(spark, sf_dir):
    return inputs(spark, sf_dir).select("template_version_id", "section_id", "input_hash")


@query(
    "batch_hash",
    ddl.with_(ddl.SECTIONS, _CONTEXT, INPUTS)
    + """SELECT template_version_id, count(*) AS total_inputs,
  sha256('["' || string_agg(input_hash, '","' ORDER BY input_hash) || '"]') AS content_hash FROM inputs GROUP BY template_version_id""",
)
def batch_hash(spark, sf_dir):
    return G.batches(inputs(spark, sf_dir), "template_version_id").select("template_version_id", "total_inputs", "content_hash")


@query(
    "prompt_text",
    ddl.with_(ddl.SECTIONS, _CONTEXT, INPUTS)
    + """SELECT template_version_id, section_id, concat_ws(chr(10), 'Generate content for section at path: ' || structural_path,
  'Classification confidence: ' || confidence, 'Justification: ' || justification, 'Document structure: body > block > ' || section_id,
  'Client: ' || client_name, 'nation: ' || nation, 'region: ' || region, 'segment: ' || segment,
  'Preceding section: ' || preceding_content, 'Following section: ' || following_content) AS prompt FROM inputs""",
)
def prompt_text(spark, sf_dir):
    rows = inputs(spark, sf_dir)
    return rows.select("template_version_id", "section_id", G.prompt_text(rows).alias("prompt"))


@query(
    "input_checks",
    ddl.with_(ddl.SECTIONS, _CONTEXT)
    + "SELECT template_version_id, section_id, 'template_version_id' AS field, 'must be a valid UUID string' AS reason, template_version_id::VARCHAR AS value FROM dynamic",
)
def input_checks(spark, sf_dir):
    """Version ids of these tables are numbers, so the UUID check must fire on every input."""
    uuid = F.lit("00000000-0000-4000-8000-000000000000")
    rows = G.check_input(G.dynamic_inputs(sections(spark, sf_dir)).withColumn("template_id", uuid))
    return rows.select("template_version_id", "section_id", "input_error.field", "input_error.reason", "input_error.value")


@query(
    "config_checks",
    ddl.with_(ddl.SECTIONS)
    + """SELECT template_version_id, section_id, CASE section_id % 4 WHEN 0 THEN 'MissingPromptConfigError' WHEN 1 THEN 'MissingPromptConfigError'
  WHEN 2 THEN 'MalformedSectionMetadataError' END AS error_type,
  CASE section_id % 4 WHEN 0 THEN 'classification_confidence,classification_method,justification' WHEN 1 THEN 'classification_method,justification'
  WHEN 2 THEN '' END AS missing FROM sections""",
)
def config_checks(spark, sf_dir):
    """Configs derived per section: none, incomplete, not an object, complete."""
    rows = sections(spark, sf_dir)
    full = F.to_json(F.struct(F.col("confidence").alias("classification_confidence"), F.col("method").alias("classification_method"), "justification"))
    part = F.to_json(F.struct(F.col("confidence").alias("classification_confidence")))
    m = F.col("section_id") % 4
    config = F.when(m == 1, part).when(m == 2, F.lit('["no object"]')).when(m == 3, full)
    checked = G.check_config(rows.withColumn("config", config), "config")
    return checked.select("template_version_id", "section_id", "config_error.error_type", F.array_join("config_error.missing", ",").alias("missing"))


# --- attempts ---------------------------------------------------------------------------------
_CHAINS = """attempts AS (
  SELECT conv_id AS section_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS attempt_no,
    role = 'assistant' AS llm_ok, text, conv_id * 1000000 + turn AS attempt_key
  FROM conversations WHERE role IN ('assistant', 'system')),
""" + judged("attempts", "attempt_key") + """,
tried AS (
  SELECT a.section_id, a.attempt_no, a.llm_ok, a.text, j.is_valid AND a.llm_ok AS valid, j.n,
    CASE WHEN NOT a.llm_ok THEN 'LLM_INVOCATION_FAILED' WHEN NOT j.is_valid THEN split_part(j.error_codes, ',', 1) END AS code,
    CASE WHEN NOT a.llm_ok THEN 'GENERATION_FAILURE' ELSE j.failure_type END AS failure
  FROM attempts a JOIN judged j USING (attempt_key)),
ends AS (
  SELECT *, valid OR attempt_no >= 3 OR NOT (NOT llm_ok OR (failure = 'BOUNDS_VIOLATION' AND code NOT IN
    ('CONTAINS_MARKUP', 'CONTAINS_TAGS', 'CONTAINS_HEADERS', 'STRUCTURAL_MODIFICATION'))) AS terminal
  FROM tried),
stops AS (
  SELECT section_id, min(attempt_no) FILTER (terminal) AS stop, max(attempt_no) AS last FROM ends GROUP BY section_id),
outputs AS (
  SELECT s.section_id, stop IS NOT NULL AS done, e.valid AND stop IS NOT NULL AS validated,
    CASE WHEN stop IS NULL THEN 'RETRYING' WHEN e.valid THEN 'VALIDATED' ELSE 'FAILED' END AS status,
    CASE WHEN stop IS NOT NULL AND e.valid THEN NULL WHEN stop IS NOT NULL AND NOT e.llm_ok AND e.attempt_no >= 3 THEN 'RETRY_EXHAUSTED' ELSE e.code END AS error_code,
    CASE WHEN stop IS NOT NULL AND e.valid THEN NULL WHEN stop IS NOT NULL AND NOT e.llm_ok AND e.attempt_no >= 3 THEN 'RETRY_EXHAUSTION' ELSE e.failure END AS failure_category,
    CASE WHEN stop IS NULL THEN last + 1 ELSE stop END AS retry_count,
    CASE WHEN stop IS NOT NULL AND e.valid THEN sha256(""" + ddl.strip("e.text") + """) END AS content_hash,
    CASE WHEN stop IS NOT NULL AND e.valid THEN e.n ELSE 0 END AS content_length
  FROM stops s JOIN ends e ON e.section_id = s.section_id AND e.attempt_no = coalesce(s.stop, s.last))"""


def outputs(spark, sf_dir):
    return R.outcomes(R.judge(T.attempts(spark, sf_dir)), "section_id").withColumn(
        "batch_key", F.floor(F.col("section_id") / 10)
    )


@query(
    "attempt_outcome",
    ddl.with_(_CHAINS)
    + "SELECT section_id, status, error_code, failure_category, retry_count, content_hash, content_length FROM outputs",
)
def attempt_outcome(spark, sf_dir):
    return outputs(spark, sf_dir).select(
        "section_id", "status", "error_code", "failure_category", "retry_count", "content_hash", "content_length"
    )


@query(
    "retry_history",
    ddl.with_(_CHAINS)
    + """SELECT s.section_id, string_agg(e.attempt_no || ':' || e.code, ',' ORDER BY e.attempt_no) AS history, max(e.attempt_no) AS last_attempt
FROM stops s JOIN ends e ON e.section_id = s.section_id AND NOT e.terminal AND e.attempt_no < 3 AND (s.stop IS NULL OR e.attempt_no < s.stop) GROUP BY s.section_id""",
)
def retry_history(spark, sf_dir):
    rows = outputs(spark, sf_dir).filter(F.size("retry_history") > 0)
    entry = F.transform("retry_history", lambda e: F.concat(e["attempt"].cast("string"), F.lit(":"), e["error_code"]))
    return rows.select("section_id", F.array_join(entry, ",").alias("history"), F.col("last_attempt.attempt").alias("last_attempt"))


@query(
    "retry_backoff",
    ddl.with_(_CHAINS)
    + """SELECT section_id, attempt_no, least(power(2, attempt_no), 16)::INT AS delay_seconds,
  CASE WHEN attempt_no >= 3 THEN 'EXHAUSTED' WHEN failure IN ('GENERATION_FAILURE', 'BOUNDS_VIOLATION') THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END AS eligibility
FROM ends WHERE NOT valid""",
)
def retry_backoff(spark, sf_dir):
    rows = R.judge(T.attempts(spark, sf_dir)).filter(~F.col("attempt_valid"))
    return rows.select(
        "section_id", "attempt_no", R.backoff_seconds(F.col("attempt_no")).alias("delay_seconds"),
        R.retry_eligibility(F.col("attempt_failure"), F.col("attempt_no")).alias("eligibility"),
    )


@query(
    "batch_progress",
    ddl.with_(_CHAINS)
    + """SELECT batch_key, total_sections, completed_sections, failed_sections,
  CASE WHEN completed_sections + failed_sections >= total_sections THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status
FROM (SELECT section_id // 10 AS batch_key, count(*) AS total_sections, count(*) FILTER (status = 'VALIDATED') AS completed_sections,
  count(*) FILTER (status = 'FAILED') AS failed_sections FROM outputs GROUP BY 1)""",
)
def batch_progress(spark, sf_dir):
    return R.batch_progress(outputs(spark, sf_dir), "batch_key").drop("is_immutable")


@query(
    "status_counts",
    ddl.with_(_CHAINS)
    + "SELECT section_id // 10 AS batch_key, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in K.OUTPUT_STATUSES)
    + " FROM outputs GROUP BY 1",
)
def status_counts(spark, sf_dir):
    return R.status_counts(outputs(spark, sf_dir), "batch_key")


@query(
    "assembly_readiness",
    ddl.with_(_CHAINS)
    + "SELECT section_id // 10 AS batch_key, count(*) FILTER (validated) AS ready_outputs, bool_and(validated) AS is_ready FROM outputs GROUP BY 1",
)
def assembly_readiness(spark, sf_dir):
    return R.readiness(outputs(spark, sf_dir), "batch_key")


@query(
    "output_flags",
    ddl.with_(_CHAINS)
    + """SELECT section_id, validated AS is_successful, status = 'FAILED' AS is_failed, retry_count >= 3 AS is_retry_exhausted,
  NOT done AND retry_count < 3 AND coalesce(failure_category IN ('GENERATION_FAILURE', 'BOUNDS_VIOLATION'), false) AS can_retry FROM outputs""",
)
def output_flags(spark, sf_dir):
    return R.flags(outputs(spark, sf_dir)).select("section_id", "is_successful", "is_failed", "is_retry_exhausted", "can_retry")


@query(
    "generated_responses",
    ddl.with_(ddl.BLOCKS)
    + """SELECT template_version_id, sequence AS section_id, CASE WHEN sequence % 2 = 0
      THEN 'Reply ' || template_version_id || '/' || sequence ELSE 'Generated content for section.' END AS raw_output FROM blocks""",
)
def generated_responses(spark, sf_dir):
    """A response table over the sections of all versions; ids repeat between versions."""
    inputs = T.text_blocks(spark, sf_dir).select("template_version_id", F.col("sequence").alias("section_id"))
    reply = F.concat_ws("/", F.concat(F.lit("Reply "), F.col("template_version_id").cast("string")), F.col("section_id").cast("string"))
    responses = inputs.filter("section_id % 2 = 0").select("template_version_id", "section_id", reply.alias("text"))
    return R.generate(inputs, responses=responses).select("template_version_id", "section_id", "raw_output")


@query(
    "retry_exhausted",
    """SELECT doc_id AS section_id, CASE WHEN doc_id % 3 = 1 THEN 'VALIDATED' WHEN doc_id % 3 = 2 THEN 'RETRYING' ELSE 'FAILED' END AS status,
  CASE doc_id % 3 WHEN 0 THEN 'RETRY_EXHAUSTED' WHEN 2 THEN 'LLM_INVOCATION_FAILED' END AS error_code,
  CASE doc_id % 3 WHEN 0 THEN 'Retry exhausted after 4 attempts: call 3 of ' || doc_id || ' timed out' WHEN 2 THEN 'call 1 of ' || doc_id || ' timed out' END AS error_message,
  CASE doc_id % 3 WHEN 0 THEN 'RETRY_EXHAUSTION' WHEN 2 THEN 'GENERATION_FAILURE' END AS failure_category,
  CASE doc_id % 3 WHEN 2 THEN 2 ELSE 3 END AS retry_count, CASE doc_id % 3 WHEN 2 THEN 2 ELSE 3 END AS past_failures FROM documents""",
)
def retry_exhausted(spark, sf_dir):
    """Chains of four failed calls, of three and then an answer, and of two so far."""
    k, n = F.col("section_id"), F.col("attempt_no")
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section_id"))
    calls = docs.select("section_id", F.explode(F.sequence(F.lit(0), F.when(k % 3 == 2, 1).otherwise(3))).alias("attempt_no")).withColumn("attempt_no", n.cast("bigint"))
    answer = F.lit("The committee read the entry again and found each of its figures in order, so nothing further was asked of anyone.")
    calls = calls.withColumns({
        "llm_ok": (k % 3 == 1) & (n == 3),
        "raw_output": F.when((k % 3 == 1) & (n == 3), answer),
        "llm_error": F.concat(F.lit("call "), n.cast("string"), F.lit(" of "), k.cast("string"), F.lit(" timed out")),
    })
    return R.outcomes(R.judge(calls), "section_id").select(
        "section_id", "status", "error_code", "error_message", "failure_category", "retry_count", F.size("retry_history").alias("past_failures")
    )


@query(
    "input_checks_each",
    ddl.with_(ddl.SECTIONS)
    + """SELECT template_version_id, section_id, ['section_id', 'template_id', 'template_version_id', 'structural_path', 'prompt_config.classification_confidence', NULL][section_id % 6 + 1] AS field,
  ['must be a positive integer', 'must be a valid UUID string', 'must be a valid UUID string', 'cannot be empty', 'must be between 0.0 and 1.0', NULL][section_id % 6 + 1] AS reason,
  [CAST(-section_id AS VARCHAR), 'no uuid', '{bad}', ' ', '1.5', NULL][section_id % 6 + 1] AS value FROM sections""",
)
def input_checks_each(spark, sf_dir):
    """Each of the five checks, and inputs that pass."""
    uuid, m = F.lit("00000000-0000-4000-8000-000000000000"), F.col("number") % 6
    rows = sections(spark, sf_dir).select(F.col("template_version_id").alias("version"), F.col("section_id").alias("number"), "structural_path")
    checked = G.check_input(rows.select(
        "version", "number",
        F.when(m == 0, -F.col("number")).otherwise(F.col("number")).alias("section_id"),
        F.when(m == 1, "no uuid").otherwise(uuid).alias("template_id"),
        F.when(m == 2, "{bad}").otherwise(uuid).alias("template_version_id"),
        F.when(m == 3, " ").otherwise(F.col("structural_path")).alias("structural_path"),
        F.struct(F.when(m == 4, 1.5).otherwise(1.0).alias("classification_confidence")).alias("prompt_config"),
    ))
    error = F.col("input_error")
    return checked.select(
        F.col("version").alias("template_version_id"), F.col("number").alias("section_id"), error["field"].alias("field"), error["reason"].alias("reason"), error["value"].alias("value")
    )
