"""Queries: versions and regeneration."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions.text import sha
from foliate.operators import regenerate as X
from foliate.operators import versions as N
from foliate.plans import ddl
from foliate.plans.generation import sections
from foliate.plans.registry import query
from foliate.session import stored
from foliate.sources import tables as T

# --- versions ---------------------------------------------------------------------------------
_PLACED = """hashed AS (SELECT source AS document_id, doc_id AS arrival, text, sha256(text) AS content_hash FROM documents),
firsts AS (SELECT document_id, content_hash, min(arrival) AS first_arrival FROM hashed GROUP BY ALL),
numbers AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first_arrival) AS version_number FROM firsts),
placed AS (
  SELECT h.document_id, h.arrival, h.content_hash, h.text, n.version_number, h.arrival <> n.first_arrival AS is_duplicate
  FROM hashed h JOIN numbers n USING (document_id, content_hash))"""


def _arrivals(spark, sf_dir):
    """Hashed once and stored: placing versions reads its arrivals several times, the texts are read here only."""
    rows = T.documents(spark, sf_dir).select(
        F.col("source").alias("document_id"), F.col("doc_id").alias("arrival"), sha("text").alias("content_hash")
    )
    return stored(rows, "arrivals")


def versions(spark, sf_dir):
    return N.new_versions(N.place_arrivals(_arrivals(spark, sf_dir)))


@query(
    "template_versions",
    ddl.with_(ddl.VERSIONS) + "SELECT template_id, template_version_id, content_hash, version_number FROM versions",
)
def template_versions(spark, sf_dir):
    return T.template_versions(spark, sf_dir)


@query("version_dedupe", ddl.with_(_PLACED) + "SELECT document_id, arrival, content_hash, version_number, is_duplicate FROM placed")
def version_dedupe(spark, sf_dir):
    return N.place_arrivals(_arrivals(spark, sf_dir))


@query(
    "version_append",
    ddl.with_(_PLACED, """stored AS (SELECT DISTINCT document_id, content_hash, version_number FROM placed WHERE NOT is_duplicate AND arrival % 3 = 0),
base AS (SELECT document_id, max(version_number) AS top FROM stored GROUP BY 1),
fresh AS (SELECT f.*, row_number() OVER (PARTITION BY f.document_id ORDER BY first_arrival) AS r FROM firsts f
  WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.document_id = f.document_id AND s.content_hash = f.content_hash)),
numbered AS (SELECT f.document_id, f.content_hash, f.first_arrival, f.r + coalesce(b.top, 0) AS version_number, true AS is_new FROM fresh f LEFT JOIN base b USING (document_id)
  UNION ALL SELECT s.document_id, s.content_hash, f.first_arrival, s.version_number, false FROM stored s JOIN firsts f USING (document_id, content_hash))""")
    + """SELECT h.document_id, h.arrival, n.version_number, NOT (n.is_new AND h.arrival = n.first_arrival) AS is_duplicate
FROM hashed h JOIN numbered n USING (document_id, content_hash)""",
)
def version_append(spark, sf_dir):
    """The same arrivals again, onto a store that holds a part of the versions."""
    arrivals = _arrivals(spark, sf_dir)
    before = N.place_arrivals(arrivals).filter(~F.col("is_duplicate") & (F.col("arrival") % 3 == 0))
    before = before.select("document_id", "content_hash", "version_number")
    return N.place_arrivals(arrivals, before).select("document_id", "arrival", "version_number", "is_duplicate")


@query(
    "next_version",
    ddl.with_(_PLACED) + "SELECT document_id, max(version_number) + 1 AS next_version FROM placed GROUP BY document_id",
)
def next_version(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"))
    return N.next_numbers(versions(spark, sf_dir), docs)


@query(
    "version_history",
    ddl.with_(_PLACED)
    + """SELECT document_id, version_number, content_hash, 'documents/' || document_id || '/' || version_number || '/output.docx' AS output_path,
  count(*) OVER (PARTITION BY document_id) AS total_versions, max(version_number) OVER (PARTITION BY document_id) AS current_version
FROM placed WHERE NOT is_duplicate""",
)
def version_history(spark, sf_dir):
    return N.history(versions(spark, sf_dir)).select(
        "document_id", "version_number", "content_hash", "output_path", "total_versions", "current_version"
    )


@query(
    "version_integrity",
    ddl.with_(_PLACED) + "SELECT document_id, version_number, arrival % 4 NOT IN (0, 1) AS is_intact FROM placed WHERE NOT is_duplicate",
)
def version_integrity(spark, sf_dir):
    """Stored contents of which some are lost and some altered."""
    v = versions(spark, sf_dir).select("document_id", "version_number", "content_hash", "arrival")
    texts = T.documents(spark, sf_dir).select(F.col("doc_id").alias("arrival"), "text")
    m = F.col("arrival") % 4
    contents = v.join(texts, "arrival").filter(m != 0).select(
        "document_id", "version_number", F.when(m == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")
    )
    return N.integrity(v, contents).select("document_id", "version_number", "is_intact")


@query(
    "duplicate_numbers",
    "SELECT source AS document_id, CAST(doc_id % 7 AS BIGINT) AS version_number, count(*) AS rows FROM documents GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_numbers(spark, sf_dir):
    rows = T.table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), (F.col("doc_id") % 7).alias("version_number"))
    return N.duplicate_numbers(rows, "document_id", "version_number")


@query("version_counts", ddl.with_(_PLACED) + "SELECT document_id, count(*) AS versions FROM placed WHERE NOT is_duplicate GROUP BY document_id")
def version_counts(spark, sf_dir):
    return N.version_counts(versions(spark, sf_dir))


@query(
    "existing_versions",
    ddl.with_(_PLACED)
    + """SELECT source AS document_id, 3 * doc_id AS version_number FROM documents d
WHERE EXISTS (SELECT 1 FROM placed p WHERE NOT p.is_duplicate AND p.document_id = d.source AND p.version_number = 3 * d.doc_id)""",
)
def existing_versions(spark, sf_dir):
    """Of three times each document's id as a version number, those that its source has."""
    wanted = T.table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), (3 * F.col("doc_id")).alias("version_number"))
    return N.existing_versions(wanted, versions(spark, sf_dir))


@query(
    "latest_template_version",
    ddl.with_(ddl.VERSIONS) + "SELECT template_id, max(version_number) AS version_number, max(template_version_id) AS template_version_id FROM versions GROUP BY template_id",
)
def latest_template_version(spark, sf_dir):
    return N.latest_template_versions(T.template_versions(spark, sf_dir)).select("template_id", "version_number", "template_version_id")


@query(
    "asof_template",
    """WITH switches AS (SELECT source AS template_id, doc_id AS template_version_id, TIMESTAMP '1992-01-01' + to_hours(CAST(doc_id * 6 AS INT)) AS effective_at FROM documents),
docs AS (SELECT o_orderkey AS document_id, 'src' || (o_orderkey % 20) AS template_id, o_orderdate AS created_at FROM orders)
SELECT d.document_id, d.template_id, s.template_version_id FROM docs d ASOF LEFT JOIN switches s
  ON d.template_id = s.template_id AND d.created_at >= s.effective_at""",
)
def asof_template(spark, sf_dir):
    start = F.lit("1992-01-01 00:00:00").cast("timestamp_ntz")
    switches = T.table(spark, sf_dir, "documents").select(
        F.col("source").alias("template_id"),
        F.col("doc_id").alias("template_version_id"),
        (start + F.make_dt_interval(hours=(F.col("doc_id") * 6).cast("int"))).alias("effective_at"),
    )
    docs = T.document_instances(spark, sf_dir).select("document_id", "template_id", "created_at")
    return N.template_as_of(docs, switches, "created_at").select("document_id", "template_id", "template_version_id")


@query(
    "parsing_state",
    """SELECT user_id AS template_version_id, arg_max(status, {'t': ts, 'e': event_id}) AS parsing_status,
  CASE WHEN arg_max(status, {'t': ts, 'e': event_id}) = 'COMPLETED' THEN 'templates/' || user_id || '/parsed.json' END AS parsed_path
FROM (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'IN_PROGRESS' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM events) GROUP BY user_id""",
)
def parsing_state(spark, sf_dir):
    e = T.job_events(spark, sf_dir)
    status = F.when(F.col("status") == "RUNNING", "IN_PROGRESS").otherwise(F.col("status"))
    rows = e.select(
        F.col("job_id").alias("template_version_id"), "event_id", status.alias("status"), "ts",
        F.concat(F.lit("templates/"), F.col("job_id").cast("string"), F.lit("/parsed.json")).alias("parsed_path"),
        F.lit(None).cast("string").alias("content_hash"),
    )
    return N.parsing_state(rows).select("template_version_id", "parsing_status", "parsed_path")


# --- regeneration -----------------------------------------------------------------------------
DOC = "document_id"


def _request(spark, sf_dir):
    """Sections, targets, previous outputs and client data of every document, derived from its id."""
    rows = sections(spark, sf_dir).select(F.col("template_version_id").alias(DOC), "section_id", "section_type")
    s = stored(rows, "sections")
    dynamic = s.filter(F.col("section_type") == "DYNAMIC").select(DOC, "section_id")
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias(DOC))

    def client(tier):
        name = F.concat(F.lit("c"), (F.col(DOC) % 150).cast("string"))
        return F.create_map(F.lit("tier"), tier, F.lit("client"), name)

    override = F.when(F.col("section_id") % 5 == 0, F.create_map(F.lit("tier"), F.lit("special")))
    targets = dynamic.filter(F.col("section_id") % 3 == 0).select(
        DOC, "section_id", F.lit(0).alias("pos"), (F.col("section_id") % 2 == 0).alias("force"), override.alias("override")
    ).unionByName(
        docs.filter(F.col(DOC) % 13 == 0).select(
            DOC, F.lit(0).cast("bigint").alias("section_id"), F.lit(1).alias("pos"), F.lit(False).alias("force"),
            F.lit(None).cast("map<string,string>").alias("override"),
        )
    )
    previous = dynamic.filter(F.col(DOC) % 11 != 0).select(
        DOC, "section_id",
        X.fingerprint(F.col("section_id"), client(F.lit("old"))).alias("input_hash"),
        sha(F.concat(F.lit("old "), F.col("section_id").cast("string"))).alias("content_hash"),
        F.concat(F.lit("old "), F.col("section_id").cast("string")).alias("generated_content"),
    )
    data = docs.select(DOC, client(F.when(F.col(DOC) % 4 == 0, "new").otherwise("old")).alias("client_data"))
    return s, targets, previous, data


def _plan(spark, sf_dir):
    return X.plan(*_request(spark, sf_dir))


_PLANNED = """dyn AS (SELECT template_version_id AS document_id, section_id FROM sections WHERE section_type = 'DYNAMIC'),
planned AS (
  SELECT document_id, section_id,
    CASE WHEN section_id % 3 = 0 AND (section_id % 2 = 0 OR document_id % 11 = 0 OR section_id % 5 = 0 OR document_id % 4 = 0)
      THEN 'regenerate' ELSE 'reuse' END AS action,
    sha256('{"client_data":{"client":"c' || (document_id % 150) || '","tier":"' ||
      CASE WHEN section_id % 3 = 0 AND section_id % 5 = 0 THEN 'special' WHEN document_id % 4 = 0 THEN 'new' ELSE 'old' END
      || '"},"section_id":' || section_id || '}') AS new_input_hash,
    CASE WHEN document_id % 11 <> 0 THEN sha256('old ' || section_id) END AS previous_content_hash
  FROM dyn WHERE document_id % 13 <> 0)"""


@query("regen_plan", ddl.with_(ddl.SECTIONS, _PLANNED) + "SELECT * FROM planned")
def regen_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(
    "regen_plan_forced",
    ddl.with_(ddl.SECTIONS, _PLANNED)
    + "SELECT document_id, section_id, CASE WHEN section_id % 3 = 0 THEN 'regenerate' ELSE 'reuse' END AS action FROM planned",
)
def regen_plan_forced(spark, sf_dir):
    """Every target anew, changed or not."""
    return X.plan(*_request(spark, sf_dir), force_all=True).select(DOC, "section_id", "action")


@query(
    "regen_statuses",
    ddl.with_(ddl.BLOCKS, """r AS (SELECT template_version_id AS d, sequence AS s, template_version_id % 3 = 2 OR (template_version_id % 3 = 1 AND sequence % 2 = 1) AS bad FROM blocks)""")
    + """SELECT d AS document_id, count(*) FILTER (NOT bad) AS sections_regenerated, CAST(0 AS BIGINT) AS sections_reused, count(*) FILTER (bad) AS sections_failed,
  CASE WHEN bool_and(bad) THEN 'FAILED' WHEN bool_or(bad) THEN 'PARTIALLY_COMPLETED' ELSE 'COMPLETED' END AS status FROM r GROUP BY d""",
)
def regen_statuses(spark, sf_dir):
    """Results in which nothing, every second section or everything has failed."""
    d, n = F.col("template_version_id"), F.col("sequence")
    bad = (d % 3 == 2) | ((d % 3 == 1) & (n % 2 == 1))
    results = T.text_blocks(spark, sf_dir).select(
        d.alias(DOC), (~bad).alias("was_regenerated"), F.lit(False).alias("was_reused"), F.when(bad, "model does not answer").alias("error")
    )
    return X.result_status(results)


@query(
    "regen_target_errors",
    "SELECT doc_id AS document_id, CAST(0 AS BIGINT) AS section_id, 'SECTION_NOT_FOUND' AS error_code FROM documents WHERE doc_id % 13 = 0",
)
def regen_target_errors(spark, sf_dir):
    s, targets, _, _ = _request(spark, sf_dir)
    return X.target_errors(targets, s)


@query(
    "regen_static_targets",
    ddl.with_(ddl.BLOCKS)
    + """SELECT template_version_id AS document_id, sequence AS section_id, 'STATIC_SECTION' AS error_code FROM blocks WHERE sequence % 5 = 0 AND sequence % 3 = 0
UNION ALL SELECT DISTINCT template_version_id, 1000000 + template_version_id, 'SECTION_NOT_FOUND' FROM blocks WHERE template_version_id % 7 = 0""",
)
def regen_static_targets(spark, sf_dir):
    """Every fifth section as target, of which every third is static, and targets that do not exist."""
    kind = F.when(F.col("sequence") % 3 == 0, "STATIC").otherwise("DYNAMIC").alias("section_type")
    rows = T.text_blocks(spark, sf_dir).select(F.col("template_version_id").alias("document_id"), F.col("sequence").alias("section_id"), kind)
    unknown = rows.filter("document_id % 7 = 0").select("document_id", (F.col("document_id") + 1_000_000).alias("section_id")).distinct()
    targets = rows.filter("section_id % 5 = 0").select("document_id", "section_id").unionByName(unknown)
    return X.target_errors(targets, rows)


@query(
    "regen_results",
    ddl.with_(ddl.SECTIONS, _PLANNED)
    + """SELECT document_id, section_id, action = 'regenerate' AS was_regenerated, action = 'reuse' AS was_reused, previous_content_hash,
  CASE WHEN action = 'reuse' THEN previous_content_hash END AS new_content_hash FROM planned""",
)
def regen_results(spark, sf_dir):
    return X.section_results(_plan(spark, sf_dir)).drop("error")


@query(
    "regen_status",
    ddl.with_(ddl.SECTIONS, _PLANNED)
    + """SELECT document_id, count(*) FILTER (action = 'regenerate') AS sections_regenerated, count(*) FILTER (action = 'reuse') AS sections_reused,
  0 AS sections_failed, 'COMPLETED' AS status FROM planned GROUP BY document_id""",
)
def regen_status(spark, sf_dir):
    return X.result_status(X.section_results(_plan(spark, sf_dir)))


@query(
    "regen_full",
    ddl.with_(ddl.SECTIONS)
    + """SELECT template_version_id AS document_id, count(*) AS sections_regenerated, 0 AS sections_reused, 0 AS sections_failed, 'COMPLETED' AS status,
  CASE WHEN template_version_id % 2 = 0 THEN 4 END AS previous_version_number, CASE WHEN template_version_id % 2 = 0 THEN 5 ELSE 1 END AS new_version_number
FROM sections WHERE section_type = 'DYNAMIC' GROUP BY template_version_id""",
)
def regen_full(spark, sf_dir):
    s = sections(spark, sf_dir).withColumn(DOC, F.col("template_version_id"))
    stored = T.table(spark, sf_dir, "documents").filter(F.col("doc_id") % 2 == 0).select(
        F.col("doc_id").alias(DOC), F.lit(4).alias("version_number")
    )
    return X.full(s, stored)


def _updates(spark, sf_dir):
    """Every document moves to the version twenty ids on; the last twenty name one that does not exist."""
    return T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(DOC), F.col("doc_id").alias("old_version"), (F.col("doc_id") + 20).alias("new_version")
    )


@query(
    "template_update",
    ddl.with_(ddl.SECTIONS)
    + """SELECT d.doc_id AS document_id, d.doc_id AS old_version, d.doc_id + 20 AS new_version, coalesce(s.n, 0) AS sections_regenerated,
  CASE WHEN v.doc_id IS NULL THEN 'TEMPLATE_VERSION_NOT_FOUND' END AS error_code
FROM documents d LEFT JOIN documents v ON v.doc_id = d.doc_id + 20
LEFT JOIN (SELECT template_version_id, count(*) AS n FROM sections WHERE section_type = 'DYNAMIC' GROUP BY 1) s ON s.template_version_id = d.doc_id + 20""",
)
def template_update(spark, sf_dir):
    known = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("template_version_id"))
    return X.template_update(_updates(spark, sf_dir), known, sections(spark, sf_dir))


@query(
    "template_diff",
    ddl.with_(ddl.SECTIONS)
    + """, o AS (SELECT template_version_id AS document_id, structural_path, section_type AS old_type FROM sections),
n AS (SELECT template_version_id - 20 AS document_id, structural_path, section_type AS new_type FROM sections WHERE template_version_id >= 20)
SELECT document_id, structural_path, old_type, new_type, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed'
  WHEN old_type <> new_type THEN 'retyped' ELSE 'kept' END AS change FROM o FULL JOIN n USING (document_id, structural_path)""",
)
def template_diff(spark, sf_dir):
    return X.template_diff(_updates(spark, sf_dir), sections(spark, sf_dir))


@query(
    "reuse_merge",
    ddl.with_(ddl.SECTIONS, _PLANNED)
    + """SELECT document_id, section_id, CASE WHEN action = 'regenerate' THEN 'new ' || section_id WHEN document_id % 11 <> 0 THEN 'old ' || section_id END AS generated_content,
  action = 'reuse' AND document_id % 11 <> 0 AS is_reused FROM planned""",
)
def reuse_merge(spark, sf_dir):
    s, targets, previous, data = _request(spark, sf_dir)
    planned = X.plan(s, targets, previous, data)
    fresh = planned.filter("action = 'regenerate'").select(
        DOC, "section_id", F.concat(F.lit("new "), F.col("section_id").cast("string")).alias("generated_content")
    )
    return X.merge_reused(fresh, planned, previous)


@query(
    "regen_transitions",
    ddl.with_(ddl.SECTIONS, _PLANNED)
    + """SELECT document_id, CAST(NULL AS INT) AS old_version_number, 1 AS new_version_number, '00000000-0000-0000-0000-000000000000' AS new_version_id,
  'SECTION' AS scope, 'CONTENT_UPDATE' AS intent, coalesce(string_agg(section_id::VARCHAR, ',' ORDER BY section_id) FILTER (action = 'regenerate'), '') AS regenerated,
  count(*) FILTER (action = 'reuse') AS reused, document_id::VARCHAR AS template_version_id FROM planned GROUP BY document_id""",
)
def regen_transitions(spark, sf_dir):
    """The audit rows of a plan, read back as typed transitions."""
    planned = _plan(spark, sf_dir)
    none = spark.createDataFrame([], "document_id bigint, version_number int")
    results = X.result_status(X.section_results(planned), none)
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias(DOC), F.col("doc_id").alias("template_version_id"))
    rows = X.transitions(X.audit_rows(planned, results, docs))
    return rows.select(
        DOC, "old_version_number", "new_version_number", "new_version_id", "scope", "intent",
        F.array_join(F.transform("regenerated_section_ids", lambda i: i.cast("string")), ",").alias("regenerated"),
        F.size("reused_section_ids").cast("bigint").alias("reused"), "template_version_id",
    )
