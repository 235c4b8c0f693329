"""Queries: job log and audit log."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.operators import audit as U
from foliate.operators import classify as C
from foliate.operators import jobs as J
from foliate.operators import versions as N
from foliate.plans import ddl
from foliate.plans.generation import sections
from foliate.plans.registry import query
from foliate.plans.versioning import versions
from foliate.session import scratch_dir, stored
from foliate.sources import tables as T

AS_OF = "2024-01-31 00:00:00"

_EVENTS = """ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'RUNNING'
      WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM events)"""
_JOBS = _EVENTS + """,
jobs AS (
  SELECT event_id AS job_id, (['PARSE', 'CLASSIFY', 'GENERATE', 'REGENERATE', 'REGENERATE_SECTIONS'])[k % 5 + 1] AS job_type, status,
    k::VARCHAR AS document_id, user_id::VARCHAR AS template_version_id, ts AS created_at,
    CASE WHEN status <> 'PENDING' THEN ts + to_seconds(k) END AS started_at,
    CASE WHEN status IN ('COMPLETED', 'FAILED') THEN ts + to_minutes(CAST(k + 1 AS INT)) END AS completed_at,
    CASE WHEN status = 'COMPLETED' THEN k % 7 END AS version_number, CASE WHEN status = 'FAILED' THEN 'error ' || k END AS error
  FROM ev)"""
_LOGS = _EVENTS + """,
logs AS (
  SELECT event_id AS id, (['DOCUMENT', 'DOCUMENT_VERSION', 'GENERATION_BATCH', 'SECTION_OUTPUT'])[k % 4 + 1] AS entity_type, user_id AS entity_id,
    'SECTION_GENERATION_' || CASE status WHEN 'PENDING' THEN 'INITIATED' WHEN 'RUNNING' THEN 'STARTED' ELSE status END AS action,
    k, k % 5 AS version, ts AS "timestamp" FROM ev)"""


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(
    "job_page",
    ddl.with_(_JOBS) + "SELECT job_id, job_type, status FROM jobs WHERE status = 'RUNNING' AND job_type = 'PARSE' ORDER BY created_at DESC, job_id DESC LIMIT 100 OFFSET 100",
)
def job_page(spark, sf_dir):
    return J.listing(T.jobs(spark, sf_dir), "RUNNING", "PARSE", 100, 100).select("job_id", "job_type", "status")


@query("jobs_by_entity", ddl.with_(_JOBS) + "SELECT job_id, job_type, status FROM jobs WHERE template_version_id = '7'")
def jobs_by_entity(spark, sf_dir):
    return J.by_entity(T.jobs(spark, sf_dir), "template_version", 7).select("job_id", "job_type", "status")


@query(
    "jobs_by_entities",
    ddl.with_(_JOBS) + "SELECT job_id, document_id, status FROM jobs WHERE document_id IN (SELECT doc_id::VARCHAR FROM labels)",
)
def jobs_by_entities(spark, sf_dir):
    """Jobs about labelled documents."""
    wanted = T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    return J.by_entities(T.jobs(spark, sf_dir), "document", wanted).select("job_id", "document_id", "status")


@query(
    "job_counts",
    ddl.with_(_JOBS) + "SELECT job_type, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in K.JOB_STATUSES) + " FROM jobs GROUP BY job_type",
)
def job_counts(spark, sf_dir):
    return J.status_counts(T.jobs(spark, sf_dir), "job_type")


@query(
    "stuck_jobs",
    ddl.with_(_JOBS) + f"SELECT job_id, template_version_id, started_at FROM jobs WHERE status = 'RUNNING' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE",
)
def stuck_jobs(spark, sf_dir):
    return J.stuck(T.jobs(spark, sf_dir), _as_of()).select("job_id", J.payload("template_version_id").alias("template_version_id"), "started_at")


@query(
    "stuck_recovery",
    ddl.with_(_JOBS) + f"""SELECT job_id, 'PENDING' AS status, CAST(NULL AS TIMESTAMP) AS started_at, 'Reset: Worker timeout after 30 minutes' AS error
FROM jobs WHERE status = 'RUNNING' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE""",
)
def stuck_recovery(spark, sf_dir):
    return J.recovered(T.jobs(spark, sf_dir), _as_of()).select("job_id", "status", "started_at", "error")


_STAGES = """newest AS (
  SELECT template_version_id, job_type, arg_max(status, (created_at, job_id)) AS status, arg_max(job_id, (created_at, job_id)) AS job_id
  FROM jobs WHERE job_type IN ('PARSE', 'CLASSIFY', 'GENERATE') GROUP BY ALL),
stages AS (
  SELECT template_version_id, max(job_id) FILTER (job_type = 'PARSE') AS parse_job, max(status) FILTER (job_type = 'PARSE') AS p,
    max(status) FILTER (job_type = 'CLASSIFY') AS c, max(status) FILTER (job_type = 'GENERATE') AS g FROM newest GROUP BY 1),
cascade AS (
  SELECT template_version_id, CASE WHEN p = 'FAILED' THEN 'PARSE' WHEN c = 'FAILED' THEN 'CLASSIFY' WHEN g = 'FAILED' THEN 'GENERATE'
    WHEN g = 'COMPLETED' THEN 'COMPLETE' WHEN g IN ('PENDING', 'RUNNING') THEN 'GENERATE' WHEN c = 'COMPLETED' THEN 'READY_FOR_GENERATE'
    WHEN c IN ('PENDING', 'RUNNING') THEN 'CLASSIFY' WHEN p = 'COMPLETED' THEN 'READY_FOR_CLASSIFY' WHEN p IN ('PENDING', 'RUNNING') THEN 'PARSE'
    ELSE 'NOT_STARTED' END AS current_stage, coalesce(p = 'FAILED', false) OR coalesce(c = 'FAILED', false) OR coalesce(g = 'FAILED', false) AS has_failed
  FROM stages)"""


@query(
    "latest_stage_jobs",
    ddl.with_(_JOBS, _STAGES) + "SELECT template_version_id, parse_job, p AS parse_status, c AS classify_status, g AS generate_status FROM stages",
)
def latest_stage_jobs(spark, sf_dir):
    return J.latest_per_stage(T.jobs(spark, sf_dir)).select(
        "template_version_id", F.col("parse.job_id").alias("parse_job"), F.col("parse.status").alias("parse_status"),
        F.col("classify.status").alias("classify_status"), F.col("generate.status").alias("generate_status"),
    )


@query(
    "current_stage",
    ddl.with_(_JOBS, _STAGES) + "SELECT template_version_id, current_stage, current_stage = 'COMPLETE' AS is_complete, has_failed FROM cascade",
)
def current_stage(spark, sf_dir):
    return J.current_stage(J.latest_per_stage(T.jobs(spark, sf_dir)))


@query(
    "ready_documents",
    ddl.with_(_JOBS, _STAGES)
    + """SELECT o_orderkey AS document_id FROM orders WHERE (o_orderkey % 150)::VARCHAR IN
  (SELECT template_version_id FROM cascade WHERE current_stage IN ('READY_FOR_GENERATE', 'GENERATE', 'COMPLETE') AND NOT has_failed)""",
)
def ready_documents(spark, sf_dir):
    requests = T.document_instances(spark, sf_dir).select("document_id", (F.col("document_id") % 150).cast("string").alias("template_version_id"))
    return J.ready_requests(requests, J.current_stage(J.latest_per_stage(T.jobs(spark, sf_dir)))).select("document_id")


@query(
    "next_jobs",
    ddl.with_(_JOBS) + "SELECT job_id AS after_job_id, template_version_id, 'CLASSIFY' AS job_type, 'PENDING' AS status FROM jobs WHERE status = 'COMPLETED' AND job_type = 'PARSE'",
)
def next_jobs(spark, sf_dir):
    return J.next_jobs(T.jobs(spark, sf_dir))


@query(
    "restartable_versions",
    ddl.with_(_JOBS, _STAGES) + "SELECT template_version_id FROM stages WHERE coalesce(p NOT IN ('PENDING', 'RUNNING'), true)",
)
def restartable_versions(spark, sf_dir):
    stages = J.latest_per_stage(T.jobs(spark, sf_dir))
    return J.restartable(stages.select("template_version_id"), stages)


_LAGGED = """changes AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_status FROM ev)"""


@query(
    "illegal_transitions",
    ddl.with_(_EVENTS, _LAGGED)
    + """SELECT user_id AS job_id, event_id, previous_status, status FROM changes WHERE previous_status IS NOT NULL
  AND (previous_status, status) NOT IN (('PENDING', 'RUNNING'), ('PENDING', 'FAILED'), ('RUNNING', 'COMPLETED'), ('RUNNING', 'FAILED'))""",
)
def illegal_transitions(spark, sf_dir):
    return J.illegal_transitions(T.job_events(spark, sf_dir)).select("job_id", "event_id", "previous_status", "status")


@query(
    "transition_counts",
    ddl.with_(_EVENTS, _LAGGED) + "SELECT coalesce(previous_status, 'NONE') AS previous_status, status, count(*) AS changes FROM changes GROUP BY ALL",
)
def transition_counts(spark, sf_dir):
    rows = J.transitions(T.job_events(spark, sf_dir))
    return rows.groupBy(F.coalesce("previous_status", F.lit("NONE")).alias("previous_status"), "status").agg(F.count(F.lit(1)).alias("changes"))


@query(
    "job_flags",
    ddl.with_(_JOBS) + "SELECT job_id, status IN ('COMPLETED', 'FAILED') AS is_terminal, template_version_id AS entity_id FROM jobs",
)
def job_flags(spark, sf_dir):
    return J.with_flags(T.jobs(spark, sf_dir)).select("job_id", "is_terminal", "entity_id")


@query(
    "job_durations",
    ddl.with_(_EVENTS)
    + """SELECT *, (epoch_us(completed_at) - epoch_us(started_at)) // 1000000 AS seconds FROM (
  SELECT user_id AS job_id, min(ts) FILTER (status = 'RUNNING') AS started_at, max(ts) FILTER (status IN ('COMPLETED', 'FAILED')) AS completed_at, count(*) AS events FROM ev GROUP BY 1)""",
)
def job_durations(spark, sf_dir):
    return J.durations(T.job_events(spark, sf_dir))


@query(
    "pending_queue",
    ddl.with_(_JOBS) + "SELECT job_id, job_type FROM jobs WHERE status = 'PENDING' AND job_type IN ('PARSE', 'CLASSIFY') ORDER BY created_at, job_id LIMIT 100",
)
def pending_queue(spark, sf_dir):
    return J.pending_queue(T.jobs(spark, sf_dir), 100, ["PARSE", "CLASSIFY"]).select("job_id", "job_type")


def _versions_with_names(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("template_version_id"), F.col("source").alias("template_name")
    )


@query(
    "job_board",
    ddl.with_(_JOBS)
    + """SELECT job_id, job_type, status, coalesce(d.source, 'Unknown Template') AS template_name,
  CASE status WHEN 'COMPLETED' THEN 100 WHEN 'RUNNING' THEN 50 WHEN 'FAILED' THEN 20 ELSE 0 END AS progress, document_id, version_number, error
FROM jobs LEFT JOIN documents d ON d.doc_id::VARCHAR = template_version_id""",
)
def job_board(spark, sf_dir):
    names = _versions_with_names(spark, sf_dir)
    templates = T.table(spark, sf_dir, "documents").select(F.col("source").alias("template_id")).distinct().withColumn("template_name", F.col("template_id"))
    return J.board(T.jobs(spark, sf_dir), names, templates)


@query(
    "board_counters",
    ddl.with_(_JOBS)
    + """SELECT job_type, count(*) AS total_jobs, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'RUNNING') AS running,
  count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status IN ('PENDING', 'RUNNING')) AS pending_or_running FROM jobs GROUP BY job_type""",
)
def board_counters(spark, sf_dir):
    return J.counters(T.jobs(spark, sf_dir), "job_type")


@query(
    "template_cards",
    ddl.with_(ddl.SECTIONS, ddl.VERSIONS, _JOBS, """latest AS (SELECT template_id, arg_max(template_version_id, version_number) AS tv, max(version_number) AS version FROM versions GROUP BY 1),
states AS (SELECT template_version_id, bool_or(status = 'FAILED') AS failed, bool_or(status = 'RUNNING') AS running, bool_and(status = 'COMPLETED') AS done FROM jobs GROUP BY 1),
counted AS (SELECT template_version_id, count(*) AS n, count(*) FILTER (section_type = 'STATIC') AS s, count(*) FILTER (section_type = 'DYNAMIC') AS d FROM sections GROUP BY 1)""")
    + """SELECT l.template_id, l.tv AS template_version_id, l.version,
  CASE WHEN st.failed THEN 'error' WHEN st.running THEN 'analyzing' WHEN st.done OR l.tv % 3 = 0 THEN 'ready' WHEN l.tv % 3 = 1 THEN 'analyzing' ELSE 'pending' END AS status,
  coalesce(c.n, 0) AS sections, coalesce(c.s, 0) AS static_sections, coalesce(c.d, 0) AS dynamic_sections
FROM latest l LEFT JOIN states st ON st.template_version_id = l.tv::VARCHAR LEFT JOIN counted c ON c.template_version_id = l.tv""",
)
def template_cards(spark, sf_dir):
    v = T.template_versions(spark, sf_dir)
    m = F.col("template_version_id") % 3
    parsed = v.withColumn("parsing_status", F.when(m == 0, "COMPLETED").when(m == 1, "IN_PROGRESS").otherwise("PENDING"))
    templates = T.table(spark, sf_dir, "documents").select(F.col("source").alias("template_id")).distinct()
    counts = C.stored_statistics(sections(spark, sf_dir), "template_version_id").select(
        "template_version_id", "total_sections", "static_sections", "dynamic_sections"
    )
    return J.template_cards(templates, parsed, T.jobs(spark, sf_dir), counts)


@query(
    "document_counters",
    """WITH stored AS (SELECT source AS document_id, count(DISTINCT sha256(text)) AS n FROM documents GROUP BY 1)
SELECT 'src' || (o_orderkey % 20) AS template_name, count(*) AS documents, sum(coalesce(s.n, 0))::BIGINT AS total_versions,
  count(*) FILTER (s.n > 0) AS ready_to_download
FROM orders LEFT JOIN stored s ON s.document_id = 'src' || (o_orderkey % 21) GROUP BY 1""",
)
def document_counters(spark, sf_dir):
    """Documents by template; each shows the versions stored under a source name, some of which do not exist."""
    v = stored(versions(spark, sf_dir).select("document_id", "version_number"), "versions")
    docs = T.document_instances(spark, sf_dir).select(
        F.concat(F.lit("src"), (F.col("document_id") % 21).cast("string")).alias("stored_as"), "template_id"
    )
    names = v.select(F.col("document_id").alias("template_version_id")).distinct().select(
        "template_version_id", F.col("template_version_id").alias("template_name"), F.lit(1).alias("version_number")
    )
    rows = docs.join(N.current_versions(v).withColumnRenamed("document_id", "stored_as"), "stored_as", "left").select(
        F.col("stored_as").alias("document_id"), F.col("template_id").alias("template_version_id"),
        F.coalesce("current_version", F.lit(0)).alias("current_version"),
    )
    return J.document_counters(J.document_cards(rows, names, v), "template_name")


_RUNS = """run_stages AS (
  SELECT o_orderkey AS run_id, unnest([1, 2, 3, 4, 5]) AS n FROM orders),
outcome AS (
  SELECT run_id, n, (run_id * 7 + n * 3) % 11 <> 0 AS ok FROM run_stages),
folded AS (SELECT run_id, min(n) FILTER (NOT ok) AS failed FROM outcome GROUP BY 1)"""


@query(
    "run_outcome",
    ddl.with_(_RUNS)
    + """SELECT run_id, failed IS NULL AS success, names[failed] AS failed_stage, coalesce(names[failed], 'COMPLETED') AS current_stage,
  CASE WHEN failed IS NOT NULL THEN names[failed] || ' failed' END AS error, """
    + ", ".join(f"CASE WHEN coalesce(failed, 6) > {i + 1} THEN run_id || '-{i + 1}' END AS {s.lower()}_id" for i, s in enumerate(K.RUN_STAGES))
    + f" FROM folded, (SELECT {list(K.RUN_STAGES)} AS names)",
)
def run_outcome(spark, sf_dir):
    """Five stages per order, each failing for some keys; rows exist for all stages, also after a failure."""
    stages = F.array(*[F.struct(F.lit(i + 1).alias("n"), F.lit(s).alias("stage")) for i, s in enumerate(K.RUN_STAGES)])
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.inline(stages))
    ok = (F.col("run_id") * 7 + F.col("n") * 3) % 11 != 0
    return J.run_outcomes(rows.select(
        "run_id", "stage", ok.alias("ok"),
        F.concat(F.col("run_id").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("artifact"),
        F.when(~ok, F.concat("stage", F.lit(" failed"))).alias("error"),
    ))


# --- audit ------------------------------------------------------------------------------------
@query(
    "audit_search",
    ddl.with_(_LOGS)
    + """SELECT id, entity_id, action, "timestamp" FROM logs WHERE entity_type = 'DOCUMENT' AND action = 'SECTION_GENERATION_COMPLETED'
  AND "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY "timestamp" DESC, id DESC LIMIT 100 OFFSET 10""",
)
def audit_search(spark, sf_dir):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    rows = U.search(
        T.audit_logs(spark, sf_dir), "DOCUMENT", action="SECTION_GENERATION_COMPLETED",
        since=day("2024-01-05 00:00:00"), until=day("2024-01-20 00:00:00"), skip=10, limit=100,
    )
    return rows.select("id", "entity_id", "action", "timestamp")


@query("audit_by_job", ddl.with_(_LOGS) + "SELECT id, entity_type, action FROM logs WHERE entity_id = 3")
def audit_by_job(spark, sf_dir):
    return U.by_key(T.audit_logs(spark, sf_dir), "job_id", 3, limit=None).select("id", "entity_type", "action")


@query(
    "audit_by_keys",
    ddl.with_(_LOGS) + "SELECT id, k::VARCHAR AS document_id, action FROM logs WHERE k IN (SELECT doc_id FROM labels)",
)
def audit_by_keys(spark, sf_dir):
    """Audit rows of labelled documents."""
    wanted = T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    return U.by_keys(T.audit_logs(spark, sf_dir), "document_id", wanted).select("id", "document_id", "action")


@query("audit_by_version", ddl.with_(_LOGS) + "SELECT id, entity_type, action FROM logs WHERE k = 42 AND version = 2")
def audit_by_version(spark, sf_dir):
    return U.by_version(T.audit_logs(spark, sf_dir), 42, 2, limit=None).select("id", "entity_type", "action")


@query(
    "audit_lookups",
    ddl.with_(_LOGS)
    + """SELECT 'job' AS lookup, id, action FROM logs WHERE entity_id = 3 UNION ALL SELECT 'version', id, action FROM logs WHERE k = 42 AND version = 2
UNION ALL SELECT 'documents', id, action FROM logs WHERE k IN (SELECT doc_id FROM labels)""",
)
def audit_lookups(spark, sf_dir):
    """The three lookups on a log that is written with its metadata keys as columns."""
    path = scratch_dir(spark, "audit-log")
    U.write_log(T.audit_logs(spark, sf_dir), path)
    log = spark.read.parquet(path)
    wanted = T.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"))
    found = {"job": U.stored_by_key(log, "job_id", 3), "version": U.stored_by_version(log, 42, 2), "documents": U.stored_by_keys(log, "document_id", wanted)}
    out = None
    for name, rows in found.items():
        rows = rows.select(F.lit(name).alias("lookup"), "id", "action")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "audit_versions",
    ddl.with_(_LOGS) + "SELECT k::VARCHAR AS document_id, version AS version_number, count(*) AS rows FROM logs GROUP BY ALL",
)
def audit_versions(spark, sf_dir):
    return U.promote(T.audit_logs(spark, sf_dir)).groupBy("document_id", "version_number").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "audit_gaps",
    ddl.with_(_LOGS)
    + """SELECT entity_id, id, gap_seconds FROM (SELECT entity_id, id, (epoch_us("timestamp") - epoch_us(lag("timestamp") OVER (PARTITION BY entity_id ORDER BY "timestamp", id))) // 1000000 AS gap_seconds FROM logs)
WHERE gap_seconds > 86400""",
)
def audit_gaps(spark, sf_dir):
    return U.gaps(T.audit_logs(spark, sf_dir), ["entity_id"], 24 * 60).select("entity_id", "id", "gap_seconds")


@query(
    "audit_out_of_order",
    ddl.with_(_LOGS)
    + """SELECT entity_id, id FROM (SELECT *, lag(shifted) OVER (PARTITION BY entity_id ORDER BY id) AS before FROM (
  SELECT *, "timestamp" - to_minutes(CAST(k * 10 AS INT)) AS shifted FROM logs)) WHERE shifted < before""",
)
def audit_out_of_order(spark, sf_dir):
    """Logs whose stamps lag by up to a day, so that some entities run backwards."""
    logs = T.audit_logs(spark, sf_dir)
    late = F.make_dt_interval(mins=(U.meta("document_id").cast("int") * 10))
    return U.out_of_order(logs.withColumn("timestamp", F.col("timestamp") - late)).select("entity_id", "id")


@query(
    "audit_unstarted",
    ddl.with_(_LOGS)
    + """SELECT entity_id, entity_type, completed FROM (SELECT entity_id, entity_type, min("timestamp") FILTER (action LIKE '%\\_STARTED' ESCAPE '\\') AS started,
  min("timestamp") FILTER (action LIKE '%\\_COMPLETED' ESCAPE '\\') AS completed FROM logs GROUP BY ALL) WHERE completed IS NOT NULL AND (started IS NULL OR started > completed)""",
)
def audit_unstarted(spark, sf_dir):
    return U.completed_before_started(T.audit_logs(spark, sf_dir), "entity_id", "entity_type").select("entity_id", "entity_type", "completed")


@query(
    "audit_duplicates",
    ddl.with_(_LOGS) + "SELECT entity_id, k::VARCHAR AS document_id, action, count(*) AS rows FROM logs GROUP BY ALL HAVING count(*) > 1",
)
def audit_duplicates(spark, sf_dir):
    logs = U.promote(T.audit_logs(spark, sf_dir))
    return U.duplicates(logs, "entity_id", "document_id", "action")


@query(
    "unaudited_jobs",
    ddl.with_(_JOBS) + "SELECT job_id FROM jobs WHERE status = 'COMPLETED' AND job_id NOT IN (SELECT user_id FROM ev WHERE status = 'COMPLETED')",
)
def unaudited_jobs(spark, sf_dir):
    return U.unaudited_jobs(T.jobs(spark, sf_dir), T.audit_logs(spark, sf_dir)).select("job_id")


@query(
    "audit_emitted",
    ddl.with_(ddl.SECTIONS)
    + """SELECT 'template_version' AS entity_type, template_version_id::VARCHAR AS entity_id, 'sections_classified' AS action,
  '{"total_sections":' || count(*) || ',"static_sections":' || count(*) FILTER (section_type = 'STATIC') || ',"dynamic_sections":' || count(*) FILTER (section_type = 'DYNAMIC')
  || ',"high_confidence_count":' || count(*) FILTER (confidence_level = 'high') || ',"rule_based_count":' || count(*) FILTER (method = 'rule_based')
  || ',"llm_assisted_count":0,"fallback_count":' || count(*) FILTER (method = 'fallback') || '}' AS metadata FROM sections GROUP BY template_version_id""",
)
def audit_emitted(spark, sf_dir):
    stats = C.batch_statistics(sections(spark, sf_dir), "template_version_id").drop("success_rate")
    return U.emit(stats, "sections_classified", "template_version_id")


@query(
    "dataset_checks",
    ddl.with_(ddl.SECTIONS, _EVENTS)
    + """SELECT * FROM (
  SELECT 'template_exists' AS "check", (SELECT count(DISTINCT source) FROM documents) AS found UNION ALL
  SELECT 'template_version_exists', (SELECT count(*) FROM documents) UNION ALL
  SELECT 'template_parsed', (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) UNION ALL
  SELECT 'document_exists', (SELECT count(*) FROM orders) UNION ALL SELECT 'document_has_version', 0 UNION ALL
  SELECT 'sections_exist', (SELECT count(*) FROM sections) UNION ALL
  SELECT 'dynamic_sections_exist', (SELECT count(*) FROM sections WHERE section_type = 'DYNAMIC') UNION ALL
  SELECT 'jobs_completed', (SELECT count(*) FROM ev WHERE status = 'COMPLETED')), LATERAL (SELECT found > 0 AS passed, CASE WHEN found = 0 THEN 'Document has no version' END AS error)""",
)
def dataset_checks(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents")
    v = docs.select(F.when(F.col("doc_id") % 2 == 0, "COMPLETED").otherwise("PENDING").alias("parsing_status"))
    instances = T.document_instances(spark, sf_dir).withColumn("current_version", F.lit(0))
    return U.dataset_checks(docs.select("source").distinct(), v, instances, sections(spark, sf_dir), T.jobs(spark, sf_dir))


@query(
    "error_catalogue",
    ddl.with_(_EVENTS, "catalogue(error_code, category, severity, recovery_action, is_retryable) AS (VALUES "
      + ", ".join(f"({ddl.text(a)}, {ddl.text(b)}, {ddl.text(c)}, {ddl.text(d)}, {str(e).lower()})" for a, b, c, d, e in K.ERROR_CATALOGUE) + ")")
    + f"""SELECT error_code, category, severity, recovery_action, is_retryable, count(*) AS failures FROM
  (SELECT ({[c[0] for c in K.ERROR_CATALOGUE] + ['SOMETHING_ELSE']})[k % 11 + 1] AS error_code FROM ev WHERE status = 'FAILED') LEFT JOIN catalogue USING (error_code) GROUP BY ALL""",
)
def error_catalogue(spark, sf_dir):
    """Failed jobs by catalogued error; one code is not in the catalogue."""
    codes = F.array(*[F.lit(c[0]) for c in K.ERROR_CATALOGUE], F.lit("SOMETHING_ELSE"))
    failed = T.jobs(spark, sf_dir).filter("status = 'FAILED'").select(
        F.get(codes, (J.payload("document_id").cast("int") % 11)).alias("error_code")
    )
    rows = U.with_error_details(failed.groupBy("error_code").agg(F.count(F.lit(1)).alias("failures")), U.error_catalogue(spark))
    return rows.select("error_code", "category", "severity", "recovery_action", "is_retryable", "failures")
