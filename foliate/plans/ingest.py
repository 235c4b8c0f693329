"""Queries: files, artefacts, logs and streams."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from foliate.operators import blocks as B
from foliate.operators import jobs as J
from foliate.plans import ddl
from foliate.plans.operations import _EVENTS, _JOBS
from foliate.plans.registry import query
from foliate.sources import docx, files
from foliate.sources import tables as T
from foliate.streaming import events as S

_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _pack(text: str) -> bytes:
    """A minimal word-processor file with one paragraph per line."""
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("[Content_Types].xml", "<Types/>")
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{_WORD}"><w:body>{lines}</w:body></w:document>')
    return out.getvalue()


def packed_documents(spark, sf_dir):
    """Every document as a file: some empty, some not archives, some without body."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            odd = {7: b"", 8: b"no archive"}
            content = [odd[k % 50] if k % 50 in odd else _pack(text) for k, text in zip(batch["doc_id"], batch["text"])]
            yield pd.DataFrame({"key": batch["doc_id"], "content": content})

    return T.documents(spark, sf_dir).select("doc_id", "text").mapInPandas(pack, "key bigint, content binary")


@query(
    "file_gate",
    "SELECT doc_id AS key, CASE doc_id % 50 WHEN 7 THEN 'empty_file' WHEN 8 THEN 'invalid_format' END AS error_type FROM documents",
)
def file_gate(spark, sf_dir):
    return files.quality_gate(packed_documents(spark, sf_dir)).select("key", "error_type")


@query(
    "raw_ingest",
    ddl.with_(ddl.BLOCKS)
    + """SELECT template_version_id::VARCHAR AS template_version_id, block_id, position, sequence, block_type, text FROM blocks
WHERE template_version_id % 50 NOT IN (7, 8)""",
)
def raw_ingest(spark, sf_dir):
    """Unpacked files give the same blocks as the texts they were made from."""
    good = files.quality_gate(packed_documents(spark, sf_dir)).filter("error_type IS NULL")
    rows = docx.body(docx.elements(good))
    blank = F.regexp_count("text", F.lit(r"\S")) == 0
    kept = rows.filter(~((F.col("kind") == "p") & blank & (F.col("table").isNull())))
    return B.blocks(kept).select("template_version_id", "block_id", "position", "sequence", "block_type", "text")


@query(
    "missing_artifacts",
    "SELECT source AS template_id, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source",
)
def missing_artifacts(spark, sf_dir):
    """Versions for which no artefact (here: label row) is present, per template."""
    expected = T.table(spark, sf_dir, "documents").select(F.col("source").alias("template_id"), "doc_id")
    gone = files.missing(expected, T.table(spark, sf_dir, "labels"), "doc_id")
    return gone.groupBy("template_id").agg(F.count(F.lit(1)).alias("missing"))


@query(
    "storage_keys",
    ddl.with_(ddl.VERSIONS)
    + "SELECT 'templates' AS kind, template_id AS owner_id, version_number, 'source.docx' AS file_name, template_version_id FROM versions",
)
def storage_keys(spark, sf_dir):
    """Keys of all template sources, taken apart again."""
    v = T.template_versions(spark, sf_dir)
    keys = v.select("template_version_id", files.source_key(F.col("template_id"), F.col("version_number")).alias("path"))
    return keys.select("template_version_id", *[c.alias(n) for n, c in files.key_ids(F.col("path")).items()])


@query(
    "upload_filter",
    """SELECT page_id, page_id % 4 IN (0, 1) AND page_id % 3 <> 2 AS accepted FROM pages""",
)
def upload_filter(spark, sf_dir):
    m4, m3 = F.col("page_id") % 4, F.col("page_id") % 3
    name = F.concat(F.regexp_replace("url", r"[^A-Za-z0-9]", "_"), F.when(m4 == 0, ".docx").when(m4 == 1, ".DOCX").when(m4 == 2, ".pdf").otherwise(".doc"))
    kind = F.when(m3 == 0, "application/octet-stream").when(m3 == 1, "application/vnd.openxmlformats-officedocument.wordprocessingml.document").otherwise("text/html")
    return T.table(spark, sf_dir, "pages").select("page_id", files.acceptable(name, kind).alias("accepted"))


@query(
    "log_summary",
    ddl.with_(_EVENTS)
    + """SELECT 'req-' || user_id AS correlation_id, count(*) AS lines, count(*) FILTER (status = 'FAILED') AS errors, count(*) FILTER (status = 'FAILED' AND k % 2 = 0) AS exceptions,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_at FROM ev WHERE user_id % 10 <> 0 GROUP BY user_id""",
)
def log_summary(spark, sf_dir):
    """Events as JSON log lines, parsed and grouped; some lines carry no correlation id, some are broken."""
    e = T.jobs(spark, sf_dir)
    user = F.get_json_object("payload", "$.template_version_id").cast("int")
    k = F.get_json_object("payload", "$.document_id").cast("int")
    failed = F.col("status") == "FAILED"
    line = F.to_json(F.struct(
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(failed, "ERROR").otherwise("INFO").alias("level"),
        F.lit("worker").alias("logger"),
        F.col("status").alias("message"),
        F.when(user % 10 != 0, F.concat(F.lit("req-"), user.cast("string"))).alias("correlation_id"),
        F.when(failed & (k % 2 == 0), "trace").alias("exception"),
    ))
    lines = e.select(F.when(user % 10 == 0, F.concat(line, F.lit("}{"))).otherwise(line).alias("value"))
    return files.logs_by_correlation(files.parse_logs(lines))


# --- streams ----------------------------------------------------------------------------------
def _event_stream(spark, sf_dir):
    raw = S.read_stream(spark, sf_dir, "events.parquet")
    return T.events_of(raw)


_FOLD = """ordered AS (SELECT user_id AS job_id, status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev),
fold AS (
  SELECT job_id, rn, status AS state, status, 'accepted' AS verdict FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.job_id, o.rn, CASE WHEN ok THEN o.status ELSE o.state END, o.status, CASE WHEN ok THEN 'accepted' ELSE 'illegal' END FROM (
    SELECT o.job_id, o.rn, o.status, f.state, (f.state = 'PENDING' AND o.status IN ('RUNNING', 'FAILED')) OR (f.state = 'RUNNING' AND o.status IN ('COMPLETED', 'FAILED')) AS ok
    FROM fold f JOIN ordered o ON o.job_id = f.job_id AND o.rn = f.rn + 1) o)"""


@query(
    "stream_states",
    "WITH RECURSIVE " + _EVENTS + ",\n" + _FOLD
    + "\nSELECT job_id, count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'illegal') AS illegal, arg_max(state, rn) AS state FROM fold GROUP BY job_id",
)
def stream_states(spark, sf_dir):
    """The event log as a stream through the job state machine."""
    changes = S.run_available(S.job_states(T.job_events_of(_event_stream(spark, sf_dir))), "states")
    ok = F.col("verdict") == "accepted"
    return changes.filter("verdict <> 'stuck'").groupBy("job_id").agg(
        F.count_if(ok).alias("accepted"),
        F.count_if(F.col("verdict") == "illegal").alias("illegal"),
        F.max_by("status", F.when(ok, F.col("ts"))).alias("state"),
    )


@query(
    "stream_alerts",
    "WITH RECURSIVE " + _EVENTS + """,
fine AS (SELECT user_id * 1000 + k AS user_id, event_id, ts, status FROM ev),
""" + _FOLD.replace("FROM ev", "FROM fine")
    + """
SELECT f.job_id, l.ts AS silent_since, f.state AS status FROM (SELECT job_id, arg_max(state, rn) AS state FROM fold GROUP BY job_id) f
JOIN (SELECT user_id, max(ts) AS ts FROM fine GROUP BY user_id) l ON l.user_id = f.job_id
WHERE f.state = 'RUNNING' AND epoch_ms(l.ts) + 30 * 60000 < (SELECT epoch_ms(max(ts)) FROM ev) - 10 * 60000""",
)
def stream_alerts(spark, sf_dir):
    """Running jobs, here one per user and key, that have been silent for too long by the watermark."""
    fine = _event_stream(spark, sf_dir).withColumn("user_id", F.col("user_id") * 1000 + F.col("k"))
    changes = S.run_available(S.job_states(T.job_events_of(fine)), "alerts")
    alerts = changes.filter("verdict = 'stuck'")
    return alerts.select("job_id", F.col("ts").cast("timestamp_ntz").alias("silent_since"), "status")


_SESSIONS = _EVENTS + """,
beats AS (SELECT 'w' || user_id % 10 AS worker_id, ts FROM ev),
marked AS (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY worker_id ORDER BY ts) + INTERVAL 1 HOUR, true) AS starts FROM beats),
islands AS (SELECT *, sum(starts::INT) OVER (PARTITION BY worker_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked),
sessions AS (SELECT worker_id, min(ts) AS alive_from, max(ts) + INTERVAL 1 HOUR AS dead_at, count(*) AS beats FROM islands GROUP BY worker_id, session)"""


def _beats(rows):
    return rows.select(F.concat(F.lit("w"), (F.col("user_id") % 10).cast("string")).alias("worker_id"), "ts")


@query("heartbeat_sessions", ddl.with_(_SESSIONS) + "SELECT * FROM sessions")
def heartbeat_sessions(spark, sf_dir):
    return J.life_spans(_beats(T.table(spark, sf_dir, "events")), 3600)


@query(
    "stream_heartbeats",
    ddl.with_(_SESSIONS)
    + "SELECT * FROM sessions WHERE dead_at <= (SELECT date_trunc('millisecond', max(ts)) FROM ev) - INTERVAL 10 MINUTE",
)
def stream_heartbeats(spark, sf_dir):
    """The same as a stream: life spans that have ended by the watermark."""
    return S.run_available(S.heartbeat_sessions(_beats(_event_stream(spark, sf_dir)), 3600, "10 minutes"), "heartbeats")


@query("stream_dedupe", ddl.with_(_EVENTS) + "SELECT DISTINCT user_id AS job_id, k AS stage, status AS action FROM ev")
def stream_dedupe(spark, sf_dir):
    e = _event_stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("k").alias("stage"), F.col("status").alias("action"), "ts")
    return S.run_available(S.once_per_key(e, ["job_id", "stage", "action"]), "dedupe").drop("ts")


@query(
    "stream_classify",
    ddl.with_(ddl.BLOCKS, ddl.classified(0.85)) + "SELECT template_version_id, block_id, section_type, confidence, method FROM classified",
)
def stream_classify(spark, sf_dir):
    docs = S.read_stream(spark, sf_dir, "documents.parquet")
    out = S.classified(T.text_blocks_of(docs)).select("template_version_id", "block_id", "section_type", "confidence", "method")
    return S.run_available(out, "classify")


@query(
    "stream_next_jobs",
    ddl.with_(_JOBS) + "SELECT DISTINCT template_version_id, 'CLASSIFY' AS job_type FROM jobs WHERE status = 'COMPLETED' AND job_type = 'PARSE'",
)
def stream_next_jobs(spark, sf_dir):
    return S.run_available(S.next_jobs(T.jobs_of(_event_stream(spark, sf_dir))), "next-jobs")


@query(
    "stream_notifications",
    ddl.with_(_JOBS) + "SELECT job_id::VARCHAR AS job_id, job_type FROM jobs WHERE status = 'PENDING'",
)
def stream_notifications(spark, sf_dir):
    stream = T.jobs_of(_event_stream(spark, sf_dir)).filter("status = 'PENDING'")
    lines = stream.select(F.concat(F.col("job_id").cast("string"), F.lit(":"), "job_type").alias("value"))
    return S.run_available(S.notifications(lines), "notifications")
