"""Job-log analytics. ``as_of`` times are parameters; nothing reads the clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.functions.ordered import hour_bucket, lagged, time_bucket
from foliate.functions.text import first_of


def payload(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def listing(jobs: DataFrame, status: str | None = None, job_type: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """All jobs that meet the conditions, in no order; or a page of them, newest first."""
    if status:
        jobs = jobs.filter(F.col("status") == status)
    if job_type:
        jobs = jobs.filter(F.col("job_type") == job_type)
    if not skip and limit is None:
        return jobs
    jobs = jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).offset(skip)
    return jobs if limit is None else jobs.limit(limit)


def by_entity(jobs: DataFrame, entity_type: str, entity_id) -> DataFrame:
    """Jobs whose payload names the entity, newest first."""
    return jobs.filter(payload(f"{entity_type}_id") == str(entity_id)).orderBy(F.col("created_at").desc(), F.col("job_id").desc())


def by_entities(jobs: DataFrame, entity_type: str, wanted: DataFrame) -> DataFrame:
    """Jobs about any entity of a table ``(<entity_type>_id)``: the set form of ``by_entity``."""
    key = f"{entity_type}_id"
    ids = wanted.select(F.col(key).cast("string").alias(key)).distinct()
    return jobs.withColumn(key, payload(key)).join(ids, key, "left_semi")


def status_counts(jobs: DataFrame, *by: str) -> DataFrame:
    """One zero-filled column per status."""
    return jobs.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in K.JOB_STATUSES])


def stuck(jobs: DataFrame, as_of: Column, minutes: int = K.STUCK_MINUTES) -> DataFrame:
    """RUNNING jobs started more than ``minutes`` before ``as_of``."""
    return jobs.filter((F.col("status") == "RUNNING") & (F.col("started_at") < as_of - F.make_dt_interval(mins=F.lit(minutes))))


def recovered(jobs: DataFrame, as_of: Column, minutes: int = K.STUCK_MINUTES) -> DataFrame:
    """The rows that put stuck jobs back to PENDING."""
    return stuck(jobs, as_of, minutes).withColumns({
        "status": F.lit("PENDING"),
        "started_at": F.lit(None).cast(jobs.schema["started_at"].dataType),
        "error": F.lit(f"Reset: Worker timeout after {minutes} minutes"),
    })


def latest_per_stage(jobs: DataFrame) -> DataFrame:
    """Newest PARSE, CLASSIFY and GENERATE job of each template version; other types are ignored."""
    rows = jobs.filter(F.col("job_type").isin(*K.STAGE_JOB_TYPES)).withColumn(
        "template_version_id", payload("template_version_id")
    ).filter(F.col("template_version_id").isNotNull())
    newest = F.struct("job_id", "status")
    order = F.struct("created_at", "job_id")
    return rows.groupBy("template_version_id").agg(*[
        F.max_by(newest, F.when(F.col("job_type") == t, order)).alias(t.lower()) for t in K.STAGE_JOB_TYPES
    ])


def current_stage(stages: DataFrame) -> DataFrame:
    """Stage of each template version: failures first, then the furthest stage reached."""
    p, c, g = (F.col(f"{t.lower()}.status") for t in K.STAGE_JOB_TYPES)
    open_ = ("PENDING", "RUNNING")
    stage = first_of([
        (p == "FAILED", "PARSE"),
        (c == "FAILED", "CLASSIFY"),
        (g == "FAILED", "GENERATE"),
        (g == "COMPLETED", "COMPLETE"),
        (g.isin(*open_), "GENERATE"),
        (c == "COMPLETED", "READY_FOR_GENERATE"),
        (c.isin(*open_), "CLASSIFY"),
        (p == "COMPLETED", "READY_FOR_CLASSIFY"),
        (p.isin(*open_), "PARSE"),
    ], F.lit("NOT_STARTED"))
    failed = F.coalesce(p == "FAILED", F.lit(False)) | F.coalesce(c == "FAILED", F.lit(False)) | F.coalesce(g == "FAILED", F.lit(False))
    return stages.select("template_version_id", stage.alias("current_stage"), (stage == "COMPLETE").alias("is_complete"), failed.alias("has_failed"))


def ready_requests(requests: DataFrame, stages: DataFrame) -> DataFrame:
    """Document requests whose template version may generate."""
    ready = stages.filter(F.col("current_stage").isin("READY_FOR_GENERATE", "GENERATE", "COMPLETE") & ~F.col("has_failed"))
    return requests.join(ready.select("template_version_id"), "template_version_id", "left_semi")


def next_jobs(jobs: DataFrame) -> DataFrame:
    """A CLASSIFY job for every completed PARSE job that names its version."""
    version = payload("template_version_id")
    return jobs.filter((F.col("status") == "COMPLETED") & (F.col("job_type") == "PARSE") & version.isNotNull()).select(
        F.col("job_id").alias("after_job_id"), version.alias("template_version_id"), F.lit("CLASSIFY").alias("job_type"), F.lit("PENDING").alias("status")
    )


def restartable(versions: DataFrame, stages: DataFrame) -> DataFrame:
    """Template versions without a PARSE job in flight."""
    busy = stages.filter(F.col("parse.status").isin("PENDING", "RUNNING")).select("template_version_id")
    return versions.join(busy, "template_version_id", "left_anti")


def transitions(events: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Each event with the status before it. Hot jobs are split by hour, see ``lagged``."""
    return lagged(events, keys, [F.col("ts"), F.col("event_id")], time_bucket("ts"), {"previous_status": F.col("status")})


def is_legal(before: Column, after: Column) -> Column:
    legal = F.lit(False)
    for a, b in K.LEGAL_TRANSITIONS:
        legal = legal | ((before == a) & (after == b))
    return legal


def illegal_transitions(events: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Status changes outside the state map. RUNNING back to PENDING is legal with a reset reason."""
    rows = transitions(events, keys)
    reset = (F.col("previous_status") == "RUNNING") & (F.col("status") == "PENDING") & F.col("reason").isNotNull()
    return rows.filter(F.col("previous_status").isNotNull() & ~is_legal(F.col("previous_status"), F.col("status")) & ~reset)


def with_flags(jobs: DataFrame) -> DataFrame:
    """Terminal flag and the entity a job is about."""
    return jobs.withColumns({
        "is_terminal": F.col("status").isin("COMPLETED", "FAILED"),
        "entity_id": F.coalesce(payload("template_version_id"), payload("document_id")),
    })


def durations(events: DataFrame, *keys: str) -> DataFrame:
    """First start, last end and seconds between, from status events."""
    rows = events.groupBy(*(keys or ("job_id",))).agg(
        F.min(F.when(F.col("status") == "RUNNING", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("COMPLETED", "FAILED"), F.col("ts"))).alias("completed_at"),
        F.count(F.lit(1)).alias("events"),
    )
    return rows.withColumn("seconds", F.timestamp_diff("SECOND", "started_at", "completed_at"))


def pending_queue(jobs: DataFrame, limit: int, job_types: Sequence[str] | None = None) -> DataFrame:
    """The next jobs to run: PENDING, oldest first. A top-k, not a full sort."""
    rows = jobs.filter(F.col("status") == "PENDING")
    if job_types:
        rows = rows.filter(F.col("job_type").isin(*job_types))
    return rows.orderBy("created_at", "job_id").limit(limit)


def board(jobs: DataFrame, versions: DataFrame, templates: DataFrame) -> DataFrame:
    """Jobs with template name, progress and document. Names by version id, else by template id."""
    by_version = versions.select(F.col("template_version_id").alias("_version"), F.col("template_name").alias("_by_version"))
    by_template = templates.select(F.col("template_id").alias("_template"), F.col("template_name").alias("_by_template"))
    # a job without a template id has a key of its own, so that such jobs do not meet in one task
    own = F.concat(F.lit("\0"), F.col("job_id").cast("string"))
    rows = jobs.withColumns({"_version": payload("template_version_id"), "_template": F.coalesce(payload("template_id"), own)})
    rows = rows.join(by_version, "_version", "left").join(by_template, "_template", "left")
    progress = first_of([
        (F.col("status") == "COMPLETED", F.lit(100)),
        (F.col("status") == "RUNNING", F.lit(50)),
        ((F.col("status") == "FAILED") & F.col("result").isNotNull(), F.lit(50)),
        (F.col("status") == "FAILED", F.lit(20)),
    ], F.lit(0))
    return rows.select(
        "job_id", "job_type", "status",
        F.coalesce("_by_version", "_by_template", F.lit("Unknown Template")).alias("template_name"),
        progress.alias("progress"),
        F.coalesce(F.get_json_object("result", "$.document_id"), payload("document_id")).alias("document_id"),
        F.get_json_object("result", "$.version_number").try_cast("int").alias("version_number"),
        "error",
    )


def counters(jobs: DataFrame, *by: str) -> DataFrame:
    def n(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_jobs"),
        n("COMPLETED").alias("completed"),
        n("RUNNING").alias("running"),
        n("FAILED").alias("failed"),
        n("PENDING", "RUNNING").alias("pending_or_running"),
    )


def template_cards(templates: DataFrame, versions: DataFrame, jobs: DataFrame, section_counts: DataFrame) -> DataFrame:
    """Per template: latest version, status out of its jobs and parsing, section counts."""
    value = F.struct("template_version_id", "version_number", "parsing_status")
    latest = versions.groupBy("template_id").agg(F.max_by(value, "version_number").alias("v")).select("template_id", "v.*")
    states = jobs.withColumn("template_version_id", payload("template_version_id")).groupBy("template_version_id").agg(
        F.bool_or(F.col("status") == "FAILED").alias("_failed"),
        F.bool_or(F.col("status") == "RUNNING").alias("_running"),
        F.every(F.col("status") == "COMPLETED").alias("_all"),
    )
    rows = templates.join(latest, "template_id", "left").join(
        states, latest["template_version_id"].cast("string") == states["template_version_id"], "left"
    ).drop(states["template_version_id"]).join(section_counts, "template_version_id", "left")
    status = first_of([
        (F.col("_failed"), "error"),
        (F.col("_running"), "analyzing"),
        (F.col("_all") | (F.col("parsing_status") == "COMPLETED"), "ready"),
        (F.col("parsing_status") == "IN_PROGRESS", "analyzing"),
    ], F.lit("pending"))
    return rows.select(
        *templates.columns, "template_version_id", F.coalesce("version_number", F.lit(1)).alias("version"), status.alias("status"),
        F.coalesce("total_sections", F.lit(0)).alias("sections"),
        F.coalesce("static_sections", F.lit(0)).alias("static_sections"),
        F.coalesce("dynamic_sections", F.lit(0)).alias("dynamic_sections"),
    )


def document_cards(documents: DataFrame, template_versions: DataFrame, versions: DataFrame) -> DataFrame:
    """Per document: template name and version (or defaults), current version, stored versions."""
    stored = versions.groupBy("document_id").agg(F.count(F.lit(1)).alias("_versions"))
    names = template_versions.select("template_version_id", "template_name", F.col("version_number").alias("_number"))
    return documents.join(names, "template_version_id", "left").join(stored, "document_id", "left").select(
        "document_id",
        F.coalesce("template_name", F.lit("Unknown Template")).alias("template_name"),
        F.coalesce("_number", F.lit(1)).alias("template_version_number"),
        "current_version",
        F.coalesce("_versions", F.lit(0)).alias("versions"),
    )


def document_counters(cards: DataFrame, *by: str) -> DataFrame:
    return cards.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("versions").alias("total_versions"),
        F.count_if(F.col("current_version") > 0).alias("ready_to_download"),
    )


def cancelled(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows for cancelled jobs; finished jobs stay as they are."""
    return jobs.join(requests.select("job_id"), "job_id", "left_semi").filter(
        ~F.col("status").isin("COMPLETED", "FAILED")
    ).withColumns({"status": F.lit("FAILED"), "error": F.lit("Cancelled by user")})


def run_outcomes(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """Outcome of each run from ``(run, stage, ok, artifact, error)`` rows.

    The first failing stage ends the run: artefacts of earlier stages stay, later ones are NULL.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in K.RUN_STAGES]), F.col("stage"))
    rows = stages.withColumn("_order", order)
    failed = F.when(~F.col("ok"), F.col("_order"))
    folded = rows.groupBy(run).agg(
        F.min(failed).alias("_failed"),
        F.min_by(F.struct("stage", "error"), failed).alias("_failure"),
        F.count_if("ok").alias("_done"),
        *[F.max(F.when((F.col("_order") == i + 1) & F.col("ok"), F.col("artifact"))).alias(s.lower()) for i, s in enumerate(K.RUN_STAGES)],
    )
    stop = F.coalesce("_failed", F.lit(len(K.RUN_STAGES) + 1))
    return folded.select(
        run,
        F.col("_failed").isNull().alias("success"),
        F.col("_failure.stage").alias("failed_stage"),
        F.coalesce("_failure.stage", F.lit("COMPLETED")).alias("current_stage"),
        F.col("_failure.error").alias("error"),
        *[F.when(stop > i + 1, F.col(s.lower())).alias(f"{s.lower()}_id") for i, s in enumerate(K.RUN_STAGES)],
    )


def life_spans(beats: DataFrame, ttl_seconds: int = K.HEARTBEAT_TTL_SECONDS) -> DataFrame:
    """Life spans of workers from a log of beats ``(worker_id, ts)``: dead ``ttl_seconds`` after the last.

    Beats are first merged per worker and hour; only those pieces (at most 3600 / ttl + 1 per hour, however
    many beats) are merged per worker.
    """
    ttl = F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)"))

    def pieces(rows: DataFrame, keys: list[str], start: str, last: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(start)
        opens = F.coalesce(F.col(start) > F.lag(last).over(w) + ttl, F.lit(True)).cast("int")
        numbered = rows.withColumn("_opens", opens)
        return numbered.withColumn("_piece", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)))

    hourly = beats.select("worker_id", "ts").withColumn("_hour", hour_bucket("ts"))
    local = pieces(hourly, ["worker_id", "_hour"], "ts", "ts").groupBy("worker_id", "_hour", "_piece").agg(
        F.min("ts").alias("alive_from"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("_beats")
    ).drop("_piece", "_hour")
    return pieces(local, ["worker_id"], "alive_from", "_last").groupBy("worker_id", "_piece").agg(
        F.min("alive_from").alias("alive_from"), (F.max("_last") + ttl).alias("dead_at"), F.sum("_beats").alias("beats")
    ).drop("_piece")
