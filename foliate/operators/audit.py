"""Audit-log queries, emitted rows, consistency checks and the error catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.functions.ordered import id_bucket, lagged, time_bucket


def meta(name: str, column: str = "metadata") -> Column:
    return F.get_json_object(column, f"$.{name}")


def _page(rows: DataFrame, skip: int, limit: int | None) -> DataFrame:
    """A page of the rows, newest first; all rows, in no order, where no page is asked for."""
    if not skip and limit is None:
        return rows
    rows = rows.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    if skip:
        rows = rows.offset(skip)
    return rows if limit is None else rows.limit(limit)


def search(
    logs: DataFrame,
    entity_type: str | None = None,
    entity_id=None,
    action: str | None = None,
    since: Column | None = None,
    until: Column | None = None,
    skip: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Rows that meet all given conditions, newest first. Every condition reaches the scan."""
    conditions = [
        None if entity_type is None else F.col("entity_type") == entity_type,
        None if entity_id is None else F.col("entity_id") == entity_id,
        None if action is None else F.col("action") == action,
        None if since is None else F.col("timestamp") >= since,
        None if until is None else F.col("timestamp") <= until,
    ]
    for condition in conditions:
        if condition is not None:
            logs = logs.filter(condition)
    return _page(logs, skip, limit)


def by_key(logs: DataFrame, name: str, value, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Rows whose metadata name a document, template version or job; the whole log is searched."""
    return _page(logs.filter(meta(name) == str(value)), skip, limit)


def by_keys(logs: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Rows that name any key of a table: the set form of ``by_key``."""
    ids = wanted.select(F.col(name).cast("string").alias(name)).distinct()
    return logs.withColumn(name, meta(name)).join(ids, name, "left_semi")


def has_version(number: Column | int) -> Column:
    """The version stands under one of three keys."""
    hit = F.lit(False)
    for name in ("version_number", "version", "version_intent"):
        hit = hit | F.coalesce(meta(name).try_cast("int") == number, F.lit(False))
    return hit


def by_version(logs: DataFrame, document_id, number: int, skip: int = 0, limit: int | None = None) -> DataFrame:
    return _page(logs.filter((meta("document_id") == str(document_id)) & has_version(number)), skip, limit)


def promote(logs: DataFrame) -> DataFrame:
    """Hot metadata keys as columns, to be written at ingest so that filters on them reach the scan."""
    return logs.withColumns({name: meta(name) for name in ("document_id", "template_version_id", "job_id")}).withColumn(
        "version_number", F.coalesce(*[meta(n).try_cast("int") for n in ("version_number", "version", "version_intent")])
    )


#: Metadata keys that a written log has as columns.
PROMOTED = ("document_id", "template_version_id", "job_id")
VERSION_KEYS = ("version_number", "version", "version_intent")


def write_log(logs: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """The log with its hot metadata keys as columns, sorted by document; filters on them reach the scan.

    A document's rows lie in few row groups; for the other keys each row group has a Bloom filter. Range partitioning
    samples the keys, so a document with a large part of all rows gets several files.
    """
    out = logs.withColumns({n: meta(n) for n in PROMOTED} | {f"meta_{n}": meta(n).try_cast("int") for n in VERSION_KEYS})
    files = max(1, -(-logs.count() // rows_per_file))
    rows = out.repartitionByRange(files, "document_id", "timestamp", "id").sortWithinPartitions("document_id", "timestamp", "id")
    writer = rows.write.option("parquet.bloom.filter.expected.ndv", 100_000)
    for name in ("template_version_id", "job_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.parquet(path)


def stored_by_key(log: DataFrame, name: str, value, skip: int = 0, limit: int | None = None) -> DataFrame:
    """``by_key`` on a written log."""
    return _page(log.filter(F.col(name) == str(value)), skip, limit)


def stored_by_version(log: DataFrame, document_id, number: int, skip: int = 0, limit: int | None = None) -> DataFrame:
    """``by_version`` on a written log."""
    hit = F.lit(False)
    for name in VERSION_KEYS:
        hit = hit | (F.col(f"meta_{name}") == number)
    return _page(log.filter((F.col("document_id") == str(document_id)) & hit), skip, limit)


def stored_by_keys(log: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """``by_keys`` on a written log."""
    return log.join(wanted.select(F.col(name).cast("string").alias(name)).distinct(), name, "left_semi")


# --- emitted rows -----------------------------------------------------------------------------
def emit(rows: DataFrame, event: str, entity_id: str) -> DataFrame:
    """Audit rows of one event for every row; metadata from the columns the rows have. Ids are strings."""
    entity_type, action, keys = K.AUDIT_EVENTS[event]
    present = [k for k in keys if k in rows.columns]
    ids = {k for k in present if k.endswith("_id") and k != "section_id"}
    values = [F.col(k).cast("string").alias(k) if k in ids else F.col(k) for k in present]
    return rows.select(
        F.lit(entity_type).alias("entity_type"),
        F.col(entity_id).cast("string").alias("entity_id"),
        F.lit(action).alias("action"),
        F.to_json(F.struct(*values)).alias("metadata"),
    )


# --- checks -----------------------------------------------------------------------------------
def out_of_order(logs: DataFrame, keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """Rows stamped earlier than the row logged before them for the same entity."""
    rows = lagged(logs, keys, [F.col("id")], id_bucket("id"), {"_before": F.col("timestamp")})
    return rows.filter(F.col("timestamp") < F.col("_before")).drop("_before")


def stage_of(action: Column) -> Column:
    return F.regexp_extract(action, r"\A(.*)_[A-Z]+\z", 1)


def gaps(logs: DataFrame, keys: Sequence[str], minutes: int) -> DataFrame:
    """Silences longer than ``minutes`` between two rows of the same key."""
    rows = lagged(logs, keys, [F.col("timestamp"), F.col("id")], time_bucket("timestamp"), {"previous_timestamp": F.col("timestamp")})
    return rows.withColumn("gap_seconds", F.timestamp_diff("SECOND", "previous_timestamp", "timestamp")).filter(
        F.col("gap_seconds") > minutes * 60
    )


def completed_before_started(logs: DataFrame, *keys: str) -> DataFrame:
    """Keys with a COMPLETED row but no STARTED row at or before the first one."""
    first = {
        name: F.min(F.when(F.col("action").endswith("_" + name.upper()), F.col("timestamp"))).alias(name)
        for name in ("started", "completed")
    }
    rows = logs.groupBy(*keys).agg(*first.values())
    return rows.filter(F.col("completed").isNotNull() & (F.col("started").isNull() | (F.col("started") > F.col("completed"))))


def duplicates(logs: DataFrame, *keys: str) -> DataFrame:
    """More than one row per (job, stage, action)."""
    return logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def unaudited_jobs(jobs: DataFrame, logs: DataFrame) -> DataFrame:
    """Completed jobs without a completion row."""
    done = logs.filter(F.col("action").endswith("_COMPLETED")).select(meta("job_id").alias("_job")).distinct()
    rows = jobs.filter(F.col("status") == "COMPLETED").withColumn("_job", F.col("job_id").cast("string"))
    return rows.join(done, "_job", "left_anti").drop("_job")


def dataset_checks(templates: DataFrame, versions: DataFrame, documents: DataFrame, sections: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per expectation about a data set: name, size found, passed, error."""

    def checks(rows: DataFrame, *wanted: tuple) -> DataFrame:
        """The expectations about one table, out of one pass over it."""
        counted = rows.agg(*[F.count_if(hit).alias(name) for name, hit, _ in wanted])
        each = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("found"), F.lit(error).alias("error")) for name, _, error in wanted])
        found = F.col("c.found")
        return counted.select(F.explode(each).alias("c")).select(
            "c.check", "c.found", (found > 0).alias("passed"), F.when(found == 0, F.col("c.error")).alias("error")
        )

    always = F.lit(True)
    out = checks(templates, ("template_exists", always, "Template not found"))
    for rows in (
        checks(
            versions, ("template_version_exists", always, "Template version not found"),
            ("template_parsed", F.col("parsing_status") == "COMPLETED", "Template version not parsed"),
        ),
        checks(
            documents, ("document_exists", always, "Document not found"), ("document_has_version", F.col("current_version") >= 1, "Document has no version")
        ),
        checks(
            sections, ("sections_exist", always, "Sections not found"), ("dynamic_sections_exist", F.col("section_type") == K.DYNAMIC, "No dynamic sections found")
        ),
        checks(jobs, ("jobs_completed", F.col("status") == "COMPLETED", "No completed jobs found")),
    ):
        out = out.unionByName(rows)
    return out


def error_catalogue(spark: SparkSession) -> DataFrame:
    """The ten error codes with category, severity, recovery action and retry flag."""
    schema = "error_code string, category string, severity string, recovery_action string, is_retryable boolean"
    return spark.createDataFrame(list(K.ERROR_CATALOGUE), schema)


def with_error_details(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue columns beside each coded row; unknown codes stay without. The catalogue has ten rows."""
    return rows.join(F.broadcast(catalogue), "error_code", "left")
