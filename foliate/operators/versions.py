"""Content-addressed versions: dedupe, numbering, history, integrity, as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.functions.ordered import asof, id_bucket, join_copies, ranked
from foliate.functions.text import sha

DOC = "document_id"


def rejected_arrivals(arrivals: DataFrame) -> DataFrame:
    """Arrivals that cannot be placed: without document, content hash or arrival number."""
    return arrivals.filter(F.col(DOC).isNull() | F.col("content_hash").isNull() | F.col("arrival").isNull())


def place_arrivals(arrivals: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Version number of every arrival ``(document_id, arrival, content_hash)``.

    Content already stored, or seen earlier in the batch, returns that version as a duplicate; new
    content gets the next number in order of arrival. Copies are counted away first (partial counts
    before the shuffle), numbering runs in buckets of arrival ids, and the numbers go back to the
    copies by a join whose heavy groups adaptive execution splits. ``arrival`` is a unique integer. Rows that
    lack a part of the key are not placed; ``rejected_arrivals`` has them.
    """
    arrivals = arrivals.filter(F.col(DOC).isNotNull() & F.col("content_hash").isNotNull() & F.col("arrival").isNotNull())
    groups = arrivals.groupBy(DOC, "content_hash").agg(
        F.min("arrival").alias("first_arrival"), F.count(F.lit(1)).alias("_copies")
    )
    if existing is None:
        fresh, known = groups, None
        base = None
    else:
        stored = existing.groupBy(DOC, "content_hash").agg(F.min("version_number").alias("version_number"))
        fresh = groups.join(stored, [DOC, "content_hash"], "left_anti")
        known = groups.join(stored, [DOC, "content_hash"]).withColumn("_new", F.lit(False))
        base = existing.groupBy(DOC).agg(F.max("version_number").alias("_base"))
    numbered = ranked(fresh, [DOC], [F.col("first_arrival")], id_bucket("first_arrival"), "version_number")
    if base is not None:
        numbered = numbered.join(base, DOC, "left").withColumn(
            "version_number", F.col("version_number") + F.coalesce("_base", F.lit(0))
        ).drop("_base")
    numbered = numbered.withColumn("_new", F.lit(True))
    placed = numbered if known is None else numbered.unionByName(known.select(*numbered.columns))
    rows = join_copies(arrivals, placed, [DOC, "content_hash"], "_copies")
    return rows.withColumn(
        "is_duplicate", ~(F.col("_new") & (F.col("arrival") == F.col("first_arrival")))
    ).drop("_new", "first_arrival")


def new_versions(placed: DataFrame) -> DataFrame:
    """Rows to append: the arrivals that made a version, with their output path."""
    path = F.concat(F.lit("documents/"), F.col(DOC).cast("string"), F.lit("/"), F.col("version_number").cast("string"), F.lit("/output.docx"))
    return placed.filter(~F.col("is_duplicate")).withColumn("output_path", path)


def next_numbers(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Next free version number of every document; 1 where it has none."""
    top = versions.groupBy(DOC).agg(F.max("version_number").alias("_top"))
    return documents.select(DOC).distinct().join(top, DOC, "left").select(
        DOC, (F.coalesce("_top", F.lit(0)) + 1).alias("next_version")
    )


def current_versions(versions: DataFrame) -> DataFrame:
    """Pointer to the newest version per document."""
    return versions.groupBy(DOC).agg(F.max("version_number").alias("current_version"))


def current_rows(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """The version each pointer names; none where the pointer is 0."""
    pointers = documents.filter(F.col("current_version") > 0).select(DOC, F.col("current_version").alias("version_number"))
    return pointers.join(versions, [DOC, "version_number"])


def history(versions: DataFrame) -> DataFrame:
    """Versions with total and current number of their document, in no order; ``listing`` gives a page."""
    totals = versions.groupBy(DOC).agg(
        F.count(F.lit(1)).alias("total_versions"), F.max("version_number").alias("current_version")
    )
    return versions.join(totals, DOC)


def integrity(versions: DataFrame, contents: DataFrame) -> DataFrame:
    """Does the stored content still have the stored hash? Missing content does not."""
    found = contents.select(DOC, "version_number", sha("content").alias("_found"))
    return versions.join(found, [DOC, "version_number"], "left").withColumn(
        "is_intact", F.coalesce(F.col("_found") == F.col("content_hash"), F.lit(False))
    ).drop("_found")


def metadata(versions: DataFrame, column: str = "generation_metadata") -> DataFrame:
    """Hash and size out of the JSON metadata, with the defaults of missing keys."""
    return versions.withColumns({
        "content_hash": F.coalesce(F.get_json_object(column, "$.content_hash"), F.lit("")),
        "file_size_bytes": F.coalesce(F.get_json_object(column, "$.file_size_bytes").try_cast("bigint"), F.lit(0)),
    })


def version_of(versions: DataFrame, document_id, number: int) -> DataFrame:
    return versions.filter((F.col(DOC) == document_id) & (F.col("version_number") == number))


def version_counts(versions: DataFrame) -> DataFrame:
    return versions.groupBy(DOC).agg(F.count(F.lit(1)).alias("versions"))


def existing_versions(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    return wanted.join(versions.select(DOC, "version_number"), [DOC, "version_number"], "left_semi")


def duplicate_numbers(versions: DataFrame, *key: str) -> DataFrame:
    """Violations of a uniqueness rule such as (document, version)."""
    return versions.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def latest_template_versions(template_versions: DataFrame) -> DataFrame:
    value = F.struct(*[c for c in template_versions.columns if c != "template_id"])
    return template_versions.groupBy("template_id").agg(F.max_by(value, "version_number").alias("_v")).select(
        "template_id", "_v.*"
    )


def template_as_of(rows: DataFrame, switches: DataFrame, time: str, effective: str = "effective_at", key: str = "template_id") -> DataFrame:
    """Template version in force at the time of each row; earlier rows keep their version after a switch."""
    return asof(rows, switches, [key], time, effective, ["template_version_id"])


def parsing_state(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """Latest parsing status per version, by time and then ``tie``; completed ones carry time, path and hash."""
    e = F.struct("status", "ts", "parsed_path", "content_hash")
    done = F.col("e.status") == "COMPLETED"
    return events.groupBy("template_version_id").agg(F.max_by(e, F.struct("ts", tie)).alias("e")).select(
        "template_version_id",
        F.col("e.status").alias("parsing_status"),
        F.when(done, F.col("e.ts")).alias("parsed_at"),
        F.when(done, F.col("e.parsed_path")).alias("parsed_path"),
        F.when(done, F.col("e.content_hash")).alias("content_hash"),
    )


def listing(rows: DataFrame, created: str = "created_at", tie: str = DOC, skip: int = 0, limit: int | None = None) -> DataFrame:
    """All rows, in no order; or a page, newest first."""
    if not skip and limit is None:
        return rows
    rows = rows.orderBy(F.col(created).desc(), F.col(tie).desc()).offset(skip)
    return rows if limit is None else rows.limit(limit)
