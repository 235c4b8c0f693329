"""Incremental regeneration: which sections change, what is reused, and the record of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.functions.text import first_of, sha

DOC = "document_id"
VERSION = "template_version_id"
TRANSITION = (
    "old_version int, old_version_id string, new_version int, new_version_id string, scope string, intent string, "
    "regenerated_sections array<bigint>, reused_sections array<bigint>, template_version_id string"
)
NO_ID = "00000000-0000-0000-0000-000000000000"


def document_errors(requests: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Requests for unknown documents, and for documents without a version to start from."""
    unknown = requests.select(DOC).join(documents.select(DOC), DOC, "left_anti").withColumn("error_code", F.lit("DOCUMENT_NOT_FOUND"))
    bare = (
        requests.select(DOC)
        .join(documents.select(DOC), DOC, "left_semi")
        .join(versions.select(DOC), DOC, "left_anti")
        .withColumn("error_code", F.lit("NO_VERSION_EXISTS"))
    )
    return unknown.unionByName(bare)


def target_errors(targets: DataFrame, section_rows: DataFrame) -> DataFrame:
    """Targets that name no section of the document, or a static one."""
    known = section_rows.select(DOC, "section_id", "section_type")
    code = first_of([
        (F.col("section_type").isNull(), "SECTION_NOT_FOUND"),
        (F.col("section_type") == K.STATIC, "STATIC_SECTION"),
    ])
    return targets.join(known, [DOC, "section_id"], "left").withColumn("error_code", code).filter(
        F.col("error_code").isNotNull()
    ).select(DOC, "section_id", "error_code")


def merged(base: Column, override: Column) -> Column:
    """Client data overlaid by an override; independent of the session's duplicate-key policy."""
    empty = F.create_map().cast("map<string,string>")
    over = F.coalesce(override, empty)
    return F.map_concat(F.map_filter(F.coalesce(base, empty), lambda k, _: ~F.map_contains_key(over, k)), over)


def fingerprint(section_id: Column, client_data: Column) -> Column:
    """Hash of section and client data as JSON with sorted keys."""
    data = F.map_from_entries(F.array_sort(F.map_entries(client_data)))
    return sha(F.to_json(F.struct(data.alias("client_data"), section_id.alias("section_id"))))


def plan(
    section_rows: DataFrame,
    targets: DataFrame,
    previous: DataFrame,
    client_data: DataFrame,
    force_all: bool = False,
) -> DataFrame:
    """Action for every dynamic section: ``regenerate`` or ``reuse``.

    Sections ``(document_id, section_id, section_type)``; targets ``(document_id, section_id, pos,
    force, override)``, of which the first per section counts; previous outputs ``(document_id,
    section_id, input_hash, content_hash)``; client data ``(document_id, client_data)``. A target is
    regenerated when forced, new, or when its fingerprint changed. Documents with a bad target are
    left out (see ``target_errors``).
    """
    bad = target_errors(targets, section_rows).select(DOC).distinct()
    first = targets.groupBy(DOC, "section_id").agg(F.min_by(F.struct("force", "override"), "pos").alias("_t"))
    before = previous.select(DOC, "section_id", "input_hash", F.col("content_hash").alias("previous_content_hash"), F.lit(True).alias("_had"))
    rows = (
        section_rows.filter(F.col("section_type") == K.DYNAMIC)
        .select(DOC, "section_id")
        .join(bad, DOC, "left_anti")
        .join(first, [DOC, "section_id"], "left")
        .join(before, [DOC, "section_id"], "left")
        .join(client_data, DOC, "left")
    )
    new_hash = fingerprint(F.col("section_id"), merged(F.col("client_data"), F.col("_t.override")))
    rows = rows.withColumn("new_input_hash", new_hash)
    changed = F.col("_had").isNull() | ~F.col("new_input_hash").eqNullSafe(F.col("input_hash"))
    go = F.col("_t").isNotNull() & (F.coalesce("_t.force", F.lit(False)) | F.lit(force_all) | changed)
    return rows.select(
        DOC, "section_id", F.when(go, "regenerate").otherwise("reuse").alias("action"), "new_input_hash", "previous_content_hash"
    )


def section_results(planned: DataFrame) -> DataFrame:
    again = F.col("action") == "regenerate"
    return planned.select(
        DOC, "section_id",
        again.alias("was_regenerated"),
        (~again).alias("was_reused"),
        "previous_content_hash",
        F.when(~again, F.col("previous_content_hash")).alias("new_content_hash"),
        F.lit(None).cast("string").alias("error"),
    )


def result_status(results: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Counts and status per document, with the version numbers before and after."""
    rows = results.groupBy(DOC).agg(
        F.count_if("was_regenerated").alias("sections_regenerated"),
        F.count_if("was_reused").alias("sections_reused"),
        F.count_if(F.col("error").isNotNull()).alias("sections_failed"),
    )
    status = first_of([
        ((F.col("sections_failed") > 0) & (F.col("sections_regenerated") > 0), "PARTIALLY_COMPLETED"),
        (F.col("sections_failed") > 0, "FAILED"),
    ], F.lit("COMPLETED"))
    rows = rows.withColumn("status", status)
    if versions is None:
        return rows
    top = versions.groupBy(DOC).agg(F.max("version_number").alias("previous_version_number"))
    return rows.join(top, DOC, "left").withColumn(
        "new_version_number", F.coalesce("previous_version_number", F.lit(0)) + 1
    )


def full(section_rows: DataFrame, versions: DataFrame) -> DataFrame:
    """All dynamic sections of every document anew; the version goes up by one, or starts at 1."""
    results = section_rows.filter(F.col("section_type") == K.DYNAMIC).select(
        DOC, F.lit(True).alias("was_regenerated"), F.lit(False).alias("was_reused"), F.lit(None).cast("string").alias("error")
    )
    return result_status(results, versions)


def template_update(requests: DataFrame, template_versions: DataFrame, section_rows: DataFrame) -> DataFrame:
    """Per request ``(document_id, old_version, new_version)``: dynamic sections of the new version.

    A version that does not exist gives TEMPLATE_VERSION_NOT_FOUND.
    """
    dynamic = section_rows.filter(F.col("section_type") == K.DYNAMIC).groupBy(VERSION).agg(
        F.count(F.lit(1)).alias("sections_regenerated")
    )
    known = template_versions.select(F.col(VERSION).alias("new_version"), F.lit(True).alias("_known"))
    return (
        requests.join(known, "new_version", "left")
        .join(dynamic.withColumnRenamed(VERSION, "new_version"), "new_version", "left")
        .select(
            DOC, "old_version", "new_version",
            F.coalesce("sections_regenerated", F.lit(0)).alias("sections_regenerated"),
            F.when(F.col("_known").isNull(), "TEMPLATE_VERSION_NOT_FOUND").alias("error_code"),
        )
    )


def template_diff(requests: DataFrame, section_rows: DataFrame) -> DataFrame:
    """Sections added, removed, retyped or kept between the two versions of a request, by path."""

    def side(column: str, name: str) -> DataFrame:
        s = section_rows.select(F.col(VERSION).alias(column), "structural_path", F.col("section_type").alias(name))
        return requests.join(s, column).select(DOC, "structural_path", name)

    both = side("old_version", "old_type").join(side("new_version", "new_type"), [DOC, "structural_path"], "full_outer")
    change = first_of([
        (F.col("old_type").isNull(), "added"),
        (F.col("new_type").isNull(), "removed"),
        (F.col("old_type") != F.col("new_type"), "retyped"),
    ], F.lit("kept"))
    return both.withColumn("change", change)


def merge_reused(new_outputs: DataFrame, planned: DataFrame, previous: DataFrame) -> DataFrame:
    """Contents of the next version: new text for regenerated sections, the old one for the others."""
    fresh = new_outputs.select(DOC, "section_id", F.col("generated_content").alias("_new"))
    old = previous.select(DOC, "section_id", F.col("generated_content").alias("_old"))
    rows = planned.select(DOC, "section_id", "action").join(fresh, [DOC, "section_id"], "left").join(old, [DOC, "section_id"], "left")
    again = F.col("action") == "regenerate"
    content = F.when(again, F.col("_new")).otherwise(F.col("_old"))
    return rows.select(DOC, "section_id", content.alias("generated_content"), (~again & F.col("_old").isNotNull()).alias("is_reused"))


def audit_rows(planned: DataFrame, results: DataFrame, documents: DataFrame) -> DataFrame:
    """REGENERATE audit row per document; absent keys are left out of the JSON."""
    ids = planned.groupBy(DOC).agg(
        F.array_sort(F.collect_list(F.when(F.col("action") == "regenerate", F.col("section_id")))).alias("regenerated_sections"),
        F.array_sort(F.collect_list(F.when(F.col("action") == "reuse", F.col("section_id")))).alias("reused_sections"),
    )
    rows = results.join(ids, DOC).join(documents.select(DOC, VERSION), DOC)
    meta = F.to_json(F.struct(
        F.lit("SECTION").alias("scope"),
        F.lit("CONTENT_UPDATE").alias("intent"),
        F.col("previous_version_number").alias("old_version"),
        F.col("new_version_number").alias("new_version"),
        F.col(VERSION).cast("string").alias("template_version_id"),
        "regenerated_sections",
        "reused_sections",
    ))
    return rows.select(F.lit("DOCUMENT").alias("entity_type"), F.col(DOC).alias("entity_id"), F.lit("REGENERATE").alias("action"), meta.alias("metadata"))


def transitions(audit: DataFrame) -> DataFrame:
    """Typed version transitions of the REGENERATE rows, with the defaults of missing keys."""
    rows = audit.filter((F.col("entity_type") == "DOCUMENT") & (F.col("action") == "REGENERATE"))
    m = F.from_json("metadata", TRANSITION)
    rows = rows.withColumn("_m", m)
    none = F.array().cast("array<bigint>")
    return rows.select(
        F.col("entity_id").alias(DOC),
        F.col("_m.old_version").alias("old_version_number"),
        F.col("_m.old_version_id").alias("old_version_id"),
        F.col("_m.new_version").alias("new_version_number"),
        F.coalesce("_m.new_version_id", F.lit(NO_ID)).alias("new_version_id"),
        F.coalesce("_m.scope", F.lit("FULL")).alias("scope"),
        F.coalesce("_m.intent", F.lit("CONTENT_UPDATE")).alias("intent"),
        F.coalesce("_m.regenerated_sections", none).alias("regenerated_section_ids"),
        F.coalesce("_m.reused_sections", none).alias("reused_section_ids"),
        F.col("_m.template_version_id").alias(VERSION),
        *(["timestamp"] if "timestamp" in audit.columns else []),
    )
