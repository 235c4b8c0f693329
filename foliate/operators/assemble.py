"""Assembly: blocks, sections and outputs joined into documents; integrity and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.functions.text import first_of, run_of, runs_text, sha, short_hash

VERSION = "template_version_id"


def block_hash(block_rows: DataFrame) -> Column:
    """Content hash of a block: its text, its table size, its items, else its id."""
    has = set(block_rows.columns)
    text = F.col("text") if "text" in has else runs_text(F.col("runs"))
    cases = [(F.col("block_type").isin("paragraph", "heading"), F.coalesce(text, F.lit("")))]
    if "rows" in has:
        size = F.concat(F.lit("table:"), F.coalesce(F.size("rows"), F.lit(0)).cast("string"), F.lit("x"), F.coalesce("column_count", F.lit(0)).cast("string"))
        cases.append((F.col("block_type") == "table", size))
    if "items" in has:
        cases.append((F.col("block_type") == "list", F.array_join(F.transform("items", lambda x: x["text"]), "|")))
    return short_hash(first_of(cases, F.col("block_id")))


def preconditions(section_rows: DataFrame, outputs: DataFrame, *key: str) -> DataFrame:
    """Error rows: dynamic sections without an output, outputs not validated, outputs without content."""
    on = [*key, "section_id"]
    number = F.col("section_id").cast("string")
    missing = section_rows.filter(F.col("section_type") == K.DYNAMIC).join(outputs.select(*on), on, "left_anti").select(
        *on,
        F.lit("MISSING_VALIDATED_CONTENT").alias("error_code"),
        F.concat(F.lit("Dynamic section "), number, F.lit(" lacks validated content")).alias("message"),
    )
    found = F.array_compact(F.array(
        F.when(~F.col("is_validated"), F.struct(
            F.lit("INVALID_SECTION_OUTPUT").alias("error_code"),
            F.concat(F.lit("Section output "), number, F.lit(" is not validated")).alias("message"))),
        F.when(F.coalesce("generated_content", F.lit("")) == "", F.struct(
            F.lit("MISSING_VALIDATED_CONTENT").alias("error_code"),
            F.concat(F.lit("Section output "), number, F.lit(" has no content")).alias("message"))),
    ))
    bad = outputs.select(*on, F.explode(found).alias("e")).select(*on, "e.error_code", "e.message")
    return missing.unionByName(bad)


def assemble(block_rows: DataFrame, section_rows: DataFrame | None, outputs: DataFrame | None, *key: str) -> DataFrame:
    """Every block once, with generated text injected into dynamic paragraphs and headings.

    Sections meet blocks by path ``body/block/<sequence>``, outputs meet sections by id; ``key``
    names the document (or version) in all three. Blocks that carry their own ``section_id`` and
    ``section_type`` need no section rows, and such that also carry their ``generated_content`` no outputs: then nothing is joined. Layout, level and ids are kept; other block types and
    sections without content keep their block.
    """
    key = list(key) or [VERSION]
    made = F.nullif("generated_content", F.lit("")).alias("_content")
    contents = None if outputs is None else outputs.select(*key, "section_id", made)
    dynamic = (F.col("section_type") == K.DYNAMIC).alias("_dynamic")
    if outputs is None:
        rows = block_rows.withColumn("_dynamic", dynamic).withColumn("_content", made)
        block_rows = block_rows.drop("section_id", "section_type", "generated_content")
    elif section_rows is None:
        rows = block_rows.withColumn("_dynamic", dynamic).join(contents, [*key, "section_id"], "left")
        block_rows = block_rows.drop("section_id", "section_type")
    else:
        known = section_rows.select(*key, "section_id", F.col("structural_path").alias("_path"), dynamic).join(
            contents, [*key, "section_id"], "left"
        )
        path = F.concat(F.lit("body/block/"), F.col("sequence").cast("string"))
        rows = block_rows.withColumn("_path", path).join(known, [*key, "_path"], "left")
    dynamic = F.coalesce("_dynamic", F.lit(False))
    textual = F.col("block_type").isin("paragraph", "heading")
    rows = rows.withColumns({
        "is_dynamic": dynamic,
        "was_injected": dynamic & textual & F.col("_content").isNotNull(),
        "injection_error": F.when(
            dynamic & ~textual & F.col("_content").isNotNull(),
            F.concat(F.lit("Unsupported block type for injection: "), "block_type"),
        ),
        "original_content_hash": block_hash(block_rows),
    })
    inject = F.col("was_injected")
    changed = {
        "assembled_content_hash": F.when(inject, short_hash("_content")).otherwise(F.col("original_content_hash")),
        "was_modified": inject,
        "injected_length": F.when(inject, F.length("_content")),
        "text": F.when(inject, F.col("_content")).otherwise(F.col("text")),
    }
    if "runs" in block_rows.columns:
        plain = run_of(F.col("_content")).cast(block_rows.schema["runs"].dataType)
        changed["runs"] = F.when(inject, plain).otherwise(F.col("runs"))
    extra = ("is_dynamic", "section_id", "original_content_hash", "assembled_content_hash", "was_modified",
             "was_injected", "injection_error", "injected_length")
    return rows.withColumns(changed).select(*block_rows.columns, *extra)


def injection_report(assembled: DataFrame, *key: str) -> DataFrame:
    """One row per dynamic block that had content: injected or why not."""
    rows = assembled.filter(F.col("was_injected") | F.col("injection_error").isNotNull())
    return rows.select(
        *key, "section_id", F.concat(F.lit("body/block/"), F.col("sequence").cast("string")).alias("structural_path"),
        "was_injected",
        F.when(F.col("was_injected"), F.col("original_content_hash")).alias("original_content_hash"),
        F.when(F.col("was_injected"), F.col("assembled_content_hash")).alias("injected_content_hash"),
        F.coalesce("injected_length", F.lit(0)).alias("content_length"),
        F.col("injection_error").alias("error_message"),
    )


def counts(assembled: DataFrame, *key: str) -> DataFrame:
    return assembled.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_blocks"),
        F.count_if("is_dynamic").alias("dynamic_blocks_count"),
        F.count_if(~F.col("is_dynamic")).alias("static_blocks_count"),
        F.count_if("was_injected").alias("injected_sections_count"),
    )


def structure_errors(original: DataFrame, assembled: DataFrame, *key: str) -> DataFrame:
    """Differences in block number, ids, order and type, as (key, error_code, errors).

    A different number of blocks is reported alone. Both sides are tagged; each row counts once under its block id and
    once under its position in a single grouping, so each side is computed once and a large document spreads over all tasks.
    """
    key = list(key)

    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select(*key, "block_id", "position", "block_type", F.lit(side).alias("_side"))

    both = tagged(original, 0).unionByName(tagged(assembled, 1))
    under = F.array(
        F.struct(F.lit(True).alias("id"), F.col("block_id").alias("v")),
        F.struct(F.lit(False).alias("id"), F.col("position").cast("string").alias("v")),
    )
    at = {side: F.max(F.when(F.col("_side") == side, F.struct("block_id", "block_type"))) for side in (0, 1)}
    places = both.withColumn("_u", F.explode(under)).groupBy(*key, "_u").agg(
        F.count_if(F.col("_side") == 0).alias("_a"), F.count_if(F.col("_side") == 1).alias("_b"), at[0].alias("_o"), at[1].alias("_n")
    )
    by_id = F.col("_u.id")
    joined = places.groupBy(*key).agg(
        F.sum(F.when(by_id, F.col("_a"))).alias("_original"),
        F.sum(F.when(by_id, F.col("_b"))).alias("_assembled"),
        F.count_if(by_id & (F.col("_b") == 0)).alias("_missing"),
        F.count_if(by_id & (F.col("_a") == 0)).alias("_extra"),
        F.count_if(~by_id & (F.col("_o.block_id") != F.col("_n.block_id"))).alias("_moved"),
        F.count_if(~by_id & (F.col("_o.block_type") != F.col("_n.block_type"))).alias("_retyped"),
    )
    differs = F.col("_original") != F.col("_assembled")
    found = F.when(differs, F.array(
        F.struct(F.lit("BLOCK_COUNT_MISMATCH").alias("error_code"), F.abs(F.col("_original") - F.col("_assembled")).alias("errors"))
    )).otherwise(F.array(
        F.struct(F.lit("ORPHANED_BLOCK").alias("error_code"), F.col("_missing").alias("errors")),
        F.struct(F.lit("STRUCTURAL_MISMATCH").alias("error_code"), (F.col("_extra") + F.col("_retyped")).alias("errors")),
        F.struct(F.lit("BLOCK_ORDER_MISMATCH").alias("error_code"), F.col("_moved").alias("errors")),
    ))
    exploded = joined.select(*key, F.explode(found).alias("e")).select(*key, "e.error_code", "e.errors")
    return exploded.filter(F.col("errors") > 0)


def changed_static_blocks(original: DataFrame, assembled: DataFrame, *key: str) -> DataFrame:
    """Static blocks whose content hash is not the original's."""
    before = original.select(*key, "block_id", block_hash(original).alias("_expected"))
    after = assembled.filter(~F.col("is_dynamic")).select(*key, "block_id", "assembled_content_hash")
    return after.join(before, [*key, "block_id"]).filter(
        ~F.col("_expected").eqNullSafe(F.col("assembled_content_hash"))
    ).select(*key, "block_id", F.lit("STATIC_SECTION_MODIFIED").alias("error_code"))


def initial_hash(document: Column, version: Column, intent: Column, batch: Column) -> Column:
    return sha(F.concat_ws("|", *[c.cast("string") for c in (document, version, intent, batch)]))


def assembly_hash(assembled: DataFrame, document: Column, version: Column, intent: Column, batch: Column, *key: str) -> DataFrame:
    """One hash per document over its ids and the ``id:hash`` pairs of its blocks by sequence.

    The value is defined over the whole list, so a document's pairs (about 45 characters per block)
    meet in one row.
    """
    part = F.concat("block_id", F.lit(":"), F.coalesce("assembled_content_hash", F.lit("")))
    rows = assembled.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("sequence", "position", part.alias("part")))).alias("_parts"),
        F.count(F.lit(1)).alias("total_blocks"),
    )
    joined = F.array_join(F.transform("_parts", lambda p: p["part"]), "|")
    head = [c.cast("string") for c in (document, version, intent, batch)]
    return rows.select(*key, "total_blocks", sha(F.concat_ws("|", *head, joined)).alias("assembly_hash"))


def differences(first: DataFrame, second: DataFrame, *key: str) -> DataFrame:
    """Documents whose two assemblies differ: blocks that are missing, moved or have another hash."""
    key = list(key)
    columns = [*key, "position", "block_id", "assembled_content_hash"]
    tagged = first.select(*columns, F.lit(1).alias("_d")).unionByName(second.select(*columns, F.lit(-1).alias("_d")))
    return tagged.groupBy(*columns).agg(F.sum("_d").alias("_d")).filter("_d <> 0").groupBy(*key).agg(
        F.count_distinct("position").alias("different_positions")
    )


# --- stored assemblies ------------------------------------------------------------------------
def already_assembled(requests: DataFrame, stored: DataFrame, batch: str = "batch_key") -> DataFrame:
    """Requests refused because an immutable assembly of their batch exists and none is forced."""
    done = stored.filter("is_immutable").select(batch)
    return requests.filter(~F.col("force")).join(done, batch, "left_semi").withColumn(
        "error_code", F.lit("ASSEMBLY_ALREADY_EXISTS")
    )


def accepted_requests(requests: DataFrame, stored: DataFrame, batch: str = "batch_key") -> DataFrame:
    done = stored.filter("is_immutable").select(batch, F.lit(True).alias("_done")).distinct()
    rows = requests.join(done, batch, "left")
    return rows.filter(F.col("force") | F.col("_done").isNull()).drop("_done")


def status_flags(stored: DataFrame, structure: str = "assembled_structure") -> DataFrame:
    valid = F.col("status") == "VALIDATED"
    return stored.withColumns({
        "is_complete": F.col("status").isin("COMPLETED", "VALIDATED"),
        "is_failed": F.col("status") == "FAILED",
        "is_validated": valid,
        "can_be_rendered": F.col("is_immutable") & valid & F.col(structure).isNotNull(),
    })


def find(
    stored: DataFrame,
    document_id=None,
    version: int | None = None,
    batch=None,
    content_hash: str | None = None,
    status: str | None = None,
    validated: bool = False,
    version_column: str = "version_intent",
    hash_column: str = "assembly_hash",
) -> DataFrame:
    """Stored assemblies or renditions that meet all given conditions, newest version first."""
    conditions = {
        "document_id": document_id, version_column: version, "batch_key": batch, hash_column: content_hash, "status": status,
    }
    for name, value in conditions.items():
        if value is not None:
            stored = stored.filter(F.col(name) == value)
    if validated:
        stored = renderable(stored)
    return stored.orderBy(F.col(version_column).desc())


def renderable(stored: DataFrame) -> DataFrame:
    return stored.filter((F.col("status") == "VALIDATED") & F.col("is_immutable"))


def latest(stored: DataFrame, order: str = "version_intent", key: str = "document_id") -> DataFrame:
    """The stored row with the highest version per document; also for renditions and versions."""
    value = F.struct(*[c for c in stored.columns if c != key])
    return stored.groupBy(key).agg(F.max_by(value, order).alias("_v")).select(key, "_v.*")


def stored_counts(stored: DataFrame, key: str = "document_id") -> DataFrame:
    return stored.groupBy(key).agg(F.count(F.lit(1)).alias("assemblies"))
