"""Generation inputs: context of dynamic sections, checks, fingerprints, prompts, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.functions.text import first_of, sha, strip

VERSION = "template_version_id"
REQUIRED_CONFIG = ("classification_confidence", "classification_method", "justification")
UUID = r"(?i)\A(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?\z"


def versions_without_dynamic(versions: DataFrame, section_rows: DataFrame) -> DataFrame:
    dynamic = section_rows.filter(F.col("section_type") == K.DYNAMIC).select(VERSION)
    return versions.join(dynamic, VERSION, "left_anti").select(
        VERSION, F.lit("NoDynamicSectionsError").alias("error_type")
    )


def with_context(section_rows: DataFrame) -> DataFrame:
    """Neighbours, hierarchy and order of every section; filter to DYNAMIC afterwards.

    Neighbours and siblings count static sections too, so the windows come before the filter. They
    run per version over ids, paths and types only; the texts are not shuffled.
    """
    w = W.partitionBy(VERSION).orderBy("section_id")
    every = W.partitionBy(VERSION)
    segments = F.split("structural_path", "/")
    rows = section_rows.withColumns({
        "path_segments": segments,
        "_parent": F.regexp_extract("structural_path", r"(?s)\A(.*)/[^/]*\z", 1),
        "_nested": F.col("structural_path").contains("/"),
        "preceding_content": F.lag("structural_path").over(w),
        "preceding_type": F.lag("section_type").over(w),
        "following_content": F.lead("structural_path").over(w),
        "following_type": F.lead("section_type").over(w),
        "section_boundary_hint": F.format_string(
            "Section at position %d of %d", F.row_number().over(w), F.count(F.lit(1)).over(every)
        ),
        "sequence_order": (
            F.sum((F.col("section_type") == K.DYNAMIC).cast("bigint")).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
        ),
    })
    siblings = W.partitionBy(VERSION, "_parent", "_nested")
    n = F.size("path_segments")
    return rows.withColumns({
        "parent_heading": F.when(n > 1, F.try_element_at("path_segments", F.lit(-2))),
        "parent_level": F.when(n > 1, n - 1),
        "depth": n - 1,
        "sibling_index": F.when(F.col("_nested"), F.row_number().over(siblings.orderBy("section_id")) - 1).otherwise(0),
        "total_siblings": F.when(F.col("_nested"), F.count(F.lit(1)).over(siblings)).otherwise(F.lit(1)),
    }).drop("_parent", "_nested")


def ancestors(section_rows: DataFrame) -> DataFrame:
    """(version, section, ancestor_id, ancestor_path, distance): every section above another one, nearest first at distance 1.

    The prefixes of a path are the paths of its ancestors, so the closure is one equi-join; it has at most one row per level of a path.
    """
    segments = F.split("structural_path", "/")
    n = F.size(segments)
    above = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.array_join(F.slice(segments, F.lit(1), i), "/").alias("path"), i.alias("i")))
    below = section_rows.filter(n > 1).select(VERSION, "section_id", n.alias("n"), F.explode(above).alias("p"))
    named = section_rows.select(VERSION, F.col("structural_path").alias("ancestor_path"), F.col("section_id").alias("ancestor_id"))
    found = below.select(VERSION, "section_id", F.col("p.path").alias("ancestor_path"), (F.col("n") - F.col("p.i")).alias("distance"))
    return found.join(named, [VERSION, "ancestor_path"]).select(VERSION, "section_id", "ancestor_id", "ancestor_path", "distance")


def dynamic_inputs(section_rows: DataFrame) -> DataFrame:
    return with_context(section_rows).filter(F.col("section_type") == K.DYNAMIC)


def check_config(rows: DataFrame, config: str = "prompt_config") -> DataFrame:
    """``config_error`` for a prompt config given as JSON text: missing, incomplete or malformed."""
    keys = F.json_object_keys(config)
    missing = F.array_compact(F.array(*[F.when(~F.array_contains(keys, k), F.lit(k)) for k in REQUIRED_CONFIG]))
    score = F.get_json_object(config, "$.classification_confidence")
    blank = F.col(config).isNull() | F.col(config).isin("", "{}", "null")
    error = first_of([
        (blank, F.struct(F.lit("MissingPromptConfigError").alias("error_type"), F.array(*map(F.lit, REQUIRED_CONFIG)).alias("missing"))),
        (keys.isNull(), F.struct(F.lit("MalformedSectionMetadataError").alias("error_type"), F.array().cast("array<string>").alias("missing"))),
        (F.size(missing) > 0, F.struct(F.lit("MissingPromptConfigError").alias("error_type"), missing.alias("missing"))),
        (score.try_cast("double").isNull(), F.struct(F.lit("MalformedSectionMetadataError").alias("error_type"), F.array().cast("array<string>").alias("missing"))),
    ])
    return rows.withColumn("config_error", error)


def check_input(rows: DataFrame, uuids: bool = True) -> DataFrame:
    """``input_error struct<field, reason, value>`` of the first failing check, NULL when fine."""

    def failure(field: str, reason: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), value.cast("string").alias("value"))

    checks = [(F.col("section_id") <= 0, failure("section_id", "must be a positive integer", F.col("section_id")))]
    if uuids:
        for name in ("template_id", VERSION):
            bad = ~F.coalesce(F.rlike(F.col(name).cast("string"), F.lit(UUID)), F.lit(False))
            checks.append((bad, failure(name, "must be a valid UUID string", F.col(name))))
    path = F.coalesce("structural_path", F.lit(""))
    checks.append((strip(path) == "", failure("structural_path", "cannot be empty", F.col("structural_path"))))
    score = F.col("prompt_config.classification_confidence")
    checks.append((
        ~score.between(0.0, 1.0),
        failure("prompt_config.classification_confidence", "must be between 0.0 and 1.0", score),
    ))
    return rows.withColumn("input_error", first_of(checks))


def attach_client(inputs: DataFrame, client_rows: DataFrame, key: str = "client_id") -> DataFrame:
    """Client name and open data fields beside each input; a missing client leaves them empty."""
    return inputs.join(client_rows, key, "left")


def _sorted_map(m: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.map_from_entries(F.array_sort(F.map_entries(m))), empty)


def canonical_input(rows: DataFrame) -> Column:
    """JSON of a whole input: keys sorted at every level, compact, NULLs kept, text not escaped to ASCII."""
    empty = F.create_map().cast("map<string,string>")
    has = set(rows.columns)
    return F.to_json(
        F.struct(
            F.struct(
                F.col("client_id").cast("string").alias("client_id"),
                "client_name",
                (_sorted_map(F.col("custom_context")) if "custom_context" in has else empty).alias("custom_context"),
                _sorted_map(F.col("data_fields")).alias("data_fields"),
            ).alias("client_data"),
            F.struct("depth", "parent_heading", "parent_level", "path_segments", "sibling_index", "total_siblings").alias("hierarchy_context"),
            F.struct(
                F.col("prompt_config.classification_confidence"),
                F.col("prompt_config.classification_method"),
                F.col("prompt_config.justification"),
                F.col("prompt_config.prompt_template"),
            ).alias("prompt_config"),
            "section_id",
            "structural_path",
            F.struct("following_content", "following_type", "preceding_content", "preceding_type", "section_boundary_hint").alias("surrounding_context"),
            F.col("template_id").cast("string").alias("template_id"),
            F.col(VERSION).cast("string").alias(VERSION),
        ),
        {"ignoreNullFields": "false"},
    )


def with_input_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("input_hash", sha(canonical_input(rows)))


def prompt_text(rows: DataFrame) -> Column:
    """Prompt lines; lines without a value are left out."""
    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    config = "prompt_config."
    fields = F.array_join(
        F.transform(F.map_entries(_sorted_map(F.col("data_fields"))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Generate content for section at path: "), "structural_path"),
        F.concat(F.lit("Classification confidence: "), F.coalesce(F.col(config + "classification_confidence").cast("string"), F.lit("N/A"))),
        F.concat(F.lit("Justification: "), F.coalesce(F.col(config + "justification"), F.lit("N/A"))),
        line("Document structure: ", F.array_join("path_segments", " > ")),
        line("Client: ", F.col("client_name")),
        F.nullif(fields, F.lit("")),
        line("Preceding section: ", F.col("preceding_content")),
        line("Following section: ", F.col("following_content")),
        line("Template guidance: ", F.col(config + "prompt_template")),
    )


def batches(inputs: DataFrame, *key: str) -> DataFrame:
    """One row per batch: number of inputs and a hash that does not depend on their order.

    The hashes of one batch (64 characters per section of one document) are gathered and sorted.
    """
    return inputs.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_inputs"),
        sha(F.to_json(F.array_sort(F.collect_list("input_hash")))).alias("content_hash"),
    ).withColumns({"status": F.lit("VALIDATED"), "is_immutable": F.lit(True)})


def accepted_batches(candidates: DataFrame, existing: DataFrame, *key: str) -> DataFrame:
    """New batches only; a stored validated batch is never overwritten."""
    return candidates.join(existing.filter("is_immutable").select(*key), list(key), "left_anti")


def write_violations(candidates: DataFrame, existing: DataFrame, *key: str) -> DataFrame:
    """Candidates that would change a stored validated batch."""
    return candidates.join(existing.filter("is_immutable").select(*key), list(key), "left_semi").withColumn(
        "error_type", F.lit("ImmutabilityViolationError")
    )


def bad_intents(requests: DataFrame) -> DataFrame:
    """Requests whose version intent is below 1."""
    return requests.filter(F.coalesce(F.col("version_intent"), F.lit(0)) < 1)


def usable_batches(batch_rows: DataFrame) -> DataFrame:
    return batch_rows.filter((F.col("status") == "VALIDATED") & F.col("is_immutable"))


def batches_of(batch_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Batches of the documents in a table of keys; where it has ``version_intent``, of these intents only."""
    keys = ["document_id"] + (["version_intent"] if "version_intent" in wanted.columns else [])
    return batch_rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def inputs_of(inputs: DataFrame, batches: DataFrame, *key: str) -> DataFrame:
    """Inputs of the given batches; ``sequence_order`` orders those of a batch."""
    return inputs.join(batches.select(*key).distinct(), list(key), "left_semi")
