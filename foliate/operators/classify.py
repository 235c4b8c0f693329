"""Section classification: ordered text rules, structure, heuristics, model replies, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.functions.text import confidence_level, first_of, has_more_tokens, holds_any, java, matches, once, strip

MODEL_SCHEMA = "classification string, confidence string, reasoning string"


def _choose(number: Column, values: list, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number).cast(kind)


def rule_number(text: Column, lower: str, threshold: float = 0.0) -> Column:
    """Number of the first text rule that hits, from 0; NULL when none does.

    The literals of a rule are searched first, in the lower-cased text; few texts get as far as its
    pattern. A rule below the threshold still ends the search, but does not stand: it counts as no
    rule.
    """
    tests = []
    for i, (_, confidence, _, pattern, literals) in enumerate(K.RULES):
        hit = matches(text, pattern)
        if literals:
            hit = (holds_any(lower, literals) | F.col("_odd")) & hit
        tests.append((hit, F.lit(i if confidence >= threshold else _NO_RULE)))
    return first_of(tests)


def _alternative(rule: Column, text: Column) -> Column:
    """What the pattern of the rule that stands found, trimmed; that one pattern only, and only if the column is asked for."""
    found = [(rule == i, strip(F.regexp_extract(text, java(r[3]), 0))) for i, r in enumerate(K.RULES)]
    return first_of(found)


def isolated(classified: DataFrame, error: Column) -> DataFrame:
    """Classified blocks where a block whose ``error`` is not NULL falls back, with a message, instead of failing the batch."""
    failed = error.isNotNull()
    fallback = {
        "section_type": K.STATIC, "confidence": K.FALLBACK_CONFIDENCE, "confidence_level": K.LOW, "method": K.FALLBACK, "justification": K.FALLBACK_REASON,
    }
    out = {name: F.when(failed, F.lit(value)).otherwise(F.col(name)) for name, value in fallback.items()}
    out |= {name: F.when(~failed, F.col(name)) for name in ("rule_number", "text_sample", "pattern", "matched_text") if name in classified.columns}
    out["error"] = F.when(failed, F.concat(F.lit("Failed to classify block "), F.coalesce("block_id", F.lit("unknown")), F.lit(": "), error))
    return classified.withColumns(out)


def block_fault(block_type: Column, text: Column) -> Column:
    """Why a block cannot be classified: it has no type, or its text is not text. NULL for a sound one."""
    return first_of([(block_type.isNull(), "block has no type"), (~F.is_valid_utf8(text), "text is not valid UTF-8")])


_INDICATORS = (K.HEADER_FOOTER_RULE, K.TOP_HEADING_RULE, K.SHORT_RULE, K.CAPS_RULE, K.NARRATIVE_RULE)
_NO_RULE = len(K.RULES) + len(_INDICATORS)


def _indicator(block_type: Column, level: Column, text: Column, threshold: float) -> Column:
    """Structural rule, else heuristic. The first that applies counts, if it reaches the threshold."""

    def number(i: int) -> Column:
        return F.lit(len(K.RULES) + i if _INDICATORS[i][1] >= threshold else None).cast("int")

    structural = first_of([
        (block_type.isin("header", "footer"), number(0)),
        ((block_type == "heading") & (level == 1), number(1)),
    ])
    heuristics = [
        (F.length(strip(text)) < K.SHORT_LENGTH, number(2)),
        ((F.length(text) < K.CAPS_LENGTH) & (F.upper(text) == text) & (F.lower(text) != text), number(3)),
        (
            (block_type == "paragraph")
            & (F.length(text) > K.NARRATIVE_LENGTH)
            & has_more_tokens(text, K.NARRATIVE_WORDS),
            number(4),
        ),
    ]
    if all(rule[1] < threshold for rule in _INDICATORS[2:]):
        return structural
    return F.coalesce(structural, first_of(heuristics))


def classify(
    blocks: DataFrame,
    threshold: float = K.DEFAULT_THRESHOLD,
    replies: DataFrame | None = None,
    keys: tuple[str, ...] = ("template_version_id", "block_id"),
) -> DataFrame:
    """Blocks with section type, confidence, level, method, justification and text sample.

    The text rules and the indicators are one lazy chain that yields a rule number; everything else
    is looked up from it, so each pattern is tried at most once per block and only until the first
    hit. ``replies`` holds at most one parsed model reply per block (see ``model_replies``).
    Blocks without text (tables, lists, breaks) are classified as empty text.
    """
    text = F.coalesce("text", F.lit(""))
    prepared = once(blocks, {"_lower": F.lower(text), "_odd": F.coalesce(holds_any("text", K.ODD_LETTERS), F.lit(False))})
    number = F.coalesce(
        rule_number(text, "_lower", threshold),
        _indicator(F.col("block_type"), F.col("level"), text, threshold),
        F.lit(_NO_RULE),
    )
    rows = once(prepared, {"_rule": number}).drop("_lower", "_odd")
    known = (*K.RULES, *_INDICATORS, (K.STATIC, K.FALLBACK_CONFIDENCE, K.FALLBACK_REASON))
    rule = F.col("_rule")
    verdict = {
        "section_type": _choose(rule, [r[0] for r in known], "string"),
        "confidence": _choose(rule, [r[1] for r in known], "double"),
        "method": F.when(rule == _NO_RULE, K.FALLBACK).otherwise(K.RULE_BASED),
        "justification": _choose(
            rule, [f"Rule-based: {r[2]}" if i < len(K.RULES) else r[2] for i, r in enumerate(known)], "string"
        ),
    }
    if replies is not None:
        rows = rows.join(replies.select(*keys, F.col("reply").alias("_reply")), list(keys), "left")
        reply = F.col("_reply")
        by_model = (rule == _NO_RULE) & F.coalesce(reply["confidence"] >= threshold, F.lit(False))
        answers = {
            "section_type": reply["classification"],
            "confidence": reply["confidence"],
            "method": F.lit(K.LLM_ASSISTED),
            "justification": F.concat(F.lit("LLM-assisted: "), reply["reasoning"]),
        }
        verdict = {name: F.when(by_model, answers[name]).otherwise(value) for name, value in verdict.items()}
    rows = rows.withColumns(verdict)
    return rows.select(
        *blocks.columns,
        "section_type",
        "confidence",
        confidence_level(F.col("confidence")).alias("confidence_level"),
        "method",
        "justification",
        F.when(rule != _NO_RULE, rule + 1).alias("rule_number"),
        F.when(rule < len(K.RULES), F.substring(text, 1, 100)).alias("text_sample"),
        _choose(rule, [r[3] for r in K.RULES], "string").alias("pattern"),
        _alternative(rule, text).alias("matched_text"),
    )


def model_replies(raw: DataFrame, content: str = "content") -> DataFrame:
    """Replies of a model as ``reply struct<classification, confidence, reasoning>``, NULL if unusable.

    The text from the first ``{`` to the last ``}`` must be JSON with class STATIC or DYNAMIC.
    """
    body = F.from_json(F.regexp_extract(content, r"(\{[\s\S]*\})", 1), MODEL_SCHEMA)
    rows = raw.withColumn("_body", body)
    kind = F.upper(F.col("_body.classification"))
    score = F.coalesce(F.col("_body.confidence"), F.lit("0")).try_cast("double")
    reply = F.struct(
        kind.alias("classification"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("confidence"),
        F.coalesce("_body.reasoning", F.lit("No reasoning provided")).alias("reasoning"),
    )
    usable = kind.isin(K.STATIC, K.DYNAMIC) & score.isNotNull()
    return rows.withColumn("reply", F.when(usable, reply)).drop("_body")


def neighbour_context(blocks: DataFrame, doc: str = "template_version_id") -> DataFrame:
    """Position, total and neighbouring block types of each block of a document.

    The window holds the blocks of one document, which come out of one source row.
    """
    w = W.partitionBy(doc).orderBy("position")
    return blocks.withColumns({
        "position_in_document": (F.row_number().over(w) - 1).cast("bigint"),
        "total_blocks": F.count(F.lit(1)).over(W.partitionBy(doc)),
        "previous_block_type": F.lag("block_type").over(w),
        "next_block_type": F.lead("block_type").over(w),
    })


def model_features(blocks: DataFrame, doc: str = "template_version_id") -> DataFrame:
    """Request rows for an external model: content sample and structural metadata. Texts are cut before the window."""
    text = F.coalesce("text", F.lit(""))
    cut = blocks.select(
        doc, "block_id", "block_type", "sequence", "level", "style_name", "position",
        F.substring(text, 1, 1000).alias("content"), F.length(text).alias("text_length"),
    )
    return neighbour_context(cut, doc).select(
        doc,
        "block_id",
        "block_type",
        "content",
        F.struct(
            "block_type", "sequence", "text_length", F.col("level").alias("heading_level"),
            "style_name", "previous_block_type", "next_block_type", "position_in_document",
        ).alias("structural_metadata"),
    )


def sections(classified: DataFrame) -> DataFrame:
    """One section per block. ``section_id`` counts from 1 inside the version, in block order.

    ``structural_path`` is the assembly path ``body/block/<sequence>``; the block id stays beside it.
    """
    config = F.struct(
        F.col("confidence").alias("classification_confidence"),
        F.col("method").alias("classification_method"),
        "justification",
        F.lit(None).cast("string").alias("prompt_template"),
    )
    return classified.select(
        *[c for c in ("template_id",) if c in classified.columns],
        "template_version_id",
        (F.col("position") + 1).alias("section_id"),
        "block_id",
        F.concat(F.lit("body/block/"), F.col("sequence").cast("string")).alias("structural_path"),
        "section_type",
        "confidence",
        "confidence_level",
        "method",
        "justification",
        F.when(F.col("section_type") == K.DYNAMIC, config).alias("prompt_config"),
    )


def batch_statistics(classified: DataFrame, *by: str) -> DataFrame:
    """Counts per type, level and method, with the share of high-confidence sections in percent."""
    total = F.count(F.lit(1))
    high = F.count_if(F.col("confidence_level") == K.HIGH)
    return classified.groupBy(*by).agg(
        total.alias("total_sections"),
        F.count_if(F.col("section_type") == K.STATIC).alias("static_sections"),
        F.count_if(F.col("section_type") == K.DYNAMIC).alias("dynamic_sections"),
        high.alias("high_confidence_count"),
        F.count_if(F.col("confidence_level") == K.MEDIUM).alias("medium_confidence_count"),
        F.count_if(F.col("confidence_level") == K.LOW).alias("low_confidence_count"),
        F.count_if(F.col("method") == K.RULE_BASED).alias("rule_based_count"),
        F.count_if(F.col("method") == K.LLM_ASSISTED).alias("llm_assisted_count"),
        F.count_if(F.col("method") == K.FALLBACK).alias("fallback_count"),
        F.coalesce(F.try_divide(high, total) * 100, F.lit(0.0)).alias("success_rate"),
    )


def stored_statistics(section_rows: DataFrame, *by: str) -> DataFrame:
    """Statistics over stored sections, where a missing prompt config counts as high confidence."""
    confidence = F.coalesce(F.col("prompt_config.classification_confidence"), F.lit(0.0))
    none = F.col("prompt_config").isNull()
    total = F.count(F.lit(1))
    static = F.count_if(F.col("section_type") == K.STATIC)
    dynamic = F.count_if(F.col("section_type") == K.DYNAMIC)
    return section_rows.groupBy(*by).agg(
        total.alias("total_sections"),
        static.alias("static_sections"),
        dynamic.alias("dynamic_sections"),
        F.count_if(none | (confidence >= 0.9)).alias("high_confidence_count"),
        F.count_if(~none & (confidence >= 0.7) & (confidence < 0.9)).alias("medium_confidence_count"),
        F.count_if(~none & (confidence < 0.7)).alias("low_confidence_count"),
        F.round(static / total * 100, 2).alias("static_percentage"),
        F.round(dynamic / total * 100, 2).alias("dynamic_percentage"),
    )


def sections_of(section_rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Sections of the versions in a table of keys; ``section_no`` orders those of a version."""
    own = section_rows.join(versions.select("template_version_id").distinct(), "template_version_id", "left_semi")
    return own.withColumn("section_no", F.col("section_id"))
