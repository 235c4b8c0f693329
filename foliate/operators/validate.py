"""Content validation: markup, bounds, quality, and the combined verdict. All per row, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.functions.text import (
    at_line,
    find_all,
    first_of,
    holds_any,
    is_blank,
    matches,
    once,
    present,
    quoted_list,
    sha,
    strip,
    word_profile,
)

CHECKS = (
    "html_tags", "markdown_headers", "markdown_formatting", "markdown_links", "code_blocks",
    "horizontal_rules", "tables", "section_numbering",
)
_PATTERN = {
    "html_tags": K.HTML_TAG,
    "markdown_headers": at_line(K.MD_HEADER),
    "markdown_formatting": K.BOLD_ITALIC,
    "markdown_links": K.LINK,
    "code_blocks": K.CODE,
    "horizontal_rules": at_line(K.HORIZONTAL_RULE),
    "tables": at_line(K.TABLE_ROW),
    "section_numbering": at_line(K.NUMBERING),
}


# Characters without which a pattern cannot match.
_NEEDS = {
    "html_tags": ("<",),
    "markdown_headers": ("#",),
    "markdown_formatting": ("*", "_"),
    "markdown_links": ("](",),
    "code_blocks": ("`",),
    "horizontal_rules": ("--", "**", "__", "-*", "*-", "_-", "-_", "_*", "*_"),
    "tables": ("|",),
    "section_numbering": (".", ")"),
}


def _first(c: Column, pattern: str, n: int) -> Column:
    return F.slice(find_all(c, pattern), 1, n)


def structural(
    df: DataFrame,
    content: str = "content",
    checks: Sequence[str] = CHECKS,
    custom: Sequence[str] = (),
    findings: bool = True,
) -> DataFrame:
    """Forbidden markup: ``structural_valid``, ``structural_codes`` and, if asked, what was found.

    ``checks`` are the switches, ``custom`` further patterns (multiline, any case). Empty content is
    valid.
    """
    return _structural(once(df, _markup(content, checks, custom)), content, custom, findings)


def _markup(content: str, checks: Sequence[str], custom: Sequence[str]) -> dict[str, Column]:
    c = F.coalesce(content, F.lit(""))
    found = {
        f"_has_{name}": F.coalesce(holds_any(content, _NEEDS[name]) & matches(c, _PATTERN[name]), F.lit(False)) if name in checks else F.lit(False)
        for name in CHECKS
    }
    return {**found, **{f"_custom_{i}": F.rlike(c, F.lit(f"(?iumd){p}")) for i, p in enumerate(custom)}}


def _structural(rows: DataFrame, content: str, custom: Sequence[str], findings: bool) -> DataFrame:
    c = F.coalesce(content, F.lit(""))
    has = {name: F.col(f"_has_{name}") for name in CHECKS}
    custom_hits = [F.col(f"_custom_{i}") for i in range(len(custom))]
    any_custom = F.lit(False)
    for hit in custom_hits:
        any_custom = any_custom | hit
    codes = present([
        (has["markdown_links"] | has["code_blocks"], K.CONTAINS_MARKUP),
        (has["html_tags"], K.CONTAINS_TAGS),
        (has["markdown_headers"] | has["section_numbering"], K.CONTAINS_HEADERS),
        (has["markdown_formatting"], K.CONTAINS_FORMATTING),
        (has["horizontal_rules"] | has["tables"] | any_custom, K.STRUCTURAL_MODIFICATION),
    ])
    rows = rows.withColumn("structural_codes", codes).withColumn("structural_valid", F.size("structural_codes") == 0)
    if findings:
        none = F.array().cast("array<string>")

        def listed(name: str, value: Column) -> Column:
            return F.when(has[name], value).otherwise(none)

        rows = rows.withColumns({
            "detected_tags": listed("html_tags", _first(c, _PATTERN["html_tags"], 5)),
            "detected_headers": F.concat(
                listed("markdown_headers", _first(c, _PATTERN["markdown_headers"], 5)),
                listed("section_numbering", _first(c, _PATTERN["section_numbering"], 5)),
            ),
            "detected_formatting": listed("markdown_formatting", _first(c, _PATTERN["markdown_formatting"], 5)),
            "detected_markup": F.concat(
                listed("markdown_links", _first(c, _PATTERN["markdown_links"], 3)),
                listed("code_blocks", F.transform(_first(c, _PATTERN["code_blocks"], 3), lambda _: F.lit("code_block"))),
                listed("horizontal_rules", F.array(F.lit("horizontal_rule"))),
                listed("tables", F.transform(_first(c, _PATTERN["tables"], 3), lambda _: F.lit("table_row"))),
                F.array_compact(F.array(*[F.when(h, F.lit(f"custom_pattern:{p}")) for p, h in zip(custom, custom_hits)]))
                if custom else none,
            ),
        })
        labels = (
            ("detected_tags", "HTML tags detected: "),
            ("detected_headers", "Headers/numbering detected: "),
            ("detected_formatting", "Formatting detected: "),
            ("detected_markup", "Structural markup detected: "),
        )
        parts = [
            F.when(F.size(name) > 0, F.concat(F.lit(label), quoted_list(F.slice(name, 1, 3)))) for name, label in labels
        ]
        rows = rows.withColumn("structural_message", F.when(~F.col("structural_valid"), F.concat_ws("; ", *parts)))
    return rows.drop(*[f"_has_{name}" for name in CHECKS], *[f"_custom_{i}" for i in range(len(custom))])


def bounds(
    df: DataFrame,
    content: str = "content",
    min_length: int = K.MIN_LENGTH,
    max_length: int = K.MAX_LENGTH,
    min_meaningful: int = K.MIN_MEANINGFUL,
) -> DataFrame:
    """Length of the trimmed content against the limits."""
    rows = once(df, {"content_length": F.length(F.coalesce(strip(content), F.lit("")))})
    return _bounds(rows, min_length, max_length, min_meaningful)


def _bounds(rows: DataFrame, min_length: int, max_length: int, min_meaningful: int = K.MIN_MEANINGFUL) -> DataFrame:
    n = F.col("content_length")
    empty, near = n == 0, (n > 0) & (n < min_meaningful)
    short, long = (n > 0) & (n < min_length), n > max_length
    codes = present([
        (empty, K.EMPTY_CONTENT),
        (near, K.NEAR_EMPTY_CONTENT),
        (long, K.CONTENT_TOO_LONG),
        (short, K.CONTENT_TOO_SHORT),
    ])
    number = n.cast("string")
    message = F.concat_ws(
        "; ",
        F.when(empty, F.lit("Content is empty")),
        F.when(near, F.concat(F.lit("Content is near-empty ("), number, F.lit(" chars)"))),
        F.when(short, F.concat(F.lit("Content too short: "), number, F.lit(f" < {min_length}"))),
        F.when(long, F.concat(F.lit("Content too long: "), number, F.lit(f" > {max_length}"))),
    )
    rows = rows.withColumns({"bounds_codes": codes, "bounds_message": F.nullif(message, F.lit(""))})
    return rows.withColumn("bounds_valid", F.size("bounds_codes") == 0)


def word_statistics(df: DataFrame, content: str = "content") -> DataFrame:
    """Total and unique words and the share of the commonest word.

    Counting is done inside the row (sort, one pass); exploding the words would shuffle all text.
    """
    return _word_columns(once(df, {"_words": word_profile(F.coalesce(content, F.lit("")))}))


def _word_columns(rows: DataFrame) -> DataFrame:
    w = F.col("_words")
    return rows.withColumns({
        "total_words": w["total"],
        "unique_words": w["unique"],
        "top_count": w["top"],
        "repetition_ratio": F.when(w["total"] > 0, w["top"] / w["total"]).otherwise(F.lit(0.0)),
    }).drop("_words")


def boilerplate_hits(content: Column | str) -> Column:
    """Numbers (from 1) of the boilerplate patterns that hit the trimmed content."""
    return _boilerplate(strip(content))


def _boilerplate(c: Column) -> Column:
    """One pass with all patterns together; the single ones run only where that hits."""
    anyone = F.rlike(c, F.lit(at_line("|".join(f"(?:{p})" for p in K.BOILERPLATE), True)))
    each = [F.when(F.rlike(c, F.lit(at_line(p, True))), F.lit(i + 1)) for i, p in enumerate(K.BOILERPLATE)]
    return F.when(anyone, F.array_compact(F.array(*each))).otherwise(F.array().cast("array<int>"))


def quality(
    df: DataFrame,
    content: str = "content",
    min_unique_words: int = K.MIN_UNIQUE_WORDS,
    max_repetition: float = K.MAX_REPETITION,
) -> DataFrame:
    """Repetition, boilerplate and vocabulary of the content; empty content is not valid."""
    return _quality(once(_trimmed(df, content), _language()), min_unique_words, max_repetition).drop("_text")


def _trimmed(df: DataFrame, content: str) -> DataFrame:
    """Trim once; length, patterns, words and the accepted text all start from it."""
    return once(df, {"_text": F.coalesce(strip(content), F.lit(""))})


def _language() -> dict[str, Column]:
    c = F.col("_text")
    return {"_words": word_profile(c), "boilerplate_rules": _boilerplate(c)}


def _quality(
    measured: DataFrame, min_unique_words: int = K.MIN_UNIQUE_WORDS, max_repetition: float = K.MAX_REPETITION
) -> DataFrame:
    rows = _word_columns(measured)
    repetitive = (F.col("total_words") >= 10) & (F.col("repetition_ratio") > max_repetition)
    poor = (F.col("unique_words") < min_unique_words) & (F.col("total_words") >= 5)
    boilerplate = F.size("boilerplate_rules") > 0
    blank = F.col("_text") == ""
    codes = F.when(blank, F.array(F.lit(K.EMPTY_CONTENT))).otherwise(
        present([(poor, K.NEAR_EMPTY_CONTENT), (repetitive, K.REPETITIVE_CONTENT), (boilerplate, K.BOILERPLATE_ONLY)])
    )
    shown = F.array(*[F.lit(f"^{p}") for p in K.BOILERPLATE])
    message = F.concat_ws(
        "; ",
        F.when(repetitive, F.concat(F.lit("Content is repetitive (ratio: "), F.format_string("%.2f", "repetition_ratio"), F.lit(")"))),
        F.when(boilerplate, F.concat(F.lit("Boilerplate detected: "), quoted_list(F.transform(F.slice("boilerplate_rules", 1, 2), lambda i: F.get(shown, i - 1))))),
        F.when(poor, F.concat(F.lit("Too few unique words: "), F.col("unique_words").cast("string"))),
    )
    rows = rows.withColumns({
        "is_repetitive": ~blank & repetitive,
        "is_boilerplate": ~blank & boilerplate,
        "quality_codes": codes,
        "quality_message": F.when(blank, F.lit("Cannot validate quality of empty content")).otherwise(F.nullif(message, F.lit(""))),
    })
    return rows.withColumn("quality_valid", F.size("quality_codes") == 0)


# Order of the codes in results.
_ORDER = (
    K.EMPTY_CONTENT, K.NEAR_EMPTY_CONTENT, K.CONTENT_TOO_LONG, K.CONTENT_TOO_SHORT, K.CONTAINS_MARKUP,
    K.CONTAINS_TAGS, K.CONTAINS_HEADERS, K.CONTAINS_FORMATTING, K.STRUCTURAL_MODIFICATION,
    K.REPETITIVE_CONTENT, K.BOILERPLATE_ONLY,
)


def verdict(
    df: DataFrame,
    content: str = "content",
    min_length: int = K.MIN_LENGTH,
    max_length: int = K.MAX_LENGTH,
    checks: Sequence[str] = CHECKS,
    custom: Sequence[str] = (),
    messages: bool = True,
) -> DataFrame:
    """All three validations and what follows from them.

    Adds ``is_valid``, ``error_codes`` (distinct, fixed order), ``failure_type`` (markup before
    bounds before quality), ``is_retryable`` (bounds only), ``validated_content``, ``content_hash``
    and, with ``messages``, ``rejection_reason``. Empty content is judged on bounds alone.
    """
    before = df.columns
    measures = {**_markup(content, checks, custom), **_language(), "content_length": F.length("_text")}
    rows = _structural(once(_trimmed(df, content), measures), content, custom, messages)
    rows = _quality(_bounds(rows, min_length, max_length))
    empty = F.col("content_length") == 0
    rows = rows.withColumns({
        "structural_valid": empty | F.col("structural_valid"),
        "structural_codes": F.when(empty, F.array().cast("array<string>")).otherwise(F.col("structural_codes")),
    })
    every = F.array_union(F.array_union("bounds_codes", "structural_codes"), "quality_codes")
    rows = rows.withColumn("_every", every)
    ordered = F.filter(F.array(*[F.lit(c) for c in _ORDER]), lambda code: F.array_contains(F.col("_every"), code))
    rows = rows.withColumns({
        "is_valid": F.col("bounds_valid") & F.col("structural_valid") & F.col("quality_valid"),
        "error_codes": ordered,
        "failure_type": first_of([
            (~F.col("structural_valid"), K.STRUCTURAL_VIOLATION),
            (~F.col("bounds_valid"), K.BOUNDS_VIOLATION),
            (~F.col("quality_valid"), K.QUALITY_FAILURE),
        ]),
    })
    trimmed = F.when(F.col("is_valid"), F.col("_text"))
    rows = rows.withColumns({
        "is_retryable": F.coalesce(F.col("failure_type") == K.BOUNDS_VIOLATION, F.lit(False)),
        "validated_content": trimmed,
        "content_hash": sha(trimmed),
    })
    extra = ["content_length", "structural_valid", "bounds_valid", "quality_valid", "is_valid", "error_codes",
             "failure_type", "is_retryable", "validated_content", "content_hash"]
    if messages:
        reason = F.when(empty, F.lit("Content is empty")).otherwise(
            F.nullif(F.concat_ws("; ", "bounds_message", "structural_message", "quality_message"), F.lit(""))
        )
        rows = rows.withColumn("rejection_reason", reason)
        extra.append("rejection_reason")
    return rows.select(*[c for c in before if c not in extra], *extra)


def failure_classification(llm_failed: Column, unexpected: Column, failure_type: Column) -> Column:
    return first_of([
        (unexpected, K.UNEXPECTED_ERROR),
        (llm_failed, K.GENERATION_FAILURE),
    ], F.coalesce(failure_type, F.lit(K.VALIDATION_FAILURE)))


def validation_metadata(input_hash: Column, path: Column, attempt: Column) -> Column:
    """Metadata struct of a judged row."""
    return F.struct(
        input_hash.alias("input_hash"),
        path.alias("structural_path"),
        attempt.alias("attempt_number"),
        F.struct(
            "is_valid", "error_codes", "rejection_reason", "structural_valid", "bounds_valid", "quality_valid", "content_length"
        ).alias("validation"),
    )


def constraints(
    df: DataFrame, content: str = "content", min_length: int = K.MIN_LENGTH, max_length: int = K.MAX_LENGTH
) -> DataFrame:
    """The older validator: untrimmed length and one list of forbidden patterns."""
    c = F.coalesce(content, F.lit(""))
    n = F.length(c)
    found = [
        (n < min_length, F.concat(F.lit("Content length "), n.cast("string"), F.lit(f" is below minimum {min_length}"))),
        (n > max_length, F.concat(F.lit("Content length "), n.cast("string"), F.lit(f" exceeds maximum {max_length}"))),
        *[
            (F.rlike(c, F.lit(f"(?md){pattern}")), F.lit(f"Content contains forbidden structural pattern: {shown}"))
            for shown, pattern in K.CONSTRAINT_PATTERNS
        ],
    ]
    violations = F.when(is_blank(content), F.array(F.lit("empty_content"))).otherwise(
        F.array_compact(F.array(*[F.when(hit, message) for hit, message in found]))
    )
    rows = df.withColumn("violations", violations)
    return rows.withColumns({
        "is_valid": F.size("violations") == 0,
        "rejection_code": first_of([(is_blank(content), K.EMPTY_CONTENT), (F.size("violations") > 0, "CONSTRAINT_VIOLATION")]),
        "validated_content": F.when(F.size("violations") == 0, strip(content)),
    })


def rejections_by_code(judged: DataFrame, *by: str) -> DataFrame:
    """Rejected rows per failure type and code; partial counts are merged before the shuffle."""
    return (
        judged.filter(~F.col("is_valid"))
        .select(*by, "failure_type", F.explode("error_codes").alias("error_code"))
        .groupBy(*by, "failure_type", "error_code")
        .agg(F.count(F.lit(1)).alias("rejections"))
    )
