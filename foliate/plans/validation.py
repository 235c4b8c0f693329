"""Queries: content validation of documents and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.operators import validate as V
from foliate.plans import ddl
from foliate.plans.ddl import hit, line, strip, text
from foliate.plans.registry import query
from foliate.sources import tables as T


def _documents(spark, sf_dir):
    return T.documents(spark, sf_dir).select("doc_id", "source", F.col("text").alias("content"))


_FLAGS = f"""{hit('text', K.HTML_TAG)} AS tags, {hit('text', line(K.MD_HEADER))} AS md_headers,
  {hit('text', K.BOLD_ITALIC)} AS formatting, {hit('text', K.LINK)} AS links, {hit('text', K.CODE)} AS code,
  {hit('text', line(K.HORIZONTAL_RULE))} AS hr, {hit('text', line(K.TABLE_ROW))} AS table_rows,
  {hit('text', line(K.NUMBERING))} AS numbering"""
_BOILERPLATE = " + ".join(f"{hit(strip('text'), line(p, True))}::INT" for p in K.BOILERPLATE)


def judged(source: str, key: str) -> str:
    """SQL of the verdict for table ``source(key, text)``."""
    return f"""flags AS (SELECT {key}, text, length({strip('text')}) AS n, {_FLAGS}, {_BOILERPLATE} AS boilerplate FROM {source}),
word_rows AS (
  SELECT {key}, unnest(regexp_extract_all(lower(text), {text(f'[{K.WORD}]+')})) AS word FROM {source}),
word_counts AS (SELECT {key}, word, count(*) AS c FROM word_rows GROUP BY ALL),
word_stats AS (SELECT {key}, sum(c) AS total, count(*) AS uniq, max(c) AS top FROM word_counts GROUP BY {key}),
measures AS (
  SELECT f.*, coalesce(w.total, 0)::BIGINT AS total, coalesce(w.uniq, 0) AS uniq, coalesce(w.top, 0) AS top,
    CASE WHEN w.total > 0 THEN w.top / w.total ELSE 0.0 END AS ratio
  FROM flags f LEFT JOIN word_stats w USING ({key})),
findings AS (
  SELECT *, n = 0 AS empty, n > 0 AND (tags OR md_headers OR formatting OR links OR code OR hr OR table_rows OR numbering) AS structural,
    n < 10 OR n > 50000 AS bounds, n > 0 AND total >= 10 AND ratio > 0.5 AS repetitive,
    n > 0 AND uniq < 5 AND total >= 5 AS poor, n > 0 AND boilerplate > 0 AS boiler
  FROM measures),
judged AS (
  SELECT *, NOT (empty OR structural OR bounds OR repetitive OR poor OR boiler) AS is_valid,
    CASE WHEN structural THEN 'STRUCTURAL_VIOLATION' WHEN bounds THEN 'BOUNDS_VIOLATION'
         WHEN repetitive OR poor OR boiler THEN 'QUALITY_FAILURE' END AS failure_type,
    concat_ws(',', CASE WHEN empty THEN 'EMPTY_CONTENT' END,
      CASE WHEN (n > 0 AND n < 10) OR poor THEN 'NEAR_EMPTY_CONTENT' END,
      CASE WHEN n > 50000 THEN 'CONTENT_TOO_LONG' END,
      CASE WHEN structural AND (links OR code) THEN 'CONTAINS_MARKUP' END,
      CASE WHEN structural AND tags THEN 'CONTAINS_TAGS' END,
      CASE WHEN structural AND (md_headers OR numbering) THEN 'CONTAINS_HEADERS' END,
      CASE WHEN structural AND formatting THEN 'CONTAINS_FORMATTING' END,
      CASE WHEN structural AND (hr OR table_rows) THEN 'STRUCTURAL_MODIFICATION' END,
      CASE WHEN repetitive THEN 'REPETITIVE_CONTENT' END,
      CASE WHEN boiler THEN 'BOILERPLATE_ONLY' END) AS error_codes
  FROM findings)"""


def _list(pattern: str, n: int) -> str:
    return f"array_to_string(list_slice(regexp_extract_all(text, {text(pattern)}), 1, {n}), '|')"


@query(
    "structural_violations",
    f"""SELECT doc_id, {_list(K.HTML_TAG, 5)} AS tags, {_list(line(K.MD_HEADER), 5)} AS md_headers,
  {_list(K.BOLD_ITALIC, 5)} AS formatting, {_list(line(K.NUMBERING), 5)} AS numbering FROM documents""",
)
def structural_violations(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    only_headers = V.structural(rows, checks=("html_tags", "markdown_headers", "markdown_formatting"))
    first = only_headers.select(
        "doc_id", "content",
        F.array_join("detected_tags", "|").alias("tags"),
        F.array_join("detected_headers", "|").alias("md_headers"),
        F.array_join("detected_formatting", "|").alias("formatting"),
    )
    second = V.structural(first, checks=("section_numbering",))
    return second.select("doc_id", "tags", "md_headers", "formatting", F.array_join("detected_headers", "|").alias("numbering"))


@query(
    "bounds_check",
    f"""SELECT doc_id, length({strip('text')}) AS content_length, length({strip('text')}) BETWEEN 200 AND 5000 AS bounds_valid,
  concat_ws(',', CASE WHEN length({strip('text')}) BETWEEN 1 AND 9 THEN 'NEAR_EMPTY_CONTENT' END,
    CASE WHEN length({strip('text')}) > 5000 THEN 'CONTENT_TOO_LONG' END,
    CASE WHEN length({strip('text')}) BETWEEN 1 AND 199 THEN 'CONTENT_TOO_SHORT' END) AS codes,
  nullif(concat_ws('; ', CASE WHEN length({strip('text')}) BETWEEN 1 AND 9 THEN 'Content is near-empty (' || length({strip('text')}) || ' chars)' END,
    CASE WHEN length({strip('text')}) BETWEEN 1 AND 199 THEN 'Content too short: ' || length({strip('text')}) || ' < 200' END,
    CASE WHEN length({strip('text')}) > 5000 THEN 'Content too long: ' || length({strip('text')}) || ' > 5000' END), '') AS message
FROM documents""",
)
def bounds_check(spark, sf_dir):
    return V.bounds(_documents(spark, sf_dir), min_length=200, max_length=5000).select(
        "doc_id", "content_length", "bounds_valid", F.array_join("bounds_codes", ",").alias("codes"),
        F.col("bounds_message").alias("message"),
    )


@query(
    "word_statistics",
    ddl.with_(judged("documents", "doc_id"))
    + "SELECT doc_id, total AS total_words, uniq AS unique_words, top AS top_count, ratio AS repetition_ratio FROM measures",
)
def word_statistics(spark, sf_dir):
    return V.word_statistics(_documents(spark, sf_dir)).select(
        "doc_id", "total_words", "unique_words", "top_count", "repetition_ratio"
    )


@query(
    "boilerplate_hits",
    f"""SELECT {', '.join(f"count(*) FILTER ({hit(strip('text'), line(p, True))}) AS rule_{i + 1}" for i, p in enumerate(K.BOILERPLATE))},
  source FROM documents GROUP BY source""",
)
def boilerplate_hits(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("source", V.boilerplate_hits("content").alias("hits"))
    return rows.groupBy("source").agg(
        *[F.count_if(F.array_contains("hits", i + 1)).alias(f"rule_{i + 1}") for i in range(len(K.BOILERPLATE))]
    )


_VERDICT = "doc_id, n AS content_length, is_valid, failure_type, error_codes, coalesce(failure_type = 'BOUNDS_VIOLATION', false) AS is_retryable"


@query(
    "content_verdict",
    ddl.with_(judged("documents", "doc_id"))
    + f"SELECT {_VERDICT}, CASE WHEN is_valid THEN sha256({strip('text')}) END AS content_hash FROM judged",
)
def content_verdict(spark, sf_dir):
    return V.verdict(_documents(spark, sf_dir), messages=False).select(
        "doc_id", "content_length", "is_valid", "failure_type", F.array_join("error_codes", ",").alias("error_codes"),
        "is_retryable", "content_hash",
    )


@query(
    "rejection_breakdown",
    ddl.with_(judged("documents", "doc_id"))
    + """SELECT failure_type, error_code, count(*) AS rejections
FROM (SELECT failure_type, unnest(string_split(error_codes, ',')) AS error_code FROM judged WHERE NOT is_valid) GROUP BY ALL""",
)
def rejection_breakdown(spark, sf_dir):
    return V.rejections_by_code(V.verdict(_documents(spark, sf_dir), messages=False))


@query(
    "quality_by_label",
    ddl.with_(judged("documents", "doc_id"))
    + """SELECT l.quality, l.toxic, count(*) AS documents, count(*) FILTER (j.is_valid) AS valid_documents
FROM judged j JOIN labels l USING (doc_id) GROUP BY l.quality, l.toxic""",
)
def quality_by_label(spark, sf_dir):
    """Validation outcome per slice of the label table."""
    v = V.verdict(_documents(spark, sf_dir), messages=False).select("doc_id", "is_valid")
    return v.join(T.table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("is_valid").alias("valid_documents")
    )


_CONSTRAINTS = " + ".join(f"{hit('text', '(?m)' + p)}::INT" for _, p in K.CONSTRAINT_PATTERNS)


@query(
    "constraint_check",
    f"""SELECT doc_id, {strip('text')} <> '' AND length(text) <= 5000 AND ({_CONSTRAINTS}) = 0 AS is_valid,
  CASE WHEN {strip('text')} = '' THEN 'EMPTY_CONTENT' WHEN length(text) > 5000 OR ({_CONSTRAINTS}) > 0 THEN 'CONSTRAINT_VIOLATION' END AS rejection_code,
  CASE WHEN {strip('text')} = '' THEN 1 ELSE (length(text) > 5000)::INT + {_CONSTRAINTS} END AS violations FROM documents""",
)
def constraint_check(spark, sf_dir):
    return V.constraints(_documents(spark, sf_dir), max_length=5000).select(
        "doc_id", "is_valid", "rejection_code", F.size("violations").alias("violations")
    )
