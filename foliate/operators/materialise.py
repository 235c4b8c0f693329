"""Text renditions of assembled documents, their statistics and checks."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliate.functions.text import first_of, runs_text, sha, strip

PAGE_BREAK = "[page break]"
SECTION_BREAK = "[section break]"
#: Characters of missing texts that a task holds.
HELD = 1 << 20


def _cells(row: Column, columns: Column) -> Column:
    texts = F.transform(
        row["cells"], lambda c: F.array_join(F.transform(c["content"], lambda p: runs_text(p["runs"])), "")
    )
    return F.array_join(F.slice(texts, F.lit(1), columns), " | ")


def _columns() -> Column:
    """Stored column count, else the cells of the first row."""
    first = F.coalesce(F.size(F.get("rows", F.lit(0))["cells"]), F.lit(0))
    return F.when(F.coalesce("column_count", F.lit(0)) == 0, first).otherwise(F.col("column_count"))


def rendered_text(block_rows: DataFrame) -> Column:
    """Text of one block; NULL for types that are not rendered and for empty tables."""
    has = set(block_rows.columns)
    text = F.coalesce("text", F.lit(""))
    level = F.greatest(F.lit(0), F.least(F.coalesce("level", F.lit(1)), F.lit(9)))
    cases = [
        (F.col("block_type") == "paragraph", text),
        (F.col("block_type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)),
        (F.col("block_type") == "page_break", PAGE_BREAK),
        (F.col("block_type") == "section_break", SECTION_BREAK),
    ]
    if "rows" in has:
        lines = F.array_join(F.transform("rows", lambda r: _cells(r, _columns())), "\n")
        cases.append(((F.col("block_type") == "table") & _shown_table(), lines))
    if "items" in has:
        numbered = F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"]))
        bullets = F.transform("items", lambda x: F.concat(F.lit("- "), x["text"]))
        cases.append((F.col("block_type") == "list", F.array_join(F.when(F.col("list_type") == "bullet", bullets).otherwise(numbered), "\n")))
    return first_of(cases)


def _shown_table() -> Column:
    return (F.coalesce(F.size("rows"), F.lit(0)) > 0) & (_columns() > 0)


def render(block_rows: DataFrame, *key: str, headers: DataFrame | None = None) -> DataFrame:
    """One text per document: headers, blocks by position, footers; with hash and size.

    A rendition is one value by definition, so the lines of a document meet in one row.
    """
    lines = block_rows.select(*key, F.lit(1).alias("_part"), F.col("position").alias("_at"), rendered_text(block_rows).alias("_line"))
    if headers is not None:
        content = F.array_join(F.transform("content", lambda p: p["text"]), "\n")
        part = F.when(F.col("block_type") == "header", 0).otherwise(2)
        lines = lines.unionByName(headers.select(*key, part.alias("_part"), F.col("sequence").alias("_at"), content.alias("_line")))
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_part", "_at", "_line"))), lambda x: x["_line"]), "\n"
    )
    rows = lines.filter(F.col("_line").isNotNull()).groupBy(*key).agg(text.alias("rendition"))
    return rows.withColumns({"content_hash": sha("rendition"), "file_size_bytes": F.octet_length("rendition")})


def statistics(block_rows: DataFrame, *key: str) -> DataFrame:
    """Rendered blocks by type; the total is the sum of the six types."""
    kind = F.col("block_type")
    table = (kind == "table") & (_shown_table() if "rows" in block_rows.columns else F.lit(True))
    rows = block_rows.groupBy(*key).agg(
        F.count_if(kind == "paragraph").alias("paragraphs"),
        F.count_if(kind == "heading").alias("headings"),
        F.count_if(table).alias("tables"),
        F.count_if(kind == "list").alias("lists"),
        F.count_if(kind == "page_break").alias("page_breaks"),
        F.count_if(kind == "section_break").alias("section_breaks"),
    )
    return rows.withColumn(
        "total_blocks",
        F.col("paragraphs") + F.col("headings") + F.col("tables") + F.col("lists") + F.col("page_breaks") + F.col("section_breaks"),
    )


def check_statistics(expected: DataFrame, found: DataFrame, *key: str) -> DataFrame:
    """Warnings where fewer blocks or paragraphs, or another number of tables, were found; error if empty."""
    f = found.select(*key, *[F.col(c).alias(f"_{c}") for c in ("total_blocks", "paragraphs", "tables")])
    rows = expected.join(f, list(key), "left")

    def warning(label: str, a: str, hit: Column) -> Column:
        return F.when(hit, F.concat(F.lit("Expected "), F.col(a).cast("string"), F.lit(f" {label} but found "), F.col(f"_{a}").cast("string")))

    empty = F.coalesce("_total_blocks", F.lit(0)) == 0
    return rows.select(
        *key,
        F.when(empty, "VALIDATION_FAILED").alias("error_code"),
        F.array_compact(F.array(
            warning("blocks", "total_blocks", F.col("_total_blocks") < F.col("total_blocks")),
            warning("paragraphs", "paragraphs", F.col("_paragraphs") < F.col("paragraphs")),
            warning("tables", "tables", F.col("_tables") != F.col("tables")),
        )).alias("warnings"),
    )


def _without_a_match(wanted: list[str], shown: list[str]) -> list[str]:
    """Wanted texts that are in none of the shown ones and hold none of them.

    One automaton of all wanted texts reads every shown text once, and one of all shown texts reads what is still missing, each
    up to its first match; so the work is that of reading both sides, not of searching each text in each other.
    """
    missing = dict.fromkeys(wanted)
    for text in _reader(wanted, shown):
        missing.pop(text, None)
        if not missing:
            return []
    automaton = _automaton(shown)
    return sorted(t for t in missing if automaton is None or next(automaton.iter(t), None) is None)


def _automaton(texts: list[str]):
    automaton = ahocorasick.Automaton()
    for text in texts:
        automaton.add_word(text, text)
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def _reader(patterns: list[str], texts: list[str]) -> Iterator[str]:
    """Patterns as they are met in the texts; a pattern may come more than once."""
    automaton = _automaton(patterns)
    if automaton is not None:
        for text in texts:
            for _, found in automaton.iter(text):
                yield found


def missing_texts(expected: DataFrame, rendered: DataFrame, *key: str) -> DataFrame:
    """Per document with any, the sorted expected texts that neither are in, nor contain, a rendered text of it.

    Texts present as they are leave first by an anti join on (document, text). Only documents with a rest go on, as one row
    each with the rest and what is shown. No pair of texts is ever emitted.
    """
    key = list(key)
    wanted = expected.select(*key, strip("text").alias("text")).filter("text <> ''").distinct()
    shown = rendered.select(*key, strip("text").alias("text")).filter("text <> ''").distinct()
    rest = wanted.join(shown, [*key, "text"], "left_anti").groupBy(*key).agg(F.collect_list("text").alias("_rest"))
    texts = shown.join(rest.select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list("text").alias("_shown"))
    rows = rest.join(texts, key, "left").select(*key, "_rest", F.coalesce("_shown", F.array().cast("array<string>")).alias("_shown"))

    def run(batches):
        for batch in batches:
            # a document at a time is taken out of its batch, and what is missing leaves in small batches
            own, at, held = [], 0, 0
            for i in range(batch.num_rows):
                own.append(_without_a_match(batch.column(len(key))[i].as_py(), batch.column(len(key) + 1)[i].as_py()))
                held += sum(map(len, own[-1]))
                if held > HELD or i + 1 == batch.num_rows:
                    keys = [c.slice(at, i + 1 - at) for c in batch.columns[: len(key)]]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(own, pa.list_(pa.string()))], [*key, "texts"])
                    own, at, held = [], i + 1, 0

    out = StructType([*[rows.schema[k] for k in key], StructField("texts", ArrayType(StringType()))])
    return rows.mapInArrow(run, out).filter(F.size("texts") > 0)


def missing_content(expected: DataFrame, rendered: DataFrame, *key: str) -> DataFrame:
    """The missing texts as rows."""
    return missing_texts(expected, rendered, *key).select(*key, F.explode("texts").alias("text"))


def missing_warning(missing: DataFrame, *key: str) -> DataFrame:
    """Number of missing texts and up to three samples (first 50 characters) per document, of rows of ``missing_texts``."""
    short = F.transform(F.slice("texts", 1, 3), lambda t: F.substring(t, 1, 50))
    return missing.select(*key, F.size("texts").cast("bigint").alias("missing_texts"), short.alias("samples"))


def compare(first: DataFrame, second: DataFrame, *key: str) -> DataFrame:
    """Two renditions of the same documents, as blocks with ``rendered``: equal, else why not."""
    key = list(key)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, "position", F.struct("block_type", "rendered").alias(name))

    rows = side(first, "_a").join(side(second, "_b"), [*key, "position"], "full_outer")
    a, b = F.col("_a"), F.col("_b")
    differs = ~a.eqNullSafe(b)
    is_table = (F.coalesce(a["block_type"], F.lit("")) == "table") | (F.coalesce(b["block_type"], F.lit("")) == "table")
    out = rows.groupBy(*key).agg(
        F.count_if(differs & ~is_table).alias("_texts"),
        F.count_if(a["block_type"] == "table").alias("_ta"),
        F.count_if(b["block_type"] == "table").alias("_tb"),
        F.min(F.when(differs & is_table, F.col("position"))).alias("_table"),
    )
    reason = first_of([
        (F.col("_texts") > 0, "Paragraph content differs between renders"),
        (F.col("_ta") != F.col("_tb"), F.format_string("Table count differs: %d vs %d", "_ta", "_tb")),
        (F.col("_table").isNotNull(), F.format_string("Table at position %d content differs", "_table")),
    ], F.lit("Content is byte-identical"))
    return out.select(*key, reason.alias("reason"), (reason == "Content is byte-identical").alias("is_identical"))


def render_error(stored: DataFrame, rendered: DataFrame | None = None, key: str = "assembled_document_id") -> DataFrame:
    """``error_code`` of assemblies that may not be rendered; NULL for those that may."""
    rows = stored
    done = F.lit(False)
    if rendered is not None:
        immutable = rendered.filter("is_immutable").select(key, F.lit(True).alias("_rendered")).distinct()
        rows = rows.join(immutable, key, "left")
        done = F.col("_rendered").isNotNull() & ~(F.col("force") if "force" in stored.columns else F.lit(False))
    code = first_of([
        (~F.col("is_immutable"), "DOCUMENT_NOT_IMMUTABLE"),
        (F.col("status") != "VALIDATED", "DOCUMENT_NOT_VALIDATED"),
        (~F.col("has_structure"), "MISSING_ASSEMBLED_STRUCTURE"),
        (done, "ALREADY_RENDERED"),
    ])
    return rows.withColumn("error_code", code).drop("_rendered")
