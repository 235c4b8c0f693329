"""Typed blocks from raw elements: numbering, list grouping, tables, headers, outline, suggestions.

An element row is ``(doc, ord, kind 'p' or 'tbl', style_name, outline_level, has_numbering,
list_level, page_break, runs, text)``, with ``table array<array<array<struct<text, runs>>>>`` (rows,
cells, paragraphs) for tables. Windows are per document; the elements of a document come out of one
source row or file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.functions.text import block_id, first_of, is_blank, strip

DOC = "template_version_id"
OUTLINE_BLOCKS = 50
SUGGESTIONS = (
    "array<struct<block_id:string,suggestion_type:string,confidence:string,new_level:int,reason:string>>"
)
_LAYOUT = ("alignment", "indent_left", "indent_right", "indent_first_line", "spacing_before", "spacing_after")


def heading_level(style: Column, outline: Column) -> Column:
    """Level of a heading style, else of the outline; NULL for body text.

    ``Heading N`` in any case gives N (0 counts as body text). The exact spellings ``Title`` and
    ``Subtitle`` decide between 1 and 2; other spellings of those two names give 1.
    """
    digit = F.regexp_extract(style, r"(?i)\AHeading[ \t]*(\d)\z", 1)
    plain = F.lower(style)
    named = first_of([
        (digit != "", F.nullif(digit.try_cast("int"), F.lit(0))),
        ((plain == "subtitle") & style.contains("Subtitle") & ~style.contains("Title"), F.lit(2)),
        (plain.isin("title", "subtitle"), F.lit(1)),
    ])
    is_named = (digit != "") | plain.isin("title", "subtitle")
    return F.when(is_named, named).when((outline >= 0) & (outline < 9), outline + 1)


def is_list_item(style: Column, has_numbering: Column) -> Column:
    return F.coalesce(has_numbering, F.lit(False)) | F.coalesce(F.rlike(style, F.lit("(?i)list|bullet")), F.lit(False))


def points(value: Column) -> Column:
    """Indents and spacings in points; zero and absent are both NULL."""
    return F.nullif(value.cast("double"), F.lit(0.0))


def alignment_name(value: Column) -> Column:
    return F.lower(F.replace(value, F.lit("WD_PARAGRAPH_ALIGNMENT."), F.lit("")))


def kept_runs(runs: Column) -> Column:
    return F.filter(runs, lambda r: F.coalesce(r["text"] != "", F.lit(False)))


def _numbered(elements: DataFrame, doc: str) -> DataFrame:
    """Drop blanks, mark list items and count the flushes of the list buffer."""
    rows = elements.filter(~((F.col("kind") == "p") & is_blank("text") & (F.coalesce(F.size("runs"), F.lit(0)) <= 0)))
    rows = rows.withColumn("_item", (F.col("kind") == "p") & is_list_item(F.col("style_name"), F.col("has_numbering")))
    w = W.partitionBy(doc).orderBy("ord")
    flush = F.coalesce(F.lag("_item").over(w), F.lit(False)) & ~F.col("_item")
    rows = rows.withColumns({"_flush": flush, "_n": F.row_number().over(w), "_next": F.lead("kind").over(w)})
    return rows.withColumn("_k", F.sum(F.col("_flush").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))


def _table_rows(table: Column) -> Column:
    def paragraph(p: Column, i: Column) -> Column:
        return F.struct(
            block_id("cell_para", i, F.substring(strip(p["text"]), 1, 30)).alias("block_id"),
            i.alias("sequence"),
            kept_runs(p["runs"]).alias("runs"),
        )

    def cell(r: Column):
        return lambda c, i: F.struct(
            block_id("cell", r * 100 + i).alias("cell_id"),
            r.alias("row_index"),
            i.alias("col_index"),
            F.transform(F.filter(c, lambda p: ~is_blank(p["text"])), paragraph).alias("content"),
        )

    return F.transform(
        table,
        lambda cells, r: F.struct(
            block_id("row", r).alias("row_id"),
            r.alias("row_index"),
            (r == 0).alias("is_header"),
            F.transform(cells, cell(r)).alias("cells"),
        ),
    )


def blocks(elements: DataFrame, doc: str = DOC) -> DataFrame:
    """Blocks in output order (``position``) with their numbers (``sequence``).

    Numbers follow the single counter of the source semantics: every kept paragraph or table takes
    one, list items too although only their list survives; a list takes one more when it is closed:
    after the paragraph that ends it, but before a table that does. So numbers have gaps, and a list
    may carry a higher number than the paragraph behind it.
    """
    has_table = "table" in elements.columns
    rows = _numbered(elements, doc)
    late = (F.col("_flush") & (F.col("kind") == "p")).cast("int")
    layout = [c for c in _LAYOUT if c in elements.columns]
    single = F.struct(
        (F.col("_n") + F.col("_k") - late).cast("bigint").alias("sequence"),
        "kind", "style_name", "outline_level", "page_break", "runs", "text", *layout,
        *(["table"] if has_table else []),
    )
    item = F.struct(
        "ord",
        F.coalesce("list_level", F.lit(0)).alias("level"),
        "text",
        "runs",
    )
    bullet = F.lower(F.coalesce("style_name", F.lit(""))).contains("bullet") | F.col("text").contains("•")
    # Lists are keyed by their flush count, other elements by their own ord: one grouping for both.
    grouped = rows.groupBy(doc, "_item", F.when(F.col("_item"), F.col("_k")).otherwise(F.col("ord")).alias("_group")).agg(
        F.min("ord").alias("_first"),
        F.any_value(F.when(~F.col("_item"), single), True).alias("_s"),
        F.array_sort(F.collect_list(F.when(F.col("_item"), item))).alias("_items"),
        F.min_by(F.when(bullet, "bullet").otherwise("numbered"), "ord").alias("_list_type"),
        F.max("_n").alias("_last_n"),
        F.max_by("_next", "ord").alias("_closer"),
        F.max("_k").alias("_k"),
    )
    s = F.col("_s")
    level = heading_level(s["style_name"], s["outline_level"])
    kind = first_of([
        (F.col("_item"), "list"),
        (s["kind"] == "tbl", "table"),
        (s["page_break"], "page_break"),
        (level.isNotNull(), "heading"),
    ], F.lit("paragraph"))
    list_number = F.col("_last_n") + F.col("_k") + F.when(F.col("_closer") == "p", 2).otherwise(1)
    sequence = F.when(F.col("_item"), list_number.cast("bigint")).otherwise(s["sequence"])
    items = F.transform(
        "_items",
        lambda x, i: F.struct(
            block_id("list_item", i, F.substring(strip(x["text"]), 1, 30)).alias("item_id"),
            i.alias("index"),
            x["level"].alias("level"),
            x["text"].alias("text"),
            kept_runs(x["runs"]).alias("runs"),
        ),
    )
    named = grouped.withColumns({"block_type": kind, "sequence": sequence})
    textual = F.col("block_type").isin("heading", "paragraph")
    table_rows = F.when(F.col("block_type") == "table", _table_rows(s["table"])) if has_table else F.lit(None).cast(
        "array<struct<row_id:string,row_index:int,is_header:boolean,cells:array<struct<cell_id:string,row_index:int,"
        "col_index:int,content:array<struct<block_id:string,sequence:int,runs:array<struct<text:string>>>>>>>>"
    )
    out = named.select(
        doc,
        block_id(F.col("block_type"), F.col("sequence"), F.when(textual, F.substring(strip(s["text"]), 1, 50)).otherwise("")).alias("block_id"),
        (F.row_number().over(W.partitionBy(doc).orderBy("_first")) - 1).cast("bigint").alias("position"),
        "sequence",
        "block_type",
        F.when(F.col("block_type") == "heading", level).alias("level"),
        F.when(textual, s["style_name"]).alias("style_name"),
        F.when(textual, s["text"]).alias("text"),
        F.when(textual, kept_runs(s["runs"])).alias("runs"),
        *[F.when(textual, alignment_name(s[c]) if c == "alignment" else points(s[c])).alias(c) for c in layout],
        F.when(F.col("_item"), F.col("_list_type")).alias("list_type"),
        F.when(F.col("_item"), items).alias("items"),
        table_rows.alias("rows"),
    )
    widest = F.array_max(F.transform("rows", lambda r: F.size(r["cells"])))
    return out.withColumn("column_count", F.when(F.col("block_type") == "table", F.coalesce(widest, F.lit(0))))


def last_number(elements: DataFrame, doc: str = DOC) -> DataFrame:
    """Counter after the body of every document, where the header numbers go on."""
    open_list = F.max_by(F.col("_item"), "ord").cast("int")
    return _numbered(elements, doc).groupBy(doc).agg(
        (F.max("_n") + F.max("_k") + open_list).cast("bigint").alias("last_sequence")
    )


def headers_footers(paragraphs: DataFrame, last: DataFrame, doc: str = DOC) -> DataFrame:
    """Header and footer blocks from ``(doc, section_no, part, variant, ord, text, runs)``.

    Per section and variant (default, first, even) the non-blank paragraphs, kept only if any.
    """
    kept = paragraphs.filter(~is_blank("text"))
    grouped = kept.groupBy(doc, "section_no", "part", "variant").agg(
        F.array_sort(F.collect_list(F.struct("ord", "text", "runs"))).alias("_paragraphs")
    )
    variant = F.array_position(F.array(F.lit("default"), F.lit("first"), F.lit("even")), F.col("variant"))
    w = W.partitionBy(doc).orderBy("section_no", F.when(F.col("part") == "header", 0).otherwise(1), variant)
    rows = grouped.withColumn("_r", F.row_number().over(w)).join(last, doc, "left")
    sequence = (F.coalesce("last_sequence", F.lit(0)) + F.col("_r")).cast("bigint")
    content = F.transform(
        "_paragraphs",
        lambda p, i: F.struct(
            block_id(F.concat("part", F.lit("_para")), i, F.substring(strip(p["text"]), 1, 30)).alias("block_id"),
            i.alias("sequence"),
            p["text"].alias("text"),
            kept_runs(p["runs"]).alias("runs"),
        ),
    )
    return rows.select(
        doc,
        block_id(F.col("part"), sequence).alias("block_id"),
        sequence.alias("sequence"),
        F.col("part").alias("block_type"),
        F.col("variant").alias("header_footer_type"),
        content.alias("content"),
    )


def cells(block_rows: DataFrame, doc: str = DOC) -> DataFrame:
    """Tables as one row per cell."""
    flat = block_rows.filter(F.col("block_type") == "table").select(
        doc, "block_id", "column_count", F.explode("rows").alias("row")
    ).select(doc, "block_id", "column_count", "row.row_id", "row.is_header", F.explode("row.cells").alias("cell"))
    texts = F.transform("cell.content", lambda p: F.array_join(F.transform(p["runs"], lambda r: r["text"]), ""))
    return flat.select(
        doc, "block_id", "column_count", "row_id", "is_header", "cell.cell_id", "cell.row_index", "cell.col_index",
        F.array_join(texts, "").alias("text"),
    )


def statistics(block_rows: DataFrame, *by: str) -> DataFrame:
    """Number of blocks, headings, paragraphs, tables and lists."""
    return block_rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_blocks"),
        *[F.count_if(F.col("block_type") == t).alias(f"{t}_count") for t in ("heading", "paragraph", "table", "list")],
    )


def outline(block_rows: DataFrame, doc: str = DOC) -> DataFrame:
    """Counts and the first 50 blocks of each document as text; only those 50 lines are gathered."""
    label = first_of([
        (F.col("block_type") == "heading", F.concat(F.lit("HEADING L"), F.col("level").cast("string"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 60))),
        (F.col("block_type") == "paragraph", F.concat(F.lit("PARAGRAPH: "), F.substring(F.coalesce("text", F.lit("")), 1, 60))),
    ], F.upper("block_type"))
    line = F.concat(F.lit("  ["), F.col("block_id"), F.lit("] "), label)
    stats = statistics(block_rows, doc)
    lines = block_rows.filter(F.col("position") < OUTLINE_BLOCKS).groupBy(doc).agg(
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("_lines")
    )
    more = F.when(
        F.col("total_blocks") > OUTLINE_BLOCKS,
        F.concat(F.lit("  ... and "), (F.col("total_blocks") - OUTLINE_BLOCKS).cast("string"), F.lit(" more blocks")),
    )
    summary = F.concat_ws(
        "\n",
        F.format_string("Document has %d blocks:", "total_blocks"),
        F.format_string("- %d headings", "heading_count"),
        F.format_string("- %d paragraphs", "paragraph_count"),
        F.format_string("- %d tables", "table_count"),
        F.format_string("- %d lists", "list_count"),
        F.lit(""),
        F.lit("Block structure (first 50 blocks):"),
        F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"),
        more,
    )
    return stats.join(lines, doc).select(doc, summary.alias("outline"))


# --- suggestions ------------------------------------------------------------------------------
def parse_suggestions(replies: DataFrame, content: str = "content", doc: str = DOC) -> DataFrame:
    """Reply texts, optionally in a code fence, as one row per suggestion; bad JSON gives none.

    A suggestion without confidence has 0.5; one whose confidence is no number is skipped.
    """
    text = strip(content)
    inner = F.when(text.startswith("```"), F.regexp_replace(F.get(F.split(text, "```"), 1), r"\Ajson", "")).otherwise(text)
    exploded = replies.select(doc, F.posexplode(F.from_json(inner, SUGGESTIONS)).alias("pos", "s"))
    confidence = F.coalesce(F.col("s.confidence"), F.lit("0.5")).try_cast("double")
    return exploded.filter(F.col("s.block_id").isNotNull() & F.col("s.suggestion_type").isNotNull() & confidence.isNotNull()).select(
        doc, "pos", "s.block_id", "s.suggestion_type",
        confidence.alias("confidence"),
        "s.new_level", F.coalesce("s.reason", F.lit("")).alias("reason"),
    )


def valid_suggestions(suggestions: DataFrame, block_rows: DataFrame, doc: str = DOC) -> DataFrame:
    """Suggestions about an existing block, of a known type, with a level of 1 to 9 or none."""
    fine = F.col("suggestion_type").isin(*K.SUGGESTION_TYPES) & (
        F.col("new_level").isNull() | F.col("new_level").between(1, 9)
    )
    return suggestions.filter(fine).join(block_rows.select(doc, "block_id"), [doc, "block_id"], "left_semi")


def _applies(suggestion_type: Column, new_level: Column, block_type: Column, confidence: Column, threshold: float) -> Column:
    promote = (suggestion_type == "promote_to_heading") & (block_type == "paragraph")
    adjust = (suggestion_type == "adjust_level") & (block_type == "heading") & new_level.isNotNull()
    return (confidence >= threshold) & (promote | adjust)


def apply_suggestions(block_rows: DataFrame, suggestions: DataFrame, threshold: float = K.DEFAULT_THRESHOLD, doc: str = DOC) -> DataFrame:
    """Promote paragraphs and change heading levels; of several suggestions for a block the last wins."""
    last = suggestions.filter(F.col("confidence") >= threshold).groupBy(doc, "block_id").agg(
        F.max_by(
            F.struct(F.coalesce("new_level", F.lit(2)).alias("level")),
            F.when(F.col("suggestion_type") == "promote_to_heading", F.col("pos")),
        ).alias("_promote"),
        F.max_by(
            F.struct(F.col("new_level").alias("level")),
            F.when((F.col("suggestion_type") == "adjust_level") & F.col("new_level").isNotNull(), F.col("pos")),
        ).alias("_adjust"),
    )
    rows = block_rows.join(last, [doc, "block_id"], "left")
    promoted = (F.col("block_type") == "paragraph") & F.col("_promote").isNotNull()
    adjusted = (F.col("block_type") == "heading") & F.col("_adjust").isNotNull()
    return rows.withColumns({
        "level": F.when(promoted, F.col("_promote.level")).when(adjusted, F.col("_adjust.level")).otherwise(F.col("level")),
        "block_type": F.when(promoted, F.lit("heading")).otherwise(F.col("block_type")),
    }).select(*block_rows.columns)


def suggestion_counts(block_rows: DataFrame, suggestions: DataFrame, threshold: float = K.DEFAULT_THRESHOLD, doc: str = DOC) -> DataFrame:
    """Applied and skipped suggestions per document."""
    rows = suggestions.join(block_rows.select(doc, "block_id", "block_type"), [doc, "block_id"], "left")
    hit = F.coalesce(
        _applies(F.col("suggestion_type"), F.col("new_level"), F.col("block_type"), F.col("confidence"), threshold),
        F.lit(False),
    )
    return rows.groupBy(doc).agg(
        F.count(F.lit(1)).alias("suggestions_count"),
        F.count_if(hit).alias("applied_count"),
        F.count_if(~hit).alias("skipped_count"),
    )


def parse_summary(block_rows: DataFrame, headers: DataFrame, versions: DataFrame, doc: str = DOC) -> DataFrame:
    """Per version: content hash, block counts, header and footer counts."""
    extra = headers.groupBy(doc).agg(
        F.count_if(F.col("block_type") == "header").alias("header_count"),
        F.count_if(F.col("block_type") == "footer").alias("footer_count"),
    )
    counted = versions.join(statistics(block_rows, doc), doc, "left").join(extra, doc, "left")
    names = ("total_blocks", "heading_count", "paragraph_count", "table_count", "list_count", "header_count", "footer_count")
    return counted.fillna(0, list(names))
