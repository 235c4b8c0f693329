"""Queries: block extraction from text and HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliate.functions import constants as K
from foliate.operators import blocks as B
from foliate.operators import classify as C
from foliate.plans import ddl
from foliate.plans.registry import query
from foliate.session import stored
from foliate.sources import tables as T

# The HTML cut, in SQL: same marks, same tag sets.
_CUT = r"""cut AS (
  SELECT page_id, string_split(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->|<(?:script|style|title)[^>]*>.*?</(?:script|style|title)>', '', 'g'),
      '(?i)<(h[1-6]|p|li)(?:[ \t\n\r/][^>]*)?>', chr(1) || '\1' || chr(2), 'g'),
      '(?i)</?(?:h[1-6]|p|li|ul|ol|nav|article|section|div|body|html|head|header|footer|aside|main|form|blockquote|table|thead|tbody|tfoot|tr|td|th|caption|dl|dt|dd|pre|figure|figcaption|option)(?:[ \t\n\r/][^>]*)?>', chr(1) || '-' || chr(2), 'g'),
      '<[^>]*>', '', 'g'), chr(1)) AS pieces
  FROM pages),
pieces AS (
  SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS ord FROM cut),
named AS (
  SELECT page_id, ord, CASE WHEN contains(piece, chr(2)) THEN lower(split_part(piece, chr(2), 1)) ELSE '-' END AS tag,
    CASE WHEN contains(piece, chr(2)) THEN split_part(piece, chr(2), 2) ELSE piece END AS raw FROM pieces),
""" + f"""plain AS (
  SELECT page_id, ord, tag, {ddl.strip('''replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'),
      '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')''')} AS text FROM named),
elements AS (
  SELECT page_id AS template_version_id, ord - 1 AS ord, CASE tag WHEN '-' THEN 'p' ELSE tag END AS tag, text
  FROM plain WHERE tag <> '-' OR text <> '')"""

# Numbering by an explicit walk over the kept elements: items count, each list counts once more.
_HTML_BLOCKS = _CUT + """,
kept AS (
  SELECT *, tag = 'li' AS item,
    row_number() OVER w AS n,
    coalesce(lag(tag = 'li') OVER w, false) AND tag <> 'li' AS closes
  FROM elements WHERE text <> '' WINDOW w AS (PARTITION BY template_version_id ORDER BY ord)),
counted AS (
  SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY template_version_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed_before,
    sum(closes::INT) OVER (PARTITION BY template_version_id ORDER BY ord) AS closed,
    max(n) OVER (PARTITION BY template_version_id) AS total
  FROM kept),
singles AS (
  SELECT template_version_id, ord AS first_ord, n + closed_before AS sequence,
    CASE WHEN tag = 'p' THEN 'paragraph' ELSE 'heading' END AS block_type,
    CASE WHEN tag <> 'p' THEN CAST(tag[2:2] AS INT) END AS level, text, NULL AS item_count, NULL AS items
  FROM counted WHERE NOT item),
lists AS (
  SELECT template_version_id, min(ord) AS first_ord,
    -- closed by the next paragraph or heading: numbered right after it; else at the end
    CASE WHEN max(n) < max(total) THEN max(n) + 1 + max(closed) + 1 ELSE max(n) + max(closed) + 1 END AS sequence,
    'list' AS block_type, NULL AS level, NULL AS text, count(*) AS item_count,
    string_agg(text, '|' ORDER BY ord) AS items
  FROM counted WHERE item GROUP BY template_version_id, closed),
html_blocks AS (
  SELECT *, row_number() OVER (PARTITION BY template_version_id ORDER BY first_ord) - 1 AS position,
    printf('blk_%s_%04d_%s', left(block_type, 3), CAST(sequence AS BIGINT),
      left(sha256(block_type || ':' || CAST(sequence AS BIGINT) || ':' || left(coalesce(text, ''), 50)), 12)) AS block_id
  FROM (SELECT * FROM singles UNION ALL SELECT * FROM lists))"""


def html_blocks(spark, sf_dir):
    return B.blocks(T.html_elements(spark, sf_dir))


@query(
    "text_blocks",
    ddl.with_(ddl.BLOCKS)
    + "SELECT template_version_id, template_id, block_id, position, sequence, total_blocks, text FROM blocks",
)
def text_blocks(spark, sf_dir):
    return T.text_blocks(spark, sf_dir).select(
        "template_version_id", "template_id", "block_id", "position", "sequence", "total_blocks", "text"
    )


@query(
    "html_blocks",
    ddl.with_(_HTML_BLOCKS)
    + "SELECT template_version_id, block_id, position, CAST(sequence AS BIGINT) AS sequence, block_type, level, text, item_count, items FROM html_blocks",
)
def html_block_rows(spark, sf_dir):
    is_list = F.col("block_type") == "list"
    return html_blocks(spark, sf_dir).select(
        "template_version_id", "block_id", "position", "sequence", "block_type", "level", "text",
        F.when(is_list, F.size("items")).cast("bigint").alias("item_count"),
        F.when(is_list, F.array_join(F.transform("items", lambda x: x["text"]), "|")).alias("items"),
    )


@query(
    "page_text",
    r"""WITH shown AS (
  SELECT page_id, regexp_replace(regexp_replace(html,
    '(?is)<!--.*?-->|<(?:script|style|title)[^>]*>.*?</(?:script|style|title)>', '', 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
decoded AS (
  SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '),
    '&amp;', '&'), '[ \t\n\r\f\v]', '', 'g') AS t FROM shown)
SELECT page_id AS template_version_id, length(t) AS letters, md5(t) AS digest FROM decoded WHERE t <> ''""",
)
def page_text(spark, sf_dir):
    """All visible text of a page is in its elements: letters and digest of the texts without white space."""
    texts = T.html_elements(spark, sf_dir).filter(F.col("text") != "")
    pieces = F.array_sort(F.collect_list(F.struct("ord", "text")))
    rows = texts.groupBy("template_version_id").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("t"))
    bare = rows.select("template_version_id", F.regexp_replace("t", r"[ \t\n\r\f\x0B]", "").alias("t"))
    return bare.select("template_version_id", F.length("t").cast("bigint").alias("letters"), F.md5("t").alias("digest"))


@query(
    "list_items",
    ddl.with_(_HTML_BLOCKS, f"""items AS (
  SELECT c.template_version_id, l.block_id AS list_id, c.text,
    row_number() OVER (PARTITION BY c.template_version_id, c.closed ORDER BY c.ord) - 1 AS item_index
  FROM counted c JOIN html_blocks l ON l.template_version_id = c.template_version_id AND l.block_type = 'list'
   AND l.first_ord = (SELECT min(d.ord) FROM counted d WHERE d.item AND d.closed = c.closed AND d.template_version_id = c.template_version_id)
  WHERE c.item)""")
    + """SELECT template_version_id, list_id, item_index, 0 AS item_level, text,
  printf('blk_lis_%04d_%s', item_index, left(sha256('list_item:' || item_index || ':' || left(text, 30)), 12)) AS item_id FROM items""",
)
def list_items(spark, sf_dir):
    rows = html_blocks(spark, sf_dir).filter(F.col("block_type") == "list")
    exploded = rows.select("template_version_id", F.col("block_id").alias("list_id"), F.explode("items").alias("item"))
    return exploded.select(
        "template_version_id", "list_id",
        F.col("item.index").cast("bigint").alias("item_index"),
        F.col("item.level").alias("item_level"), "item.text", "item.item_id",
    )


@query(
    "block_statistics",
    ddl.with_(_HTML_BLOCKS)
    + """SELECT template_version_id, count(*) AS total_blocks,
  count(*) FILTER (block_type = 'heading') AS heading_count, count(*) FILTER (block_type = 'paragraph') AS paragraph_count,
  count(*) FILTER (block_type = 'table') AS table_count, count(*) FILTER (block_type = 'list') AS list_count
FROM html_blocks GROUP BY template_version_id""",
)
def block_statistics(spark, sf_dir):
    return B.statistics(html_blocks(spark, sf_dir), "template_version_id")


@query(
    "document_properties",
    r"""SELECT page_id AS template_version_id,
  replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS title,
  regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang FROM pages""",
)
def document_properties(spark, sf_dir):
    return T.page_properties(spark, sf_dir)


@query(
    "block_outline",
    ddl.with_(_HTML_BLOCKS)
    + """SELECT template_version_id, 'Document has ' || count(*) || ' blocks:' || chr(10)
  || '- ' || count(*) FILTER (block_type = 'heading') || ' headings' || chr(10)
  || '- ' || count(*) FILTER (block_type = 'paragraph') || ' paragraphs' || chr(10)
  || '- ' || count(*) FILTER (block_type = 'table') || ' tables' || chr(10)
  || '- ' || count(*) FILTER (block_type = 'list') || ' lists' || chr(10) || chr(10)
  || 'Block structure (first 50 blocks):' || chr(10)
  || string_agg('  [' || block_id || '] ' || CASE block_type WHEN 'heading' THEN 'HEADING L' || level || ': ' || left(text, 60)
       WHEN 'paragraph' THEN 'PARAGRAPH: ' || left(text, 60) ELSE upper(block_type) END, chr(10) ORDER BY position) FILTER (position < 50)
  || CASE WHEN count(*) > 50 THEN chr(10) || '  ... and ' || (count(*) - 50) || ' more blocks' ELSE '' END AS outline
FROM html_blocks GROUP BY template_version_id""",
)
def block_outline(spark, sf_dir):
    return B.outline(html_blocks(spark, sf_dir))


@query(
    "neighbour_context",
    ddl.with_(_HTML_BLOCKS)
    + """SELECT template_version_id, block_id, position AS position_in_document,
  count(*) OVER (PARTITION BY template_version_id) AS total_blocks,
  lag(block_type) OVER (PARTITION BY template_version_id ORDER BY position) AS previous_block_type,
  lead(block_type) OVER (PARTITION BY template_version_id ORDER BY position) AS next_block_type FROM html_blocks""",
)
def neighbour_context(spark, sf_dir):
    return C.neighbour_context(html_blocks(spark, sf_dir)).select(
        "template_version_id", "block_id", "position_in_document", "total_blocks", "previous_block_type", "next_block_type"
    )


def _suggested(spark, sf_dir):
    """One fenced JSON reply per page, derived from its blocks: promote, adjust, merge and a bad one."""
    b = stored(html_blocks(spark, sf_dir), "html-blocks")
    kinds = F.array(*[F.lit(t) for t in (*K.SUGGESTION_TYPES, "unknown")])
    one = F.struct(
        "block_id",
        F.get(kinds, (F.col("position") % 4).cast("int")).alias("suggestion_type"),
        F.when(F.col("sequence") % 5 != 0, F.lit(0.9)).alias("confidence"),
        F.when(F.col("sequence") % 3 != 0, (F.col("sequence") % 11).cast("int")).alias("new_level"),
    )
    listed = F.array_sort(F.collect_list(F.struct("position", one.alias("one"))))
    texts = b.groupBy("template_version_id").agg(
        F.concat(F.lit("```json\n"), F.to_json(F.transform(listed, lambda x: x["one"])), F.lit("\n```")).alias("content")
    )
    return b, B.valid_suggestions(B.parse_suggestions(texts), b)


_SUGGESTED = """suggested AS (
  SELECT *, CASE position % 4 WHEN 0 THEN 'promote_to_heading' WHEN 1 THEN 'adjust_level' WHEN 2 THEN 'merge_list' ELSE 'unknown' END AS suggestion_type,
    CASE WHEN sequence % 5 <> 0 THEN 0.9 ELSE 0.5 END AS confidence,
    CASE WHEN sequence % 3 <> 0 THEN CAST(sequence AS BIGINT) % 11 END AS new_level FROM html_blocks),
valid AS (
  SELECT *, confidence >= 0.85 AND ((suggestion_type = 'promote_to_heading' AND block_type = 'paragraph')
     OR (suggestion_type = 'adjust_level' AND block_type = 'heading' AND new_level IS NOT NULL)) AS applies
  FROM suggested WHERE suggestion_type <> 'unknown' AND (new_level IS NULL OR new_level BETWEEN 1 AND 9))"""


@query(
    "suggestion_counts",
    ddl.with_(_HTML_BLOCKS, _SUGGESTED)
    + """SELECT template_version_id, count(*) AS suggestions_count, count(*) FILTER (applies) AS applied_count,
  count(*) FILTER (NOT applies) AS skipped_count FROM valid GROUP BY template_version_id""",
)
def suggestion_counts(spark, sf_dir):
    b, s = _suggested(spark, sf_dir)
    return B.suggestion_counts(b, s)


@query(
    "suggestions_applied",
    ddl.with_(_HTML_BLOCKS, _SUGGESTED)
    + """SELECT b.template_version_id, b.block_id, CASE WHEN v.applies THEN 'heading' ELSE b.block_type END AS block_type,
  CASE WHEN v.applies THEN coalesce(v.new_level, 2) ELSE b.level END AS level
FROM html_blocks b LEFT JOIN valid v ON v.template_version_id = b.template_version_id AND v.block_id = b.block_id""",
)
def suggestions_applied(spark, sf_dir):
    b, s = _suggested(spark, sf_dir)
    return B.apply_suggestions(b, s).select("template_version_id", "block_id", "block_type", "level")
