"""Nested lists and tables of HTML pages as raw elements.

A page is cut into tokens inside its row. The level of a list item is the number of lists open around it, and its kind that of
the innermost one: both are windows over the tokens of one page. A table is one element; its cells are laid out on a grid, in which a cell that
spans rows or columns stands in every place it covers.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions.text import once, run_of, strip
from foliate.sources import tables as T

#: Spans above these are cut, as browsers do.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
GRID = "array<array<string>>"
_TABLE = r"(?is)<table(?:\s[^>]*)?>.*?</table\s*>"
_MARK = r"(?i)<(/?(?:h[1-6]|p|li|ul|ol))(?:[ \t\n\r/][^>]*)?>"
_ROW = re.compile(r"<tr(?:\s[^>]*)?>(.*?)(?=<tr[\s>]|</tr|</table|\Z)", re.I | re.S)
_CELL = re.compile(r"<t[dh]((?:\s[^>]*)?)>(.*?)(?=<t[dh][\s>]|</t[dh]|\Z)", re.I | re.S)
_SPAN = re.compile(r"(col|row)span\s*=\s*[\"']?\s*([0-9]+)", re.I)
_TAGS = re.compile(r"<[^>]*>")


def grid(html: str) -> list[list[str]]:
    """The texts of a table by row and column; a place that no cell covers is empty."""
    out: list[list[str]] = []
    # what earlier rows reach down with: column → text and rows left
    reaching: dict[int, tuple[str, int]] = {}
    for row in _ROW.findall(html):
        line: list[str] = []

        def reached() -> None:
            while len(line) in reaching:
                at = len(line)
                text, left = reaching.pop(at)
                if left > 1:
                    reaching[at] = text, left - 1
                line.append(text)

        below: dict[int, tuple[str, int]] = {}
        for attributes, inner in _CELL.findall(row):
            reached()
            spans = {k.lower(): int(n) for k, n in _SPAN.findall(attributes)}
            text = _TAGS.sub("", inner)
            for _ in range(min(max(spans.get("col", 1), 1), MOST_COLUMNS)):
                reaching.pop(len(line), None)
                if (tall := min(spans.get("row", 1), MOST_ROWS)) > 1:
                    below[len(line)] = text, tall - 1
                line.append(text)
        reached()
        while reaching and max(reaching) >= len(line):
            line.append("")
            reached()
        reaching |= below
        out.append(line)
    return out


def _grids(tables: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            laid = [grid(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(laid, pa.list_(pa.list_(pa.string())))], ["template_version_id", "ord", "grid"])

    return tables.mapInArrow(run, f"template_version_id bigint, ord bigint, grid {GRID}")


def elements(pages: DataFrame) -> DataFrame:
    """Raw elements of pages ``(template_version_id, html)`` in order: headings, paragraphs, list items and tables."""
    html = F.regexp_replace("html", T._NOISE, "")
    split = once(pages.select("template_version_id", "html"), {"texts": F.split(html, _TABLE), "tables": F.regexp_extract_all(html, F.lit(_TABLE), F.lit(0))})
    # a token is a mark and the text behind it; a table closes what stands before it
    marked = F.transform("texts", lambda t: F.split(F.regexp_replace(F.regexp_replace(t, _MARK, "\x01$1\x02"), T._TAG, ""), "\x01"))
    both = F.flatten(F.transform(marked, lambda parts, i: F.concat(
        F.transform(parts, lambda x: F.struct(x.alias("piece"), F.lit(None).cast("string").alias("table"))),
        F.transform(F.slice("tables", i + 1, 1), lambda x: F.struct(F.lit("-\x02").alias("piece"), x.alias("table"))),
    )))
    tokens = split.select("template_version_id", F.posexplode(both).alias("ord", "t")).select("template_version_id", F.col("ord").cast("bigint").alias("ord"), "t.*")
    tag = F.when(F.col("piece").contains("\x02"), F.lower(F.substring_index("piece", "\x02", 1))).otherwise("-")
    text = strip(T._entities(F.substring_index("piece", "\x02", -1)))
    opens, closes = F.col("tag").isin("ul", "ol"), F.col("tag").isin("/ul", "/ol")
    page = W.partitionBy("template_version_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = tokens.withColumns({"tag": tag, "text": text})
    rows = rows.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(page))
    level = W.partitionBy("template_version_id", "depth").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("list", F.last(F.when(opens, F.col("tag")), ignorenulls=True).over(level))
    item = F.col("tag") == "li"
    kept = rows.filter((F.col("text") != "") & F.col("table").isNull() | item)
    style = (
        F.when(item, F.when(F.col("list") == "ol", "List Number").otherwise("List Bullet"))
        .when(F.col("tag").rlike(r"\Ah[1-6]\z"), F.concat(F.lit("Heading "), F.substring("tag", 2, 1))).otherwise("Normal")
    )
    grids = _grids(rows.filter(F.col("table").isNotNull()).select("template_version_id", "ord", "table"))
    cell = F.col("grid")
    paragraphs = lambda c: F.when(strip(c) == "", F.array().cast(f"array<{_PARAGRAPH}>")).otherwise(
        F.array(F.struct(strip(T._entities(c)).alias("text"), run_of(strip(T._entities(c))).alias("runs")))
    )
    tables = grids.select(
        "template_version_id", "ord", F.lit("tbl").alias("kind"), F.transform(cell, lambda r: F.transform(r, paragraphs)).alias("table")
    )
    out = kept.select(
        "template_version_id", "ord", F.lit("p").alias("kind"), style.alias("style_name"), F.lit(None).cast("int").alias("outline_level"),
        F.lit(False).alias("has_numbering"), F.when(item, F.greatest(F.col("depth") - 1, F.lit(0))).cast("int").alias("list_level"),
        F.lit(False).alias("page_break"),
        F.when(F.col("text") == "", F.array().cast(T._RUNS)).otherwise(run_of(F.col("text"))).alias("runs"), "text",
    )
    return out.unionByName(tables, allowMissingColumns=True)


_PARAGRAPH = f"struct<text:string,runs:{T._RUNS}>"
