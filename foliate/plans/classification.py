"""Queries: classification of text blocks."""

from __future__ import annotations

from foliate.operators import classify as C
from foliate.plans import ddl
from foliate.plans.registry import query
from foliate.sources import tables as T

_STATS = """count(*) AS total_sections,
  count(*) FILTER (section_type = 'STATIC') AS static_sections,
  count(*) FILTER (section_type = 'DYNAMIC') AS dynamic_sections,
  count(*) FILTER (confidence_level = 'high') AS high_confidence_count,
  count(*) FILTER (confidence_level = 'medium') AS medium_confidence_count,
  count(*) FILTER (confidence_level = 'low') AS low_confidence_count,
  count(*) FILTER (method = 'rule_based') AS rule_based_count,
  count(*) FILTER (method = 'llm_assisted') AS llm_assisted_count,
  count(*) FILTER (method = 'fallback') AS fallback_count,
  count(*) FILTER (confidence_level = 'high') / count(*) * 100 AS success_rate"""


@query(
    "classify_summary",
    ddl.with_(ddl.BLOCKS, ddl.classified(0.85))
    + f"SELECT template_version_id, {_STATS} FROM classified GROUP BY template_version_id",
)
def classify_summary(spark, sf_dir):
    return C.batch_statistics(C.classify(T.text_blocks(spark, sf_dir)), "template_version_id")


_COLUMNS = ("template_version_id", "block_id", "section_type", "confidence", "confidence_level", "method", "justification")


@query("classify_blocks", ddl.with_(ddl.BLOCKS, ddl.classified(0.85)) + f"SELECT {', '.join(_COLUMNS)} FROM classified")
def classify_blocks(spark, sf_dir):
    return C.classify(T.text_blocks(spark, sf_dir)).select(*_COLUMNS)


@query(
    "classify_low_threshold",
    ddl.with_(ddl.BLOCKS, ddl.classified(0.70)) + f"SELECT {', '.join(_COLUMNS)}, rule_number FROM classified",
)
def classify_low_threshold(spark, sf_dir):
    """At 0.70 the structural rules and heuristics take part."""
    return C.classify(T.text_blocks(spark, sf_dir), 0.70).select(*_COLUMNS, "rule_number")
