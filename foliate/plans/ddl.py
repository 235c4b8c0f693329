"""SQL common table expressions for the check engine, written independently of the DataFrame code.

Only fixed values (patterns, confidences, messages) are shared with it.
"""

from __future__ import annotations

from foliate.functions import constants as K


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


WHITESPACE = text(K.WHITESPACE)


def strip(expr: str) -> str:
    return f"trim({expr}, {WHITESPACE})"


def hit(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {text(pattern)})"


def line(pattern: str, ignore_case: bool = False) -> str:
    return f"(?{'i' if ignore_case else ''}m)^(?:{pattern})"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


VERSIONS = """versions AS (
  SELECT source AS template_id, doc_id AS template_version_id, sha256(text) AS content_hash,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version_number
  FROM documents)"""

BLOCKS = f"""lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS ord
  FROM documents),
numbered AS (
  SELECT doc_id AS template_version_id, source AS template_id, line AS text,
         row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS sequence,
         count(*) OVER (PARTITION BY doc_id) AS total_blocks
  FROM lines WHERE {strip('line')} <> ''),
blocks AS (
  SELECT *, sequence - 1 AS position, 'paragraph' AS block_type,
         printf('blk_par_%04d_%s', sequence,
                left(sha256('paragraph:' || sequence || ':' || left({strip('text')}, 50)), 12)) AS block_id
  FROM numbered)"""


def classified(threshold: float, source: str = "blocks", name: str = "classified") -> str:
    """Classification of paragraph blocks at a threshold."""
    rules = "\n".join(
        f"      WHEN {hit('text', pattern)} THEN {i}" for i, (_, _, _, pattern, _) in enumerate(K.RULES)
    )
    n = len(K.RULES)
    soft = [
        (K.SHORT_RULE, f"length({strip('text')}) < {K.SHORT_LENGTH}", n + 2),
        (K.CAPS_RULE, f"upper(text) = text AND lower(text) <> text AND length(text) < {K.CAPS_LENGTH}", n + 3),
        (K.NARRATIVE_RULE,
         f"length(text) > {K.NARRATIVE_LENGTH} AND "
         f"len(regexp_extract_all(text, {text(f'[^{K.WS}]+')})) > {K.NARRATIVE_WORDS}", n + 4),
    ]
    # The heuristics are a first-match chain before the threshold is applied.
    chain = "\n".join(f"      WHEN {cond} THEN {no if rule[1] >= threshold else 'NULL'}" for rule, cond, no in soft)
    table = list(K.RULES) + [K.HEADER_FOOTER_RULE, K.TOP_HEADING_RULE, K.SHORT_RULE, K.CAPS_RULE, K.NARRATIVE_RULE]
    stand = ",\n".join(
        f"    ({i}, {text(r[0])}, CAST({r[1]} AS DOUBLE), {text(('Rule-based: ' if i < n else '') + r[2])})"
        for i, r in enumerate(table)
        if r[1] >= threshold
    )
    return f"""{name}_rules(rule_no, section_type, confidence, justification) AS (VALUES
{stand}),
{name}_hits AS (
  SELECT b.*, CASE
{rules}
{chain}
      END AS rule_no
  FROM {source} b),
{name} AS (
  SELECT h.* EXCLUDE (rule_no),
         coalesce(r.section_type, 'STATIC') AS section_type,
         coalesce(r.confidence, CAST({K.FALLBACK_CONFIDENCE} AS DOUBLE)) AS confidence,
         CASE WHEN coalesce(r.confidence, 0.5) >= 0.9 THEN 'high'
              WHEN coalesce(r.confidence, 0.5) >= 0.7 THEN 'medium' ELSE 'low' END AS confidence_level,
         CASE WHEN r.rule_no IS NULL THEN 'fallback' ELSE 'rule_based' END AS method,
         coalesce(r.justification, {text(K.FALLBACK_REASON)}) AS justification,
         r.rule_no + 1 AS rule_number
  FROM {name}_hits h LEFT JOIN {name}_rules r ON h.rule_no = r.rule_no)"""


SECTION_THRESHOLD = 0.70
SECTIONS = BLOCKS + ",\n" + classified(SECTION_THRESHOLD) + """,
sections AS (
  SELECT *, sequence AS section_id, 'body/block/' || sequence AS structural_path FROM classified)"""
