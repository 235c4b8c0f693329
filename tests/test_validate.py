import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate.operators import validate as V

GOOD = "The quarterly figures improved in every region we looked at."
CASES = [
    ("", False, ["EMPTY_CONTENT"], "BOUNDS_VIOLATION", True),
    ("  \t\n", False, ["EMPTY_CONTENT"], "BOUNDS_VIOLATION", True),
    ("ninechars", False, ["NEAR_EMPTY_CONTENT"], "BOUNDS_VIOLATION", True),
    ("tencharsxx", True, [], None, False),
    (f"  {GOOD} ", True, [], None, False),
    ("words " * 9000, False, ["CONTENT_TOO_LONG", "NEAR_EMPTY_CONTENT", "REPETITIVE_CONTENT"], "BOUNDS_VIOLATION", True),
    ("again " * 12, False, ["NEAR_EMPTY_CONTENT", "REPETITIVE_CONTENT"], "QUALITY_FAILURE", False),
    ("Lorem ipsum dolor sit amet consectetur", False, ["BOILERPLATE_ONLY"], "QUALITY_FAILURE", False),
    (f"{GOOD}\nTODO:  ", False, ["BOILERPLATE_ONLY"], "QUALITY_FAILURE", False),
    ("todo: write something about the region soon", True, [], None, False),
    ("[insert the summary of results here]", False, ["BOILERPLATE_ONLY"], "QUALITY_FAILURE", False),
    (f"{GOOD} <b>x</b>", False, ["CONTAINS_TAGS"], "STRUCTURAL_VIOLATION", False),
    (f"# Title\n{GOOD}", False, ["CONTAINS_HEADERS"], "STRUCTURAL_VIOLATION", False),
    (f"{GOOD} **bold**", False, ["CONTAINS_FORMATTING"], "STRUCTURAL_VIOLATION", False),
    ("uses snake_case_words in one plain sentence", False, ["CONTAINS_FORMATTING"], "STRUCTURAL_VIOLATION", False),
    (f"{GOOD} [t](http://x)", False, ["CONTAINS_MARKUP"], "STRUCTURAL_VIOLATION", False),
    (f"{GOOD} `code`", False, ["CONTAINS_MARKUP"], "STRUCTURAL_VIOLATION", False),
    (f"{GOOD}\n---\n", False, ["STRUCTURAL_MODIFICATION"], "STRUCTURAL_VIOLATION", False),
    (f"{GOOD}\n| a | b |\n", False, ["STRUCTURAL_MODIFICATION"], "STRUCTURAL_VIOLATION", False),
    (f"1. first\n{GOOD}", False, ["CONTAINS_HEADERS"], "STRUCTURAL_VIOLATION", False),
    (f"(a) first\n{GOOD}", False, ["CONTAINS_HEADERS"], "STRUCTURAL_VIOLATION", False),
    ("Plain text, with (brackets) and a dash - nothing else: 3.5 times.", True, [], None, False),
    ("<b>x</b>", False, ["NEAR_EMPTY_CONTENT", "CONTAINS_TAGS"], "STRUCTURAL_VIOLATION", False),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, content string")
    got = V.verdict(df).orderBy("i").collect()
    for (content, valid, codes, failure, retry), row in zip(CASES, got):
        assert (row["is_valid"], sorted(row["error_codes"]), row["failure_type"], row["is_retryable"]) == (valid, sorted(codes), failure, retry), content[:60]
        assert row["content_hash"] == (hashlib.sha256(content.strip().encode()).hexdigest() if valid else None)
        assert (row["rejection_reason"] is None) == valid


def test_null_content_is_empty(spark):
    df = spark.createDataFrame([(None,)], "content string")
    row = V.verdict(df).first()
    assert (row["is_valid"], row["error_codes"], row["rejection_reason"]) == (False, ["EMPTY_CONTENT"], "Content is empty")


def test_messages(spark):
    df = spark.createDataFrame([("<a> <b> <c> <d>", 1), ("again " * 12, 2), ("short", 3)], "content string, i int")
    got = {r["i"]: r["rejection_reason"] for r in V.verdict(df, min_length=8).collect()}
    assert got[1] == "HTML tags detected: ['<a>', '<b>', '<c>']; Too few unique words: 4" or got[1].startswith("HTML tags detected: ['<a>', '<b>', '<c>']")
    assert got[2] == "Content is repetitive (ratio: 1.00); Too few unique words: 1"
    assert got[3] == "Content is near-empty (5 chars); Content too short: 5 < 8"


def test_findings_and_switches(spark):
    text = "# One\n<a><b><c><d><e><f>\n[t](u) ```x``` \n***\n|r|\n1) n"
    df = spark.createDataFrame([(text,)], "content string")
    row = V.structural(df).first()
    assert row["detected_tags"] == ["<a>", "<b>", "<c>", "<d>", "<e>"]
    assert row["detected_headers"] == ["# One", "1) "]
    assert row["detected_markup"] == ["[t](u)", "code_block", "horizontal_rule", "table_row"]
    off = V.structural(df, checks=()).first()
    assert off["structural_valid"] and off["detected_tags"] == []
    custom = V.structural(df, checks=(), custom=("^one", "^# ONE")).first()
    assert custom["structural_codes"] == ["STRUCTURAL_MODIFICATION"] and custom["detected_markup"] == ["custom_pattern:^# ONE"]


def test_constraints(spark):
    rows = [("  ",), ("===\nx",), ("fine text",), ("x" * 30,)]
    df = spark.createDataFrame(rows, "content string")
    got = [(r["is_valid"], r["rejection_code"], len(r["violations"])) for r in V.constraints(df, max_length=20).collect()]
    assert got == [(False, "EMPTY_CONTENT", 1), (False, "CONSTRAINT_VIOLATION", 1), (True, None, 0), (False, "CONSTRAINT_VIOLATION", 1)]


def test_rejections_by_code(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "content string")
    got = {r["error_code"]: r["rejections"] for r in V.rejections_by_code(V.verdict(df)).groupBy("error_code").agg(F.sum("rejections").alias("rejections")).collect()}
    want = Counter(code for c in CASES for code in c[2])
    assert got == dict(want)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="abé_9 .\n#*|-", max_size=60), min_size=1, max_size=25))
def test_word_statistics_against_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    for row in V.word_statistics(df).collect():
        words = re.findall(r"\b\w+\b", texts[row["i"]].lower())
        top = max(Counter(words).values(), default=0)
        assert (row["total_words"], row["unique_words"], row["top_count"]) == (len(words), len(set(words)), top)


@pytest.mark.parametrize("unexpected,llm,failure,want", [
    (True, True, "QUALITY_FAILURE", "UNEXPECTED_ERROR"), (False, True, None, "GENERATION_FAILURE"),
    (False, False, "QUALITY_FAILURE", "QUALITY_FAILURE"), (False, False, None, "VALIDATION_FAILURE"),
])
def test_failure_classification(spark, unexpected, llm, failure, want):
    df = spark.createDataFrame([(unexpected, llm, failure)], "u boolean, l boolean, f string")
    assert df.select(V.failure_classification(F.col("l"), F.col("u"), F.col("f"))).first()[0] == want
