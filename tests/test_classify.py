import pytest
from pyspark.sql import functions as F

from foliate.operators import classify as C

LONG = "We reviewed the figures for every branch and found that they improved over the whole period. " * 5


def classify(spark, rows, threshold=0.85, replies=None):
    df = spark.createDataFrame(
        [("v", f"b{i}", i, i + 1, *r) for i, r in enumerate(rows)],
        "template_version_id string, block_id string, position bigint, sequence bigint, block_type string, level int, text string",
    )
    return C.classify(df, threshold, replies)


CASES = [
    ("Strictly CONFIDENTIAL material.", 0.85, "STATIC", 0.95, "rule_based"),
    ("(c) 2024, all rights reserved", 0.85, "STATIC", 0.95, "rule_based"),
    ("Nonconfidentialities are fine to share with anyone", 0.85, "STATIC", 0.5, "fallback"),
    ("éconfidential words of a longer remark", 0.85, "STATIC", 0.5, "fallback"),
    ("This document was issued by the desk.", 0.85, "STATIC", 0.92, "rule_based"),
    ("Tel: 555", 0.85, "STATIC", 0.90, "rule_based"),
    ("Page 12 of 30", 0.85, "STATIC", 0.95, "rule_based"),
    ("See page 12 of the annex please", 0.85, "STATIC", 0.5, "fallback"),
    ("Date:", 0.85, "STATIC", 0.92, "rule_based"),
    ("Executive Summary \n", 0.85, "STATIC", 0.90, "rule_based"),
    ("The date of delivery", 0.85, "DYNAMIC", 0.88, "rule_based"),
    ("Dear {name}, hello", 0.85, "DYNAMIC", 0.95, "rule_based"),
    ("Dear [name], hello", 0.85, "DYNAMIC", 0.95, "rule_based"),
    ("Mail <a@b.org> for more", 0.85, "DYNAMIC", 0.95, "rule_based"),
    ("Empty {} and [] stay", 0.85, "STATIC", 0.5, "fallback"),
    ("Please customize this part", 0.85, "DYNAMIC", 0.92, "rule_based"),
    ("A tailored plan follows", 0.85, "DYNAMIC", 0.85, "rule_based"),
    ("A tailored plan follows", 0.86, "STATIC", 0.5, "fallback"),
    ("inſert here the nameless", 0.85, "DYNAMIC", 0.92, "rule_based"),
    ("tiny", 0.85, "STATIC", 0.5, "fallback"),
    ("tiny", 0.70, "STATIC", 0.75, "rule_based"),
    ("SHORT SHOUTED TITLE", 0.70, "STATIC", 0.80, "rule_based"),
    (LONG, 0.70, "DYNAMIC", 0.72, "rule_based"),
    (LONG, 0.85, "STATIC", 0.5, "fallback"),
    (None, 0.70, "STATIC", 0.75, "rule_based"),
]


@pytest.mark.parametrize("threshold", [0.70, 0.85, 0.86])
def test_rules(spark, threshold):
    cases = [c for c in CASES if c[1] == threshold]
    got = classify(spark, [("paragraph", None, c[0]) for c in cases], threshold).orderBy("position").collect()
    for case, row in zip(cases, got):
        assert (row["section_type"], row["confidence"], row["method"]) == case[2:], case


def test_structure_only_below_default_threshold(spark):
    rows = [("heading", 1, "Our growth in the region"), ("header", None, "some running title"), ("heading", 2, "Our growth in the region")]
    got = classify(spark, rows, 0.70).orderBy("position").collect()
    assert [(r["confidence"], r["method"]) for r in got] == [(0.70, "rule_based"), (0.95, "rule_based"), (0.5, "fallback")]
    assert [r["confidence"] for r in classify(spark, rows).orderBy("position").collect()] == [0.5, 0.95, 0.5]


def test_short_text_wins_over_capitals_before_the_threshold(spark):
    got = classify(spark, [("paragraph", None, "ABC")], 0.78).first()
    assert got["method"] == "fallback"


def test_model_tier(spark):
    raw = spark.createDataFrame(
        [
            ("v", "b0", 'Sure: {"classification": "dynamic", "confidence": 1.7, "reasoning": "r"} done'),
            ("v", "b1", '{"classification": "STATIC", "confidence": 0.6}'),
            ("v", "b2", '{"classification": "OTHER", "confidence": 0.9}'),
            ("v", "b3", "nothing"),
            ("v", "b4", '{"classification": "DYNAMIC", "confidence": 0.99}'),
        ],
        "template_version_id string, block_id string, content string",
    )
    replies = C.model_replies(raw)
    parsed = {r["block_id"]: r["reply"] for r in replies.collect()}
    assert parsed["b0"]["confidence"] == 1.0 and parsed["b0"]["classification"] == "DYNAMIC"
    assert parsed["b1"]["reasoning"] == "No reasoning provided"
    assert parsed["b2"] is None and parsed["b3"] is None
    rows = [("paragraph", None, "an unclear remark")] * 4 + [("paragraph", None, "Confidential note")]
    got = classify(spark, rows, replies=replies).orderBy("position").collect()
    assert [(r["section_type"], r["method"]) for r in got] == [
        ("DYNAMIC", "llm_assisted"), ("STATIC", "fallback"), ("STATIC", "fallback"), ("STATIC", "fallback"), ("STATIC", "rule_based"),
    ]
    assert got[0]["justification"] == "LLM-assisted: r"
    stats = C.batch_statistics(classify(spark, rows, replies=replies), "template_version_id").first()
    assert (stats["llm_assisted_count"], stats["fallback_count"], stats["success_rate"]) == (1, 3, 40.0)


def test_sections_and_stored_statistics(spark):
    rows = [("paragraph", None, "Dear {name}, hello"), ("paragraph", None, "A tailored plan follows"), ("paragraph", None, "plain remark only")]
    s = C.sections(classify(spark, rows))
    got = s.orderBy("section_id").collect()
    assert [r["structural_path"] for r in got] == ["body/block/1", "body/block/2", "body/block/3"]
    assert got[2]["prompt_config"] is None and got[0]["prompt_config"]["classification_confidence"] == 0.95
    stats = C.stored_statistics(s, "template_version_id").first()
    assert (stats["high_confidence_count"], stats["medium_confidence_count"]) == (2, 1)
    assert (stats["static_percentage"], stats["dynamic_percentage"]) == (33.33, 66.67)


def test_result_does_not_depend_on_partitions(spark):
    rows = [("paragraph", None, c[0]) for c in CASES]
    df = classify(spark, rows)
    a, b = df.repartition(1), classify(spark, rows).repartition(7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_features_carry_neighbours(spark):
    df = spark.createDataFrame(
        [("v", f"b{i}", i, i, t, None, None, "x" * 1500) for i, t in enumerate(["heading", "paragraph", "list"])],
        "template_version_id string, block_id string, position bigint, sequence bigint, block_type string, level int, style_name string, text string",
    )
    got = C.model_features(df).filter("block_id = 'b1'").first()
    m = got["structural_metadata"]
    assert (len(got["content"]), m["previous_block_type"], m["next_block_type"], m["position_in_document"]) == (1000, "heading", "list", 1)
