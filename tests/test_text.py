import hashlib

import pytest
from pyspark.sql import functions as F

from foliate.functions import text as X


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("value", ["  a b ", " a ", "\t\n\x0b", "", "a\x85", "é 　"])
def test_strip_is_unicode(spark, value):
    assert one(spark, value, X.strip("t")) == value.strip()


def test_words_are_unicode(spark):
    assert one(spark, "Über été a_b, 42!", X.words("t")) == ["über", "été", "a_b", "42"]


@pytest.mark.parametrize("words,more", [(50, False), (51, True), (0, False)])
@pytest.mark.parametrize("gap", [" ", " ", " \n\t", " "])
def test_token_count(spark, words, more, gap):
    assert one(spark, gap + gap.join(["wörd→x"] * words) + gap, X.has_more_tokens("t", 50)) is more


def test_word_profile(spark):
    p = one(spark, "a b a c A", X.word_profile("t"))
    assert (p["total"], p["unique"], p["top"]) == (5, 3, 3)
    p = one(spark, "...", X.word_profile("t"))
    assert (p["total"], p["unique"], p["top"]) == (0, 0, 0)


@pytest.mark.parametrize("number,padded", [(1, "0001"), (9999, "9999"), (12345, "12345")])
def test_block_id(spark, number, padded):
    digest = hashlib.sha256(f"paragraph:{number}:Hällo".encode()).hexdigest()[:12]
    assert one(spark, "Hällo", X.block_id("paragraph", F.lit(number), F.col("t"))) == f"blk_par_{padded}_{digest}"


def test_once_blocks_pushdown(spark):
    df = X.once(spark.range(10), {"x": F.col("id") * 2}).filter("x > 4")
    assert df.count() == 7
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
