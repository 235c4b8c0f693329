"""The pipeline's stages and queries on the given tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliate.llm import queries
from tests import oracle_check as check
from tests.llm.test_near_copies import least_of_each

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, con, name):
    ok, message = check.compare(spark, con, name, SF_DIR)
    assert ok, message


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "tokens":
            assert out.columns == docs.columns, name
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in out.collect()) == least_of_each([(r.doc_id, r.text) for r in docs.collect()])
        if name in ("language", "benchmark"):
            assert 0.9 * docs.count() < out.count() <= docs.count()
        if name == "tokens":
            assert out.count() == docs.count()
        docs = spark.createDataFrame(out.collect(), out.schema)


#: Names that stages use for columns of their own.
INSIDE = "_id _s _f _least _holder _print _mix_base _mix_source_ _mix_h _mix_words _lid_host _lid_h _lid_prior language kept posterior h size base rank".split()


def test_clashing_columns(spark, docs):
    plain = docs
    clashing = docs
    for name in {*INSIDE} - {*docs.columns}:
        clashing = clashing.withColumn(name, F.lit("own"))
    for name, stage in corpus_pipeline.STAGES:
        before, out = stage(spark, plain, SF_DIR), stage(spark, clashing, SF_DIR)
        if name == "tokens":
            assert out.count() == before.count()
            continue
        assert out.columns == clashing.columns, name
        assert all(out.filter(F.col(c) != "own").count() == 0 for c in INSIDE[:2])
        order = lambda df: sorted(map(repr, df.select(*plain.columns).collect()))
        assert order(out) == order(before), name
