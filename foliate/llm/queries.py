"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliate.llm import (
    collocations,
    decontamination,
    language_id,
    mixing,
    packing,
    secrets,
    simhash,
    spot_signatures,
    sql,
    substring_dedup,
    suffix_dedup,
    token_files,
    warc,
    whitening,
)
from foliate.llm.common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.reports(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.edits(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out, names = language_id.document_languages(docs)
    return out.select("doc_id", *[names[k] for k in ("language", "posterior", "text_language", "kept")])


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with the declared language, suffix and host as evidence; text models from the documents."""
    return language_id.page_languages(table(spark, sf_dir, "pages"), language_id.trained(table(spark, sf_dir, "documents")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.reports(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids="ids_crc32 bigint")


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_substring_dedup,
        op3_decontamination,
        op4_simhash,
        op5_mixing,
        op6_spot_signatures,
        op7_language_id,
        op8_warc,
        op9_secrets,
        op10_token_files,
        op11_collocations,
        op12_whitening,
        op13_packing,
        page_languages,
    )
}

ORACLES = {
    "op1_suffix_array_dedup": sql.SUFFIX_DEDUP,
    "op2_substring_dedup": sql.SUBSTRING_DEDUP,
    "op3_decontamination": sql.DECONTAMINATION,
    "op5_mixing": sql.MIXING,
    "op8_warc": sql.WARC,
    "op11_collocations": sql.COLLOCATIONS,
}
