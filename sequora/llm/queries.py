"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from sequora.llm import embedding_dedup, html_text, mixing, nearest, packing, pii, quality, warc
from sequora.llm.minhash_dedup import near_duplicates
from sequora.llm.runtime import table
from sequora.llm.substring_dedup import remove_repeats


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"), spark)


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), spark)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), spark)


def op4_nearest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), spark, F.col("vec_id") % 20 == 0)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), spark))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"), spark)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), spark, shingle=4, percent=80)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), spark, public_tokenizers.path("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), spark)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_bootstrap,
        op2_html_main_text,
        op3_embedding_near_dedup,
        op4_nearest_products,
        op5_quality_gam,
        op6_warc_revisits,
        op7_minhash_near_dedup,
        op8_mix_sources,
        op9_pack_sequences,
        op10_substring_dedup,
    )
}

SQL: dict[str, str] = {
    "op6_warc_revisits": warc.SQL,
    "op8_mix_sources": mixing.SQL,
}
