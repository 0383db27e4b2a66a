"""The operators of this subpackage as named queries, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import licences, mixing, search, sharding, substrings
from ledgerloom.llm.decontamination import contaminated
from ledgerloom.llm.language import fit_languages, identify
from ledgerloom.llm.neighbours import nearest
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality import fit_quality, score_quality
from ledgerloom.llm.simhash import near_duplicates
from ledgerloom.llm.spelling import spelling_variants
from ledgerloom.llm.token_counts import token_counts

SHARD_BYTES = 1 << 20
REPEATED_WORDS = 35


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return contaminated(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def op2_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack(_table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return nearest(_table(spark, d, "embeddings"))


def op4_licences(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan_licences(_table(spark, d, "documents"), licences.document_path())


def op5_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.extendible_shards(_table(spark, d, "documents"), SHARD_BYTES)


def op6_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, d, "documents"), REPEATED_WORDS, with_text=False)


def op7_language(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return identify(docs, fit_languages(docs))


def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(_table(spark, d, "documents"))


def op9_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(_table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, d, "labels")))


def op11_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling_variants(_table(spark, d, "documents"))


def op12_search(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked_search(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


def op13_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_neighbours": op3_neighbours,
    "op4_licences": op4_licences,
    "op5_sharding": op5_sharding,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_spelling": op11_spelling,
    "op12_search": op12_search,
    "op13_mixing": op13_mixing,
}

ORACLES: dict[str, str] = {
    "op4_licences": licences.oracle(),
    "op5_sharding": sharding.oracle(SHARD_BYTES),
    "op6_substring_dedup": substrings.oracle(REPEATED_WORDS),
    "op12_search": search.oracle(),
    "op13_mixing": mixing.oracle(),
}
