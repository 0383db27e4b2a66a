"""The corpus pipeline: language, near-duplicates, repeated passages, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``. Ids may repeat or be
null: rows are told apart by their id and text (two 64-bit hashes of both).
Columns besides those of ``documents`` are carried along, whatever their names.
All of every text is read; a very long one takes memory in proportion to its
words in the task that has it. An empty table passes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontamination import contaminated
from ledgerloom.llm.language import UNKNOWN, fit_languages, identify
from ledgerloom.llm.packing import pack
from ledgerloom.llm.shared import small_or_stored, stored
from ledgerloom.llm.simhash import similar_documents
from ledgerloom.llm.substrings import remove_repeats

#: Least mean probability of a document's language; with four languages, chance is 0.25.
LEAST_LANGUAGE_SCORE = 0.35
REPEATED_WORDS = 35


def _row() -> Column:
    """Stands for a row by its id and text, in 128 bits."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc, row, doc_id, text): the columns of the documents out of the way, and what the operators need."""
    return docs.select(F.struct(*docs.columns).alias("doc"), _row().alias("row"), "doc_id", "text")


def _documents(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them new."""
    return rows.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language is unclear; fills in missing languages.

    Null and empty texts have no letters. Of equal probabilities the first
    language by name counts. Repeated rows are judged each.
    """
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("doc")  # the text travels once
    judged = identify(docs.select("doc_id", "text", rest), fit_languages(docs), keep=("doc",), with_text=True)
    kept = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return _documents(kept, docs, text=F.col("text_"), lang=F.coalesce(F.col("doc.lang"), F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the least id (of one id the least text hash), once.

    Of rows with the same id and text any one stays. Null ids come first.
    """
    rows = _marked(docs)
    found = similar_documents(rows.select("text", F.struct("doc_id", F.xxhash64("text").alias("h"), "row").alias("doc_id")))
    # stored, since a join right on an aggregate cannot split rows that repeat
    first = stored(found.where(F.col("doc_id") == F.col("component_id")).select("doc_id.row").distinct(), "first")
    return _documents(rows.select("doc", "row").join(first, "row", "left_semi").dropDuplicates(["row"]), docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words and more that occur more than once; the words kept are joined by single spaces.

    Null text becomes empty. Every copy of a passage goes, so texts that are one
    such passage end empty; they stay, as rows.
    """
    rest = F.struct(*[c for c in docs.columns if c not in ("text", "n_chars")]).alias("doc")
    kept = remove_repeats(docs.select(rest, "text"), REPEATED_WORDS, id_col="doc")
    return _documents(kept, docs, text=F.col("kept"), n_chars=F.length("kept").cast("bigint"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least half of a benchmark item, with its values or others.

    Null and empty texts stay. Rows with the same id and text share their fate.
    """
    rows = _marked(docs)
    found = contaminated(rows.select("row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row", item_col="item_id")
    return _documents(rows.select("doc", "row").join(small_or_stored(found.select("row").distinct(), "contaminated"), "row", "left_anti"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens; null and empty texts are an end token alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), known_bytes=1 << 24)  # workers also hold other stages' modules


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the learned stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
