"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing over the whole of ``documents``.

Every stage but the last returns the columns of ``documents``; each works on all that the one before it kept. Language
ID drops rows whose language isn't identified; exact dedup keeps one row of equal texts and near-dedup one row of each
component of texts that share four fifths of their five-word shingles, which op1's rule mostly misses; mixing emits each row as often as its source's rate says; packing returns the pieces in their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockweave.llm import common, exact_dedup, lang_id, mixing, packing, similar

#: SQL can express neither the language model nor the packing; the tests hold run() against brute force instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in an identified language."""
    return lang_id.drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies."""
    return similar.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in their sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each stage's rows are written and read again as the next one's."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
