"""A training corpus from ``documents`` in stages; each is written as Parquet and read again as the next one's input.

Language ID drops documents without a clear language; of each group of near copies the least doc_id stays; passages of 50
words that an earlier document has are cut; sources are mixed by repeating and leaving out documents; the rest is tokenised and packed
into length buckets. All stages but the last return the columns of ``documents``, further ones too, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import common, jaccard_join, language_id, mixing, packing, substring_dedup


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that labelled rows of docs have; null texts, texts without letters and unclear ones go. Repeated rows are judged alike."""
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row of least doc_id; of rows that repeat it, one. Rows without doc_id stay where their class has no id, one of a class.
    Texts without words are one class."""
    return jaccard_join.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the windows of 50 words that a row of smaller doc_id has; a row that loses all its words goes. Rows without doc_id stay as they are."""
    return substring_dedup.remove_substrings(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them. A null source is a source; rows without words are drawn like others and weigh nothing."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """A row a sequence of tokenizer ids: its span in the document and its place in a batch. Rows without text have none; copies are packed one by one."""
    import public_tokenizers

    return packing.pack(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify), ("near_duplicates", near_duplicates), ("substring_dedup", substrings), ("mixing", mix), ("packing", pack)]
#: The stages learn a model, draw and search by hashing, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
