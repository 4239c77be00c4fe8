"""A corpus pipeline over documents; counted as part of the subpackage tradelake.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradelake.functions.tables import delete_table, scratch, write_table
from tradelake.llm import exact_dedup, langid, mixing, piece_bpe, simhash
from tradelake.llm.common import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages; those without one, or without a letter, go.

    A null or empty text has no letter and goes; a null id, language or source is a value like others. Repeated rows are judged alike.
    An empty table gives no rows.
    """
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space: the one with the most characters, then the smallest id.

    Null texts count as empty. Of rows that repeat an id and a text one stays; rows with one id and different texts are told apart; null
    ids are compared like others. An empty table gives no rows.
    """
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Null texts, and texts without words, have the fingerprint zero and are linked with each other. Repeated rows leave one; rows without an
    id are judged by their text like others. An empty table gives no rows.
    """
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for.

    A null source is a source of its own, a null text has no words, and a source without words has target 0, so its documents go. Rows that
    repeat an id are drawn alike. An empty table gives no rows.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids with an end id, and the text that they decode to, for each document of the mix.

    A null text is an empty one and has the end id alone; repeated rows are each coded. An empty table gives no rows.
    """
    return piece_bpe.encode_decode(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("source mixing", mix), ("SentencePiece coding", encode)]

#: SQL can express neither trigram models nor SimHash links nor the vocabulary; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result. Each other stage's tables go when its result is written, and that when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = write_table(stage(spark, docs, sf_dir), keep=True)
        if before:
            delete_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
