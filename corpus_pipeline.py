"""From raw documents to token ids: language ID, exact and near dedup, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents. Stages are written as Parquet in the shared folder and read again, and
removed once the next one is written.

Defined results: a null text, or one without a letter, has no language and goes with the first stage; rows
that repeat id and text are one document, of which one row is left after the second stage; of texts that are
equal but for case the largest id stays, of near copies the smallest, null after all others; a null source
is a source of its own. Equal scores and hashes are settled by value, so reruns agree. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import exact_dedup, langid, mixing, pieces, simhash
from siltstone.llm.common import read_table, release, store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go."""
    return langid.accept(docs, langid.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z and a-z, the largest doc_id stays."""
    return exact_dedup.keep_one(docs, exact_dedup.fresh_index(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the smallest doc_id stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in the mix."""
    return pieces.encode_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("SentencePiece encoding", encode),
]

#: A trained classifier, SimHash and the encoder can't be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, f"stage-{i + 1}")
            release(before)
    return docs
