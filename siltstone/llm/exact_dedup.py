"""Exact dedup over a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per digest
(map-side first, so a text that a third of all rows share costs one row a task), sort-merge anti-joined
with the index, and what is new is appended. Everything runs as DataFrame operations.

Defined results: a null text counts as empty; texts are equal when identical after lower-casing A-Z
only; of equal texts the largest id stays. Rows that repeat an id and a text are one document: each is
returned and all share one decision. A null id stays only where its group has no other id. An empty
batch gives an empty result and leaves the index as it is. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import LOWER, UPPER, keep_documents, store, text_hash

INDEX_SCHEMA = "digest binary, keep_id bigint, group_size bigint"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, digest, more): SHA-256 of each text with A-Z lower-cased."""
    normal = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"), *more)


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far: (digest, keep_id, group_size)."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table = spark, table
        self.path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        self.buckets = buckets

    def append_new(self, batch: DataFrame) -> None:
        """Append the batch's digests that the index has not got; a repeated call adds nothing.

        batch: what digests() returns. The index side of the anti-join is read by bucket without a shuffle.
        """
        groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        seen = self.spark.table(self.table).select("digest")
        fresh = groups.join(seen.hint("merge"), "digest", "left_anti")
        writer = fresh.select("digest", "keep_id", "group_size").write.mode("append").format("parquet")
        writer.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)

    def entries(self) -> DataFrame:
        """The index read as plain files, so that a join may split a digest that many rows share."""
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.path)


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add the batch to the index; one row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Both sides of the closing join are shuffled by digest alone, so adaptive execution splits hot digests.
    """
    batch = store(digests(docs, id_col, text_col), "digests")  # texts are read and hashed once
    index.append_new(batch)
    found = batch.join(index.entries().hint("merge"), "digest")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, columns unchanged, of the document that stays of each group of equal texts; each document once.

    Of unlike texts of the largest id, equal but for case, the one with the least hash stays.
    """
    batch = digests(docs, id_col, text_col, text_hash(text_col).alias("x"))
    batch = store(batch, "digests")
    index.append_new(batch)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    found = batch.join(index.entries().drop("group_size"), "digest")
    first = found.filter(same).groupBy("digest").agg(F.min("x").alias("first_x"))
    found = found.join(first, "digest", "left").select("doc_id", "x", F.coalesce(same & (F.col("x") == F.col("first_x")), F.lit(False)).alias("kept"))
    return keep_documents(docs, found, id_col, text_col)


def fresh_index(spark: SparkSession, buckets: int = 64) -> DigestIndex:
    """An index of its own for one run."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets)
