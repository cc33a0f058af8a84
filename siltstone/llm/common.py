"""What the training-data operators share: table access, shared-folder writes, word rules."""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.shipping import shared_folder, ship

#: One word is a maximal run of anything but ASCII white space.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
SPACE_REGEX = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows and bytes in one Arrow batch sent to a Python worker at most (a longer row goes alone).
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20

_STORED: dict[str, list[str]] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode alone, one of our own if unset."""
    context = spark.sparkContext
    named = shared_folder(spark) if context.getCheckpointDir() is None else spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def store(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _STORED.setdefault(spark.sparkContext.applicationId, [])
    if not made:
        atexit.register(clear, spark)
    made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove tables that store() wrote and that nothing will read again."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path is not None:
            system, where = _folder(table.sparkSession, path)
            system.delete(where, True)
            _STORED[table.sparkSession.sparkContext.applicationId].remove(path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that store() wrote for this application; runs by itself when the driver ends."""
    if spark.sparkContext._jsc is None:  # stopped
        return
    for path in _STORED.pop(spark.sparkContext.applicationId, []):
        try:
            system, where = _folder(spark, path)
            system.delete(where, True)
        except Exception:  # the session is going down, and what is left can be deleted by hand
            return


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Make Python workers ready: they get the package, and batches bounded by rows and bytes, since texts may be very long.

    The session's own bounds stay where they are smaller. They must hold when a query runs, so they are not put back.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key)
        number = re.fullmatch(r"(\d+)[bB]?", now)
        if number is None or not 0 < int(number[1]) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return to the system what this process has freed; the allocators keep it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:  # glibc
        trim(0)


def trimmed(work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """work for mapInPandas, after which its Python worker, waiting for the next task, does not hold what the last one took."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from work(batches)
        give_back()

    return run


def below(count: int, wanted: int) -> int | None:
    """The signed 64-bit value below which a hash falls for about `wanted` of `count` rows; None: for all."""
    return None if count <= wanted else -(2**63) + 2**64 * wanted // count


def sampled(rows: DataFrame, count: int, wanted: int, *columns: str) -> DataFrame:
    """About `wanted` of the `count` rows, by a hash of the columns; rows that repeat these count once if they are many.

    Exact for any count, so that the sample neither vanishes nor grows with the data; a document that a third of
    all rows repeat is one row of it.
    """
    limit = below(count, wanted)
    return rows if limit is None else rows.filter(F.xxhash64(*columns) < F.lit(limit)).dropDuplicates(list(columns))


def text_hash(text: str | Column = "text") -> Column:
    """A hash by which rows of one id and unlike texts are told apart."""
    column = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(F.coalesce(column, F.lit("")))


def keep_documents(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, columns unchanged, of the documents kept, each document once.

    rows: (doc_id, x: text_hash, kept) of every row. The documents that go are joined, as Spark finds it best
    for their number, so texts are shuffled only where these are too many to broadcast. Of rows that repeat
    id and text the one whose columns have the least hash stays, and only such rows are grouped.
    """
    columns = docs.columns
    gone = store(rows.filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("x").alias("__x")).distinct(), "gone")
    again = rows.filter("kept").groupBy(F.col("doc_id").alias("__id"), F.col("x").alias("__x")).count().filter("count > 1").drop("count")
    again = store(again, "repeated")
    own = docs.withColumns({"__own_id": F.col(id_col).cast("long"), "__own_x": text_hash(text_col)})
    same = F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_x") == F.col("__x"))
    left = own.join(gone, same, "left_anti")
    if again.isEmpty():
        return left.select(*columns)
    row = F.struct(*columns)
    one = left.join(again, same, "left_semi").groupBy("__own_id", "__own_x").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return left.join(again, same, "left_anti").select(*columns).unionByName(one.select("row.*"))


def text_bytes(text: str | Column = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("binary"), F.lit(b"").cast("binary"))


def word_count(text: str | Column = "text") -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD_REGEX)), F.lit(0)).cast("long")
