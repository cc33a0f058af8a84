"""Substring dedup by level-wise doubling of word windows.

Windows of 20 words count. Grams of 5 words are looked at first, then, where they repeat, grams of 10,
and at last the windows themselves; see repeats. A document that equals one of smaller id is settled
without any window.

Defined results: null counts as empty; a text of fewer words than a window loses nothing; rows that
repeat an id and text are one document and get one result each; rows with one id but unlike texts are
documents of their own, in the order of their texts' SHA-256; a null id sorts before all others. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import repeats
from siltstone.llm.common import small_batches, trimmed

#: Words of a window, and the gram lengths looked at before.
WINDOW = 20
LEVELS = (5, 10)


def covered(at: bytes, n: bytes, size: int, window: int) -> np.ndarray:
    """Which of the document's tokens are in a window that starts in one of the runs of places."""
    start, count = np.frombuffer(at, np.int64), np.frombuffer(n, np.int64)
    end = np.minimum(start + count + window - 1, size)
    turn = np.bincount(start, minlength=size + 1)[: size + 1] - np.bincount(end, minlength=size + 1)[: size + 1]
    return np.cumsum(turn)[:size] > 0


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the remaining words joined by a space)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, keys, buckets = repeats.document_keys(docs, id_col, text_col)
    copied = repeats.copies(rows)
    whole = repeats.packed(docs, id_col, text_col, keys)
    texts = repeats.plain(docs, id_col, text_col) if keys is None else None
    segments = repeats.narrowed(whole, copied, repeats.word_tokens, levels, window, buckets, texts)
    places = repeats.gathered(repeats.repeated_places(segments, repeats.word_tokens, window, window, buckets, later_only=True), buckets)
    marks = places.unionByName(copied.select("doc", F.lit(b"").alias("at"), F.lit(b"").alias("n")))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for own, blob, at, runs in zip(batch["id"], batch["blob"], batch["at"], batch["n"], strict=True):
                w = unpack.decompress(blob).split()
                n = len(w)
                if at is None:
                    kept = w
                elif not at:  # a copy
                    kept = w if n < window else []
                else:
                    gone = covered(at, runs, n, window)
                    kept = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                out.append((own, n, n - len(kept), b" ".join(kept)))
            yield pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept"])

    joined = whole.join(marks, "doc", "left").select("id", "blob", "at", "n")
    found = joined.mapInPandas(trimmed(remove), "id long, n_words long, n_removed long, kept binary")
    return found.select(F.nullif("id", F.lit(repeats.NULL_ID)).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
