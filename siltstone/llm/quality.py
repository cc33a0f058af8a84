"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Texts become tf-idf vectors of hashed words and word shapes; the labelled sample's truncated singular
value decomposition gives the latent space. Its vectors are broadcast, every document's cosines to all of
them are computed exactly in blocks, and the nearest vote with their similarity as weight.

Defined results: null counts as empty; a text without words, or any text when nothing is labelled, gets
the share of label 1 in the sample (0.5 if there is none); label rows that repeat id and label count once, and of
an id with unlike texts one is learned. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import sampled, small_batches, text_bytes, text_hash
from siltstone.llm.textbatch import chunks, span_hashes, words

#: Hashed features, latent dimensions, neighbours that vote.
FEATURES = 1 << 12
DIMS = 48
NEIGHBOURS = 25
#: Features for the lengths of runs of one word.
RUNS = 5
#: About so many labelled rows are learned from, chosen by a hash; bounds what is broadcast.
MAX_LABELLED = 4_000
#: Rows of one block of cosines.
BLOCK = 128
THRESHOLD = 0.3
#: Votes of the sample's average that are added, so that far-off texts tend towards it.
PRIOR_VOTES = 0.5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def term_counts(texts: list[bytes]) -> np.ndarray:
    """A row of feature counts for each text: words in the even features, shapes and repeats in the odd.

    A word that repeats the one before counts for how long the run is by then: 2, 3 to 4, 5 to 8 words and so on.
    """
    flat, start, end, owner = words(texts)
    counts = np.zeros((len(texts), FEATURES), np.float32)
    if not len(start):
        return counts
    half = np.uint64(FEATURES // 2)
    hashes = span_hashes(flat, start, end)
    ids = [(hashes % half) * np.uint64(2)]
    fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
    run = np.arange(len(start)) - np.maximum.accumulate(np.where(fresh, np.arange(len(start)), 0))
    again = np.flatnonzero(run)
    grown = FEATURES - 1 - 2 * np.minimum(np.log2(np.maximum(run[again], 1)).astype(np.int64), RUNS - 1)
    shape = _SHAPE[flat]
    keep = np.concatenate(([True], shape[1:] != shape[:-1]))
    keep[start] = True
    at = np.cumsum(keep) - 1
    ids.append((span_hashes(shape[keep], at[start], at[end - 1] + 1) % half) * np.uint64(2) + np.uint64(1))
    for who, x in ((owner, ids[0]), (owner, ids[1]), (owner[again], grown)):
        np.add(counts, np.bincount(who * FEATURES + x.astype(np.int64), minlength=counts.size).reshape(counts.shape), out=counts, casting="unsafe")
    return counts


class Model:
    """idf, the latent projection, and the labelled sample's unit vectors and labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dims: int = DIMS):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
        if not len(counts):
            self.axes, self.vectors = np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32)
            return
        x = self._weighted(counts)
        rng = np.random.default_rng(7)
        basis = np.linalg.qr(x.T @ rng.standard_normal((len(x), min(dims + 16, len(x), FEATURES))).astype(np.float32))[0]
        for _ in range(3):  # subspace iteration
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        turn = np.linalg.svd(x @ basis, full_matrices=False)[2]
        self.axes = np.ascontiguousarray((basis @ turn.T)[:, :dims], np.float32)
        self.vectors = self._unit(x @ self.axes)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts) * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self._unit(self._weighted(counts) @ self.axes) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** 2
        weight[counts.sum(1) == 0] = 0
        score = ((weight * self.labels[top]).sum(1) + PRIOR_VOTES * self.prior) / (weight.sum(1) + PRIOR_VOTES)
        return np.clip(score, 0, 1)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED
) -> Model:
    """Fit on labelled rows whose crc32(id as text) mod 5 is not 0, or a sample of about max_labelled of them."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(
        "doc_id IS NOT NULL AND y IS NOT NULL AND crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 != 0"
    )
    known = sampled(known, known.count(), max_labelled, "doc_id", "y").distinct()
    # the sample is bounded by max_labelled, hence the broadcast; of unlike texts of one id the one with the least hash is learned
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", text_hash()).alias("text")).select("doc_id", "y", text_bytes().alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, texts in chunks(batch["text"]):
                for a in range(0, len(texts), BLOCK):
                    counts = term_counts(texts[a : a + BLOCK])
                    part = batch.iloc[first + a : first + a + len(counts)]
                    at = [np.flatnonzero(c) for c in counts]
                    yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "at": [x.astype(np.int32) for x in at], "n": [c[x] for c, x in zip(counts, at, strict=True)]})

    table = rows.mapInPandas(count, "doc_id long, y int, at array<int>, n array<float>").toArrow().to_pandas()
    table = table.sort_values(["doc_id", "y"], kind="stable")
    counts = np.zeros((len(table), FEATURES), np.float32)
    for i, (at, n) in enumerate(zip(table["at"], table["n"], strict=True)):
        counts[i, at] = n
    return Model(counts, table["y"].to_numpy(np.float64) > 0)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            scores = [model.score(term_counts(texts[a : a + BLOCK])) for _, texts in chunks(batch["text"]) for a in range(0, len(texts), BLOCK)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.concatenate(scores) if scores else []})

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInPandas(score, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
