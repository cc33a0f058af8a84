"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams and of documents by language are summed over a bounded sample of labelled rows;
the matrix of log-probabilities and the languages' own are broadcast, and batches of texts are scored in numpy as sparse rows of n-gram ids.
Texts are read whole, very long ones in overlapping pieces whose n-grams are each counted once.

Defined results: a null text or one without a letter gets `und` and score 0, as does every text where
there is nothing to learn from; equal scores go to the language that sorts first; an empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import sampled, small_batches

#: The model's size: n-gram orders, log2 of the hashed features, the most languages (its size bound).
ORDERS = (1, 2, 3)
BITS = 16
MAX_LANGS = 256
#: What is added to each count of an n-gram.
SMOOTHING = 0.5
#: About so many labelled rows are learned from, chosen by a hash.
MAX_TRAINING_DOCS = 20_000
#: Code points handled at once.
PIECE = 1 << 19
#: A score rests on the evidence of so many n-grams at most, else every long text scores 1.
EVIDENCE = 60
#: The least score that the filtering stage accepts.
MIN_SCORE = 0.5

#: Languages in order, log-probabilities by feature and language, log-probabilities of the languages.
Model = tuple[list[str], np.ndarray, np.ndarray]

_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))


def _pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, code points with up to two of the next piece, length of its own part)."""
    over = max(ORDERS) - 1
    for i, text in enumerate(texts):
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        for a in range(0, len(codes), PIECE):
            yield i, codes[a : a + PIECE + over], min(PIECE, len(codes) - a)


def _features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, feature) of every n-gram, for about PIECE code points at a time."""

    def made(held):
        flat = np.concatenate([c for _, c, _ in held])
        size = np.array([len(c) for _, c, _ in held])
        own = np.array([m for *_, m in held])
        first = np.cumsum(size) - size
        local = np.arange(len(flat)) - np.repeat(first, size)
        owner = np.repeat(np.array([i for i, *_ in held]), size)
        room = np.repeat(size, size) - local
        core = local < np.repeat(own, size)
        mixed = np.full(len(flat), 0x27D4EB2F, np.uint32)
        docs, ids = [], []
        with np.errstate(over="ignore"):
            for n in range(1, max(ORDERS) + 1):
                ahead = np.zeros(len(flat), np.uint32)
                ahead[: len(flat) - n + 1] = flat[n - 1 :]
                mixed = (mixed ^ (mixed >> np.uint32(15))) * _FACTORS[n % 3] + ahead * _FACTORS[(n + 1) % 3]
                if n in ORDERS:
                    keep = core & (room >= n)
                    docs.append(owner[keep])
                    ids.append(((mixed[keep] ^ (mixed[keep] >> np.uint32(13))) * _FACTORS[0]) >> np.uint32(32 - BITS))
        return np.concatenate(docs), np.concatenate(ids)

    held, size = [], 0
    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[1])
        if size >= PIECE:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAINING_DOCS) -> Model:
    """(languages, log-probabilities by feature and language, those of languages) from the rows that may be learned from.

    These are rows with text and language whose crc32(id as text) mod 4 is not 2. Of them a sample of about
    max_docs is taken by a hash of id, text and language; rows that repeat all three are learned once.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL AND coalesce(crc32(CAST(id AS binary)), 0) % 4 != 2")
    some = sampled(rows, rows.count(), max_docs, "id", "text", "lang")
    named = some.select("lang").distinct().limit(MAX_LANGS + 1).count()
    if named > MAX_LANGS:
        raise ValueError(f"the broadcast model holds {MAX_LANGS} languages at most")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang", sort=True):
                total = sums.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                total[-1] += len(part)
                for _, ids in _features(list(part["text"])):
                    total[:-1] += np.bincount(ids, minlength=1 << BITS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "feature": at, "n": total[at]})

    found = some.select("text", "lang").repartition(8).mapInPandas(count, "lang string, feature long, n long")
    table = found.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(table["lang"].unique())
    counts = np.zeros(((1 << BITS) + 1, len(langs)))
    counts[table["feature"], np.searchsorted(langs, table["lang"])] = table["n"]
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0)
    weight = counts[:-1] + SMOOTHING
    return langs, np.log(weight / weight.sum(0)).astype(np.float32), np.log(counts[-1] / counts[-1].sum())


def score_texts(texts: list[str | None], langs: list[str], logs: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    named = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    out, score = ["und"] * len(texts), np.zeros(len(texts))
    if not langs or not named.any():
        return out, score
    where = np.flatnonzero(named)
    total, grams = np.zeros((len(where), len(langs))), np.zeros(len(where))
    for docs, ids in _features([texts[i] for i in where]):
        order = np.argsort(docs, kind="stable")
        docs, ids = docs[order], ids[order]
        start = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        total[docs[start]] += np.add.reduceat(logs[ids], start, axis=0, dtype=np.float64)
        grams[docs[start]] += np.diff(np.concatenate((start, [len(docs)])))
    total += prior
    scaled = total * (np.minimum(grams, EVIDENCE) / grams)[:, None]
    best = total.argmax(1)
    odds = np.exp(scaled - scaled[np.arange(len(where)), best][:, None])
    score[where] = np.clip(1 / odds.sum(1), 0, 1)
    for i, b in zip(where, best, strict=True):
        out[i] = langs[b]
    return out, score


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["lang_pred"], batch["score"] = score_texts(list(batch["text"]), *shared.value)
            yield batch[["doc_id", "lang_pred", "score"]]

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(score, "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows, all columns unchanged, whose language is known with at least min_score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        langs, scores = score_texts(list(texts), *shared.value)
        return pd.Series((np.array(langs) != "und") & (scores >= min_score))

    return docs.filter(known(F.col(text_col)))
