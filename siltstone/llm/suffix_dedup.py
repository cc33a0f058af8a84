"""Suffix-array dedup of byte strings that stand elsewhere before.

Windows of 100 bytes count; no window crosses documents. Texts are first cut down to the parts whose
windows share a looked-at gram of 32, then of 64 bytes with another place (see repeats). The
windows in a row that have one least gram form one stretch of bytes; stretches go to the shard of their gram,
so equal windows meet in one shard, and equal stretches are made one. A shard sorts the suffixes of its
stretches by induction, and common prefixes of 100 bytes and more tell which windows are equal; all but the
first of each are removed. A gram that very many stretches share is split among shards by two more grams of
the window.

Defined results: null counts as empty; a text of fewer bytes than a window loses nothing; rows that
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
from siltstone.llm.substring_dedup import covered
from siltstone.llm.suffix_array import common_prefixes, suffix_array
from siltstone.llm.textbatch import mix64

#: Bytes of a window, and the gram lengths looked at before.
WINDOW = 100
LEVELS = (32, 64)
#: Hash cells by which gram hashes are counted; one is crowded beyond COMMON runs of windows and 16 times the average.
CELLS = 1 << 16
COMMON = 20_000
#: Bytes of stretches sorted at once.
SHARD_BYTES = 1 << 20
#: Bytes of stretches that a task settles and packs at once.
SETTLED_BYTES = 12 << 20


def crowded_cells(segments: DataFrame, k: int, window: int, common: int = COMMON) -> np.ndarray:
    """Which of CELLS hash cells hold more windows' runs than one shard should: at most CELLS / 16 of them.

    Counts are exact, so that no gram with so many runs is missed; a rare one may share a cell with it.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, texts in repeats._texts(batch):
                hashes, owner, *_ = repeats.byte_tokens(texts)
                _, least, inside = repeats.windows(hashes, owner, k, window)
                first = inside & np.append(True, ~inside[:-1] | (least[1:] != least[:-1]))[: len(least)]
                total += np.bincount((least[first] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    sums = segments.select("blob").mapInPandas(trimmed(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    crowded = np.zeros(CELLS, bool)
    crowded[sums["cell"][sums["n"] > max(common, 16 * int(sums["n"].sum()) // CELLS)]] = True
    return crowded


def later_in_shard(group: np.ndarray, texts: list[bytes], doc: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every window of the stretches that is not the first of its content."""
    size = np.array([len(t) for t in texts])
    order = np.lexsort((at, doc, group))
    edges = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1], [True])))
    out_doc, out_at, part, held = [], [], [], 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):  # whole groups, up to SHARD_BYTES at once
        part.extend(order[a:b].tolist())
        held += int(size[order[a:b]].sum())
        if held < SHARD_BYTES and b < len(order):
            continue
        text = np.frombuffer(b"".join(x for i in part for x in (texts[i], b"\0")) + b"\0", np.uint8).astype(np.uint16) + 2
        n, own = size[part], np.array(part)
        ends = np.cumsum(n + 1) - 1
        text[ends] = 1  # between stretches
        text[-1] = 0
        sorted_ = suffix_array(text, 258)
        group_of = np.cumsum(common_prefixes(text, sorted_)[sorted_] < window)
        which = np.repeat(np.arange(len(part)), n + 1)
        inside = np.arange(len(which)) - np.repeat(ends - n, n + 1)
        real = sorted_ < len(which)
        sorted_, group_of = sorted_[real], group_of[real]
        starts = inside[sorted_] + window <= n[which[sorted_]]  # a whole window begins here
        sorted_, group_of = sorted_[starts], group_of[starts]
        many = np.bincount(group_of)[group_of] > 1 if len(group_of) else starts[:0]
        sorted_, group_of = sorted_[many], group_of[many]
        d, p = doc[own[which[sorted_]]], at[own[which[sorted_]]] + inside[sorted_]
        rank = np.lexsort((p, d, group_of))
        d, p, g = d[rank], p[rank], group_of[rank]
        if len(g):
            new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            lead = np.repeat(new, np.diff(np.append(new, len(g))))
            later = (d != d[lead]) | (p != p[lead])
            out_doc.append(d[later])
            out_at.append(p[later])
        part, held = [], 0
    return (np.concatenate(out_doc), np.concatenate(out_at)) if out_doc else (doc[:0], at[:0])


def _first_stretches(h: np.ndarray, texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its gram and content, equal to one that starts before); one that is listed twice is neither, the second time."""
    seen: dict[tuple[int, bytes], int] = {}
    new, known = np.zeros(len(h), bool), np.zeros(len(h), bool)
    for i in np.lexsort((at, doc)).tolist():
        lead = seen.setdefault((int(h[i]), texts[i]), i)
        new[i] = lead == i
        known[i] = doc[lead] != doc[i] or at[lead] != at[i]
    return new, known


def shard_keys(hashes: np.ndarray, owner: np.ndarray, k: int, window: int, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the shard key of each window, whether it lies in one text): the same wherever a window's content stands.

    It is the least gram hash or, where that lies in a crowded cell, this and the least two by other hashes:
    windows that share one gram but not their surroundings differ in one of these.
    """
    _, key, inside = repeats.windows(hashes, owner, k, window)
    many = crowded[(key % np.uint64(CELLS)).astype(np.int64)] & inside
    if many.any():
        for salt in (1, 2):
            other = repeats.sliding(repeats.gram_hashes(hashes, k, salt), window - k + 1, np.minimum)
            key = np.where(many, mix64(key ^ mix64(other)), key)
    return key, inside


def recurring(hashes: np.ndarray, owner: np.ndarray, k: int, window: int, begin: np.ndarray, finish: np.ndarray) -> np.ndarray:
    """Whether the least gram of a run of windows stands at several places in it, without which no two windows are equal."""
    grams, least, inside = repeats.windows(hashes, owner, k, window)
    reach = window - k + 1
    at = repeats.chosen(grams, least, inside, reach)
    values, which = np.unique(grams[at], return_inverse=True)
    placed = np.sort(which * np.int64(len(grams)) + at)
    own = np.searchsorted(values, least[begin]) * np.int64(len(grams))
    return np.searchsorted(placed, own + finish + reach) - np.searchsorted(placed, own + begin) > 1


def shard_windows(segments: DataFrame, k: int, window: int, crowded: np.ndarray, buckets: int) -> DataFrame:
    """Windows that are not the first of their content, found by shard, dealt for gathered()."""
    shared = segments.sparkSession.sparkContext.broadcast(crowded)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for rows, texts in repeats._texts(batch):
                hashes, owner, *_ = repeats.byte_tokens(texts)
                if len(hashes) < window:
                    continue
                key, inside = shard_keys(hashes, owner, k, window, shared.value)
                # a stretch holds the windows in a row that have one key
                new = np.append(True, ~inside[:-1] | (key[1:] != key[:-1]))
                begin = np.flatnonzero(new & inside)
                finish = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside)
                base = np.searchsorted(owner, np.arange(len(texts)))[owner[begin]]
                joined = b"".join(texts)
                stretches = [joined[b : f + window] for b, f in zip(begin.tolist(), finish.tolist(), strict=True)]
                held.append((key[begin], rows["doc"].to_numpy()[owner[begin]], begin - base + rows["first"].to_numpy()[owner[begin]], recurring(hashes, owner, k, window, begin, finish), stretches))
                size += int((finish - begin).sum()) + len(begin) * window
                if size >= SETTLED_BYTES:
                    yield from pack(held)
                    held, size = [], 0
        if held:
            yield from pack(held)

    def pack(held: list[tuple]) -> Iterator[pd.DataFrame]:
        h, doc, at, twice = (np.concatenate([x[i] for x in held]) for i in range(4))
        texts = [t for x in held for t in x[4]]
        new, known = _first_stretches(h, texts, doc, at)  # the first is sent; the others are later for certain
        spread = np.where(known, mix64(doc.view(np.uint64)), h) % np.uint64(buckets)
        order = np.argsort(spread, kind="stable")
        order = order[(new | known)[order]]
        edge = np.searchsorted(spread[order], np.arange(buckets + 1))
        count = np.array([len(t) for t in texts]) - window + 1
        out = []
        for b in range(buckets):
            own = order[edge[b] : edge[b + 1]]
            if len(own):
                fresh, old = own[new[own]], own[known[own]]
                text = zstandard.compress(b"".join(texts[i] for i in fresh), 1)
                out.append((b, h[fresh].tobytes(), doc[fresh].tobytes(), at[fresh].tobytes(), count[fresh].tobytes(), twice[fresh].tobytes(), text, doc[old].tobytes(), at[old].tobytes(), count[old].tobytes()))
        yield pd.DataFrame(out, columns=["bucket", "h", "doc", "at", "n", "twice", "text", "old_doc", "old_at", "old_n"])

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for b in held for x in b[name]])
        h, doc, at, n = join("h", np.uint64), join("doc", np.int64), join("at", np.int64), join("n", np.int64)
        twice = join("twice", bool)
        joined = b"".join(zstandard.decompress(x) for b in held for x in b["text"])
        old = join("old_doc", np.int64), join("old_at", np.int64), join("old_n", np.int64)
        del held
        found = [old]
        ends = np.cumsum(n + window - 1)
        texts = [joined[a:b] for a, b in zip((ends - n - window + 1).tolist(), ends.tolist(), strict=True)]
        del joined
        new, again = _first_stretches(h, texts, doc, at)
        found.append((doc[again], at[again], n[again]))
        left = np.flatnonzero(new)
        _, group, size = np.unique(h[left], return_inverse=True, return_counts=True)
        some = (size[group] > 1) | twice[left]  # one stretch alone needs no sorting unless its gram recurs in it
        left, group = left[some], group[some]
        if len(left):
            d, p = later_in_shard(group, [texts[i] for i in left], doc[left], at[left], window)
            found.append((d, p, np.ones(len(d), np.int64)))
        yield repeats.dealt(*(np.concatenate(x) for x in zip(*found, strict=True)), buckets)

    sent = segments.select("doc", "first", "blob").mapInPandas(
        trimmed(send), "bucket int, h binary, doc binary, at binary, n binary, twice binary, text binary, old_doc binary, old_at binary, old_n binary"
    )
    return sent.repartitionById(buckets, "bucket").mapInPandas(trimmed(sort), repeats.DEALT)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, levels: tuple[int, ...] = LEVELS, common: int = COMMON) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that remain)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, keys, buckets = repeats.document_keys(docs, id_col, text_col)
    copied = repeats.copies(rows)
    whole = repeats.packed(docs, id_col, text_col, keys)
    texts = repeats.plain(docs, id_col, text_col) if keys is None else None
    segments = repeats.narrowed(whole, copied, repeats.byte_tokens, levels, window, buckets, texts)
    found = shard_windows(segments, levels[-1], window, crowded_cells(segments, levels[-1], window, common), buckets)
    marks = repeats.gathered(found, buckets).unionByName(copied.select("doc", F.lit(b"").alias("at"), F.lit(b"").alias("n")))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for own, blob, at, runs in zip(batch["id"], batch["blob"], batch["at"], batch["n"], strict=True):
                text = unpack.decompress(blob)
                if at:
                    gone = covered(at, runs, len(text), window)
                else:  # nothing, or a copy
                    gone = np.full(len(text), at is not None and len(text) >= window)
                removed = int(gone.sum())
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if removed else text
                out.append((own, len(text), removed, spans, kept))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = whole.join(marks, "doc", "left").select("id", "blob", "at", "n")
    result = joined.mapInPandas(trimmed(remove), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return result.select(F.nullif("id", F.lit(repeats.NULL_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
