"""Repeated windows of tokens across a corpus, found level by level.

A level looks at grams of one length. Of each window (the length that counts in the end) only the gram
with the least hash is looked at, which is the same gram wherever the window's content stands, so no
repeated window is missed while few grams are shuffled. Windows whose gram occurs once are dropped; what
is left is cut out of the texts and looked at with grams twice as long.

A task first settles what it can by itself: of a gram that it has seen before it sends one occurrence to
the gram's bucket and the others straight to their documents' buckets. A gram that stands in a third of
all documents thus costs its bucket one entry for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import release, store, text_bytes, trimmed
from siltstone.llm.textbatch import chunks, mix64, span_hashes, words

#: Entries that a task settles and packs at once.
FLUSH = 1 << 19
#: Bytes of text for each bucket of entries.
BUCKET_BYTES = 64 << 20
#: Stands for a null id.
NULL_ID = -(2**63)

#: texts -> (a hash of each token, index of its text, start and end of each token in its text's bytes)
Tokens = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat, start, end, owner = words(texts)
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])[owner]
    return span_hashes(flat, start, end), owner, start - base, end - base


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), size)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return _BYTE[np.frombuffer(b"".join(texts), np.uint8)], owner, start, start + 1


def gram_hashes(tokens: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of the k tokens from each place on (the last k - 1 places have none).

    A polynomial in the tokens' hashes, put together from runs of 1, 2, 4, ... tokens and scrambled.
    """
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, size, piece = None, 0, 1, tokens
    power = 0x9E3779B97F4A7C15 + 2 * salt  # odd; always the factor's power of size
    while True:
        if k & size:
            part = piece[at : at + n]
            out = part.copy() if out is None else np.add(np.multiply(out, np.uint64(power), out=out), part, out=out)
            at += size
        if 2 * size > k:
            return np.maximum(mix64(out), np.uint64(1))
        piece = piece[:-size] * np.uint64(power) + piece[size:]
        power = power * power % 2**64
        size *= 2


def sliding(values: np.ndarray, w: int, best: Callable) -> np.ndarray:
    """The best of each w values in a row, by doubling."""
    size = 1
    while 2 * size <= w:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: len(values) - (w - size)], values[w - size :]) if w > size else values


def windows(tokens: np.ndarray, owner: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, least gram hash of each window, whether the window lies in one text)."""
    grams = gram_hashes(tokens, k)
    n = len(tokens) - window + 1
    if n <= 0:
        return grams, np.zeros(0, np.uint64), np.zeros(0, bool)
    return grams, sliding(grams, window - k + 1, np.minimum), owner[:n] == owner[window - 1 :]


def chosen(grams: np.ndarray, least: np.ndarray, inside: np.ndarray, reach: int) -> np.ndarray:
    """The places of grams that are the least of some window."""
    most = sliding(np.pad(np.where(inside, least, np.uint64(0)), reach - 1), reach, np.maximum)
    return np.flatnonzero((most == grams) & (most > 0))


def _sorted(h: np.ndarray, extra: np.ndarray | None, doc: np.ndarray, at: np.ndarray) -> tuple:
    """(order, the entries in it: by gram, document and place; where a gram begins)."""
    order = np.lexsort((at, doc, h) if extra is None else (at, doc, extra, h))
    h, extra, doc, at = h[order], extra if extra is None else extra[order], doc[order], at[order]
    new = h[1:] != h[:-1]
    if extra is not None:
        new |= extra[1:] != extra[:-1]
    return order, h, extra, doc, at, np.append(True, new)[: len(h)]


class _Packer:
    """Settles repeats among a task's own entries and packs the rest by bucket."""

    def __init__(self, buckets: int, check: bool):
        self.buckets, self.check = buckets, check
        self.held: list[tuple] = []
        self.size = 0

    def add(self, h: np.ndarray, extra: np.ndarray | None, doc: np.ndarray, at: np.ndarray) -> None:
        self.held.append((h, extra, doc, at))
        self.size += len(h)

    def flush(self) -> pd.DataFrame:
        h, extra, doc, at = (np.concatenate(x) if x[0] is not None else None for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        _, h, extra, doc, at, new = _sorted(h, extra, doc, at)
        once = np.append(True, new[1:] | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))  # a repeated row lists its places again
        h, extra, doc, at, new = h[once], extra[once] if self.check else None, doc[once], at[once], new[once]
        more = np.append(~new[1:], False)  # the next entry is of the same gram
        spread = np.where(new, h, mix64(doc.view(np.uint64))) % np.uint64(self.buckets)
        order = np.argsort(spread, kind="stable")
        edge = np.searchsorted(spread[order], np.arange(self.buckets + 1))
        rows = []
        for b in range(self.buckets):
            own = order[edge[b] : edge[b + 1]]
            if len(own):
                first = own[new[own]]
                known = own[~new[own]]
                rows.append((b, h[first].tobytes(), extra[first].tobytes() if self.check else b"", doc[first].tobytes(), at[first].tobytes(), more[first].tobytes(), doc[known].tobytes(), at[known].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "h", "extra", "doc", "at", "more", "known_doc", "known_at"])


_PACKED = "bucket int, h binary, extra binary, doc binary, at binary, more binary, known_doc binary, known_at binary"


def _texts(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Runs of rows with their texts, which are packed unless the rows are those of plain()."""
    unpack = zstandard.ZstdDecompressor()
    for first, texts in chunks(batch["text"] if "text" in batch else (unpack.decompress(b) for b in batch["blob"])):
        yield batch.iloc[first : first + len(texts)], texts


def document_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None, int]:
    """((doc, digest) of all rows, (id, digest, doc) of all documents or None if each doc is its id, buckets).

    There is a bucket for each BUCKET_BYTES of text, so that what a task holds of one does not grow with the
    data. Rows of one id and text are one document. doc numbers documents in the order of their ids, null first,
    and of their digests. Ids do for that, unless one of them (or null) has unlike texts.
    """
    digest = F.unhex(F.sha2(text_bytes(text_col), 256))
    size = F.octet_length(text_bytes(text_col)).cast("long").alias("size")
    rows = store(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), digest.alias("digest"), size), "digests")
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    short = F.xxhash64("digest")
    if not rows.groupBy("id").agg(F.min(short).alias("low"), F.max(short).alias("high")).filter("low < high").count():
        return rows.select(F.col("id").alias("doc"), "digest"), None, buckets
    ordered = rows.select("id", "digest").distinct().repartitionByRange(buckets, "id", "digest").sortWithinPartitions("id", "digest")
    keys = store(ordered.withColumn("doc", F.monotonically_increasing_id()), "keys")
    return keys.select("doc", "digest"), keys, buckets


def packed(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame | None) -> DataFrame:
    """(id, doc, first, blob): each whole text as one segment, compressed since it will be shuffled; keys as of document_keys."""
    text = text_bytes(text_col)
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id")
    rows = docs.select(ids, *([] if keys is None else [F.unhex(F.sha2(text, 256)).alias("digest")]), text.alias("blob"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield batch.assign(blob=[press.compress(b) for b in batch["blob"]])

    rows = rows.mapInPandas(trimmed(pack), rows.schema)
    rows = rows.withColumn("doc", F.col("id")) if keys is None else rows.join(keys, ["id", "digest"])
    return rows.select("id", "doc", F.lit(0).cast("long").alias("first"), "blob")


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, first, text): each whole text as one segment, not compressed, where each doc is its id.

    For what reads the texts where they lie: packing them would take a second Python worker beside the reader's.
    """
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc")
    return docs.select(ids, F.lit(0).cast("long").alias("first"), text_bytes(text_col).alias("text"))


def repeated_places(segments: DataFrame, tokens: Tokens, k: int, window: int, buckets: int, later_only: bool = False) -> DataFrame:
    """Places of the segments' looked-at grams that occur more than once, dealt for gathered().

    With later_only, k must be the window: places of all windows but the first of each content, by
    document and place. Such windows are told apart by 128 bits of hash.
    """
    reach = window - k + 1

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = _Packer(buckets, later_only)
        for batch in batches:
            for rows, texts in _texts(batch):
                hashes, owner, *_ = tokens(texts)
                grams, least, inside = windows(hashes, owner, k, window)
                at = chosen(grams, least, inside, reach) if len(least) else np.zeros(0, np.int64)
                if len(at):
                    first = np.searchsorted(owner, np.arange(len(texts)))
                    place = at - first[owner[at]] + rows["first"].to_numpy()[owner[at]]
                    extra = gram_hashes(hashes, k, 1)[at] if later_only else None
                    packer.add(grams[at], extra, rows["doc"].to_numpy()[owner[at]], place)
                if packer.size >= FLUSH:
                    yield packer.flush()
        if packer.size:
            yield packer.flush()

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for b in held for x in b[name]])
        h, doc, at, more = join("h", np.uint64), join("doc", np.int64), join("at", np.int64), join("more", bool)
        extra = join("extra", np.uint64) if later_only else None
        known_doc, known_at = join("known_doc", np.int64), join("known_at", np.int64)
        del held
        order, h, extra, doc, at, new = _sorted(h, extra, doc, at)
        more = more[order]
        if later_only:
            start = np.flatnonzero(new)
            lead = np.repeat(start, np.diff(np.append(start, len(h))))
            keep = (doc != doc[lead]) | (at != at[lead])
        else:
            group = np.cumsum(new) - 1
            many = np.bincount(group) > 1
            many[group[more]] = True
            keep = many[group] if len(h) else new
        doc, at = np.concatenate((doc[keep], known_doc)), np.concatenate((at[keep], known_at))
        yield dealt(doc, at, np.ones(len(doc), np.int64), buckets)

    sent = segments.select("doc", "first", "text" if "text" in segments.columns else "blob").mapInPandas(trimmed(send), _PACKED)
    return sent.repartitionById(buckets, "bucket").mapInPandas(trimmed(settle), DEALT)


DEALT = "part int, doc binary, at binary, n binary"


def dealt(doc: np.ndarray, at: np.ndarray, n: np.ndarray, parts: int) -> pd.DataFrame:
    """Runs of n places each, packed in one row for each part of the documents."""
    part = (mix64(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((at, doc, part))
    edge = np.searchsorted(part[order], np.arange(parts + 1))
    own = [order[edge[p] : edge[p + 1]] for p in range(parts)]
    rows = [(p, doc[o].tobytes(), at[o].tobytes(), n[o].tobytes()) for p, o in enumerate(own) if len(o)]
    return pd.DataFrame(rows, columns=["part", "doc", "at", "n"])


def gathered(runs: DataFrame, parts: int) -> DataFrame:
    """(doc, at, n): one row for each document, with its runs of places united, 8 bytes a value."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        doc, at, n = (np.concatenate([np.frombuffer(x, np.int64) for b in held for x in b[name]]) for name in ("doc", "at", "n"))
        del held
        order = np.lexsort((at, doc))
        doc, at, n = doc[order], at[order], n[order]
        new = np.concatenate(([True], doc[1:] != doc[:-1]))
        lift = np.cumsum(new) * (int((at + n).max()) + 2)  # keeps the documents' places apart
        end = np.maximum.accumulate(at + n + lift)
        starts = np.flatnonzero(new | np.concatenate(([True], (at + lift)[1:] > end[:-1])))
        last = np.append(starts[1:], len(doc)) - 1
        doc, at, n = doc[starts], at[starts], end[last] - lift[last] - at[starts]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for a in range(0, len(first), 10_000):
            s = first[a : a + 10_000]
            e = np.append(first, len(doc))[a + 1 : a + 1 + len(s)]
            yield pd.DataFrame({"doc": doc[s], "at": [at[i:j].tobytes() for i, j in zip(s, e, strict=True)], "n": [n[i:j].tobytes() for i, j in zip(s, e, strict=True)]})

    return runs.repartitionById(parts, "part").mapInPandas(trimmed(gather), "doc long, at binary, n binary")


def spread(at: bytes, n: bytes) -> np.ndarray:
    """All places of a document's runs."""
    start, size = np.frombuffer(at, np.int64), np.frombuffer(n, np.int64)
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def survivors(segments: DataFrame, places: DataFrame, tokens: Tokens, k: int, window: int) -> DataFrame:
    """(doc, first, blob): the parts of the segments whose windows' least grams are among the gathered places."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for rows, texts in _texts(batch):
                hashes, owner, start, end = tokens(texts)
                grams, least, inside = windows(hashes, owner, k, window)
                if not len(least):
                    continue
                first = np.searchsorted(owner, np.arange(len(texts)))
                size = np.bincount(owner, minlength=len(texts))
                again = np.full(len(grams), np.uint64(2**64 - 1))
                for i, (runs, counts, base) in enumerate(zip(rows["at"], rows["n"], rows["first"], strict=True)):
                    at = spread(runs, counts) - base
                    at = at[(at >= 0) & (at <= size[i] - k)] + first[i]
                    again[at] = grams[at]
                on = np.flatnonzero(inside & (sliding(again, window - k + 1, np.minimum) == least))
                if not len(on):
                    continue
                # close gaps of under half a window: the windows between are looked at in vain, but the text is cut less
                apart = np.flatnonzero((np.diff(on) > window // 2) | (owner[on[1:]] != owner[on[:-1]]))
                a, b = on[np.concatenate(([0], apart + 1))], on[np.append(apart, len(on) - 1)] + window - 1
                docs, bases = rows["doc"].to_numpy()[owner[a]], rows["first"].to_numpy()[owner[a]]
                blobs = [press.compress(texts[o][s:e]) for o, s, e in zip(owner[a], start[a], end[b], strict=True)]
                yield pd.DataFrame({"doc": docs, "first": a - first[owner[a]] + bases, "blob": blobs})

    return segments.join(places, "doc").select("doc", "first", "blob", "at", "n").mapInPandas(trimmed(cut), "doc long, first long, blob binary")


def copies(rows: DataFrame) -> DataFrame:
    """(doc): the documents whose whole text stands in a document of smaller number; rows as of document_keys."""
    many = rows.groupBy("digest").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = store(many.select("digest", "least"), "copied")
    return store(rows.join(many, "digest").filter("doc != least").select("doc").distinct(), "copies")


def narrowed(segments: DataFrame, copied: DataFrame, tokens: Tokens, levels: tuple[int, ...], window: int, buckets: int, texts: DataFrame | None = None) -> DataFrame:
    """What is left of the segments once each level's grams have been looked at; copies of whole documents go.

    texts: the same segments as of plain(), if there are such.
    """
    for i, k in enumerate(levels):
        looked_at = segments if i or texts is None else texts
        places = gathered(repeated_places(looked_at, tokens, k, window, buckets), buckets).join(copied, "doc", "left_anti")
        before, segments = segments, store(survivors(segments, places, tokens, k, window), f"segments-{k}")
        release(before)
    return segments
