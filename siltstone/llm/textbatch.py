"""Vectorised views of many texts at once: flat byte arrays, words and their hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text handled at once, few enough for a core's cache; a longer text is handled by itself.
CHUNK_BYTES = 1 << 17

_POWERS = np.empty(1 << 16, np.uint64)
_POWERS[0] = 1
with np.errstate(over="ignore"):
    for _k in range(16):  # by doubling: P^(n+m) = P^n * P^m
        _n = 1 << _k
        _POWERS[_n : 2 * _n] = _POWERS[:_n] * (_POWERS[_n - 1] * np.uint64(0x9E3779B97F4A7C15 | 1))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) runs of about `limit` bytes in all."""
    held, size, first = [], 0, 0
    for text in texts:
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = first + len(held), [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts: (flat bytes, start, end, index of the text), words in order.

    Texts are joined by a space; offsets are into the flat array.
    """
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[flat]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return flat, start, end, np.searchsorted(ends, start, side="right")


def span_hashes(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and don't overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    inside = np.arange(size.sum()) - np.repeat(first, size)
    at = inside + np.repeat(start, size)
    with np.errstate(over="ignore"):
        far = inside >> 16
        value = (flat[at].astype(np.uint64) + np.uint64(1)) * _POWERS[inside & 0xFFFF]
        if far.any():  # a word of over 65,536 bytes
            value *= mix64(far.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        return mix64(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
