"""Suffix arrays by induced sorting, in numpy, and permuted longest common prefixes.

Each pass of the induction handles a whole bucket (all suffixes with one first symbol) at once. The
leftmost-smaller substrings are sorted by induction, named, and the string of names is sorted in the same
way. Many names are written as two digits each, so that there are few buckets at every level: suffixes that
begin with a first digit are in the order of the names' own suffixes.
"""

from __future__ import annotations

import numpy as np

#: Most names that are symbols by themselves; more are written as two digits.
DIGIT = 512
#: Symbols of a text at which the recursion ends.
SHORT = 1 << 16


def _place(array: np.ndarray, fill: np.ndarray, symbols: np.ndarray, items: np.ndarray, forward: bool) -> None:
    """Put the items, in order, at the next free places of their symbols' buckets."""
    order = np.argsort(symbols, kind="stable")  # a counting sort, since symbols have 16 bits
    s, items = symbols[order].astype(np.int64), items[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    size = np.diff(np.append(new, len(s)))
    rank = np.arange(len(s)) - np.repeat(new, size)
    if forward:
        array[fill[s] + rank] = items
        fill[s[new]] += size
    else:
        array[fill[s] - 1 - rank] = items
        fill[s[new]] -= size


def _induce(text: np.ndarray, small: np.ndarray, first: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes sorted, given the leftmost-smaller ones in order (or, sorted by first symbol only, their substrings)."""
    n, symbols = len(text), len(first) - 1
    out = np.full(n, -1, np.int64)
    seed_symbols = text[seeds].astype(np.int64)
    edge = np.searchsorted(seed_symbols, np.arange(symbols + 1))
    fill = first[:-1].copy()
    for c in np.flatnonzero(np.diff(first)):  # larger ones, left to right
        done = first[c]
        while True:  # a larger suffix that repeats its first symbol follows in the same bucket
            wave = out[done : fill[c]]
            done = fill[c]
            before = wave[wave > 0] - 1
            before = before[(text[before] == c) & ~small[before]]
            if not len(before):
                break
            out[done : done + len(before)] = before
            fill[c] += len(before)
        whole = np.concatenate((out[first[c] : fill[c]], seeds[edge[c] : edge[c + 1]]))
        before = whole[whole > 0] - 1
        before = before[~small[before] & (text[before] > c)]
        if len(before):
            _place(out, fill, text[before], before, True)
    larger = fill.copy()  # where each bucket's larger suffixes end
    fill = first[1:].copy()
    for c in np.flatnonzero(np.diff(first))[::-1]:  # smaller ones, right to left
        done = first[c + 1]
        while True:
            wave = out[fill[c] : done][::-1]
            done = fill[c]
            before = wave[wave > 0] - 1
            before = before[(text[before] == c) & small[before]]
            if not len(before):
                break
            out[done - len(before) : done] = before[::-1]
            fill[c] -= len(before)
        whole = np.concatenate((out[fill[c] : first[c + 1]][::-1], out[first[c] : larger[c]][::-1]))
        before = whole[whole > 0] - 1
        before = before[small[before] & (text[before] < c)]
        if len(before):
            _place(out, fill, text[before], before, False)
    out[0] = n - 1  # the end itself, which no other suffix leads to
    return out


def _short(text: np.ndarray) -> np.ndarray:
    """The suffix array of a short text, where the recursion ends: the length by which ranks tell suffixes apart is doubled."""
    rank, step, n = text.astype(np.int64), 1, len(text)
    most = max(n, int(rank.max(initial=0)) + 1) + 1  # a short text's symbols may be greater than its length
    while n > 1:
        key = rank * most
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2
    return np.arange(n)


def _same_substrings(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each substring equals the one before it in the list."""
    same = np.zeros(len(start), bool)
    pair = np.flatnonzero(size[1:] == size[:-1]) + 1
    if len(pair):
        n = size[pair]
        head = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(head, n)
        a, b = np.repeat(start[pair], n) + inside, np.repeat(start[pair - 1], n) + inside
        same[pair] = np.logical_and.reduceat(text[a] == text[b], head)
    return same


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes in order; the text holds 0..symbols-1 and ends with its only 0."""
    n = len(text)
    if n <= SHORT:
        return _short(text)
    if symbols <= DIGIT:
        return _sorted(text, symbols)
    base = int(np.ceil(np.sqrt(symbols)))  # both digits alike, so that deeper levels get shorter; they begin at 1, the end is 0
    digits = np.zeros(2 * n - 1, np.int64)
    digits[:-1:2], digits[1::2] = (text[:-1].astype(np.int64) - 1) // base + 1, (text[:-1].astype(np.int64) - 1) % base + 1
    order = _sorted(digits, base + 1)
    return order[order % 2 == 0] // 2


def _sorted(text: np.ndarray, symbols: int) -> np.ndarray:
    n, text = len(text), text.astype(np.uint16)
    # a suffix is smaller than the next if its first differing symbol is; equal symbols take the next one's class
    change = np.concatenate((np.sign(text[1:].astype(np.int64) - text[:-1]), [0]))
    nearest = np.where(change != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    small = change[nearest] > 0
    del change, nearest  # what is done with goes before the recursion, which needs two thirds of this level's memory
    small[-1] = True
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost smaller
    first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
    rough = _induce(text, small, first, seeds[np.argsort(text[seeds], kind="stable")])
    leftmost = np.zeros(n, bool)
    leftmost[seeds] = True
    ordered = rough[leftmost[rough]]
    del rough, leftmost
    size = np.zeros(n, np.int64)
    size[seeds] = np.append(np.diff(seeds) + 1, 1)
    lengths = size[ordered]
    del size
    names = np.cumsum(~_same_substrings(text, ordered, lengths)) - 1
    del lengths
    if names[-1] + 1 < len(seeds):
        name_of = np.zeros(n, np.int64)
        name_of[ordered] = names
        symbols, name_of = int(names[-1]) + 1, name_of[seeds]
        del names, ordered
        ordered = seeds[suffix_array(name_of, symbols)]
        del name_of
    return _induce(text, small, first, ordered)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, by its place in the text, the symbols it shares with the one before it in order.

    Only where the symbols before the two suffixes differ is anything compared; every other value is one
    less than that of the place before.
    """
    n = len(text)
    ahead = np.full(n, n - 1, np.int64)
    ahead[order[1:]] = order[:-1]
    head = np.ones(n, bool)
    head[1:] = (text[:-1] != text[np.maximum(ahead[1:] - 1, 0)]) | (ahead[1:] == 0)
    head[order[0]] = True
    if order[0] + 1 < n:
        head[order[0] + 1] = True
    at = np.flatnonzero(head)
    value = np.zeros(len(at), np.int64)
    open_ = np.flatnonzero(at != order[0])
    step = 0
    while len(open_):
        a, b = at[open_] + step, ahead[at[open_]] + step
        inside = (a < n) & (b < n)
        same = inside & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
        value[open_[~same]] = step
        open_ = open_[same]
        step += 1
    last = np.cumsum(head) - 1
    return np.maximum(value[last] - (np.arange(n) - at[last]), 0)
