"""SentencePiece encoding and decoding in batched numpy.

A text is cut where no piece can span: before each run of white-space marks. Each distinct word is
encoded once, together with all words of the same length: substring hashes of every start probe the
sorted keys of the pieces, as long as a piece goes on so, and Viterbi takes the best path with vectorised
maxima that store backpointers. A unigram model's path has the largest sum of scores. A BPE model's ids
are the result of merges; its lattice has only those pieces side by side that merging would keep apart,
which leaves one path, the merges' own. Longer words are cut, encoded in the same way and mended.

Defined results: a null or empty text has no ids and decodes to the empty text; code points without a
piece become their UTF-8 bytes' pieces; U+2581, which stands for a space in such models, decodes as a
space. Repeated rows are encoded each; an empty table gives no rows; extra columns are ignored. Only
models with identity normalisation and byte fallback, whose pieces don't hold a mark after another
code point and (BPE) rank behind the pieces that they are merged from, are accepted.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import small_batches
from siltstone.llm.textbatch import mix64

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Code points of the cuts of a longer word; most cells of a batch's table; most words remembered by a worker.
LONG = 40
CELLS = 1 << 22
REMEMBERED = 500_000
#: Most pairs of symbols of which a worker remembers whether merging keeps them apart.
PAIRS_REMEMBERED = 1 << 21
#: Code points encoded at once.
CHUNK = 1 << 22
#: A unigram path through an unknown code point scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0

_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BASE = np.uint64(0x100000001B3 * 2654435761 % 2**64 | 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class _Pairs:
    """Remembers yes or no for pairs of symbols, in open addressing; forgets all beyond PAIRS_REMEMBERED."""

    def __init__(self):
        self.slots, self.used = 1 << 16, 0
        self.key, self.answer = np.full(self.slots, -1, np.int64), np.zeros(self.slots, bool)

    def _at(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.view(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(answers, whether they are known)."""
        at, known, open_ = self._at(key), np.zeros(len(key), bool), np.arange(len(key))
        while len(open_):
            here = self.key[at[open_]]
            hit = here == key[open_]
            known[open_[hit]] = True
            open_ = open_[~hit & (here >= 0)]
            at[open_] = (at[open_] + 1) & (self.slots - 1)
        return self.answer[at] & known, known

    def add(self, key: np.ndarray, answer: np.ndarray) -> None:
        """Distinct keys that are not known."""
        if self.used + len(key) > self.slots // 2:
            old = self.key >= 0
            key, answer = np.concatenate((self.key[old], key)), np.concatenate((self.answer[old], answer))
            if len(key) > PAIRS_REMEMBERED:
                key, answer = key[-PAIRS_REMEMBERED:], answer[-PAIRS_REMEMBERED:]
            while len(key) > self.slots // 4:
                self.slots *= 2
            self.used, self.key, self.answer = 0, np.full(self.slots, -1, np.int64), np.zeros(self.slots, bool)
        at, open_ = self._at(key), np.arange(len(key))
        while len(open_):
            free = open_[self.key[at[open_]] < 0]
            self.key[at[free]] = key[free]  # of several for one slot the last stays
            done = self.key[at[open_]] == key[open_]
            self.answer[at[open_[done]]] = answer[open_[done]]
            open_ = open_[~done]
            at[open_] = (at[open_] + 1) & (self.slots - 1)
        self.used += len(key)


class PieceModel:
    """The pieces of a model file and what is needed to look them up.

    A symbol is a piece's id or, for a code point without a piece, the number of pieces plus the code point.
    """

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types, self.kind = [], [], [], UNIGRAM
        self.prefix, charsmap, squeeze = True, b"", True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                charsmap, self.prefix, squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if charsmap or squeeze or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with identity normalisation are supported")
        if BYTE not in self.types:
            raise ValueError("the model has no byte fallback")
        at_byte = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.bytes_ = np.array([at_byte[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        self.plain = [i for i, t in enumerate(self.types) if t in (NORMAL, USER_DEFINED)]
        if any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in self.plain):
            raise ValueError("a piece spans words")
        self.count = len(self.pieces)
        self.longest = max(len(self.pieces[i]) for i in self.plain)
        self.score = np.array(self.scores, np.float64)
        self.low = min(self.scores[i] for i in self.plain) - UNKNOWN_PENALTY
        self._index()
        self.pairs = _Pairs()
        if self.kind == BPE:
            self._trees()
        # for decoding: the bytes of each piece, end to end
        out = [b"" if t in (CONTROL, UNUSED) else " ⁇ ".encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        self.sizes = np.array([len(x) for x in out])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(out), np.uint8)

    # ---- looking pieces up ---------------------------------------------------------------------------

    def _index(self) -> None:
        """Sorted keys of all pieces and their beginnings, with the piece (or -1) and whether a longer one begins so."""
        self.length = np.ones(self.count, np.int64)
        self.value = np.zeros(self.count, np.uint64)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.longest, _BASE, np.uint64))), dtype=np.uint64)
        keys, ids, longer = [], [], []
        for size in range(1, self.longest + 1):
            long_enough = [i for i in self.plain if len(self.pieces[i]) >= size]
            codes = np.frombuffer("".join(self.pieces[i][:size] for i in long_enough).encode("utf-32-le"), np.uint32).reshape(-1, size)
            value = np.zeros(len(codes), np.uint64)
            with np.errstate(over="ignore"):
                for k in range(size):
                    value = value * _BASE + codes[:, k] + np.uint64(1)
            own = np.array(long_enough)
            whole = np.array([len(self.pieces[i]) == size for i in long_enough])
            self.length[own[whole]], self.value[own[whole]] = size, value[whole]
            order = np.lexsort((~whole, value))
            value, own, whole = value[order], own[order], whole[order]
            new = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            if np.count_nonzero(whole) != np.count_nonzero(whole[new]) or len(new) != len(np.unique(codes, axis=0)):
                raise ValueError("two pieces share a hash")
            keys.append(self._key(value[new], size))
            ids.append(np.where(whole[new], own[new], -1))
            longer.append(np.diff(np.append(new, len(value))) > whole[new])
        keys, ids, longer = np.concatenate(keys), np.concatenate(ids), np.concatenate(longer)
        order = np.argsort(keys)
        self.keys, self.ids, self.longer = keys[order], ids[order].astype(np.int32), longer[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.shift = np.uint64(64 - len(keys).bit_length())
        edges = np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift
        self.begin = np.append(np.searchsorted(self.keys, edges), len(keys))  # where each value of the leading bits begins
        self.crowd = int(np.diff(self.begin).max())

    @staticmethod
    def _key(value: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(value + np.asarray(length).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def probe(self, key: np.ndarray) -> np.ndarray:
        """The place of each key among the sorted ones, or -1."""
        lead = (key >> self.shift).astype(np.int64)
        at, end = self.begin[lead], self.begin[lead + 1]
        found = np.full(len(key), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        for _ in range(self.crowd):
            hit = self.keys[at[open_]] == key[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
            if not len(open_):
                break
        return found

    def table(self, codes: np.ndarray) -> np.ndarray:
        """The symbols by word, start and length less 1, for words of one length; -1 where no piece is."""
        n, size = codes.shape
        most = min(size, self.longest)
        ids = np.full((n * size, most), -1, np.int32)
        flat = codes.reshape(-1).astype(np.uint64)
        room = np.tile(np.arange(size, 0, -1), n)
        on, value = np.arange(n * size), np.zeros(n * size, np.uint64)
        for k in range(most):
            with np.errstate(over="ignore"):
                value = value * _BASE + flat[on + k] + np.uint64(1)
            at = self.probe(self._key(value, k + 1))
            hit = at >= 0
            if k == 0:
                ids[:, 0] = np.where(hit, self.ids[at], self.count + codes.reshape(-1))
            else:
                ids[on[hit], k] = self.ids[at[hit]]
            more = hit & self.longer[at] & (room[on] > k + 1)
            on, value = on[more], value[more]
            if not len(on):
                break
        return ids.reshape(n, size, most)

    # ---- what merging does -----------------------------------------------------------------------------

    def _trees(self) -> None:
        """For every piece its rank (the lower merges first) and the two symbols of its last merge.

        A piece whose parts merge otherwise is never made and no candidate. Pieces must rank behind their parts.
        """
        self.rank = np.full(self.count, np.inf)
        self.rank[self.plain] = -self.score[self.plain]
        self.made = np.full(self.count, -np.inf)  # when a symbol comes to be; code points are there at once
        self.left = np.full(self.count, -1, np.int64)
        self.right = np.full(self.count, -1, np.int64)
        self.reached = np.zeros(self.count, bool)
        for size in range(1, self.longest + 1):
            own = np.array([i for i in self.plain if len(self.pieces[i]) == size], np.int64)
            if size == 1:
                self.reached[own] = True
                continue
            for cut in range(1, size) if len(own) else ():
                a, b = (self._symbols([self.pieces[i][s] for i in own]) for s in (slice(cut), slice(cut, None)))
                some = np.flatnonzero((a >= 0) & (b >= 0))
                some = some[self._is_made(a[some]) & self._is_made(b[some])]
                some = some[self.apart(a[some], b[some], False)]
                self.left[own[some]], self.right[own[some]], self.reached[own[some]] = a[some], b[some], True
                if (np.maximum(self._made(a[some]), self._made(b[some])) > self.rank[own[some]]).any():
                    raise ValueError("a piece ranks before its parts")
            self.made[own] = self.rank[own]

    def _symbols(self, texts: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)
        value = np.zeros(len(texts), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(codes.shape[1]):
                value = value * _BASE + codes[:, k] + np.uint64(1)
        at = self.probe(self._key(value, codes.shape[1]))
        none = self.count + codes[:, 0].astype(np.int64) if codes.shape[1] == 1 else -1
        found = np.where(at >= 0, self.ids[at], -1)
        return np.where(found >= 0, found, none).astype(np.int64)

    def _own(self, values: np.ndarray, symbols: np.ndarray, other) -> np.ndarray:
        return np.where(symbols < self.count, values[np.minimum(symbols, self.count - 1)], other)

    def _made(self, symbols: np.ndarray) -> np.ndarray:
        return self._own(self.made, symbols, -np.inf)

    def _is_made(self, symbols: np.ndarray) -> np.ndarray:
        return self._own(self.reached, symbols, True)

    def apart(self, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
        """Whether merging the text of two symbols leaves the boundary between them alone.

        Both are taken to pieces, the one made later first, so that all pairs of neighbours at the boundary
        pass by; a pair that is a piece and merges before either neighbour is used up crosses it. Of merges
        of one rank the leftmost is first. Without whole, the two symbols themselves may make a piece.
        """
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        used_a, used_b = np.full(len(a), np.inf), np.full(len(a), np.inf)
        while len(at):
            if whole:
                size = self._own(self.length, b, 1)
                with np.errstate(over="ignore"):
                    value = self._own(self.value, a, (a - self.count + 1).astype(np.uint64)) * self.power[size] + self._own(self.value, b, (b - self.count + 1).astype(np.uint64))
                place = self.probe(self._key(value, self._own(self.length, a, 1) + size))
                piece = np.where(place >= 0, self.ids[place], -1)
                rank = np.where(piece >= 0, self.rank[piece], np.inf)
                crossed = (rank < used_a) & (rank <= used_b)
                crossed &= piece >= 0
                ok[at[crossed]] = False
            else:
                crossed = np.zeros(len(at), bool)
            whole = True
            made_a, made_b = self._made(a), self._made(b)
            on = ~crossed & (np.maximum(made_a, made_b) > -np.inf)
            at, a, b, used_a, used_b, made_a, made_b = (x[on] for x in (at, a, b, used_a, used_b, made_a, made_b))
            later = made_a > made_b
            used_a, used_b = np.where(later, made_a, used_a), np.where(later, used_b, made_b)
            a = np.where(later, self._own(self.right, a, 0), a)
            b = np.where(later, b, self._own(self.left, b, 0))
        return ok

    def keeps_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As apart(), remembered."""
        key = (a << 22) | b
        answer, known = self.pairs.find(key)
        if not known.all():
            new = np.unique(key[~known])
            self.pairs.add(new, self.apart(new >> 22, new & ((1 << 22) - 1)))
            answer = self.pairs.find(key)[0]
        return answer

    # ---- encoding ------------------------------------------------------------------------------------

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, number of them by word) on the best path of each word; all have one length.

        All words advance together, from one end to the next; the best of the pieces that end there is kept
        with its length as backpointer. A unigram model's best path has the largest sum of scores. In a BPE
        model a piece may follow only a symbol from which merging keeps it apart; of any text's beginning
        exactly one path is left, which is what merging gives.
        """
        n, size = codes.shape
        ids = self.table(codes)
        most = ids.shape[2]
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        last = np.full((n, size + 1), -1, np.int64)
        every = np.arange(n)
        for end in range(1, size + 1):
            steps = np.arange(1, min(end, most) + 1)
            symbols = ids[:, end - steps, steps - 1].astype(np.int64)
            if self.kind == UNIGRAM:
                gain = np.where(symbols >= 0, self._own(self.score, symbols, self.low), -np.inf)
                reach = best[:, end - steps] + gain
            else:
                reach = np.full(symbols.shape, -np.inf)
                row, step = np.nonzero((symbols >= 0) & self._is_made(symbols))
                right = symbols[row, step]
                left = last[row, end - steps[step]]
                fits = left < 0  # the word's beginning
                inner = np.flatnonzero(~fits)
                fits[inner] = self.keeps_apart(left[inner], right[inner])
                reach[row[fits], step[fits]] = 0
            at = reach.argmax(1)
            best[:, end], back[:, end], last[:, end] = reach[every, at], steps[at], symbols[every, at]
        on_path = np.zeros((n, size + 1), bool)
        at = np.full(n, size)
        while (on := np.flatnonzero(at > 0)).size:
            on_path[on, at[on]] = True
            at[on] -= back[on, at[on]]
        return last[on_path], on_path.sum(1)

    def _batches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all symbols, number of them by word); words of one length are encoded together."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        sizes, made = np.zeros(len(words), np.int64), []
        at = int(np.searchsorted(size[order], 1))
        while at < len(order):
            n = int(size[order[at]])
            upto = min(int(np.searchsorted(size[order], n, side="right")), at + max(1, CELLS // (n * min(n, self.longest))))
            part = order[at:upto]
            codes = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            symbols, sizes[part] = self._alone(words[part[0]]) if len(part) == 1 and n > 4 * LONG else self.viterbi(codes)
            made.append(symbols)
            at = upto
        begin = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int64)
        if made:
            n = sizes[order]
            flat[np.repeat(begin[order] - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.concatenate(made)
        return flat, sizes

    def _alone(self, word: str) -> tuple[np.ndarray, int]:
        """viterbi() for one very long word, place by place."""
        of = {self.pieces[i]: i for i in self.plain if self.kind == UNIGRAM or self.reached[i]}
        apart: dict[tuple[int, int], bool] = {}
        best, back, last = [0.0], [0], [-1]
        for end in range(1, len(word) + 1):
            found = (-np.inf, 1, -1)
            for step in range(1, min(end, self.longest) + 1):
                symbol = of.get(word[end - step : end], self.count + ord(word[end - 1]) if step == 1 else -1)
                if symbol < 0:
                    continue
                before = last[end - step]
                if self.kind == UNIGRAM:
                    value = best[end - step] + (self.scores[symbol] if symbol < self.count else self.low)
                else:
                    if before >= 0 and (before, symbol) not in apart:
                        apart[before, symbol] = bool(self.keeps_apart(np.array([before]), np.array([symbol]))[0])
                    value = 0.0 if before < 0 or apart[before, symbol] else -np.inf
                if value > found[0]:
                    found = (value, step, symbol)
            best.append(found[0])
            back.append(found[1])
            last.append(found[2])
        path, at = [], len(word)
        while at:
            path.append(last[at])
            at -= back[at]
        return np.array(path[::-1], np.int64), len(path)

    def _stitched(self, words: list[str]) -> list[np.ndarray]:
        """The symbols of long words of a BPE model: of cuts of them, mended at the joints.

        Neighbours that merging keeps apart everywhere make the text's encoding. Where two cuts' ends don't
        keep apart, some symbols on both sides are put together and encoded anew, more each time.
        """
        def runs_of(texts: list[str]) -> list[np.ndarray]:
            flat, sizes = self._batches(texts)
            return np.split(flat, np.cumsum(sizes)[:-1]) if texts else []

        cuts = [[w[i : i + LONG] for i in range(0, len(w), LONG)] for w in words]
        made = iter(runs_of([c for cut in cuts for c in cut]))
        runs = [[next(made) for _ in cut] for cut in cuts]
        width, open_ = 4, [i for i, r in enumerate(runs) if len(r) > 1]
        while open_:
            jobs, texts = [], []
            for i in open_:
                own = runs[i]
                good = self.keeps_apart(np.array([r[-1] for r in own[:-1]]), np.array([r[0] for r in own[1:]]))
                edge = [0, *(np.flatnonzero(~good) + 1).tolist(), len(own)]
                own = runs[i] = [np.concatenate(own[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                chosen = list(range(0, len(own) - 1, 2))
                jobs.append((i, chosen))
                texts += [self._text(np.concatenate((own[b][-width:], own[b + 1][:width]))) for b in chosen]
            mended = iter(runs_of(texts))
            open_ = []
            for i, chosen in jobs:
                own, out, at = runs[i], [], 0
                for b in chosen:
                    out += own[at:b]
                    out += [x for x in (own[b][:-width], next(mended), own[b + 1][width:]) if len(x)]
                    at = b + 2
                runs[i] = out + own[at:]
                if len(runs[i]) > 1:
                    open_.append(i)
            width *= 2
        return [np.concatenate(r) for r in runs]

    def _text(self, symbols: np.ndarray) -> str:
        return "".join(self.pieces[x] if x < self.count else chr(x - self.count) for x in symbols.tolist())

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of them by word); a code point without a piece becomes its bytes' pieces."""
        long = [i for i, w in enumerate(words) if len(w) > LONG] if self.kind == BPE else []
        flat, sizes = self._batches([w if len(w) <= LONG else "" for w in words] if long else words)
        if long:  # put in where they belong
            stitched = self._stitched([words[i] for i in long])
            begin = np.concatenate((np.cumsum(sizes) - sizes, len(flat) + np.cumsum([0, *(len(r) for r in stitched)])))
            sizes[long] = [len(r) for r in stitched]
            begin[long] = begin[len(words) : -1]
            flat = np.concatenate((flat, *stitched))[np.repeat(begin[: len(words)] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        alone = np.flatnonzero(flat >= self.count)
        if len(alone):
            spelt = [self.bytes_[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (flat[alone] - self.count).tolist()]
            times = np.ones(len(flat), np.int64)
            times[alone] = [len(x) for x in spelt]
            sizes = np.bincount(np.repeat(np.repeat(np.arange(len(words)), sizes), times), minlength=len(words))
            flat = np.repeat(flat, times)
            flat[flat >= self.count] = np.concatenate(spelt)
        return flat.astype(np.int32), sizes


class Codec:
    """Encodes and decodes; remembers words between calls."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids by text)."""
        if len(self.index) > REMEMBERED:
            self._forget()
        lead = MARK if self.model.prefix else ""
        split = [_WORD.findall(lead + t.replace(" ", MARK)) if t else [] for t in texts]
        words = [w for s in split for w in s]
        new = list(dict.fromkeys(w for w in words if w not in self.index))
        if new:
            made, sizes = self.model.encode_words(new)
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, made))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        size = self.sizes[at]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1], size) + np.repeat(self.starts[at], size)]
        ends = np.cumsum([len(s) for s in split]).astype(np.int64) if split else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate(([0], total[ends])))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of runs of ids."""
        m = self.model
        size = m.sizes[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        flat = m.flat[np.arange(total[-1]) - np.repeat(total[:-1], size) + np.repeat(m.starts[ids], size)].tobytes()
        ends = total[np.concatenate(([0], np.cumsum(counts)))]
        skip = 1 if m.prefix else 0
        return [flat[a : a + 1].replace(b" ", b"") * skip + flat[a + skip : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """(ids, texts) of rows, about CHUNK code points at once whatever the batches' size."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for own, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids.append(own)
            texts.append(text)
            size += len(text or "")
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_CODECS: dict[bytes, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """The codec of a model file's bytes, made once in each process and kept for the next task."""
    key = hashlib.sha256(data).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(PieceModel(data))
    return _CODECS[key]


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, n_tokens, text_sha256, decoded_sha256, round_trip.

    The model file is read by the driver and broadcast; its size does not depend on the data.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = load(model_path)
    codec_of(data)  # refuse an unsuitable model here
    shared = spark.sparkContext.broadcast(data)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("text_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for own, texts in _groups(batches):
            ids, counts = codec.encode(texts)
            back = codec.decode(ids, counts)
            sums = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
            again = [hashlib.sha256(b).hexdigest() for b in back]
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(ids, pa.int32()))
            columns = [pa.array(own, pa.int64()), lists, pa.array(counts, pa.int64()), pa.array(sums), pa.array(again), pa.array([a == b for a, b in zip(sums, again, strict=True)])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return found.mapInArrow(coded, "doc_id long, ids array<int>, n_tokens long, text_sha256 string, decoded_sha256 string, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text."""
    spark = encoded.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load(model_path))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            runs = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
            back = codec.decode(np.concatenate(runs) if runs else np.zeros(0, np.int32), np.array([len(r) for r in runs], np.int64))
            texts = pa.array([b.decode(errors="replace") for b in back], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    found = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return found.mapInArrow(coded, "doc_id long, text string")
