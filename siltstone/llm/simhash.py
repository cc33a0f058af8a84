"""SimHash near-duplicate detection over a Gray-order hierarchical index.

Equal fingerprints are first made one. Two fingerprints that differ in at most three bits agree in
one of four blocks of 16 bits, so each fingerprint goes, once for each block, to the shard of its value
there. A shard sorts its fingerprints by Gray rank, in which neighbours differ in few bits, and factors
the bits that neighbours share, wherever these are, into the nodes above them. Pairs of nodes descend
together; the differences among the bits shared so far add up, and a pair is dropped with all below it
once they exceed three. A value that very many share is spread by ranges of Gray rank, and the upper
levels of its index are tables. Links of a shard are reduced to a spanning forest; components are found
by contraction.

Defined results: null counts as empty; a text without words has fingerprint zero, linked like any
other; repeated ids keep a row each; a null id never names a component that has another id; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import keep_documents, release, small_batches, store, text_bytes, text_hash
from siltstone.llm.components import components

#: Words in a shingle, the hash seed, the most differing bits of a link.
WORDS = 3
SEED = 42
BITS = 3
#: Fingerprints that share a block's value and go to one shard at most.
PART = 4_096
#: Neighbours below one node of the index.
FAN = 8
#: Rows of crowded values that a task cuts into runs at once.
CUT_ROWS = 1 << 17
#: Rows of a shard, about.
SHARD_ROWS = 200_000
#: Pairs of nodes held at once.
PAIRS = 2_000_000

_HASH = partial(xxhash.xxh64_intdigest, seed=SEED)
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bit i is 1 if set in over half the hashes of the text's shingles, repeats included."""
    w = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    hashes = np.fromiter(map(_HASH, shingles), np.uint64)
    if len(hashes) == 1:
        return int(hashes[0])
    each = hashes.view(np.uint8).reshape(-1, 8)
    sums = np.concatenate([np.bincount(each[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * sums > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, x, fp): one row per input row; x is the text_hash, fp is signed."""
    small_batches(docs.sparkSession)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words) for t in batch["text"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": batch["x"], "fp": fp.view(np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("x"), text_bytes(text_col).alias("text")).mapInPandas(
        made, "doc_id long, x long, fp long"
    )


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in Gray order."""
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bits that all patterns of one node have and none of the other; a node is (all its patterns and-ed, or-ed).

    No pattern of one differs from a pattern of the other in fewer bits.
    """
    return np.bitwise_count((a[0] & ~b[1]) | (b[0] & ~a[1]))


class GrayIndex:
    """Fingerprints of some groups in Gray order, below nodes of FAN neighbours each that hold what these share.

    levels[0] are the fingerprints, the last level has one node for each group. A level is (patterns and-ed,
    or-ed, first child of each node with one more).
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray, gray: bool = True):
        order = np.lexsort((gray_rank(fp) if gray else fp, group))
        group, fp = group[order], fp[order]
        keep = np.append(True, (group[1:] != group[:-1]) | (fp[1:] != fp[:-1]))[: len(fp)]
        self.fp, group = fp[keep], group[keep]
        self.levels = [(self.fp, self.fp, np.zeros(0, np.int64))]
        while True:
            new = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[: len(group)]
            if len(new) == len(group):
                break
            inside = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
            first = np.flatnonzero(inside % FAN == 0)
            low, high, _ = self.levels[-1]
            self.levels.append((np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), np.append(first, len(group))))
            group = group[first]

    def near(self, most: int, visited: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of fingerprints of one group (by their places) that differ in at most `most` bits.

        Pairs of nodes descend together. What a level's nodes share and differ in adds to the differences
        found above; a pair with more than `most` is dropped with all that is below it.
        """
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        yield from self._descend(top, roots, roots, most, visited)

    def _descend(self, level: int, a: np.ndarray, b: np.ndarray, most: int, visited: list[int] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if level == 0:
            yield a[a != b], b[a != b]
            return
        first = self.levels[level][2]
        low, high, _ = self.levels[level - 1]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        size = na * nb
        cuts, done = np.cumsum(size), 0
        while done < len(a):
            upto = max(done + 1, int(np.searchsorted(cuts, (cuts[done - 1] if done else 0) + PAIRS, side="right")))
            part = slice(done, upto)
            k = np.repeat(np.arange(done, upto), size[part])
            inner = np.arange(len(k)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            ca, cb = first[a[k]] + inner // nb[k], first[b[k]] + inner % nb[k]
            once = ca <= cb
            ca, cb = ca[once], cb[once]
            if visited is not None:
                visited.append(len(ca))
            keep = differences((low[ca], high[ca]), (low[cb], high[cb])) <= most
            yield from self._descend(level - 1, ca[keep], cb[keep], most, visited)
            done = upto


def link_group(group: np.ndarray, fp: np.ndarray, most: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fp, fp) among fingerprints (unsigned) of the same group that differ in at most `most` bits."""
    index = GrayIndex(group, fp)
    label = np.arange(len(index.fp))
    for a, b in index.near(most) if len(label) else ():
        while len(a):  # union by smallest label
            while not ((up := label[label]) == label).all():
                label = up
            ra, rb = label[a], label[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
    while not ((up := label[label]) == label).all():
        label = up
    joined = np.flatnonzero(label != np.arange(len(label)))
    return index.fp[joined], index.fp[label[joined]]


def block_masks(most: int = BITS) -> list[int]:
    """most + 1 blocks of bits, as signed masks: values that differ in at most `most` bits agree in one of them."""
    edges = [64 * i // (most + 1) for i in range(most + 2)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def gray_order(fp: str) -> Column:
    """gray_rank of a signed fingerprint, as a signed value in the same order."""
    rank = F.col(fp)
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def near_links(fps: DataFrame, most: int = BITS, part: int = PART) -> DataFrame:
    """Links (a, b) that connect all distinct signed fingerprints `fp` differing in at most `most` bits.

    The index's first level are blocks of bits, in one of which a pair has no difference: a fingerprint goes
    once for each block to the shard of its value there. Values that over `part` fingerprints share are not
    put in one shard but dealt by range of Gray rank, see _crowded.
    """
    spark = fps.sparkSession
    masks = block_masks(most)
    routed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    heavy = store(routed.groupBy("t", "key").count().filter(F.col("count") > part), "simhash-crowded")
    crowd = heavy.agg(F.sum("count")).first()[0] or 0
    light = routed.join(heavy, ["t", "key"], "left_anti") if crowd else routed
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), fps.count() * len(masks) // SHARD_ROWS + 1)

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pd.concat(held, ignore_index=True)
            group = rows.groupby(["t", "key"], sort=False).ngroup().to_numpy()
            a, b = link_group(group, rows["fp"].to_numpy(np.int64).view(np.uint64), most)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    links = light.repartition(shards, "t", "key").mapInPandas(linked, "a long, b long")
    return links.unionByName(_crowded(routed.join(heavy.drop("count"), ["t", "key"]), crowd, most, part)) if crowd else links


def _crowded(rows: DataFrame, count: int, most: int, part: int) -> DataFrame:
    """The links of (t, key, fp) with crowded keys, by runs of at most `part` / 4 neighbours in Gray order.

    Tasks get equal ranges of (t, key, Gray rank) and cut them into runs. Nodes above the runs hold what their
    FAN children share, up to one for each key; pairs of nodes descend level by level, and those that differ
    in too many bits are dropped before any fingerprint moves.
    """
    spark = rows.sparkSession
    size = max(2, part // 4)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // SHARD_ROWS + 1)
    ranged = rows.withColumn("g", gray_order("fp")).repartitionByRange(tasks, "t", "key", "g").sortWithinPartitions("t", "key", "g").select("t", "key", "g", "fp")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat((held, batch), ignore_index=True)
            if len(held) > CUT_ROWS:  # the last key may go on in the next batch
                last = held["key"].ne(held["key"].iloc[-1]) | held["t"].ne(held["t"].iloc[-1])
                own = int(last.sum())
                own += (len(held) - own - 1) // size * size
                yield runs(held.iloc[:own])
                held = held.iloc[own:]
        if held is not None and len(held):
            yield runs(held)

    def runs(rows: pd.DataFrame) -> pd.DataFrame:
        made = []
        for (t, key), own in rows.groupby(["t", "key"], sort=False):
            fp, g = own["fp"].to_numpy(np.int64), own["g"].to_numpy(np.int64)
            for s in range(0, len(fp), size):
                run = fp[s : s + size]
                made.append((t, key, g[s], np.bitwise_and.reduce(run), np.bitwise_or.reduce(run), run.tobytes()))
        return pd.DataFrame(made, columns=["t", "key", "g", "low", "high", "fps"])

    made = store(ranged.mapInPandas(cut, "t int, key long, g long, low long, high long, fps binary"), "simhash-runs")
    places = Window.partitionBy("t", "key").orderBy("g")
    nodes = store(made.select("t", "key", "g", "low", "high", (F.row_number().over(places) - 1).cast("long").alias("node")), "simhash-nodes")
    levels = [nodes.drop("g")]
    while not levels[-1].filter("node > 0").isEmpty():
        above = levels[-1].groupBy("t", "key", F.expr(f"node div {FAN}").alias("node"))
        levels.append(store(above.agg(F.bit_and("low").alias("low"), F.bit_or("high").alias("high")), "simhash-above"))
    pairs = levels[-1].select("t", "key", F.col("node").alias("a"), F.col("node").alias("b"))
    for level in levels[-2::-1]:
        for x in ("a", "b"):
            below = level.select("t", "key", F.expr(f"node div {FAN}").alias(x), F.col("node").alias(f"{x}_node"), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"))
            pairs = pairs.join(below, ["t", "key", x])
        near = F.expr(f"bit_count((a_low & ~b_high) | (b_low & ~a_high)) <= {most}")
        pairs = store(pairs.filter(near & (F.col("a_node") <= F.col("b_node"))).select("t", "key", F.col("a_node").alias("a"), F.col("b_node").alias("b")), "simhash-pairs")
    held = nodes.select("t", "key", "g", "node").join(made.select("t", "key", "g", "fps"), ["t", "key", "g"]).drop("g")
    for x in ("a", "b"):
        pairs = pairs.join(held.select("t", "key", F.col("node").alias(x), F.col("fps").alias(f"{x}_fps")), ["t", "key", x])

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["a_fps"], batch["b_fps"], strict=True):
                fp = np.unique(np.frombuffer(a + b, np.uint64))
                x, y = link_group(np.zeros(len(fp), np.int64), fp, most)
                yield pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    return pairs.select("a_fps", "b_fps").repartition(tasks).mapInPandas(linked, "a long, b long")


def _first_of_components(rows: DataFrame, most: int) -> DataFrame:
    """(fp, first: the component's document of least id, null last, and then of least x)."""
    document = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")
    single = store(rows.groupBy("fp").agg(F.min(document).alias("first")), "simhash-single")
    roots = components(near_links(single.select("fp"), most))
    named = single.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    named = store(named, "simhash-named")
    release(single, roots)
    least = store(named.groupBy("root").agg(F.min("first").alias("first")), "simhash-least")
    found = store(named.select("fp", "root").join(least, "root").select("fp", "first"), "simhash-first")
    release(named, least)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, most: int = BITS) -> DataFrame:
    """One row per input row: doc_id, fp (signed), component_id (the smallest id reachable by links)."""
    rows = store(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    return rows.join(_first_of_components(rows, most), "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, columns unchanged, of one document of each component: the smallest id, null last; of unlike texts of that id the one with the least hash."""
    rows = store(fingerprints(docs, id_col, text_col), "simhash-rows")
    found = rows.join(_first_of_components(rows, BITS), "fp")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("x") == F.col("first.x"))
    return keep_documents(docs, found.select("doc_id", "x", kept.alias("kept")), id_col, text_col)
