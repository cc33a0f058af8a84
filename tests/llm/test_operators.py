"""Each operator against brute force on small tables with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, fingerprints, html_extract, langid, mixing, quality, repeats, simhash, substring_dedup, suffix_dedup
from siltstone.llm.common import below, release, sampled, small_batches, store, trimmed
from siltstone.llm.components import components
from siltstone.llm.suffix_array import common_prefixes, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, periods, nulls and blanks."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé ß".replace(" ", ""), k=rng.randint(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=45))
    texts = [None, "", " \t\n", "x", "one two", "a b c d", "Wher. " * 70, "aaaa " * 40, "z" * 700, "z" * 650]
    while len(texts) < n:
        kind = rng.random()
        words = rng.choices(vocabulary, k=rng.randint(1, 160))
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.3:
            texts.append((rng.choice(texts) or "").upper())
        elif kind < 0.45 and len(words) > 5:
            old = WORD.findall(rng.choice(texts) or "")
            if old:
                old[rng.randrange(len(old))] = "edited"
            texts.append("  ".join(old))
        elif kind < 0.6:
            texts.append(" ".join(words[:20]) + "\n" + passage + " " + " ".join(words[20:40]))
        else:
            texts.append(" ".join(words))
    return texts


def table(spark, texts, **more):
    """documents with columns whose names clash with what operators make; ids are shuffled."""
    ids = random.Random(3).sample(range(1000), len(texts))
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "de", i, "x", "y", 1) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, h long, skey string, doc string, copies int").repartition(3), {i: t for i, t in zip(ids, texts)}


@pytest.fixture(scope="module")
def docs(spark):
    df, own = table(spark, corpus())
    return df.cache(), own


def test_exact_dedup(spark, docs):
    df, own = docs
    groups = {}
    for i, t in own.items():
        groups.setdefault(ascii_lower(t or ""), []).append(i)
    found = exact_dedup.exact_dedup(df, exact_dedup.fresh_index(spark, 4)).collect()
    assert len(found) == len(own)
    for r in found:
        text = ascii_lower(own[r.doc_id] or "")
        assert (r.keep_id, r.group_size, r.kept) == (max(groups[text]), len(groups[text]), r.doc_id == max(groups[text]))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.keep_one(df.union(df), exact_dedup.fresh_index(spark, 4))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_digest_index_grows_and_can_be_rerun(spark):
    index = exact_dedup.fresh_index(spark, 4)
    first = spark.createDataFrame([(1, "a"), (2, "A"), (None, "b")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(first, index).collect()} == {(1, 2, False), (2, 2, True), (None, None, True)}
    index.append_new(exact_dedup.digests(first))  # as after a lost driver: nothing new
    assert index.entries().count() == 2
    second = spark.createDataFrame([(9, "a"), (10, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_dedup(second, index).collect()} == {(9, 2, False), (10, 10, True)}
    assert exact_dedup.exact_dedup(second.limit(0), index).count() == 0


def test_fingerprints(spark, docs):
    df, own = docs
    order = sorted(own)
    found = {r.doc_id: r for r in fingerprints.compare_with_next(df, scale=2, ranges=5).collect()}
    assert len(found) == len(own)
    by_text = {}
    for i, after in zip(order, order[1:] + order[:1]):
        text, ahead = own[i] or "", own[after] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + ahead[:q]
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, found[i].fingerprint) == found[i].fingerprint
        a, b, c = ({x.fingerprint[k : k + 16] for k in range(0, len(x.fingerprint), 16)} for x in (found[i], found[after], found[i]))
        e = {found[i].edited_fingerprint[k : k + 16] for k in range(0, len(found[i].edited_fingerprint), 16)}
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert found[i].near_next == pytest.approx(like(a, b)) and found[i].near_edited == pytest.approx(like(a, e))
        assert bool(a) == bool(WORD.search(text))
    assert fingerprints.compare_with_next(df.limit(0), ranges=3).count() == 0
    tied = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q"), (2, None)], "doc_id long, text string")
    assert fingerprints.compare_with_next(tied, ranges=2).count() == 4


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_successors_of_crowded_ids(spark, ranges, monkeypatch):
    """A third of all rows under one id or none, with unlike and with equal texts; each text's successor by brute force."""
    monkeypatch.setattr("siltstone.llm.fingerprints.BLOCK", 7)
    texts = [f"text {i} of many words that are not alike {i * i}" for i in range(90)]
    rows = [(None, t) for t in texts[:30]] + [(5, t) for t in texts[30:60]] + [(6 + i % 20, t) for i, t in enumerate(texts[60:])]
    rows += [(7, "the same text again and again and again")] * 40 + [(None, None)] * 3 + [(None, "")] * 2 + [(-(2**63), "lowest")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, block int").repartition(5)
    digest = {r.text: r.x for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x")).collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], digest[r[1]], r[1] or ""))
    want = []
    for (i, text), (_, ahead) in zip(order, order[1:] + order[:1]):
        text, ahead = text or "", ahead or ""
        q = len(text) // 4
        want.append((i, len(text), hashlib.sha256((text[: len(text) - q] + ahead[:q]).encode()).hexdigest()))
    found = fingerprints.compare_with_next(df, ranges=ranges).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_short_sketches_merge(spark):
    texts = [f"only one shingle of {i}" for i in range(40)]
    rows = spark.createDataFrame([(a, b, f"{a} {b}") for a, b in zip(texts, texts[1:])], "a string, b string, c string")
    rows = rows.select(*[fingerprints.sketch(x, words=5).alias(x) for x in "ab"])
    for r in rows.select("a", "b", fingerprints.merged("a", "b").alias("m")).collect():
        both = sorted({*r.a, *r.b})
        below = [x for x in both if 0 <= x < 2**64 // fingerprints.SCALE]
        assert r.m == (below or both[:1])


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    rows = spark.createDataFrame([(" ".join(words), " ".join(words[:2000]), " ".join(words[2000:]))], "a string, b string, c string")
    rows = rows.select(*[fingerprints.sketch(x).alias(x) for x in "abc"])
    r = rows.select(fingerprints.likeness("a", "b").alias("like"), fingerprints.containment("b", "a").alias("within"), "a", fingerprints.merged("b", "c").alias("merged")).first()
    assert abs(r.like - 1 / 3) < 0.05 and r.within == 1.0
    assert len(set(r.a) ^ set(r.merged)) <= 4 and set(r.merged) <= set(r.a)  # but for shingles across the cut


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for trial in range(300):
        text = np.append(rng.integers(1, rng.integers(2, 5), rng.integers(1, 60)), 0)
        order = suffix_array(text, 6)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        shared = common_prefixes(text, order)
        for a, b in zip(order[:-1], order[1:]):
            n = next(k for k in range(len(text)) if max(a, b) + k >= len(text) or text[a + k] != text[b + k])
            assert shared[b] == n


def removed(tokens_by_id, window):
    seen, gone = set(), {}
    for i in sorted(tokens_by_id):
        t = tokens_by_id[i]
        mark = [False] * len(t)
        for s in range(len(t) - window + 1):
            part = tuple(t[s : s + window])
            if part in seen:
                mark[s : s + window] = [True] * window
            seen.add(part)
        gone[i] = mark
    return gone


def test_substring_dedup(spark, docs):
    df, own = docs
    tokens = {i: WORD.findall(t or "") for i, t in own.items()}
    gone = removed(tokens, 20)
    for r in substring_dedup.dedup_substrings(df).collect():
        kept = [w for w, g in zip(tokens[r.doc_id], gone[r.doc_id]) if not g]
        assert (r.n_words, r.n_removed, r.kept) == (len(tokens[r.doc_id]), sum(gone[r.doc_id]), " ".join(kept))
    twice = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(df.union(df)).collect()}
    assert twice == {i: sum(g) for i, g in gone.items()}
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0


@pytest.mark.parametrize("names", [300, 5_000, 200_000])
def test_suffix_arrays_of_many_names(names, monkeypatch):
    """Texts of so many symbols that names are written in digits, and deeper levels that need them too."""
    rng = np.random.default_rng(names)
    text = np.concatenate((rng.integers(1, names, 800), np.tile(rng.integers(1, names, 40), 10), rng.integers(1, 4, 200), [0]))
    as_list = text.tolist()
    want = sorted(range(len(text)), key=lambda i: as_list[i:])
    assert suffix_array(text, names).tolist() == want
    monkeypatch.setattr("siltstone.llm.suffix_array.SHORT", 1)
    assert suffix_array(text, names).tolist() == want
    monkeypatch.setattr("siltstone.llm.suffix_array.DIGIT", 4)
    assert suffix_array(text, names).tolist() == want


@pytest.mark.parametrize("short", [1, 16, 1 << 16])
def test_suffix_arrays_of_few_bytes(short, monkeypatch):
    """Short texts of great symbols, with the recursion ending early and late."""
    monkeypatch.setattr("siltstone.llm.suffix_array.SHORT", short)
    rng = np.random.default_rng(short)
    for trial in range(100):
        part = rng.integers(1, 257, rng.integers(1, 40))
        text = np.concatenate((part, rng.integers(1, 257, rng.integers(0, 9)), part[: rng.integers(0, len(part) + 1)], part, [0]))
        as_list = text.tolist()
        assert suffix_array(text, 257).tolist() == sorted(range(len(text)), key=lambda i: as_list[i:])


def test_suffix_array_of_text():
    text = np.frombuffer((" ".join(x or "" for x in corpus(5, 120))).encode() + b"\0", np.uint8)
    order = suffix_array(text, 256)
    data = text.tobytes()
    assert sorted(order.tolist()) == list(range(len(text)))
    shared = common_prefixes(text, order)[order[1:]].tolist()
    assert all(data[a : a + n] == data[b : b + n] and data[a + n : a + n + 1] < data[b + n : b + n + 1] for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), shared))


def test_suffix_arrays_take_little_memory():
    """The arrays of one level are gone when the next one needs as much again: 36 bytes a symbol (105 when they stayed)."""
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 30, 1 << 18).astype(np.uint8), 0)
    tracemalloc.start()
    try:
        suffix_array(text, 30)
        assert tracemalloc.get_traced_memory()[1] < 80 * len(text)
    finally:
        tracemalloc.stop()


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_workers_give_back_what_a_task_took():
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    pins = []

    def work(batches):
        for batch in batches:
            held = [bytearray(50_000) for _ in range(4_000)]
            pins.append(bytes(50_000))  # above all others, so that the heap can't shrink from its end
            yield batch.assign(n=len(held))

    before = resident()
    assert [b["n"].item() for b in trimmed(work)(iter([pd.DataFrame({"a": [1]})] * 2))] == [4_000, 4_000]
    assert resident() - before < 100 << 20


@pytest.mark.parametrize("dedup", [suffix_dedup.dedup_bytes, substring_dedup.dedup_substrings])
def test_texts_are_looked_at_where_they_lie(spark, docs, dedup, monkeypatch):
    """No Python worker packs texts for a second one in the same task."""
    plans, found = [], repeats.repeated_places

    def places(segments, *more, **named):
        plans.append(segments._jdf.queryExecution().optimizedPlan().toString())
        return found(segments, *more, **named)

    monkeypatch.setattr(repeats, "repeated_places", places)
    assert dedup(docs[0]).count() == len(docs[1])
    assert len(plans) > 1 and not any("MapInPandas" in p for p in plans)


@pytest.mark.parametrize("common", [suffix_dedup.COMMON, 3])
def test_suffix_dedup(spark, docs, common):
    df, own = docs
    tokens = {i: (t or "").encode() for i, t in own.items()}
    gone = removed(tokens, 100)
    for r in suffix_dedup.dedup_bytes(df, common=common).collect():
        mark = gone[r.doc_id]
        kept = bytes(b for b, g in zip(tokens[r.doc_id], mark) if not g)
        spans = sum(1 for k, g in enumerate(mark) if g and (k == 0 or not mark[k - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(mark), sum(mark), spans, kept), r.doc_id
    assert suffix_dedup.dedup_bytes(df.limit(0)).count() == 0


def test_suffix_dedup_of_short_texts_of_great_bytes(spark):
    """So few bytes in a shard that some of them are greater than its length."""
    rng = random.Random(8)
    for trial in range(3):
        passage = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(34))
        texts = {1: passage + "а", 2: "б" + passage, 3: "я" + passage[:33]}
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        gone = removed({i: t.encode() for i, t in texts.items()}, 100)
        for r in suffix_dedup.dedup_bytes(df).collect():
            kept = bytes(b for b, g in zip(texts[r.doc_id].encode(), gone[r.doc_id]) if not g)
            assert (r.n_removed, bytes(r.kept)) == (sum(gone[r.doc_id]), kept)


def test_null_ids_come_first(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(None, text), (5, text + " more"), (5, text + " more")], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.dedup_substrings(rows).collect()} == {(None, 0), (5, 50)}
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup.dedup_bytes(rows).collect()} == {(None, 0), (5, len(text))}


def test_rows_of_one_id_with_unlike_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    alone, shared, passage = ([word() for _ in range(n)] for n in (60, 50, 40))
    low = -(2**62)
    rows = [(low, shared), (5, shared), (5, alone), (5, alone), (7, alone[:30] + passage), (None, passage + alone[:5]), (None, alone[30:] + passage), (None, shared[:25]), (2**60, passage[:25]), (2**60 + 1, passage[5:])]
    rows += [(i, [word() for _ in range(30)]) for i in range(10, 40)]
    texts = [(i, " ".join(w)) for i, w in rows]
    order = {(i is not None, i or 0, hashlib.sha256(t.encode()).digest()): (i, t) for i, t in texts}
    names = {order[k]: n for n, k in enumerate(sorted(order))}  # rows of one id and text are one document
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)

    gone = removed({n: t.split(" ") for (_, t), n in names.items()}, 20)
    wanted = [(i, len(t.split()), sum(gone[names[i, t]]), " ".join(w for w, g in zip(t.split(), gone[names[i, t]]) if not g)) for i, t in texts]
    assert sorted(map(repr, substring_dedup.dedup_substrings(table).collect())) == sorted(f"Row(doc_id={i!r}, n_words={n}, n_removed={r}, kept={k!r})" for i, n, r, k in wanted)

    gone = removed({n: t.encode() for (_, t), n in names.items()}, 100)
    wanted = [(i, len(t), bytes(b for b, g in zip(t.encode(), gone[names[i, t]]) if not g)) for i, t in texts]
    assert sorted(((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.dedup_bytes(table).collect()), key=repr) == sorted(wanted, key=repr)


def brute_fingerprint(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, most=3):
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = root[i], root[j]
                if a != b:
                    root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return root


def test_simhash(spark, docs):
    df, own = docs
    fps = {i: brute_fingerprint(t) for i, t in own.items()}
    want = brute_components(sorted(own), fps)
    found = simhash.near_duplicates(df).collect()
    assert {r.doc_id: r.fp % 2**64 for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", [simhash.PART, 4])
def test_near_links_of_crowded_fingerprints(spark, part):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(40)} | {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    roots = {r.node % 2**64: r.root % 2**64 for r in components(simhash.near_links(df, part=part)).collect()}
    want = brute_components(range(len(fps)), fps)
    groups = {}
    for k, f in enumerate(fps):
        groups.setdefault(want[k], set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


@pytest.mark.parametrize("most", [1, 3, 4])
def test_block_masks_miss_no_pair(most):
    masks = simhash.block_masks(most)
    assert len(masks) == most + 1 and sum(m % 2**64 for m in masks) == 2**64 - 1
    rng = random.Random(most)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), most))
        assert any(flips & (m % 2**64) == 0 for m in masks)


@pytest.mark.parametrize("seed", range(4))
def test_gray_index_finds_all_pairs_of_a_group(seed):
    rng = np.random.default_rng(seed)
    bits = 14 if seed % 2 else 64  # crowded, or spread out with planted pairs
    fp = rng.integers(0, 2**bits - 1, 700, dtype=np.uint64, endpoint=True)
    fp[350:] = fp[:350] ^ (np.uint64(1) << rng.integers(0, bits, 350).astype(np.uint64))
    group = rng.integers(0, 3, 700)
    group[350:] = group[:350]
    index = simhash.GrayIndex(group, fp)
    where = {(int(g), int(f)) for g, f in zip(group, fp)}
    want = {(g, min(f, h), max(f, h)) for g, f in where for g2, h in where if g == g2 and f != h and (f ^ h).bit_count() <= 3}
    owner = {}
    for g, f in where:
        owner.setdefault(f, set()).add(g)
    found = {(min(int(index.fp[a]), int(index.fp[b])), max(int(index.fp[a]), int(index.fp[b]))) for x, y in index.near(3) for a, b in zip(x, y)}
    assert found == {(f, h) for _, f, h in want}


def test_gray_order_saves_work():
    """Neighbours in Gray order share more bits than neighbours by value, so more pairs of nodes are dropped early."""
    work = {}
    for gray in (True, False):
        work[gray] = 0
        for seed in range(5):
            fp = np.random.default_rng(seed).integers(0, 2**48, 4096, dtype=np.uint64)
            visited = []
            pairs = sum(len(a) for a, _ in simhash.GrayIndex(np.zeros(4096, np.int64), fp, gray).near(3, visited))
            work[gray] += sum(visited)
            assert pairs >= 0 and (not gray or sum(visited) < 4096 * 4097 // 4)
    assert work[True] < 0.95 * work[False], work


def test_gray_order_in_sql(spark):
    fps = [0, 1, 2**63, 2**64 - 1, *(random.Random(3).getrandbits(64) for _ in range(50))]
    rows = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long").select("fp", simhash.gray_order("fp").alias("g")).collect()
    rank = simhash.gray_rank(np.array(fps, np.uint64))
    assert [r.g + 2**63 for r in rows] == rank.tolist()


def test_mix(spark, docs):
    df, own = docs
    found = {r.doc_id: r for r in mixing.mix(df).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(2)).collect()}
    assert len(found) == len(own) and again == {i: r.taken for i, r in found.items()}
    sources = {i: r.source for i, r in ((r.doc_id, r) for r in df.collect())}
    names = sorted({s for s in sources.values() if s is not None}) + [None]
    sizes = {s: sum(len(WORD.findall(own[i] or "")) for i in own if sources[i] == s) for s in names}
    goal = mixing.targets({str(s): sizes[s] for s in names}, {str(s): (3, 1, 2)[k % 3] for k, s in enumerate(names)})
    for s in names:
        rows = [found[i] for i in own if sources[i] == s]
        assert {(r.source_size, r.target) for r in rows} == {(sizes[s], float(goal[str(s)]))}
        assert abs(sum(r.taken for r in rows) - goal[str(s)]) <= max(r.size for r in rows)
        assert all(r.taken <= 2 * r.size and r.size == len(WORD.findall(own[r.doc_id] or "")) for r in rows)
    taken = mixing.take(df)
    assert taken.columns == df.columns
    counts = {}
    for r in taken.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {i: r.copies for i, r in found.items() if r.copies}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.take(df.limit(0)).count() == 0


def test_targets_share_out_what_is_above_the_cap():
    goal = mixing.targets({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2})
    assert goal == {"a": 20, "b": Fraction(295, 3), "c": Fraction(590, 3)}
    assert sum(goal.values()) == 315
    assert mixing.targets({"a": 0}, {"a": 3}) == {"a": 0} and mixing.targets({}, {}) == {}


def test_nested_budgets(spark):
    rows = spark.createDataFrame([(i, " ".join(["w"] * (i % 9)), "s") for i in range(400)], "doc_id long, text string, source string")
    small, large = ({r.doc_id for r in mixing.mix(rows, share=Fraction(x, 10), weights=(1,)).collect() if r.taken} for x in (3, 7))
    assert small < large


def test_language(spark):
    rng = random.Random(1)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(i, " ".join("".join(rng.choices(letters[x], k=5)) for _ in range(rng.randint(3, 40))), x) for i, x in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", None), (903, "abcd " * 200_000, None), (None, "vwxyz", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", langid.F.lit(5))
    model = langid.train(df)
    found = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert len(found) == len(rows)
    assert all(found[i].lang_pred == x for i, _, x in rows[:120])
    assert [found[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[900].score == 0
    kept = langid.accept(df, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == len(rows) - 3
    empty = df.limit(0)
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.train(empty)).collect()} == {"und"}


def test_language_pieces_count_each_gram_once(monkeypatch):
    text = "".join(random.Random(2).choices("abc é", k=5000))
    logs = np.random.default_rng(1).random((1 << langid.BITS, 2)).astype(np.float32)
    whole = langid.score_texts([text], ["a", "b"], logs, np.zeros(2))
    monkeypatch.setattr(langid, "PIECE", 64)
    again = langid.score_texts([text], ["a", "b"], logs, np.zeros(2))
    assert again[0] == whole[0] and again[1] == pytest.approx(whole[1])


def test_language_against_plain_naive_bayes(spark):
    """Word by word counting, with n-grams told apart by themselves: the same predictions, but for hash collisions, and scores."""
    rng = random.Random(8)
    pools = {"aa": "abcdefg", "bb": "defghij", "cc": "ghijklma"}
    rows = [(i, " ".join("".join(rng.choices(pools[x], k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12))), x) for i, x in enumerate(rng.choices(list(pools), weights=(6, 3, 1), k=300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        padded = f" {text.lower()} "
        return [padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)]

    learned = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    langs = sorted(pools)
    counts = {x: Counter(g for t, y in learned if y == x for g in grams(t)) for x in langs}
    prior = {x: math.log(sum(y == x for _, y in learned) / len(learned)) for x in langs}
    size = {x: sum(counts[x].values()) + langid.SMOOTHING * 2**langid.BITS for x in langs}
    found = {r.doc_id: r for r in langid.identify(df, langid.train(df)).collect()}
    same, close = [], []
    for i, t, _ in rows:
        own = grams(t)
        total = {x: prior[x] + sum(math.log((counts[x][g] + langid.SMOOTHING) / size[x]) for g in own) for x in langs}
        best = max(langs, key=total.get)
        odds = [math.exp((total[x] - total[best]) * min(len(own), langid.EVIDENCE) / len(own)) for x in langs]
        same.append(found[i].lang_pred == best)
        close.append(abs(found[i].score - 1 / sum(odds)) < 0.02)
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert sum(same) >= 0.99 * len(rows) and sum(close) >= 0.9 * len(rows)


@pytest.mark.parametrize("text", ["½ ² ①", "Ⅷ 12", "_ - !", "١٢٣"])
def test_texts_without_a_letter(spark, text):
    rows = [(i, "abc def", "aa") for i in range(20)] + [(50, text, None), (51, text + " ª", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.train(df)).collect()}
    assert found[50] == ("und", 0.0) and found[51][0] == "aa"  # an ordinal indicator is a letter


@pytest.mark.parametrize("count", [10, 10**6, 10**12, 10**17])
def test_samples_neither_vanish_nor_grow(count):
    limit = below(count, 4_000)
    assert limit is None if count <= 4_000 else abs((limit + 2**63) * count / 2**64 / 4_000 - 1) < 0.01 and limit > -(2**63)


def test_samples_hold_a_hot_row_once(spark):
    rows = spark.createDataFrame([(7, "hot", "aa")] * 300 + [(i, f"t{i}", "aa") for i in range(600)], "doc_id long, text string, lang string")
    found = sampled(rows, 900, 90, "doc_id", "text").collect()
    assert 50 <= len(found) <= 140 and len({(r.doc_id, r.text) for r in found}) == len(found)


def test_learning_more_than_the_bounds(spark):
    rows = [(i, "fine words here and there " * 3 if i % 2 else "BAD!! STUFF%% 99 " * 3, "aa" if i % 2 else "bb") for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:1] * 400, "doc_id long, text string, lang string")
    model = langid.train(docs, max_docs=60)
    assert model[0] == ["aa", "bb"] and {r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in langid.identify(docs, model).collect()} == {True}
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, 1)] * 400, "doc_id long, quality int")
    model = quality.train(docs, labels, max_labelled=60)
    assert 20 <= len(model.labels) <= 60 and {r.predicted == r.doc_id % 2 for r in quality.classify(docs, model).collect()} == {True}


def test_one_document_of_a_group_stays(spark):
    t, u = "some text of a few words", "quite another text of other words here"
    rows = spark.createDataFrame([(1, t, "x"), (None, t, "y"), (None, u, "z"), (1, u, "p"), (1, u, "q")], "doc_id long, text string, doc string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(rows).collect()) == sorted([(1, t), (1, u)])
    alone = rows.filter("doc_id IS NULL")
    assert sorted(r.doc for r in simhash.keep_one(alone).collect()) == ["y", "z"]
    cased = spark.createDataFrame([(3, "A b", "x"), (3, "a b", "y"), (3, "a b", "z"), (2, "a B", "w")], "doc_id long, text string, doc string")
    for keep in (lambda d: simhash.keep_one(d), lambda d: exact_dedup.keep_one(d, exact_dedup.fresh_index(spark, 2))):
        first, again = keep(cased).collect(), keep(cased.repartition(3)).collect()
        assert len(first) == 1 and first == again


def test_tables_are_removed(spark, docs):
    made = store(spark.range(5).toDF("a"), "some")
    path = Path(made.stored_at.removeprefix("file:"))
    assert path.is_dir() and made.count() == 5
    release(made, None)
    assert not path.exists()


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")
        small_batches(spark)
        assert spark.conf.get(key) == "7"
        spark.conf.set(key, "0")  # without bound
        small_batches(spark)
        assert spark.conf.get(key) == "512"
    finally:
        spark.conf.set(key, old)


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.98 * found.count()


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rows = quality.classify(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = rows[rows.quality == 1].score.to_numpy(), rows[rows.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() >= 0.85  # area under the curve


def test_quality_edges(spark):
    rows = [(i, "fine words here " * 5 if i % 2 else "BAD!! STUFF%% " * 5) for i in range(60)] + [(100, None), (101, ""), (None, "fine words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", quality.F.lit("s"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(100, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    found = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    assert len(found) == len(rows) and all(r.predicted == r.doc_id % 2 for i, r in found.items() if i is not None and i < 60)
    assert found[100].score == found[101].score == pytest.approx(model.prior)
    blank = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.classify(docs, blank).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0


def test_cosines_are_exact():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.02, (40, quality.FEATURES)).astype(np.float32)
    labels = rng.integers(0, 2, 40)
    model = quality.Model(counts, labels, 8)
    x = rng.poisson(0.02, (5, quality.FEATURES)).astype(np.float32)
    latent = np.log1p(x) * model.idf @ model.axes
    near = latent @ model.vectors.T / np.linalg.norm(latent, axis=1)[:, None]
    for k in range(5):
        top = np.argsort(-near[k])[: quality.NEIGHBOURS]
        w = np.maximum(near[k][top], 0) ** 2
        want = (w @ labels[top] + quality.PRIOR_VOTES * labels.mean()) / (w.sum() + quality.PRIOR_VOTES)
        assert model.score(x)[k] == pytest.approx(want, abs=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do.</div><div class="ad">Buy this, now!</div>
<article><h1>Head&amp;line</h1><p>First   para&shy;graph, with <b>bold<br>text</b>.<p>Second &lt;one&gt;, longer than the first.
<ul><li>Item one<li>Item two</ul><aside>Related</aside><form>Your mail <input></form><!-- <p>no</p> --></article>
<div id="comments"><p>Great post, thanks a lot, really!</p></div><footer>&copy; someone</footer>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain text, no markup"), (5, "x", "<p>" + "long text. " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", html_extract.F.lit("clash"))
    found = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()]
    main = "Head&line\nFirst para\xadgraph, with bold text.\nSecond <one>, longer than the first.\nItem one\nItem two"
    assert found[0] == found[1] == (1, main, len(main))
    assert found[2:5] == [(2, "", 0), (3, "", 0), (4, "plain text, no markup", 21)] and found[5][2] == 11 * 50_000 - 1
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_html_without_article():
    page = "<body><div id=nav><a href=x>Home</a> <a href=y>News</a></div><div class=post><h2>Title</h2><p>Some text, of a few words. It goes on.</p><p>Short.</p></div><div class=sidebar><p>Other, things.</p></div></body>"
    assert html_extract.extract(page) == "Title\nSome text, of a few words. It goes on.\nShort."


def test_html_links_in_an_article():
    links = "".join(f"<li><a href=/{i}>Part {i}</a>" for i in range(5))
    cells = "".join(f"<tr><td class=name><a href=/{i}>Name {i}</a><td>Value {i}, of some." for i in range(3))
    text = "Some text, of a few words. It goes on."
    page = f"<body><article><h1><a href=/t>Title</a></h1><p>{text}</p><ul>{links}</ul><table>{cells}</table></article></body>"
    rows = [x for i in range(3) for x in (f"Name {i}", f"Value {i}, of some.")]
    assert html_extract.extract(page).split("\n") == ["Title", text, *(f"Part {i}" for i in range(5)), *rows]
    assert html_extract.extract(f"<main><ul>{links}</ul></main>").split("\n") == [f"Part {i}" for i in range(5)]
    bare = f"<div class=post><h2><a href=/t>Title</a></h2><p>{text}</p><ul>{links}</ul></div>"
    assert html_extract.extract(bare) == f"Title\n{text}"  # a link list outside an article


def test_html_lead_beside_the_body():
    lead, text = "A lead of few words, which says what follows. It is short.", "Some text, of a few words. It goes on. " * 25
    parts = f"<div class=lead><p>{lead}</p></div><div class=body><p>{text}</p></div>"
    assert html_extract.extract(f"<body>{parts}</body>").split("\n") == [lead, text.strip()]
    assert html_extract.extract(f"<body><article>{parts}</article><div class=legal><p>{lead}</p></div>").split("\n") == [lead, text.strip()]
    two = f"<body><article><p>{text}</p></article><article class=brief><p>{lead}</p></article></body>"
    assert html_extract.extract(two).split("\n") == [text.strip(), lead]


@pytest.mark.parametrize("start", ["<article>", "<p>", "<img src=x>", "", "<b>", "</head>", "</head><body>", "<body>"])
def test_html_head_left_open(start):
    head = "<html><head>\n <title>T</title><meta name=a><link href=x>\n<style>p{}</style><script>1</script><noscript>No</noscript>\n"
    assert html_extract.extract(f"{head}{start}Some text, of a few words.") == "Some text, of a few words."


@pytest.mark.parametrize("anchor", ["<a name=top>", "<a href=#top>", "<p><a href=#top>Top"])
def test_html_anchor_left_open(anchor):
    text = "Some text, of a few words. It goes on."
    found = html_extract.extract(f"<body>{anchor}<div><p>{text}</p><p>{text}</p><a href=/n>Next</a></div></body>")
    assert found.split("\n")[:2] == [text, text]


def test_html_link_around_blocks():
    assert [n for *_, n in html_extract.blocks("<a href=/x><div>Card</div><p>More</p></a><p>Text</p>")[0]] == [4, 4, 0]


LONG_TEXT = "Some text, of a few words. It goes on, as texts do. " * 6


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class='layout with-sidebar'><article><h1>T</h1><p>{LONG_TEXT}</p></article></div>", ["T", LONG_TEXT.strip()]),
        (f"<div id=page class='site has-sidebar'><main><p>{LONG_TEXT}</p></main></div>", [LONG_TEXT.strip()]),
        (f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG_TEXT}</p></article>", ["Title", LONG_TEXT.strip()]),
        (f"<article><p>{LONG_TEXT}</p><section class='related-work'><h2>Work</h2><p>{LONG_TEXT}</p></section></article>", [LONG_TEXT.strip(), "Work", LONG_TEXT.strip()]),
        (f"<article><p>{LONG_TEXT}</p><div class=comments><p>Great, thanks.</p></div><div class=ad>Buy, now.</div></article>", [LONG_TEXT.strip()]),
        (f"<div class=ad>Buy this, now.</div><div class=post><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div><div class='post-comments'><p>Great, thanks.</p></div>", [LONG_TEXT.strip()] * 2),
        ("<div class=ad>Buy this, now. Buy that, then. Or both.</div><article><h1>Head.</h1><p>Short.</article>", ["Head.", "Short."]),
        (f"<div class='cookie-notice'>We use cookies.</div><div id=nav-wrap class=menu-holder><div><p>{LONG_TEXT}</p><p>Short.</p></div></div>", [LONG_TEXT.strip(), "Short."]),
    ],
)
def test_html_names_of_furniture_do_not_hide_articles(page, want):
    assert html_extract.extract(f"<html><body>{page}<footer>Foot, note.</footer></body></html>").split("\n") == want


def brute_weights(found):
    """Tag-path ratios, block by block."""
    out = {}
    paths = sorted({p for p, *_ in found})
    own = {p: [b for b in found if b[0] == p] for p in paths}
    text = {p: sum(len(t) - n for _, t, n in own[p]) / len(own[p]) for p in paths}
    points = {p: sum(len(re.findall("[.,;:!?…。，、；：！？]", t)) for _, t, _ in own[p]) / len(own[p]) for p in paths}
    for p in paths:
        smooth = []
        for ratio in (text, points):
            values = []
            for i, (q, *_) in enumerate(found):
                if q == p:
                    near = [(3 - abs(i - j), ratio[found[j][0]]) for j in range(i - 2, i + 3) if 0 <= j < len(found)]
                    values.append((ratio[p] + sum(w * r for w, r in near) / sum(w for w, _ in near)) / 2)
            smooth.append(sum(values) / len(values))
        share = sum(n for *_, n in own[p]) / sum(len(t) for _, t, _ in own[p])
        out[p] = smooth[0] * math.log(1 + smooth[1] + 0.5) * (1 - share)
    return [out[p] for p in paths]


def test_tag_path_ratios_against_brute_force():
    import pyarrow.parquet as pq

    pages = [PAGE, *pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()[:60]]
    for page in pages:
        found, _ = html_extract.blocks(page)
        _, of = np.unique([p for p, *_ in found], return_inverse=True)
        length, linked = (np.array([f(t, n) for _, t, n in found], float) for f in (lambda t, n: len(t), lambda t, n: n))
        marks = np.array([len(re.findall("[.,;:!?…。，、；：！？]", t)) for _, t, _ in found], float)
        assert html_extract.path_weights(of, length, marks, linked) == pytest.approx(brute_weights(found))


def test_tag_path_ratios_decide(monkeypatch):
    """Without them adverts and comments come in, on the test pages too."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    with_ratios = [html_extract.extract(p) for p in pages]
    monkeypatch.setattr(html_extract, "path_weights", lambda of, *_: np.full(of.max() + 1, 1e9))
    monkeypatch.setattr(html_extract, "SUSPECT_WEIGHT", 1)
    monkeypatch.setattr(html_extract, "MAIN_WEIGHT", 1)
    assert sum(a != html_extract.extract(p) for a, p in zip(with_ratios, pages)) > len(pages) / 2


@pytest.mark.parametrize("page", ["<div>word, of text. " * 100_000, "<p>a</b></i></q></li></ul>" * 40_000, "<li>x" * 60_000, "<div class=ad><span>x" * 30_000, "<a href=x>y" * 60_000])
def test_html_takes_linear_time(page):
    import time

    start = time.process_time()
    html_extract.extract(page)
    assert time.process_time() - start < 20


@pytest.mark.parametrize("page", ["<a" * 50_000, '<p "' * 20_000, "<div>" * 3_000 + "deep. text", "<" * 10_000, "&#x110000; &bogus; a &amp b", "a < b > c"])
def test_html_of_any_kind_ends(page):
    html_extract.extract(page)


def test_gram_hashes_depend_on_all_tokens():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 2**63, 50).astype(np.uint64)
    for k in (1, 5, 7, 10, 20, 32):
        grams = repeats.gram_hashes(tokens, k)
        assert len(grams) == 51 - k
        for at in range(50):
            other = tokens.copy()
            other[at] += np.uint64(1)
            assert set(np.flatnonzero(repeats.gram_hashes(other, k) != grams)) == set(range(max(0, at - k + 1), min(at, 50 - k) + 1))
