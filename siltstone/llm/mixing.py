"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a 64-bit hash. Sizes are summed by source and leading hash bits; the bucket in which a
source's running sum crosses its budget is refined by further bits until one hash is left in it. The
mix takes what lies below the threshold, so a larger budget's mix contains a smaller one's, nothing is
sorted, and reruns agree. Only one boundary row per source reaches the driver.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that
repeat id and text are taken or left together; an empty table gives an empty mix; a source whose texts
are all empty has target 0. Extra columns are ignored. The driver holds one row per source.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import store, word_count

#: Weights by rank of the source, repeating; the budget as a share of all sizes; the most repeats.
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
REPEATS = 2
#: Hash bits a round refines.
DIGIT = 12
#: A table of one row per source is broadcast up to so many sources, and joined as Spark sees fit beyond.
BROADCAST_SOURCES = 20_000


def _per_source(df: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(df) if sources <= BROADCAST_SOURCES else df


def targets(sizes: dict[str, int], weights: dict[str, int], share: Fraction = SHARE, repeats: int = REPEATS) -> dict[str, Fraction]:
    """Split share x all sizes by weight; what a source gets above repeats x its size is shared again."""
    left, out = share * sum(sizes.values()), {}
    open_ = set(sizes)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] >= repeats * sizes[s]}
        if not full:
            return out | {s: unit * weights[s] for s in open_}
        for s in full:
            out[s] = Fraction(repeats * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def _key_and_hash(id_col: str, text_col: str, source_col: str, seed: int) -> tuple[Column, Column]:
    source = F.col(source_col).cast("string")
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    return key, F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    skey, h = _key_and_hash(id_col, text_col, source_col, seed)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), skey.alias("skey"), word_count(text_col).alias("size"), h.alias("h"))


def thresholds(rows: DataFrame, budget: dict[str, Fraction]) -> dict[str, tuple[int, int]]:
    """For each source (shift, p): it takes the rows whose hash shifted right by shift is below p."""
    spark = rows.sparkSession
    open_ = {s: (None, 0) for s, b in budget.items() if b > 0}  # prefix reached, words below it
    found: dict[str, tuple[int, int]] = {}
    above, shift = 64, 64 - DIGIT
    while open_:
        state = spark.createDataFrame(
            [(s, p, int(acc), float(budget[s] - acc)) for s, (p, acc) in open_.items()], "skey string, prefix long, acc long, room double"
        )
        part = rows.join(_per_source(state, len(open_)), "skey")
        if above < 64:
            part = part.filter(F.shiftright("h", above) == F.col("prefix"))
        cell = part.groupBy("skey", F.shiftright("h", shift).alias("p")).agg(
            F.sum("size").alias("words"), (F.min("h") < F.max("h")).alias("more"), F.first("room").alias("room")
        )
        below = F.coalesce(F.sum("words").over(Window.partitionBy("skey").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = cell.withColumn("below", below).filter("below < room and below + words >= room")
        reached, open_ = open_, {}
        for r in edge.collect():
            acc = reached[r.skey][1] + r.below
            if r.more and shift > 0:
                open_[r.skey] = (r.p, acc)
                continue
            nearer = abs(acc + r.words - budget[r.skey]) < abs(budget[r.skey] - acc)
            found[r.skey] = (shift, r.p + bool(nearer))
        above, shift = shift, max(0, shift - DIGIT)
    return found


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: Fraction = SHARE,
    repeats: int = REPEATS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, skey, size, h; plan: a row per source with its size, target, whole copies and threshold)."""
    spark = docs.sparkSession
    rows = store(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    sizes = {r.skey: int(r.words) for r in rows.groupBy("skey").agg(F.sum("size").alias("words")).collect()}
    order = sorted(sizes, key=lambda s: (s[0] == "n", s))
    goal = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, share, repeats)
    base = {s: int(goal[s] // sizes[s]) if sizes[s] else 0 for s in order}
    cut = thresholds(rows, {s: goal[s] - base[s] * sizes[s] for s in order})
    plan = spark.createDataFrame(
        [(s, sizes[s], float(goal[s]), base[s], *cut.get(s, (0, None))) for s in order],
        "skey string, source_size long, target double, base int, shift int, cut long",
    )
    return rows, _per_source(plan, len(order))


def _copies() -> Column:
    return F.col("base") + F.coalesce(F.expr("shiftright(h, shift)") < F.col("cut"), F.lit(False)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken (copies x size).

    Every document is taken floor(target / source size) times, and those below the source's hash
    threshold once more; a source misses its target by at most half of one document's size.
    """
    rows, plan = mix_plan(docs, id_col, text_col, source_col, **options)
    taken = rows.join(plan, "skey").withColumn("copies", _copies())
    return taken.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mix itself: the input's rows, columns unchanged, each as often as it is taken.

    Only the plan is joined, so texts are not shuffled.
    """
    _, plan = mix_plan(docs, id_col, text_col, source_col, seed=seed, **options)
    own = {f: f"__mix_{f}" for f in ("skey", "h", "base", "shift", "cut")}
    skey, h = _key_and_hash(id_col, text_col, source_col, seed)
    plan = plan.select(*[F.col(c).alias(own[c]) for c in ("skey", "base", "shift", "cut")])  # keeps the broadcast hint
    rows = docs.withColumns({own["skey"]: skey, own["h"]: h}).join(plan, own["skey"])
    copies = F.col(own["base"]) + F.coalesce(F.expr(f"shiftright({own['h']}, {own['shift']})") < F.col(own["cut"]), F.lit(False)).cast("int")
    return rows.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), copies)).alias("__mix_copy")).drop("__mix_copy")
