"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL expressions only.

A sketch keeps every distinct 64-bit shingle hash below a fixed fraction of the hash range, whatever the
text's length. Sketches merge by union, and the shares of a sketch found in another estimate Jaccard
likeness and containment, also between texts of very unequal lengths.

Defined results: a null or empty text has an empty sketch; a text of fewer words than a shingle is one
shingle; where no hash falls below the threshold the smallest hash alone is kept, so that short texts
stay comparable; merging keeps it if the other text has none below the threshold either and a greater
smallest one. Two empty sketches are alike by 1, an empty and another by 0. Rows with equal ids follow
each other by the hash of their texts; a null id comes first. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import release, store, text_hash

#: Words in a shingle; one of SCALE hashes is kept.
WORDS = 5
SCALE = 4
#: Bytes of text in a range of documents, and the most ranges; beyond these, ranges grow and are sorted on disk.
RANGE_BYTES = 64 << 20
MOST_RANGES = 20_000
#: Repeated rows made from one row at once.
BLOCK = 10_000


def sketch(text: str, words: int = WORDS, scale: int = SCALE) -> Column:
    """The sorted array of the hashes kept from the text in the named column."""
    limit = 2**64 // scale  # hashes are signed: the lowest fraction of the range counts from 0 up
    if scale < 2:
        raise ValueError("scale must be 2 or more")
    shingle = ", ".join(f"w[i + {k}]" for k in range(words))
    return F.expr(rf"""
      transform(array(array_remove(split(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), '')), w ->
        transform(array(CASE WHEN size(w) = 0 THEN CAST(array() AS array<bigint>)
                             WHEN size(w) < {words} THEN array(xxhash64(array_join(w, ' ')))
                             ELSE transform(sequence(0, size(w) - {words}), i -> xxhash64({shingle})) END), s ->
          transform(array(filter(s, x -> x >= 0 AND x < {limit})), k ->
            IF(size(k) > 0 OR size(s) = 0, sort_array(array_distinct(k)), array(array_min(s))))[0])[0])[0]
    """)


def written(fingerprint: str) -> Column:
    """A sketch as text: 16 lowercase hex digits for each hash."""
    return F.expr(f"array_join(transform({fingerprint}, x -> lpad(lower(hex(x)), 16, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard likeness of two sketches, from 0 to 1."""
    common, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(common / both)


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: str, b: str, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    return F.expr(f"""
      transform(array(array_union({a}, {b})), u ->
        transform(array(filter(u, x -> x >= 0 AND x < {2**64 // scale})), k ->
          IF(size(k) > 0 OR size(u) = 0, sort_array(k), array(array_min(u))))[0])[0]
    """)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint (array of hashes)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), sketch("text", words, scale).alias("fingerprint"))


def _bounds(cuts: list[int]) -> list[tuple[int, int]]:
    """Where ranges begin, as (key, hash): a key that many cuts fall on is split as often, evenly by hash."""
    return sorted((key, -(2**63) + 2**64 * i // n) for key, n in Counter(cuts).items() for i in range(n))


def _bigint(value: int) -> str:
    """As a literal; the least value can't be written as one."""
    return f"{value}L" if value > -(2**63) else f"({value + 1}L - 1L)"


def _range_of(key: str, digest: str, bounds: list[tuple[int, int]]) -> Column:
    """How many bounds are at most the key and hash: a binary search, so thousands of ranges stay cheap."""
    if not bounds:
        return F.lit(0)
    keys, hashes = ("array(" + ", ".join(map(_bigint, values)) + ")" for values in zip(*bounds, strict=True))
    middle = "((a.lo + a.hi) div 2)"
    at = f"[CAST({middle} AS int)]"
    return F.expr(f"""
      CAST(aggregate(sequence(1, {len(bounds).bit_length() + 1}), named_struct('lo', 0L, 'hi', {len(bounds)}L),
        (a, x) -> CASE WHEN a.lo >= a.hi THEN a
                       WHEN {keys}{at} < {key} OR {keys}{at} = {key} AND {hashes}{at} <= {digest} THEN named_struct('lo', {middle} + 1L, 'hi', a.hi)
                       ELSE named_struct('lo', a.lo, 'hi', {middle}) END,
        a -> a.lo) AS int)""")


def _compared(rows: DataFrame, words: int, scale: int) -> DataFrame:
    """The result's columns, from (k, void, text, fp, next_text, next_fp) and any others, which stay."""
    edited = F.expr("concat(left(text, char_length(text) - char_length(text) div 4), left(next_text, char_length(text) div 4))")
    rows = rows.withColumns({"doc_id": F.when(~F.col("void"), F.col("k")), "n_chars": F.char_length("text").cast("long"), "edited": edited})
    rows = rows.drop("k", "void", "text", "next_text")
    rows = rows.withColumns({"edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "edited_fp": sketch("edited", words, scale)}).drop("edited")
    found = {
        "fingerprint": written("fp"),
        "edited_fingerprint": written("edited_fp"),
        "near_edited": likeness("fp", "edited_fp"),
        "near_next": likeness("fp", "next_fp"),
        "within_edited": containment("fp", "edited_fp"),
        "within_next": containment("fp", "next_fp"),
    }
    return rows.withColumns(found).drop("fp", "next_fp", "edited_fp")


def compare_with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, scale: int = SCALE, ranges: int | None = None
) -> DataFrame:
    """Sketch each text, the text with its last quarter replaced by the start of the next, and compare.

    Documents are dealt once, by ranges of (id, hash of the text) of about equal counts, so that an id that a
    third of all rows have is many ranges; a copy of each range's first document goes to the end of the range
    before, and one of the first document to the end of the last, so no document needs a second shuffle to
    meet its successor. Rows that repeat id and text are dealt as one: all but the last are followed by
    themselves. Besides the ranges' bounds, at most MOST_RANGES, nothing comes to the driver.
    """
    spark = docs.sparkSession
    number, own = F.col(id_col).cast("long"), ["k", "void", "x", "y"]
    base = docs.select(
        F.coalesce(number, F.lit(-(2**63))).alias("k"),
        number.isNull().alias("void"),
        text_hash(text_col).alias("x"),
        F.hash(F.coalesce(F.col(text_col), F.lit(""))).alias("y"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    keys = store(base.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("size")), "keys")
    total = keys.agg(F.sum("size").alias("size"), F.max("n").alias("n")).first()
    ranges = ranges or min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total.size or 0) // RANGE_BYTES)))
    points = [i / ranges for i in range(1, ranges)]
    bounds = _bounds(keys.agg(F.percentile_approx("k", points, max(10_000, 20 * ranges))).first()[0] or []) if points else []
    r = _range_of("k", "x", bounds)
    first = sorted(keys.groupBy(r.alias("r")).agg(F.min(F.struct("k", "x")).alias("least")).collect())
    starts = [f"({_bigint(row.least.k)}, {_bigint(row.least.x)}, {first[i - 1].r})" for i, row in enumerate(first)]  # the first one's goes to the last
    starts = spark.sql(f"SELECT * FROM VALUES {', '.join(starts or ['(0L, 0L, 0)'])} AS starts(k, x, r)")

    again = None
    if (total.n or 0) > 1:
        many = keys.filter("n > 1").select(*own, "n")
        again = base.join(many, own).groupBy(*own, "n").agg(F.first("text").alias("text"))
        base = base.join(many, own, "left_anti").unionByName(again.drop("n"))
    else:
        release(keys)
    # each side is sketched before the shuffle; the copies are as few as the ranges
    placed = base.withColumn("r", r).withColumn("copy", F.lit(False))
    rows = placed.unionByName(base.join(F.broadcast(starts), ["k", "x"]).withColumn("copy", F.lit(True))).drop("y").withColumn("fp", sketch("text", words, scale))
    rows = rows.repartitionById(len(bounds) + 1, "r")
    ahead = Window.partitionBy("r").orderBy("copy", "k", "x", "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(ahead), "next_fp": F.lead("fp").over(ahead)}).filter("NOT copy")
    found = _compared(rows.drop("r", "x", "copy"), words, scale)
    if again is not None:
        same = again.withColumn("fp", sketch("text", words, scale)).withColumns({"next_text": F.col("text"), "next_fp": F.col("fp")})
        same = _compared(same.drop("x", "y"), words, scale)
        blocks = same.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 2) div {BLOCK})"))).repartition("doc_id", "block")
        same = blocks.withColumn("i", F.explode(F.expr(f"sequence(1L, least({BLOCK}, n - 1 - block * {BLOCK}))")))
        found = found.unionByName(same.select(*found.columns))
    return found
