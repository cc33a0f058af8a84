"""Connected components of links too many for one machine, by contraction.

In each round every node takes the smallest node among itself and its neighbours, pointers are followed
twice, and links are renamed, so that at least each node with a smaller neighbour disappears. Rounds
are cut by tables in the shared folder. Joins read stored tables on both sides and thus leave adaptive
execution free to split a node that many others point to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import release, store


def components(links: DataFrame) -> DataFrame:
    """links: (a long, b long). Returns (node, root) for every node that has a link to another."""
    links = store(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    names = None
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        superseded = [links, names]
        parent = store(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "parent")
        for _ in range(2):
            further, old = parent.select(F.col("node").alias("root"), F.col("root").alias("top")), parent
            parent = store(parent.join(further, "root").select("node", F.col("top").alias("root")), "parent")
            release(old)
        if names is None:
            names = parent
        else:
            further = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            names = store(names.join(further, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "names")
        a, b = (parent.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
        half = store(links.join(a, "a").select("a_root", "b"), "moved")
        moved = half.join(b, "b").select("a_root", "b_root").filter("a_root != b_root")
        links = store(moved.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "links")
        release(*superseded, half, *([] if names is parent else [parent]))
    return names if names is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
