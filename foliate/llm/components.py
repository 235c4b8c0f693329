"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm.common import forget, stored


def _large(e: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node around."""
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge and is not the root, the smallest node, of its component.

    ``edges`` has two integer columns a and b. Each round rewrites the edges towards the smallest nodes and
    is written to the shared folder, so that lineage stays short; rounds grow with the logarithm of the longest path.
    They run while the plan is built, and each removes the edges of the one before.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    e = stored(e, "edges")
    seen = None
    while True:
        # the same edges as before: their number and two sums of 64-bit hashes
        mark = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20)")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())
        if mark == seen or not mark[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, before = mark, e
        e = stored(_small(_large(e)), "edges")
        forget(before)
