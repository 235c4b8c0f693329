"""Mixing sources to target weights by nested hash thresholds, in DataFrame operations only.

Sources, ordered by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... and share 150 % of all words. A source's target
stops at twice its size; what it leaves is shared by the others by weight until none is above.

Each row has a hash. A source takes every row ``base`` times whole (once if its target reaches its size) and once more
each row whose hash is below a threshold. The threshold is found without sorting: words are summed by source
and hash bucket, the bucket in which the budget runs out is refined by the next bits of the hash, and
only that one, until all bits are used. The row at the threshold is taken in part, so that each source meets
its target to the word. Thresholds are nested: a larger target only adds rows.

Defined results: null or empty text: size 0, nothing to take; a null source is a source of its own; the hash is of the
doc_id (null: of the empty string), so rows that share it stand or fall together, and at the threshold share
what is left evenly, rounded down; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.llm.common import free_name, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and bits that one histogram resolves.
BITS, STEP = 60, 12


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_of(key: str = "doc_id") -> Column:
    digits = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Targets are min(cap, level * weight): sources are filled in the order of cap / weight, and the level
    follows from the caps before and the weights from there on.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.lit(SHARE) * F.sum("source_size").over(everything) - before) / onward
    levels = caps.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    # The level of the first source that stays below its cap holds for all from there on.
    first = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))).over(everything)
    filled = levels.withColumn("filled", first)
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("filled") * F.col("weight")), F.col("cap").cast("double"))
    return filled.select("source", "source_size", target.alias("target"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source_"])


#: What a source carries from one histogram to the next.
CARRIED = ("source_size", "target", "base", "rest")


def _boundary(sums: DataFrame) -> DataFrame:
    """Of each source's buckets (source_, bucket, words, n and CARRIED), the one in which the budget runs out.

    If all fit, the last one, with at least its words left.
    """
    upto = F.sum("words").over(W.partitionBy("source_").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    here = F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), "n")
    hit = F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), here)), F.max(here))
    return (
        sums.withColumn("upto", upto)
        .groupBy("source_")
        .agg(hit.alias("hit"), *[F.first(c).alias(c) for c in CARRIED[:-1]])
        .select("source_", *CARRIED[:-1], "hit.rest", F.col("hit.bucket").alias("threshold"), F.col("hit.n").alias("tied"))
    )


def thresholds(sized: DataFrame) -> DataFrame:
    """(source_, source_size, target, base, threshold, rest, tied) from rows (source, size, h)."""
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.round("target").cast("bigint")
    base = F.when(whole >= F.col("source_size"), 1).otherwise(0)
    goals = goals.withColumn("base", base).select(
        F.col("source").alias("source_"), "source_size", "target", "base", (whole - F.col("base") * F.col("source_size")).alias("rest")
    )
    measures = F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")
    coarse = sized.groupBy("source", F.shiftright("h", BITS - STEP).alias("bucket")).agg(*measures)
    cell = _boundary(coarse.join(goals, _same(coarse, goals)))
    for used in range(2 * STEP, BITS + 1, STEP):
        # Only rows of the boundary bucket; the bucket is part of the join key, so no source is one task.
        inside = sized.withColumn("up", F.shiftright("h", BITS - used + STEP))
        inside = inside.join(cell, _same(inside, cell) & (inside["up"] == cell["threshold"]))
        carried = [F.first(c).alias(c) for c in CARRIED]
        cell = _boundary(inside.groupBy("source_", F.shiftright("h", BITS - used).alias("bucket")).agg(*measures, *carried))
    return cell


def mixed(docs: DataFrame) -> DataFrame:
    """Per row: its words, its source's words and target, and the words taken, repeats counted."""
    sized = stored(docs.select("doc_id", "source", size_of().alias("size"), hash_of().alias("h")), "sizes")
    limits = thresholds(sized)
    return sized.join(limits, _same(sized, limits)).select("doc_id", "size", "source_size", "target", taken().alias("taken"))


def taken() -> Column:
    more = (
        F.when(F.col("h") < F.col("threshold"), F.col("size"))
        .when(F.col("h") == F.col("threshold"), F.least(F.col("size"), F.floor(F.col("rest") / F.greatest("tied", F.lit(1)))))
        .otherwise(0)
    )
    return (F.col("base") * F.col("size") + more).cast("bigint")


def mixture(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: rows as often as they are taken, the row at the threshold cut after its share of words.

    Columns are those of ``docs``; a cut text has one space between words, and ``n_chars``, where there is such a column, is its new length.
    """
    sized = stored(docs.select("source", size_of().alias("size"), hash_of().alias("h")), "sizes")
    columns = ("source_", "base", "threshold", "rest", "tied", "h", "words")
    name = {c: free_name(docs, f"_mix_{c}") for c in columns}
    col = {c: F.col(n) for c, n in name.items()}
    limits = stored(thresholds(sized), "thresholds").select([F.col(c).alias(name[c]) for c in columns[:5]])
    rows = docs.withColumn(name["h"], hash_of()).join(limits, docs["source"].eqNullSafe(col["source_"]))
    part = F.floor(col["rest"] / F.greatest(col["tied"], F.lit(1))).cast("int")
    below = F.when(col["h"] < col["threshold"], 1).otherwise(0)
    cut = F.when((col["h"] == col["threshold"]) & (part > 0), part)
    # One entry per row to emit: null for the whole text, else the number of its words.
    times = F.array_repeat(F.lit(None).cast("int"), (col["base"] + below).cast("int"))
    times = F.when(cut.isNull(), times).otherwise(F.concat(times, F.array(cut)))
    rows = rows.withColumn(name["words"], F.explode(times))
    shorter = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), col["words"]), " ")
    out = rows.withColumn("text", F.when(col["words"].isNull(), F.col("text")).otherwise(shorter))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(col["words"].isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
