"""Ordered operators for groups that may hold a large part of all rows.

A window over ``partitionBy(key)`` puts a whole key into one task. The functions here split every
key into order-preserving buckets and windows only inside them; what a bucket needs of all earlier ones of its key is one
summary row per bucket, scanned in two levels: inside spans of ``2^SPAN_BITS`` buckets, then over one row per span. ``bucket`` must be a
non-decreasing integer in the order, such as ``id_bucket`` or ``time_bucket``. For any 64-bit id, dense or hashed, no window holds more than
65 536 rows of a key in a bucket, ``2^24`` summary rows in a span, or ``2^24`` spans; for times, a bucket holds what one key gets in four seconds.
Results equal the plain window's, also for rows whose key or order is NULL: such rows form a group, and the first bucket, of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ID_BUCKET = 65_536
SPAN_BITS = 24


def id_bucket(c: Column | str, size: int = ID_BUCKET) -> Column:
    """Bucket of a unique integer: never more than ``size`` rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(size)).cast("bigint")


def time_bucket(c: Column | str) -> Column:
    """Four seconds of a time stamp without zone, since the epoch; needs no session time zone."""
    c = F.col(c) if isinstance(c, str) else c
    seconds = F.unix_date(F.to_date(c)).cast("bigint") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.shiftright(seconds, 2)


def hour_bucket(c: Column | str) -> Column:
    """Hours since the epoch of a time stamp without zone; needs no session time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_date(F.to_date(c)).cast("bigint") * 24 + F.hour(c)


def _back(rows: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names in which NULL equals NULL; ``side`` is unique on them."""
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    named = side.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in side.columns if c not in on])
    return rows.join(named, match, how).drop(*[f"_on_{c}" for c in on])


def _scan(summary: DataFrame, keys: Sequence[str], value: str, how: str) -> DataFrame:
    """(keys, _bucket, value): the sum, or the last that is not NULL, of ``value`` over all earlier buckets of a key.

    ``summary`` has one row per key and bucket.
    """
    keys = list(keys)
    fold = F.sum if how == "sum" else lambda c: F.last(c, ignorenulls=True)
    over = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    rows = summary.withColumn("_span", F.shiftright("_bucket", SPAN_BITS))
    inside = rows.withColumn("_near", fold(value).over(over(*keys, "_span").orderBy("_bucket"))).drop(value)
    whole = F.sum(value) if how == "sum" else F.max_by(value, F.when(F.col(value).isNotNull(), F.struct("_bucket")))
    spans = rows.groupBy(*keys, "_span").agg(whole.alias(value))
    far = spans.select(*keys, "_span", fold(value).over(over(*keys).orderBy("_span")).alias("_far"))
    near, away = F.col("_near"), F.col("_far")
    total = F.coalesce(near, F.lit(0)) + F.coalesce(away, F.lit(0)) if how == "sum" else F.coalesce(near, away)
    return _back(inside, far, [*keys, "_span"]).select(*keys, "_bucket", total.alias(value))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` as column ``name``."""
    keys = list(keys)
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        _back(rows.withColumn("_inside", inside), _scan(sizes, keys, "_before", "sum"), [*keys, "_bucket"])
        .withColumn(name, (F.col("_inside") + F.col("_before")).cast("bigint"))
        .drop("_bucket", "_inside", "_before")
    )


def lagged(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, values: dict[str, Column]
) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` for each named value."""
    keys = list(keys)
    value = F.struct(*[c.alias(n) for n, c in values.items()])
    rows = df.withColumn("_bucket", bucket)
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_carry"))
    inside = F.lag(value).over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    out = _back(rows.withColumn("_inside", inside), _scan(last, keys, "_carry", "last"), [*keys, "_bucket"])
    out = out.withColumn("_previous", F.coalesce("_inside", "_carry"))
    return out.withColumns({n: F.col("_previous")[n] for n in values}).drop(
        "_bucket", "_inside", "_carry", "_previous"
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    bucket=time_bucket,
) -> DataFrame:
    """Left rows with the values of the latest right row at or before their time (NULL if none).

    Both sides are merged into one stream per (key, bucket), so no pair of rows is ever produced. Every
    left row stays: a NULL key or time finds nothing. Of right rows with one time the largest values count.
    """
    keys = list(keys)
    payload = [c for c in left.columns if c not in keys]
    some = F.struct(*values)
    for c in [*keys, right_time]:
        right = right.filter(F.col(c).isNotNull())
    merged = left.select(
        *keys,
        F.col(left_time).alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*payload).alias("_row"),
        F.lit(None).cast(right.select(some.alias("v")).schema["v"].dataType).alias("_v"),
    ).unionByName(
        right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), some.alias("_v")),
        allowMissingColumns=True,
    ).withColumn("_bucket", bucket("_t"))
    last = (
        right.withColumn("_bucket", bucket(right_time))
        .groupBy(*keys, "_bucket")
        .agg(F.max_by(some, F.struct(F.col(right_time), some)).alias("_last"))
    )
    # Buckets that hold only left rows need a carry as well, so both sides name the buckets.
    buckets = merged.groupBy(*keys, "_bucket").agg(F.max(F.lit(1)).alias("_x")).drop("_x")
    carry = _scan(_back(buckets, last, [*keys, "_bucket"], "left").withColumnRenamed("_last", "_carry"), keys, "_carry", "last")
    upto = W.partitionBy(*keys, "_bucket").orderBy("_t", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    seen = merged.withColumn("_seen", F.last("_v", ignorenulls=True).over(upto)).filter(F.col("_side") == 1)
    return (
        _back(seen, carry, [*keys, "_bucket"])
        .withColumn("_hit", F.coalesce("_seen", "_carry"))
        .select(*keys, "_row.*", *[F.col("_hit")[v].alias(v) for v in values])
    )


def join_copies(rows: DataFrame, groups: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Left join of many rows to one row per group, where one group may own a third of the rows.

    ``groups`` is unique on ``keys``; NULL keys match NULL. It is a plain left join whose large side is the left
    one, so adaptive execution splits the partition of a heavy group. The result has no ``weight`` column.
    """
    return _back(rows, groups.drop(weight), list(keys), "left")
