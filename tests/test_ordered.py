import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions import ordered as O


@pytest.fixture(scope="module")
def events(spark):
    """One key holds a third of the rows."""
    rng = random.Random(7)
    rows = [(f"k{rng.randrange(20)}" if rng.random() > 0.33 else "hot", i, rng.randrange(1000)) for i in range(3000)]
    return spark.createDataFrame(rows, "key string, id bigint, v int").repartition(5).cache()


def same(a, b):
    assert a.exceptAll(b.select(a.columns)).count() == 0
    assert b.select(a.columns).exceptAll(a).count() == 0


def test_ranked_equals_row_number(events):
    got = O.ranked(events, ["key"], [F.col("id")], O.id_bucket("id", 50), "r")
    same(got, events.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("id")).cast("bigint")))


def test_lagged_equals_lag(events):
    got = O.lagged(events, ["key"], [F.col("id")], O.id_bucket("id", 50), {"p": F.col("v")})
    same(got, events.withColumn("p", F.lag("v").over(W.partitionBy("key").orderBy("id"))))


def test_asof_equals_brute_force(spark, events):
    left = events.select("key", "id", F.col("v").alias("t"))
    right = events.filter("id % 7 = 0").groupBy("key", F.col("v").alias("at")).agg(F.max("id").alias("hit"))
    got = O.asof(left, right, ["key"], "t", "at", ["hit"], bucket=lambda c: F.floor(F.col(c) / 30))
    r = [(x["key"], x["at"], x["hit"]) for x in right.collect()]
    for row in got.collect():
        best = max(((at, hit) for k, at, hit in r if k == row["key"] and at <= row["t"]), default=(None, None))
        assert row["hit"] == best[1]
    assert got.count() == left.count()


def test_join_copies(events):
    groups = events.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    same(O.join_copies(events, groups, ["key"], "n"), events.join(groups.drop("n"), "key"))


@pytest.fixture(scope="module")
def holes(spark):
    """NULL keys, ids and times, ties, hashed ids and one hot key."""
    rng = random.Random(11)
    rows = []
    for i in range(800):
        key = rng.choice([None, "hot", "hot", "a", "b"])
        rows.append((key, None if i % 97 == 0 else hash((i, 7)) % 10**12, None if i % 31 == 0 else rng.randrange(60)))
    return spark.createDataFrame(rows, "key string, id bigint, v int").repartition(4).cache()


def test_ranked_and_lagged_keep_nulls(holes):
    order = [F.col("id"), F.col("v")]
    w = W.partitionBy("key").orderBy(*order)
    got = O.ranked(holes, ["key"], order, O.id_bucket("id", 10**11), "r")
    assert got.count() == holes.count()
    same(got.select("key", "id", "r"), holes.withColumn("r", F.row_number().over(w).cast("bigint")).select("key", "id", "r"))
    lagged = O.lagged(holes.filter("id is not null"), ["key"], order, O.id_bucket("id", 10**11), {"p": F.col("v")})
    same(lagged, holes.filter("id is not null").withColumn("p", F.lag("v").over(w)))


def test_asof_keeps_every_left_row(holes):
    left = holes.select("key", "id", F.col("v").alias("t"))
    right = holes.filter("v % 3 = 0 or v is null").select("key", F.col("v").alias("at"), F.col("id").alias("hit"))
    got = O.asof(left, right, ["key"], "t", "at", ["hit"], bucket=lambda c: F.floor(F.col(c) / 20)).collect()
    assert len(got) == left.count()
    r = [(x["key"], x["at"], x["hit"]) for x in right.collect() if x["key"] is not None and x["at"] is not None]
    for row in got:
        seen = [(at, hit is not None, hit) for k, at, hit in r if k == row["key"] and row["t"] is not None and at <= row["t"]]
        assert row["hit"] == (max(seen)[2] if seen else None)


@pytest.fixture(scope="module")
def hard(spark):
    """A hot key with hashed 64-bit ids, negative ones too, and a burst of times inside one hour."""
    rng = random.Random(13)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{i % 7}"
        ident = rng.randrange(-(2**63), 2**63)
        second = rng.randrange(3600) if i % 5 else rng.randrange(10**8)
        rows.append((key, ident, second))
    df = spark.createDataFrame(rows, "key string, id bigint, s int").repartition(4)
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-03-31 00:00:00' + make_dt_interval(0, 0, 0, s)")).cache()


def test_hashed_ids_and_bursts(hard):
    w = W.partitionBy("key")
    same(O.ranked(hard, ["key"], [F.col("id")], O.id_bucket("id"), "r"), hard.withColumn("r", F.row_number().over(w.orderBy("id")).cast("bigint")))
    order = [F.col("ts"), F.col("id")]
    got = O.lagged(hard, ["key"], order, O.time_bucket("ts"), {"p": F.col("id")})
    same(got, hard.withColumn("p", F.lag("id").over(w.orderBy(*order))))
    left, right = hard.filter("id % 2 = 0").select("key", "ts"), hard.filter("id % 2 <> 0").select("key", F.col("ts").alias("at"), "id")
    seen = O.asof(left, right, ["key"], "ts", "at", ["id"]).groupBy("key", "ts").agg(F.max("id").alias("id"))
    plain = left.distinct().join(right, "key", "left").groupBy("key", "ts").agg(F.max(F.when(F.col("at") <= F.col("ts"), F.struct("at", "id"))).alias("m"))
    same(seen, plain.select("key", "ts", "m.id"))


def test_no_window_holds_a_hot_key(hard):
    """Rows of a bucket, summary rows of a span and spans of a key: each far fewer than the key's rows."""
    hot = hard.filter("key = 'hot'")
    most = lambda df, *by: df.groupBy(*by).count().agg(F.max("count")).first()[0]
    for bucket in (O.id_bucket("id"), O.time_bucket("ts")):
        rows = hot.withColumn("b", bucket).withColumn("span", F.shiftright("b", O.SPAN_BITS))
        buckets = rows.select("span", "b").distinct()
        assert most(rows, "b") < 20 and rows.select("span").distinct().count() <= 2**O.SPAN_BITS
        assert buckets.select((F.col("b") - F.shiftleft("span", O.SPAN_BITS)).alias("x")).agg(F.min("x"), F.max("x")).first()[1] < 2**O.SPAN_BITS
    ids = hot.withColumn("span", F.shiftright(O.id_bucket("id"), O.SPAN_BITS))
    assert most(ids, "span") < 5
