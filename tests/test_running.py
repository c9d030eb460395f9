"""Counts as of a time, composite hot keys, Bloom filters."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.operators import graph, running, sampling
from feedlens.operators.membership import bloom_filter, maybe_member
from feedlens.operators.skew import salted_lookup


@pytest.mark.parametrize("per_range", [1_000_000, 40, 7])
def test_older_events_against_plain_count(spark, per_range):
    rng = random.Random(2)
    users = ["hot"] * 30 + [f"u{i}" for i in range(20)] + [None]
    events = [(rng.choice(users), rng.choice([None, *range(60)])) for _ in range(400)]
    asked = [(rng.choice(users), rng.choice([None, *range(-2, 63)])) for _ in range(300)]
    schema = "id string, at long"
    got = running.older_events(spark.createDataFrame(events, schema), spark.createDataFrame(asked, schema), ["id"], "at", per_range).collect()
    expected = {(u, t): sum(e[0] == u and e[1] is not None and e[1] < t for e in events) for u, t in asked if u is not None and t is not None}
    assert {(r["id"], r["at"]): r["older"] for r in got} == expected
    assert len(got) == len(expected)


def test_older_events_without_rows(spark):
    none = spark.createDataFrame([], "id string, at long")
    assert running.older_events(none, none, ["id"], "at").count() == 0


def test_ranges_share_a_hot_user(spark):
    marks = spark.createDataFrame([("hot", t) for t in range(1000)], "id string, at long")
    bounds = running.time_ranges(marks, "at", 1000, 100)
    sizes = Counter(r["range"] for r in running.with_range(marks, "at", bounds).collect())
    assert len(sizes) == 10 and max(sizes.values()) < 2 * 100


def test_degrees_as_of_sees_no_own_or_later_edge(table):
    like = "like_timestamp"
    df = table(
        {"tweet_id": "t1", "tweet_timestamp": 100, like: 110},
        {"tweet_id": "t2", "tweet_timestamp": 110, like: 120},  # the first like is not older
        {"tweet_id": "t3", "tweet_timestamp": 111, like: 5, "reply_timestamp": 130},  # dated before its tweet
        {"tweet_id": "t4", "tweet_timestamp": 200},
        {"tweet_id": "t5", "tweet_timestamp": None, like: 300},
        {"tweet_id": "t6", "tweet_timestamp": 500, "engaging_user_id": None, "engaged_with_user_id": "z"},
    )
    got = {r["tweet_id"]: (r["engaged_with_user_in_degree"], r["engaging_user_out_degree"]) for r in graph.degrees_as_of(df, graph.edges(df)).collect()}
    assert got == {"t1": (0, 0), "t2": (0, 0), "t3": (1, 1), "t4": (4, 4), "t5": (0, 0), "t6": (0, 0)}


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_composite_hot_keys(spark, how):
    rng = random.Random(4)
    rows = [(1, "hot", n) if n % 3 else (rng.choice([1, 2, None]), rng.choice(["a", "b", "hot", None]), n) for n in range(3000)]
    left = spark.createDataFrame(rows, "fold int, user string, n int")
    right = spark.createDataFrame([(1, "hot", 7), (2, "a", 8), (1, "b", 9), (None, "a", 1)], "fold int, user string, v int")
    salted = salted_lookup(left, right, ["fold", "user"], ["n"], how, piece_rows=200)
    assert sorted(map(str, salted.collect())) == sorted(map(str, left.join(right, ["fold", "user"], how).collect()))
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()


def test_largest_piece_of_a_hot_viewer(spark):
    rows = spark.range(30_000).select(F.lit(0).alias("fold"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("user"), "id")
    known = rows.select("fold", "user").distinct().withColumn("known", F.lit(True))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_lookup(rows, known, ["fold", "user"], ["id"], "left", 30_000, piece_rows=250)
        sizes = sorted(r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
        plain = sorted(r["n"] for r in rows.join(known, ["fold", "user"], "left").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == sum(plain) == 30_000
    assert sizes[-1] < 2 * sizes[len(sizes) // 2] and plain[-1] > 2 * plain[1]


@pytest.mark.parametrize("most_bits", [1 << 26, 1 << 15])
def test_bloom_filter_misses_no_member(spark, most_bits):
    keys = spark.range(20_000).select((F.col("id") % 5).alias("fold"), F.concat(F.lit("u"), "id").alias("user"))
    rows = spark.range(60_000).select((F.col("id") % 5).alias("fold"), F.concat(F.lit("u"), "id").alias("user"), "id")
    seen = rows.where(maybe_member(["fold", "user"], bloom_filter(keys, ["fold", "user"], most_bits)))
    counts = seen.agg(F.count_if(F.col("id") < 20_000), F.count_if(F.col("id") >= 20_000)).first()
    assert counts[0] == 20_000
    assert counts[1] < (6_000 if most_bits > 1 << 20 else 40_001)
    none = bloom_filter(keys.limit(0), ["fold", "user"])
    assert rows.where(maybe_member(["fold", "user"], none)).count() == 0


def test_folds_are_the_same_with_hot_viewers(interactions):
    plan = sampling.FoldPlan(split=893137754, train_rows=500, test_rows=300, extra_rows=20, folds=2)
    half = interactions.withColumn("engaging_user_id", F.when(F.pmod(F.xxhash64("tweet_id"), F.lit(3)) == 0, "hot").otherwise(F.col("engaging_user_id")))
    half = half.dropDuplicates(S.KEYS)
    plain, split = (sampling.build_folds(half, plan, **skew).test for skew in ({}, {"piece_rows": 20}))
    rows = [sorted(map(str, t.select("fold", *S.KEYS).collect())) for t in (plain, split)]
    assert rows[0] == rows[1] and len(rows[0]) > 100
