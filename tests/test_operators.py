import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions import columns as C
from feedlens.operators import filters, profile, projections, sampling, skew, splits
from feedlens.sources.durable import durable


def keys(df):
    return sorted((r["tweet_id"], r["engaging_user_id"]) for r in df.collect())


# -- projections and filters ------------------------------------------------


def test_targets_from_timestamps_and_from_flags(table):
    df = table({"like_timestamp": 9, "reply_timestamp": 3})
    row = projections.binarize_targets(df).first()
    assert (row["like"], row["reply"], row["retweet"], row["retweet_with_comment"]) == (True, True, False, False)
    flags = projections.labels_to_flags(df)
    assert flags.first()["retweet_timestamp"] == 0
    # every flag is non-null, so the plain test would call every row positive
    assert projections.binarize_targets(flags).first()["retweet"] is True
    row = projections.binarize_targets(flags, binarised=True).first()
    assert (row["like"], row["reply"], row["retweet"]) == (True, True, False)


def test_negatives_of_flagged_labels(table):
    flags = projections.labels_to_flags(table({"tweet_id": "n"}, {"tweet_id": "p", "like_timestamp": 1}))
    assert keys(filters.negatives(flags, binarised=True)) == [("n", "b")]
    assert keys(filters.positives(flags, binarised=True)) == [("p", "b")]
    assert keys(filters.engaged(flags, "like", binarised=True)) == [("p", "b")]
    assert profile.engagement_profile(flags, binarised=True).first()["negative_pct"] == 50.0


def test_zero_fill_keeps_the_schema(table):
    df = projections.zero_fill(table({"hashtags": "x"}), ["hashtags", "engaging_user_is_verified", "like_timestamp"])
    row = df.first()
    assert (row["hashtags"], row["engaging_user_is_verified"], row["like_timestamp"]) == ("0", False, 0)
    assert [f.dataType for f in df.schema] == [f.dataType for f in S.interaction_schema()]


def test_column_order_and_renames(table):
    df = table({})
    shuffled = df.select(*reversed(df.columns))
    assert projections.file_order(shuffled).columns == S.ALL_COLUMNS
    scores = df.select(*S.KEYS, *[F.lit(0.1).alias(t) for t in S.TARGET_NAMES])
    assert projections.prefix_predictions(scores).columns == [*S.KEYS, *["predicted_" + t for t in S.TARGET_NAMES]]


def test_interaction_rows(table):
    df = table({"reply_timestamp": 1, "like_timestamp": 4}, {}, {"retweet_with_comment_timestamp": 3})
    assert sorted(tuple(r) for r in projections.interaction_rows(df).collect()) == [(1, "reply"), (3, "rt_com"), (4, "like")]


def test_by_engagement_and_time_sides(table):
    df = table({"tweet_id": "1", "tweet_timestamp": 9, "like_timestamp": 1, "reply_timestamp": 1}, {"tweet_id": "2", "tweet_timestamp": 10}, {"tweet_id": "3", "tweet_timestamp": 11})
    assert sorted((r["tweet_id"], r["target"]) for r in filters.by_engagement(df).collect()) == [("1", "like"), ("1", "reply")]
    # the row exactly at the split belongs to neither side
    assert sorted((r["tweet_id"], r["side"]) for r in filters.by_time_side(df, 10).collect()) == [("1", "train"), ("3", "test")]
    assert keys(filters.before(df, 10)) == [("1", "b")] and keys(filters.after(df, 10)) == [("3", "b")]


def test_trailing_window_is_strict(table):
    df = table(*[{"tweet_id": str(t), "tweet_timestamp": t} for t in (100, 110, 120)])
    assert keys(filters.trailing_window(df, 10)) == [("120", "b")]
    assert keys(filters.trailing_window(df, 20, last=130)) == [("120", "b")]
    assert keys(filters.trailing_window(df, 21)) == [("100", "b"), ("110", "b"), ("120", "b")]


# -- profile ----------------------------------------------------------------


def test_profile_of_an_empty_table(table):
    row = profile.engagement_profile(table({}).where("false")).first()
    assert row["rows"] == 0 and row["like_pct"] is None


def test_hour_text_is_utc_in_any_session_zone(spark):
    seconds = [0, 3599, 3600, 1612396800, 1614211199, 951782399, 951782400, 4102444800]
    df = spark.createDataFrame([(s,) for s in seconds], "s bigint")
    found = df.select(C.day_hour_text(C.day_hour_code(F.col("s"))), C.hour_start(F.col("s"))).collect()
    expected = [datetime.datetime.fromtimestamp(s, datetime.timezone.utc).strftime("%d-%H") for s in seconds]
    assert [r[0] for r in found] == expected
    assert [r[1] for r in found] == [s // 3600 * 3600 for s in seconds]


def test_hourly_tables(table):
    day = 1612396800  # 04-00
    df = table({"like_timestamp": day}, {"like_timestamp": day + 5}, {"reply_timestamp": day + 3600}, {"like_timestamp": day + 31 * 86400})
    counts = profile.hourly_counts(df)
    assert sorted(tuple(r) for r in counts.collect()) == [("04-00", "like", 2), ("04-01", "reply", 1), ("07-00", "like", 1)]
    wide = {r["date"]: r.asDict() for r in profile.hourly_pivot(counts).collect()}
    assert wide["04-00"] == {"date": "04-00", "reply": None, "rt": None, "rt_com": None, "like": 2}
    assert tuple(profile.grid_completeness(counts, 21).first()) == (3, 2016, False)
    assert [tuple(r) for r in profile.top_hours(counts, 2).collect()] == [("04-00", "like", 2), ("04-01", "reply", 1)]
    assert [r["type"] for r in profile.series_by_type(counts).collect()] == ["like", "like", "reply"]
    assert profile.full_hour_counts(df).count() == 3


# -- sampling ---------------------------------------------------------------


def python_draw(row, fraction, seed):
    digest = hashlib.md5(f"{row[0]}|{row[1]}|{seed}".encode()).hexdigest()
    return int(digest[:8], 16) < fraction * 2**32


def test_hash_sample_equals_python_and_ignores_partitions(interactions):
    every = keys(interactions)
    for fraction, seed in ((0.1, 42), (0.5, 7), (0.0, 1), (1.0, 1), (2.0, 1), (1 / 2**32, 3)):
        expected = [k for k in every if python_draw(k, fraction, seed)]
        assert keys(sampling.hash_sample(interactions, fraction, seed)) == expected
    assert keys(sampling.hash_sample(interactions.repartition(13), 0.1, 42)) == keys(sampling.hash_sample(interactions.coalesce(1), 0.1, 42))


def test_bernoulli_sample_clamps_the_fraction(spark):
    df = spark.range(50)
    assert sampling.bernoulli_sample(df, 500).count() == 50
    assert 0 < sampling.bernoulli_sample(df, 20, 50, seed=1).count() < 50
    assert sampling.fraction_for(5, 0) == 1.0


def test_folds_equal_brute_force(interactions):
    plan = sampling.FoldPlan(split=893137754, train_rows=60, test_rows=300, extra_rows=100, folds=2)
    folds = sampling.build_folds(interactions, plan)
    rows = [(r["tweet_id"], r["engaging_user_id"], r["tweet_timestamp"]) for r in interactions.collect()]
    earlier = [r for r in rows if r[2] < plan.split]
    later = [r for r in rows if r[2] > plan.split]
    for fold in range(2):
        train = [r[:2] for r in earlier if python_draw(r, 60 / len(earlier), 42 + 153 + fold)]
        users = {r[1] for r in train}
        eligible = [r for r in later if r[1] in users]
        test = {r[:2] for r in eligible if python_draw(r, min(1, 300 / len(eligible)), 7357 + 153 + fold)}
        test |= {r[:2] for r in later if python_draw(r, 100 / len(later), 466 + 153 + fold)}
        found = folds.pair(fold)
        assert keys(found[0]) == sorted(train) and keys(found[1]) == sorted(test)
        assert any(u not in users for _, u in test)  # extra rows bring unseen users
        assert found[0].columns == S.ALL_COLUMNS


def test_folds_remove_duplicate_rows_and_skip_the_split_time(table):
    df = table(*[{"tweet_id": t, "tweet_timestamp": ts} for t, ts in (("a", 1), ("b", 5), ("c", 9), ("c", 9))])
    folds = sampling.build_folds(df, sampling.FoldPlan(split=5, folds=1))
    train, test = folds.pair(0)
    assert keys(train) == [("a", "b")] and keys(test) == [("c", "b")]


def test_folds_of_one_sided_data(table):
    folds = sampling.build_folds(table({"tweet_timestamp": 9}), sampling.FoldPlan(split=5, folds=2))
    assert folds.train.count() == 0 and folds.test.count() == 2  # the extra draw takes every row


def test_write_folds(spark, interactions, tmp_path):
    from feedlens.sources.readers import read_interactions

    plan = sampling.FoldPlan(split=893137754, train_rows=500, test_rows=200, extra_rows=20, folds=2)
    folds = sampling.build_folds(interactions, plan)
    written = sampling.write_folds(folds, plan, str(tmp_path))
    assert keys(read_interactions(spark, written[1][1])) == keys(folds.pair(1)[1])


def test_sample_generator(spark, interactions, tmp_path):
    spec = sampling.SampleSpec(binarise=True, zero_columns=("hashtags",), window=None, rows=1000)
    sample = sampling.generate_sample(interactions, spec)
    assert {r["hashtags"] for r in sample.collect()} == {"0"}
    assert dict(sample.dtypes)["like_timestamp"] == "int" and 800 < sample.count() < 1200
    path = sampling.export_sample(interactions, spec, str(tmp_path))
    assert path.endswith(f"sample_{1000 / interactions.count():.4f}")
    assert sorted(spark.read.parquet(path).collect(), key=str) == sorted(sample.collect(), key=str)


# -- splits -----------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 5, 7])
def test_positional_split_of_small_tables(table, n):
    df = table(*[{"tweet_id": f"t{i}"} for i in range(n)]) if n else table({}).where("false")
    train, test = splits.positional_split(df)
    assert [k for k, _ in keys(train)] == [f"t{i}" for i in range(int(n * 0.6))]
    assert [k for k, _ in keys(test)] == [f"t{i}" for i in range(int(n * 0.8), n)]


def test_positional_split_takes_the_exact_rows(interactions):
    ordered = keys(interactions)
    n = len(ordered)
    train, test = splits.positional_split(interactions.repartition(5))
    assert keys(train) == ordered[: int(n * 0.6)] and keys(test) == ordered[int(n * 0.8) :]


def test_positional_split_inside_a_hot_key(spark):
    rng = random.Random(5)
    ids = [f"k{rng.randrange(400):04d}" for _ in range(600)] + ["k0150"] * 400
    df = spark.createDataFrame([(i, "u", n) for n, i in enumerate(ids)], "tweet_id string, engaging_user_id string, n int").repartition(4)
    ids.sort()
    assert ids[400] == ids[500] == "k0150"
    for cut in (0.4, 0.5, 0.8):
        train, test = splits.positional_split(df, cut, cut)
        n = int(1000 * cut)
        assert sorted(r["tweet_id"] for r in train.collect()) == ids[:n] and sorted(r["tweet_id"] for r in test.collect()) == ids[n:]
        assert train.unionByName(test).distinct().count() == 1000


def test_equal_rows_stay_together(spark):
    df = spark.createDataFrame([("a", "u")] * 7 + [("b", "u")] * 3, "tweet_id string, engaging_user_id string")
    train, test = splits.positional_split(df, 0.5, 0.8)
    assert (train.count(), test.count()) == (0, 3)


def test_rows_with_missing_keys_come_last(spark):
    rows = [(None, "u"), ("a", None), ("a", "x"), ("b", "x"), (None, None)]
    df = spark.createDataFrame(rows, "tweet_id string, engaging_user_id string")
    ordered = [("a", "x"), ("a", None), ("b", "x"), (None, "u"), (None, None)]
    for cut in range(6):
        train, test = splits.positional_split(df, cut / 5, cut / 5)
        assert sorted(map(tuple, train.collect()), key=str) == sorted(ordered[:cut], key=str)
        assert sorted(map(tuple, test.collect()), key=str) == sorted(ordered[cut:], key=str)


def test_key_at_every_kind_of_position(spark):
    ids = sorted([f"k{i:04d}" for i in range(600)] + ["k0300"] * 400)
    df = spark.createDataFrame([(i, "u") for i in ids], "tweet_id string, engaging_user_id string").repartition(3)
    ranges = splits.key_ranges(df)
    positions = [0, 1, 449, 450, 500, 998, 999]
    assert ranges.rows == 1000
    assert ranges.at([*positions, 1000]) == {p: ((ids[p], "u"), p - ids.index(ids[p])) for p in positions}


def test_positions_are_narrowed_before_a_sort(spark, monkeypatch):
    """However many rows, one task sorts the keys of a small range only."""
    rng = random.Random(9)
    ids = [f"k{rng.randrange(2500):04d}" for _ in range(1500)] + ["k0700"] * 400 + ["k1900", None] * 90
    rows = [(i, rng.choice(["u", "v", None])) for i in ids]
    df = spark.createDataFrame(rows, "tweet_id string, engaging_user_id string").repartition(3).localCheckpoint()
    ordered = sorted(rows, key=lambda row: [(v is None, v or "") for v in row])
    sorts = []
    monkeypatch.setattr(splits, "ROWS_SORTED", 300)
    monkeypatch.setattr(splits, "KEYS_DRAWN", 200)
    plain = splits.KeyRanges._sorted

    def spy(ranges, range_, before, positions):
        sorts.append(ranges._within(range_).count())
        return plain(ranges, range_, before, positions)

    monkeypatch.setattr(splits.KeyRanges, "_sorted", spy)
    positions = [0, 1, 399, 640, 900, 1200, 1650, len(rows) - 100, len(rows) - 1]
    found = splits.key_ranges(df).at([*positions, len(rows)])
    assert found == {p: (ordered[p], p - ordered.index(ordered[p])) for p in positions}
    assert sorts and max(sorts) <= 300


def test_sort_puts_missing_keys_last(table):
    df = table({"tweet_id": None}, {"tweet_id": "b"}, {"tweet_id": "a", "engaging_user_id": None}, {"tweet_id": "a", "engaging_user_id": "z"})
    found = [(r["tweet_id"], r["engaging_user_id"]) for r in splits.sort_by_key(df).collect()]
    assert found == [("a", "z"), ("a", None), ("b", "b"), (None, "b")]


# -- skew -------------------------------------------------------------------


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_salted_lookup_equals_the_plain_join(spark, how):
    rng = random.Random(2)
    rows = [(("hot" if i % 3 == 0 else f"k{rng.randrange(60)}") if i % 50 else None, i) for i in range(900)]
    left = spark.createDataFrame(rows, "k string, v int")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, w int")
    plain = left.join(right, "k", how)
    salted = skew.salted_lookup(left, right, "k", ["v"], how, share=0.05, piece_rows=40)
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert salted.columns == plain.columns


def test_hot_key_is_spread_over_partitions(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        left = durable(spark.range(4000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS k", "id AS v"))
        right = durable(left.select("k").distinct().selectExpr("k", "length(k) AS w"))

        def largest(df):
            return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        plain = largest(left.join(right, "k", "left"))
        salted = largest(skew.salted_lookup(left, right, "k", ["v"], share=0.05, piece_rows=20))
        assert plain > 1900 and salted < 1300
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_number_of_hot_keys_is_bounded(spark):
    df = spark.range(1000).selectExpr("if(id < 5, null, cast(id % 5 AS string)) AS k")
    assert sorted(skew.hot_keys(df, "k", 1000, share=0.1)) == ["0", "1", "2", "3", "4"]
    assert skew.hot_keys(df, "k", 1000, share=0.2) == {}
    assert len(skew.hot_keys(df, "k", 1000, share=0.1, sample_rows=500)) == 5


def test_pieces_follow_the_rows_of_a_key(spark):
    left = spark.range(2000).selectExpr("if(id % 2 = 0, 'hot', concat('k', id)) AS k", "id AS v")
    right = spark.createDataFrame([("hot", 1)], "k string, w int")
    for piece_rows, pieces in ((100, 10), (250, 4), (1000, 1)):
        plan = skew.salted_lookup(left, right, "k", ["v"], "inner", share=0.05, piece_rows=piece_rows)
        assert plan.count() == 1000
        assert (f"map(hot, {pieces})" in plan._jdf.queryExecution().optimizedPlan().toString()) or pieces == 1 or f"{pieces}" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_a_wrong_list_of_hot_keys_changes_nothing(spark, monkeypatch):
    left = spark.range(300).selectExpr("concat('k', id % 30) AS k", "id AS v")
    right = spark.range(40).selectExpr("concat('k', id) AS k", "id AS w")
    expected = sorted(map(tuple, left.join(right, "k", "left").collect()))
    for hot in ({"k1": 50}, {"k1": 11, "k99": 500}, {f"k{i}": 45 for i in range(30)}):
        monkeypatch.setattr(skew, "hot_keys", lambda *args: hot)
        found = skew.salted_lookup(left, right, "k", ["v"], piece_rows=10)
        assert sorted(map(tuple, found.collect())) == expected
