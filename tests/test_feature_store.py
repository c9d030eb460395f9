import pytest
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.plans.feature_store import FeatureCache, FeatureStore, concat_features, row_contract
from feedlens.plans.registry import Registry
from feedlens.sources import paths


@pytest.fixture
def registry():
    r = Registry()
    r.calls = []

    @r.feature()
    def hour(raw_data, features, auxiliaries):
        r.calls.append("hour")
        return F.pmod(F.floor(raw_data["tweet_timestamp"] / 3600), F.lit(24))

    @r.feature()
    def pair(raw_data, features):  # older form without auxiliaries
        return {"late": features["hour"] > 11, "long_text": F.length("text_tokens") > 5}

    @r.feature(version="3")
    def keyed(raw_data, features, auxiliaries):
        r.calls.append("keyed")
        return raw_data.select(*S.KEYS, F.length("language").alias("language_length"))

    @r.feature()
    def wrong(raw_data, features, auxiliaries):
        return 5

    @r.feature()
    def keyless(raw_data, features, auxiliaries):
        return raw_data.select("language")

    @r.feature()
    def doubled(raw_data, features, auxiliaries):
        one = raw_data.select(*S.KEYS, F.lit(1).alias("one"))
        return one.unionByName(one)

    @r.feature()
    def widened(raw_data, features, auxiliaries):
        languages = raw_data.groupBy("language").agg(F.count(F.lit(1)).alias("language_rows"))
        return raw_data.join(languages, "language", "left")

    @r.feature()
    def widened_twice(raw_data, features, auxiliaries):
        return raw_data.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))

    @r.feature()
    def tweets_by_author(raw_data, features, auxiliaries):
        return raw_data.join(auxiliaries["authors"], "engaged_with_user_id", "left").select(*S.KEYS, "tweets")

    @r.auxiliary()
    def authors_table(raw_data, auxiliary_train=None):
        r.calls.append("authors_table" if auxiliary_train is None else "extended")
        counts = raw_data.groupBy("engaged_with_user_id").agg(F.count(F.lit(1)).alias("tweets"))
        if auxiliary_train is not None:
            counts = counts.unionByName(auxiliary_train["authors"])
            counts = counts.groupBy("engaged_with_user_id").agg(F.sum("tweets").alias("tweets"))
        return {"authors": counts}

    @r.auxiliary()
    def bad_table(raw_data, auxiliary_train=None):
        return raw_data

    return r


@pytest.fixture
def raw(table):
    return table({"tweet_timestamp": 13 * 3600}, {"tweet_id": "t2", "language": "abc", "engaged_with_user_id": "q", "like_timestamp": 7})


def test_routing_order_and_columns(raw, registry):
    store = FeatureStore(raw, ["language", "hour", "pair", "tweet_id", "keyed", "language"], registry=registry)
    assert store.default == ["language", "tweet_id"] and store.custom == ["hour", "pair", "keyed"]
    df = store.dataset()
    assert df.columns == [*S.KEYS, "language", "hour", "late", "long_text", "language_length"]
    row = df.where("tweet_id = 't1'").first()
    assert (row["hour"], row["late"], row["language_length"]) == (13, True, 2)


def test_expressions_need_no_join(raw, registry):
    plan = FeatureStore(raw, ["language", "hour", "pair"], registry=registry).dataset()._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_wider_tables_replace_the_raw_table(raw, registry, tmp_path):
    df = FeatureStore(raw, ["hour", "widened"], registry=registry, check_contract=True).dataset()
    assert df.columns == [*S.KEYS, "hour", "language_rows"] and {r["language_rows"] for r in df.collect()} == {1}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # no second join by row key
    with pytest.raises(ValueError, match="one row per raw row"):
        FeatureStore(raw, ["widened_twice"], registry=registry, check_contract=True).dataset()
    cache = FeatureCache(str(tmp_path), "d")
    stored = [FeatureStore(raw, ["widened"], registry=registry, feature_cache=cache, cache_all=True).dataset() for _ in range(2)]
    assert sorted(map(tuple, stored[0].collect())) == sorted(map(tuple, stored[1].collect()))


def test_wrong_results_are_rejected(raw, registry):
    for name in ("wrong", "keyless"):
        with pytest.raises(TypeError, match=name):
            FeatureStore(raw, [name], registry=registry).dataset()
    with pytest.raises(TypeError, match="bad_table"):
        FeatureStore(raw, [], ["bad_table"], registry=registry).auxiliaries()
    with pytest.raises(KeyError, match="nobody"):
        FeatureStore(raw, ["nobody"], registry=registry)
    with pytest.raises(KeyError, match="nothing"):
        FeatureStore(raw, [], ["nothing"], registry=registry)


def test_contract(raw, registry):
    assert FeatureStore(raw, ["keyed"], registry=registry, check_contract=True).dataset().count() == 2
    with pytest.raises(ValueError, match="one row per raw row"):
        FeatureStore(raw, ["doubled"], registry=registry, check_contract=True).dataset()
    keyed = raw.select(*S.KEYS, "language")
    assert tuple(row_contract(raw, keyed).first()) == (2, 2, 0, True)
    assert tuple(row_contract(raw, keyed.limit(1)).first()) == (2, 1, 0, False)
    swapped = keyed.limit(1).unionByName(keyed.limit(1))  # right count, wrong keys
    assert tuple(row_contract(raw, swapped).first()) == (2, 2, 1, False)


def test_without_the_check_duplicate_keys_fan_out_like_a_join(raw, registry):
    assert FeatureStore(raw, ["doubled"], registry=registry, check_contract=False).dataset().count() == 4


def test_lost_rows_are_an_error_by_default(raw, registry):
    registry.feature()(lost)
    with pytest.raises(ValueError, match="one row per raw row"):
        FeatureStore(raw, ["lost"], registry=registry).dataset()


def lost(raw_data, features, auxiliaries):
    return raw_data.where("tweet_id = 't2'").select(*S.KEYS, F.lit(1).alias("lost"))


def test_cached_features_follow_their_auxiliaries(raw, table, registry, tmp_path):
    other = table(*[{"tweet_id": f"o{i}"} for i in range(5)], {"engaged_with_user_id": "q"})
    found = []
    for data, name in ((raw, "A"), (other, "B"), (raw, "A")):
        auxiliary = FeatureCache(str(tmp_path / "auxiliaries"), name)
        FeatureStore(data, [], ["authors_table"], registry=registry, auxiliary_cache=auxiliary).auxiliaries()
        options = {"feature_cache": FeatureCache(str(tmp_path / "features"), "raw"), "auxiliary_cache": auxiliary}
        df = FeatureStore(raw, ["tweets_by_author"], ["authors_table"], registry=registry, **options).dataset()
        found.append({r["tweet_id"]: r["tweets"] for r in df.collect()})
    assert found == [{"t1": 1, "t2": 1}, {"t1": 5, "t2": 1}, {"t1": 1, "t2": 1}]


def test_cached_features_follow_earlier_features(raw, registry, tmp_path):
    cache = FeatureCache(str(tmp_path), "d")
    for enabled in (["keyed"], ["hour", "keyed"], ["keyed"]):
        FeatureStore(raw, enabled, registry=registry, feature_cache=cache).dataset()
    assert registry.calls.count("keyed") == 2


def test_cache_is_reused_and_tells_datasets_apart(raw, table, registry, tmp_path):
    cache = FeatureCache(str(tmp_path), "first")
    build = lambda df, c: FeatureStore(df, ["hour", "keyed"], registry=registry, feature_cache=c).dataset()
    first = sorted(map(tuple, build(raw, cache).collect()))
    assert sorted(map(tuple, build(raw, cache).collect())) == first
    assert registry.calls.count("keyed") == 1 and registry.calls.count("hour") == 2
    other = table({"tweet_id": "x", "language": "12345"}, {"tweet_id": "y"})  # same number of rows
    assert {r["language_length"] for r in build(other, FeatureCache(str(tmp_path), "second")).collect()} == {5, 2}
    (stored,) = paths.subdirectories(raw.sparkSession, f"{tmp_path}/first")
    assert stored.startswith("keyed-v3-")  # and what it was computed from
    cache.clear(raw.sparkSession)
    build(raw, cache)
    assert registry.calls.count("keyed") == 3


def test_expressions_can_be_cached_too(raw, registry, tmp_path):
    build = lambda: FeatureStore(raw, ["hour", "pair"], registry=registry, feature_cache=FeatureCache(str(tmp_path), "d"), cache_all=True).dataset()
    first, second = build(), build()
    assert registry.calls.count("hour") == 1 and first.columns == second.columns
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_unfinished_cache_entry_is_ignored(raw, registry, tmp_path):
    cache = FeatureCache(str(tmp_path), "d")
    (tmp_path / "d" / "keyed-v3").mkdir(parents=True)
    assert FeatureStore(raw, ["keyed"], registry=registry, feature_cache=cache).dataset().count() == 2


def test_auxiliaries_are_stored_and_extended_at_inference(raw, table, registry, tmp_path):
    options = {"registry": registry, "auxiliary_cache": FeatureCache(str(tmp_path), "train")}
    enabled, names = ["tweets_by_author"], ["authors_table"]
    assert {r["tweets"] for r in FeatureStore(raw, enabled, names, **options).dataset().collect()} == {1}
    FeatureStore(raw, enabled, names, **options).dataset()
    assert registry.calls == ["authors_table"]
    unseen = table({"tweet_id": "n1"}, {"tweet_id": "n2"}, {"tweet_id": "n3", "engaged_with_user_id": "new"})
    rows = FeatureStore(unseen, enabled, names, inference=True, **options).dataset().collect()
    assert {r["tweet_id"]: r["tweets"] for r in rows} == {"n1": 3, "n2": 3, "n3": 1}
    assert registry.calls == ["authors_table", "extended"]


def test_concat_is_an_inner_join(raw):
    left, right = raw.select(*S.KEYS, "language"), raw.where("tweet_id = 't2'").select(*S.KEYS, "tweet_type")
    rows = concat_features([left, right]).collect()
    assert [tuple(r) for r in rows] == [("t2", "b", "abc", "Toplevel")]


def test_default_extractors(raw, tmp_path):
    cache = FeatureCache(str(tmp_path), "d")
    store = FeatureStore(raw, [*S.MODEL_FEATURES, "binarize_timestamps", "engagement_degrees"], ["engagement_graph"], auxiliary_cache=cache)
    rows = {r["tweet_id"]: r for r in store.dataset(ordered=True).collect()}
    assert rows["t2"]["like"] and rows["t2"]["engaged_with_user_in_degree"] == 0 and rows["t1"]["engaged_with_user_in_degree"] == 0
    assert set(paths.subdirectories(raw.sparkSession, f"{tmp_path}/d/engagement_graph-v1")) == {"vertices", "edges", "degrees"}


def test_degrees_do_not_tell_the_label(table, tmp_path):
    enabled, names = ["engagement_degrees"], ["engagement_graph"]
    options = {"auxiliary_cache": FeatureCache(str(tmp_path), "train")}
    ins, outs = "engaged_with_user_in_degree", "engaging_user_out_degree"

    def degrees(df, **more):
        rows = FeatureStore(df, enabled, names, **options, **more).dataset().collect()
        return {r["tweet_id"]: (r[ins], r[outs]) for r in rows}

    train = table({"tweet_id": "x", "like_timestamp": 1, "reply_timestamp": 2}, {"tweet_id": "y", "like_timestamp": 3}, {"tweet_id": "z"})
    assert degrees(train) == {"x": (1, 1), "y": (2, 2), "z": (3, 3)}
    test = table({"tweet_id": "n", "like_timestamp": 1}, {"tweet_id": "m"})
    assert degrees(test, inference=True) == {"n": (3, 3), "m": (3, 3)}
    assert degrees(test.select(*S.INPUT_COLUMNS), inference=True) == {"n": (3, 3), "m": (3, 3)}


def test_graph_auxiliaries_of_unlabelled_data_are_empty(raw):
    store = FeatureStore(raw.select(*S.INPUT_COLUMNS), ["engagement_degrees"], ["engagement_graph"], inference=True)
    assert {tuple(r)[2:] for r in store.dataset().collect()} == {(0, 0)}


def test_unlabelled_data_needs_no_targets(raw):
    df = raw.select(*S.INPUT_COLUMNS)
    assert FeatureStore(df, S.MODEL_FEATURES, inference=True).dataset().columns == [*S.KEYS, *S.MODEL_FEATURES]
