"""What the physical plans must look like, whatever the data size."""

import re

import pytest
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens import standin
from feedlens.operators import filters, graph, metrics, profile, projections, sampling, splits
from feedlens.sources import readers
from feedlens.verify.oracles import ORACLES
from feedlens.verify.queries import QUERIES, fixed_long


@pytest.fixture(scope="module")
def stored(spark, interactions, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "all.parquet")
    interactions.write.parquet(path)
    return readers.read_interactions(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df):
    return [sorted(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))]


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan(df)))


def test_profile_reads_five_columns_once(stored):
    df = profile.engagement_profile(stored)
    assert read_columns(df) == [sorted(["hashtags", *S.LABELS])]
    assert exchanges(df) == 1  # one partial row per task


def test_filters_reach_the_scan(stored):
    assert "GreaterThan(tweet_timestamp" in plan(filters.after(stored, 5)) and "LessThan(tweet_timestamp" in plan(filters.before(stored, 5))
    assert "IsNotNull(like_timestamp)" in plan(filters.engaged(stored, "like"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan(filters.positives(stored))).group(1)
    assert pushed.count("IsNotNull") == 4 and "Or" in pushed
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan(stored.where(splits.key_below(("t1", "u1"))))).group(1)
    assert pushed.startswith("Or(LessThan(tweet_id,t1)")


def test_hourly_counts_shuffle_once_and_read_labels_only(stored):
    df = profile.hourly_counts(stored)
    assert read_columns(df) == [sorted(S.LABELS)] and exchanges(df) == 1


def test_edges_and_vertices_come_from_one_scan(stored):
    assert len(read_columns(graph.edges(stored))) == 1 and exchanges(graph.edges(stored)) == 0
    assert len(read_columns(graph.vertices(stored))) == 1 and exchanges(graph.vertices(stored)) == 1
    assert len(read_columns(graph.degree_summary(graph.edges(stored)))) == 1


def test_binarised_targets_and_samples_are_narrow(stored):
    for df in (projections.binarize_targets(stored), sampling.hash_sample(stored, 0.1, 1), filters.by_engagement(stored)):
        assert exchanges(df) == 0


def test_split_sides_are_plain_filters(stored):
    for side in splits.positional_split(stored):
        assert exchanges(side) == 0 and "Join" not in plan(side)


def test_no_query_uses_a_cross_join_or_a_window_over_everything(spark, stored):
    long = fixed_long(stored)
    frames = [metrics.evaluate(long), metrics.evaluate(long, scores_per_range=500), graph.degree_features(stored, graph.degrees(graph.edges(stored)))]
    folds = sampling.build_folds(stored, sampling.FoldPlan(split=893137754, train_rows=100, test_rows=50, folds=2))
    for df in [*frames, folds.train, folds.test]:
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        for window in re.findall(r"Window \[.*?\](?:, \[(.*?)\])?", text):
            assert window, text


def test_draw_happens_before_the_shuffle_of_the_folds(stored):
    folds = sampling.build_folds(stored, sampling.FoldPlan(split=893137754, train_rows=100, test_rows=50, folds=2))
    text = plan(folds.test)
    scan_to_exchange = text[: text.rindex("FileScan")]
    assert "md5" in scan_to_exchange


def test_registered_names_match():
    without_sql = {"bernoulli_sample", "gbt_train_predict", "batch_inference", "cross_fold_eval", "cross_fold_eval_with_degrees", "differential_check"}
    assert set(QUERIES) - set(ORACLES) == without_sql
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    row = entry.entry(spark).first()
    assert row["rows"] == 5942
    assert entry.queries().items() >= QUERIES.items() and entry.oracle_sql().items() >= ORACLES.items()
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_a_fold_reads_its_own_files(interactions):
    folds = sampling.build_folds(interactions, sampling.FoldPlan(split=893137754, train_rows=1000, test_rows=400, folds=2)).stored()
    for side in folds.pair(1):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(fold" in plan and "(fold" in plan.split("PartitionFilters: ")[1]


def test_standin_schema_and_key(spark, sf_dir):
    from feedlens.standin import interactions

    df = interactions(spark, sf_dir)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in S.interaction_schema()]
    assert df.groupBy(*S.KEYS).count().where(F.col("count") > 1).count() == 0


def test_stand_in_joins_move_given_columns_only(spark, sf_dir):
    """Derived texts and times are computed behind the last join, and the pairs are
    dealt by order once, for their duplicates and for the join."""
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    earlier = {name: spark.conf.get(name) for name in off}
    try:
        for name, value in off.items():
            spark.conf.set(name, value)
        query = standin.interactions(spark, sf_dir)._jdf.queryExecution()
        lines = query.optimizedPlan().toString().splitlines()
        first = next(i for i, line in enumerate(lines) if "Join" in line)
        assert any("concat(" in line for line in lines[:first]) and not any("concat(" in line for line in lines[first:])
        # orders and authors, tweets, pairs, pairs with their tweets, viewers
        assert query.executedPlan().toString().count("Exchange hashpartitioning") == 6
    finally:
        for name, value in earlier.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("name", ["components", "components_by_type", "component_stats", "degrees_as_of", "graph_report"])
def test_graph_queries_store_no_texts(spark, sf_dir, monkeypatch, name):
    from feedlens.verify import queries

    stored = []

    def recorded(df, *rest):
        stored.append(set(df.columns))
        raise StopIteration

    monkeypatch.setattr(queries, "durable", recorded)
    with pytest.raises(StopIteration):
        queries.QUERIES[name](spark, sf_dir)
    assert stored and not stored[0] & {"text_tokens", "hashtags", "present_media", "language"}
