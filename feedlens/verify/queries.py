"""One query per operator, over the whole stand-in interaction table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions.columns import follower_score
from feedlens.operators import components as CC
from feedlens.operators import filters, graph, metrics, profile, projections, sampling, splits
from feedlens.plans import jobs
from feedlens.plans.extractors import engagement_graph
from feedlens.plans.feature_store import FeatureCache, FeatureStore, concat_features, contract_report
from feedlens.plans.models import DEFAULT_PARAMS, TargetModels, score_batches
from feedlens.sources import readers, writers
from feedlens.sources.durable import durable, scratch_path
from feedlens.sources.publish import staged
from feedlens.standin import interactions
from feedlens.streaming.hourly import read_hour_parts, read_hourly_counts, stream_hour_parts, stream_hourly_counts
from feedlens.streaming.scoring import degree_scorer, read_model_scores, read_part_stream, stream_model_scores, stream_scores

#: Split time of the stand-in table: its median tweet time.
SPLIT = 893137754
#: Trailing window of the stand-in table, which spans years: 90 days.
WINDOW = 90 * 86400
#: Calendar days that occur as ``dd``.
DAYS = 31
PLAN = sampling.FoldPlan(split=SPLIT, train_rows=10_000, test_rows=2_000, extra_rows=200, folds=5)
SAMPLE = sampling.SampleSpec(binarise=True, zero_columns=("hashtags", "engaging_user_is_verified"), window=None, rows=4_000)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def on_interactions(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query that needs nothing but the interaction table."""
    QUERIES[function.__name__] = lambda spark, sf_dir: function(interactions(spark, sf_dir))
    return function


def on_stored_interactions(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query that scans its input several times: as in production,
    the interaction table is stored first instead of derived again per scan."""
    QUERIES[function.__name__] = lambda spark, sf_dir: function(durable(interactions(spark, sf_dir), "interactions"))
    return function


#: Columns that a typed edge needs, those of a user, and those that tell an edge's age.
EDGES = ["engaged_with_user_id", "engaging_user_id", "engagee_follows_engager", *S.LABELS]
USERS = [f"{role}_user_{name}" for role in ("engaged_with", "engaging") for name in projections.VERTEX_ATTRIBUTES]
MOMENTS = [*S.KEYS, "tweet_timestamp"]


def on_stored_columns(columns: list[str], engaged: bool = False) -> Callable:
    """Like ``on_stored_interactions`` for a query that needs these columns only and,
    with ``engaged``, rows with an engagement only."""

    def register(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        def query(spark, sf_dir):
            needed = interactions(spark, sf_dir).select(*dict.fromkeys(columns))
            return function(durable(filters.positives(needed) if engaged else needed, "interactions"))

        QUERIES[function.__name__] = query
        return function

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def fixed_long(df: DataFrame, ids: list[str] = []) -> DataFrame:
    """Fixed score against all four targets, in long form."""
    scored = df.select(*ids, *[c.alias(t) for t, c in projections.target_columns().items()], follower_score().alias("p"))
    scored = scored.withColumns({f"predicted_{t}": F.col("p") for t in S.TARGET_NAMES})
    return metrics.to_long(scored, ids)


def fixed_predictions(df: DataFrame) -> DataFrame:
    score = follower_score()
    return df.select(*S.KEYS, *[score.alias(t) for t in S.TARGET_NAMES])


# -- profile and projections ------------------------------------------------


@on_interactions
def engagement_profile(df):
    shares = ["with_hashtags_pct", "negative_pct", *[f"{t}_pct" for t in S.TARGET_NAMES]]
    return rounded(profile.engagement_profile(df), *shares)


@on_interactions
def row_count(df):
    return df.agg(F.count(F.lit(1)).alias("n"))


@on_interactions
def binarize_targets(df):
    return projections.binarize_targets(df)


@on_interactions
def timestamp_to_flag(df):
    return projections.labels_to_flags(df).select(*S.KEYS, *S.LABELS)


@on_interactions
def zero_fill_columns(df):
    columns = ["hashtags", "engaged_with_user_is_verified", "engaged_with_user_follower_count"]
    return projections.zero_fill(df, columns).select(*S.KEYS, *columns)


@on_interactions
def engaged_with_users(df):
    return projections.engaged_with_users(df)


@on_interactions
def engaging_users(df):
    return projections.engaging_users(df)


# -- sources and sinks ------------------------------------------------------


def text_copy(df: DataFrame, labelled: bool = True) -> str:
    path = scratch_path(df.sparkSession, "text")
    writers.write_delimited(projections.file_order(df, labelled), path)
    return path


@on_interactions
def csv_roundtrip(df):
    return readers.read_interactions(df.sparkSession, text_copy(df))


@on_interactions
def unlabelled_scan(df):
    return readers.read_interactions(df.sparkSession, text_copy(df, False), labelled=False)


@on_interactions
def part_files(df):
    return readers.read_part_files(df.sparkSession, text_copy(df, False)).select(*S.KEYS, *S.MODEL_FEATURES)


@on_interactions
def parquet_projection(df):
    spark = df.sparkSession
    path = scratch_path(spark, "copy") + ".parquet"
    durable(df, path=path)
    return readers.read_interactions(spark, path).select(*S.KEYS, "language", "tweet_type", "like_timestamp")


@on_interactions
def raw_lines_split(df):
    return readers.name_fields(readers.read_raw_fields(df.sparkSession, text_copy(df)))


@on_interactions
def typed_cast(df):
    named = readers.name_fields(readers.read_raw_fields(df.sparkSession, text_copy(df)))
    return readers.cast_fields(named, S.SAMPLE_TYPES)


@on_interactions
def list_columns(df):
    lists = readers.with_list_columns(df)
    sizes = [F.when(F.col(c).isNotNull(), F.size(c)).alias(f"{c}_size") for c in S.LIST_FIELDS]
    firsts = [F.get(c, F.lit(0)).alias(f"{c}_first") for c in S.LIST_FIELDS]
    items = [F.array_join(c, "|", "?").alias(f"{c}_items") for c in S.LIST_FIELDS]
    return lists.select(*S.KEYS, *sizes, *firsts, *items)


@on_interactions
def predictions_export(df):
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "predictions")
    writers.write_predictions(fixed_predictions(df), path)
    types = ", ".join([f"{k} string" for k in S.KEYS] + [f"`{t}` double" for t in S.TARGET_NAMES])
    return spark.read.schema(types).csv(path)


# -- filters ----------------------------------------------------------------


@on_interactions
def with_hashtags(df):
    return filters.with_hashtags(df).select(*S.KEYS, "hashtags")


@on_interactions
def negatives(df):
    return filters.negatives(df).select(*S.KEYS, "tweet_timestamp")


@on_interactions
def positives(df):
    return filters.positives(df).select(*S.KEYS, *S.LABELS)


@on_interactions
def engaged_like(df):
    return filters.engaged(df, "like").select(*S.KEYS, "like_timestamp")


@on_interactions
def by_engagement(df):
    return filters.by_engagement(df).select("target", *S.KEYS)


@on_interactions
def time_window(df):
    return filters.trailing_window(df, WINDOW).select(*S.KEYS, "tweet_timestamp")


@on_interactions
def time_split(df):
    return filters.by_time_side(df, SPLIT).select(*S.KEYS, "tweet_timestamp", "side")


# -- hourly series ----------------------------------------------------------


@on_interactions
def interaction_long(df):
    return projections.interaction_rows(df)


@on_interactions
def hourly_counts(df):
    return profile.series_by_type(profile.hourly_counts(df))


@on_interactions
def full_hour_counts(df):
    return profile.full_hour_counts(df)


@on_interactions
def hourly_pivot(df):
    return profile.hourly_pivot(profile.hourly_counts(df))


@on_interactions
def hourly_grid_complete(df):
    return profile.grid_completeness(profile.hourly_counts(df), DAYS)


@on_interactions
def top_hours(df):
    return profile.top_hours(profile.hourly_counts(df), 10)


# -- metrics ----------------------------------------------------------------


@on_interactions
def log_loss(df):
    return rounded(metrics.log_loss(fixed_long(df)), "ctr", "log_loss")


@on_interactions
def click_rate(df):
    return rounded(metrics.click_rate(fixed_long(df)), "ctr")


@on_interactions
def rce(df):
    return rounded(metrics.relative_cross_entropy(fixed_long(df)), "rce")


@on_interactions
def average_precision(df):
    return rounded(metrics.average_precision(fixed_long(df)), "ap")


@on_interactions
def average_precision_by_language(df):
    by = ["language", "target"]
    return rounded(metrics.average_precision(fixed_long(df, ["language"]), by, scores_per_range=20_000), "ap")


@on_stored_interactions
def predictions_joined(df):
    return metrics.join_predictions(fixed_predictions(df), projections.binarize_targets(df))


@on_stored_interactions
def evaluate_all(df):
    joined = metrics.join_predictions(fixed_predictions(df), projections.binarize_targets(df))
    return rounded(metrics.evaluate(metrics.to_long(joined)), "ap", "rce")


def fixed_fold_metrics(df: DataFrame) -> DataFrame:
    folds = sampling.build_folds(df, PLAN)
    tagged = [
        fixed_long(side.withColumn("split", F.lit(split)), ["fold", "split"])
        for split, side in (("train", folds.train), ("test", folds.test))
    ]
    return metrics.evaluate(tagged[0].unionByName(tagged[1]), ["fold", "split", "target"])


@on_stored_interactions
def fold_metrics(df):
    return rounded(fixed_fold_metrics(df), "ap", "rce")


@on_stored_interactions
def fold_summary(df):
    summary = metrics.fold_summary(fixed_fold_metrics(df))
    return rounded(summary, *[c for c in summary.columns if c not in ("split", "target")])


@on_stored_interactions
def mean_metrics(df):
    summary = metrics.mean_metrics(fixed_fold_metrics(df))
    return rounded(summary, *[c for c in summary.columns if c != "split"])


def logistic_scorer(keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The fixed score as a batch function that needs no package on the workers."""

    def score(batch):
        engaging = 0.1 * np.log(1 + batch["engaging_user_follower_count"])
        engaged_with = 0.05 * np.log(1 + batch["engaged_with_user_follower_count"])
        return batch[keys].assign(p=np.round(1 / (1 + np.exp(1.0 - engaging + engaged_with)), 6))

    return score


@on_interactions
def score_map_in_pandas(df):
    schema = "tweet_id string, engaging_user_id string, p double"
    return score_batches(df.select(*S.KEYS, *S.MODEL_FEATURES), logistic_scorer(list(S.KEYS)), schema)


# -- samples, folds, splits -------------------------------------------------


@on_interactions
def bernoulli_sample(df):
    return sampling.bernoulli_sample(df, 4_000, seed=42).select(*S.KEYS)


@on_stored_interactions
def exact_sample(df):
    return sampling.exact_sample(df, 4_000, 42).select(*S.KEYS, "tweet_timestamp")


@on_interactions
def hash_sample(df):
    return sampling.hash_sample(df, 0.1, 42).select(*S.KEYS, "tweet_timestamp")


@on_stored_interactions
def fold_train(df):
    return sampling.build_folds(df, PLAN).train.select("fold", *S.KEYS, "tweet_timestamp")


@on_stored_interactions
def fold_test(df):
    return sampling.build_folds(df, PLAN).test


@on_interactions
def sample_users(df):
    train = filters.before(sampling.hash_sample(df, 0.1, 42), SPLIT)
    return train.select("engaging_user_id").distinct()


@on_interactions
def sample_generator(df):
    return sampling.generate_sample(df, SAMPLE)


@on_interactions
def sample_generator_window(df):
    return sampling.generate_sample(df, sampling.SampleSpec(window=WINDOW)).select(*S.KEYS, "tweet_timestamp", *S.LABELS)


@on_stored_interactions
def positional_split(df):
    table = df.withColumn("retweet_with_comment", F.col("retweet_with_comment_timestamp").isNotNull())
    train, test = splits.positional_split(table.select(*S.KEYS, *S.MODEL_FEATURES, "retweet_with_comment"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@on_interactions
def sorted_dataset(df):
    return splits.sort_by_key(df.select(*S.KEYS, *S.MODEL_FEATURES))


@on_interactions
def sorted_dataset_order(df):
    """Whether the sorted table is in order, inside and across its partitions."""
    return splits.order_report(splits.sort_by_key(df.select(*S.KEYS, *S.MODEL_FEATURES)))


# -- graph ------------------------------------------------------------------


@on_interactions
def graph_vertices(df):
    return graph.vertices(df)


@on_interactions
def latest_vertices(df):
    return graph.latest_vertices(df)


@on_interactions
def graph_edges(df):
    return graph.edges(df)


@on_interactions
def graph_sizes(df):
    return graph.sizes(graph.build_graph(df))


@on_interactions
def in_degrees(df):
    return graph.in_degrees(graph.edges(df))


@on_interactions
def out_degrees(df):
    return graph.out_degrees(graph.edges(df))


@on_interactions
def degree_summary(df):
    return rounded(graph.degree_summary(graph.edges(df)), "avg", "stddev")


@on_interactions
def drop_isolated(df):
    quotes = graph.edges(df).where(F.col("interaction_type") == S.EDGE_TYPES["retweet_with_comment_timestamp"])
    return graph.drop_isolated(graph.Graph(graph.vertices(df), quotes)).vertices


@on_stored_columns([*EDGES, *USERS], engaged=True)
def components(df):
    built = graph.build_graph(df)
    return CC.connected_components(built.vertices, built.edges)


def typed_components(df: DataFrame) -> DataFrame:
    """Components of the four single-type graphs at once: a vertex is a user
    within a type, so the types stay apart."""
    typed = graph.edges(df).select(
        *[F.concat_ws(":", F.col("interaction_type").cast("string"), end).alias(end) for end in ("src", "dst")]
    )
    return CC.connected_components(graph.endpoints(typed), typed)


@on_stored_columns(EDGES, engaged=True)
def components_by_type(df):
    return typed_components(df)


@on_stored_columns(EDGES, engaged=True)
def component_stats(df):
    return rounded(CC.component_stats(typed_components(df)), "avg_vertices")


@on_stored_interactions
def degree_features(df):
    return graph.degree_features(df, graph.degrees(graph.edges(df)))


@on_stored_interactions
def degrees_without_own_row(df):
    """No row sees its own engagements in the degrees of its users."""
    return graph.degree_features(df, graph.degrees(graph.edges(df)), own=graph.own_edges(df))


@on_stored_columns([*EDGES, *MOMENTS])
def degrees_as_of(df):
    """Engagements strictly older than the tweet, over several time ranges."""
    return graph.degrees_as_of(df, graph.edges(df))


@on_stored_columns([*EDGES, *USERS], engaged=True)
def graph_report(df):
    return rounded(jobs.graph_report(df), "value")


# -- feature store ----------------------------------------------------------


def caches(spark: SparkSession, dataset: str) -> dict[str, FeatureCache]:
    cache = FeatureCache(scratch_path(spark, "store"), dataset)
    return {"feature_cache": cache, "auxiliary_cache": cache}


@on_stored_interactions
def feature_assembly(df):
    enabled = [*S.MODEL_FEATURES, "binarize_timestamps", "engagement_degrees"]
    store = FeatureStore(df, enabled, ["engagement_graph"], **caches(df.sparkSession, "all"))
    return store.dataset(ordered=True)


@on_stored_interactions
def feature_concat(df):
    delays = {f"{t}_delay": F.col(label) - F.col("tweet_timestamp") for t, label in S.TARGETS.items()}
    return concat_features([projections.binarize_targets(df), df.select(*S.KEYS, *[c.alias(n) for n, c in delays.items()])])


def extended_graph(df: DataFrame) -> dict[str, DataFrame]:
    """Auxiliaries stored for the training side, extended by the test side."""
    options = caches(df.sparkSession, "train")
    FeatureStore(filters.before(df, SPLIT), [], ["engagement_graph"], **options).auxiliaries()
    return FeatureStore(filters.after(df, SPLIT), [], ["engagement_graph"], inference=True, **options).auxiliaries()


@on_stored_interactions
def auxiliary_extend(df):
    return extended_graph(df)["edges"]


@on_stored_interactions
def auxiliary_degrees(df):
    return extended_graph(df)["degrees"]


@on_stored_interactions
def row_contract_check(df):
    degrees = engagement_graph(df)["degrees"]
    return contract_report(df, graph.degree_features(df, degrees))


@on_stored_interactions
def row_contract_foreign(df):
    """As many distinct keys as the raw rows, but those of other rows."""
    mixed = df.select(F.when(F.col("tweet_timestamp") < SPLIT, F.col("tweet_id")).otherwise(F.concat(F.lit("x"), "tweet_id")).alias("tweet_id"), "engaging_user_id")
    return contract_report(df, mixed)


# -- models and jobs --------------------------------------------------------


@on_interactions
def gbt_train_predict(df):
    dataset = durable(FeatureStore(df, TargetModels().enabled()).dataset(), "dataset")
    return TargetModels().fit(dataset).predict(dataset)


@on_stored_interactions
def validated_fit(df):
    """Fits that stop on later rows: are the rounds kept within the limit, and is
    the last one the best of them on those rows?"""
    dataset = durable(FeatureStore(df, [*TargetModels().enabled(), "tweet_timestamp"]).dataset(), "dataset")
    valid = filters.after(dataset, SPLIT)
    model = TargetModels().fit(filters.before(dataset, SPLIT), valid)
    found = [(t, len(losses) <= DEFAULT_PARAMS["maxIter"], losses[-1] == min(losses)) for t, losses in model.validation_losses(valid).items()]
    return df.sparkSession.createDataFrame(found, "target string, within_limit boolean, last_is_best boolean")


@on_stored_interactions
def batch_inference(df):
    spark = df.sparkSession
    directory, out = text_copy(df, False), scratch_path(spark, "results")
    dataset = FeatureStore(filters.before(df, SPLIT), TargetModels().enabled()).dataset()
    jobs.batch_inference(spark, directory, TargetModels().fit(dataset), out)
    types = ", ".join([f"{k} string" for k in S.KEYS] + [f"`{t}` float" for t in S.TARGET_NAMES])
    return spark.read.schema(types).csv(out)


def degree_model() -> TargetModels:
    """Learns from the follower counts and the degrees as of the tweet."""
    degrees = ["engaged_with_user_in_degree", "engaging_user_out_degree"]
    return TargetModels([*S.MODEL_FEATURES, *degrees], extractors=[*S.MODEL_FEATURES, "engagement_degrees_as_of"], auxiliaries=["engagement_graph"])


def stored_pairs(df: DataFrame, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    plan = sampling.FoldPlan(split=SPLIT, train_rows=10_000, test_rows=2_000, extra_rows=200, folds=folds)
    built = sampling.build_folds(df, plan).stored()
    return [built.pair(i) for i in range(folds)]


@on_stored_interactions
def cross_fold_eval(df):
    return jobs.cross_fold_evaluation(stored_pairs(df, 5))


@on_stored_interactions
def cross_fold_eval_with_degrees(df):
    return jobs.cross_fold_evaluation(stored_pairs(df, 5), make_model=degree_model)


@on_stored_interactions
def published_predictions(df):
    """Predictions of a first run; a second one with fewer rows fails its check."""
    spark, out = df.sparkSession, scratch_path(df.sparkSession, "results")
    whole = fixed_predictions(df)
    for predictions in (whole, whole.where(F.col("tweet_id") < "t5")):
        try:
            with staged(spark, out) as staging:
                writers.write_predictions(predictions, staging)
                if spark.read.csv(staging).count() != df.count():
                    raise ValueError("predictions are missing")
        except ValueError:
            continue
    types = ", ".join([f"{k} string" for k in S.KEYS] + [f"`{t}` double" for t in S.TARGET_NAMES])
    return spark.read.schema(types).csv(out)


@on_interactions
def differential_check(df):
    return jobs.differential_check(df)


# -- streaming --------------------------------------------------------------


@on_interactions
def stream_hourly(df):
    spark, out = df.sparkSession, scratch_path(df.sparkSession, "hours")
    stream = read_part_stream(spark, text_copy(df), labelled=True)
    stream_hourly_counts(stream, out, scratch_path(spark, "hours-state")).awaitTermination()
    return read_hourly_counts(spark, out)


@on_interactions
def stream_scored(df):
    spark, out = df.sparkSession, scratch_path(df.sparkSession, "scores")
    parts = read_part_stream(spark, text_copy(df, False), labelled=False)
    score = lambda rows: rows.select(*S.KEYS, follower_score().alias("p"))
    stream_scores(parts, score, out, scratch_path(spark, "scores-state")).awaitTermination()
    return spark.read.schema("tweet_id string, engaging_user_id string, p double").csv(out)


@on_interactions
def stream_hourly_late(df):
    """Counts from several batches, with the late ones kept."""
    spark, out = df.sparkSession, scratch_path(df.sparkSession, "hour-parts")
    stream = read_part_stream(spark, text_copy(df), labelled=True, files_per_batch=4)
    stream_hour_parts(stream, out, scratch_path(spark, "hour-parts-state"), lateness=86400).awaitTermination()
    return read_hour_parts(spark, out).select("hour", "type", "count")


@on_stored_interactions
def stream_scored_model(df):
    """A model fitted on earlier rows scores a stream of all rows, with the stored
    degrees of training: rows that are scored, and rows whose scores are not those
    of the batch job."""
    spark, out = df.sparkSession, scratch_path(df.sparkSession, "model-scores")
    earlier = filters.before(df, SPLIT)
    degrees = durable(graph.degrees(graph.edges(earlier)), "degrees")
    labels = [(F.col(c).isNotNull()).cast("int").alias(t) for t, c in S.TARGETS.items()]
    names = ["engaged_with_user_in_degree", "engaging_user_out_degree"]
    train = graph.degree_features(earlier.select("*", *labels), degrees, keep=[*S.KEYS, *S.MODEL_FEATURES, *S.TARGET_NAMES])
    score = degree_scorer(TargetModels([*S.MODEL_FEATURES, *names]).fit(train), degrees)
    parts = read_part_stream(spark, text_copy(df, False), files_per_batch=4).select(*S.KEYS, "engaged_with_user_id", *S.MODEL_FEATURES)
    stream_model_scores(parts, score, out, scratch_path(spark, "model-state")).awaitTermination()
    sides = [(read_model_scores(spark, out), 1, 0), (score(df), 0, 1)]
    both = reduce(DataFrame.unionByName, [scores.withColumns({"streamed": F.lit(s), "batch": F.lit(b)}) for scores, s, b in sides])
    counts = both.groupBy(*S.KEYS, *S.TARGET_NAMES).agg(F.sum("streamed").alias("streamed"), F.sum("batch").alias("batch"))
    return counts.agg(F.sum("streamed").alias("n_streamed"), F.sum(F.abs(F.col("streamed") - F.col("batch"))).alias("n_different"))
