"""End-to-end jobs: training, inference, cross-fold evaluation, reports."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.operators import components, graph, metrics, profile, splits
from feedlens.plans.feature_store import FeatureCache, FeatureStore
from feedlens.plans.models import TargetModels
from feedlens.sources.durable import durable, job_scratch, scratch_path
from feedlens.sources.paths import dataset_fingerprint
from feedlens.sources.publish import staged
from feedlens.sources.readers import read_interactions, read_part_files
from feedlens.sources.writers import write_predictions


def train(
    spark: SparkSession, path: str, model_path: str, model: TargetModels | None = None, cache_root: str | None = None, params: dict | None = None
) -> TargetModels:
    """Read labelled data, assemble features, fit all targets and save.

    With ``cache_root``, keyed features and auxiliaries are stored under the
    fingerprint of the data; :func:`training_cache` finds them again.
    """
    model = model or TargetModels()
    cache = training_cache(spark, path, cache_root) if cache_root else None
    raw = read_interactions(spark, path)
    with job_scratch(spark):
        store = FeatureStore(raw, model.enabled(), model.auxiliaries, feature_cache=cache, auxiliary_cache=cache)
        model.fit(store.dataset(), None, params)
        model.save(model_path, spark)
    return model


def training_cache(spark: SparkSession, path: str, cache_root: str) -> FeatureCache:
    """Cache of one training dataset."""
    return FeatureCache(cache_root, dataset_fingerprint(spark, path))


def score_unlabelled(raw: DataFrame, model: TargetModels, auxiliary_cache: FeatureCache | None = None) -> DataFrame:
    """Predictions for unlabelled rows.

    Auxiliaries come from ``auxiliary_cache``, that of the training data, and
    are extended by the new rows.
    """
    enabled = model.enabled(include_targets=False)
    store = FeatureStore(raw, enabled, model.auxiliaries, auxiliary_cache=auxiliary_cache, inference=True)
    return model.predict(store.dataset())


def batch_inference(
    spark: SparkSession,
    directory: str,
    model: TargetModels,
    out: str,
    auxiliary_cache: FeatureCache | None = None,
) -> int:
    """Score every part file of a directory in one job; returns the row count.

    The number of predictions is observed while they are written and compared
    with the number of input rows, which only takes a scan of line ends. They are
    written beside ``out`` and take its place once the numbers agree; otherwise
    earlier predictions stay as they are.
    """
    written = Observation()
    raw = read_part_files(spark, directory)
    with job_scratch(spark), staged(spark, out) as staging:
        predictions = score_unlabelled(raw, model, auxiliary_cache)
        write_predictions(predictions.observe(written, F.count(F.lit(1)).alias("rows")), staging)
        rows, scored = raw.count(), written.get["rows"]
        if rows != scored:
            raise ValueError(f"{rows} rows read but {scored} predictions written")
    return scored


def cross_fold_evaluation(
    pairs: list[tuple[DataFrame, DataFrame]], params: dict | None = None, make_model: Callable[[], TargetModels] = TargetModels, parallelism: int = 3
) -> DataFrame:
    """``(fold, split, target, ap, rce)`` of a fresh model per train/test pair.

    Auxiliaries of the train side are stored and extended by the test side;
    features must not read a row's own labels back from them. The small jobs of a
    fold leave executors idle, so up to ``parallelism`` folds are assembled and
    fitted side by side; the scores of all folds are evaluated in one pass.
    """

    def scores(fold: int, train_raw: DataFrame, test_raw: DataFrame) -> list[DataFrame]:
        model = make_model()
        cache = FeatureCache(scratch_path(train_raw.sparkSession, "fold"), "train")

        def assemble(raw: DataFrame, inference: bool) -> DataFrame:
            store = FeatureStore(raw, model.enabled(), model.auxiliaries, auxiliary_cache=cache, inference=inference)
            return durable(store.dataset(), "fold")

        sides = {"train": assemble(train_raw, False), "test": assemble(test_raw, True)}
        model.fit(sides["train"], None, params)
        scored = [model.score(df, model.targets, "predicted_").select(F.lit(fold).alias("fold"), F.lit(split).alias("split"), "*") for split, df in sides.items()]
        return [metrics.to_long(df, ["fold", "split"], targets=model.targets) for df in scored]

    if not pairs:
        raise ValueError("no pairs to evaluate")
    run = inheritable_thread_target(pairs[0][0].sparkSession)(scores)
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        # A context of its own per fold, so that scratch tables belong to the job around.
        pending = [pool.submit(copy_context().run, run, fold, *pair) for fold, pair in enumerate(pairs)]
        long = [df for fold in pending for df in fold.result()]
    return metrics.evaluate(reduce(DataFrame.unionByName, long), ["fold", "split", "target"])


def differential_check(raw: DataFrame, target: str = "retweet_with_comment", params: dict | None = None) -> DataFrame:
    """Positional split, fit one target, score the rest: ``(target, ap, rce)``.

    An independent route to the metrics, without store and sampler.
    """
    model = TargetModels(targets=[target])
    table = raw.withColumn(target, F.col(S.TARGETS[target]).isNotNull())
    table = durable(table.select(*S.KEYS, *S.MODEL_FEATURES, target), "differential")
    train_set, test_set = splits.positional_split(table)
    return model.fit(train_set, None, params).evaluate(test_set)


def stationarity_report(df: DataFrame, days: int, top: int = 10) -> dict[str, DataFrame]:
    """Hourly counts, their aligned series, completeness and busiest hours.

    The counts are a small table, written once and shared by all parts.
    """
    counts = durable(profile.hourly_counts(df), "hourly")
    return {
        "counts": profile.series_by_type(counts),
        "series": profile.hourly_pivot(counts).orderBy("date"),
        "complete": profile.grid_completeness(counts, days),
        "top": profile.top_hours(counts, top),
    }


def graph_report(df: DataFrame) -> DataFrame:
    """``(statistic, value)``: sizes, isolated vertices, degrees, components."""
    vertices = durable(graph.vertices(df), "vertices")
    edges = durable(graph.edges(df).select("src", "dst"), "edges")
    built = graph.Graph(vertices, edges)
    connected = graph.drop_isolated(built).vertices.agg(F.count(F.lit(1)).alias("n_not_isolated"))
    parts = components.component_stats(components.connected_components(vertices, edges))

    def long(row: DataFrame, ids: list[str] = []) -> DataFrame:
        values = [F.col(c).cast("double").alias(c) for c in row.columns if c not in ids]
        return row.select(*ids, *values).unpivot(ids, [c for c in row.columns if c not in ids], "statistic", "value")

    degrees = long(graph.degree_summary(edges), ["direction"])
    named = degrees.select(F.concat_ws("_", "direction", "statistic").alias("statistic"), "value")
    return reduce(DataFrame.unionByName, [long(graph.sizes(built)), long(connected), named, long(parts)])


def metric_report(fold_metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summary per target and over all targets."""
    return metrics.fold_summary(fold_metrics), metrics.mean_metrics(fold_metrics)
