"""Distributed evaluation: average precision and relative cross-entropy.

The input is the long form ``(by…, y, p)``: one row per scored label with the
0/1 label ``y`` and the score ``p``. Groups are few (targets, folds, splits).
A metric is null where it is undefined: without a positive label for average
precision, with a single class for relative cross-entropy, and for a group
that holds a missing label or score.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions import columns as C
from feedlens.operators.projections import prefix_predictions, targets_to_int
from feedlens.sources.durable import durable

#: Distinct scores one task sorts; decides the number of score ranges.
SCORES_PER_RANGE = 1_000_000


def to_long(
    df: DataFrame, ids: list[str] = [], prefix: str = "predicted_", targets: list[str] = S.TARGET_NAMES
) -> DataFrame:
    """Label/score column pairs to ``(ids…, target, y, p)`` rows, one scan."""
    pairs = [
        F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("y"), F.col(prefix + t).cast("double").alias("p"))
        for t in targets
    ]
    return df.select(*ids, F.inline(F.array(*pairs)))


def click_rate(long: DataFrame, by: list[str] = ["target"]) -> DataFrame:
    """Share of positives."""
    return long.groupBy(*by).agg(F.avg("y").alias("ctr"))


def log_loss(long: DataFrame, by: list[str] = ["target"]) -> DataFrame:
    """Share of positives and mean log loss with clipped scores."""
    term = C.log_loss_term(F.col("y"), F.col("p"))
    return long.groupBy(*by).agg(F.avg("y").alias("ctr"), F.avg(term).alias("log_loss"))


def _relative(cross_entropy: Column, rate: Column) -> Column:
    return (1 - cross_entropy / C.constant_log_loss(rate)) * 100


def relative_cross_entropy(long: DataFrame, by: list[str] = ["target"]) -> DataFrame:
    """Gain in percent over predicting the positive share, in one pass."""
    return log_loss(long, by).select(*by, _relative(F.col("log_loss"), F.col("ctr")).alias("rce"))


def score_counts(long: DataFrame, by: list[str]) -> DataFrame:
    """Positives and rows per distinct score, so ties form one threshold.

    Rows of a popular score are combined before the shuffle. Missing labels or
    scores are counted on a row of their own with a null score.
    """
    missing = F.col("y").isNull() | F.col("p").isNull() | F.isnan("p")
    score = F.when(~missing, F.col("p"))
    return long.groupBy(*by, score.alias("p")).agg(
        F.sum(F.when(~missing, F.col("y").cast("long")).otherwise(0)).alias("pos"),
        F.count(F.lit(1)).alias("n"),
    )


def _with_range(counts: DataFrame, scores_per_range: int) -> DataFrame:
    """Add ``range``: consecutive score intervals of about equal population.

    Edges are approximate quantiles of the distinct scores, hence balanced for
    any score distribution; the interval of a score is a function of the score
    alone, so a retried task puts it where it was before. Rows without a score
    form the lowest interval.
    """
    ranges = 1 + counts.count() // scores_per_range
    quantiles = [i / ranges for i in range(ranges)]
    # 0 is one more edge: a bucketizer needs one where no row has a score.
    edges = sorted({0.0, *counts.approxQuantile("p", quantiles, 1 / (4 * ranges))})
    bucketizer = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="p", outputCol="range", handleInvalid="keep")
    return bucketizer.transform(counts).withColumn("range", F.coalesce("range", F.lit(-1.0)))


def _running(counts: DataFrame, by: list[str], scores_per_range: int) -> DataFrame:
    """Add positives and rows at or above each score, as ``pos_cum, n_cum``.

    The running totals inside a score range plus the totals of the higher
    ranges. Apart from the range totals, one row per ``scores_per_range``
    scores, no window spans more than one range.
    """
    ranged = _with_range(counts, scores_per_range)
    window = Window.partitionBy(*by, "range").orderBy(F.desc_nulls_last("p")).rowsBetween(Window.unboundedPreceding, 0)
    higher = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*by, "range").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    above = totals.select(
        *by,
        "range",
        F.coalesce(F.sum("pos").over(higher), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("n_above"),
    )
    inside = ranged.withColumns({"pos_in": F.sum("pos").over(window), "n_in": F.sum("n").over(window)})
    return inside.join(above, [*by, "range"]).withColumns(
        {"pos_cum": F.col("pos_above") + F.col("pos_in"), "n_cum": F.col("n_above") + F.col("n_in")}
    )


def evaluate(long: DataFrame, by: list[str] = ["target"], scores_per_range: int = SCORES_PER_RANGE) -> DataFrame:
    """Average precision and relative cross-entropy per group.

    Both come from the table of distinct scores, which is written once: the
    scores of a model are then computed once, however many passes follow.
    """
    counts = durable(score_counts(long, by), "scores")
    running = _running(counts, by, scores_per_range)
    scored = F.col("p").isNotNull()
    positives, rows = F.sum("pos"), F.sum(F.when(scored, F.col("n")))
    precision = F.col("pos_cum") / F.col("n_cum")
    negatives = F.col("n") - F.col("pos")
    loss = F.col("pos") * C.log_loss_term(F.lit(1), F.col("p")) + negatives * C.log_loss_term(F.lit(0), F.col("p"))
    complete = F.bool_and(scored)
    return running.groupBy(*by).agg(
        F.when(complete, F.try_divide(F.sum(F.col("pos") * precision), positives)).alias("ap"),
        F.when(complete, _relative(F.sum(loss) / rows, positives / rows)).alias("rce"),
    )


def average_precision(long: DataFrame, by: list[str] = ["target"], scores_per_range: int = SCORES_PER_RANGE) -> DataFrame:
    """Precision averaged over recall steps, one step per distinct score."""
    return evaluate(long, by, scores_per_range).select(*by, "ap")


def join_predictions(predictions: DataFrame, labelled: DataFrame) -> DataFrame:
    """Predictions next to their integer targets, matched by row key."""
    labels = targets_to_int(labelled.select(*S.KEYS, *S.TARGET_NAMES))
    return prefix_predictions(predictions).join(labels, S.KEYS, "inner")


def fold_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean, population deviation and one-sigma bounds per split and target."""
    aggregates = []
    for m in ("ap", "rce"):
        mean, sigma = F.avg(m), F.stddev_pop(m)
        aggregates += [
            mean.alias(f"{m}_mean"),
            sigma.alias(f"{m}_sigma"),
            (mean - sigma).alias(f"{m}_lb"),
            (mean + sigma).alias(f"{m}_ub"),
        ]
    return fold_metrics.groupBy("split", "target").agg(*aggregates)


def mean_metrics(fold_metrics: DataFrame) -> DataFrame:
    """Mean and deviation per split over all targets and folds together."""
    return fold_metrics.groupBy("split").agg(
        F.avg("ap").alias("map_mean"),
        F.stddev_pop("ap").alias("map_sigma"),
        F.avg("rce").alias("mrce_mean"),
        F.stddev_pop("rce").alias("mrce_sigma"),
    )
