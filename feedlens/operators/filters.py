"""Row selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions.columns import any_label, filled, no_label, present


def with_hashtags(df: DataFrame) -> DataFrame:
    return df.where(filled(F.col("hashtags")))


def negatives(df: DataFrame, binarised: bool = False) -> DataFrame:
    """Rows without any engagement."""
    return df.where(no_label(binarised))


def positives(df: DataFrame, binarised: bool = False) -> DataFrame:
    """Rows with at least one engagement."""
    return df.where(any_label(binarised))


def engaged(df: DataFrame, target: str, binarised: bool = False) -> DataFrame:
    """Rows with one given engagement."""
    return df.where(present(S.TARGETS[target], binarised))


def by_engagement(df: DataFrame, binarised: bool = False) -> DataFrame:
    """Rows of each engagement, tagged with ``target``; one scan for all four."""
    tags = [F.when(present(label, binarised), F.lit(target)) for target, label in S.TARGETS.items()]
    return df.select(F.explode(F.array_compact(F.array(*tags))).alias("target"), *df.columns)


def trailing_window(df: DataFrame, seconds: int, last: int | None = None) -> DataFrame:
    """Rows younger than ``seconds`` before ``last`` (default: the newest row).

    The newest timestamp is a scalar subquery, evaluated once before the scan.
    """
    newest = F.lit(last) if last is not None else df.select(F.max("tweet_timestamp")).scalar()
    return df.where(F.col("tweet_timestamp") > newest - seconds)


def before(df: DataFrame, split: int) -> DataFrame:
    """Training side of a time split."""
    return df.where(F.col("tweet_timestamp") < split)


def after(df: DataFrame, split: int) -> DataFrame:
    """Test side of a time split. Rows exactly at the split are on neither side."""
    return df.where(F.col("tweet_timestamp") > split)


def by_time_side(df: DataFrame, split: int) -> DataFrame:
    """Both sides of a time split in one scan, tagged ``train`` or ``test``."""
    ts = F.col("tweet_timestamp")
    return df.where(ts != split).withColumn("side", F.when(ts < split, "train").otherwise("test"))
