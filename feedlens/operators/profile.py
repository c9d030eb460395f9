"""Exploratory statistics: engagement profile and hourly series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions import columns as C
from feedlens.operators.projections import interaction_rows


def engagement_profile(df: DataFrame, binarised: bool = False) -> DataFrame:
    """Row count and the six shares in percent, from one aggregate."""
    total = F.count(F.lit(1))

    def share(condition):
        return C.percentage(F.count_if(condition), total)

    return df.agg(
        total.alias("rows"),
        share(C.filled(F.col("hashtags"))).alias("with_hashtags_pct"),
        share(C.no_label(binarised)).alias("negative_pct"),
        *[share(C.present(c, binarised)).alias(f"{t}_pct") for t, c in S.TARGETS.items()],
    )


def hourly_counts(df: DataFrame) -> DataFrame:
    """Engagements per (UTC ``dd-HH``, type).

    Groups by an integer code, so the shuffle carries one small partial row per
    code and type from each task and text is formatted per group only.
    """
    code = C.day_hour_code(F.col("timestamp"))
    counts = interaction_rows(df).groupBy(code.alias("code"), "type").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(C.day_hour_text(F.col("code")).alias("date"), "type", "count")


def full_hour_counts(df: DataFrame) -> DataFrame:
    """Engagements per (start of the full hour in unix seconds, type)."""
    hour = C.hour_start(F.col("timestamp"))
    return interaction_rows(df).groupBy(hour.alias("hour"), "type").agg(F.count(F.lit(1)).alias("count"))


def series_by_type(counts: DataFrame) -> DataFrame:
    """The hourly series ordered by type and date."""
    return counts.orderBy("type", "date")


def hourly_pivot(counts: DataFrame) -> DataFrame:
    """One aligned count column per type."""
    return counts.groupBy("date").pivot("type", list(S.SHORT_TYPES.values())).sum("count")


def grid_completeness(counts: DataFrame, days: int) -> DataFrame:
    """Whether every (hour, type) cell of the period occurs."""
    expected = days * 24 * len(S.SHORT_TYPES)
    groups = F.count(F.lit(1))
    return counts.agg(groups.alias("groups"), F.lit(expected).alias("expected"), (groups == expected).alias("complete"))


def top_hours(counts: DataFrame, n: int = 10) -> DataFrame:
    """The busiest (hour, type) groups; ties by date and type."""
    return counts.orderBy(F.desc("count"), "date", "type").limit(n)
