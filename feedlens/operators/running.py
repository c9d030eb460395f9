"""Running counts as of a time, without one task per user."""

from __future__ import annotations

from math import ceil, inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlens.sources.durable import durable

#: Distinct moments per time range; a window holds those of one user in one range.
MOMENTS_PER_RANGE = 1_000_000


def time_ranges(df: DataFrame, time: str, rows: int, per_range: int = MOMENTS_PER_RANGE) -> list[int]:
    """Bounds between ranges of about ``per_range`` rows each, increasing."""
    parts = ceil(rows / per_range)
    if parts < 2:
        return []
    quantiles = df.stat.approxQuantile(time, [i / parts for i in range(1, parts)], 0.25 / parts)
    return sorted({int(q) for q in quantiles})


def with_range(df: DataFrame, time: str, bounds: list[int]) -> DataFrame:
    """Adds ``range``, the number of bounds that are not above the time."""
    splits = [-inf, *map(float, bounds), inf]
    if not bounds:
        return df.withColumn("range", F.lit(0.0))
    moments = df.withColumn("_time", F.col(time).cast("double"))
    return Bucketizer(splits=splits, inputCol="_time", outputCol="range").transform(moments).drop("_time")


def older_events(events: DataFrame, asked: DataFrame, by: list[str], time: str, per_range: int = MOMENTS_PER_RANGE) -> DataFrame:
    """``by``, ``time``, ``older`` per distinct moment of ``asked``: the events of
    the same ``by`` strictly before it. Nulls are never asked, nor counted.

    Events and questions are combined per moment, so any number of rows at one
    time is one entry. Time is cut into ranges of as many entries each: a window
    sums inside one range of one user, and only the totals of the ranges are summed
    over a user's whole time. A user with a third of all rows is thus dealt over
    all ranges.
    """
    n, is_asked = F.lit(1).cast("long"), F.lit(False)
    marks = events.select(*by, time, n.alias("n"), is_asked.alias("asked")).unionByName(
        asked.select(*by, time, F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    )
    whole = marks.dropna(subset=[*by, time]).groupBy(*by, time).agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    moments = durable(whole, "moments")
    bounds = time_ranges(moments, time, moments.count(), per_range)
    ranged = with_range(moments, time, bounds)
    before = [W.unboundedPreceding, -1]
    inside = F.sum("n").over(W.partitionBy(*by, "range").orderBy(time).rowsBetween(*before))
    within = ranged.withColumn("inside", inside).where("asked")
    zero = F.lit(0).cast("long")
    if not bounds:
        return within.select(*by, time, F.coalesce("inside", zero).alias("older"))
    totals = ranged.groupBy(*by, "range").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(W.partitionBy(*by).orderBy("range").rowsBetween(*before))
    totals = totals.select(*by, "range", earlier.alias("earlier"))
    return within.join(totals, [*by, "range"]).select(*by, time, (F.coalesce("inside", zero) + F.coalesce("earlier", zero)).alias("older"))
