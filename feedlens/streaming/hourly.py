"""Hourly engagement counts on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedlens.operators.projections import interaction_rows
from feedlens.sources.paths import exists

#: Columns of stored counts.
COUNTS = "hour bigint, type string, count bigint"


def hourly_windows(df: DataFrame, lateness: str | None = None) -> DataFrame:
    """Engagements per (hour, type).

    Works on streams and on tables. With ``lateness`` a stream drops the state
    of an hour once the watermark passes its end, and rows that come later;
    without, it keeps four counts per hour and misses no row.
    """
    events = interaction_rows(df).select(F.timestamp_seconds("timestamp").alias("ts"), "type")
    if lateness is not None:
        events = events.withWatermark("ts", lateness)
    counted = events.groupBy(F.window("ts", "1 hour"), "type").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.unix_seconds(F.col("window.start")).alias("hour"), "type", "count")


def stream_hourly_counts(stream: DataFrame, out: str, checkpoint: str, lateness: str | None = None) -> StreamingQuery:
    """Store the counts that each batch changed until the input is used up.

    Open hours are stored as well. A batch replaces its own directory, so one
    that is run again after a failure leaves no second copy. Read the result
    with :func:`read_hourly_counts`.
    """

    def store(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return (
        hourly_windows(stream, lateness)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def read_hourly_counts(spark: SparkSession, out: str) -> DataFrame:
    """The newest count per (hour, type); counts only grow, so it is the largest."""
    stored = spark.read.schema(f"{COUNTS}, batch bigint").parquet(out)
    return stored.groupBy("hour", "type").agg(F.max("count").alias("count"))


def stream_hour_parts(stream: DataFrame, out: str, checkpoint: str, lateness: int) -> StreamingQuery:
    """Store the counts of every batch by itself, with no state, and mark late ones.

    A count is late if its hour had ended ``lateness`` seconds or more before the
    newest engagement of the batches before. Late counts are kept beside the
    others, so no row is lost whatever the order of the files. A batch looks at
    batches with smaller numbers only and replaces its own directory: run again
    after a failure, it stores the same rows.
    """

    def store(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        newest = None
        if batch and exists(spark, out):
            newest = _hour_parts(spark, out).where(F.col("batch") < batch).agg(F.max("newest")).first()[0]
        events = interaction_rows(rows).select((F.floor(F.col("timestamp") / 3600) * 3600).alias("hour"), "type", "timestamp")
        counted = events.groupBy("hour", "type").agg(F.count(F.lit(1)).alias("count"), F.max("timestamp").alias("newest"))
        late = F.lit(False) if newest is None else F.col("hour") + 3600 + lateness <= newest
        counted.select("hour", "type", "count", "newest", late.alias("late")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _hour_parts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{COUNTS}, newest bigint, late boolean, batch bigint").parquet(out)


def read_hour_parts(spark: SparkSession, out: str) -> DataFrame:
    """``hour, type, count, late_count``: all engagements, and those that came late."""
    late = F.sum(F.when(F.col("late"), F.col("count")).otherwise(0))
    return _hour_parts(spark, out).groupBy("hour", "type").agg(F.sum("count").alias("count"), late.alias("late_count"))
