"""Intermediate tables that outlive the executors which computed them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from feedlens.sources.paths import delete

#: Scratch folder of local sessions that set none.
LOCAL_ROOT = "file:///tmp/checkpoints/feedlens"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session without that setting gets ``LOCAL_ROOT``; on a cluster
    a missing setting is an error, because a folder of one machine would not be
    readable from the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return LOCAL_ROOT


#: Scratch paths handed out by this process outside ``job_scratch``, and inside.
_handed_out: list[str] = []
_of_job: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    own = _of_job.get()
    (_handed_out if own is None else own).append(path)
    return path


@contextmanager
def job_scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside at its end, also after an error.

    Results must be stored or collected inside. A job frees its own tables only,
    not those of jobs around it or in other threads.
    """
    own: list[str] = []
    token = _of_job.set(own)
    try:
        yield
    finally:
        _of_job.reset(token)
        while own:
            delete(spark, own.pop())


def release_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this process that no ``job_scratch`` owns,
    once their results are stored."""
    while _handed_out:
        delete(spark, _handed_out.pop())


def durable(df: DataFrame, label: str = "table", path: str | None = None, partition_by: list[str] = ()) -> DataFrame:
    """Write ``df`` as parquet and continue from the files.

    Cuts the lineage like a checkpoint does, and in addition keeps columns
    prunable and gives the optimiser real sizes for its join choices. Filters on
    ``partition_by`` columns read the matching directories only.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, label)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return spark.read.schema(df.schema).parquet(target).select(*df.columns)
