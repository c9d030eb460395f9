"""Outputs that appear whole and checked, or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from feedlens.sources.paths import delete, exists, rename


def _beside(path: str, label: str) -> str:
    """A fresh path in the same folder, which readers of that folder skip."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/.{label}-{name}-{uuid.uuid4().hex}"


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Let ``source`` take the place of ``target`` by renames. What was there is
    put back if that fails, and deleted once it has worked."""
    earlier = _beside(target, "earlier") if exists(spark, target) else None
    if earlier:
        rename(spark, target, earlier)
    try:
        rename(spark, source, target)
    except Exception:
        if earlier:
            rename(spark, earlier, target)
        raise
    if earlier:
        delete(spark, earlier)


@contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A path to write to instead of ``path``; it is published when the block
    ends, so check inside. After an error nothing of it is left and an earlier
    output is as it was. A rename is one step on HDFS and local disks; on object
    stores it copies, and readers can meet a part of it."""
    staging = _beside(path, "staging")
    try:
        yield staging
        replace(spark, staging, path)
    finally:
        delete(spark, staging)
