"""Directory checks through the Hadoop file system of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _locate(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its success marker in ``path``."""
    location, fs = _locate(spark, f"{path}/_SUCCESS")
    return fs.exists(location)


def subdirectories(spark: SparkSession, path: str) -> list[str]:
    """Names of the directories directly below ``path``; none if it is missing."""
    location, fs = _locate(spark, path)
    if not fs.exists(location):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(location) if s.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    location, fs = _locate(spark, path)
    return fs.exists(location)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename within one file system; raises ``OSError`` where it does not work."""
    location, fs = _locate(spark, source)
    if not fs.rename(location, _locate(spark, target)[0]):
        raise OSError(f"could not rename {source} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or directory, if it is there."""
    location, fs = _locate(spark, path)
    fs.delete(location, True)


def clear_directory(spark: SparkSession, path: str) -> None:
    """Remove the contents of a cache directory; dotfiles and the directory stay."""
    location, fs = _locate(spark, path)
    if fs.exists(location):
        for status in fs.listStatus(location):
            if not status.getPath().getName().startswith("."):
                fs.delete(status.getPath(), True)


def dataset_fingerprint(spark: SparkSession, path: str | list[str]) -> str:
    """Identity of a stored dataset from names, sizes and times of its files.

    The file contents are not read, and the listing is reduced on the executors.
    """
    files: DataFrame = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    row = files.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.coalesce(F.bit_xor(F.xxhash64("path", "modificationTime", "length")), F.lit(0)).alias("mix"),
    ).first()
    return f"{row['n']}-{row['bytes']}-{row['mix'] & 0xFFFFFFFFFFFFFFFF:016x}"
