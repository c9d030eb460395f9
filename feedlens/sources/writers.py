"""Sinks: features, auxiliaries, predictions, samples and folds.

All writers keep one file per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from feedlens import schema as S


def write_feature(df: DataFrame, path: str, names: list[str]) -> None:
    """Store one feature or a feature group: row key plus value columns."""
    df.select(*S.KEYS, *names).write.mode("overwrite").parquet(path)


def write_auxiliaries(tables: dict[str, DataFrame], path: str) -> None:
    """Store auxiliary tables, one directory per name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def write_predictions(df: DataFrame, path: str) -> None:
    """Comma-separated scores without header: row key, then one per target that
    was scored, in the order of the targets."""
    columns = [*S.KEYS, *[t for t in S.TARGET_NAMES if t in df.columns]]
    df.select(*columns).write.mode("overwrite").option("header", False).csv(path)


def sample_directory(rows: int, total: int) -> str:
    """Directory name of a sample, by its share of the full table."""
    return f"sample_{rows / total:.4f}" if total else "sample_0.0000"


def write_sample(df: DataFrame, root: str, rows: int, total: int) -> str:
    """Store a sample as parquet below ``root``; returns its path."""
    path = f"{root}/{sample_directory(rows, total)}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_delimited(df: DataFrame, path: str) -> None:
    """0x01-separated text without header, as the text reader expects it."""
    (
        df.write.mode("overwrite")
        .option("sep", S.FIELD_SEPARATOR)
        .option("header", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_fold(train: DataFrame, test: DataFrame, root: str, fold: int) -> tuple[str, str]:
    """Store one train/test pair as text, replacing an earlier one."""
    paths = f"{root}/sample{fold + 1}", f"{root}/sample{fold + 1}_test"
    for df, path in zip((train, test), paths):
        write_delimited(df.select(*S.ALL_COLUMNS), path)
    return paths
