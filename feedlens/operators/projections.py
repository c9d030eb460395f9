"""Targets, zero-filling, user and edge projections, long form of the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions.columns import present


def target_columns(binarised: bool = False) -> dict[str, Column]:
    """The four boolean targets as expressions."""
    return {target: present(label, binarised) for target, label in S.TARGETS.items()}


def binarize_targets(df: DataFrame, binarised: bool = False) -> DataFrame:
    """Row key and the four boolean targets."""
    return df.select(*S.KEYS, *[c.alias(t) for t, c in target_columns(binarised).items()])


def labels_to_flags(df: DataFrame) -> DataFrame:
    """Replace label timestamps by 0/1 in place."""
    return df.withColumns({label: present(label).cast("int") for label in S.LABELS})


def zero_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Overwrite columns with the zero of their type, keeping the schema."""
    types = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: F.lit(0).cast(types[c]) for c in columns})


def targets_to_int(df: DataFrame) -> DataFrame:
    """Boolean targets to 0/1 integers."""
    return df.withColumns({t: F.col(t).cast("int") for t in S.TARGET_NAMES})


def prefix_predictions(df: DataFrame, prefix: str = "predicted_") -> DataFrame:
    """Rename the score columns so they can sit next to the targets."""
    return df.withColumnsRenamed({t: prefix + t for t in S.TARGET_NAMES})


def file_order(df: DataFrame, labelled: bool = True) -> DataFrame:
    """Columns in file order."""
    return df.select(*(S.ALL_COLUMNS if labelled else S.INPUT_COLUMNS))


#: Vertex attributes, as named in the user columns of either role. Fixed values of the format.
VERTEX_ATTRIBUTES = ["id", "follower_count", "following_count", "is_verified", "account_creation"]


def _user(role: str) -> list[Column]:
    return [F.col(f"{role}_user_{name}").alias(name) for name in VERTEX_ATTRIBUTES]


def engaged_with_users(df: DataFrame) -> DataFrame:
    """Authors with the vertex schema, one row per input row."""
    return df.select(*_user("engaged_with"))


def engaging_users(df: DataFrame) -> DataFrame:
    """Viewers with the vertex schema, one row per input row."""
    return df.select(*_user("engaging"))


def both_users(df: DataFrame) -> DataFrame:
    """Authors and viewers of every row, from a single scan."""
    return df.select(F.inline(F.array(F.struct(*_user("engaged_with")), F.struct(*_user("engaging")))))


#: Tweet columns an edge carries along. Fixed values of the format.
EDGE_TWEET_COLUMNS = [
    "text_tokens",
    "hashtags",
    "tweet_id",
    "present_media",
    "present_links",
    "present_domains",
    "tweet_type",
    "language",
    "tweet_timestamp",
]


def edge_projection(df: DataFrame) -> DataFrame:
    """Viewer to author, with the follow flag and the tweet columns that ``df`` has."""
    return df.select(
        F.col("engaging_user_id").alias("src"),
        F.col("engaged_with_user_id").alias("dst"),
        F.col("engagee_follows_engager").alias("dst_follows_src"),
        *[c for c in EDGE_TWEET_COLUMNS if c in df.columns],
        *S.LABELS,
    )


def labels_to_rows(df: DataFrame, ids: list[str], names: dict[str, str], type_column: str, time_column: str) -> DataFrame:
    """Unpivot the label timestamps that are set: one row per engagement.

    One scan for all four types; ``names`` maps a label column to its type.
    """
    named = df.select(*ids, *[F.col(label).alias(name) for label, name in names.items()])
    long = named.unpivot(ids, list(names.values()), type_column, time_column)
    return long.where(F.col(time_column).isNotNull())


def interaction_rows(df: DataFrame) -> DataFrame:
    """Zero to four ``(timestamp, type)`` rows per input row."""
    return labels_to_rows(df, [], S.SHORT_TYPES, "type", "timestamp").select("timestamp", "type")
