"""The interaction table: one row per (tweet, viewing user) pair.

Everything below is a fixed value of the data format: column names, their file
order and their types.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Byte that separates the fields of a text line.
FIELD_SEPARATOR = "\x01"
#: Character that separates the items of a list-valued field.
LIST_SEPARATOR = "\t"

#: The row key, carried by every derived table.
KEYS = ["tweet_id", "engaging_user_id"]

INPUT_FIELDS = [
    T.StructField("text_tokens", T.StringType()),
    T.StructField("hashtags", T.StringType()),
    T.StructField("tweet_id", T.StringType()),
    T.StructField("present_media", T.StringType()),
    T.StructField("present_links", T.StringType()),
    T.StructField("present_domains", T.StringType()),
    T.StructField("tweet_type", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("tweet_timestamp", T.LongType()),
    T.StructField("engaged_with_user_id", T.StringType()),
    T.StructField("engaged_with_user_follower_count", T.LongType()),
    T.StructField("engaged_with_user_following_count", T.LongType()),
    T.StructField("engaged_with_user_is_verified", T.BooleanType()),
    T.StructField("engaged_with_user_account_creation", T.LongType()),
    T.StructField("engaging_user_id", T.StringType()),
    T.StructField("engaging_user_follower_count", T.LongType()),
    T.StructField("engaging_user_following_count", T.LongType()),
    T.StructField("engaging_user_is_verified", T.BooleanType()),
    T.StructField("engaging_user_account_creation", T.LongType()),
    T.StructField("engagee_follows_engager", T.BooleanType()),
]

LABEL_FIELDS = [
    T.StructField("reply_timestamp", T.LongType()),
    T.StructField("retweet_timestamp", T.LongType()),
    T.StructField("retweet_with_comment_timestamp", T.LongType()),
    T.StructField("like_timestamp", T.LongType()),
]

#: Types a stored sample is cast to: integers are 32 bits wide there.
SAMPLE_TYPES = {
    f.name: T.IntegerType() if isinstance(f.dataType, T.LongType) else f.dataType for f in INPUT_FIELDS + LABEL_FIELDS
}

#: Item type of the list-valued fields.
LIST_FIELDS = {
    "text_tokens": T.LongType(),
    "hashtags": T.StringType(),
    "present_media": T.StringType(),
    "present_links": T.StringType(),
    "present_domains": T.StringType(),
}

#: The four engagement targets and the label column each is derived from.
TARGETS = {
    "reply": "reply_timestamp",
    "retweet": "retweet_timestamp",
    "retweet_with_comment": "retweet_with_comment_timestamp",
    "like": "like_timestamp",
}
TARGET_NAMES = list(TARGETS)
LABELS = list(TARGETS.values())

#: Short type names used by the hourly series.
SHORT_TYPES = {
    "reply_timestamp": "reply",
    "retweet_timestamp": "rt",
    "retweet_with_comment_timestamp": "rt_com",
    "like_timestamp": "like",
}

#: Edge types of the engagement graph.
EDGE_TYPES = {
    "reply_timestamp": 1,
    "retweet_timestamp": 2,
    "retweet_with_comment_timestamp": 3,
    "like_timestamp": 4,
}

#: Seven columns that hold unix seconds.
TIMESTAMP_COLUMNS = [
    "tweet_timestamp",
    "engaged_with_user_account_creation",
    "engaging_user_account_creation",
    *LABELS,
]

#: Columns the baseline classifiers learn from.
MODEL_FEATURES = [
    "engaged_with_user_follower_count",
    "engaged_with_user_following_count",
    "engaging_user_follower_count",
    "engaging_user_following_count",
]

INPUT_COLUMNS = [f.name for f in INPUT_FIELDS]
ALL_COLUMNS = INPUT_COLUMNS + LABELS


def interaction_schema(labelled: bool = True) -> T.StructType:
    """The 24-column schema, or its first 20 columns for unlabelled data."""
    return T.StructType(INPUT_FIELDS + (LABEL_FIELDS if labelled else []))


def prediction_schema() -> T.StructType:
    """Row key followed by one float score per target, all non-null."""
    return T.StructType(
        [T.StructField(k, T.StringType(), False) for k in KEYS]
        + [T.StructField(t, T.FloatType(), False) for t in TARGET_NAMES]
    )
