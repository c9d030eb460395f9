"""Scalar expressions shared by the operators."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens import schema as S


def present(name: str, binarised: bool = False) -> Column:
    """True where a field carries a value.

    ``binarised`` reads label columns that were already turned into 0/1, where
    the 0 stands for "did not happen" instead of a missing timestamp.
    """
    column = F.col(name)
    if binarised:
        return F.coalesce(column != 0, F.lit(False))
    return column.isNotNull()


def any_label(binarised: bool = False) -> Column:
    """True for a positive sample. A plain OR of null tests, which the parquet
    reader accepts as a pushed filter (a ``coalesce`` would not be pushed)."""
    return reduce(or_, [present(c, binarised) for c in S.LABELS])


def no_label(binarised: bool = False) -> Column:
    """True for a negative sample: none of the four engagements happened."""
    return reduce(and_, [~present(c, binarised) for c in S.LABELS])


def filled(column: Column) -> Column:
    """Non-empty test on text; false for null. The reader accepts it as a pushed filter."""
    return column.isNotNull() & (column != "")


def percentage(part: Column, total: Column) -> Column:
    """Share in percent; null over an empty table."""
    return F.try_divide(part, total) * F.lit(100.0)


def split_fields(line: Column) -> Column:
    """Outer-trimmed text line to its fields; trailing empty fields stay."""
    return F.split(F.btrim(line, F.lit(" \t\r\n\x0b\x0c")), S.FIELD_SEPARATOR, -1)


def typed_list(name: str) -> Column:
    """Tab-separated field to an array of its item type; null stays null."""
    items = F.split(F.col(name), S.LIST_SEPARATOR)
    item_type = S.LIST_FIELDS[name]
    if isinstance(item_type, T.StringType):
        return items
    return items.try_cast(T.ArrayType(item_type))


def day_hour_code(seconds: Column) -> Column:
    """Unix seconds to ``day-of-month * 24 + hour`` in UTC.

    Works on day and second counts, so it neither depends on the session time
    zone nor formats text per row; group by the code, then format the groups.
    """
    day = F.dayofmonth(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")))
    return day * 24 + F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int")


def day_hour_text(code: Column) -> Column:
    """Inverse of :func:`day_hour_code` as ``dd-HH``."""
    day = F.floor(code / 24).cast("string")
    hour = F.pmod(code, F.lit(24)).cast("string")
    return F.concat(F.lpad(day, 2, "0"), F.lit("-"), F.lpad(hour, 2, "0"))


def hour_start(seconds: Column) -> Column:
    """Start of the full hour as unix seconds; keeps month and year apart."""
    return F.floor(seconds / 3600) * 3600


def hash_bits(seed: Column, keys: list[str] = S.KEYS) -> Column:
    """First 32 bits of ``md5(key|…|seed)`` as eight hexadecimal digits."""
    return F.substring(F.md5(F.concat_ws("|", *[F.col(k) for k in keys], seed.cast("string"))), 1, 8)


def hash_bound(fraction: float) -> str:
    """Digits that the bits of a kept row stay below.

    Fixed-width digits order like the numbers, which saves a conversion per
    row. "g" follows every digit and keeps all rows.
    """
    bound = max(0, math.ceil(fraction * 2**32))
    return "g" if bound >= 2**32 else f"{bound:08x}"


def in_hash_sample(fraction: float, seed: int, keys: list[str] = S.KEYS) -> Column:
    """Reproducible Bernoulli draw by row key: bits below ``fraction * 2**32``.

    Depends on key and seed only, so it survives repartitioning and retries.
    """
    return hash_bits(F.lit(seed), keys) < F.lit(hash_bound(fraction))


#: Scores closer than this to 0 or 1 are clipped before taking logarithms.
LOG_LOSS_EPSILON = 1e-15


def log_loss_term(label: Column, score: Column) -> Column:
    """Log loss of one row for a 0/1 label."""
    p = F.greatest(F.least(score, F.lit(1.0 - LOG_LOSS_EPSILON)), F.lit(LOG_LOSS_EPSILON))
    return -(label * F.ln(p) + (1 - label) * F.ln(1 - p))


def constant_log_loss(rate: Column) -> Column:
    """Mean log loss of always predicting the positive share itself.

    Null where only one class occurs: the ratio built on it is undefined there.
    """
    mixed = (rate > 0) & (rate < 1)
    return F.when(mixed, -(rate * F.ln(rate) + (1 - rate) * F.ln(1 - rate)))


def follower_score() -> Column:
    """Fixed logistic score over the two follower counts, six decimals."""
    z = (
        F.lit(-1.0)
        + F.lit(0.1) * F.ln(1 + F.col("engaging_user_follower_count"))
        - F.lit(0.05) * F.ln(1 + F.col("engaged_with_user_follower_count"))
    )
    return F.round(1 / (1 + F.exp(-z)), 6)
