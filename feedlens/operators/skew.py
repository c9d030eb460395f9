"""Equi-joins that keep a hot key from ending up in a single task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of all rows, so about 1000 keys can be hot.
HOT_SHARE = 1 / 1000
#: Rows of one key that a task copes with; a hot key is split into pieces of
#: about so many, however many pieces that makes.
PIECE_ROWS = 1_000_000
#: Rows looked at to find the hot keys.
SAMPLE_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, rows: int, share: float = HOT_SHARE, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Keys that hold more than about ``share`` of ``rows``, with their estimated rows.

    Estimated from a sample, which at these shares finds every key that matters.
    The length of the list is bounded by ``1/share`` whatever the data size. It
    is fixed before the join is planned: both sides, and every retried task,
    see the same list.
    """
    fraction = min(1.0, sample_rows / max(rows, 1))
    sample = df.select(key).where(F.col(key).isNotNull())
    if fraction < 1:
        sample = sample.sample(False, fraction, seed=0)
    counts = sample.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return {row[key]: row["n"] / fraction for row in counts.where(F.col("n") > share * rows * fraction).collect()}


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    key: str | list[str],
    spread: list[str],
    how: str = "left",
    rows: int | None = None,
    share: float = HOT_SHARE,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Join ``left`` to ``right``, which holds each key once.

    Rows of a hot key are spread over pieces of about ``piece_rows`` by the hash
    of the ``spread`` columns, rows without a key likewise; the hot rows of
    ``right`` are repeated for every piece. Which keys are taken for hot affects the speed only: any
    list gives the rows of the plain join. ``how`` is left, inner or left_semi.
    Without a key of more than one piece this is the plain join. Several key
    columns, which need the same types on both sides, are told apart by a hash;
    two keys with one hash are both split.
    """
    if rows is None:
        rows = left.count()
    if not isinstance(key, str):
        if rows <= piece_rows:
            return left.join(right, key, how)
        hashed = [df.withColumn("_code", F.xxhash64(*key)) for df in (left, right)]
        return _salted(*hashed, "_code", [*key, "_code"], spread, how, rows, share, piece_rows).drop("_code")
    return _salted(left, right, key, [key], spread, how, rows, share, piece_rows)


def _salted(left: DataFrame, right: DataFrame, key: str, on: list[str], spread: list[str], how: str, rows: int, share: float, piece_rows: int) -> DataFrame:
    """``key`` is the column by which hot keys are known, ``on`` what is joined."""
    found = hot_keys(left, key, rows, share) if rows > piece_rows else {}  # no key has more rows than there are
    pieces = {k: math.ceil(n / piece_rows) for k, n in found.items() if n > piece_rows}
    if not pieces:
        return left.join(right, on, how)
    of_key = F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair])
    number = F.when(F.col(key).isin(list(pieces)), F.element_at(of_key, F.col(key)))
    no_key = F.when(F.col(key).isNull(), F.lit(math.ceil(rows / piece_rows)))
    piece = F.pmod(F.xxhash64(*spread), F.coalesce(number, no_key, F.lit(1)).cast("long")).cast("int")
    salted_left = left.withColumn("_salt", piece)
    salted_right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(number, F.lit(1)) - 1)))
    return salted_left.join(salted_right, [*on, "_salt"], how).drop("_salt")
