"""Bernoulli and key-hash samples, fold building and the sample generator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions.columns import hash_bits, hash_bound, in_hash_sample
from feedlens.operators import filters, projections
from feedlens.operators.membership import bloom_filter, maybe_member
from feedlens.operators.skew import salted_lookup
from feedlens.sources.durable import durable
from feedlens.sources.readers import cast_fields
from feedlens.sources.writers import write_fold, write_sample


def fraction_for(rows: int, total: int) -> float:
    """Sampling fraction for about ``rows`` rows, never above 1."""
    return min(1.0, rows / total) if total else 1.0


def bernoulli_sample(df: DataFrame, rows: int, total: int | None = None, seed: int | None = None) -> DataFrame:
    """About ``rows`` rows without replacement; which ones depends on the
    partitioning. Use :func:`hash_sample` for a reproducible draw."""
    if total is None:
        total = df.count()
    return df.sample(False, fraction_for(rows, total), seed)


def hash_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Reproducible Bernoulli sample decided by row key and seed alone."""
    return df.where(in_hash_sample(fraction, seed))


#: Hexadecimal digits of a key hash that one pass of the selection looks at.
DIGITS = 3


def exact_sample(df: DataFrame, rows: int, seed: int, keys: list[str] = S.KEYS) -> DataFrame:
    """``rows`` rows, or all if there are fewer: those with the smallest hashes of
    key and seed, under any partitioning.

    The bound is found digit by digit: every pass counts the rows per next digits
    below the prefix found so far, at most 4096 numbers, and goes on with the digits
    that hold the last wanted row. Rows of the bound's own key are told apart by
    the hash of the whole row.
    """
    if rows <= 0:
        return df.limit(0)
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", *[F.col(k) for k in keys], F.lit(str(seed)))))
    prefix, wanted = "", rows
    while len(prefix) < 32:
        within = hashed.where(F.col("_hash").startswith(prefix)) if prefix else hashed
        width = min(DIGITS, 32 - len(prefix))
        counts = within.groupBy(F.substring("_hash", len(prefix) + 1, width).alias("digits")).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(counts):
            if row["n"] >= wanted:
                break
            wanted -= row["n"]
        else:
            return df
        prefix += row["digits"]
        if row["n"] == wanted:  # all rows below this prefix, too
            return hashed.where(F.col("_hash") < prefix + "g").drop("_hash")
    below = hashed.where(F.col("_hash") < prefix)
    same = hashed.where(F.col("_hash") == prefix).orderBy(F.xxhash64(*df.columns)).limit(wanted)
    return below.unionByName(same).drop("_hash")


@dataclass(frozen=True)
class FoldPlan:
    """Sizes and seeds of the train/test pairs; the defaults are fixed values."""

    split: int = 1613602800
    train_rows: int = 1_000_000
    test_rows: int = 200_000
    extra_rows: int = 2_000
    folds: int = 5
    seed: int = 153
    train_seed: int = 42
    test_seed: int = 7357
    extra_seed: int = 466


def _per_fold(df: DataFrame, folds: int) -> DataFrame:
    """Every row once per fold. Meant to be filtered by a draw right away: both
    steps run in one generated loop, so only drawn copies are materialised."""
    return df.select(F.explode(F.array(*[F.lit(i) for i in range(folds)])).alias("fold"), *df.columns)


@dataclass(frozen=True)
class Folds:
    """All train and all test rows, tagged with a 0-based ``fold`` column."""

    train: DataFrame
    test: DataFrame

    def pair(self, fold: int) -> tuple[DataFrame, DataFrame]:
        return tuple(df.where(F.col("fold") == fold).drop("fold") for df in (self.train, self.test))

    def stored(self) -> "Folds":
        """With the test rows written once; a pair then reads its own files only."""
        return Folds(self.train, durable(self.test, "test", partition_by=["fold"]))


def build_folds(df: DataFrame, plan: FoldPlan, **skew) -> Folds:
    """Train and test samples of every fold.

    Train rows are drawn before the split time. Test rows are drawn after it
    from users that occur in the fold's train sample, plus a few rows of any
    user; duplicates between both draws are removed.

    All folds and both draws share one scan per side. A draw is a filter on the
    row key, so it runs before the user lookup and only drawn rows are shuffled;
    the number of eligible rows, which the test fraction needs, comes from rows
    combined per user. The train samples are stored, as their users are needed
    twice. Drawn rows pass a Bloom filter of these users before they are shuffled,
    and the rows of a hot user are spread. Only two totals, one number per fold and
    the filter, whose size is bounded, reach the driver.
    """
    ts, fold = F.col("tweet_timestamp"), F.col("fold")
    totals = df.agg(F.count_if(ts < plan.split).alias("train"), F.count_if(ts > plan.split).alias("test")).first()
    earlier, later = filters.before(df, plan.split), filters.after(df, plan.split)

    bound = hash_bound(fraction_for(plan.train_rows, totals["train"]))
    drawn = _per_fold(earlier, plan.folds).where(hash_bits(fold + plan.train_seed + plan.seed) < bound)
    train = durable(drawn, "train", partition_by=["fold"])
    user = ["fold", "engaging_user_id"]
    users = durable(train.select(*user).where(F.col("engaging_user_id").isNotNull()).distinct(), "users")

    per_user = later.groupBy("engaging_user_id").agg(F.count(F.lit(1)).alias("n"))
    eligible = per_user.join(users, "engaging_user_id").groupBy("fold").agg(F.sum("n").alias("n")).collect()
    sizes = {row["fold"]: row["n"] for row in eligible}
    bounds = [hash_bound(fraction_for(plan.test_rows, sizes.get(i, 0))) for i in range(plan.folds)]

    in_test = hash_bits(fold + plan.test_seed + plan.seed) < F.element_at(F.array(*map(F.lit, bounds)), fold + 1)
    extra_bound = hash_bound(fraction_for(plan.extra_rows, totals["test"]))
    in_extra = hash_bits(fold + plan.extra_seed + plan.seed) < extra_bound
    seen = maybe_member(user, bloom_filter(users, user))
    candidates = _per_fold(later, plan.folds).where((in_test & seen) | in_extra)
    known = users.withColumn("_known", F.lit(True))
    most = plan.folds * (plan.test_rows + plan.extra_rows)
    test = salted_lookup(candidates, known, user, S.KEYS, "left", most, **skew).where((in_test & F.col("_known")) | in_extra)
    return Folds(train, test.select("fold", *df.columns).distinct())


def write_folds(folds: Folds, plan: FoldPlan, root: str) -> list[tuple[str, str]]:
    """Store every pair as text; returns the paths per fold."""
    stored = folds.stored()
    return [write_fold(*stored.pair(i), root, i) for i in range(plan.folds)]


@dataclass(frozen=True)
class SampleSpec:
    """Options of the sample generator; the defaults are fixed values.
    ``window`` in seconds wins over ``rows``."""

    binarise: bool = False
    zero_columns: tuple[str, ...] = ()
    window: int | None = 10_800
    last: int | None = None
    rows: int = 200_000
    seed: int = 42


def generate_sample(df: DataFrame, spec: SampleSpec, total: int | None = None) -> DataFrame:
    """Take a window or a draw, then optionally binarise and zero-fill, and cast.

    Rows are chosen by their stored columns: the time filter reaches the scan,
    and zero-filled keys do not change the draw.
    """
    if spec.window is not None:
        df = filters.trailing_window(df, spec.window, spec.last)
    else:
        df = hash_sample(df, fraction_for(spec.rows, df.count() if total is None else total), spec.seed)
    if spec.binarise:
        df = projections.labels_to_flags(df)
    if spec.zero_columns:
        df = projections.zero_fill(df, list(spec.zero_columns))
    return cast_fields(df, S.SAMPLE_TYPES)


def export_sample(df: DataFrame, spec: SampleSpec, root: str) -> str:
    """Generate a sample and store it under its share of the full table."""
    total = df.count()
    sample = generate_sample(df, spec, total).persist()
    try:
        rows = sample.count() if spec.window is not None else min(spec.rows, total)
        return write_sample(sample, root, rows, total)
    finally:
        sample.unpersist()
