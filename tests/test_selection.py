"""Draws of exact size, proof of order, fits that stop on validation rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.operators import sampling, splits
from feedlens.plans.models import TargetModels


def plain_draw(rows, n, seed):
    digest = lambda r: hashlib.md5("|".join([*(v for v in r if v is not None), str(seed)]).encode()).hexdigest()
    return sorted(rows, key=digest)[:n]


@pytest.mark.parametrize("n", [0, 1, 17, 299, 300, 500])
def test_exact_draw(spark, n):
    rows = [(f"t{i % 97}", f"u{i}" if i % 50 else None) for i in range(300)]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "tweet_id string, engaging_user_id string")
    got = {partitions: sorted(map(str, map(tuple, sampling.exact_sample(df.repartition(partitions), n, 5).collect()))) for partitions in (1, 3)}
    assert got[1] == got[3] == sorted(map(str, plain_draw(rows, n, 5)))


def test_exact_draw_inside_the_copies_of_a_key(spark):
    df = spark.createDataFrame([("t", "u", i % 3) for i in range(30)], "tweet_id string, engaging_user_id string, v int")
    for n in (1, 7, 30, 31):
        assert sampling.exact_sample(df, n, 1).count() == min(n, 30)


def test_order_report(spark):
    rng = random.Random(3)
    rows = [(f"t{rng.randrange(200)}", rng.choice([None, "a", "b", f"u{i}"]), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "tweet_id string, engaging_user_id string, v int").repartition(5)
    assert tuple(splits.order_report(splits.sort_by_key(df)).first()) == (1000, True, True)
    assert tuple(splits.order_report(df).first()) == (1000, False, False)
    inside = df.sortWithinPartitions(*[F.col(k).asc_nulls_last() for k in S.KEYS])
    assert tuple(splits.order_report(inside).first()) == (1000, True, False)
    assert tuple(splits.order_report(df.limit(0)).first()) == (0, True, True)


def test_fit_stops_on_validation_rows(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random(), rng.random() < 0.5) for _ in range(600)]  # nothing to learn
    df = spark.createDataFrame(rows, "a double, b double, like boolean")
    train, valid = df.limit(300), df.subtract(df.limit(300))
    train, valid = train.cache(), valid.cache()
    params = {"maxIter": 8, "maxDepth": 5}
    model = lambda: TargetModels(["a", "b"], ["like"])
    free, stopped = model().fit(train, None, params), model().fit(train, valid, params)
    losses, kept = free.validation_losses(valid)["like"], stopped.validation_losses(valid)["like"]
    assert len(losses) == 8 and len(kept) < 8
    assert kept[-1] <= losses[-1] and kept[-1] == min(kept)
    assert len(model().fit(train, valid.limit(0), params).validation_losses(valid)["like"]) == 8
