import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from feedlens.operators import metrics


def brute_ap(pairs):
    positives = sum(y for y, _ in pairs)
    if not positives:
        return None
    total = 0.0
    for threshold in sorted({p for _, p in pairs}, reverse=True):
        at = sum(y for y, p in pairs if p == threshold)
        above = [y for y, p in pairs if p >= threshold]
        total += at / positives * (sum(above) / len(above))
    return total


def brute_log_loss(pairs):
    clip = [(y, min(max(p, 1e-15), 1 - 1e-15)) for y, p in pairs]
    return -sum(y * math.log(p) + (1 - y) * math.log(1 - p) for y, p in clip) / len(pairs)


def brute_rce(pairs):
    rate = sum(y for y, _ in pairs) / len(pairs)
    if rate in (0, 1):
        return None
    return (1 - brute_log_loss(pairs) / brute_log_loss([(y, rate) for y, _ in pairs])) * 100


def frame(spark, groups):
    rows = [(t, y, p) for t, pairs in groups.items() for y, p in pairs]
    return spark.createDataFrame(rows, "target string, y int, p double")


def check(spark, groups, **options):
    found = {r["target"]: r for r in metrics.evaluate(frame(spark, groups), **options).collect()}
    assert set(found) == set(groups)
    for target, pairs in groups.items():
        for name, expected in (("ap", brute_ap(pairs)), ("rce", brute_rce(pairs))):
            actual = found[target][name]
            assert (actual is None) == (expected is None), (target, name)
            assert expected is None or actual == pytest.approx(expected, rel=1e-9, abs=1e-9), (target, name)


SPECIAL = {
    "all ties": [(1, 0.5), (0, 0.5), (0, 0.5)],
    "only positives": [(1, 0.2), (1, 0.9)],
    "no positives": [(0, 0.2), (0, 0.9)],
    "extreme scores": [(1, 1.0), (0, 0.0), (0, 1.0), (1, 0.0)],
    "one row": [(1, 0.3)],
    "perfect": [(1, 0.9), (1, 0.8), (0, 0.1)],
}


@pytest.mark.parametrize("scores_per_range", [1_000_000, 1, 3])
def test_special_cases(spark, scores_per_range):
    check(spark, SPECIAL, scores_per_range=scores_per_range)


@pytest.mark.parametrize("scores_per_range", [1_000_000, 20])
def test_random_scores_with_ties(spark, scores_per_range):
    rng = random.Random(1)
    groups = {
        "even": [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(400)],
        # a third of all rows shares one score, the others crowd next to zero
        "crowded": [(int(rng.random() < 0.1), 0.25 if i % 3 == 0 else rng.random() * 1e-6) for i in range(400)],
    }
    check(spark, groups, scores_per_range=scores_per_range)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0])), min_size=1, max_size=30))
def test_any_small_set(spark, pairs):
    check(spark, {"x": pairs}, scores_per_range=2)


def test_missing_scores_make_the_group_undefined(spark):
    rows = [("a", 1, None), ("a", 0, 0.5), ("a", 1, 0.6), ("b", 1, float("nan")), ("b", 0, 0.1), ("c", None, 0.4), ("d", 1, 0.9), ("d", 0, 0.1)]
    df = spark.createDataFrame(rows, "target string, y int, p double")
    for limit in (1_000_000, 1):
        found = {r["target"]: (r["ap"], r["rce"]) for r in metrics.evaluate(df, scores_per_range=limit).collect()}
        assert found["a"] == found["b"] == found["c"] == (None, None)
        assert found["d"][0] == 1.0


def test_result_does_not_depend_on_partitions(spark, interactions):
    from feedlens.verify.queries import fixed_long

    long = fixed_long(interactions)
    results = []
    for parts, limit in ((1, 1_000_000), (7, 500), (3, 2_000)):
        rows = metrics.evaluate(long.repartition(parts), scores_per_range=limit).collect()
        results.append(sorted((r["target"], round(r["ap"], 6), round(r["rce"], 6)) for r in rows))
    assert results[0] == results[1] == results[2]


def test_log_loss_and_rate(spark):
    pairs = [(1, 0.9), (0, 0.2), (0, 0.0), (1, 1.0)]
    row = metrics.log_loss(frame(spark, {"x": pairs})).first()
    assert row["ctr"] == 0.5 and row["log_loss"] == pytest.approx(brute_log_loss(pairs))
    assert metrics.click_rate(frame(spark, {"x": pairs})).first()["ctr"] == 0.5
    assert metrics.relative_cross_entropy(frame(spark, {"x": pairs})).first()["rce"] == pytest.approx(brute_rce(pairs))


def test_fold_summaries_use_population_deviation(spark):
    rows = [(f, "test", t, ap, rce) for f, t, ap, rce in [(0, "like", 0.2, 10.0), (1, "like", 0.4, 20.0), (0, "reply", 0.6, 30.0), (1, "reply", 0.6, 30.0)]]
    df = spark.createDataFrame(rows, "fold int, split string, target string, ap double, rce double")
    like = metrics.fold_summary(df).where("target = 'like'").first()
    assert like["ap_mean"] == pytest.approx(0.3) and like["ap_sigma"] == pytest.approx(0.1)
    assert like["rce_lb"] == pytest.approx(10) and like["rce_ub"] == pytest.approx(20)
    pooled = metrics.mean_metrics(df).first()
    mean = (0.2 + 0.4 + 0.6 + 0.6) / 4
    assert pooled["map_mean"] == pytest.approx(mean)
    assert pooled["map_sigma"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in (0.2, 0.4, 0.6, 0.6)) / 4))


def test_predictions_join_on_the_key(spark):
    predictions = spark.createDataFrame([("t1", "u1", 0.1, 0.2, 0.3, 0.4), ("t2", "u2", 0.5, 0.6, 0.7, 0.8)], "tweet_id string, engaging_user_id string, reply double, retweet double, retweet_with_comment double, like double")
    labels = spark.createDataFrame([("t2", "u2", True, False, False, True), ("t3", "u3", True, True, True, True)], "tweet_id string, engaging_user_id string, reply boolean, retweet boolean, retweet_with_comment boolean, like boolean")
    rows = metrics.join_predictions(predictions, labels).collect()
    assert len(rows) == 1 and rows[0]["predicted_like"] == 0.8 and rows[0]["like"] == 1 and rows[0]["retweet"] == 0
    long = sorted(tuple(r) for r in metrics.to_long(metrics.join_predictions(predictions, labels)).collect())
    assert long == [("like", 1, 0.8), ("reply", 1, 0.5), ("retweet", 0, 0.6), ("retweet_with_comment", 0, 0.7)]
