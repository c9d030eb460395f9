"""Outputs appear whole, and failures leave the earlier one."""

import os

import pytest

from feedlens import schema as S
from feedlens.plans import jobs
from feedlens.plans.feature_store import FeatureStore, contract_report, key_print
from feedlens.plans.registry import Registry
from feedlens.sources import publish


def files(path):
    return sorted(f for f in os.listdir(path) if not f.startswith(("_", ".")))


def test_error_keeps_the_earlier_output(spark, tmp_path):
    out = str(tmp_path / "out")
    with publish.staged(spark, out) as staging:
        spark.range(5).write.parquet(staging)
        assert not os.path.exists(out)
    first = files(out)
    with pytest.raises(RuntimeError), publish.staged(spark, out) as staging:
        spark.range(9).write.parquet(staging)
        raise RuntimeError("check failed")
    assert files(out) == first and spark.read.parquet(out).count() == 5
    with publish.staged(spark, out) as staging:
        spark.range(9).write.parquet(staging)
    assert spark.read.parquet(out).count() == 9
    assert os.listdir(tmp_path) == ["out"]


def test_failed_rename_puts_the_earlier_output_back(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    spark.range(5).write.parquet(out)
    real = publish.rename

    def refuse(session, source, target):
        if ".staging-" in source:
            raise OSError("refused")
        real(session, source, target)

    monkeypatch.setattr(publish, "rename", refuse)
    with pytest.raises(OSError, match="refused"), publish.staged(spark, out) as staging:
        spark.range(9).write.parquet(staging)
    assert spark.read.parquet(out).count() == 5
    assert os.listdir(tmp_path) == ["out"]


def test_inference_with_missing_predictions_keeps_the_earlier_ones(spark, table, tmp_path, monkeypatch):
    from feedlens.sources.writers import write_delimited

    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    write_delimited(table({"tweet_id": "a"}, {"tweet_id": "b"}).select(*S.INPUT_COLUMNS), f"{data}/part-0")
    score = {t: 0.5 for t in S.TARGET_NAMES}
    predicted = lambda raw, *_: raw.selectExpr(*S.KEYS, *[f"{p} AS {t}" for t, p in score.items()])
    monkeypatch.setattr(jobs, "score_unlabelled", predicted)
    assert jobs.batch_inference(spark, f"{data}/part-0", None, out) == 2
    before = files(out)
    monkeypatch.setattr(jobs, "score_unlabelled", lambda raw, *_: predicted(raw).where("tweet_id = 'a'"))
    with pytest.raises(ValueError, match="2 rows read but 1"):
        jobs.batch_inference(spark, f"{data}/part-0", None, out)
    assert files(out) == before and spark.read.csv(out).count() == 2


def store_with(raw, feature):
    registry = Registry()
    registry.feature()(feature)
    return FeatureStore(raw, [feature.__name__], registry=registry).dataset()


def test_foreign_keys_are_refused(table):
    raw = table({"tweet_id": "a"}, {"tweet_id": "b"}, {"tweet_id": "c"})

    def shifted(raw_data, features, auxiliaries):
        return raw_data.selectExpr("concat('x', tweet_id) AS tweet_id", "engaging_user_id", "1 AS v")

    def right(raw_data, features, auxiliaries):
        return raw_data.selectExpr(*S.KEYS, "1 AS v")

    assert store_with(raw, right).count() == 3
    with pytest.raises(ValueError, match="'missing_keys': 3, 'foreign_keys': 3"):
        store_with(raw, shifted)
    with pytest.raises(ValueError, match="'surplus_rows': 1"):
        store_with(table({"tweet_id": "a"}, {"tweet_id": "a"}), right)
    with pytest.raises(ValueError, match="'missing_keys': 1, 'foreign_keys': 1"):
        store_with(table({"tweet_id": "a"}, {"tweet_id": None}), right)


def test_contract_counts_and_prints(table):
    raw = table({"tweet_id": "a"}, {"tweet_id": "b"}, {"tweet_id": "c"})
    other = table({"tweet_id": "a"}, {"tweet_id": "a"}, {"tweet_id": "z"})
    assert tuple(contract_report(raw, other).first()) == (3, 3, 1, 2, 1, False)
    assert tuple(contract_report(raw.limit(0), raw.limit(0)).first()) == (0, 0, 0, 0, 0, True)
    assert key_print(raw) == key_print(raw.orderBy("tweet_id", ascending=False).repartition(2))
    assert key_print(raw) != key_print(other)
