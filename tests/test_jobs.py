import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.operators import projections, sampling
from feedlens.plans import jobs
from feedlens.plans.feature_store import FeatureStore
from feedlens.plans.models import TargetModels, score_batches
from feedlens.sources import readers, writers
from feedlens.sources.durable import durable
from feedlens.verify.queries import degree_model

FAST = {"maxIter": 2, "maxDepth": 2}


@pytest.fixture(scope="module")
def dataset(spark):
    """Likes depend on the viewer's follower count; nobody replies."""
    rows = spark.range(400).selectExpr(
        "concat('t', id) AS tweet_id", "concat('u', id % 40) AS engaging_user_id",
        "id % 7 AS engaged_with_user_follower_count", "id % 5 AS engaged_with_user_following_count",
        "id % 40 AS engaging_user_follower_count", "id % 3 AS engaging_user_following_count",
        "false AS reply", "id % 40 < 10 AS retweet", "true AS retweet_with_comment", "id % 40 > 20 AS like",
    )
    return durable(rows, "dataset")


@pytest.fixture(scope="module")
def model(dataset):
    return TargetModels().fit(dataset, None, FAST)


def test_one_class_targets_become_constants(model, dataset):
    assert model.constants == {"reply": 0.0, "retweet_with_comment": 1.0}
    assert set(model.fitted) == {"retweet", "like"}
    row = model.predict(dataset).first()
    assert row["reply"] == 0.0 and row["retweet_with_comment"] == 1.0


def test_predictions_have_the_declared_schema(model, dataset):
    predictions = model.predict(dataset)
    assert [(f.name, f.dataType) for f in predictions.schema] == [(f.name, f.dataType) for f in S.prediction_schema()]
    plan = predictions._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_keys_travel_with_their_rows(model, dataset):
    scores = {r["tweet_id"]: r["like"] for r in model.predict(dataset.repartition(7)).collect()}
    assert scores == {r["tweet_id"]: r["like"] for r in model.predict(dataset.coalesce(1)).collect()}
    assert scores["t30"] > 0.5 > scores["t3"]


def test_labels_are_not_features(model, dataset):
    flipped = dataset.withColumns({t: ~F.col(t) for t in S.TARGET_NAMES})
    assert sorted(map(tuple, model.predict(flipped).collect())) == sorted(map(tuple, model.predict(dataset).collect()))
    unlabelled = dataset.drop(*S.TARGET_NAMES)
    assert model.predict(unlabelled).count() == 400


def test_missing_feature_values_are_a_value_of_their_own(dataset):
    """Missing exactly where the label is set: the trees have to see it."""
    holes = dataset.withColumn("engaging_user_follower_count", F.expr("if(like, null, engaging_user_follower_count)"))
    holes = holes.withColumn("engaged_with_user_follower_count", F.expr("cast('NaN' AS double)"))
    model = TargetModels(targets=["like"]).fit(holes, None, FAST)
    assert model.evaluate(holes).first()["ap"] == pytest.approx(1.0)


def test_rows_of_one_cell_are_fitted_once_with_their_number(spark, monkeypatch):
    """MLlib gets a row per cell and label, whatever the number of rows, and learns
    the same as from the rows themselves."""
    rows = spark.range(5000).selectExpr("id", "pmod(xxhash64(id, 1), 5) AS a", "pmod(xxhash64(id, 2), 7) AS b")
    rows = rows.selectExpr("a", "b", "(a > 2 OR b = 4) <> (pmod(xxhash64(id, 3), 10) = 0) AS like")
    seen, learn = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, table: seen.append(table.count()) or learn(self, table))
    model = TargetModels(["a", "b"], ["like"]).fit(rows, None, FAST)
    assert seen == [70]
    trees = model.fitted["like"].stages[-1]
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="vector").transform(rows.withColumn("like", F.col("like").cast("double")))
    plain = learn(GBTClassifier(labelCol="like", featuresCol="vector", seed=42, stepSize=0.3, **FAST), vectors)
    assert trees.treeWeights == plain.treeWeights
    losses = plain.evaluateEachIteration(vectors)
    assert model.validation_losses(rows)["like"] == pytest.approx(losses)
    scored = model.score(rows, ["a", "b"]).distinct().collect()
    expected = {(r["a"], r["b"]): r["probability"][1] for r in plain.transform(vectors).select("a", "b", "probability").distinct().collect()}
    assert {(r["a"], r["b"]): r["like"] for r in scored} == pytest.approx(expected, rel=1e-6)


def test_bins_keep_order_and_few_values_apart(spark):
    rows = spark.range(10_000).selectExpr("id % 3 AS a", "if(id % 10 = 0, null, id) AS b", "id % 3 = 1 AS like")
    model = TargetModels(["a", "b"], ["like"])
    bins = model._bins(model._numbers(rows, []), 32)
    found = bins.transform(model._numbers(rows, [])).groupBy("_b0").agg(F.count_distinct("_f0").alias("n")).collect()
    assert sorted(map(tuple, found)) == [(0.0, 1), (1.0, 1), (2.0, 1)]
    ranges = bins.transform(model._numbers(rows, [])).groupBy("_b1").agg(F.min("_f1").alias("lo"), F.max("_f1").alias("hi")).orderBy("_b1").collect()
    assert 25 <= len(ranges) <= 32 and all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:]))


def test_training_on_nothing_gives_constants(dataset):
    model = TargetModels().fit(dataset.where("false"))
    assert model.constants == dict.fromkeys(S.TARGET_NAMES, 0.0) and model.predict(dataset).count() == 400


def test_evaluation(model, dataset):
    found = {r["target"]: r for r in model.evaluate(dataset).collect()}
    assert found["like"]["ap"] > 0.99 and found["like"]["rce"] > 0
    assert found["reply"]["ap"] is None and found["reply"]["rce"] is None
    assert found["retweet_with_comment"]["ap"] == 1.0 and found["retweet_with_comment"]["rce"] is None


def test_save_load_and_log(spark, model, dataset, tmp_path):
    model.save(str(tmp_path / "m"), spark)
    loaded = TargetModels().load_pretrained(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, loaded.predict(dataset).collect())) == sorted(map(tuple, model.predict(dataset).collect()))
    for _ in range(2):
        model.save_to_logs(model.evaluate(dataset), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 8


def test_batch_scoring_with_any_function(dataset):
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        return batch[["tweet_id"]].assign(p=np.sqrt(batch["engaging_user_follower_count"]))

    out = score_batches(dataset.repartition(3), score, "tweet_id string, p double")
    assert out.count() == 400 and out.where("tweet_id = 't9'").first()["p"] == 3.0
    assert "Exchange" not in score_batches(dataset, score, "tweet_id string, p double")._jdf.queryExecution().toString()


def test_train_then_infer_over_all_part_files(spark, interactions, tmp_path):
    interactions.write.parquet(str(tmp_path / "train.parquet"))
    jobs.train(spark, str(tmp_path / "train.parquet"), str(tmp_path / "model"), params=FAST)
    loaded = TargetModels().load_pretrained(spark, str(tmp_path / "model"))

    writers.write_delimited(projections.file_order(interactions, False).repartition(5), str(tmp_path / "in"))
    rows = jobs.batch_inference(spark, str(tmp_path / "in"), loaded, str(tmp_path / "out"))
    assert rows == interactions.count() == spark.read.text(str(tmp_path / "out")).count()
    first = spark.read.csv(str(tmp_path / "out")).first()
    assert len(first) == 6 and first[0].startswith("t") and 0 <= float(first[2]) <= 1


def test_graph_features_from_training_to_inference(spark, interactions, tmp_path):
    path, root = str(tmp_path / "train.parquet"), str(tmp_path / "cache")
    interactions.write.parquet(path)
    jobs.train(spark, path, str(tmp_path / "model"), degree_model(), root, FAST)
    loaded = TargetModels().load_pretrained(spark, str(tmp_path / "model"))
    assert loaded.features[-1] == "engaging_user_out_degree" and loaded.auxiliaries == ["engagement_graph"]
    cache = jobs.training_cache(spark, path, root)
    unlabelled = interactions.select(*S.INPUT_COLUMNS)
    assert jobs.score_unlabelled(unlabelled, loaded, cache).count() == interactions.count()


def test_cross_fold_with_auxiliaries(interactions):
    pair = sampling.build_folds(interactions, sampling.FoldPlan(split=893137754, train_rows=1000, test_rows=400, folds=1)).pair(0)
    rows = jobs.cross_fold_evaluation([pair], FAST, degree_model).collect()
    assert len(rows) == 8 and all(r["ap"] is not None for r in rows if r["target"] == "like")


def test_cross_fold_evaluation_and_summary(interactions):
    plan = sampling.FoldPlan(split=893137754, train_rows=1500, test_rows=600, extra_rows=50, folds=2)
    folds = sampling.build_folds(interactions, plan)
    rows = durable(jobs.cross_fold_evaluation([folds.pair(i) for i in range(2)], FAST))
    assert rows.count() == 16
    assert {(r["fold"], r["split"]) for r in rows.collect()} == {(f, s) for f in (0, 1) for s in ("train", "test")}
    per_target, overall = jobs.metric_report(rows)
    assert per_target.count() == 8 and {r["split"] for r in overall.collect()} == {"train", "test"}


def test_differential_check(interactions):
    row = jobs.differential_check(interactions, "like", FAST).first()
    assert row["target"] == "like" and 0.2 < row["ap"] < 0.8


def test_reports(interactions):
    report = jobs.stationarity_report(interactions, 31, top=3)
    assert report["top"].count() == 3 and report["series"].columns == ["date", "reply", "rt", "rt_com", "like"]
    assert report["complete"].first()["groups"] == report["counts"].count()
    values = {r["statistic"]: r["value"] for r in jobs.graph_report(interactions).collect()}
    assert values["n_vertices"] == values["n_not_isolated"] and values["n_components"] == 1
    assert values["in_degree_min"] >= 1


def test_part_reader_feeds_the_store(spark, interactions, tmp_path):
    writers.write_delimited(projections.file_order(interactions, False), str(tmp_path / "in"))
    raw = readers.read_part_files(spark, str(tmp_path / "in"))
    assert FeatureStore(raw, S.MODEL_FEATURES, inference=True).dataset().count() == interactions.count()
