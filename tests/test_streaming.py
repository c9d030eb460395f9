import os

from pyspark.sql import functions as F

from feedlens import schema as S
from feedlens.functions.columns import follower_score
from feedlens.operators import profile, projections
from feedlens.sources import writers
from feedlens.streaming.hourly import hourly_windows, read_hour_parts, read_hourly_counts, stream_hour_parts, stream_hourly_counts
from feedlens.streaming.scoring import degree_scorer, read_model_scores, read_part_stream, stream_model_scores, stream_scores


def scores(rows):
    return rows.select(*S.KEYS, follower_score().alias("p"))


def append_part(df, directory, name):
    """One more text file, as an upstream job would drop it."""
    directory.mkdir(exist_ok=True)
    lines = df.select(F.concat_ws(S.FIELD_SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])).collect()
    (directory / f"{name}.tmp").write_text("\n".join(r[0] for r in lines) + "\n")
    (directory / f"{name}.tmp").rename(directory / name)


def test_every_part_file_is_scored_once(spark, table, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: stream_scores(read_part_stream(spark, str(source)), scores, out, state).awaitTermination()
    append_part(projections.file_order(table({"tweet_id": "a"}), False), source, "part-0")
    run()
    assert spark.read.csv(out).count() == 1
    append_part(projections.file_order(table({"tweet_id": "b"}, {"tweet_id": "c"}), False), source, "part-1")
    append_part(projections.file_order(table({"tweet_id": "d"}), False), source, "unrelated")
    run()
    run()
    rows = spark.read.csv(out).collect()
    assert sorted(r[0] for r in rows) == ["a", "b", "c"]
    expected = scores(table({"tweet_id": "a"})).first()["p"]
    assert {float(r[2]) for r in rows} == {expected}


def test_hourly_stream_equals_the_batch(spark, interactions, tmp_path):
    writers.write_delimited(interactions, str(tmp_path / "in"))
    stream = read_part_stream(spark, str(tmp_path / "in"), labelled=True)
    stream_hourly_counts(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = read_hourly_counts(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, profile.full_hour_counts(interactions).collect())) != []


def test_late_rows_count_unless_a_lateness_is_given(spark, table, tmp_path):
    source, hour = tmp_path / "in", 3600
    runs = [(str(tmp_path / f"out{i}"), str(tmp_path / f"state{i}"), lateness) for i, lateness in enumerate((None, "1 hour"))]
    parts = [table({"like_timestamp": 100}, {"like_timestamp": 9 * hour}), table({"like_timestamp": 200}, {"like_timestamp": 20 * hour})]
    for i, part in enumerate(parts):
        append_part(part, source, f"part-{i}")
        for out, state, lateness in runs:
            stream_hourly_counts(read_part_stream(spark, str(source), labelled=True), out, state, lateness).awaitTermination()
    found = [sorted(map(tuple, read_hourly_counts(spark, out).collect())) for out, _, _ in runs]
    assert found[0] == [(0, "like", 2), (9 * hour, "like", 1), (20 * hour, "like", 1)]
    assert found[1] == [(0, "like", 1), (9 * hour, "like", 1), (20 * hour, "like", 1)]


def test_hourly_windows_on_a_table(interactions):
    batch = sorted(map(tuple, profile.full_hour_counts(interactions).collect()))
    assert sorted(map(tuple, hourly_windows(interactions).collect())) == batch


def test_late_rows_are_kept_and_marked(spark, table, tmp_path):
    source, out, state, hour = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state"), 3600
    parts = [
        table({"like_timestamp": 100}, {"like_timestamp": 9 * hour}),
        table({"tweet_id": "no engagement"}),
        table({"like_timestamp": 200}, {"like_timestamp": 8 * hour}, {"like_timestamp": 20 * hour}),
    ]
    for i, part in enumerate(parts):
        append_part(part, source, f"part-{i}")
        stream_hour_parts(read_part_stream(spark, str(source), labelled=True), out, state, lateness=hour).awaitTermination()
    found = sorted(map(tuple, read_hour_parts(spark, out).collect()))
    assert found == [(0, "like", 2, 1), (8 * hour, "like", 1, 0), (9 * hour, "like", 1, 0), (20 * hour, "like", 1, 0)]


def test_hour_parts_equal_the_batch_in_any_order(spark, interactions, tmp_path):
    writers.write_delimited(interactions.repartition(5, "tweet_id"), str(tmp_path / "in"))
    stream = read_part_stream(spark, str(tmp_path / "in"), labelled=True, files_per_batch=2)
    stream_hour_parts(stream, str(tmp_path / "out"), str(tmp_path / "state"), lateness=0).awaitTermination()
    rows = read_hour_parts(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, rows.drop("late_count").collect())) == sorted(map(tuple, profile.full_hour_counts(interactions).collect()))
    assert rows.where("late_count > 0").count() > 0


class Degrees:
    """A model whose scores are its inputs."""

    def predict(self, dataset):
        return dataset.select(*S.KEYS, *[F.col("engaged_with_user_in_degree").cast("float").alias(t) for t in S.TARGET_NAMES])


def test_model_scores_with_stored_degrees(spark, table, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    degrees = spark.createDataFrame([("a", 7, 1)], "id string, in_degree long, out_degree long")
    score = degree_scorer(Degrees(), degrees)
    for i, author in enumerate(("a", "unknown")):
        append_part(projections.file_order(table({"tweet_id": str(i), "engaged_with_user_id": author}), False), source, f"part-{i}")
        for _ in range(2):
            stream_model_scores(read_part_stream(spark, str(source)), score, out, state).awaitTermination()
    found = {r["tweet_id"]: r[S.TARGET_NAMES[0]] for r in read_model_scores(spark, out).collect()}
    assert found == {"0": 7.0, "1": 0.0} and read_model_scores(spark, out).count() == 2


def test_a_batch_is_parsed_once_and_scored_from_a_stored_table(spark, table, tmp_path):
    source, seen = tmp_path / "in", []
    for i in range(3):
        append_part(projections.file_order(table({"tweet_id": str(i)}), False), source, f"part-{i}")

    def score(rows):
        seen.extend(rows.inputFiles())
        assert rows.columns == S.KEYS
        return Degrees().predict(rows.withColumn("engaged_with_user_in_degree", F.lit(3)))

    parts = read_part_stream(spark, str(source), files_per_batch=2).select(*S.KEYS)
    stream_model_scores(parts, score, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert read_model_scores(spark, str(tmp_path / "out")).count() == 3
    assert len(seen) >= 2 and all(f.endswith(".parquet") for f in seen)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in seen)  # a batch frees its table
