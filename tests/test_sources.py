import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedlens import schema as S
from feedlens.sources import durable, paths, readers, writers

FULL = ["101\t7", "h1\th2", "t1", "Photo", "", "", "Quote", "l1", "100", "a", "1", "2", "true", "3", "b", "4", "5", "false", "6", "true"]


def line(*labels, base=FULL):
    return S.FIELD_SEPARATOR.join([*base, *labels])


def write_text(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_schema_has_24_columns():
    assert len(S.ALL_COLUMNS) == 24 and S.ALL_COLUMNS[20:] == S.LABELS
    assert S.interaction_schema(False).names == S.ALL_COLUMNS[:20]
    assert set(S.TIMESTAMP_COLUMNS) < set(S.ALL_COLUMNS)


def test_text_scan_types_and_missing_values(spark, tmp_path):
    path = write_text(tmp_path / "part-0", line("", "", "", "777"), line('""', "8", "", ""))
    rows = readers.read_interactions(spark, path).orderBy("like_timestamp").collect()
    assert rows[0]["reply_timestamp"] is None and rows[0]["retweet_timestamp"] == 8
    assert rows[1]["like_timestamp"] == 777 and rows[1]["present_links"] is None
    assert rows[1]["engaged_with_user_is_verified"] is True and rows[1]["text_tokens"] == "101\t7"


def test_trailing_empty_fields_survive(spark, tmp_path):
    path = write_text(tmp_path / "x", line("", "", "", ""))
    row = readers.read_delimited(spark, path).first()
    assert [row[c] for c in S.LABELS] == [None] * 4 and row["engagee_follows_engager"] is True
    fields = readers.read_raw_fields(spark, path).first()["fields"]
    assert len(fields) == 24 and fields[20:] == [""] * 4


def test_short_long_and_malformed_lines(spark, tmp_path):
    bad = [*FULL[:8], "soon", *FULL[9:]]
    path = write_text(tmp_path / "x", S.FIELD_SEPARATOR.join(FULL[:10]), line("1", "2", "3", "4", "5"), line("", "", "", "", base=bad))
    df = readers.read_delimited(spark, path, corrupt_column="_corrupt").cache()
    assert df.count() == 3
    assert df.where("tweet_timestamp IS NULL").first()["tweet_id"] == "t1"
    assert df.where("_corrupt IS NOT NULL").count() >= 1
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_delimited(spark, path, mode="FAILFAST").collect()


def test_unlabelled_text(spark, tmp_path):
    path = write_text(tmp_path / "x", line())
    df = readers.read_interactions(spark, path, labelled=False)
    assert df.columns == S.INPUT_COLUMNS and df.first()["tweet_id"] == "t1"


def test_raw_lines_equal_the_text_scan(spark, table, tmp_path):
    df = table({"like_timestamp": 5}, {"tweet_id": "t2", "hashtags": "x\ty", "reply_timestamp": 9})
    writers.write_delimited(df, str(tmp_path / "d"))
    named = readers.name_fields(readers.read_raw_fields(spark, str(tmp_path / "d")))
    assert named.schema.simpleString().count("string") == 24
    typed = readers.read_delimited(spark, str(tmp_path / "d"))
    assert sorted(readers.cast_fields(named).collect(), key=str) == sorted(typed.collect(), key=str)


def test_outer_blanks_of_raw_lines_are_trimmed(spark, tmp_path):
    path = write_text(tmp_path / "x", "  " + line("", "", "", "4") + " \t")
    fields = readers.read_raw_fields(spark, path).first()["fields"]
    assert fields[0] == "101\t7" and fields[23] == "4"


def test_dispatch_by_suffix(spark, table, tmp_path):
    df = table({"like_timestamp": 5})
    parquet, text = str(tmp_path / "a.b.parquet"), str(tmp_path / "plain")
    df.withColumn("other", F.lit(1)).write.parquet(parquet)
    writers.write_delimited(df, text)
    assert readers.read_interactions(spark, parquet).columns == S.ALL_COLUMNS
    assert readers.read_interactions(spark, parquet).collect() == readers.read_interactions(spark, text).collect()
    both = readers.read_interactions(spark, [text, text])
    assert both.count() == 2


def test_part_file_filter(spark, table, tmp_path):
    (tmp_path / "in").mkdir()
    write_text(tmp_path / "in" / "part-00000.csv", line())
    write_text(tmp_path / "in" / "old_part", line())
    write_text(tmp_path / "in" / "readme", "nothing")
    assert readers.read_part_files(spark, str(tmp_path / "in")).count() == 2


def test_cast_tolerates_bad_text(spark):
    df = spark.createDataFrame([("1", "x"), ("", "true")], "a string, b string")
    cast = readers.cast_fields(df, {"a": T.IntegerType(), "b": T.BooleanType()})
    assert [tuple(r) for r in cast.collect()] == [(1, None), (None, True)]


def test_list_columns(table):
    row = readers.with_list_columns(table({"hashtags": "x\ty"})).first()
    assert row["text_tokens"] == [101, 7, 102] and row["hashtags"] == ["x", "y"] and row["present_links"] is None


def test_text_round_trip_keeps_every_value(spark, table, tmp_path):
    df = table(
        {"hashtags": "a\tb", "like_timestamp": 5},
        {"tweet_id": ' t"2" ', "language": "x y ", "present_links": "l,1"},
        {"tweet_id": "t3", "text_tokens": None, "tweet_timestamp": None},
    )
    writers.write_delimited(df, str(tmp_path / "d"))
    assert sorted(readers.read_delimited(spark, str(tmp_path / "d")).collect(), key=str) == sorted(df.collect(), key=str)


def test_predictions_hold_the_scored_targets(spark, tmp_path):
    df = spark.range(100).repartition(4).selectExpr("0.5f AS like", "cast(id as string) AS tweet_id", "0.25f AS reply", "'u' AS engaging_user_id")
    writers.write_predictions(df, str(tmp_path / "many"))
    files = [f for f in (tmp_path / "many").iterdir() if f.name.startswith("part")]
    lines = [line for f in files for line in f.read_text().splitlines()]
    assert len(files) > 1 and len(lines) == 100 and lines[0].endswith(",u,0.25,0.5")


def test_sample_directory_name():
    assert writers.sample_directory(200_000, 747_694_282) == "sample_0.0003"
    assert writers.sample_directory(0, 0) == "sample_0.0000"


def test_fold_files(spark, table, tmp_path):
    train, test = table({}), table({"tweet_id": "t2"})
    paths_ = writers.write_fold(train, test, str(tmp_path), 0)
    assert [os.path.basename(p) for p in paths_] == ["sample1", "sample1_test"]
    writers.write_fold(train, test, str(tmp_path), 0)  # replaces the earlier pair
    assert readers.read_delimited(spark, paths_[1]).collect() == test.collect()


def test_features_and_auxiliaries_read_back(spark, table, tmp_path):
    df = table({"like_timestamp": 5})
    writers.write_feature(df, str(tmp_path / "f"), ["language", "like_timestamp"])
    assert spark.read.parquet(str(tmp_path / "f")).columns == [*S.KEYS, "language", "like_timestamp"]
    writers.write_auxiliaries({"x": df, "y": df}, str(tmp_path / "aux"))
    assert paths.subdirectories(spark, str(tmp_path / "aux")) == ["x", "y"]
    assert paths.is_complete(spark, str(tmp_path / "aux" / "x"))
    assert paths.subdirectories(spark, str(tmp_path / "missing")) == []


def test_fingerprint_tells_equal_sizes_apart(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    for directory, text in ((one, "abc"), (two, "abd")):
        directory.mkdir()
        (directory / "part").write_text(text)
    before = paths.dataset_fingerprint(spark, str(one))
    assert before == paths.dataset_fingerprint(spark, str(one))
    assert before != paths.dataset_fingerprint(spark, str(two))
    later = datetime.datetime.now().timestamp() + 60
    os.utime(one / "part", (later, later))
    assert before != paths.dataset_fingerprint(spark, str(one))


def test_clear_directory_keeps_dotfiles(spark, tmp_path):
    (tmp_path / "c" / "sub").mkdir(parents=True)
    (tmp_path / "c" / ".keep").write_text("")
    (tmp_path / "c" / "file").write_text("")
    paths.clear_directory(spark, str(tmp_path / "c"))
    assert [p.name for p in (tmp_path / "c").iterdir()] == [".keep"]
    paths.clear_directory(spark, str(tmp_path / "missing"))


def test_durable_uses_the_configured_folder(spark):
    df = durable.durable(spark.range(5), "numbers")
    assert df.inputFiles()[0].removeprefix("file://").startswith(spark.conf.get("spark.checkpoint.dir") + "/")
    assert df.count() == 5


def test_scratch_tables_can_be_released(spark, monkeypatch):
    monkeypatch.setattr(durable, "_handed_out", [])
    df = durable.durable(spark.range(3), "numbers")
    directory = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(directory)
    durable.release_scratch(spark)
    assert not os.path.exists(directory) and os.path.isdir(os.path.dirname(directory))


def test_jobs_free_their_own_scratch_only(spark):
    def folder(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    before = folder(durable.durable(spark.range(3), "numbers"))
    with durable.job_scratch(spark):
        outer = folder(durable.durable(spark.range(3), "numbers"))
        with pytest.raises(ZeroDivisionError), durable.job_scratch(spark):
            inner = folder(durable.durable(spark.range(3), "numbers"))
            1 / 0
        assert os.path.isdir(outer) and not os.path.exists(inner)
    assert os.path.isdir(before) and not os.path.exists(outer)


def test_durable_refuses_a_machine_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.scratch_root(Session())
