import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedlens import schema as S  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("feedlens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "5000")  # whole plans for the plan tests
        .config("spark.sql.debug.maxToStringFields", "200")
        .config("spark.sql.session.timeZone", "Asia/Tokyo")  # results must not depend on the zone
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BASE = {
    "text_tokens": "101\t7\t102",
    "hashtags": None,
    "tweet_id": "t1",
    "present_media": None,
    "present_links": None,
    "present_domains": None,
    "tweet_type": "Toplevel",
    "language": "l1",
    "tweet_timestamp": 1000,
    "engaged_with_user_id": "a",
    "engaged_with_user_follower_count": 10,
    "engaged_with_user_following_count": 20,
    "engaged_with_user_is_verified": False,
    "engaged_with_user_account_creation": 1,
    "engaging_user_id": "b",
    "engaging_user_follower_count": 30,
    "engaging_user_following_count": 40,
    "engaging_user_is_verified": True,
    "engaging_user_account_creation": 2,
    "engagee_follows_engager": True,
    "reply_timestamp": None,
    "retweet_timestamp": None,
    "retweet_with_comment_timestamp": None,
    "like_timestamp": None,
}


@pytest.fixture(scope="session")
def table(spark):
    """Interaction table from rows that name only what differs."""

    def build(*rows):
        values = [tuple({**BASE, **row}[c] for c in S.ALL_COLUMNS) for row in rows]
        return spark.createDataFrame(values, S.interaction_schema())

    return build


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def interactions(spark, sf_dir):
    from feedlens.sources.durable import durable
    from feedlens.standin import interactions

    return durable(interactions(spark, sf_dir), "test")
