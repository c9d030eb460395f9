"""Interaction table derived from the provided order tables.

A tweet is an order, its author the ordering customer, and every distinct part
of the order stands for a viewer. Customers and parts share the user numbers, so
an author can be a viewer with other attributes. All other columns are arithmetic on these keys, so the same rows can be produced by
any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedlens import schema as S


#: The columns used of the provided tables; stated, so no job infers them.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_brand string, p_size int, p_retailprice double",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Author columns over ``customer``.
AUTHOR = {
    "key": "c_custkey",
    "user_id": "concat('u', c_custkey)",
    "user_follower_count": "floor(c_acctbal) + 1000",
    "user_following_count": "c_custkey % 500",
    "user_is_verified": "c_mktsegment = 'BUILDING'",
    "user_account_creation": "c_custkey * 86400 + 1200000000",
}

#: Viewer columns over ``part``.
VIEWER = {
    "key": "p_partkey",
    "user_id": "concat('u', p_partkey)",
    "user_follower_count": "floor(p_retailprice)",
    "user_following_count": "cast(p_size * 10 AS bigint)",
    "user_is_verified": "p_brand = 'Brand#11'",
    "user_account_creation": "p_partkey * 86400 + 1200000000",
}

#: Tweet columns over ``orders``. The date goes through day numbers, which
#: unlike ``unix_timestamp`` do not depend on the session time zone.
TWEET = {
    "text_tokens": "concat('101\t', o_orderkey % 1000, '\t102')",
    "hashtags": "if(o_orderkey % 3 = 0, concat('h', o_orderkey % 50, '\th', o_orderkey % 7), null)",
    "tweet_id": "concat('t', o_orderkey)",
    "present_media": "case o_orderkey % 4 when 1 then 'Photo' when 2 then 'Photo\tVideo' end",
    "present_links": "if(o_orderkey % 10 = 0, concat('l', o_orderkey % 90), null)",
    "present_domains": "if(o_orderkey % 10 = 0, concat('d', o_orderkey % 9), null)",
    "tweet_type": "case left(o_orderpriority, 1) when '1' then 'Retweet' when '2' then 'Quote' when '3' then 'Reply' else 'Toplevel' end",
    "language": "concat('lang', o_orderkey % 4)",
    "tweet_timestamp": "unix_date(cast(o_orderdate as date)) * 86400L + hour(o_orderdate) * 3600 + minute(o_orderdate) * 60"
    " + cast(second(o_orderdate) as int) + o_orderkey * 37 % 86400",
}

#: Follow flag and labels over the joined row.
PAIR = {
    "engagee_follows_engager": "(engaged_with_key + engaging_key) % 3 = 0",
    "reply_timestamp": "if(k % 29 = 0, tweet_timestamp + 60 + k % 7200, null)",
    "retweet_timestamp": "if(k % 11 = 0, tweet_timestamp + 120 + k % 7200, null)",
    "retweet_with_comment_timestamp": "if(k % 97 = 0, tweet_timestamp + 180 + k % 7200, null)",
    "like_timestamp": "if(k % 5 < 2, tweet_timestamp + 30 + k % 7200, null)",
}


def _named(expressions: dict[str, str], prefix: str = "") -> list[str]:
    return [f"{expression} AS {prefix}{name}" for name, expression in expressions.items()]


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24-column interaction table over ``lineitem, orders, customer, part``.

    The joins move the columns of the given tables only, and what follows from
    them is computed behind the last join: derived texts and times would be most of
    the shuffled bytes. Pairs are dealt by order once, for their duplicates and for
    the join with their orders. Orders meet their authors before the line items
    join, so only the last two joins move all pairs. The merge hint keeps the pairs
    spread over tasks when a small input would be broadcast whole; a large one is
    merged anyway.
    """
    orders, customer, part = (_table(spark, sf_dir, name) for name in ("orders", "customer", "part"))
    pairs = _table(spark, sf_dir, "lineitem").repartition("l_orderkey").distinct().hint("merge")
    tweets = orders.join(customer, orders.o_custkey == customer.c_custkey)
    joined = tweets.join(pairs, orders.o_orderkey == pairs.l_orderkey).join(part, pairs.l_partkey == part.p_partkey)
    columns = [*_named(TWEET), *_named(AUTHOR, "engaged_with_"), *_named(VIEWER, "engaging_")]
    keyed = joined.selectExpr(*columns, "o_orderkey * 31 + p_partkey * 17 AS k")
    return keyed.selectExpr(*[c for c in S.INPUT_COLUMNS if c not in PAIR], *_named(PAIR)).select(*S.ALL_COLUMNS)
