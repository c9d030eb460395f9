"""Benchmark decontamination with a broadcast set of token windows.

The windows of all benchmark items are hashed into a set that every task gets;
the windows of each training document are looked up in it, and hits are
verified against the words before they count.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.operators.skew import salted_lookup
from feedlens.sources.durable import durable

#: Words of a window.
WINDOW = 10
#: The set is broadcast up to this many bytes of windows and item names; a larger
#: one meets the windows of the documents in a shuffle, with the same result.
BROADCAST_BYTES = 96 << 20
#: Bytes of a window beside its text and items: hash, length, array headers.
ROW_BYTES = 64
#: Words of a text whose windows are looked up together; windows over the end of
#: a slice are in it, so the result is that of the whole text.
SLICE = 128
#: Characters between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words_of(text: Column) -> Column:
    """Normalised words; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _slices(words: Column, longest: int) -> Column:
    """The words in slices of ``SLICE``, each with the ``longest - 1`` words behind
    it, the number of words before it and of all words. No words are one slice."""
    last = F.floor(F.greatest(F.size(words) - 1, F.lit(0)) / SLICE).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct((k * SLICE).alias("before"), F.size(words).alias("n_words"), F.slice(words, k * SLICE + 1, SLICE + longest - 1).alias("words")),
    )


def _windows(words: Column, length: int) -> Column:
    """Position from 1, length and hash of every window of a length that starts in a slice."""
    starts = F.sequence(F.lit(1), F.least(F.lit(SLICE), F.size(words) - length + 1))
    windows = F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), F.xxhash64(F.slice(words, i, length)).alias("hash")))
    return F.when(F.size(words) >= length, windows).otherwise(F.array().cast("array<struct<at:int,length:int,hash:bigint>>"))


def benchmark_windows(items: DataFrame, text: str = "text", key: str = "item_id", size: int = WINDOW) -> DataFrame:
    """``length, hash, window, items``: every distinct window with the items it
    is in. An item of fewer words, but not none, is one window."""
    words = items.select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    windows = words.select("item", length.alias("length"), F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("window"))
    distinct = windows.groupBy("length", "window").agg(F.collect_set("item").alias("items"))
    return distinct.select("length", F.xxhash64("window").alias("hash"), F.array_join("window", " ").alias("window"), "items")


def find_hits(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", size: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: ``key, n_words, hit, items``.

    ``hit`` lists the positions (from 1) of the words inside any occurrence of a
    benchmark window, ``items`` the items concerned as sorted strings. Windows
    are looked up as they are read; only hits and one marker per document are
    moved. Above ``broadcast_bytes`` of benchmark windows, each window of a
    document travels with its own ten words, never with the whole text, and
    frequent windows are split over several tasks.

    Texts are cut into slices of words first, so the time for a text grows with
    its length and a task never holds more than one slice's windows.

    Null and empty texts have no words, null items texts no windows. Repeated
    rows, also with one key, are searched each; a null key is kept. Other
    columns are not looked at. Without items nothing is hit.
    """
    windows = durable(benchmark_windows(items, size=size), "windows")
    named = F.aggregate("items", F.lit(0).cast("long"), lambda total, item: total + F.octet_length(item) + 16)
    summary = windows.agg(
        F.coalesce(F.sum(F.octet_length("window") + named + ROW_BYTES), F.lit(0)).alias("bytes"), F.collect_set("length").alias("lengths")
    ).first()
    known = windows.select(F.col("length").alias("known_length"), "hash", "window", "items")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    lengths = sorted(summary["lengths"])
    slices = F.flatten(F.transform(F.array(words_of(F.col("text"))), lambda words: _slices(words, max(lengths, default=1))))
    sliced = numbered.select("row", "key", F.inline(slices))
    none = F.array().cast("array<struct<at:int,length:int,hash:bigint>>")
    marker = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("length"), F.lit(None).cast("long").alias("hash")))
    tried = F.concat(F.when(F.col("before") == 0, marker).otherwise(none), *[_windows(F.col("words"), n) for n in lengths])
    placed = sliced.select("row", "key", "before", "n_words", "words", F.inline(tried))
    own = F.array_join(F.slice("words", F.col("at"), F.col("length")), " ")
    if summary["bytes"] <= broadcast_bytes:
        looked = placed.join(F.broadcast(known), "hash", "left").withColumn("own", own)
    else:
        slim = placed.select("row", "key", "before", "n_words", "at", "length", "hash", F.when(F.col("at") > 0, own).alias("own"))
        looked = salted_lookup(slim, known, "hash", ["row", "before", "at"], "left")
    verified = (F.col("window") == F.col("own")) & (F.col("length") == F.col("known_length"))
    hits = looked.where((F.col("at") == 0) | verified)
    start = F.col("before") + F.col("at")
    span = F.when(F.col("at") > 0, F.sequence(start, start + F.col("length") - 1))
    slim = hits.select("row", "key", F.col("n_words").cast("long").alias("n_words"), span.alias("span"), F.col("items"))
    grouped = slim.groupBy("row").agg(
        F.first("key").alias("key"), F.max("n_words").alias("n_words"), F.collect_list("span").alias("spans"), F.collect_set("items").alias("items")
    )
    return grouped.select(
        F.col("key").alias(key),
        "n_words",
        F.array_sort(F.array_distinct(F.flatten("spans"))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a hit, as whole rows. Texts are matched by their
    digest, so copies and null or repeated keys need no care."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    found = find_hits(docs.select(digest.alias("digest"), F.col(text).alias("text")), items, "text", "digest", **options)
    bad = found.where(F.size("hit") > 0).select(F.col("digest").alias("_digest")).distinct()
    rows = docs.select(digest.alias("_digest"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    return rows.join(bad, "_digest", "left_anti").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def without_hits(text: Column, hit: Column) -> Column:
    """``text`` without the words at the positions ``hit``; what stands between
    the words stays."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    kept = F.transform(words, lambda word, i: F.when(F.array_contains(hit, i + 1), F.lit("")).otherwise(word))
    pieces = F.zip_with(F.split(text, WORD, -1), kept, lambda gap, word: F.concat(gap, F.coalesce(word, F.lit(""))))
    return F.array_join(pieces, "")
