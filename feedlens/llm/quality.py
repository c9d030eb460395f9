"""Quality rules: surface statistics and a likelihood ratio of hashed n-grams.

Words and word pairs are hashed into buckets. One multinomial is counted over a
trusted target, one over the raw corpus; a document scores the mean logarithm of
their ratio over its n-grams, and a threshold decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.bytescan import RangeHash, earlier_equal, mix, pieces, repeated, tokens
from feedlens.sources.durable import durable

BUCKETS = 1 << 15
#: Share of the raw corpus in the target's multinomial, so that no ratio is zero.
BACKGROUND = 0.1
#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Scores are compared in steps of this size when the threshold is chosen.
SCORE_STEP = 0.001

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CONTINUATION = (np.arange(256) & 0xC0) == 0x80
_SALT = np.uint64(0x632BE59BD9B4E019)


def ngram_buckets(words: np.ndarray, owner: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every word and of every pair within a text."""
    pair = owner[1:] == owner[:-1]
    pairs = mix(words[:-1] * np.uint64(3) + words[1:] * _SALT)[pair]
    grams = np.concatenate([mix(words), pairs])
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate([owner, owner[1:][pair]])


def statistics(buffer: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Base statistics per text, hash of every word and its text number."""
    n = len(offsets) - 1
    hashes = RangeHash(buffer)
    starts, ends, owner = tokens(buffer, offsets)
    words = hashes(starts, ends)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    extra = np.concatenate([[0], np.cumsum(_CONTINUATION[buffer])])
    word_chars = np.bincount(owner, ends - starts - (extra[ends] - extra[starts]), n).astype(np.int64)

    line_starts = np.union1d(np.flatnonzero(buffer == 0x0A) + 1, offsets[:-1])
    line_starts = line_starts[line_starts <= (len(buffer) - 1)]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(buffer)), offsets[line_owner + 1])
    line_ends = line_ends - (buffer[line_ends - 1] == 0x0A)
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_owner = line_starts[worded], line_ends[worded], line_owner[worded]
    lines = mix(hashes(line_starts, line_ends) + line_owner.astype(np.uint64) * _SALT)

    triples = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    windows = words[triples] + mix(words[triples + 1] + _SALT) + mix(mix(words[triples + 2]) + owner[triples].astype(np.uint64) * _SALT)
    twice = triples[repeated(mix(windows))]
    in_repeat = np.zeros(len(words), bool)
    for shift in range(3):
        in_repeat[twice + shift] = True
    return (
        {
            "n_words": np.bincount(owner, minlength=n),
            "word_chars": word_chars,
            "n_symbols": per_text(_SYMBOL[buffer]),
            "n_dup_lines": np.bincount(line_owner[earlier_equal(lines)], minlength=n),
            "n_repeat_words": np.bincount(owner[in_repeat], minlength=n),
        },
        words,
        owner,
    )


def bucket_counts(docs: DataFrame, text: str, trusted: str) -> DataFrame:
    """``bucket, raw, target``: n-grams of all texts and of the trusted ones.
    Every task adds up its own and returns a row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            marked = np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for first, buffer, offsets in pieces(batch.column(0)):
                starts, ends, owner = tokens(buffer, offsets)
                buckets, owner = ngram_buckets(RangeHash(buffer)(starts, ends), owner)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[marked[first + owner]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    counted = docs.select(text, trusted).mapInArrow(count, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame) -> np.ndarray:
    """Weight per bucket; zero without any trusted text."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.collect():  # a row per bucket
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.any():
        return np.zeros(BUCKETS)
    ratio = np.divide(target / target.sum(), raw / raw.sum(), out=np.zeros(BUCKETS), where=raw > 0)
    return np.log((1 - BACKGROUND) * ratio + BACKGROUND)



def score_documents(docs: DataFrame, weights: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, the base statistics, ``base_failed`` and
    ``score``, the mean weight of its n-grams (0 without words)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {name: [] for name in [*names, "score"]}
            for _, buffer, offsets in pieces(batch.column(1)):
                found, words, owner = statistics(buffer, offsets)
                buckets, owner = ngram_buckets(words, owner)
                n = len(offsets) - 1
                total = np.bincount(owner, weights[buckets], n) / np.maximum(np.bincount(owner, minlength=n), 1)
                for name, values in {**found, "score": total}.items():
                    columns[name].append(values)
            arrays = [pa.array(np.concatenate(columns[name]) if columns[name] else np.zeros(0)) for name in columns]
            arrays = [a.cast(pa.int64()) for a in arrays[:-1]] + [arrays[-1].cast(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["key", *columns])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {slim.schema['key'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", score double"
    scored = slim.mapInArrow(scan, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumnRenamed("key", key)


def choose_threshold(scored: DataFrame, quality: str) -> float:
    """The score that best separates labelled good (1) from bad (0) documents:
    the largest share of good ones kept less that of bad ones kept. It is put
    halfway to the next lower labelled score. Without both labels, 0."""
    step = F.floor(F.col("score") / SCORE_STEP)
    counts = scored.where(~F.col("base_failed") & F.col(quality).isNotNull()).groupBy(step.alias("step"))
    rows = sorted(counts.agg(F.sum(F.col(quality)).alias("good"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["step"])
    good, bad = sum(r["good"] for r in rows), sum(r["n"] - r["good"] for r in rows)
    if not good or not bad:
        return 0.0
    best, threshold, good_below, bad_below = -1.0, 0.0, 0, 0
    for lower, row in zip([rows[0], *rows], rows):
        if (gain := bad_below / bad - good_below / good) > best:
            best, threshold = gain, (row["step"] + lower["step"]) / 2 * SCORE_STEP
        good_below += row["good"]
        bad_below += row["n"] - row["good"]
    return threshold


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the statistics, ``score`` and ``kept``.

    Trusted are the documents labelled with quality 1; the raw
    corpus is every document. Counts, scores and the threshold cover all rows.
    A document labelled more than once counts as good if all its labels do.
    Null and empty texts have no words and fail the base rules; repeated rows
    are judged each, a null key is kept and has no label. Other columns are not
    looked at. Without labels all weights are 0 and the base rules decide.
    """
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    good = F.min((F.col("quality") == 1).cast("int"))
    known = known.agg(good.alias("good"))
    # merged at every size: the labels grow with the documents, so they are never sent to all tasks
    marked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(known.hint("merge"), "key", "left")
    weights = log_ratio(bucket_counts(marked.select("text", (F.col("good") == 1).alias("trusted")), "text", "trusted"))
    scored = durable(score_documents(docs, weights, text, key), "scores")
    labelled = scored.withColumnRenamed(key, "key").join(known, "key", "left")
    threshold = choose_threshold(labelled, "good")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
