"""SimHash near-duplicates by a self-join of a binary trie.

Fingerprints are leaves of a trie over their bits. The join starts with the pair
(root, root) and descends both nodes of a pair together: children are paired if
the bits that differ so far stay within the budget. A pair is taken apart until
few fingerprints hang below it; those are compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.operators.components import component_links
from feedlens.sources.durable import durable

SHINGLE = 3
#: Differing bits at which documents still count as near-duplicates.
BUDGET = 2
BITS = 64
#: Bits per descent: the first one pairs 256 nodes, the others 16 by 16.
FIRST, STEP = 8, 4
#: A node pair with at most this many comparisons below it is not taken apart.
LEAF_COMPARISONS = 16_384

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is set if it is set in more than half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter(map(_hash, map(b" ".join, grams)), dtype=">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str, key: str, shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long, of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["key", "fp"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(scan, f"key {slim.schema['key'].dataType.simpleString()}, fp long")


def _node(fp: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits."""
    if isinstance(depth, int):
        return F.shiftrightunsigned(fp, BITS - depth) if depth else F.lit(0).cast("long")
    return F.call_function("shiftrightunsigned", fp, (F.lit(BITS) - depth).cast("int"))


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def trie_links(prints: DataFrame, budget: int = BUDGET, leaf: int = LEAF_COMPARISONS) -> DataFrame:
    """Pairs ``src, dst`` of distinct fingerprints ``fp`` at most ``budget`` bits apart.

    The state of the descent is a table of node pairs that is written after
    every step, so it grows and is spread like any table. A full subtrie of any
    size is taken apart until its pairs are small; one with a single
    fingerprint has no pairs.
    """
    spark = prints.sparkSession
    pairs = spark.sql("SELECT 0L AS a, 0L AS b, 0 AS differing")
    settled, depth = [], 0
    while depth < BITS:
        step = FIRST if depth == 0 else STEP
        depth += step
        nodes = prints.groupBy(_node(F.col("fp"), depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        children = nodes.withColumn("parent", F.shiftrightunsigned("node", step))
        left = children.select(F.col("parent").alias("a"), F.col("node").alias("na"), F.col("n").alias("count_a"))
        right = children.select(F.col("parent").alias("b"), F.col("node").alias("nb"), F.col("n").alias("count_b"))
        own_bits = F.lit(2**step - 1).cast("long")
        differing = F.col("differing") + _differing(F.col("na").bitwiseAND(own_bits), F.col("nb").bitwiseAND(own_bits))
        below = pairs.join(left, "a").join(right, "b").where(((F.col("a") < F.col("b")) | (F.col("na") <= F.col("nb"))) & (differing <= budget))
        below = below.select(F.col("na").alias("a"), F.col("nb").alias("b"), differing.alias("differing"), (F.col("count_a") * F.col("count_b")).alias("work"))
        below = durable(below.where("a <> b OR work > 1"), "trie")
        small = F.lit(True) if depth == BITS else F.col("work") <= leaf
        settled.append(below.where(small).select(F.lit(depth).alias("depth"), "a", "b"))
        pairs = below.where(~small).select("a", "b", "differing")
        if pairs.isEmpty():
            break
    leaves = settled[0]
    for more in settled[1:]:
        leaves = leaves.unionByName(more)
    depths = F.array(*[F.lit(d) for d in range(FIRST, depth + 1, STEP)])
    members = prints.select(F.explode(depths).alias("depth"), "fp")
    members = members.select("depth", _node(F.col("fp"), F.col("depth")).alias("node"), "fp")
    from_a = members.select("depth", F.col("node").alias("a"), F.col("fp").alias("src"))
    from_b = members.select("depth", F.col("node").alias("b"), F.col("fp").alias("dst"))
    near = leaves.join(from_a, ["depth", "a"]).join(from_b, ["depth", "b"])
    once = (F.col("a") != F.col("b")) | (F.col("src") < F.col("dst"))
    return near.where(once & (_differing(F.col("src"), F.col("dst")) <= budget)).select("src", "dst")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``key, fp, component``, the smallest key reachable.

    Equal fingerprints are one leaf of the trie, so exact copies cost nothing
    beyond their rows. Links are followed to the end: documents of a component
    need not be near each other. A text without words, also an empty or null
    one, has fingerprint zero and links like any other; a null key keeps its row
    and is never the smallest unless all of its component are null. Repeated
    rows are documents each; rows with one key count as that key. Other columns
    are not looked at, and an empty table gives an empty result.
    """
    printed = durable(fingerprints(docs, text, key, shingle), "fingerprints")
    distinct = durable(printed.groupBy("fp").agg(F.min("key").alias("first")), "fingerprints")
    links = component_links(trie_links(distinct.select("fp"), budget))
    grouped = distinct.join(links.select(F.col("hi").alias("fp"), "lo"), "fp", "left")
    grouped = grouped.select("fp", "first", F.coalesce("lo", "fp").alias("group"))
    smallest = grouped.groupBy("group").agg(F.min("first").alias("component"))
    components = grouped.join(smallest, "group").select("fp", "component")
    return printed.join(components, "fp").select(F.col("key").alias(key), "fp", "component")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The document with the smallest key of every component, as whole rows.

    Null keys come last, rows with one key are told apart by their text, and of
    rows with the same key and text one stays.
    """
    identity = F.struct(F.col(key).isNull().alias("unknown"), F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text"))
    found = near_duplicates(docs.select(identity.alias("key"), F.col(text).alias("text")), "text", "key", **options)
    kept = found.where("key = component").select(F.col("key").alias("_identity")).distinct()
    rows = docs.select(identity.alias("_identity"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    one = rows.join(kept, "_identity", "left_semi").dropDuplicates(["_identity"])
    return one.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
