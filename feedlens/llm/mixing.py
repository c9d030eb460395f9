"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words. Its documents are laid end to end,
each as long as its expected number of copies; one random offset shifts a grid
of unit steps over them, and a document is taken once per grid line inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedlens.sources.durable import durable

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix as a share of all words.
SHARE = 1.5
#: No source, and so no document, is taken more often than this.
MOST = 2
SEED = 17


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _fraction(number: Column) -> Column:
    """A 32-bit number as a fraction below one."""
    return number / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Target per source over ``(source, source_size)``, one row per source.

    Targets follow the weights and stop at ``most`` times the source's size;
    what is above goes to the other sources by weight until none is above. In
    order of size per weight the stopped sources come first, so a running sum
    finds them without rounds. The windows hold one row per source.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    position = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weighted = sizes.withColumn("_w", F.element_at(cycle, position % len(weights) + 1).cast("long"))
    filling = W.orderBy(F.col("source_size") / F.col("_w"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("source_size").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("_w").over(filling.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    cap = F.lit(float(most)) * F.col("source_size")
    filled = weighted.withColumns({"_left": F.lit(share) * total - F.lit(float(most)) * before, "_onward": onward})
    stopped = filled.withColumn("_stopped", cap <= F.col("_left") * F.col("_w") / F.col("_onward"))
    first = F.min(F.when(~F.col("_stopped"), F.struct(-F.col("_onward"), F.col("_left"), F.col("_onward").alias("_free")))).over(
        W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    level = stopped.withColumn("_first", first)
    target = F.when(F.col("_stopped"), cap).otherwise(F.col("_first._left") * F.col("_w") / F.col("_first._free"))
    return level.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    carry: list[str] = [],
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``key, source, size, source_size, target, copies``
    and ``row``, a struct of the ``carry`` columns.

    Documents of a source have the same expectation, so the prefix sum is a
    rank times it. They are ranked from the longest to the shortest, which
    keeps the words taken near the target: every step trades documents of
    neighbouring sizes. Ranks come from a range partitioning over all sources:
    sorted pieces are stored with the place of every row, counted, and their
    offsets added, so a source of any share is spread over all tasks and whole
    rows are shuffled once. Equal lengths are ordered by a hash of
    the key, then by key and text; repeated rows are ranked one by one.

    A null text has size 0, a null source is a source of its own, last in order.
    A source without words has target 0 and gives no copies. Other columns of
    ``docs`` are not looked at. An empty table gives an empty result.
    """
    sized = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))).alias("draw"),
        F.xxhash64(F.col(text)).alias("tie"),
        F.struct(*[F.col(c) for c in carry]).alias("row") if carry else F.lit(None).cast("string").alias("row"),
    )
    order = [F.desc("size"), F.asc("draw"), F.asc("key"), F.asc("tie")]
    ranged = sized.repartitionByRange(F.asc("source"), *order).sortWithinPartitions(F.asc("source"), *order)
    numbered = ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("piece", F.shiftright("place", 33).cast("int"))
    pieces = durable(numbered.drop("draw", "tie"), "mix")
    counts = pieces.groupBy("piece", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("place").alias("first"))
    by_source = W.partitionBy("source")
    earlier = F.sum("n").over(by_source.orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("piece", "source", "first", F.coalesce(earlier, F.lit(0)).alias("before"))
    totals = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, weights, share, most)
    shift = _fraction(F.conv(F.left(F.md5(F.concat_ws("|", F.lit(f"{seed}/offset"), F.coalesce("t.source", F.lit("")))), F.lit(8)), 16, 10).cast("long"))
    plan = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    # Stored, so that its real size decides whether the rows move again to meet it.
    plan = durable(plan.select("o.*", "source_size", "target", shift.alias("shift")), "plan")
    joined = pieces.alias("r").join(
        plan.alias("p"), (F.col("r.piece") == F.col("p.piece")) & F.col("r.source").eqNullSafe(F.col("p.source"))
    )
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    end = F.col("before") + F.col("place") - F.col("first") + 1
    crossed = F.floor(F.col("shift") + expected * end) - F.floor(F.col("shift") + expected * (end - 1))
    copies = F.least(crossed, F.lit(most).cast("long"))
    return joined.select(F.col("key").alias(key), F.col("r.source").alias("source"), "size", "source_size", "target", copies.alias("copies"), "row")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every taken document, once per copy, with the number of
    the copy in ``copy``. The other columns are those of ``docs``; if one of them
    is called ``copy`` already, the number is in ``_copy``, and so on."""
    number = "copy"
    while number in [c.lower() for c in docs.columns]:
        number = f"_{number}"
    named = [F.col("row")[c].alias(c) for c in docs.columns]
    mixed = mix_sources(docs, carry=docs.columns, **options).where("copies > 0")
    return mixed.select(*named, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias(number))
