"""Removal of repeated byte strings, by a bounded Burrows-Wheeler transform.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts somewhere
else. Every such string is sent to a place that depends on its content alone:
its anchor, the smallest hash among its ``GRAM``-byte parts. Strings in a row
that share an anchor occurrence travel as one run. Runs that are equal as a
whole need no search; of the others one per kind meets those with its anchor in
a block, whose suffixes are sorted and transformed. A breadth-first backward
extension of intervals then derives the common prefixes of neighbouring
suffixes by increasing length, and stops at ``LENGTH``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.bytescan import RangeHash, pieces
from feedlens.sources.durable import durable
from feedlens.sources.paths import delete

LENGTH, GRAM = 200, 40
#: Parts of a string among which its anchor is chosen.
PARTS = LENGTH - GRAM + 1
#: Starts that are worked on together; the place within them takes 21 bits.
STARTS = 1 << 20
PLACE = np.uint64((1 << 21) - 1)
#: Bytes of a block, and runs of one anchor that stay together. An anchor with
#: more is divided by the place of the anchor in the string, on which equal
#: strings agree, into at most so many divisions. The strings of an anchor with
#: still more runs, such as a passage that most documents have, are not brought
#: together: like whole runs, they are counted by their hashes.
BLOCK_BYTES, RUNS, DIVISIONS = 1 << 20, 2048, 16
SEPARATOR = 256


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def runs_of(buffer: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of string starts that share an anchor occurrence: text number,
    anchor hash, hash of the run's bytes, first start (in the text), number of
    starts, distance from the first start to the anchor."""
    columns: dict[str, list] = {name: [] for name in ("owner", "anchor", "content", "start", "n", "ahead")}
    hashes = RangeHash(buffer)
    sizes = np.diff(offsets)
    text_number = np.repeat(np.arange(len(sizes)), sizes)
    all_grams = hashes.fixed(GRAM) if len(buffer) >= GRAM else None
    for low in range(0, len(buffer) - LENGTH + 1, STARTS):
        high = min(low + STARTS, len(buffer) - LENGTH + 1)
        grams = all_grams[low : high + PARTS - 1]
        places = np.arange(len(grams), dtype=np.uint64)
        anchors = (window_minimum((grams & ~PLACE) | places, PARTS) & PLACE).astype(np.int64)
        starts = np.arange(low, high)
        owner = text_number[low:high]
        whole = starts + LENGTH <= offsets[owner + 1]
        starts, owner, anchors = starts[whole], owner[whole], anchors[whole]
        if not len(starts):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchors) != 0) | (np.diff(starts) != 1)]))
        n = np.diff(np.append(new, len(starts)))
        first = starts[new]
        columns["owner"].append(owner[new])
        columns["anchor"].append(grams[anchors[new]].view(np.int64))
        columns["content"].append(hashes(first, first + n - 1 + LENGTH).view(np.int64))
        columns["start"].append(first - offsets[owner[new]])
        columns["n"].append(n)
        columns["ahead"].append(anchors[new] + low - first)
    return {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in columns.items()}


def scan_runs(docs: DataFrame) -> DataFrame:
    """All runs of ``doc, mark, text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, buffer, offsets in pieces(batch.column(2)):
                found = runs_of(buffer, offsets)
                owner = pa.array(found.pop("owner") + first)
                keys = [batch.column(i).take(owner) for i in range(2)]
                arrays = [pa.array(v, pa.int64() if name in ("anchor", "content") else pa.int32()) for name, v in found.items()]
                yield pa.RecordBatch.from_arrays([*keys, *arrays], ["doc", "mark", *found])

    doc = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "mark", "text").mapInArrow(scan, f"doc {doc}, mark long, anchor long, content long, start int, n int, ahead int")


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Suffixes by their first ``length`` symbols, by doubling sorted ranks."""
    n, packed = len(symbols), min(7, length)
    padded = np.concatenate([symbols.astype(np.int64), np.full(length, SEPARATOR)])
    keys = np.zeros(n, np.int64)
    for i in range(packed):
        keys = (keys << 9) | padded[i : i + n]
    known = packed
    while True:
        order = np.argsort(keys)
        if known >= length:
            return order
        ranks = np.zeros(n + length, np.int64)
        ranks[order] = np.cumsum(np.concatenate([[1], (np.diff(keys[order]) != 0).astype(np.int64)]))
        step = min(known, length - known)
        keys = ranks[:n] * (n + 1) + ranks[step : step + n]
        known += step


def common_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before, ``length``
    standing for that and more.

    Works on the Burrows-Wheeler transform alone: the interval of a string W is
    extended backwards by every symbol c in it. Where the interval of cW ends,
    the common prefix is the length of W, unless a shorter one was found there
    before; then the interval is not followed any further.
    """
    n = len(symbols)
    transform = symbols[order - 1]
    forward = np.argsort(transform, kind="stable")  # rank of the suffix one later
    backward = np.empty(n, np.int64)
    backward[forward] = np.arange(n)
    head = transform[forward]
    prefixes = np.full(n + 1, length, np.int64)
    begins, ends = np.zeros(1, np.int64), np.full(1, n)
    for found in range(length):
        sizes = ends - begins
        interval = np.repeat(np.arange(len(sizes)), sizes)
        rows = np.arange(len(interval)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[interval]
        target = backward[rows]
        after, before = np.minimum(target + 1, n - 1), np.maximum(target - 1, 0)
        last = (target + 1 == n) | (head[after] != head[target]) | (forward[after] >= ends[interval])
        first = (target == 0) | (head[before] != head[target]) | (forward[before] < begins[interval])
        begins, ends = np.sort(target[first]), np.sort(target[last]) + 1
        fresh = (prefixes[ends] == length) & (head[begins] != SEPARATOR)
        prefixes[ends[prefixes[ends] == length]] = found
        begins, ends = begins[fresh], ends[fresh]
        if not len(ends):
            break
    prefixes[0] = 0
    return prefixes[:n]


def repeated_starts(runs: list[bytes]) -> list[np.ndarray]:
    """For each run, its starts (from 0) whose string occurs twice in the block."""
    symbols = np.full(sum(len(r) + 1 for r in runs), SEPARATOR, np.int16)
    at, bounds = 0, []
    for run in runs:
        symbols[at : at + len(run)] = np.frombuffer(run, np.uint8)
        bounds.append((at, at + len(run) - LENGTH + 1))
        at += len(run) + 1
    order = suffix_order(symbols, LENGTH)
    equal = common_prefixes(symbols, order, LENGTH) >= LENGTH
    twice = np.zeros(len(symbols), bool)
    twice[order[equal]] = True
    twice[order[np.flatnonzero(equal) - 1]] = True
    return [np.flatnonzero(twice[low:high]) for low, high in bounds]


def _shipped(text: bytes, row: dict) -> Iterator[tuple[int, int, bytes]]:
    """Division, first start and bytes of the parts of a run that go to blocks."""
    start, n, ahead, by_place = (row[k] for k in ("start", "n", "ahead", "by_place"))
    width = -(-PARTS // by_place)
    low = 0
    while low < n:
        division = (ahead - low) // width
        high = min(n, ahead - division * width + 1)
        yield division, start + low, text[start + low : start + high - 1 + LENGTH]
        low = high


def _counted(text: bytes, row: dict) -> Iterator[tuple[int, int]]:
    """Start and hash of every string of a run."""
    start, n = row["start"], row["n"]
    hashes = RangeHash(np.frombuffer(text[start : start + n - 1 + LENGTH], np.uint8)).fixed(LENGTH)
    return zip(range(start, start + n), hashes.view(np.int64).tolist())


@dataclass
class Repeats:
    """``spans``: ``doc, mark, spans`` (arrays of byte ranges, merged, in order)
    of documents that lose bytes; ``texts``: ``doc, mark, text`` of all documents
    that could."""

    spans: DataFrame
    texts: DataFrame


def find_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Repeats:
    """Byte ranges covered by a string of ``LENGTH`` bytes that also starts
    elsewhere, in the same or another document.

    ``doc`` is the key and ``mark`` a hash of the text; together they name a
    document. Rows that agree in both are copies and lose all the same bytes. A
    null text is empty; texts shorter than ``LENGTH`` have no strings. A null
    key is one like any other. An empty table has no repeats. Runs are counted
    before they are joined, so copies of any number meet as counts only.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    runs = durable(scan_runs(named), "runs")
    path = runs.inputFiles()[0].rsplit("/", 1)[0] if runs.inputFiles() else None
    again = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    again = durable(again, "anchors")  # as a table of its own, so that the join can divide a frequent anchor
    met = durable(runs.join(again, "anchor", "left_semi"), "met")
    if path:
        delete(spark, path)
    one = F.struct("doc", "mark", "start", "n", "ahead")
    kinds = durable(met.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(one).alias("run")), "kinds")
    whole = met.join(kinds.where("copies > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    covered = whole.select("doc", "mark", F.col("start").alias("low"), (F.col("start") + F.col("n") - 1 + LENGTH).alias("high"))

    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_kinds")).where("n_kinds > 1")
    parts = F.ceil(F.col("n_kinds") / RUNS)
    divided = several.select("anchor", F.when(parts <= DIVISIONS, parts.cast("int")).alias("by_place"))  # null: counted
    searched = kinds.join(divided, "anchor").select("anchor", (F.col("copies") == 1).alias("alone"), "run.*", "by_place")
    involved = met.select("doc", "mark").distinct()
    texts = named.dropDuplicates(["doc", "mark"]).alias("t").join(
        involved.alias("i"), F.col("t.doc").eqNullSafe(F.col("i.doc")) & (F.col("t.mark") == F.col("i.mark")), "left_semi"
    )
    texts = durable(texts, "texts")
    fields = F.struct("anchor", "alone", "start", "n", "ahead", "by_place")
    by_text = searched.groupBy("doc", "mark").agg(F.collect_list(fields).alias("runs"))
    cut = texts.alias("t").join(by_text.alias("r"), F.col("t.doc").eqNullSafe(F.col("r.doc")) & (F.col("t.mark") == F.col("r.mark")))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                data = batch.column(2)[i].as_py().encode()
                out = []
                for r in batch.column(3)[i].as_py():
                    if r["by_place"] is None:
                        out += [(r["anchor"], r["alone"], None, start, None, content) for start, content in _counted(data, r)]
                    else:
                        out += [(r["anchor"], r["alone"], *part, None) for part in _shipped(data, r)]
                anchors, alone, division, start, string, content = zip(*out)
                place = pa.array(np.full(len(out), i))
                keys = [batch.column(c).take(place) for c in range(2)]
                arrays = [pa.array(anchors, pa.int64()), pa.array(division, pa.int64()), pa.array(alone), pa.array(start, pa.int32())]
                arrays += [pa.array(string, pa.binary()), pa.array(content, pa.int64())]
                yield pa.RecordBatch.from_arrays([*keys, *arrays], ["doc", "mark", "anchor", "division", "alone", "start", "string", "content"])

    doc = named.schema["doc"].dataType.simpleString()
    shipped = cut.select("t.doc", "t.mark", "text", "runs").mapInArrow(
        ship, f"doc {doc}, mark long, anchor long, division long, alone boolean, start int, string binary, content long"
    )
    shipped = durable(shipped, "shipped")
    counted = shipped.where("content IS NOT NULL").select("doc", "mark", "anchor", "content", "alone", "start")
    twice = counted.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "content")
    twice = durable(twice, "twice")
    counted = counted.where("alone").join(twice, ["anchor", "content"], "left_semi")
    counted_spans = counted.select("doc", "mark", F.col("start").alias("low"), (F.col("start") + LENGTH).alias("high"))
    shipped = shipped.where("string IS NOT NULL").drop("content")
    total = shipped.agg(F.coalesce(F.sum(F.length("string")), F.lit(0))).first()[0]
    blocks = F.pmod(F.xxhash64("anchor", "division"), F.lit(total // BLOCK_BYTES + 1))

    def search(block: pa.Table) -> pa.Table:
        starts = repeated_starts(block.column("string").to_pylist())
        alone = block.column("alone").to_pylist()
        found = [s if a else s[:0] for s, a in zip(starts, alone)]
        place = np.repeat(np.arange(len(found)), [len(s) for s in found])
        low = np.asarray(block.column("start"))[place] + (np.concatenate(found) if found else 0)
        keys = [block.column(c).take(pa.array(place)) for c in ("doc", "mark")]
        return pa.Table.from_arrays([*keys, pa.array(low, pa.int32()), pa.array(low + LENGTH, pa.int32())], ["doc", "mark", "low", "high"])

    searched_spans = shipped.withColumn("block", blocks).groupBy("block").applyInArrow(search, f"doc {doc}, mark long, low int, high int")
    every = covered.unionByName(counted_spans).unionByName(searched_spans).groupBy("doc", "mark").agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"))
    return Repeats(every, texts)


def merged(spans: pa.ListArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number and bounds of the ranges of every row, overlapping and
    touching ones joined. The ranges of a row are sorted by their starts."""
    row = np.repeat(np.arange(len(spans)), np.diff(spans.offsets))
    flat = spans.flatten()
    low, high = (np.asarray(flat.field(name), dtype=np.int64) for name in ("low", "high"))
    apart = np.cumsum(sizes + 1) - (sizes + 1)  # rows do not touch each other
    low, reach = low + apart[row], np.maximum.accumulate(high + apart[row]) if len(high) else high
    new = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]])) if len(low) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(low))[: len(new)] - 1
    row = row[new]
    return row, low[new] - apart[row], reach[last] - apart[row]


def cut_repeats(repeats: Repeats) -> DataFrame:
    """``doc, mark, removed, kept``: the ranges that go and the bytes that stay
    of every document that loses some."""
    joined = repeats.texts.alias("t").join(
        repeats.spans.alias("s"), F.col("t.doc").eqNullSafe(F.col("s.doc")) & (F.col("t.mark") == F.col("s.mark"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text.as_py().encode() for text in batch.column(2)]
            row, low, high = merged(batch.column(3), np.array([len(t) for t in texts], np.int64))
            bounds = np.searchsorted(row, np.arange(len(texts) + 1))
            kept = []
            for data, first, last in zip(texts, bounds, bounds[1:]):
                edges = [0, *np.column_stack([low[first:last], high[first:last]]).ravel().tolist(), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            ranges = pa.StructArray.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["low", "high"])
            removed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ranges)
            arrays = [batch.column(0), batch.column(1), removed, pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "mark", "removed", "kept"])

    doc = joined.select("t.doc").schema["doc"].dataType.simpleString()
    return joined.select("t.doc", "t.mark", "text", "spans").mapInArrow(cut, f"doc {doc}, mark long, removed array<struct<low:int,high:int>>, kept binary")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key, n_bytes, removed`` and ``kept_sha256``, the
    digest of the bytes that stay. Rules for odd rows: see ``find_repeats``."""
    cut = cut_repeats(find_repeats(docs, text, key)).select("doc", "mark", "removed", F.sha2("kept", 256).alias("digest"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("mark"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("own")
    )
    joined = rows.alias("d").join(cut.alias("c"), F.col("d.doc").eqNullSafe(F.col("c.doc")) & (F.col("d.mark") == F.col("c.mark")), "left")
    none = F.array().cast("array<struct<low:int,high:int>>")
    return joined.select(
        F.col("d.doc").alias(key), "n_bytes", F.coalesce("removed", none).alias("removed"), F.coalesce("digest", "own").alias("kept_sha256")
    )
