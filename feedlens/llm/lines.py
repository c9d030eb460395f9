"""Line dedup by pairwise alignment.

Documents that overlap are found through the hashes of runs of lines they share.
Each document is aligned with the first holder of every such run by a patience
diff; what is aligned is deleted from the later one. What is left of it, moved and
repeated blocks, is aligned again until no common block remains.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.llm.bytescan import mix
from feedlens.operators.skew import salted_lookup
from feedlens.sources.durable import durable

#: Characters of the aligned lines from which a block is deleted.
LEAST_CHARS = 100


def patience_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of aligned equal items, increasing in both; some, if the sides
    have an item in common.

    Common ends are matched first. Inside, the rarest common items are anchors,
    those unique on both sides if there are any, else the n-th occurrence on one
    side and the n-th on the other. The most that increase together are matched,
    and the gaps between them in turn.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            pairs.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        anchors = _longest_increasing(_rarest_pairs(a, i, i_end, b, j, j_end))
        for (k, m), (k_next, m_next) in zip([(i - 1, j - 1), *anchors], [*anchors, (i_end, j_end)]):
            if anchors:
                todo.append((k + 1, k_next, m + 1, m_next))
        pairs += anchors
    return sorted(pairs)


def _rarest_pairs(a: list, i: int, i_end: int, b: list, j: int, j_end: int) -> list[tuple[int, int]]:
    """Positions of the rarest items that ``a[i:i_end]`` and ``b[j:j_end]`` share,
    occurrence by occurrence."""
    count_a, count_b = Counter(a[i:i_end]), Counter(b[j:j_end])
    often = {item: max(n, count_b[item]) for item, n in count_a.items() if item in count_b}
    rarest = min(often.values(), default=0)
    places = defaultdict(list)
    for m in range(j_end - 1, j - 1, -1):  # the first place comes off last
        if often.get(b[m]) == rarest:
            places[b[m]].append(m)
    return [(k, places[a[k]].pop()) for k in range(i, i_end) if places.get(a[k])]


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of ``pairs``, which increase in the first part, that
    increases in the second."""
    tops: list[int] = []
    chain: list[int] = []
    back: list[int] = []
    for n, (_, m) in enumerate(pairs):
        pile = bisect_left(tops, m)
        back.append(chain[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(m)
            chain.append(n)
        else:
            tops[pile], chain[pile] = m, n
    at, found = (chain[-1] if chain else -1), []
    while at >= 0:
        found.append(pairs[at])
        at = back[at]
    return found[::-1]


def least_runs(sizes: np.ndarray, offsets: np.ndarray, least: int = LEAST_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of lines with ``least`` characters
    from every line on, and up to every line.

    ``offsets`` bound the lines of each document. Every line of a block of
    ``least`` characters lies in such a run inside the block: in the one up to it,
    the one from it on, or the one from the last line before it from which the
    block still has ``least``.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    line = np.arange(len(sizes))
    document = np.searchsorted(offsets, line, "right") - 1
    ends = np.searchsorted(total, total[:-1] + least)
    forward = ends <= offsets[document + 1]
    starts = np.searchsorted(total, total[1:] - least, "right") - 1
    backward = starts >= offsets[document]
    backward[backward] = ends[starts[backward]] != line[backward] + 1  # the same run from its start
    return np.concatenate([line[forward], starts[backward]]), np.concatenate([ends[forward], line[backward] + 1])


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def run_hashes(lines: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the lines of every run, wherever it lies."""
    n = len(lines)
    powers, inverse = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))]) for base in (_BASE, _INVERSE))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(lines) * powers[:-1])])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def common_blocks(earlier: list, later: list, sizes: list[int], least: int = LEAST_CHARS) -> list[int]:
    """Lines of ``later`` in blocks of at least ``least`` characters: runs of
    lines that follow each other on both sides.

    Both sides are read as their shortest runs of ``least`` characters and
    aligned; the lines of aligned runs go. Runs that stand in another order or
    more often than in ``earlier`` are left over and aligned again, with as many
    repeats of the earlier ones as they have room for, until no common run is
    left. Every alignment matches a run, so this ends, and a block of which no
    line is covered by aligned runs would hold a common run.
    """
    size_of = dict(zip(later, sizes))
    number = {line: n for n, line in enumerate(dict.fromkeys([*later, *earlier]))}

    def runs_of(side: list) -> tuple[list[int], np.ndarray, np.ndarray]:
        starts, ends = least_runs(np.array([size_of.get(line, 0) for line in side], np.int64), np.array([0, len(side)]), least)
        order = np.lexsort((ends, starts))
        starts, ends = starts[order], ends[order]
        return run_hashes(np.array([number[line] for line in side], np.uint64), starts, ends).tolist(), starts, ends

    theirs = runs_of(earlier)[0]
    runs, starts, ends = runs_of(later)
    held = set(theirs)
    left = [k for k, run in enumerate(runs) if run in held]
    gone = np.zeros(len(later) + 1, np.int64)  # +1 where an aligned run starts, -1 behind it
    while left:
        wanted = {runs[k] for k in left}
        theirs = [run for run in theirs if run in wanted]
        aligned = [left[i] for i, _ in patience_pairs([runs[k] for k in left], theirs * max(1, len(left) // len(theirs)))]
        if not aligned:
            break
        np.add.at(gone, starts[aligned], 1)
        np.add.at(gone, ends[aligned], -1)
        kept = np.concatenate([[0], np.cumsum(np.cumsum(gone[:-1]) == 0)])
        left = [k for k in left if kept[ends[k]] > kept[starts[k]]]
    return np.flatnonzero(np.cumsum(gone[:-1])).tolist()


def identity(key: Column, text: Column) -> Column:
    """Orders documents: by key, a null last, then by a hash of the text."""
    return F.struct(key.isNull().alias("unknown"), key.alias("key"), F.xxhash64(text).alias("text"))


def overlapping_pairs(sequences: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``earlier, later``: documents to align, each pair once.

    Postings are the shortest runs of lines with ``least`` characters, and every
    holder of a run is paired with its first. A line that a document has to lose
    lies in such a run, so these pairs miss no block, however many documents have
    it, and grow with the postings only.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, sizes = batch.column(1), batch.column(2)
            offsets = np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            starts, ends = least_runs(sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets, least)
            hashes = run_hashes(lines.flatten().to_numpy(zero_copy_only=False).view(np.uint64), starts, ends)
            ids = batch.column(0).take(pa.array(np.searchsorted(offsets, starts, "right") - 1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes.view(np.int64))], ["id", "run"])

    id_type = sequences.schema["id"].dataType.simpleString()
    postings = durable(sequences.select("id", "lines", "sizes").mapInArrow(post, f"id {id_type}, run long"), "runs")
    held = postings.groupBy("run").agg(F.min("id").alias("earlier"), F.max("id").alias("last")).where("earlier <> last")
    found = salted_lookup(postings, held.select("run", "earlier"), "run", ["id"], "inner")
    return found.where("id <> earlier").select("earlier", F.col("id").alias("later")).distinct()


def deleted_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST_CHARS) -> DataFrame:
    """``id, deleted``: numbers (from 0) of the lines to delete, for documents
    that lose any. Lines are compared without blanks at their ends."""
    lines = F.transform(F.split(F.col(text), "\n", -1), lambda line: F.trim(line))
    hashed = docs.where(F.col(text).isNotNull()).select(
        identity(F.col(key), F.col(text)).alias("id"),
        F.transform(lines, lambda line: F.xxhash64(line)).alias("lines"),
        F.transform(lines, lambda line: F.length(line)).alias("sizes"),
    )
    every = durable(hashed.withColumn("whole", F.xxhash64("lines")).dropDuplicates(["id"]), "lines")
    heads = every.groupBy("whole").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = durable(heads, "heads")
    distinct = every.join(heads.select(F.col("head").alias("id")), "id", "left_semi").drop("whole")
    pairs = durable(overlapping_pairs(distinct, least), "pairs")
    firsts = distinct.select(F.col("id").alias("earlier"), F.col("lines").alias("other"))
    met = salted_lookup(pairs.withColumn("code", F.xxhash64("earlier")), firsts.withColumn("code", F.xxhash64("earlier")), ["code", "earlier"], ["later"], "inner")
    aligned = met.join(distinct.select(F.col("id").alias("later"), "lines", "sizes"), "later")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("other", "lines", "sizes"))
            deleted = [common_blocks(*row, least) for row in zip(*columns)]
            out = pa.RecordBatch.from_arrays([batch.column("later"), pa.array(deleted, pa.list_(pa.int32()))], ["id", "deleted"])
            yield out.filter(pa.array([bool(d) for d in deleted]))

    id_type = distinct.schema["id"].dataType.simpleString()
    found = aligned.select("later", "other", "lines", "sizes").mapInArrow(align, f"id {id_type}, deleted array<int>")
    of_heads = found.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("deleted")))).alias("deleted"))
    copied = heads.where("n > 1").join(of_heads, F.col("head") == F.col("id"), "left").select("whole", "head", "deleted")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda sum_, size: sum_ + size)
    all_lines = F.sequence(F.lit(0), F.size("lines") - 1)
    copies = salted_lookup(every.withColumn("spread", F.col("id.key").cast("string")), copied, "whole", ["spread"], "inner")
    of_copies = copies.where(F.col("id") != F.col("head")).select("id", F.when(total >= least, all_lines).otherwise(F.col("deleted")).alias("deleted"))
    return of_heads.unionByName(of_copies.where("deleted IS NOT NULL"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents without common blocks that an earlier one has, as whole
    rows with ``n_lines`` and ``n_deleted`` added behind a struct ``row``.

    Earlier is the smaller key, a null key last, then the smaller hash of the
    text; rows with the same key and text are one document and are edited alike.
    A later copy of a document loses all its lines, if they make up a block, and
    becomes empty. A null text stays null, with no lines; an empty text is one
    empty line. Other columns pass unchanged.
    """
    deleted = deleted_lines(docs, text, key, **options)
    rows = docs.select(identity(F.col(key), F.col(text)).alias("id"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    joined = rows.join(deleted, "id", "left")
    lines = F.split(F.col("row")[text], "\n", -1)
    numbers = F.coalesce("deleted", F.array().cast("array<int>"))
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(numbers, i)), "\n")
    edited = F.col("row").withField(text, F.when(F.size(numbers) > 0, kept).otherwise(F.col("row")[text]))
    n_lines = F.when(F.col("row")[text].isNull(), 0).otherwise(F.size(lines))
    return joined.select(edited.alias("row"), n_lines.cast("long").alias("n_lines"), F.size(numbers).cast("long").alias("n_deleted"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Whole rows after line dedup; documents that lost every line go."""
    edited = dedup_lines(docs, text, key, **options).where("n_deleted = 0 OR n_deleted < n_lines")
    return edited.select(*[F.col("row")[c].alias(c) for c in docs.columns])
