"""Positional splits of a table in key order, without numbering its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count
from math import isqrt
from operator import and_, or_

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from feedlens import schema as S

Key = tuple
#: Rows behind the first key and before the second; ``None`` is no bound.
Range = tuple[Key | None, Key | None]

#: Rows of a range whose keys one task sorts, and keys drawn to cut a larger one.
ROWS_SORTED, KEYS_DRAWN = 1_000_000, 10_000


def sort_by_key(df: DataFrame, keys: list[str] = S.KEYS) -> DataFrame:
    """Total order by row key, nulls last.

    The hash of the whole row follows the key, so rows that share a key also
    have a fixed order and can fall into different sort ranges.
    """
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys], F.xxhash64(*df.columns))


def _same(column: Column, value) -> Column:
    return column.isNull() if value is None else column == F.lit(value)


def _lexicographic(bound: Key, keys: list[str], step: Callable[[Column, object], Column]) -> Column:
    """OR over the columns: all earlier ones equal the bound, this one differs.

    Spelled out instead of comparing structs, so that the parquet reader can
    skip row groups by it.
    """
    terms = []
    for i, k in enumerate(keys):
        equal = [_same(F.col(p), b) for p, b in zip(keys[:i], bound)]
        terms.append(reduce(and_, [*equal, step(F.col(k), bound[i])]))
    return reduce(or_, terms)


def key_below(bound: Key, keys: list[str] = S.KEYS) -> Column:
    """Rows before ``bound`` in key order, where missing keys come last."""
    return _lexicographic(bound, keys, lambda c, value: c.isNotNull() if value is None else c < F.lit(value))


def key_above(bound: Key, keys: list[str] = S.KEYS) -> Column:
    """Rows after ``bound`` in key order, where missing keys come last."""
    return _lexicographic(bound, keys, lambda c, value: F.lit(False) if value is None else (c > F.lit(value)) | c.isNull())


def key_equals(bound: Key, keys: list[str] = S.KEYS) -> Column:
    return reduce(and_, [_same(F.col(k), v) for k, v in zip(keys, bound)])


@dataclass(frozen=True)
class KeyRanges:
    """A table of ``rows`` rows, and ranges of its keys that narrow down to a position."""

    table: DataFrame
    rows: int
    keys: list[str]

    def at(self, positions: list[int]) -> dict[int, tuple[Key, int]]:
        """By position (from 0) in key order: the key of that row, and how many
        rows with the same key stand before it."""
        found, sorts = {}, {}
        for position in positions:
            if not 0 <= position < self.rows:
                continue
            range_, before, key = self._narrow(position)
            if key is None:
                sorts.setdefault((range_, before), []).append(position)
            else:
                found[position] = key, position - before
        for (range_, before), inside in sorts.items():
            found.update(self._sorted(range_, before, inside))
        return found

    def _within(self, range_: Range) -> DataFrame:
        low, high = range_
        rows = self.table if low is None else self.table.where(key_above(low, self.keys))
        return (rows if high is None else rows.where(key_below(high, self.keys))).select(*self.keys)

    def _order(self) -> list[Column]:
        return [F.col(k).asc_nulls_last() for k in self.keys]

    def _narrow(self, position: int) -> tuple[Range, int, Key | None]:
        """A range of at most ``ROWS_SORTED`` rows around the position, the rows before
        it and no key, or the key of the position and the rows before that key.

        Two keys of a draw that should enclose the position cut the range, and rows
        are counted on their sides. The draw only proposes cuts: a position outside
        of them takes another round.
        """
        range_, before, size = (None, None), 0, self.rows
        for seed in count():
            if size <= ROWS_SORTED:
                return range_, before, None
            rows = self._within(range_)
            drawn = [tuple(row) for row in rows.sample(min(1.0, KEYS_DRAWN / size), seed).orderBy(*self._order()).collect()]
            if not drawn:
                continue
            expected, slack = (position - before) * len(drawn) // size, 2 * isqrt(len(drawn))
            low, high = drawn[max(0, expected - slack)], drawn[min(len(drawn) - 1, expected + slack)]
            sides = [side(key, self.keys) for key in (low, high) for side in (key_below, key_equals)]
            under_low, at_low, under_high, at_high = rows.agg(*[F.count_if(side) for side in sides]).first()
            place = position - before
            if place < under_low:
                range_, size = (range_[0], low), under_low
            elif place < under_low + at_low:
                return range_, before + under_low, low
            elif place < under_high:
                range_, before, size = (low, high), before + under_low + at_low, under_high - under_low - at_low
            elif place < under_high + at_high:
                return range_, before + under_high, high
            else:
                range_, before, size = (high, range_[1]), before + under_high + at_high, size - under_high - at_high

    def _sorted(self, range_: Range, before: int, positions: list[int]) -> dict[int, tuple[Key, int]]:
        """:meth:`at` for positions in one range, whose keys are sorted by one task."""
        counted = self._within(range_).groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
        running = Window.orderBy(*self._order()).rowsBetween(Window.unboundedPreceding, 0)
        first = F.lit(before) + F.sum("_n").over(running) - F.col("_n")
        covers = [(F.col("_first") <= p) & (F.col("_first") + F.col("_n") > p) for p in positions]
        rows = counted.withColumn("_first", first).where(reduce(or_, covers)).collect()
        return {p: (tuple(row[k] for k in self.keys), p - row["_first"]) for p in positions for row in rows if row["_first"] <= p < row["_first"] + row["_n"]}


def key_ranges(df: DataFrame, keys: list[str] = S.KEYS) -> KeyRanges:
    """Finds rows of ``df`` by their position in key order.

    Passes over the keys count rows beside proposed cuts, so no key moves but those
    of the last range, at most ``ROWS_SORTED`` rows however large the table. ``df``
    is read several times and should be stored.
    """
    return KeyRanges(df, df.count(), list(keys))


def positional_split(
    df: DataFrame, train_until: float = 0.6, test_from: float = 0.8, keys: list[str] = S.KEYS
) -> tuple[DataFrame, DataFrame]:
    """First share of the rows for training, last share for testing.

    In key order, since a distributed table has no file order. Both sides are
    filters against a boundary, so no whole row moves. Rows that share a key are
    ordered by the hash of the whole row, as in :func:`sort_by_key`; only rows
    that are equal in every column stay together, on the later side.
    """
    ranges = key_ranges(df, keys)
    train_end, test_start = int(ranges.rows * train_until), int(ranges.rows * test_from)
    row_hash = F.xxhash64(*df.columns)
    found = ranges.at([train_end, test_start])

    def sides(position: int) -> tuple[Column, Column]:
        if position not in found:  # behind the last row
            return F.lit(True), F.lit(False)
        key, offset = found[position]
        below, same, above = key_below(key, keys), key_equals(key, keys), key_above(key, keys)
        if not offset:
            return below, above | same
        # Inside the copies of one key. The first terms are implied; they are
        # what a reader can push down.
        copies = df.where(same).select(row_hash.alias("_tie"))
        (tie,), _ = key_ranges(copies, ["_tie"]).at([offset])[offset]
        return (below | same) & (below | (row_hash < F.lit(tie))), (above | same) & (above | (row_hash >= F.lit(tie)))

    return df.where(sides(train_end)[0]), df.where(sides(test_start)[1])


def order_report(df: DataFrame, keys: list[str] = S.KEYS) -> DataFrame:
    """One row about the order in which ``df`` would be written: ``rows``, whether
    every partition is ``sorted_inside``, and whether each partition starts where
    the one before it ends or later (``sorted_across``). Missing keys come last.

    Only the bounds of the partitions are compared across tasks, a row each.
    """
    types = ", ".join(f"{side}_{k} {df.schema[k].dataType.simpleString()}" for side in ("first", "last") for k in keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, n, in_order = None, None, 0, True
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                place = [(value is None, value if value is not None else 0) for value in row]
                in_order = in_order and (last is None or last[1] <= place)
                first, last, n = first or (row, place), (row, place), n + 1
        if n:
            values = [TaskContext.get().partitionId(), n, in_order, *first[0], *last[0]]
            yield pa.RecordBatch.from_pylist([dict(zip(names, values))], schema=pa.schema(list(zip(names, arrow))))

    names = ["part", "n", "in_order", *[f"{side}_{k}" for side in ("first", "last") for k in keys]]
    arrow = [pa.int32(), pa.int64(), pa.bool_(), *[to_arrow_type(df.schema[k].dataType) for _ in range(2) for k in keys]]
    parts = df.select(*keys).mapInArrow(scan, f"part int, n long, in_order boolean, {types}")
    known = lambda side: F.struct(*[F.struct(F.col(f"{side}_{k}").isNull(), F.col(f"{side}_{k}")) for k in keys])
    before = F.lag(known("last")).over(Window.orderBy("part"))  # a row per partition
    across = parts.withColumn("across", F.coalesce(before <= known("first"), F.lit(True)))
    return across.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.bool_and("in_order"), F.lit(True)).alias("sorted_inside"),
        F.coalesce(F.bool_and("across"), F.lit(True)).alias("sorted_across"),
    )
