"""Array expressions whose time grows with the length of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that are summed up together. Adding an item to a list copies the list, so
#: lists are kept to this length, and to the number of blocks.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(steps: Column, start: Column, inclusive: bool) -> Column:
    def advance(state: Column, step: Column) -> Column:
        total = state["total"] + step
        return F.struct(total.alias("total"), F.concat(state["list"], F.array(total if inclusive else state["total"])).alias("list"))

    return F.aggregate(steps, F.struct(start.alias("total"), F.array().cast("array<int>").alias("list")), advance, lambda state: state["list"])


def running_totals(steps: Column) -> Column:
    """The sum of the integers ``steps`` up to each of them, itself included."""

    def in_blocks(steps: Column) -> Column:
        last = F.floor(F.greatest(F.size(steps) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(steps, k * BLOCK + 1, BLOCK))

    def totals(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda total, step: total + step))
        return F.flatten(F.zip_with(blocks, _running(sums, F.lit(0), False), lambda block, start: _running(block, start, True)))

    return let(let(steps, in_blocks), totals)
