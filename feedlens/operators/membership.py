"""Bloom filters on Spark's bitmap functions: rows that cannot match stay unshuffled."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of ``bitmap_construct_agg``.
BITMAP_BITS = 32_768
#: Bounds of the filter's size: 4 kB to 8 MB, whatever the number of keys.
LEAST_BITS, MOST_BITS = BITMAP_BITS, 1 << 26
#: Bits per key, as long as the bound allows, and bits that one key sets.
BITS_PER_KEY, PROBES = 8, 2


def _positions(columns: list[str], bits: int) -> list[Column]:
    """Positions from 1 on."""
    return [F.pmod(F.xxhash64(*columns, F.lit(probe)), F.lit(bits)) + 1 for probe in range(PROBES)]


def bloom_filter(keys: DataFrame, columns: list[str], most_bits: int = MOST_BITS) -> DataFrame:
    """One row ``filter``: bitmaps of the keys. Its size is bounded; with more keys
    than it is made for, it lets more rows pass, never fewer."""
    n = keys.count()
    bits = LEAST_BITS
    while bits < min(n * BITS_PER_KEY, most_bits):
        bits *= 2
    position = keys.select(F.explode(F.array(*_positions(columns, bits))).alias("p"))
    maps = position.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    held = F.map_from_entries(F.collect_list(F.struct("bucket", "map")))
    all_buckets = F.sequence(F.lit(1).cast("long"), F.lit(bits // BITMAP_BITS).cast("long"))
    return maps.agg(held.alias("held")).select(F.transform(all_buckets, lambda b: F.col("held")[b]).alias("filter"))


def maybe_member(columns: list[str], filter_: DataFrame) -> Column:
    """False only for rows whose key is not in the filter. The filter is one
    bounded value, looked up once per query."""
    (row,) = filter_.collect()
    bitmaps = F.array(*[F.lit(bytes(m)) if m is not None else F.lit(None).cast("binary") for m in row["filter"]])
    bits = len(row["filter"]) * BITMAP_BITS

    def is_set(position: Column) -> Column:
        bit = F.bitmap_bit_position(position)
        bitmap = F.get(bitmaps, (F.bitmap_bucket_number(position) - 1).cast("int"))
        byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce((F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))).cast("int") % 2) == 1, F.lit(False))

    return reduce(and_, [is_set(p) for p in _positions(columns, bits)])
