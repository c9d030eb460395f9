"""Array operations over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 2**64)
#: Bytes that are worked on together; one longer text is a piece of its own.
PIECE_BYTES = 1 << 21

#: ASCII white space, the separators of words.
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_powers = {base: np.ones(1, np.uint64) for base in (MULTIPLIER, INVERSE)}


def _powers_of(base: int, n: int) -> np.ndarray:
    known = _powers[base]
    if len(known) < n:
        steps = np.full(max(n, 2 * len(known)), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


class RangeHash:
    """Hash of any byte range of a buffer from prefix sums; equal bytes have
    equal hashes wherever they are."""

    def __init__(self, buffer: np.ndarray):
        terms = (buffer.astype(np.uint64) + np.uint64(1)) * _powers_of(MULTIPLIER, len(buffer))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def fixed(self, length: int) -> np.ndarray:
        """Of every range of a length, by its start."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * _powers_of(INVERSE, n))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = _powers_of(INVERSE, len(self.sums))
        return mix((self.sums[ends] - self.sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: number of the first, buffer, offsets into it. A null
    text has no bytes."""
    texts = texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def tokens(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word. Words end where a text ends."""
    inside = ~IS_SPACE[buffer]
    cut = np.zeros(len(buffer) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether a value occurs more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    flags = np.zeros(len(keys), bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return flags


def earlier_equal(keys: np.ndarray) -> np.ndarray:
    """Whether an equal value stands before."""
    order = np.argsort(keys, kind="stable")
    flags = np.zeros(len(keys), bool)
    flags[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return flags
