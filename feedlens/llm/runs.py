"""Periodic runs of words, by a suffix automaton with link-cut access.

A text is read word by word into a suffix automaton. The links of its states form
a tree; the path from its root to the state of the text read so far is the set of
all suffixes. Every appended word recolours this path with its number. The path
falls into segments by the colour they had: the number of the word where their
strings ended last. A segment of strings up to a length that ended no more than
that length before is a square, and its string starts where the run starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.bytescan import mix

#: Words of the shortest run.
LEAST_WORDS = 12
#: Words that are searched for repeated stretches together.
PIECE_WORDS = 1 << 19


class SuffixPaths:
    """Suffix automaton of the words appended so far, with its link tree cut into
    paths of one colour each. A path is a splay tree ordered by depth; the colour
    of a path stands at the root of its tree."""

    def __init__(self):
        self.length = [0]
        self.link = [-1]
        #: Most states have one successor: its word and state. Others have more.
        self.word, self.to, self.more = [-1], [-1], {}
        self.up, self.above, self.below, self.colour = [-1], [-1], [-1], [-1]
        self.last = 0

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1)
        self.to.append(-1)
        for side in (self.up, self.above, self.below, self.colour):
            side.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        up, above, below, colour = self.up, self.above, self.below, self.colour
        while True:
            p = up[x]
            if p < 0 or (above[p] != x and below[p] != x):
                return
            g = up[p]
            inner = g >= 0 and (above[g] == p or below[g] == p)
            if inner:
                if (above[g] == p) == (above[p] == x):
                    self._rotate(p)
                else:
                    self._rotate(x)
            else:
                colour[x] = colour[p]
            self._rotate(x)
            if inner and (up[x] < 0 or (above[up[x]] != x and below[up[x]] != x)):
                colour[x] = colour[g]
                return

    def _rotate(self, x: int) -> None:
        up, above, below = self.up, self.above, self.below
        p = up[x]
        g = up[p]
        if above[p] == x:
            moved = above[p] = below[x]
            below[x] = p
        else:
            moved = below[p] = above[x]
            above[x] = p
        if moved >= 0:
            up[moved] = p
        up[p] = x
        up[x] = g
        if g >= 0:
            if above[g] == p:
                above[g] = x
            elif below[g] == p:
                below[g] = x

    def append(self, w: int) -> int:
        """The state of the whole text with ``w`` behind it."""
        length, link, word, to, more = self.length, self.link, self.word, self.to, self.more
        p = self.last
        state = self.last = self._state(length[p] + 1, 0)
        q = -1
        while p >= 0:
            if word[p] == w:
                q = to[p]
                break
            if word[p] < 0:
                word[p], to[p] = w, state
            else:
                others = more.get(p)
                if others is None:
                    more[p] = {w: state}
                elif w in others:
                    q = others[w]
                    break
                else:
                    others[w] = state
            p = link[p]
        if p >= 0:
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                link[state] = self._split(p, w, q)
        self.up[state] = link[state]
        return state

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the strings of ``q`` that are no longer than those of ``p``
        and one word. It ended last where ``q`` did, so it joins its path above it."""
        length, link, word, to, more = self.length, self.link, self.word, self.to, self.more
        copy = self._state(length[p] + 1, link[q])
        word[copy], to[copy] = word[q], to[q]
        if q in more:
            more[copy] = dict(more[q])
        link[q] = copy
        while p >= 0:
            if word[p] == w:
                if to[p] != q:
                    break
                to[p] = copy
            else:
                others = more.get(p)
                if others is None or others.get(w) != q:
                    break
                others[w] = copy
            p = link[p]
        self._splay(q)
        top = self.above[q]
        self.above[copy] = top
        if top >= 0:
            self.up[top] = copy
        self.above[q] = copy
        self.up[copy] = q
        return copy

    def recolour(self, state: int, number: int) -> list[tuple[int, int]]:
        """Give the path from the root to ``state`` a colour. Returns the former
        colour and the longest string of each of its segments."""
        up, below, colour, length = self.up, self.below, self.colour, self.length
        segments = []
        x, under = state, -1
        while x >= 0:
            self._splay(x)
            former = colour[x]
            if former >= 0:
                segments.append((former, length[x]))
            cut = below[x]
            if cut >= 0:
                colour[cut] = former
            below[x] = under
            under = x
            x = up[x]
        colour[under] = number
        return segments


def runs_of(words: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """``start, length, period`` of the runs in a sequence of numbers.

    The longest common string that ends at word ``e`` and at the appended word
    ``i`` has ``size`` words. If ``i - e <= size``, that is a run with period
    ``i - e`` so far, whose start no later word changes; the last ``i`` is its end.
    No smaller period fits, else the string would have ended later than at ``e``.
    """
    paths = SuffixPaths()
    ends: dict[tuple[int, int], int] = {}
    for i, w in enumerate(words):
        for e, size in paths.recolour(paths.append(w), i):
            if size >= i - e:
                ends[e - size + 1, i - e] = i
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items() if end - start + 1 >= least)


def repeating_stretches(words: np.ndarray, owners: np.ndarray, least: int = LEAST_WORDS) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches that hold all runs, each run in one of them.

    A run with period p and ``least`` words has equal strings of half as many
    words p apart, and those cover it. So words in no string that occurs twice in
    a stretch cut it in two, until nothing is left to cut. ``owners`` are the texts
    of the words; no stretch crosses them.
    """
    gram = max(1, least // 2)
    at = np.arange(len(words))  # positions that are left
    part = owners.astype(np.uint64)
    while len(at) >= least:
        follows = np.ones(len(at), bool)
        follows[1:] = (at[1:] == at[:-1] + 1) & (part[1:] == part[:-1])
        part = np.cumsum(~follows).astype(np.uint64)
        key = mix(part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))[: len(at) - gram + 1].copy()
        for k in range(gram):
            key = mix(key + words[at[k : len(at) - gram + 1 + k]])
        whole = part[: len(key)] == part[gram - 1 :]
        places = np.flatnonzero(whole)
        order = np.argsort(key[places], kind="stable")
        equal = key[places][order[1:]] == key[places][order[:-1]]
        twice = np.zeros(len(places), bool)
        twice[order[1:]] |= equal
        twice[order[:-1]] |= equal
        starts = places[twice]
        covered = np.zeros(len(at) + 1, np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + gram, -1)
        kept = np.cumsum(covered[:-1]) > 0
        if kept.all():
            break
        at, part = at[kept], part[kept]
    if len(at) >= least:
        bounds = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1]), [True]]))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if high - low >= least:
                yield int(at[low]), int(at[high - 1]) + 1


def runs_in(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[list[tuple[int, int, int]]]:
    """The runs of every text, by start and period."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    owners = np.repeat(np.arange(len(texts)), np.diff(offsets))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in repeating_stretches(ids, owners, least):
        text = int(owners[low])
        shift = low - int(offsets[text])
        found[text] += [(start + shift, length, period) for start, length, period in runs_of(ids[low:high].tolist(), least)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text that no run repeats: of each run, its first period."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        dropped[start + period] += 1
        dropped[start + length] -= 1
    repeats = np.cumsum(dropped[:-1]) > 0
    return b" ".join(w for w, repeat in zip(words, repeats.tolist()) if not repeat)


def _portions(texts: list[list[bytes]], limit: int = PIECE_WORDS) -> Iterator[list[list[bytes]]]:
    """Runs of whole texts of about ``limit`` words; a longer text stands alone."""
    total = 0

    def number(words: list[bytes]) -> int:
        nonlocal total
        total += len(words)
        return total // limit

    return (list(portion) for _, portion in groupby(texts, number))


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Whole rows in a struct ``row``, with ``n_words``, ``runs`` (``start, length,
    period`` in words, by start and period) and the ``collapsed`` text.

    Words are what ASCII white space separates, compared as they are. A run is a
    stretch with a smallest period of at most half its length, as far as it goes
    both ways, of at least ``least`` words. A null or empty text has no words, no
    runs and an empty collapsed text; equal rows get equal results; an empty table
    gives none. A text is read in one task, with about 1 kB a word of the
    stretches that repeat.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            runs = [r for portion in _portions(texts) for r in runs_in(portion, least)]
            counts = pa.array([len(words) for words in texts], pa.int64())
            flat = pa.array([dict(zip(("start", "length", "period"), r)) for of_text in runs for r in of_text], _RUN)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
            short = pa.array([collapsed(words, r) for words, r in zip(texts, runs)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, lists, short], ["row", "n_words", "runs", "collapsed"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(scan, f"row {row_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
