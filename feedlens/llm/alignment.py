"""Alignment of two tokenizers over the bytes of a text, with corpus-wide counts.

Tokens of both that overlap are linked. How many documents link a pair of ids is
kept in dense vectors, indexed by a minimal perfect hash of the distinct pairs and
summed as a tree of partial vectors. A second pass aligns the documents again and
looks the counts up. Both tokenizers start a token at a single space, so each pass
aligns the distinct words of a chunk of documents once; the first one stores the
tokens of these words with the chunk, and the second one reads them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from io import BytesIO
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.llm.bytescan import mix
from feedlens.sources.durable import durable

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose documents are aligned together; one longer text stands alone.
CHUNK_BYTES = 3 << 20
#: Characters after which a text is cut at the next possible place before it is cut
#: into words, and the number of words that are encoded together.
SEGMENT_CHARS, BATCH_WORDS = 100_000, 4096
#: Distinct pairs behind one hash, and pair rows that are counted in one task.
BUCKET_PAIRS = 250_000
SLICE_ROWS = 2_000_000
#: Partial vectors that are summed in one task.
FAN_IN = 16

#: A pair is one number: first id, then second id in the lower bits.
PAIR_BITS = 24
#: A single space between other characters: both tokenizers start a token there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Any other space.
_NO_CUT = re.compile(r"(?<!\S) | (?!\S)")
#: Pattern of the parts that byte-level vocabularies merge by default (fixed value).
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        alphabet, vocabulary = _byte_alphabet(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.ranked = self._ranked()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.can_cut = not any("▁" in p.lstrip("▁") for p in pieces)  # else a piece may reach over a cut
        #: Texts of ids in groups: inside and at the end of the first side, then of the second.
        self.labels = [f"{i}{end}".encode() for side, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for i in range(len(side)) for end in ends]

    def words(self, text: str) -> Iterator[list[str]]:
        """A text in parts that can be encoded one by one, without the space
        between them; a segment's parts at a time."""
        start = 0
        while self.can_cut and len(text) - start > SEGMENT_CHARS:
            found = _CUT.search(text, start + SEGMENT_CHARS)
            if not found:
                break
            yield _CUT.split(text[start : found.start()])
            start = found.end()
        yield _CUT.split(text[start:]) if self.can_cut else [text]

    def _ranked(self) -> tiktoken.Encoding | None:
        """The first tokenizer as ranks of byte strings, which are faster to merge;
        None unless it is plain byte-level and its merges stand in the order of ids."""
        described = json.loads(self.a.to_str())
        model, split = described["model"], described["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        if not plain or described["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            return None
        merged = [model["vocab"]["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in model["merges"]]
        if merged != sorted(merged):
            return None
        special = {token["id"] for token in described["added_tokens"]}
        ranks = {token: i for i, token in enumerate(self.a_bytes) if i not in special}
        return tiktoken.Encoding("ranks", pat_str=_PARTS, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, words: list[str]) -> list[list[int]]:
        if self.ranked:
            return [self.ranked.encode_ordinary(" " + word) for word in words]
        return [e.ids for e in self.a.encode_batch_fast([" " + word for word in words], add_special_tokens=False)]

    def encode(self, words: pa.StringArray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides: number of tokens by word, and all ids. A word has none
        unless the tokens of both sides are its bytes behind a space."""
        sizes, ids = ([], []), ([], [])
        for low in range(0, len(words), BATCH_WORDS):
            batch = words.slice(low, BATCH_WORDS)
            ends = np.cumsum(pc.binary_length(batch).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            batch = batch.to_pylist()
            whole = (" " + " ".join(batch)).encode()
            sides = [self._ids_a(batch), self.b.encode(batch, num_threads=1)]
            fit = np.ones(len(batch), bool)
            for found, known, token_sizes in zip(sides, (self.a_bytes, self.b_bytes), (self.a_sizes, self.b_sizes)):
                flat = list(chain.from_iterable(found))
                reached = np.concatenate([[0], np.cumsum(token_sizes[np.array(flat, np.int64)])])[np.cumsum([len(f) for f in found])]
                if not np.array_equal(reached, ends) or b"".join([known[i] for i in flat]) != whole:
                    fit &= [b"".join([known[i] for i in of_word]) == b" " + word.encode() for word, of_word in zip(batch, found)]
            for found, size, all_ids in zip(sides, sizes, ids):
                found = found if fit.all() else [f if ok else [] for f, ok in zip(found, fit.tolist())]
                size.append(np.array([len(f) for f in found], np.int64))
                all_ids.append(np.array(list(chain.from_iterable(found)), np.int64))
        none = np.zeros(0, np.int64)
        return [(np.concatenate([none, *size]), np.concatenate([none, *all_ids])) for size, all_ids in zip(sizes, ids)]


@lru_cache(maxsize=1)
def _tokenizers(byte_bpe: str, piece_bpe: str) -> Tokenizers:
    return Tokenizers(byte_bpe, piece_bpe)


class Alignment:
    """The distinct words of many texts, aligned, and the texts as their numbers."""

    def __init__(self, texts: pa.Array, tokenizers: Tokenizers, stored: bytes | None = None):
        """``stored`` are the tokens that :meth:`stored` gave for these texts in
        this order."""
        self.n_texts = len(texts)
        owners, words = self._split(texts, tokenizers)
        found = words.dictionary_encode()
        words, self.n_words = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
        if stored is None:
            (self.n_a, self.a), (self.n_b, self.b) = tokenizers.encode(found.dictionary)
        else:
            buffer = BytesIO(zlib.decompress(stored))
            self.n_a, self.a, self.n_b, self.b = (np.load(buffer).astype(np.int64) for _ in range(4))
        fits = self.n_a > 0
        misfits = np.zeros(self.n_texts, bool)
        misfits[owners[~fits[words]]] = True
        #: Texts and words by place; a text with a word that has no tokens has none.
        self.owners, self.places = owners[~misfits[owners]], words[~misfits[owners]]
        self._align(tokenizers)

    def stored(self) -> bytes:
        """Tokens by word, in the smallest numbers that hold them."""
        buffer = BytesIO()
        for values in (self.n_a, self.a, self.n_b, self.b):
            np.save(buffer, values.astype(np.min_scalar_type(values.max(initial=0))))
        return zlib.compress(buffer.getbuffer(), 1)

    @staticmethod
    def _split(texts: pa.Array, tokenizers: Tokenizers) -> tuple[np.ndarray, pa.StringArray]:
        """Number of the text and word, by place."""
        texts = pa.concat_arrays([texts])  # kernels on strings go wrong on slices
        odd = [bool(t) and (not tokenizers.can_cut or _NO_CUT.search(t) is not None) for t in texts.to_pylist()]
        plain = pc.if_else(pc.or_(pa.array(odd, pa.bool_()), pc.equal(pc.fill_null(texts, ""), "")), pa.scalar(None, pa.string()), texts)
        of_plain = pc.split_pattern(plain, " ")
        owners, words = [pc.list_parent_indices(of_plain).to_numpy().astype(np.int64)], [of_plain.flatten()]
        for n in np.flatnonzero(odd).tolist():
            for parts in tokenizers.words(texts[n].as_py()):
                words.append(pa.array(parts, pa.string()))
                owners.append(np.full(len(parts), n, np.int64))
        owners, words = np.concatenate(owners), pa.concat_arrays(words)
        if any(odd):
            order = np.argsort(owners, kind="stable")
            owners, words = owners[order], words.take(pa.array(order))
        return owners, words

    def _align(self, tokenizers: Tokenizers) -> None:
        self.a_ends, self.b_ends = np.cumsum(tokenizers.a_sizes[self.a]), np.cumsum(tokenizers.b_sizes[self.b])
        ends_a, ends_b = (np.zeros((ends[-1] if len(ends) else 0) + 1, bool) for ends in (self.a_ends, self.b_ends))
        ends_a[self.a_ends], ends_b[self.b_ends] = True, True
        cuts = np.flatnonzero(ends_a | ends_b)  # between two cuts lies one link
        of_a, of_b = (np.cumsum(ends)[cuts] - ends[cuts] for ends in (ends_a, ends_b))
        #: Number of the pair of ids and of the word, by link.
        self.pairs = (self.a[of_a] << PAIR_BITS) | self.b[of_b]
        self.words = np.repeat(np.arange(self.n_words), self.n_a)[of_a]
        self.common = np.flatnonzero(ends_a & ends_b)
        self.n_links = np.bincount(self.words, minlength=self.n_words)

    def total(self, of_words: np.ndarray) -> np.ndarray:
        """The sums over the texts of a number by word."""
        sums = np.zeros(self.n_texts, np.int64)
        np.add.at(sums, self.owners, of_words[self.places])
        return sums

    def of_links(self, values: np.ndarray) -> np.ndarray:
        """The sums over the texts of a number by link."""
        sums = np.zeros(self.n_words, np.int64)
        np.add.at(sums, self.words, values)
        return self.total(sums)

    def pair_texts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs, and how many of the texts link each."""
        distinct, numbers = np.unique(self.pairs, return_inverse=True)
        first = np.cumsum(self.n_links) - self.n_links
        held = np.unique(self.owners * (self.n_words + 1) + self.places)
        texts, words = np.divmod(held, self.n_words + 1)
        n = self.n_links[words]
        at = np.repeat(first[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
        linked = np.unique(np.repeat(texts, n) * (len(distinct) + 1) + numbers[at])
        counts = np.bincount(linked % (len(distinct) + 1), minlength=len(distinct))
        return distinct[counts > 0], counts[counts > 0]

    def groups(self, tokenizers: Tokenizers) -> tuple[np.ndarray, list[bytes]]:
        """Number of groups and their ids, as text, by text."""
        group_a, group_b = np.searchsorted(self.common, self.a_ends), np.searchsorted(self.common, self.b_ends)
        last_a, last_b = (np.diff(group, append=-1) != 0 for group in (group_a, group_b))
        codes = np.concatenate([2 * self.a + last_a, 2 * (len(tokenizers.a_bytes) + self.b) + last_b])
        # A token stands behind the tokens of its side, and behind the other side's of
        # earlier groups; for the second side also of its own group.
        in_group_a, in_group_b = (np.cumsum(np.bincount(group, minlength=len(self.common) + 1)) for group in (group_a, group_b))
        before_a = np.arange(len(self.a)) + np.concatenate([[0], in_group_b])[group_a]
        before_b = np.arange(len(self.b)) + in_group_a[group_b]
        ordered = np.empty(len(codes), np.int64)
        ordered[np.concatenate([before_a, before_b])] = codes
        ordered, known = ordered.tolist(), tokenizers.labels
        bounds = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        of_words = [b"".join([known[c] for c in ordered[low:high]])[:-1] for low, high in zip(bounds, bounds[1:])]
        ends = np.cumsum(np.bincount(self.owners, minlength=self.n_texts)).tolist()
        places = self.places.tolist()
        labels = [b";".join([of_words[w] for w in places[low:high]]) for low, high in zip([0, *ends], ends)]
        of_word = np.repeat(np.arange(self.n_words), self.n_a)[np.searchsorted(self.a_ends, self.common)]
        return self.total(np.bincount(of_word, minlength=self.n_words)), labels


class PerfectHash:
    """Numbers distinct keys from 0 without a gap. A level holds the keys that
    meet no other there; the rest goes to the next one."""

    def __init__(self, levels: list[bytes]):
        self.bits = [np.unpackbits(np.frombuffer(level, np.uint8)).astype(bool) for level in levels]
        self.ranks = [np.cumsum(bits) - bits for bits in self.bits]
        self.bases = np.cumsum([0, *(int(bits.sum()) for bits in self.bits)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys.astype(np.uint64) ^ mix(np.array([level + 1], np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def levels_of(cls, keys: np.ndarray) -> list[bytes]:
        levels = []
        while len(keys):
            size = 8 * (len(keys) // 4 + 8)
            places = cls._place(keys, len(levels), size)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(np.packbits(alone).tobytes())
            keys = keys[~alone[places]]
        return levels

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of known keys; an unknown key gets any number, or -1."""
        found = np.full(len(keys), -1, np.int64)
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            open_ = np.flatnonzero(found < 0)
            places = self._place(keys[open_], level, len(bits))
            hit = bits[places]
            found[open_[hit]] = self.bases[level] + ranks[places[hit]]
        return found


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)


def _list(table: pa.Table, name: str) -> np.ndarray:
    """The list of the only row, as an array."""
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _hash_and_keys(table: pa.Table) -> tuple[PerfectHash, np.ndarray]:
    return PerfectHash(table.column("levels")[0].as_py()), _list(table, "keys")


def _verified(hash_: PerfectHash, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Places of pairs in the vectors; each is compared with the key there."""
    places = hash_(pairs)
    if (places < 0).any() or (keys[places] != pairs).any():
        raise ValueError("a pair is missing from the hash of its bucket")
    return places


def _lists(**columns) -> pa.Table:
    """One row with a list in each column that holds an array."""
    return pa.table({name: pa.array([value.tolist() if isinstance(value, np.ndarray) else value]) for name, value in columns.items()})


def _chunks(docs: DataFrame, text: str, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """``chunk, place, row, pairs, texts, tokens``: the documents, dealt into chunks,
    and with the first of each chunk the pairs of all its documents and the tokens
    of their words."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(byte_bpe, piece_bpe)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                before = sizes[first - 1] if first else 0
                n = max(1, int(np.searchsorted(sizes, before + CHUNK_BYTES, "right")) - first)
                piece = batch.slice(first, n)
                alignment = Alignment(piece.column(1), tokenizers)
                lists = [pa.array([of_chunk.tolist(), *[None] * (n - 1)], pa.list_(pa.int64())) for of_chunk in alignment.pair_texts()]
                tokens = pa.array([alignment.stored(), *[None] * (n - 1)], pa.binary())
                columns = [pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), piece.column(0), *lists, tokens]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "place", "row", "pairs", "texts", "tokens"])
                del alignment, lists, tokens, columns
                pa.default_memory_pool().release_unused()
                number += 1
                first += n

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(deal, f"chunk long, place int, row {row_type}, pairs array<long>, texts array<long>, tokens binary")


def _counted(partials: DataFrame, buckets: int, slices: int) -> DataFrame:
    """``bucket, levels, keys, counts, best`` with a row per bucket: the hash of
    its pairs, the pairs by their number, how many documents hold each, and
    whether that is the most of any pair with its first id."""

    def build(of_bucket: pa.Table) -> pa.Table:
        pairs = _numbers(of_bucket, "pair")
        levels = PerfectHash.levels_of(pairs)
        keys = np.empty(len(pairs), np.int64)
        keys[PerfectHash(levels)(pairs)] = pairs
        return _lists(bucket=of_bucket.column("bucket")[0].as_py(), levels=levels, keys=keys)

    def add(rows: pa.Table, of_bucket: pa.Table) -> pa.Table:
        hash_, keys = _hash_and_keys(of_bucket)
        counts = np.zeros(len(keys), np.int64)
        if rows.num_rows:
            np.add.at(counts, _verified(hash_, keys, _numbers(rows, "pair")), _numbers(rows, "texts"))
        return _lists(bucket=of_bucket.column("bucket")[0].as_py(), slice=of_bucket.column("slice")[0].as_py(), counts=counts)

    def total(parts: pa.Table) -> pa.Table:
        vectors = parts.column("counts").combine_chunks().flatten().to_numpy().reshape(parts.num_rows, -1)
        return _lists(bucket=parts.column("bucket")[0].as_py(), slice=parts.column("slice")[0].as_py(), counts=vectors.sum(axis=0))

    def finish(of_bucket: pa.Table) -> pa.Table:
        keys, counts = _list(of_bucket, "keys"), _list(of_bucket, "counts")
        _, first = np.unique(keys >> PAIR_BITS, return_inverse=True)
        most = np.zeros(first.max() + 1, np.int64)
        np.maximum.at(most, first, counts)
        return of_bucket.append_column("best", pa.array([(counts == most[first]).tolist()]))

    distinct = partials.select("bucket", "pair").distinct()
    hashes = durable(distinct.groupBy("bucket").applyInArrow(build, "bucket long, levels array<binary>, keys array<long>"), "hashes")
    of_slices = _per_slice(hashes, slices)
    vectors = partials.groupBy("bucket", "slice").cogroup(of_slices.groupBy("bucket", "slice")).applyInArrow(add, "bucket long, slice long, counts array<long>")
    while slices > 1:
        slices = ceil(slices / FAN_IN)
        parts = durable(vectors, "vectors").withColumn("slice", F.floor(F.col("slice") / FAN_IN))
        vectors = parts.groupBy("bucket", "slice").applyInArrow(total, "bucket long, slice long, counts array<long>")
    joined = hashes.join(vectors.drop("slice"), "bucket")
    counted = joined.groupBy("bucket").applyInArrow(finish, "bucket long, levels array<binary>, keys array<long>, counts array<long>, best array<boolean>")
    return durable(counted, "counts")


def _per_slice(of_buckets: DataFrame, slices: int) -> DataFrame:
    return of_buckets.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))


def _partials(chunks: DataFrame, bucket_pairs: int, slice_rows: int) -> tuple[DataFrame, int, int]:
    """``bucket, slice, chunk, pair, texts`` with a row per pair of a chunk, and
    the numbers of buckets and slices. All pairs with one first id share a bucket,
    and no id has more pairs than the other vocabulary has ids."""
    held = chunks.where("pairs IS NOT NULL").select("chunk", F.explode(F.arrays_zip("pairs", "texts")).alias("p"))
    rows = held.select("chunk", F.col("p.pairs").alias("pair"), F.col("p.texts").alias("texts"))
    n, distinct = chunks.where("pairs IS NOT NULL").agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0], rows.select(F.approx_count_distinct("pair")).first()[0]
    buckets = max(1, ceil(distinct / bucket_pairs))
    slices = max(1, ceil(n / buckets / slice_rows))
    bucket = F.pmod(F.xxhash64(F.shiftright("pair", PAIR_BITS)), F.lit(buckets)).cast("long")
    slice_ = F.pmod(F.xxhash64("chunk"), F.lit(slices)).cast("long")
    return rows.select(bucket.alias("bucket"), slice_.alias("slice"), "chunk", "pair", "texts"), buckets, slices


def pair_counts(docs: DataFrame, text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, bucket_pairs: int = BUCKET_PAIRS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``a, b, documents, best``: every pair of ids that some document links, in
    how many documents, and whether no pair with ``a`` is in more."""
    chunks = durable(_chunks(docs.select(text), text, byte_bpe, piece_bpe).select("chunk", "pairs", "texts"), "chunks")
    counted = _counted(*_partials(chunks, bucket_pairs, slice_rows))
    rows = counted.select(F.explode(F.arrays_zip("keys", "counts", "best")).alias("r"))
    second = F.col("r.keys").bitwiseAND((1 << PAIR_BITS) - 1)
    return rows.select(F.shiftright("r.keys", PAIR_BITS).cast("int").alias("a"), second.cast("int").alias("b"), F.col("r.counts").alias("documents"), "r.best")


def align(docs: DataFrame, text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, bucket_pairs: int = BUCKET_PAIRS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Whole rows in a struct ``row`` with ``n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups``.

    The first tokenizer (byte-level) reads a space and the text, the second one
    adds the space itself. Groups end where tokens of both end; as text, the ids
    of both sides in order (``a1,a2|b1;a3|b2``). Links are pairs of tokens that
    overlap. ``count_sum`` adds, over the links, the documents that link the pair
    of ids; ``n_best`` counts those whose pair is in the most documents of its
    first id. A text that is null or empty, or whose tokens are not its bytes, has
    no tokens. Equal rows count as documents each; an empty table gives no rows.
    Texts are cut at single spaces, which changes no token, and a word is encoded
    once a chunk; a text without such a space is one word.
    No task holds more than a chunk of texts or a bucket of pairs.
    """
    chunks = durable(_chunks(docs, text, byte_bpe, piece_bpe), "chunks")
    partials, buckets, slices = _partials(chunks, bucket_pairs, slice_rows)
    counted = _counted(partials, buckets, slices)

    def look_up(rows: pa.Table, of_bucket: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([[], [], [], []], schema=_FOUND)
        hash_, keys = _hash_and_keys(of_bucket)
        pairs = _numbers(rows, "pair")
        places = _verified(hash_, keys, pairs)
        return pa.table([rows.column("chunk"), pairs, _list(of_bucket, "counts")[places], _list(of_bucket, "best")[places]], schema=_FOUND)

    def measure(of_chunk: pa.Table, found: pa.Table) -> pa.Table:
        tokenizers = _tokenizers(byte_bpe, piece_bpe)
        of_chunk = of_chunk.sort_by("place")
        rows = of_chunk.column("row").combine_chunks()
        alignment = Alignment(rows.field(text).cast(pa.string()), tokenizers, of_chunk.column("tokens")[0].as_py())
        pairs = _numbers(found, "pair")
        order = np.argsort(pairs)
        places = order[np.searchsorted(pairs, alignment.pairs, sorter=order)] if len(pairs) else np.zeros(0, np.int64)
        n_groups, groups = alignment.groups(tokenizers)
        n_a, n_b, n_links = (alignment.total(n) for n in (alignment.n_a, alignment.n_b, alignment.n_links))
        n_best, count_sum = (alignment.of_links(_numbers(found, name)[places]) for name in ("best", "count"))
        numbers = [pa.array(c.astype(np.int64)) for c in (n_a, n_b, n_groups, n_links, n_best, count_sum)]
        return pa.table([rows, *numbers, pa.array(groups, pa.binary()).cast(pa.string())], names=["row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    of_slices = _per_slice(counted, slices)
    found = partials.drop("texts").groupBy("bucket", "slice").cogroup(of_slices.groupBy("bucket", "slice")).applyInArrow(look_up, "chunk long, pair long, count long, best boolean")
    row_type = chunks.schema["row"].dataType.simpleString()
    types = f"row {row_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return chunks.select("chunk", "place", "row", "tokens").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(measure, types)


_FOUND = pa.schema([("chunk", pa.int64()), ("pair", pa.int64()), ("count", pa.int64()), ("best", pa.bool_())])
