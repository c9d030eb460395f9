"""Token alignment against a plain walk over both token lists."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from feedlens.llm import alignment
from feedlens.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE)


def plain(texts, tokenizers):
    """Rows as the operator returns them behind ``row``, without segments or arrays."""
    encoded = []
    for text in texts:
        a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tokenizers.b.encode(text) if text else []
        parts = [[side[i] for i in ids] for side, ids in ((tokenizers.a_bytes, a), (tokenizers.b_bytes, b))]
        fits = text and all(b"".join(p) == b" " + text.encode() for p in parts)
        encoded.append((a, b, *parts) if fits else ([], [], [], []))
    links, groups = [], []
    for a, b, parts_a, parts_b in encoded:
        of_text, of_groups, i, j, end_a, end_b = [], [([], [])] if a else [], 0, 0, 0, 0
        owner = [[n for n, part in enumerate(parts) for _ in part] for parts in (parts_a, parts_b)]
        of_text = [(a[m], b[n]) for m, n in dict.fromkeys(zip(*owner))]
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                of_groups[-1][0].append(a[i])
                end_a += len(parts_a[i])
                i += 1
            else:
                of_groups[-1][1].append(b[j])
                end_b += len(parts_b[j])
                j += 1
            if end_a == end_b:
                of_groups.append(([], []))
        links.append(of_text)
        groups.append(of_groups[:-1])
    held = Counter(pair for of_text in links for pair in set(of_text))
    most = {}
    for (first, _), n in held.items():
        most[first] = max(n, most.get(first, 0))
    label = [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for g in groups]
    rows = [
        (len(a), len(b), len(g), len(of_text), sum(held[p] == most[p[0]] for p in of_text), sum(held[p] for p in of_text), s)
        for (a, b, _, _), of_text, g, s in zip(encoded, links, groups, label)
    ]
    return rows, held, most


TRICKY = [
    None, "", " ", "  a", "a  b ", "\n\ttabs\x00nul", "Straße — naïve café", "漢字かな交じり文", "🙂👩‍👩‍👧 emoji", "▁under", "<s> </s> <unk> <0x41> <|endoftext|>", "ﬁ Ａ é é",
    "don't we'll 12345 67 's 'll x", "a\u00a0 b \u3000c \u2581d e\x1c f \x85g", "tab\t x \ny", "x" * 300, "  \u0085  z", "same text", "same text",
]


@pytest.mark.parametrize("buckets,slices,chunk", [(250_000, 2_000_000, 4 << 20), (40, 9, 300)])
def test_rows_against_plain_walk(spark, tokenizers, monkeypatch, buckets, slices, chunk):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    rng = random.Random(3)
    words = "the of and Zug wäre étude niño tokenization 2024 ... ( ) http://x.y/z ".split()
    texts = TRICKY + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    df = spark.createDataFrame([(n, t, -n) for n, t in enumerate(texts)], "n_a long, text string, chunk long").repartition(3)
    out = alignment.align(df, bucket_pairs=buckets, slice_rows=slices).collect()
    rows, held, most = plain(texts, tokenizers)
    assert {r["row"]["n_a"]: (*tuple(r)[1:],) for r in out} == dict(enumerate(rows))
    counts = alignment.pair_counts(df, bucket_pairs=buckets, slice_rows=slices).collect()
    assert {(r["a"], r["b"]): (r["documents"], r["best"]) for r in counts} == {p: (n, n == most[p[0]]) for p, n in held.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(df).count() == 0
    assert alignment.pair_counts(df).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]["groups"] == ""


def tokens(texts, tokenizers):
    """Ids of both sides by text, put together from words; None without tokens."""
    numbers = alignment.Alignment(pa.array(texts, pa.string()), tokenizers)
    of_words = [np.split(ids, np.cumsum(n)[:-1]) for n, ids in ((numbers.n_a, numbers.a), (numbers.n_b, numbers.b))]
    found = [None] * len(texts)
    for owner, place in zip(numbers.owners.tolist(), numbers.places.tolist()):
        found[owner] = found[owner] or ([], [])
        for side, ids in zip(found[owner], of_words):
            side.extend(ids[place].tolist())
    return found


@pytest.mark.parametrize("segment", [1, 50, 100_000])
def test_cuts_change_no_token(tokenizers, monkeypatch, spark, sf_dir, segment):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + TRICKY
    assert tokenizers.can_cut
    monkeypatch.setattr(alignment, "SEGMENT_CHARS", segment)
    cut = tokens(texts, tokenizers)
    monkeypatch.setattr(tokenizers, "can_cut", False)
    assert cut == tokens(texts, tokenizers)
    whole = [(tokenizers.a.encode(" " + t, add_special_tokens=False).ids, tokenizers.b.encode(t)) for t in texts if t]
    assert [w for w, found in zip(whole, [c for c, t in zip(cut, texts) if t]) if found] == [c for c in cut if c]


def test_long_text(tokenizers):
    text = "Wörter und 12 words, " * 100_000
    numbers = alignment.Alignment(pa.array([text]), tokenizers)
    assert numbers.total(numbers.n_a)[0] == len(tokenizers.a.encode(" " + text, add_special_tokens=False).ids) > 10**5
    assert tokens([text], tokenizers)[0][0] == tokenizers.a.encode(" " + text, add_special_tokens=False).ids


def test_words_of_slices(tokenizers):
    texts = pa.array(TRICKY, pa.string())
    for low in range(len(TRICKY)):
        for n in range(1, 5):
            owners, words = alignment.Alignment._split(texts.slice(low, n), tokenizers)
            plain = [(i, w) for i, t in enumerate(TRICKY[low : low + n]) if t for parts in tokenizers.words(t) for w in parts]
            assert list(zip(owners.tolist(), words.to_pylist())) == plain


def test_ranks_give_the_tokens_of_the_file(tokenizers):
    """Every character at both ends of a word, and random words."""
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    words = [f"{c}b{c}" for c in characters]
    rng = random.Random(5)
    words += ["".join(rng.choice(characters[: rng.choice([128, 1000, 70_000])]) for _ in range(rng.randrange(1, 30))) for _ in range(50_000)]
    assert tokenizers.ranked
    for low in range(0, len(words), 50_000):
        batch = words[low : low + 50_000]
        by_file = [e.ids for e in tokenizers.a.encode_batch_fast([" " + w for w in batch], add_special_tokens=False)]
        assert [w for w, ids, found in zip(batch, by_file, tokenizers._ids_a(batch)) if ids != found] == []


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = rng.choice(1 << 40, n, replace=False)
        hash_ = alignment.PerfectHash(alignment.PerfectHash.levels_of(keys))
        assert sorted(hash_(keys).tolist()) == list(range(n))


def test_query_against_plain_walk(spark, sf_dir, tokenizers):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows, _, _ = plain([d["text"] for d in docs], tokenizers)
    expected = {d["doc_id"]: (*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[0] else "") for d, r in zip(docs, rows)}
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_alignment"](spark, sf_dir).collect()} == expected
