"""Periodic runs against the definition, word by word."""

import hashlib
import random
import re
import zlib

import pytest

from feedlens.llm import runs
from feedlens.llm.queries import QUERIES


def plain_runs(words, least=12):
    found = []
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            part = words[i : j + p]
            if len(part) >= max(least, 2 * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                found.append((i, len(part), p))
            i = max(j, i + 1)
    return sorted(found)


def periodic(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    if rng.random() < 0.6:
        start, period = rng.randrange(n), rng.randrange(1, n + 1)
        words = [words[i] if i < start else words[start + (i - start) % period] for i in range(n)]
    return words


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        words = periodic(rng, rng.randrange(1, 70), rng.choice([1, 2, 3, 6]))
        for least in (2, 12):
            assert runs.runs_of(words, least) == plain_runs(words, least)
            as_bytes = [b"%d" % w for w in words]
            assert runs.runs_in([as_bytes, [], as_bytes], least) == [plain_runs(words, least), [], plain_runs(words, least)]


def test_known_sequences():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert runs.runs_of(b, 2) == plain_runs(b, 2)  # Fibonacci words have the most nested runs
    cube = [0, 0, 1] * 5 + [2] + [0, 0, 1] * 5 + [2]
    assert runs.runs_of(cube) == [(0, 15, 3), (0, 32, 16), (16, 15, 3)]


def test_long_text_takes_linear_time():
    words = [b"w%d" % (i % 1000) for i in range(200_000)]
    assert runs.runs_in([words]) == [[(0, 200_000, 1000)]]
    assert runs.collapsed(words, [(0, 200_000, 1000)]) == b" ".join(words[:1000])


@pytest.mark.parametrize("limit", [1, 7, 10**6])
def test_portions_hold_every_text_once(limit):
    texts = [[b"x"] * n for n in (0, 3, 9, 1, 1, 0, 20, 2)]
    assert [t for portion in runs._portions(texts, limit) for t in portion] == texts


def test_rows_nulls_and_clashing_columns(spark):
    twice = "a b c d e f " * 2
    rows = [(1, None, "r"), (2, "", None), (3, twice, "s"), (3, twice, "s"), (None, twice.upper(), None), (4, " ".join("ab" * 9), "t")]
    df = spark.createDataFrame(rows, "runs long, text string, collapsed string")
    got = runs.find_runs(df).select("row.*", "n_words", runs.F.col("runs").alias("found"), runs.F.col("collapsed").alias("short")).collect()
    one = [(0, 12, 6)]
    expected = [(*r, n, f, s) for r, (n, f, s) in zip(rows, [(0, [], ""), (0, [], ""), (12, one, "a b c d e f"), (12, one, "a b c d e f"), (12, one, "A B C D E F"), (1, [], rows[-1][1])])]
    assert sorted(map(str, [(*r[:4], [tuple(f) for f in r[4]], r[5]) for r in got])) == sorted(map(str, expected))
    assert runs.find_runs(df.limit(0)).count() == 0


def test_query_against_the_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    seen = 0
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words[:20000]) if n <= 1500 else runs.runs_of([hash(w) for w in words])
        seen += len(found)
        dropped = {i for s, length, p in found for i in range(s + p, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digests = ["".join(f"{s},{length},{p}\n" for s, length, p in found), " ".join(w for i, w in enumerate(words) if i not in dropped)]
        milli = 1000 * best[1] // best[2] if found else None
        assert got[doc_id] == (len(found), *best, milli, *(hashlib.sha256(d.encode()).hexdigest() for d in digests))
    assert seen > 5
