"""Operators that scan whole texts, against brute force on small tables."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from feedlens.llm import bytescan, contamination, html, language, lines, quality, queries, repeats, simhash
from test_llm_neardups import plain_kept

DOC = "doc_id long, text string, lang string, source string, fp string, id string, size string, words string"


def docs(spark, texts, langs=None, first=0):
    """One row per text, with columns that clash with inner names."""
    rows = [(first + i, t, langs[i] if langs else None, "s", "x", "y", "z", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


def odd_texts():
    rng = random.Random(1)
    long = prose(rng, 6000)
    copy = prose(rng, 120)
    return [None, "", " \n\t ", "one", "two words", copy, copy, copy.upper(), copy + " tail", long, "é" * 500, "ab" * 400, "\n".join([copy] * 3), "ſ Ä x \x1c y"]


# --- near-duplicates


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    base = prose(rng, 300).split()
    texts = odd_texts() + [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 300, 12)] + [prose(rng, 30) for _ in range(40)]
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert {i: r["fp"] & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r["component"] for i, r in got.items()} == plain_components(prints)


def test_trie_links_of_dense_and_spread_prints(spark):
    rng = random.Random(3)
    dense = {(0xABCDEF << 40) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(150)}
    values = sorted(dense | {rng.getrandbits(64) for _ in range(300)} | {0, 1, 2**64 - 1})
    expected = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    table = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    for leaf in (1, 64, 10**6):
        links = [tuple(sorted(x & (2**64 - 1) for x in r)) for r in simhash.trie_links(table, leaf=leaf).collect()]
        assert len(links) == len(set(links)) and set(links) == expected


def test_near_duplicates_of_odd_tables(spark):
    df = docs(spark, ["same text here"] * 3).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted(map(str, simhash.keep_one(df).select("doc_id").collect())) == ["Row(doc_id=1)"]
    twice = df.unionByName(df)
    assert simhash.near_duplicates(twice).count() == 6 and simhash.keep_one(twice).columns == df.columns
    assert simhash.keep_one(twice).count() == 1
    assert simhash.near_duplicates(df.where("false")).collect() == []


# --- decontamination


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_hits(text, items):
    words, hit, found = tokens(text), set(), set()
    for item, body in items:
        needle = tokens(body)
        n = min(10, len(needle))
        windows = {tuple(needle[i : i + n]) for i in range(len(needle) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i + 1, i + n + 1))
                found.add(str(item))
    return len(words), sorted(hit), sorted(found)


def test_hits_match_brute_force(spark):
    rng = random.Random(4)
    passage = prose(rng, 30)
    items = [(1, passage), (20, "short É item"), (3, None), (4, "..."), (5, passage[:60] + " " + prose(rng, 12)), (6, "W1")]
    texts = odd_texts() + [prose(rng, 40) + ". " + passage.upper() + "! " + prose(rng, 5), "a SHORT-É.item b", "short é item", passage[8:90]]
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, window string")
    for bound in (10**6, 0):
        got = contamination.find_hits(docs(spark, texts), table, broadcast_bytes=bound).collect()
        assert {r["doc_id"]: (r["n_words"], r["hit"], r["items"]) for r in got} == {i: plain_hits(t, items) for i, t in enumerate(texts)}
    df = docs(spark, texts)
    clean = contamination.drop_contaminated(df, table)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in enumerate(texts) if not plain_hits(t, items)[1]} and clean.columns == df.columns
    assert contamination.drop_contaminated(df, table.where("false")).count() == len(texts)
    assert contamination.find_hits(df.where("false"), table).collect() == []


@pytest.mark.parametrize("broadcast_bytes", [contamination.BROADCAST_BYTES, 0])
def test_hits_over_slices(spark, broadcast_bytes):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(n))) for i, n in enumerate([3, 9, 10, 11, 40, 600, 1])]
    cut = contamination.SLICE
    texts = [" ".join(f"d{k}" for k in range(n)) for n in (cut - 1, cut, cut + 1, cut + 9, 2 * cut, 2 * cut + 1)]
    texts += [" ".join(["d"] * (cut - back) + items[3][1].split() + ["e"] * 5) for back in range(13)] + [items[5][1] + " x " + items[5][1], "d " * 300_000 + items[4][1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    started = time.time()
    got = {r["doc_id"]: r for r in contamination.find_hits(df, table, broadcast_bytes=broadcast_bytes).collect()}
    assert time.time() - started < 60
    for i, text in enumerate(texts):
        n_words, hit, ids = plain_hits(text, items)
        assert (got[i]["n_words"], got[i]["hit"], got[i]["items"]) == (n_words, sorted(hit), sorted(map(str, ids)))


def test_without_hits_keeps_the_rest(spark):
    df = spark.createDataFrame([("A b, c! d", [2, 3]), ("x", []), ("", [])], "t string, h array<int>")
    assert [r[0] for r in df.select(contamination.without_hits(F.col("t"), F.col("h"))).collect()] == ["A , ! d", "x", ""]


# --- line dedup


def test_patience_alignment():
    assert lines.patience_pairs(list("abcde"), list("xbcyde")) == [(1, 1), (2, 2), (3, 4), (4, 5)]
    assert lines.patience_pairs([], ["a"]) == [] and lines.patience_pairs(["a", "a"], ["a"]) == [(0, 0)]
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = lines.patience_pairs(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def plain_dedup(texts):
    """Deleted lines per document: every candidate pair aligned in plain Python."""
    split = {i: [line.strip(" ") for line in t.split("\n")] for i, t in enumerate(texts) if t is not None}
    heads = {}
    for i, own in split.items():
        heads.setdefault(tuple(own), i)
    distinct = sorted(heads.values())
    holders = {}
    for i in distinct:
        for gram in {(line,) for line in split[i]} | set(zip(split[i], split[i][1:])):
            holders.setdefault(gram, []).append(i)
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    deleted = {i: set() for i in split}
    for a, b in pairs:
        deleted[b] |= set(lines.common_blocks(split[a], split[b], [len(s) for s in split[b]]))
    for i, own in split.items():
        if (head := heads[tuple(own)]) != i:
            deleted[i] = set(range(len(own))) if sum(map(len, own)) >= lines.LEAST_CHARS else deleted[head]
    return deleted


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(6)
    pool = [prose(rng, rng.randrange(1, 25)) for _ in range(60)]
    texts = odd_texts() + ["\n".join(rng.choice(pool) + rng.choice(["", "", " "]) for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    texts += ["\n".join(pool[:8]), "\n".join([*pool[20:22], *pool[:8]])] * 2
    df = docs(spark, texts)
    got = {r["row"]["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    expected = plain_dedup(texts)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        if text is None:
            assert (got[i]["n_lines"], got[i]["n_deleted"], got[i]["row"]["text"]) == (0, 0, None)
        else:
            kept = [line for k, line in enumerate(text.split("\n")) if k not in expected[i]]
            assert (got[i]["n_deleted"], got[i]["row"]["text"]) == (len(expected[i]), "\n".join(kept))
    assert lines.deduplicated(df).columns == df.columns
    assert lines.dedup_lines(df.where("false")).collect() == []


def test_line_dedup_of_one_key(spark):
    text = "a line that is long enough to be a block " * 4
    df = docs(spark, [text, text, text]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["n_deleted"] for r in lines.dedup_lines(df).collect()] == [0, 0, 0]  # one document, three times


# --- repeats


def plain_cut(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append((bytes(b for b, g in zip(d, gone) if not g), re.findall(b"\1+", bytes(gone))))
    return out


def repeat_texts():
    rng = random.Random(7)
    passage = prose(rng, 90)
    texts = odd_texts() + ["x" * 700, "xy" * 150 + "z", passage[:200], passage[:199]]
    return texts + [prose(rng, rng.randrange(60)) + passage[rng.randrange(100) : 200 + rng.randrange(150)] + "é" + prose(rng, rng.randrange(60)) for _ in range(40)]


@pytest.mark.parametrize(("runs", "divisions"), [(repeats.RUNS, repeats.DIVISIONS), (2, repeats.PARTS), (2, 1)])
def test_repeats_match_brute_force(spark, monkeypatch, runs, divisions):
    monkeypatch.setattr(repeats, "RUNS", runs)  # with 2, anchors are divided by place
    monkeypatch.setattr(repeats, "DIVISIONS", divisions)  # with 1, they are counted string by string
    texts = repeat_texts()
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs(spark, texts)).collect()}
    for i, (kept, spans) in enumerate(plain_cut(texts)):
        removed = [r["high"] - r["low"] for r in got[i]["removed"]]
        assert (got[i]["n_bytes"], removed) == (len((texts[i] or "").encode()), [len(s) for s in spans])
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_repeats_of_odd_tables(spark):
    df = docs(spark, [prose(random.Random(8), 100)])
    same = df.unionByName(df).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["removed"][0]["low"] for r in repeats.remove_repeats(same).collect()] == [0, 0]
    assert repeats.remove_repeats(df).first()["removed"] == []
    assert repeats.remove_repeats(df.where("false")).collect() == []


def test_common_prefixes_of_sorted_suffixes():
    rng = random.Random(9)
    for length in (3, 20):
        symbols = np.array([rng.choice([1, 2, 2, 3]) for _ in range(300)] + [repeats.SEPARATOR], np.int16)
        order = repeats.suffix_order(symbols, length)
        words = [tuple(symbols[i : i + length]) for i in order]
        assert words == sorted(words)
        got = repeats.common_prefixes(symbols, order, length) >= length
        assert list(got) == [False] + [a == b and repeats.SEPARATOR not in a for a, b in zip(words, words[1:])]


def test_divided_runs_hold_every_start():
    rng = random.Random(10)
    text = prose(rng, 200).encode()
    found = repeats.runs_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    for by_place in (1, 7, repeats.PARTS):
        starts = []
        for start, n, ahead in zip(found["start"], found["n"], found["ahead"]):
            row = {"start": int(start), "n": int(n), "ahead": int(ahead), "by_place": by_place}
            for _, low, string in repeats._shipped(text, row):
                assert string == text[low : low + len(string)]
                starts += range(low, low + len(string) - repeats.LENGTH + 1)
        assert sorted(starts) == list(range(len(text) - repeats.LENGTH + 1))


# --- quality


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {k + s for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for s in range(3)}
    worded = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(worded) - len(set(worded)), len(repeated)


def plain_grams(text):
    def mix(x):
        m = 2**64 - 1
        x ^= x >> 31
        x = x * 0xD6E8FEB86659FD93 & m
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & m
        return x ^ x >> 29

    def word_hash(word):
        data = word.encode()
        return mix((sum((b + 1) * pow(bytescan.MULTIPLIER, i, 2**64) for i, b in enumerate(data)) + len(data)) % 2**64)

    hashes = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pairs = [mix((a * 3 + b * int(quality._SALT)) % 2**64) for a, b in zip(hashes, hashes[1:])]
    return [x % quality.BUCKETS for x in [mix(h) for h in hashes] + pairs]


def test_quality_matches_brute_force(spark):
    rng = random.Random(11)
    good = [prose(rng, rng.randrange(60, 200)) for _ in range(30)]
    bad = [" | ".join(f"j{rng.randrange(90)}" for _ in range(rng.randrange(60, 200))) for _ in range(30)]
    texts = odd_texts() + good + bad + ["a b c d " * 40, "# x\n# x\n\n  \n# x\r\n"]
    labels = [(len(odd_texts()) + i, int(i < 30), 0, "x") for i in range(0, 60, 2)] + [(len(odd_texts()), 1, 0, "x"), (None, 1, 0, "x")]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, key string")
    got = {r["doc_id"]: r for r in quality.judge(docs(spark, texts), table).collect()}
    raw, target = Counter(), Counter()
    trusted = {i for i, q, _, _ in labels if q}
    for i, text in enumerate(texts):
        raw.update(plain_grams(text))
        target.update(plain_grams(text) if i in trusted else [])
    n_raw, n_target = sum(raw.values()), sum(target.values())
    for i, text in enumerate(texts):
        grams = plain_grams(text)
        score = sum(math.log(0.9 * (target[b] / n_target) / (raw[b] / n_raw) + 0.1) for b in grams) / max(1, len(grams))
        assert got[i]["score"] == pytest.approx(score, abs=1e-9)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(got[i][n] for n in names) == plain_statistics(text)
        assert got[i]["base_failed"] == (got[i]["n_words"] < 50 or 100 * got[i]["n_repeat_words"] > 50 * got[i]["n_words"])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    n = len(odd_texts())
    judged = [(got[n + i]["kept"], got[n + i]["base_failed"], round(got[n + i]["score"], 3)) for i in range(0, 60, 2)]
    assert [k or f for k, f, _ in judged[:15]] == [True] * 15 and not any(k for k, _, _ in judged[15:]), judged


def test_quality_without_labels(spark):
    df = docs(spark, [prose(random.Random(12), 80), "few words"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["kept"] for r in quality.judge(df, none).collect()} == {0: True, 1: False}
    assert quality.judge(df.where("false"), none).collect() == []


# --- language


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    network = language.new_network(["a", "b", "c"], rng, units=3)
    for direction in (network.ahead, network.back):
        direction.inputs, direction.state = direction.inputs.astype(np.float64), direction.state.astype(np.float64)
    symbols, lengths, truth = rng.integers(0, 256, (6, 4)), np.array([6, 6, 3, 1]), np.array([0, 1, 2, 1])
    symbols[np.arange(6)[:, None] >= lengths] = language.PAD
    _, slopes = language.gradients(network, symbols, lengths, truth)
    for weights, slope in zip(network.weights(), slopes):
        place = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        values = []
        for step in (2e-2, -4e-2):
            weights[place] += step
            values.append(language.gradients(network, symbols, lengths, truth)[0])
        weights[place] += 2e-2
        assert slope[place] == pytest.approx((values[0] - values[1]) / 4e-2, rel=0.05, abs=1e-3)


def test_pooling_covers_whole_texts():
    network = language.new_network(["a", "b"], np.random.default_rng(1))
    texts = ["x" * 64 + "y" * 30, "", None, "é" * 1000, "z"]
    best, score = language.predict(network, pa.array(texts))
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        total = np.zeros(2)
        for start in range(0, len(data), language.SEGMENT):
            n = np.array([min(language.SEGMENT, len(data) - start)])
            total += language.label_sums(network, language.symbols_of(data, np.array([start]), n), n)[:, 0]
        assert score[i] == pytest.approx(total[best[i]] / max(1, len(data)), abs=1e-5)


def test_language_of_held_out_documents(spark, sf_dir):
    found = queries.QUERIES["op9_language"](spark, sf_dir).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = found[found["held_out"]]
    assert (held["lang_pred"] == truth[held.index]).mean() > 0.9 and found["score"].between(0, 1).all()


def test_language_of_odd_texts(spark):
    texts = ["the cat and the dog"] * 9 + ["le chat et le chien"] * 9 + [None, "", "123 !?", "the end"]
    df = docs(spark, texts, ["en"] * 9 + ["fr"] * 9 + ["en"] * 4)
    network = language.fit(df)
    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, network).collect()}
    assert [got[i] for i in (18, 19, 20)] == [("und", 0.0)] * 3 and got[21][0] == "en"
    kept = language.keep_identified(df, network)
    assert kept.columns == df.columns and {18, 19, 20}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language.fit(df.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language.identify(df, None).collect()} == {"und"}


# --- HTML


def test_pages_give_their_articles(spark, sf_dir):
    rows = queries.QUERIES["op1_html"](spark, sf_dir).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html as entities

    assert len(rows) == len(pages)
    for row in rows:
        article = re.search(r"<article>(.*)</article>", pages[row["page_id"]], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert row["text"] == "\n\n".join(b for b in blocks if b) and row["n_chars"] == len(row["text"])


def test_other_markup_and_odd_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    trees = html.fit(pages)
    rng = np.random.default_rng(123)
    article = [("h1", "A title of some words"), *[("p", prose(random.Random(i), 40) + ".") for i in range(4)]]
    for _ in range(30):
        nodes = html.Page(page := html.variant(rng, article, ["Home About us", "Buy now and save a lot today", "Sign up for our letter"])).nodes
        assert html.main_text(page, trees) == "\n\n".join(n.said for n in nodes if n.tag == "#text" and n.main)
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p", "x"), (3, "u", "</div><b>&amp;", "x")], "page_id long, url string, html string, text string")
    assert all(isinstance(r["text"], str) for r in html.extract(odd, trees).collect())
    assert html.extract(odd, []).count() == 4 and html.fit(odd.where("html IS NULL")) == [] and html.extract(odd.where("false"), trees).collect() == []


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(4)
    nodes = html.Page("<div><p>a<p>b<div><p>c</div></div><ul><li>d<li>e</ul>").nodes
    for _ in range(50):
        kept = html.decode(nodes, rng.normal(0, 2, len(nodes)))
        assert all(kept[node.parent] for node, k in zip(nodes, kept) if k and node.parent >= 0)


# --- pipeline


def test_pipeline_stages(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    docs_now, network = source, language.fit(source)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs_now.toPandas()
        stage(spark, docs_now, sf_dir).write.parquet(f"{tmp_path}/{number}")
        docs_now = spark.read.parquet(f"{tmp_path}/{number}")
        after = docs_now.toPandas()
        if number < 4:
            assert list(after.columns) == source.columns
        ids = set(after["doc_id"])
        if number == 0:
            best, score = language.predict(network, pa.array(before["text"].tolist()))
            sure = [i for i, t, s in zip(before["doc_id"], before["text"], score) if s >= language.LEAST_SCORE and re.search(r"[^\W\d_]", t or "")]
            assert ids == set(sure)
        elif number == 1:
            order = before.sort_values("doc_id")
            expected = plain_dedup(order["text"].tolist())
            texts = dict(zip(after["doc_id"], after["text"]))
            for k, (i, text) in enumerate(zip(order["doc_id"], order["text"])):
                kept = [line for n, line in enumerate(text.split("\n")) if n not in expected[k]]
                assert texts.get(i) == ("\n".join(kept) if kept else None)
        elif number == 2:
            order = before.sort_values("doc_id")
            assert ids == {order["doc_id"].iloc[k] for k in plain_kept([t or "" for t in order["text"]])}
        elif number == 3:
            assert ids == {i for i, t in zip(before["doc_id"], before["text"]) if not plain_hits(t, items)[1]}
        else:
            copies = after.groupby("doc_id").size()
            assert set(after["copy"]) <= {1, 2} and (copies == after.groupby("doc_id")["copy"].max()).all()
    odd = docs(spark, odd_texts()).select(source.columns[0], "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    for table in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, sf_dir)
        table.collect()


CLASHING = ["row", "key", "id", "copy", "hash", "words", "piece", "mark", "fp", "deleted", "n_lines", "_row", "_digest", "_identity", "score", "items"]


def test_stages_keep_clashing_columns(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    source = source.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    nothing = source.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema.fields]).limit(3)
    for table in (source, source.unionByName(nothing).unionByName(source), nothing, source.where("false")):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            given = table
            table = stage(spark, given, sf_dir)
            assert table.columns == (given.columns if number < 4 else [*given.columns, "_copy"])
            assert table.select(*CLASHING).where(" AND ".join(f"{c} = 'x'" for c in CLASHING)).count() == table.where("doc_id IS NOT NULL").count()
