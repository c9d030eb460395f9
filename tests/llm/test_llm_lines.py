"""Line dedup against a search for all runs of lines in all earlier documents."""

import random
import time

from feedlens.llm import lines


def plain_deleted(texts):
    """Per text, the lines in runs of 100 characters that an earlier text has."""
    deleted, split = [], [[line.strip(" ") for line in t.split("\n")] for t in texts]
    for n, own in enumerate(split):
        runs = {tuple(o[a:b]) for o in split[:n] if o != own for a in range(len(o)) for b in range(a + 1, len(o) + 1)}
        runs |= {tuple(own[a:b]) for a in range(len(own)) for b in range(a + 1, len(own) + 1)} if own in split[:n] else set()
        gone = set()
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if tuple(own[a:b]) in runs and sum(map(len, own[a:b])) >= 100:
                    gone |= set(range(a, b))
        deleted.append(len(gone))
    return deleted


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["n_deleted"] for r in lines.dedup_lines(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain_deleted(texts)


def line(name, size=60):
    return (name + " ") * (size // (len(name) + 1)) + "." * (size % (len(name) + 1))


P1, P2, P3, Q, R = line("one", 60), line("two", 60), line("three", 60), line("quite", 20), line("rather", 20)


def frequent_parts():
    firsts = [f"{P1}\n\n{Q}", f"{R}\n\n{P2}"]
    short = [line(name, 40) for name in ("red", "green", "blue")]
    more = ["\n".join([short[0], short[1], "x"]), "\n".join(["y", short[1], short[2]])]
    return firsts + more + [f"own {i}\n{P1}\n\n{P2}\nend {i}" for i in range(8)] + ["\n".join([f"z{i}", *short, f"e{i}"]) for i in range(8)]


def repeated_and_moved():
    block, other = f"{P1}\n{P2}", f"{P3}\n{line('four')}"
    return [f"a\n{block}\nb\n{block}\nc\n{other}", *[f"d{i}\n{block}\ne{i}" for i in range(6)], f"f\n{other}\ng\n{block}\nh\n{block}"]


def test_frequent_lines_with_different_first_holders(spark):
    check(spark, frequent_parts() + repeated_and_moved())


def test_repeated_and_moved_blocks():
    a, p, q = "a" * 9, "p" * 120, "q" * 120
    for earlier, later, gone in [([a, p, "y", p, "z"], ["u", p, "v"], [1]), ([p], [p, "x", p], [0, 2]), ([p, "x", q], [q, "y", p], [0, 2])]:
        assert lines.common_blocks(earlier, later, list(map(len, later))) == gone


def test_the_alignment_decides(monkeypatch):
    earlier, later = [P1, P2, "x"], ["y", P1, P2]
    assert lines.common_blocks(earlier, later, list(map(len, later))) == [1, 2]
    monkeypatch.setattr(lines, "patience_pairs", lambda a, b: [])
    assert lines.common_blocks(earlier, later, list(map(len, later))) == []


def test_pairs_of_random_documents():
    rng = random.Random(42)
    for _ in range(3000):
        pool = [line(f"l{i}", rng.choice([0, 5, 40, 70, 120])) for i in range(rng.randrange(2, 12))]
        earlier, later = ([rng.choice(pool) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        runs = {tuple(earlier[a:b]) for a in range(len(earlier)) for b in range(a + 1, len(earlier) + 1)}
        gone = {k for a in range(len(later)) for b in range(a + 1, len(later) + 1) if tuple(later[a:b]) in runs and sum(map(len, later[a:b])) >= 100 for k in range(a, b)}
        assert lines.common_blocks(earlier, later, list(map(len, later))) == sorted(gone)


def test_long_documents():
    block = [line(f"b{i}") for i in range(10)]
    unlike = [line(f"u{i}") for i in range(100_000)]
    started = time.process_time()
    assert lines.common_blocks(block, block * 10_000, [60] * 100_000) == list(range(100_000))
    assert lines.common_blocks(unlike, unlike[50_000:] + unlike[:50_000], [60] * 100_000) == list(range(100_000))
    assert lines.common_blocks(unlike, [f"x{i}" if i % 2 else one for i, one in enumerate(unlike)], [60] * 100_000) == []
    assert time.process_time() - started < 60


def test_all_runs_of_random_documents(spark):
    rng = random.Random(41)
    pool = [line(f"l{i}", rng.choice([0, 5, 20, 40, 70, 120])) for i in range(14)]
    check(spark, ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(90)])
