"""Runs and collapsed texts against a search of all periods at all places."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from sylva.llm import periodic


def runs_by_force(words, min_length, min_exponent):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            long = j + q - i
            smaller = any(all(words[i + k] == words[i + k + p] for k in range(long - p)) for p in range(1, q))
            if long >= min_length and long >= min_exponent * q and not smaller:
                out.append((i, long, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_up(rng, longest, letters):
    words = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, longest))]
    for _ in range(rng.randint(0, 2)):
        if len(words) > 5:
            p, a = rng.randint(1, len(words) // 3 + 1), rng.randrange(len(words))
            for i in range(a, min(len(words), a + rng.randint(1, len(words)))):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("min_length, min_exponent", [(2, 2), (24, 3), (6, Fraction(5, 2)), (10, 3), (12, 4), (3, 3), (40, 2)])
def test_runs_of_small_texts(min_length, min_exponent):
    rng = random.Random(min_length)
    for _ in range(400):
        words = made_up(rng, 70, rng.randint(1, 5))
        assert periodic.runs_in(words, min_length, Fraction(min_exponent)) == runs_by_force(words, min_length, min_exponent), words


def test_the_automaton_alone_finds_all_runs():
    rng = random.Random(3)
    for _ in range(400):
        words = [rng.randrange(3) for _ in range(rng.randint(1, 60))]
        assert sorted(periodic.all_runs(words), key=lambda r: (r[0], r[2])) == runs_by_force(words, 2, 2)


def test_very_long_text():
    words = [b"%d" % (i % 70_000) for i in range(210_000)]
    assert periodic.runs_in(words, 24, Fraction(3)) == [(0, 210_000, 70_000)]
    assert periodic.runs_in([b"x"] * 300_000, 24, Fraction(3)) == [(0, 300_000, 1)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = runs_by_force(words, 24, 3)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + long for s, long, q in runs)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


def test_query(spark, tmp_path):
    rng = random.Random(5)
    line = "the same line of nine words stands here again"
    texts = [None, "", " \t\n", "one", "x " * 100, " x " * 30, f"{line}\n" * 4, f"{line}\n" * 3 + "end " + "a b " * 20 + "z\x1cz " * 30]
    texts += [b" ".join(made_up(rng, 200, k)).decode() for k in (1, 2, 3, 40) for _ in range(40)]
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts)] + [(3, "one", 1, "x", "y"), (None, "b " * 40, 1, "x", "y")]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 5
    spark.createDataFrame(rows, "doc_id bigint, text string, n_runs int, runs string, collapsed string").repartition(3).write.parquet(
        f"{tmp_path}/documents.parquet")
    got = periodic.query(spark, str(tmp_path)).collect()
    want = sorted(((r[0], *expected(r[0], r[1])) for r in rows), key=str)
    assert sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
                   for r in got), key=str) == want


def test_operator_keeps_columns(spark):
    docs = spark.createDataFrame([("a b c " * 9 + "end", 1, 2), (None, 3, 4)], "body string, runs int, collapsed int")
    a, b = sorted(periodic.find_runs(docs, "body").collect(), key=lambda r: r.runs)
    assert (a.runs, a.collapsed, a["_runs"], a["_collapsed"]) == (1, 2, [(0, 27, 3)], "a b c end")
    assert (b.runs, b.collapsed, b["_runs"], b["_collapsed"]) == (3, 4, [], "")
    assert periodic.find_runs(docs.limit(0), "body").count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(docs, "body", min_exponent=1.5)
