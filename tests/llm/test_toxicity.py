"""The classifier's features and ratios against plain loops, its result by held-out texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import toxicity

INSULTS = ["idiot", "moron", "you scum"]


def made_up(n, seed=1):
    """(doc_id, text, toxic): invented words, with an insult somewhere in a third of the texts."""
    rng, out = random.Random(seed), []
    syllables = ["an", "the", "or", "in", "tion", "es", "id", "ot", "mo", "ron", "sc", "um"]
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.choice([5, 60, 400]))]
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS).upper() if i % 2 else rng.choice(INSULTS))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = made_up(600)
    docs = spark.createDataFrame([(i, t, "s", 0.5, 1) for i, t, _ in rows] + [(None, None, "s", 0.5, 1), (9001, "", "s", 0.5, 1),
                                 (9002, None, "s", 0.5, 1), (3, rows[3][1], "s", 0.5, 1)],
                                 "doc_id bigint, text string, source string, score double, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(1, 1, None), (None, 1, 1), (9002, 0, 0), (70_000, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    return rows, docs, labels


def plain_bins(text):
    out, chars = set(), [max(ord(c), 32) for c in text.lower()]
    for n in toxicity.SIZES:
        for i in range(len(chars) - n + 1):
            h = 0
            for c in chars[i:i + n]:
                h = (h * 1000003 + c) % 2**32
            out.add(((h ^ n) * 2654435761 % 2**32) >> (32 - toxicity.BITS))
    return sorted(out)


def test_bins(monkeypatch):
    texts = ["", "a", "ab", "Hello\n you Idiot", "ÀÉ 日本語 𝒳y", "abc " * 50]
    whole = [toxicity.bins(t).tolist() for t in texts]
    assert whole == [plain_bins(t) for t in texts] and toxicity.bins(None).tolist() == []
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert [toxicity.bins(t).tolist() for t in texts] == whole


def test_regression_finds_the_minimum():
    rng = np.random.default_rng(0)
    examples = [np.sort(rng.choice(30, 6, replace=False)).astype("i4") for _ in range(80)]
    labels = np.array([float(3 in e or rng.random() < 0.1) for e in examples])
    ratios = np.zeros(toxicity.GRAMS)
    ratios[:30] = rng.standard_normal(30)
    w = toxicity.Weights(ratios, examples, labels, 0.01)
    x = np.zeros((80, 31))
    for row, e in zip(x, examples):
        row[e] = ratios[e]
    x[:, 30] = 1
    p, keep = np.zeros(31), np.append(np.ones(30), 0)
    for _ in range(50):     # Newton's method
        s = 1 / (1 + np.exp(-x @ p))
        grad = x.T @ (s - labels) / 80 + 0.01 * keep * p
        p -= np.linalg.solve((x.T * (s * (1 - s))) @ x / 80 + np.diag(0.01 * keep + 1e-12), grad)
    assert np.allclose(w.bin[:30], p[:30] * ratios[:30], atol=2e-2) and abs(w.intercept - p[30]) < 2e-2


def test_counts_and_held_out(tables, spark, tmp_path):
    rows, docs, labels = tables
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all(r.held_out for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    empty = {r.score for r in got if r.doc_id in (None, 9001, 9002)}
    assert len(empty) == 1
    assert len({r.score for r in got if r.doc_id == 3}) == 1


def test_ratios_count_all_learning_rows(tables):
    rows, docs, labels = tables
    few = toxicity.fit(docs, labels, sample=40)
    many = toxicity.fit(docs, labels, sample=1000)
    counted = docs.join(labels.filter("toxic is not null"), "doc_id").select("text", F.col("toxic").alias("label"))
    n = np.zeros((2, toxicity.GRAMS))
    for r in counted.collect():
        n[r.label, plain_bins(r.text or "")] += 1
    totals = [sum(1 for r in counted.collect() if r.label == y) for y in (0, 1)]
    r = toxicity.log_count_ratios(n[1], n[0], totals[1], totals[0], 1.0)
    got = toxicity.fit(docs.repartition(7), labels, sample=1000)
    assert np.array_equal(got.bin, many.bin)      # however rows are dealt
    assert np.all(np.sign(r[many.bin != 0]) != 0) and not np.array_equal(few.bin, many.bin)
    assert r[plain_bins("idiot")].mean() > 1


def test_edges(tables, spark):
    rows, docs, labels = tables
    none = toxicity.fit(docs, labels.filter("toxic is null"))
    assert [r["_score"] for r in toxicity.classify(docs.filter("doc_id = 9001"), none).collect()] == [0.5]
    one = toxicity.fit(docs, labels.filter("toxic = 1"))
    out = toxicity.classify(docs, one)
    assert out.columns == [*docs.columns, "_score", "_predicted"] and {r["_score"] for r in out.collect()} == {1.0}
    nothing = docs.limit(0)
    assert toxicity.classify(nothing, toxicity.fit(nothing, labels)).count() == 0
    long = spark.createDataFrame([(1, "the or in " * 300_000 + "you IDIOT"), (2, "the or in " * 300_000)], "doc_id bigint, text string")
    scores = [r.score for r in toxicity.classify(long, toxicity.fit(docs, labels)).orderBy("doc_id").collect()]
    assert scores[0] > 0.3 > scores[1]
