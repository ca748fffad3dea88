"""Every stage of the corpus pipeline, and the whole of it, against plain Python on a small corpus with copies,
near copies, junk, nulls, empty texts, repeated rows and columns whose names clash with the operators' own."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sylva.llm import mixing, quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, predicted int, text_sha256 string"


def corpus():
    rng, words = random.Random(7), [f"word{i}" for i in range(400)]
    good = lambda n: " ".join(rng.choices(words, k=n)).capitalize() + "."
    texts = [good(rng.choice([12, 40, 90, 300])) for _ in range(70)]
    texts += ["BUY!! NOW!! $$$ CHEAP " * rng.randint(3, 30) + str(i) for i in range(25)]
    texts += [texts[0].upper(), texts[0], texts[1], texts[1].lower()] + [texts[3]] * 12     # equal but for A-Z
    for i in range(20, 28):     # near copies: a word or two of a hundred differ
        own = (texts[i] + " " + good(100)).split()
        texts.append(" ".join(own))
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [None, "", "", " ", good(6000)]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or ""), 0.5, "no", 0, "x") for i, t in enumerate(texts)]
    return rows + [rows[2], rows[5], (None, good(30), "en", "a", 1, 0.5, "no", 0, "x")]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    base, rows = str(tmp_path_factory.mktemp("pipeline")), corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{base}/documents.parquet")
    labels = [(i, int("BUY" not in (t or "")), 0) for i, t, *_ in rows if i is not None and i < 95] + [(1, None, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    docs, out = spark.read.parquet(f"{base}/documents.parquet"), [[tuple(r) for r in rows]]
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, base)
        result.write.parquet(f"{base}/{name}")
        columns, docs = docs.columns, spark.read.parquet(f"{base}/{name}")
        assert name == "packing" or docs.columns == columns
        out.append([tuple(r) for r in docs.collect()])
    return base, out


def count(rows):
    return Counter(map(str, rows))


def test_quality_stage_drops_what_the_vote_rejects(spark, stages):
    base, (before, after, *_) = stages
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    voters = quality.fit(docs, labels.filter("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 != 0"))
    kept = []
    for row in before:      # the neighbours of each text by sorting all cosines
        x = quality.term_weights(row[1]).astype("f8") * voters.idf
        x = x / np.linalg.norm(x) @ voters.space
        cos = (x / np.linalg.norm(x)) @ voters.units
        near = np.argsort(-cos, kind="stable")[:15]
        weight = np.maximum(cos[near], 1e-6) ** 4
        score = (weight * voters.labels[near]).sum() / weight.sum()
        assert abs(score - voters.score(quality.term_weights(row[1])[None])[0]) < 1e-4
        if score >= 0.3:
            kept.append(row)
    assert count(after) == count(kept) and 0 < len(after) < len(before)
    good = [r for r in before if r[0] is not None and r[0] < 70]
    assert not count(good) - count(after)       # clean documents stay


def test_exact_stage(stages):
    _, (_, before, after, *_) = stages
    best = {}
    for row in before:
        text = (row[1] or "").encode().lower()
        if text not in best or (best[text][0] or -1) < (row[0] or -1):
            best[text] = row
    assert count(after) == count(best.values()) and len(after) < len(before)


def test_near_stage(stages):
    _, (_, _, before, after, *_) = stages
    sets = []
    for row in before:
        w = (row[1] or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})
    of = list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    where = {str(r): c for r, c in zip(before, of)}
    assert sorted(where[str(r)] for r in after) == sorted(set(of)) and len(set(of)) < len(before)


def test_mixing_stage(spark, stages):
    _, (_, _, _, before, after, _) = stages
    taken = mixing.mix(spark.createDataFrame(before, SCHEMA)).collect()
    words = lambda t: len((t or "").split())
    assert all(n <= 2 for n in count(after).values()) and not set(count(after)) - set(count(before))
    assert sum(words(r[1]) for r in after) == sum(r.taken for r in taken)
    sizes, targets = Counter(), {}
    for r in before:
        sizes[r[3]] += words(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight, left, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        rest = left - sum(2 * sizes[s] for s in capped)
        targets = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_} | {s: 2 * sizes[s] for s in capped}
        above = {s for s in open_ if targets[s] > 2 * sizes[s]}
        if not above:
            break
        capped |= above
    got = {r.doc_id: r for r in taken}
    for r in before:
        assert got[r[0]].target == pytest.approx(targets[r[3]]) and got[r[0]].source_size == sizes[r[3]]


def test_packing_stage(spark, stages):
    base, (*_, before, _) = stages
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for row in before:
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at:at + 4096]
            want[row[0], k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    rows = spark.read.parquet(f"{base}/packing").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096


def test_run_is_its_stages(spark, stages):
    base, (*_, last) = stages
    rows = corpus_pipeline.run(spark, base)
    names = ("doc_id", "piece", "length", "ids_crc32")
    at = [rows.columns.index(c) for c in names]
    assert count(tuple(r[i] for i in at) for r in rows.collect()) == count(tuple(r[i] for i in at) for r in last)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
