"""The training-data operators against brute force on small tables with nulls, empty and
repeated rows, ties and columns whose names clash with the operators' own."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sylva.llm import exact_dedup, lm, mixing, near_dup, nearest, packing, quality, token_counts, warc, warc_query
from sylva.llm.common import id_remainder
from sylva.llm.gru import GRU

BASE = "the quick brown fox jumps over the lazy dog and runs through the old forest until night falls over the hills again"
TEXTS = [(1, "Hello, World!", "a"), (2, "hello, world!", "a"), (3, None, "b"), (4, "", None), (5, "Ünï códe été  \t naïve", "b"),
         (6, "x " * 3000, "a"), (7, "日本語 ́combining \x1c odd <|endoftext|> İ Σας", "c"), (8, BASE, "a"), (9, BASE + " x", "a"),
         (10, "totally different words stand in this other text here", "c"), (10, "totally different words stand in this other text here", "c"),
         (None, "no id", "b"), (11, "it's we'll 12 3.5 don't!!  a", "b")]
SCHEMA = "doc_id bigint, text string, source string, size int, score double, kept int, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, 0.5, 1, 2) for r in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return (text or "").encode().lower()


def test_exact_dedup(docs, nothing):
    rows = exact_dedup.new_index(docs).add(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        same = [i for i, t, _ in TEXTS if hashlib.sha256(lower(t)).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == max((i for i in same if i is not None), default=None)
        assert r.kept == (r.doc_id == r.keep_id)
    kept = exact_dedup.keep_one(docs, exact_dedup.new_index(docs))
    assert kept.columns == docs.columns and kept.count() == len({lower(t) for _, t, _ in TEXTS})
    assert exact_dedup.new_index(nothing).add(nothing).count() == 0


def test_exact_dedup_index_persists(docs):
    index = exact_dedup.new_index(docs)
    assert exact_dedup.keep_one(docs, index).count() and not index.add(docs.filter("doc_id = 1")).first().kept
    assert index.rows().count() == len({lower(t) for _, t, _ in TEXTS})


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert all(r.target <= 2 * r.source_size + 1e-9 and r.taken in (0, r.size, 2 * r.size) for r in rows)
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns and repeated.filter("doc_id = 6").count() * 3000 == sum(r.taken for r in rows if r.doc_id == 6)
    assert mixing.mix(nothing).count() == 0


def test_packing(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, capacity = Tokenizer.from_file(path), 64
    want = Counter()
    for i, text, _ in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            want[(i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    rows = packing.pack(docs, path, capacity=capacity).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= capacity and len(at) <= -(-sum(at.values()) // capacity) + 1
    assert packing.pack(nothing, path).count() == 0


def test_recipes_use_up_the_histogram():
    rng = np.random.default_rng(0)
    histogram = Counter(rng.integers(1, 101, 500).tolist())
    recipes, used = packing.plan_sequences(histogram, 100), Counter()
    for times, lengths in recipes:
        assert sum(lengths) <= 100
        for n in lengths:
            used[n] += times
    assert used == histogram
    gaps = []  # best-fit decreasing, piece by piece
    for n in sorted(histogram.elements(), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 100) - n)
    assert sum(t for t, _ in recipes) <= 1.02 * len(gaps)


def test_token_counts(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, _ in TEXTS)
    assert Counter(map(tuple, token_counts.count_tokens(docs, path).collect())) == want
    assert token_counts.count_tokens(nothing, path).count() == 0


def test_near_dup(docs, nothing):
    rows = near_dup.clusters(docs).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) and by_id[9].cluster_id == 8 == by_id[8].cluster_id and by_id[2].cluster_id == 1
    assert by_id[3].cluster_id == 3 == by_id[4].cluster_id and by_id[5].cluster_id == 5 and by_id[6].cluster_size == 1
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.cluster_id for r in rows})
    assert near_dup.clusters(nothing).count() == 0


def test_near_dup_by_slices(spark, monkeypatch):
    """A hot group whose copies are partly under the threshold to each other, with no turn of
    pivots but the first and slices of a few texts, against all pairs."""
    monkeypatch.setattr(near_dup, "PIVOTS", 1)
    monkeypatch.setattr(near_dup, "SLICE", 400)
    rng = np.random.default_rng(5)
    base, texts = [f"w{k}" for k in range(70)], []
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, 70, rng.integers(1, 5)):
            words[k] = f"x{rng.integers(0, 12)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[k:k + 5]) for k in range(66)} for w in map(str.split, texts)]
    of = list(range(150))
    for i in range(150):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    found = {r.doc_id: r.cluster_id for r in near_dup.clusters(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert 1 < len(set(of)) < 150 and found == dict(enumerate(of))


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(near_dup, "WIDE", 3)
    rng = np.random.default_rng(2)
    left, right = ([np.unique(rng.integers(0, 30, n)).astype("i8") for n in sizes] for sizes in ((9, 0, 20), (5, 25)))
    got = near_dup.shared_counts(np.concatenate(left), np.repeat(range(3), list(map(len, left))),
                                 np.concatenate(right), np.repeat(range(2), list(map(len, right))), (3, 2))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    h = near_dup.mixed(np.arange(1, 301, dtype="u8"))
    wa, wb = rng.random(200) + 0.1, rng.random(200) + 0.1
    who = near_dup.signatures(np.concatenate([h[:200], h[100:]]), np.concatenate([wa, wb]), np.repeat([0, 1], 200), 2, 4000)
    a, b = np.zeros(300), np.zeros(300)
    a[:200], b[100:] = wa, wb
    both = np.flatnonzero((a > 0) & (b > 0))
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in both)
    assert abs((who[0] == who[1]).mean() - want) < 0.04


def test_bands_miss_no_pair_with_repeats():
    """Near copies of which one repeats a menu of three lines a hundred times: nearly all share
    a bucket of weighted signatures, but not at the rate that is stated."""
    rng, texts = np.random.default_rng(4), []
    for i in range(200):
        words = [f"d{i}w{k}" for k in range(84)]
        menu = [w for k in rng.choice(16, 3, replace=False) for w in words[k * 5:k * 5 + 5]]
        texts += [" ".join(words + menu), " ".join(words + menu * 100)]
    cut = near_dup.Shingles()
    frames = list(near_dup._bands(25, 5)(iter([pd.DataFrame({"text": texts})])))
    bands = [set(map(int, b)) for f in frames for b in f["bands"]]
    sets = [set(cut(t)[0].tolist()) for t in texts]
    pairs = [k for k in range(0, 400, 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])]
    assert len(pairs) == 200 and all(bands[k] & bands[k + 1] for k in pairs)


def test_quality(spark, nothing):
    rows = [(i, ("good words stand here quietly " if i % 2 else "BUY!! NOW!! $$$ ") * (3 + i % 5) + str(i), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(100, None), (101, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:40]] + [(3, None), (None, 1)], "doc_id bigint, quality int")
    voters = quality.fit(docs, labels)
    out = {r.doc_id: r for r in quality.classify(docs, voters).collect()}
    assert len(out) == 62 and all(0 <= r.score <= 1 for r in out.values())
    assert all(out[i].predicted == q for i, _, q in rows[40:])
    assert quality.classify(nothing, quality.fit(nothing, labels)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 8)).astype("f4")
    v[50:60] = v[50]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = nearest.search(df, F.col("id") % 20 == 0, lists=4, probes=4).collect()
    w, hit = v.astype(float), 0
    for q in range(0, 300, 20):
        s = w @ w[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20].tolist()
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert len(own) == 20 and all(abs(x - s[i]) < 1e-12 for _, i, x in own)
        hit += len(set(want) & {i for _, i, _ in own})
    assert hit >= 0.95 * 300
    assert nearest.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("norm", [1e-3, 1, 100, 1e6])
def test_scan_keeps_hot_copies_at_any_norm(norm):
    rng = np.random.default_rng(3)
    for columns in (64, 384):
        for _ in range(20):
            v = rng.standard_normal((400, columns))
            v *= norm / np.linalg.norm(v, axis=1, keepdims=True)
            v[:40] = v[0]
            space = nearest.Space(v, norm, 1, 3)
            _, found = nearest.scan(space.queries(v[:1]), space.candidates(v), 21, 16, 2.1)
            assert set(range(40)) <= set(found.tolist())


def test_language_model(docs, nothing):
    rows = {r.doc_id: r for r in lm.score(docs, id_remainder("doc_id", 10) == 0, frequent=64, members=8).collect()}
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    counts, n_docs = Counter(), 0
    for i, t, _ in TEXTS:
        if not held(i):
            counts.update(lower(t).split())
            n_docs += 1
    n = sum(counts.values()) + n_docs
    z = n + 0.1 * (len(counts) + 2)
    for i, t, _ in TEXTS:
        words = lower(t).split()
        base = sum(np.log10((counts[w] + 0.1) / z) for w in words) + np.log10((n_docs + 0.1) / z)
        assert rows[i].train_tokens == n and rows[i].n_tokens == len(words) + 1 and abs(rows[i].base_score - base) < 1e-6 * max(1, -base)
        assert rows[i].score < 0
    assert lm.score(nothing, id_remainder("doc_id", 10) == 0, frequent=64, members=8).count() == 0


def test_gru_learns_and_windows_carry_state():
    docs = [np.tile(np.array([1, 2, 3], "u2"), 40) if k % 2 else np.tile(np.array([4, 5], "u2"), 50) for k in range(60)]
    model = GRU(8, 4, np.ones(10), 12)
    before = model.score(docs).sum()
    for _ in range(8):
        model.train(docs, 0.02, width=16)
    assert model.score(docs).sum() > 0.5 * before
    assert np.allclose(model.score(docs, cells=64), model.score(docs, cells=1 << 20), rtol=1e-4)


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "WARC/1.1\r\n\r\n" * 3), (5, "u", "z" * 9000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, payload int")
    got = {r.page_id: r for r in warc_query.round_trip(df, str(tmp_path / "w")).collect()}
    first = {1: None, 2: 1, 3: None, 4: 3, 5: None, None: None}
    for i, _, h in pages:
        data = (h or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert got[i].refers_to == first[i] and got[i].record_type == ("revisit" if first[i] else "response")
    one = warc.read_warc(spark, str(tmp_path / "w"), F.col("target_uri").startswith("http://a")).collect()
    assert [r.target_uri for r in one] == ["http://a/%20b"] and one[0].payload.decode() == "<p>é</p>"
    assert warc_query.round_trip(df.limit(0), str(tmp_path / "none")).count() == 0


def test_exact_dedup_index_reopened(spark, docs):
    """In a later session with other settings the same texts are known, and no table is left in the catalog."""
    before, path = spark.conf.get("spark.sql.shuffle.partitions"), exact_dedup.shared_path(spark, "reopened")
    tables = {t.name for t in spark.catalog.listTables()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        first = exact_dedup.new_index(docs, path=path)
        kept = exact_dedup.keep_one(docs, first).count()
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        again = exact_dedup.new_index(docs, path=path)
        assert again.buckets == first.buckets == 4 and kept > 0
        assert exact_dedup.keep_one(docs, again).count() == 0
        assert again.rows().count() == len({lower(t) for _, t, _ in TEXTS})
        more = spark.createDataFrame([(77, "not seen before"), (78, "Hello, World!")], "doc_id bigint, text string")
        assert {r.doc_id: r.kept for r in again.add(more).collect()} == {77: True, 78: False}
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, path, buckets=7)
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, path, id_type="string")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_packing_memory_is_bounded_in_bytes(monkeypatch):
    whole = packing.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"word{i}x{k}" for k in range(300)) + " " + "y" * 500 for i in range(5)]
    want = list(whole(texts))
    assert all(len(c) <= packing.LONGEST for c in whole)
    monkeypatch.setattr(packing, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(packing, "UNIT_BYTES", 20_000)
    small = packing.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    got = []
    for ids in small(texts):
        got.append(ids)
        assert max(small.held, small.units.held) <= 20_000 and len(small) + len(small.units) < 240
    assert got == want


def foreign(payload, digest, extra="", length=True, end="\r\n\r\n"):
    head = ["WARC/1.0", "WARC-Type: resource", "WARC-Record-ID: <urn:x>", "WARC-Target-URI: http://a.b/", extra, f"WARC-Payload-Digest: {digest}"]
    head += [f"Content-Length: {len(payload)}"] if length else []
    return ("\r\n".join(h for h in head if h) + "\r\n\r\n").encode() + payload + end.encode()


def test_warc_of_other_writers(spark, tmp_path):
    import gzip
    data = b"some payload"
    sha1, sha256, md5 = (hashlib.new(a, data) for a in ("sha1", "sha256", "md5"))
    b32 = base64.b32encode(sha1.digest()).decode()
    digests = {f"sha1:{b32}": b32, f"sha1:{b32.lower()}": b32, f"SHA1:{sha1.hexdigest()}": b32, f"sha-1:{sha1.hexdigest().upper()}": b32,
               b32: b32, f"sha256:{sha256.hexdigest()}": f"sha256:{sha256.hexdigest()}", f"md5:{md5.hexdigest().upper()}": f"md5:{md5.hexdigest()}",
               f"sha256:{base64.b32encode(sha256.digest()).decode().lower()}": f"sha256:{base64.b32encode(sha256.digest()).decode().rstrip('=')}",
               "blake9:whatever": "blake9:whatever"}
    (tmp_path / "a.warc").write_bytes(b"".join(foreign(data, d, "X-Long: one\r\n two") for d in digests))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(foreign(data, d, length=i % 2 == 0)) for i, d in enumerate(digests)))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.payload_digest for r in got) == sorted([*digests.values()] * 2) and {bytes(r.payload) for r in got} == {data}
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "c.warc").write_bytes(foreign(data, f"sha256:{'0' * 64}"))
    with pytest.raises(Exception, match="differs"):
        warc.read_warc(spark, str(bad)).collect()
    (bad / "c.warc").write_bytes(foreign(data, "", length=False))
    with pytest.raises(Exception, match="Content-Length"):
        warc.read_warc(spark, str(bad)).collect()
