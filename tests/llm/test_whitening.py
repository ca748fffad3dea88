"""Whitening against numpy's dense eigensolver and whole-number arithmetic."""

import numpy as np
import pytest

from sylva.llm import whitening


def spectra():
    rng = np.random.default_rng(0)
    for d in (1, 2, 7, 64):
        x = rng.standard_normal((500, d)) * 8
        yield f"random {d}", np.cov(x.T, bias=True).reshape(d, d)
    yield "alike", np.eye(40) * 64
    q = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    for name, e in (("pairs", np.repeat(np.linspace(1, 2, 24), 2)), ("falling", 0.6 ** np.arange(48)), ("rank 5", [5, 4, 3, 2, 1] + [0] * 43),
                    ("cluster", [9] + [1 + 1e-12 * i for i in range(30)] + [0.1] * 17)):
        v = (q * np.array(e)) @ q.T
        yield name, (v + v.T) / 2


@pytest.mark.parametrize("name, v", list(spectra()))
def test_leading(name, v):
    values, x = whitening.leading(v, 32)
    true = np.linalg.eigvalsh(v)[::-1]
    n = min(32, int((true > 1e-10 * true[0]).sum()))
    assert len(values) >= n and np.allclose(values[:n], true[:n], rtol=1e-5, atol=1e-13 * true[0])
    assert np.allclose(x.T @ x, np.eye(len(values)), atol=1e-12)
    assert np.linalg.norm(v @ x - x * values, axis=0).max() < 1e-12 * true[0]


def test_inertia():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 30):
        v = rng.standard_normal((d, d))
        v += v.T
        e = np.linalg.eigvalsh(v)
        for s in np.concatenate([(e[1:] + e[:-1]) / 2, [e[0] - 1, e[-1] + 1]]):
            assert whitening.above(v, s) == (e > s).sum()
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0) == 1 and whitening.above(np.zeros((3, 3)), 0) == 0


def test_a_missed_eigenvalue_is_an_error():
    with pytest.raises(ArithmeticError):
        whitening.feast(np.diag([1.0, 2.0, 3.0]), 1.5, 2.5, 2)


def check(rows, got, components=32, scale=64, offset=1_000_000):
    """``rows``: the (id, vector) that take part; ids are distinct here."""
    x = np.floor(np.array([v for _, v in rows], "f8") * scale).astype("i8") + offset
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, x.shape[1], int((e > 1e-10 * e[0]).sum()))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == {i for i, _ in rows}
    w = np.array([[by[i][j + 1].whitened for j in range(k)] for i, _ in rows])
    assert all(len(d) == k for d in by.values())
    for (i, _), a in zip(rows, x):
        r = by[i][1]
        assert r.n == n and r.deviation == sum((n * int(b) - int(t)) ** 2 for b, t in zip(a, s))
    assert np.allclose([by[rows[0][0]][j + 1].explained for j in range(k)], e[:k] / e.sum(), rtol=1e-6)
    m = w - w.mean(axis=0)
    assert np.abs(m.T @ m / n - np.eye(k)).max() < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    far = np.abs((c @ u[:, :k]) / np.sqrt(e[:k]))
    gaps = np.abs(np.diff(e[:k + 1])).min() if len(e) > k else np.abs(np.diff(e[:k])).min(initial=1)
    if gaps > 1e-6 * e[0]:
        assert np.allclose(np.abs(w), far, atol=1e-6)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    return [(i, [float(np.float32(x)) for x in rng.standard_normal(40) * (1 + np.arange(40) / 9) / 8]) for i in range(300)]


def test_query(spark, vectors, tmp_path):
    bad = [(900, None), (901, [None] + [0.1] * 39), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (904, []),
           (905, [0.5] * 39), (906, [1e30] * 40)]
    good = [*vectors, (700, [0.0] * 40), (None, [0.25] * 40)]
    spark.createDataFrame([(i, v, 5, 0.1, 3) for i, v in good + bad], "vec_id bigint, embedding array<float>, component int, whitened double, n int").repartition(
        4).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(good, whitening.query(spark, str(tmp_path)).collect())


def test_same_however_rows_are_dealt(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    a, b = (sorted(whitening.whiten(df.repartition(p), scale=64, offset=1_000_000).collect(), key=lambda r: (r.vec_id, r.component)) for p in (2, 7))
    assert [(r.deviation, r.explained) for r in a] == [(r.deviation, r.explained) for r in b]     # the same fit, bit by bit
    assert np.allclose([r.whitened for r in a], [r.whitened for r in b], rtol=0, atol=1e-13)


def test_few_rows_and_directions(spark):
    def run(rows, **kw):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scale=64, **kw).collect()

    assert run([]) == [] and run([(1, None)]) == []
    assert run([(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == []      # all alike: no component
    check([(1, [0.5, 0.0, 1.0]), (2, [0.0, 0.0, 1.0])], run([(1, [0.5, 0.0, 1.0]), (2, [0.0, 0.0, 1.0])]), offset=0)
    twice = run([(1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [-0.5, 1.0]), (3, [1.0, 0.0])])
    assert sorted((r.vec_id, r.component) for r in twice) == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    one = run([(i, [float(i), float(i % 2)]) for i in range(9)], components=1)
    assert {r.component for r in one} == {1} and len(one) == 9


def test_large_entries(spark):
    rows = [(i, [2.0**38 * (i % 3), -(2.0**30) * i, float(i)]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scale=64, offset=1_000_000).collect()
    x = [[int(np.floor(c * 64)) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    for r in got:
        far = sum((20 * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
        assert r.deviation == (far if far < 2**63 else None)
