"""Whitening of embeddings against numpy and integers; divergence of sources against plain counting."""

import re
from collections import Counter
from math import inf, nan

import numpy as np
import pytest
from llm_rows import SCHEMA, empty, frame

from querywarden.llm import divergence, whitening

VECTORS = "vec_id long, embedding array<float>, label int, n long, whitened double, `odd.name` string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, 0.5, "x") for i, v in rows], VECTORS).repartition(3)


def checked(x, got, kept):
    """The rows of the result against numpy's own eigenvectors and Python's integers."""
    n, dims = x.shape
    total = x.sum(0)
    values, axes = np.linalg.eigh(np.cov((x - total / n).T, bias=True).reshape(dims, dims))
    values, axes = values[::-1][:kept], axes[:, ::-1][:, :kept]
    want = (x - total / n) @ axes / np.sqrt(values)
    have = np.array([r.whitened for r in got]).reshape(n, kept)
    assert np.allclose(np.abs(want), np.abs(have), atol=1e-6)
    assert all(r.identity_error < 1e-9 and r.n == n for r in got)
    deviation = [sum((n * int(a) - int(t)) ** 2 for a, t in zip(row, total)) for row in x]
    assert [r.deviation for r in got[::kept]] == deviation
    assert np.allclose([r.explained for r in got[:kept]], values / np.trace(np.cov((x - total / n).T, bias=True).reshape(dims, dims)))


def test_whitened_rows_against_numpy(spark):
    rng = np.random.default_rng(3)
    e = (rng.normal(size=(60, 5)) * [3, 2, 1.5, 1, 0.4]).astype(np.float32)
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [nan] * 5), (903, [inf] + [0.0] * 4), (904, []), (905, [1.0, 2.0])]
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(e)] + bad)
    got = whitening.whiten(df, components=3).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in got] == [(i, c) for i in range(60) for c in (1, 2, 3)]
    checked(np.floor(64 * e.astype(float)).astype(np.int64) + 1_000_000, got, 3)


def test_repeated_rows_null_ids_and_flat_dimensions(spark):
    rng = np.random.default_rng(4)
    e = np.hstack([rng.normal(size=(20, 3)), np.ones((20, 2))]).astype(np.float32)
    rows = [(None if i == 0 else 7, v.tolist()) for i, v in enumerate(e)]
    got = whitening.whiten(vectors(spark, rows + rows)).collect()
    assert len(got) == 40 * 3 and {r.component for r in got} == {1, 2, 3}  # constant entries give no component
    assert sum(r.vec_id is None for r in got) == 6 and max(r.identity_error for r in got) < 1e-9
    same = whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)]))
    assert same.collect() == [] and same.columns == [f.split()[0] for f in whitening.RESULT.split(", ")]
    assert whitening.whiten(vectors(spark, [])).collect() == []


def test_deviation_beyond_a_long_is_null():
    x = np.array([[2**40, 0], [-(2**40), 0], [0, 3]], np.int64)
    centre = whitening.Centre(3, [0, 3])
    assert centre.deviation(x) == [None, None, 36]
    near = whitening.Centre(1, [0, 0])
    assert near.deviation(np.array([[3_037_000_499, 0], [3_037_000_500, 0]], np.int64)) == [3_037_000_499**2, None]


@pytest.mark.parametrize("values", [
    [5.0] * 10 + [5 + 1e-9] * 3 + [1, 1 + 1e-12, 2] + [0.1 * i for i in range(20)], [1.0] * 6, [0.0] * 3 + [2.0] * 4,
    [float(np.exp(-i / 4)) for i in range(60)], [7.0],
])
def test_refined_vectors_of_clustered_eigenvalues(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    lam, x = whitening.refined_eigen(a)
    assert float(np.abs(x.T @ x - np.eye(len(a))).max()) < 1e-16
    assert float(np.abs(a.astype(np.longdouble) @ x - x * lam).max()) < 1e-15 * max(values)
    assert np.allclose(sorted(values, reverse=True), lam.astype(float), atol=1e-13)


def divergence_by_hand(rows, min_docs, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), s) for t, la, s in rows if la == lang]
        df = Counter(w for words, _ in docs for w in set(words))
        kept = sorted(w for w in df if df[w] >= min_docs)
        counts = {s: Counter() for _, s in docs}
        for words, s in docs:
            counts[s].update(w for w in words if w in set(kept))
        whole = sum(counts.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        q = share(whole)
        p = {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in counts if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(items[:limit])]
    return out


def test_divergence_by_hand(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 2)   # several tiles and blocks
    monkeypatch.setattr(divergence, "BLOCK", 3)
    rnd = np.random.default_rng(1)
    words = ["Aa", "b", "Cç", "d", "éE", "f", "G", "zz", "rare"]
    rows = [(" ,1".join(rnd.choice(words, 6)), ["en", "de", None, ""][i % 4], f"s{rnd.integers(5)}") for i in range(120)]
    rows += [("", "en", "only empty"), (None, "en", None), ("few", "xx", "a"), ("few", "xx", "b"), ("few", "xx", "b")]
    rows += [rows[0]] * 40                        # repeated rows
    df = spark.createDataFrame([(i, t, la, s, 1, 2, 3.0, "x", "y") for i, (t, la, s) in enumerate(rows)], SCHEMA).repartition(4)
    for top in (2, 50):
        got = [tuple(r) for r in divergence.source_divergence(df, min_docs=10, top=top).collect()]
        assert sorted(got) == sorted(divergence_by_hand(rows, 10, top))


def test_divergence_of_odd_rows_and_none(spark):
    odd = frame(spark)
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    for least in (1, 3, 30):
        got = [tuple(r) for r in divergence.source_divergence(odd, min_docs=least).collect()]
        assert sorted(got) == sorted(divergence_by_hand(rows, least, 50))
    assert divergence.source_divergence(empty(spark)).collect() == []
