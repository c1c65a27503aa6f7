import math

import numpy as np
import pytest

from eddyline.llm import whitening as Wh

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def brute(rows, k=16):
    """Integer vectors, exact sums, covariance from exactly centred entries."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [1_000_000] * (d - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    exact = lambda x: [n * a - s for a, s in zip(x, sums)]
    m = np.array([[o / n for o in exact(x)] for x in fit]).reshape(n, d)
    w, u = np.linalg.eigh(m.T @ m / max(n, 1))
    w, u = w[::-1], u[:, ::-1]
    good = int((w > 1e-9 * max(w.sum(), 1e-300)).sum()) if n else 0
    k = min(k, good)
    rows = [(i, sum(o * o for o in exact(x)), np.array([o / n for o in exact(x)]) @ (u[:, :k] / np.sqrt(w[:k]))) for i, x in kept]
    return n, w[:k] / max(w.sum(), 1e-300), rows


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA)
    got = Wh.whiten(df).collect()
    n, explained, want = brute(rows)
    k = len(explained)
    assert len(got) == k * len(want)
    if not got:
        return
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    table, ref = [], []
    for (i, dev), rs in sorted(by.items(), key=str):
        rs.sort(key=lambda r: r["component"])
        copies = len(rs) // k
        assert [r["component"] for r in rs] == [c + 1 for c in range(k) for _ in range(copies)]
        assert np.allclose([r["explained"] for r in rs[::copies]], explained, rtol=1e-9)
        table.append([r["whitened"] for r in rs[::copies]])
    for (i, dev) in sorted(by, key=str):
        same = [w for j, e, w in want if (j, e) == (i, dev)]
        assert same
        ref.append(same[0])
    table, ref = np.array(table), np.array(ref)
    sign = np.sign((table * ref).sum(axis=0))
    assert np.allclose(table, ref * sign, atol=1e-8)


def test_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, .1, 40) * (1 + np.arange(40) / 40)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(50)]
    rows += [(5, rows[5][1]), (None, rows[9][1]), (2000, None), (2001, [1.0, None]), (2002, [math.nan]), (2003, [math.inf, 0.0])]
    check(spark, rows)


def test_small_dimensions_ragged_and_constant(spark):
    rng = np.random.default_rng(4)
    check(spark, [(i, [float(c) for c in rng.normal(0, 3, 5)] + [2.5]) for i in range(30)])       # one dimension without variance
    check(spark, [(1, [1.0, 2.0]), (2, [3.0]), (3, [])])
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])                                                # all vectors equal
    check(spark, [(1, [])])
    check(spark, [])


def test_far_mean_keeps_all_digits(spark):
    rng = np.random.default_rng(5)
    check(spark, [(i, [float(c) for c in 30_000 + rng.integers(-8, 8, 3) / 64]) for i in range(200)])


@pytest.mark.parametrize("gap", [0.0, 1e-9, 1e-3])
def test_iteration_restarts_close_and_equal_values(gap):
    """Products alone, in many dimensions, so that the subspace restarts."""
    rng = np.random.default_rng(6)
    d, k, calls = 400, 16, []
    u = np.linalg.qr(rng.normal(size=(d, d)))[0]
    w = np.sort(np.concatenate([100 - gap * np.arange(4), 50 + np.arange(20) * .5, rng.random(d - 24) * 40]))[::-1]

    def product(q):
        calls.append(q.shape[1])
        return u @ (w[:, None] * (u.T @ q))

    values, vectors = Wh.jacobi_davidson(product, d, k)
    assert np.allclose(values, w[:k], rtol=1e-13)
    assert np.abs(product(vectors) - vectors * values).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert max(calls) <= 2 * k


def test_whole_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(spark, rows)
    assert Wh.op13_whitening(spark, sf).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_too_large_entries_raise(spark):
    with pytest.raises(Exception, match="2\\^40|overflow"):
        Wh.whiten(spark.createDataFrame([(1, [1e30], 1, "")], SCHEMA)).collect()
