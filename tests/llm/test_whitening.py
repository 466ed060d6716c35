"""Whitening against numpy's eigenvalues, and on odd rows."""

import numpy as np
import pytest

from panelcast.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("seed", range(6))
def test_spectrum_equals_eigenvalues(seed):
    r = np.random.default_rng(seed)
    n = [1, 2, 5, 30, 64, 90][seed]
    q = np.linalg.qr(r.standard_normal((n, n)))[0]
    for values in (r.random(n), 10.0 ** -np.arange(n).clip(max=14), np.repeat([3.0, 1.0], [n // 2, n - n // 2]), np.concatenate([np.zeros(n // 2), 5 + 1e-3 * r.random(n - n // 2)]), np.ones(n), np.arange(n) - n / 2):
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        e, w = whitening.spectrum(a)
        scale = np.abs(values).max()
        assert np.allclose(e, np.sort(values)[::-1], atol=1e-13 * n * scale)
        assert np.allclose(w.T @ w, np.eye(n), atol=1e-13 * n)
        assert np.allclose(a @ w, w * e, atol=1e-12 * n * scale)
        some = whitening.spectrum(a, 3)
        assert np.allclose(some[0], e[:3]) and some[1].shape == (n, min(n, 3))


def test_polar_factor():
    r = np.random.default_rng(3)
    a = r.standard_normal((40, 40))
    a = a + a.T
    e, w = np.linalg.eigh(a)
    assert np.allclose(whitening.polar(a), (w * np.sign(e)) @ w.T, atol=1e-12)


def by_hand(rows):
    good = [(k, v) for k, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, (_, v) in enumerate(good)}
    points = np.array(sorted(set(map(tuple, x.values()))), float)
    n, total = len(points), points.sum(0)
    centred = points - total / n
    v = centred.T @ centred / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    out = []
    for i, (key, _) in enumerate(good):
        deviation = sum((n * c - int(s)) ** 2 for c, s in zip(x[i], total, strict=True))
        for k in range(min(4, len(e))):
            if e[k] > 1e-9 * np.trace(v):
                out.append((key, k + 1, n, deviation, abs((np.array(x[i]) - total / n) @ w[:, k]) / np.sqrt(e[k]), e[k] / np.trace(v)))
    return sorted(out, key=str)


def test_equal_to_numpy(spark, tmp_path):
    r = np.random.default_rng(4)
    data = [(i, (r.standard_normal(12) * np.linspace(0.1, 1.5, 12) + 3).astype(np.float32).tolist()) for i in range(400)]
    data += [(1000 + i, data[0][1]) for i in range(300)] + [(None, data[1][1]), (5, data[2][1])]
    nan = float("nan")
    data += [(2000, None), (2001, [nan] * 12), (2002, [None] + [1.0] * 11), (2003, [float("inf")] + [1.0] * 11), (2004, [])]
    for rows in (data, data[:1] * 3 + data[-5:], data[:3]):
        folder = str(tmp_path / str(len(rows)))
        spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/embeddings.parquet")
        df = queries.op12_whitening(spark, folder)
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        got = sorted(((x.vec_id, x.component, x.n, x.deviation, abs(x.whitened), x.explained) for x in df.collect()), key=str)
        expected = by_hand(rows)
        assert [x[:4] for x in got] == [x[:4] for x in expected]
        assert np.allclose(np.array([x[4:] for x in got], float), np.array([x[4:] for x in expected], float), rtol=1e-9, atol=1e-9)
        assert all(x.identity_error < 1e-9 for x in df.collect())


def test_signs_are_one_for_all_rows_and_whitened_is_white(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.standard_normal(8).astype(np.float32).tolist()) for i in range(200)]
    d = spark.createDataFrame(rows, SCHEMA)
    y = np.array([x.whitened for x in whitening.whiten(d, whitening.fit(d, most=8)).collect()])
    assert np.allclose(y.T @ y / 200, np.eye(8), atol=1e-9)


def test_odd_inputs(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty, whitening.fit(empty)).count() == 0
    mixed = spark.createDataFrame([(i, [float(i), 1.0] if i < 5 else [1.0, 2.0, 3.0]) for i in range(8)], SCHEMA + "").withColumnRenamed("vec_id", "x")
    model = whitening.fit(mixed)
    assert model["d"] == 2 and len(model["values"]) == 1 and whitening.whiten(mixed, model, "x").count() == 5
    large = spark.createDataFrame([(i, [float(i) * 1e9, 1.0]) for i in range(20)], SCHEMA)
    got = {r.vec_id: r.deviation for r in whitening.whiten(large, whitening.fit(large)).collect()}
    assert got[10] == 20**2 * (256 * 10**9) ** 2 // 4 if 20**2 * (256 * 10**9) ** 2 // 4 < 1 << 63 else got[10] is None
