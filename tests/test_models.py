"""Properties of the models against plain numpy written from the formulas."""

import numpy as np
import pytest

from seriesloom.operators import factor, fill, generate, matrix, page
from seriesloom.plans.models import Segmented, SyntheticControl, fit_als, fit_svd
from seriesloom.sources import series as S
from seriesloom.streaming import updates


def frame(spark, data):
    rows = [(k, t, None if np.isnan(v) else float(v)) for k, x in data.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, S.SERIES)


def reference(data, keys, n, m, k, p, past_only):
    every = np.concatenate(list(data.values()))
    mid = (np.nanmin(every) + np.nanmax(every)) / 2
    a = np.vstack([np.where(np.isnan(data[q]), mid, data[q])[-n * m :].reshape(m, n).T for q in keys])
    low = lambda x: (lambda u, s, v: (u[:, :k] * s[:k]) @ v[:k])(*np.linalg.svd(x, full_matrices=False))
    hat = low(a) / p
    rows = [i for i in range(len(a)) if not (i % n == n - 1 and (past_only or i // n == len(keys) - 1))]
    u, s, v = np.linalg.svd(hat[rows], full_matrices=False)
    kk = min(k, len(s))
    w = p * (u[:, :kk] / s[:kk]) @ (v[:kk] @ a[-1])
    return hat, w


@pytest.mark.parametrize(("n", "m", "k", "p", "past_only", "keys"), [(4, 80, 2, 1.0, True, ["x"]), (4, 80, 3, 0.7, True, ["y", "z", "x"]), (4, 80, 3, 0.8, False, ["y", "x"]), (1, 10, 2, 0.7, False, [*"abcdefghijkl", "x"])])
def test_svd(spark, n, m, k, p, past_only, keys):
    r = np.random.RandomState(5)
    t = np.arange(n * m + 7)
    names = dict.fromkeys([*keys, "unused"])
    data = {q: np.sin(t * (0.2 + i / 17)) * (i + 1) + r.randn(len(t)) * 0.3 for i, q in enumerate(names)}
    for q in data:
        data[q][r.rand(len(t)) > 0.9] = np.nan
    data["x"][-n * m :: n] = 1.0
    got = fit_svd(frame(spark, data), "x", keys[:-1], n=n, m=m, k=k, p=p, past_only=past_only)
    hat, w = reference(data, keys, n, m, k, p, past_only)
    assert np.allclose(got.weights, w, atol=1e-6)
    clean = {(x.series_key, x.t): x.value for x in got.denoised().collect()}
    want = {(q, c * n + i): hat[b * n + i, c] for b, q in enumerate(keys) for i in range(n) for c in range(m)}
    assert clean.keys() == want.keys() and all(np.isclose(clean[x], want[x], atol=1e-8) for x in want)
    assert np.isclose(len([1 for x in got.denoised(2, 5).collect()]), 3 * len(keys))


def test_wide_and_tall_agree(spark):
    r = np.random.RandomState(2)
    data = {f"d{i:02}": r.randn(12).cumsum() for i in range(70)} | {"x": r.randn(12).cumsum()}
    keys = sorted(q for q in data if q != "x")
    tall = SyntheticControl.fit(frame(spark, data), "x", keys, m=12, k=3, p=0.7)
    hat, w = reference(data, [*keys, "x"], 1, 12, 3, 0.7, False)
    assert np.allclose(tall.model.weights, w, atol=1e-8)
    got = {x.t: x.prediction for x in tall.predict(frame(spark, data)).collect()}
    assert all(np.isclose(got[t], sum(w[i] * data[q][t] for i, q in enumerate(keys))) for t in range(12))


def test_forecasts_at_once_are_single_forecasts(spark):
    r = np.random.RandomState(3)
    data = {"y": r.randn(60), "x": r.randn(60)}
    for past_only in (True, False):
        f = fit_svd(frame(spark, data), "x", ["y"], n=4, m=15, k=2, past_only=past_only)
        got = {x.t: x.forecast for x in f.forecast(frame(spark, data), 16).collect()}
        assert sorted(got) == list(range(3, 60))
        for t in (3, 16, 17, 40, 59):
            want = f.predict({"y": list(data["y"][: t + (not past_only)])}, list(data["x"][:t]))
            assert np.isclose(got[t], want)


def test_als(spark):
    r = np.random.RandomState(4)
    x = (r.rand(6, 2) + 0.5) @ (r.rand(2, 40) + 0.5)
    hidden = r.rand(6, 40) > 0.8
    cells = spark.createDataFrame([(i, j, None if hidden[i, j] else float(x[i, j])) for i in range(6) for j in range(40)], "row long, c long, value double")
    u, v, error, rounds = factor.als(cells, 2, 0.0, 12, 1e-12, seed=1)
    got = {(q.row, q.c): q.value for q in factor.reconstruct(u, v).collect()}
    assert rounds <= 12 and error < 1e-3
    assert np.sqrt(np.mean([(got[i, j] - x[i, j]) ** 2 for i in range(6) for j in range(40) if hidden[i, j]])) < 0.15
    flat = {"x": np.where(hidden, np.nan, x).T.ravel()}
    f = fit_als(frame(spark, flat), "x", n=6, m=40, k=2, iterations=8)
    clean = np.array([q.value for q in f.denoised().orderBy("t").collect()])
    assert clean.min() >= np.nanmin(flat["x"]) - 1e-9 and len(f.weights) == 5
    with pytest.raises(NotImplementedError, match="als"):
        f.update([1.0])
    f.release()
    u, v, error, _ = factor.als(cells, 2, 0.5, 5, -1.0, seed=1)  # with a penalty: each factor solves its normal equations
    left, right = ({q[0]: np.array(q.f) for q in w.collect()} for w in (u, v))
    for j in range(40):
        rows = [i for i in range(6) if not hidden[i, j]]
        m = np.array([left[i] for i in rows])
        assert np.allclose((m.T @ m + 0.5 * np.eye(2)) @ right[j], m.T @ x[rows, j])
    assert np.isclose(error, sum((left[i] @ right[j] - x[i, j]) ** 2 for i in range(6) for j in range(40) if not hidden[i, j]) / 240)


def test_arma_in_blocks_is_the_recurrence(spark):
    r = np.random.RandomState(11)
    e = {"a": r.randn(101), "b": r.randn(23), "c": r.randn(3)}
    for ar, ma, start, compat in (([0.4, 0.3, 0.2], [0.5, 0.1], None, True), ([0.5, -0.3], [0.2, 0.1, 0.3], [1.0, 2.0, 3.0], False), ([], [0.7], None, False), ([0.9], [], None, False)):
        got = {(x.series_key, x.t): x for x in generate.arma(frame(spark, e), ar, ma, start, compat, block=8).collect()}
        lag = 0 if compat else 1
        for key, err in e.items():
            n, q = len(err), len(ma)
            x, mean = np.zeros(n), np.zeros(n)
            if start:
                x[: min(q, n)] = start[: min(q, n)]
            for i in range(q, n - q if compat else n):
                mean[i] = sum(c * x[i - j - lag] for j, c in enumerate(ar) if i - j - lag >= 0 and j + lag > 0) + sum(c * err[i - j - lag] for j, c in enumerate(ma) if i - j - lag >= 0)
                x[i] = mean[i] + err[i]
            assert np.allclose([got[key, i].observation for i in range(n)], x) and np.allclose([got[key, i].mean for i in range(n)], mean)
        assert len(got) == 127


def test_gram_of_many_tasks(spark):
    a = np.random.RandomState(7).randn(130, 50)
    cols = spark.createDataFrame([(c, a[:, c].tolist()) for c in range(50)], "c long, x array<double>").repartition(7)
    assert np.allclose(factor.gram(cols, 130), a @ a.T)
    with pytest.raises(ValueError, match="shorter side"):
        factor.gram(cols, 10_000)


def test_updates():
    r = np.random.RandomState(6)
    a, d = r.randn(8, 20), r.randn(8, 3)
    u, s, v = np.linalg.svd(a, full_matrices=False)
    k = 4
    u1, s1, _ = factor.rank_k_update(u[:, :k], s[:k], d)
    low = (u[:, :k] * s[:k]) @ v[:k]
    uu, ss, _ = np.linalg.svd(np.hstack([low, d]), full_matrices=False)
    assert np.allclose(s1, ss[:k]) and np.allclose(u1 @ u1.T, uu[:, :k] @ uu[:, :k].T)
    assert np.allclose((u[:, :k] * s[:k]) @ factor.fold_in(u[:, :k], s[:k], d).T, u[:, :k] @ u[:, :k].T @ d)
    state = updates.start(a.T.ravel(), 8, k)
    assert len(state.weights()) == 7
    for method in ("folding-in", "UP"):
        nxt, clean = updates.update(state, d.T.ravel(), method)
        assert nxt.updates == 1 and np.allclose(clean, (nxt.u @ nxt.u.T @ d).T.ravel())
    for bad in ({"values": np.zeros(5)}, {"values": np.zeros(64)}, {"values": np.zeros(8), "method": "x"}):
        with pytest.raises(ValueError):
            updates.update(state, **bad)
    assert updates.fill_batch(np.array([np.nan, np.nan])).tolist() == [0, 0]


def test_operators(spark):
    x = {"a": np.array([np.nan, 1, np.nan, np.nan, 4, np.nan]), "b": np.full(6, np.nan)}
    got = {(q.series_key, q.t): q.value for q in fill.interpolate(frame(spark, x), 2).collect()}
    assert [got["a", t] for t in range(6)] == [1, 1, 2, 3, 4, 4] and got["b", 3] is None
    s = frame(spark, {"a": np.arange(12.0)})
    assert sorted(q.value for q in page.page_series(page.page_matrix(s, 3), 3).collect()) == list(range(12))
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)], "i long, j long, v double")
    assert {(q.i, q.j): q.v for q in matrix.dot(m, m, b_transpose=True).collect()} == {(0, 0): 5, (0, 1): 6, (1, 0): 6, (1, 1): 9}
    assert {q.v for q in matrix.subtract(m, m).collect()} == {0.0}
    for bad in (lambda: page.key_blocks(s, ["a", "a"]), lambda: page.check_shape(s, 5, 5, ["a"]), lambda: page.check_shape(s, 1, 1, ["q"]), lambda: factor.eigen(np.eye(2), 0), lambda: generate.generated(spark, None, 5), lambda: SyntheticControl.fit(s, "a", [], m=2, k=1, method="x"), lambda: page.combine_metrics([s], [1.0, 2.0], 3)):
        with pytest.raises(ValueError):
            bad()
    textbook = generate.arma(frame(spark, {"e": np.ones(6)}), [0.5], [], compat=False).orderBy("t").collect()
    assert np.allclose([q.observation for q in textbook], [1, 1.5, 1.75, 1.875, 1.9375, 1.96875])
    seg = Segmented.fit(frame(spark, {"x": np.sin(np.arange(130.0))}), "x", 130, rows=4, k=2, rect=2)
    assert seg.denoised().count() == 130 - 130 % 32  # the rest of 2 points is below gamma of a segment
    assert abs(seg.predict(list(np.sin(np.arange(127.0, 130.0)))) - np.sin(130)) < 0.05
