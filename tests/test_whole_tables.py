"""Queries without SQL cover their whole table and agree with plain numpy."""

import numpy as np
import pytest

from seriesloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def longer(spark, tmp_path_factory):
    """A table of 3,280 events over 41 days, and embeddings of 64 values."""
    at, r = str(tmp_path_factory.mktemp("longer")), np.random.RandomState(9)
    x = np.sin(np.arange(3280) / 7) * 20 + 50 + r.randn(3280)
    rows = [(t, int(t // 80), catalog.TYPES[t % 5], float(v)) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "event_id long, day long, event_type string, value double")
    df.selectExpr("event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(day as int)) AS ts", "event_type", "value").write.parquet(f"{at}/events.parquet")
    return at, x


def rank(a, k):
    u, s, v = np.linalg.svd(a, full_matrices=False)
    return (u[:, :k] * s[:k]) @ v[:k]


def lcg(t):
    return ((t * 1103515245 + 12345) % 2147483648) / 2147483648.0


def test_segmented_forecaster_covers_all_events(spark, longer):
    at, x = longer
    got = {r.t: r.value for r in catalog.QUERIES["segmented_forecaster"](spark, at).collect()}
    want = np.concatenate([rank(x[a : a + 400].reshape(-1, 10).T, 2).T.ravel() for a in range(0, 3200, 400)])
    assert sorted(got) == list(range(3200)) and np.allclose([got[t] for t in range(3200)], want)


def test_segments_overlap_at_the_end(spark):
    r = np.random.RandomState(1)
    x = r.randn(1003)
    x[17] = np.nan
    df = spark.createDataFrame([("x", t, None if np.isnan(v) else float(v)) for t, v in enumerate(x)], "series_key string, t long, value double")
    seg = catalog.models.Segmented.fit(df, "x", 1003, rows=10, k=2, rect=4)
    got = {q.t: q.value for q in seg.denoised().collect()}
    x[17] = (np.nanmin(x[:400]) + np.nanmax(x[:400])) / 2
    parts = [rank(x[a : a + 400].reshape(-1, 10).T, 2).T.ravel() for a in (0, 400, 603)]
    want = np.concatenate([parts[0], parts[1][:203], parts[2]])
    assert sorted(got) == list(range(1003)) and np.allclose([got[t] for t in range(1003)], want)
    single = catalog.models.fit_svd(df.where("t >= 400 and t < 800"), "x", n=10, m=40, k=2)
    assert np.allclose(seg.models[1].weights, single.weights) and np.allclose(seg.models[1].s, single.s)


def test_segments_built_by_updates_are_those_of_one_fit(spark):
    x = np.random.RandomState(2).randn(1003)
    df = spark.createDataFrame([("x", t, float(v)) for t, v in enumerate(x)], "series_key string, t long, value double")
    shape = dict(rows=10, k=2, rect=4, least=100)
    seg = catalog.models.Segmented.begin("x", **shape)
    assert seg.update(df.where("t < 99"), 99) is seg and not seg.models
    with pytest.raises(ValueError):
        seg.denoised()
    counts = []
    for points in (150, 160, 420, 640, 1003):
        before, seg = seg, seg.update(df.where(f"t < {points}"), points)
        counts.append((seg is before, seg.built, len(seg.models)))
    # 160 is too little more; 420 gives a whole segment and a rest that waits; 640 an overlapping one, which goes at 1003
    assert counts == [(False, 1, 1), (True, 1, 1), (False, 2, 1), (False, 3, 2), (False, 5, 3)]
    whole = catalog.models.Segmented.fit(df, "x", 1003, **shape)
    assert seg.starts == whole.starts == (0, 400, 603) and whole.built == 3
    for a, b in zip(seg.models, whole.models, strict=True):
        assert np.allclose(a.weights, b.weights) and np.allclose(a.s, b.s)
    a, b = ({r.t: r.value for r in m.denoised().collect()} for m in (seg, whole))
    assert sorted(a) == list(range(1003)) and np.allclose([a[t] for t in range(1003)], [b[t] for t in range(1003)])
    assert np.isclose(seg.predict(list(x[-9:]), 3), whole.predict(list(x[-9:]), 3))
    with pytest.raises(ValueError):
        seg.update(df, 1000)
    seg.release()


def test_updates_read_new_stretches_only(spark):
    df = spark.createDataFrame([("x", t, float(np.sin(t))) for t in range(800)], "series_key string, t long, value double")
    seg = catalog.models.Segmented.fit(df, "x", 400, rows=10, k=2, rect=4)
    later = seg.update(df.where("t >= 400"), 800)
    assert later.models[0] is seg.models[0] and later.denoised().count() == 800


def test_svd_page_50_covers_all_events(spark, longer):
    at, x = longer
    got = {r.t: r.value for r in catalog.QUERIES["svd_page_50"](spark, at).collect()}
    seen = np.where(lcg(np.arange(3280)) <= 0.7, x, np.nan)
    a = np.where(np.isnan(seen), (np.nanmin(seen) + np.nanmax(seen)) / 2, seen).reshape(-1, 20).T
    assert sorted(got) == list(range(3280)) and np.allclose([got[t] for t in range(3280)], (rank(a, 5) / 0.7).T.ravel())


def test_als_forecaster_covers_all_days(spark, longer):
    at, x = longer
    rows = catalog.QUERIES["als_forecaster"](spark, at).collect()
    assert {(r.series_key, r.t) for r in rows} == {(k, t) for k in ("click", "purchase") for t in range(40)}
    day = {k: np.array([x[d * 80 : (d + 1) * 80][i::5].mean() for d in range(1, 41)]) for i, k in enumerate(catalog.TYPES)}
    assert all(abs(r.value - day[r.series_key][r.t]) < 8 for r in rows)


def test_start_from_a_gram_matrix():
    r = np.random.RandomState(3)
    a = r.randn(6, 50)
    x, y = catalog.updates.start(a.T.ravel(), 6, 3), catalog.updates.start_gram(a @ a.T, 300, 3)
    assert np.allclose(x.s, y.s) and np.allclose(x.u @ x.u.T, y.u @ y.u.T) and np.allclose(x.weights(), y.weights()) and y.points == 300


def test_updates_take_all_later_events(spark, longer):
    at, x = longer
    a = x.reshape(-1, 2).T
    cut = 3280 * 7 // 20
    u = np.linalg.svd(a[:, :cut], full_matrices=False)[0][:, :1]
    got = {r.t: r.value for r in catalog.QUERIES["fold_in"](spark, at).collect()}
    assert sorted(got) == list(range(2 * cut, 3280)) and np.allclose([got[t] for t in sorted(got)], (u @ u.T @ a[:, cut:]).T.ravel(), atol=1e-5)
    s = np.linalg.svd(a[:, :cut], full_matrices=False)[1][:1]
    for c in range(cut, a.shape[1]):
        u, s, _ = np.linalg.svd(np.hstack([u * s, a[:, c : c + 1]]), full_matrices=False)
        u, s = u[:, :1], s[:1]
    (r,) = catalog.QUERIES["rank_k_update"](spark, at).collect()
    assert r.points == 3280 and np.isclose(r.s, s[0], atol=1e-4)


def test_stream_takes_all_later_events(spark, longer, monkeypatch):
    at, x = longer
    monkeypatch.setattr(catalog, "_FILE", 400)
    monkeypatch.setattr(catalog, "_FLUSH", 200)
    got = {r.t: r.value for r in catalog.QUERIES["stream_updates"](spark, at).collect()}
    a, c, want = x.reshape(-1, 10).T, 3280 * 7 // 100, []
    u, s, _ = np.linalg.svd(a[:, :c], full_matrices=False)
    u, s = u[:, :3], s[:3]
    ends = [min(c + k, 328) for k in range(40, 140, 40)]
    while c < 328:
        step = min(9, next(q for q in ends if q > c) - c)
        u, s, _ = np.linalg.svd(np.hstack([u * s, a[:, c : c + step]]), full_matrices=False)
        u, s = u[:, :3], s[:3]
        want += (u @ u.T @ a[:, c : c + step]).T.ravel().tolist()
        c += step
    assert sorted(got) == list(range(2290, 3280)) and np.allclose([got[t] for t in sorted(got)], want)


def test_every_batch_is_filled(spark, longer):
    at, x = longer
    got = {r.t: r.value for r in catalog.QUERIES["batch_fill"](spark, at).collect()}
    seen = np.where(lcg(np.arange(3280)) <= 0.7, x, np.nan)
    want = np.concatenate([np.where(np.isnan(b), (np.nanmin(b) + np.nanmax(b)) / 2, b) for b in np.split(seen, range(200, 3280, 200))])
    assert sorted(got) == list(range(3280)) and np.allclose([got[t] for t in range(3280)], want, atol=1e-6)


def test_products_take_all_vectors_and_values(spark, tmp_path):
    a = np.random.RandomState(8).randn(70, 64).astype(np.float32)
    label = np.arange(70) % 7
    spark.createDataFrame([(i, x.tolist(), int(label[i])) for i, x in enumerate(a)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    a = a.astype(float)
    lab = np.zeros((70, 64))
    lab[np.arange(70), label] = 1
    g = a.T @ a
    want = {"mat_add": 2 * a, "mat_subtract": a - lab, "mat_transpose": a.T, "mat_dot": a @ a.T / 2, "mat_dot_at": a.T @ lab[:, :7], "mat_dot_bt": a @ a.T, "mat_dot_atbt": g @ a.T, "gram_rows": g, "gram_blocks": g, "matrix_write_read_copy": a}
    for name, m in want.items():
        rows = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        got = np.full(m.shape, np.nan)
        for i, j, v in rows:
            got[i, j] = v
        assert len(rows) == m.size and np.allclose(got, m, atol=1e-4), name


def stream_case(spark, tmp_path, parts):
    """Files of a stream, in order; each part is a list of (t, value)."""
    for k, part in enumerate(parts):
        spark.createDataFrame([("x", t, float(v)) for t, v in part], "series_key string, t long, value double").coalesce(1).write.parquet(f"{tmp_path}/in{k}")


def test_stream_state_survives_a_restart(spark, tmp_path):
    import shutil

    from seriesloom.streaming import updates

    r = np.random.RandomState(12)
    x = np.sin(np.arange(200) / 5) + r.randn(200) * 0.1
    first = updates.start(x[:100], 5, 2)
    late = [(t, x[t]) for t in range(100, 131) if t != 117]
    stream_case(spark, tmp_path, [late, [(t, x[t]) for t in range(131, 160)] + [(90, 9.0), (130, 9.0)], [(117, x[117])] + [(t, x[t]) for t in range(160, 200)]])
    (tmp_path / "in").mkdir()
    seen, got = {}, {}

    def run(files):
        states = {"x": first}
        q = updates.run_updates(updates.series_stream(spark, str(tmp_path / "in")), states, lambda k, t, s, v: seen.update({t + i: w for i, w in enumerate(v)}), str(tmp_path / "log"), "UP")
        for k in files:
            for f in sorted((tmp_path / f"in{k}").glob("*.parquet")):
                shutil.copy(f, tmp_path / "in" / f"{k}-{f.name}")
            q.processAllAvailable()
        q.stop()
        got.update(states)

    run([0])
    assert got["x"].points == 115 and max(seen) == 114  # what comes after the missing point waits
    run([1])  # a new query, which starts from the first state
    assert got["x"].points == 115
    run([2])
    want = first
    for a in (100, 115):  # whole columns, n - 1 at most at a time, as they could be applied
        end = {100: 115, 115: 200}[a]
        while want.points < end:
            take = min((end - want.points) // 5, 4) * 5
            want, _ = updates.update(want, x[want.points : want.points + take], "UP")
    assert got["x"].points == 200 and got["x"].updates == want.updates
    assert np.allclose(got["x"].s, want.s) and np.allclose(got["x"].weights(), want.weights()) and sorted(seen) == list(range(100, 200))


def test_waiting_points_are_bounded(spark, tmp_path):
    from seriesloom.streaming import updates

    stream_case(spark, tmp_path, [[(t, 1.0) for t in range(11, 40)]])
    q = updates.run_updates(updates.series_stream(spark, f"{tmp_path}/in0"), {"x": updates.start(np.arange(10.0), 5, 2)}, lambda *_: None, f"{tmp_path}/log", most_waiting=20)
    with pytest.raises(Exception, match="wait for point 10"):
        q.processAllAvailable()


def test_control_by_als_covers_all_days(spark, longer):
    at, x = longer
    got = {(r.metric, r.t): r.prediction for r in catalog.QUERIES["control_als"](spark, at).collect()}
    assert set(got) == {(-1, t) for t in range(41)} | {(k, t) for k in (0, 1) for t in range(41)}
    day = np.array([x[d * 80 : (d + 1) * 80][2::5].mean() for d in range(41)])
    assert np.sqrt(np.mean([(got[-1, t] - day[t]) ** 2 for t in range(41)])) < 4
    assert np.sqrt(np.mean([(got[0, t] / np.sqrt(2) - day[t]) ** 2 for t in range(41)])) < 4
    assert np.allclose([got[1, t] / np.sqrt(0.5) for t in range(41)], 16, atol=1)


def test_svd_of_several_series_against_numpy(spark, longer):
    at, x = longer
    got = {(r.series_key, r.t): r.value for r in catalog.QUERIES["svd_multi_series"](spark, at).collect()}
    keys = ["click", "view", "signup", "purchase"]
    day = {k: np.array([x[d * 80 : (d + 1) * 80][i::5].mean() for d in range(41)]) for i, k in enumerate(catalog.TYPES)}
    a = np.vstack([day[k][-30:].reshape(6, 5).T for k in keys])
    low = rank(a, 3)
    want = {(k, c * 5 + i): low[b * 5 + i, c] for b, k in enumerate(keys) for i in range(5) for c in range(6)}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_products_by_blocks_are_those_of_the_join(spark, monkeypatch):
    """Absent, NULL, infinite and repeated cells, a NULL key, names as keys, and more blocks than one on each side."""
    from seriesloom.operators import matrix

    monkeypatch.setattr(matrix, "LEAST", 8)
    r = np.random.RandomState(3)
    cells = [(i, int(k), float(r.randn())) for i in range(40) for k in range(6) if r.rand() < 0.5]
    a = spark.createDataFrame([*cells, (1, 0, None), (2, 3, None), (2, 3, 4.0), (7, 5, float("inf")), (90, 1, None), (None, 2, 1.5)], "i long, j int, v double")
    b = spark.createDataFrame([(k, f"n{j}", float(r.randn())) for j in range(30) for k in range(8) if (j + k) % 3], "i long, j string, v double")
    canon = lambda df: {(q.i, q.j): None if q.v is None else round(q.v, 9) for q in df.collect()}
    for left, right, how in ((a, b, {}), (a, a, {"b_transpose": True}), (b, b, {"a_transpose": True})):
        want, got = (canon(matrix.dot(left, right, 0.5, **how, **more)) for more in ({}, {"inner": 8}))
        assert got == want or {k for k in want if repr(got.get(k)) != repr(want[k])} | (got.keys() ^ want.keys()) == set()
    rows = [(i, 0, float(v)) for i, v in enumerate([0.0000005, -0.0000005, -1e-9, 2.5e-6, 1234567.1234565])]
    one = spark.createDataFrame([(0, 0, 1.0)], "i long, j long, v double")
    got = {q.i: repr(q.v) for q in matrix.dot(spark.createDataFrame(rows, "i long, j long, v double"), one, inner=1, digits=6).collect()}
    assert got == {0: "1e-06", 1: "-1e-06", 2: "0.0", 3: "3e-06", 4: "1234567.123457"}


@pytest.mark.parametrize("name", ["mat_dot", "mat_dot_bt"])
def test_no_row_is_made_for_a_product_of_cells(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_sub_models_stay_on_the_executors(spark):
    """The driver makes nothing for each sub-model until one is asked for, however many there are."""
    made = []
    real = catalog.models.Forecaster

    class Counted(real):
        def __init__(self, *args, **options):
            made.append(1)
            super().__init__(*args, **options)

    x = np.random.RandomState(5).randn(1630)
    df = spark.createDataFrame([("x", t, float(v)) for t, v in enumerate(x)], "series_key string, t long, value double")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(catalog.models, "Forecaster", Counted)
        seg = catalog.models.Segmented.begin("x", rows=2, k=1, rect=2, gamma=0.5).update(df.where("t < 1000"), 1000).update(df, 1630)
        got = {r.t: r.value for r in seg.denoised().collect()}
        assert not made and len(seg.models) == seg.built == 204 and seg.starts[-2:] == (1616, 1622)
        assert np.allclose(seg.models[-1].s, rank_s(x[1622:])) and np.allclose(seg.models[7].s, rank_s(x[56:64])) and len(made) == 2
        assert [len(seg.models[-3:]), len(list(seg.models))] == [3, 204]
    want = np.concatenate([*(rank(x[a : a + 8].reshape(-1, 2).T, 1).T.ravel() for a in range(0, 1624, 8))])
    want = np.concatenate([want[:1622], rank(x[1622:].reshape(-1, 2).T, 1).T.ravel()])
    assert sorted(got) == list(range(1630)) and np.allclose([got[t] for t in range(1630)], want)


def rank_s(x):
    return np.linalg.svd(x.reshape(-1, 2).T)[1][:1]


def test_segmented_forecaster_makes_no_sub_model_on_the_driver(spark, longer, monkeypatch):
    at, x = longer
    monkeypatch.setattr(catalog.models, "Forecaster", None)
    assert catalog.QUERIES["segmented_forecaster"](spark, at).count() == 3200


def test_columns_in_turn_are_updates_one_by_one(spark, longer, monkeypatch):
    from seriesloom.streaming import updates

    r = np.random.RandomState(4)
    for n, k in ((2, 1), (5, 1), (5, 2)):
        for new in (r.randn(300, n) * 9 + 5, r.randn(40, n), np.zeros((3, n)), np.where(r.rand(60, n) < 0.3, np.nan, 50 * r.randn(60, n))):
            state = want = updates.start(r.randn(20 * n), n, k)
            for x in new:
                want, _ = updates.update(want, x, "UP")
            got = updates.update_each(state, new)
            assert np.allclose(got.s, want.s) and np.allclose(got.u @ got.u.T, want.u @ want.u.T) and np.allclose(got.sw, want.sw)
            assert np.allclose(got.weights(), want.weights()) and (got.points, got.updates) == (want.points, want.updates)
    at, x = longer
    a, cut, calls = x.reshape(-1, 2).T, 3280 * 7 // 20, []
    monkeypatch.setattr(catalog, "_TURN", 100)
    monkeypatch.setattr(updates, "rank_k_update", lambda *_: calls.append(1))
    (got,) = catalog.QUERIES["rank_k_update"](spark, at).collect()
    s, u = np.linalg.svd(a[:, :cut])[1][:1], np.linalg.svd(a[:, :cut])[0][:, :1]
    for c in range(cut, a.shape[1]):
        u, s, _ = np.linalg.svd(np.hstack([u * s, a[:, c : c + 1]]), full_matrices=False)
        u, s = u[:, :1], s[:1]
    assert not calls and got.points == 3280 and np.isclose(got.s, s[0], atol=1e-4)
