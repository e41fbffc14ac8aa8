"""Regressions for many keys, event responses, exact rank tests, smoothing and exact quantiles, against direct computation."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest

from cortexa.functions.distributions import rank_sum_tail, t_two_sided
from cortexa.operators import blocks, connectome as cm, glm, gradients as grad, labels as lab, stats, timeseries as ts, voxels
from cortexa.sources.shared import stored


def test_glm_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(y), float(a), float(b), "x") for k in range(6) for a, b in rng.normal(3, 1, (12, 2)) for y in [2 + a - 0.5 * b + rng.normal()]]
    rows += [(6, 1.0, 2.0, 4.0, "x"), (6, 2.0, 3.0, 6.0, "x"), (6, 4.0, 5.0, 10.0, "x"), (6, 4.5, 6.0, 12.0, "x"), (7, 1.0, 1.0, 1.0, "x"), (8, None, 1.0, 1.0, "x"), (0, 5.0, None, 1.0, "x"), (0, 5.0, math.nan, 1.0, "x")]
    df = spark.createDataFrame(rows, "key int, y double, a double, b double, contrast string").drop("contrast")
    contrasts = {"a": {"a": 1.0}, "a-b": {"a": 1.0, "b": -1.0}, "twice": {"a": 1.0, "b": 2.0}, "level": {"intercept": 1.0, "a": 3.0, "b": 3.0}}
    got = {(r.key, r.contrast): r for r in glm.mass_glm(df, ["key"], "y", ["a", "b"], contrasts).collect()}
    assert {k for k, _ in got} == {*range(8)}
    for k in range(6):
        data = np.array([r[1:4] for r in rows if r[0] == k and None not in r[:4] and not math.isnan(r[2])], float)
        x = np.column_stack([np.ones(len(data)), data[:, 1:]])
        beta, rss, *_ = np.linalg.lstsq(x, data[:, 0], rcond=None)
        for name, c in (("a", [0, 1, 0]), ("a-b", [0, 1, -1]), ("twice", [0, 1, 2]), ("level", [1, 3, 3])):
            c = np.array(c, float)
            se = math.sqrt(rss[0] / (len(data) - 3) * (c @ np.linalg.inv(x.T @ x) @ c))
            r = got[k, name]
            assert (r.df, r.effect, r.se, r.t) == pytest.approx((len(data) - 3, c @ beta, se, c @ beta / se))
            p = t_two_sided(np.array([r.t]), np.array([r.df]))[0]
            assert (r.p, r.z) == pytest.approx((p, math.copysign(NormalDist().inv_cdf(1 - p / 2), r.t)), abs=1e-6)
    assert got[6, "a"].effect is None and got[6, "a-b"].t is None  # b is twice a: only a + 2 b can be told
    assert got[6, "twice"].effect == pytest.approx(np.polyfit([2, 3, 5, 6], [1, 2, 4, 4.5], 1)[0]) and got[6, "twice"].df == 2
    assert all(got[7, c].se is None for c in contrasts)
    with pytest.raises(ValueError):
        glm.mass_glm(df, ["key"], "y", ["a"], {"c": {"q": 1.0}})


def test_thresholds_over_all_keys(spark):
    p = [0.001, 0.004, 0.02, 0.03, 0.2, 0.9, None]
    df = spark.createDataFrame([(k, c, x, 3.0) for c in "uv" for k, x in enumerate(p)], "key int, contrast string, p double, z double")
    kept = lambda control: sorted(r.key for r in glm.thresholded(df, 0.05, control).where("contrast = 'u' and z_kept <> 0").collect())
    assert (kept("fpr"), kept("fdr"), kept("bonferroni")) == ([0, 1, 2, 3], [0, 1, 2, 3], [0, 1])


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (1, 5), (3, 4), (5, 5), (2, 9), (8, 4)])
def test_exact_rank_sums_by_enumeration(n1, n2):
    us = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    want = [sum(u >= k for u in us) / len(us) for k in range(n1 * n2 + 1)]
    assert rank_sum_tail(n1, n2) == pytest.approx(want, abs=1e-12)


def test_exact_p_where_no_values_are_tied(spark):
    rng = random.Random(2)
    rows = [("few", g, rng.random() + (g == "a") * 0.4) for g in "aaaabbbbbb"] + [("tied", g, float(k % 4)) for k, g in enumerate("aaaabbbb")] + [("one", "a", 1.0)] + [("many", g, rng.random()) for g in "ab" * 12]
    got = {r.key: r for r in stats.mann_whitney(spark.createDataFrame(rows, "key string, grp string, v double"), ["key"], "grp", "v", "a", "b").collect()}
    few = [v for k, *v in rows if k == "few"]
    ranks = sorted(v for _, v in few)
    u = sum(ranks.index(v) + 1 for g, v in few if g == "a") - 10
    us = [sum(c) - 10 for c in itertools.combinations(range(1, 11), 4)]
    assert got["few"].u_a == u and got["few"].p == pytest.approx(min(1, 2 * sum(x >= max(u, 24 - u) for x in us) / len(us)))
    for k in ("tied", "many"):
        assert got[k].p == pytest.approx(min(1, 2 * (1 - NormalDist().cdf(abs(got[k].z)))) if got[k].z > 0 else 1.0, abs=1e-9)
    assert got["one"].p is None


def h(t, d=1.0):
    a = 6 / d
    return (t / d) ** (a - 1) * math.exp(-t / d) / math.gamma(a) / d - t**15 * math.exp(-t) / math.gamma(16) / 6 if 0 < t <= 32 else 0.0


@pytest.mark.parametrize("duration", [False, True])
def test_responses_summed_at_their_lags(spark, duration):
    events = [("r1", "a", 3.1, 0.0, 2.0), ("r1", "a", 10.4, 3.0, 4.0), ("r1", "b", 12.0, None, None), ("r2", "a", 190.0, 1.0, 1.0), ("r2", "a", -3.0, 1.0, 5.0), ("r2", "b", None, 1.0, 5.0)]
    df = spark.createDataFrame([(*e, "x") for e in events], "run string, kind string, onset double, duration double, m double, frame string").drop("frame")
    tr, n, over = 2.0, 96, 5
    got = ts.response_columns(df, ["run"], "kind", "onset", tr, n, "duration" if duration else None, "m", over).collect()
    want = {}
    means = {("r1", "a"): 3.0, ("r2", "a"): 3.0}
    for run, kind, onset, length, m in events:
        if onset is None:
            continue
        step, first = tr / over, round(onset / (tr / over))
        points = max(1, math.floor(length / step + 0.5)) if duration and length else 1
        weight = step if duration and length else 1.0
        m = m - means[run, kind] if m is not None else 0.0
        for at in (first + k for k in range(points)):
            for f in range(n):
                lag = (f + 0.5) * tr - at * step
                if 0 <= lag <= 32.1:
                    cell = want.setdefault((run, kind, f), [0.0] * 4)
                    for k, x in enumerate((h(lag), (h(lag) - h(lag - 0.1)) / 0.1, (h(lag) - h(lag, 1.01)) / 0.01, h(lag) * m)):
                        cell[k] += x * weight
    assert {(r.run, r.kind, r.frame) for r in got} == set(want)
    for r in got:
        assert (r.response, r.derivative, r.dispersion, r.response_mod) == pytest.approx(want[r.run, r.kind, r.frame], abs=1e-9)
    wide = ts.filled_design(ts.orthogonalised(spark.createDataFrame(got), ["run", "kind"], "response_mod", "response"), ["run"], "kind", ["a", "b"], ["response", "response_mod"], n, scale=True)
    table = wide.toPandas()
    assert len(table) == 2 * n and list(table.columns) == ["run", "frame", "a_response", "a_response_mod", "b_response", "b_response_mod"]
    assert table.groupby("run")["a_response"].max().tolist() == [1.0, 1.0]
    one = table[table.run == "r1"]
    assert abs((one.a_response * one.a_response_mod).sum()) < 1e-9


@pytest.mark.parametrize("edge", [4, 32])
def test_smoothing_is_the_direct_sum(spark, edge):
    rng = random.Random(3)
    grid = {(x, y, z): rng.random() for x in range(-3, 7) for y in range(6) for z in range(5) if rng.random() < 0.8}
    gone = min(grid)
    rows = [(*at, None if at == gone else v, "x") for at, v in grid.items()]
    df = spark.createDataFrame(rows, "x int, y int, z int, v double, w string")
    got = {(r.x, r.y, r.z): r.v for r in voxels.smoothed(df, ["v"], 0.8, edge=edge).collect()}
    assert set(got) == set(grid)
    for at in grid:
        near = [(math.exp(-sum((a - b) ** 2 for a, b in zip(at, o, strict=True)) / 2 / 0.64), v) for o, v in grid.items() if o != gone and all(abs(a - b) <= 3 for a, b in zip(at, o, strict=True))]
        assert got[at] == pytest.approx(sum(w * v for w, v in near) / sum(w for w, _ in near))


def test_noisy_voxels_stand_out(spark):
    rows = [(x, y, z, 10.0 if (x, y, z) != (4, 4, 4) else 0.0, 1.0) for x in range(9) for y in range(9) for z in range(9)]
    got = voxels.noisy_voxels(spark.createDataFrame(rows, "x int, y int, z int, mean double, sd double"), 0.85).where("noisy").collect()
    assert [(r.x, r.y, r.z) for r in got] == [(4, 4, 4)] and got[0].cov == pytest.approx(1e6)


@pytest.mark.parametrize("share", [0.0, 0.31, 0.9, 1.0])
def test_quantiles_with_ties_and_narrowed_brackets(spark, share):
    rng = np.random.default_rng(4)
    values = {"ties": np.where(rng.random(6000) < 0.9, 0.5, rng.normal(size=6000)), "many": rng.normal(size=30_000), "one": np.array([3.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("many", None), ("many", math.nan), ("none", None)]
    df = stored(spark.createDataFrame(rows, "key string, w double"))
    got = {r.key: r["__limit"] for r in cm.exact_quantile(df, share, ["key"], ordered=500).collect()}
    assert got == {k: pytest.approx(np.quantile(x, share), abs=1e-12) for k, x in values.items()}
    many = df.where("key = 'many'")
    assert cm.exact_quantile(many, share, [], ordered=500).first()[0] == pytest.approx(np.quantile(values["many"], share), abs=1e-12)


def test_templates_in_tasks_and_by_joins_agree(spark):
    rng = random.Random(5)
    maps = spark.createDataFrame([(n, t, rng.random()) for n in range(20) for t in range(30) if rng.random() < 0.9] + [(3, 5, None), (99, 1000, 1.0)], "node long, target long, w double")
    templates = spark.createDataFrame([(k, t, rng.random()) for k in range(4) for t in range(30) if rng.random() < 0.8], "template int, target long, w double")
    rows = lambda held: sorted((r.node, r.template, round(r.eta2, 9)) for r in lab.eta_squared(maps, templates, 0.1, (2,), held).collect())
    assert rows(10**6) == rows(0) and len(rows(0)) == 60


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 25])
def test_products_of_tiles(spark, broadcast_bytes):
    rng = np.random.default_rng(6)
    n, k = 23, 3
    dense = np.where(rng.random((n, n)) < 0.3, rng.normal(size=(n, n)), 0)
    edges = spark.createDataFrame([(int(i) * 10, int(j) * 10, float(dense[i, j])) for i, j in zip(*np.nonzero(dense), strict=True)], "i long, j long, w double")
    places = blocks.placed(spark.createDataFrame([(i * 10,) for i in range(n)], "node long"), side=6)
    matrix = blocks.SparseBlocks(spark, edges, places, buckets=3)
    x = rng.normal(size=(n, k))
    rows = places.join(spark.createDataFrame([(i * 10, x[i].tolist()) for i in range(n)], "node long, x array<double>"), "node")
    product = matrix.times(stored(blocks.packed(rows, matrix.side, k)), k, broadcast_bytes)
    got = {r.node: r.v for r in blocks.unpacked(product, places, k).collect()}
    for i in range(n):
        assert got.get(i * 10, [0.0] * k) == pytest.approx((dense @ x)[i].tolist(), abs=1e-9)
    plan = product._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (broadcast_bytes > 0, broadcast_bytes == 0)
    assert plan.count("Exchange hashpartitioning") == (1 if broadcast_bytes else 2)  # of the sums, and of the vectors: tiles stay where they are
    matrix.close()


def test_gradients_of_the_table_match_numpy(spark):
    from checks import DATA

    from cortexa.plans import tables

    weights = stored(grad.affinity(cm.correlation_edges(tables.series(spark, DATA))))
    got = {r.node: r.g for r in grad.diffusion_gradients(weights, 3).collect()}
    nodes = sorted(got)
    at = {n: k for k, n in enumerate(nodes)}
    a = np.zeros((len(nodes),) * 2)
    for r in weights.collect():
        a[at[r.i], at[r.j]] = r.w
    d = a.sum(axis=1)
    a = a / np.sqrt(np.outer(d, d))
    d = a.sum(axis=1)
    values, axes = np.linalg.eigh(a / np.sqrt(np.outer(d, d)))
    for c in range(3):
        want = axes[:, -2 - c] / np.sqrt(d)
        r = np.corrcoef(want, [got[n][c] for n in nodes])[0, 1]
        assert abs(r) > 0.999


def test_confound_regression_matches_numpy(spark):
    """The whole query, with the confounds made and the fits solved by numpy."""
    from checks import DATA

    from cortexa.plans import registry

    vectors = {r.vec_id: np.array(r.embedding, np.float32).astype(float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    t = np.arange(64)
    keep = t % 9 != 4
    want = {}
    for run in range(4):
        base = np.array([np.mean([x for n, x in vectors.items() if n % 4 == run and n % 9 == c], axis=0) for c in range(9)])
        change = np.diff(base, axis=1, prepend=base[:, :1])
        for whole, m in ((True, 9), (False, 8)):
            made = np.concatenate([base[:m], change[:m], base[:m] ** 2, change[:m] ** 2])
            x = np.column_stack([np.ones(64), np.linspace(-1, 1, 64), made.T])
            for n, y in vectors.items():
                if n % 4 == run:
                    beta, *_ = np.linalg.lstsq(x[keep], y[keep], rcond=None)
                    want[run, n, whole] = np.sum((y - x @ beta) ** 2)
    got = {(r.run, r.node, r.with_global): r.energy for r in registry.QUERIES["confound_regression"](spark, DATA).collect()}
    assert set(got) == set(want)
    assert all(v == pytest.approx(want[k], abs=1e-5) for k, v in got.items())


def test_a_single_tile_is_applied_many_times(spark):
    rng = np.random.default_rng(7)
    dense, x = rng.normal(size=(5, 5)) / 3, rng.normal(size=(5, 2))
    edges = spark.createDataFrame([(i, j, float(dense[i, j])) for i in range(5) for j in range(5)], "i long, j long, w double")
    places = blocks.placed(spark.createDataFrame([(i,) for i in range(5)], "node long"), side=8)
    matrix = blocks.SparseBlocks(spark, edges, places)
    rows = places.join(spark.createDataFrame([(i, x[i].tolist()) for i in range(5)], "node long, x array<double>"), "node")
    got = {r.node: r.v for r in blocks.unpacked(matrix.times(blocks.packed(rows, matrix.side, 2), 2, power=4), places, 2).collect()}
    want = np.linalg.matrix_power(dense, 4) @ x
    assert all(got[i] == pytest.approx(want[i].tolist()) for i in range(5))
    matrix.close()


def test_frames_of_responses_are_not_shuffled(spark):
    """Events are dealt by run and kind, and their frames summed there; orthogonal columns come of the same pass."""
    df = spark.createDataFrame([(r, "ab"[k % 2], 7.0 * k, 1.5, float(k % 5)) for r in range(3) for k in range(20)], "run long, kind string, onset double, duration double, m double")
    out = ts.orthogonalised(ts.response_columns(df, ["run"], "kind", "onset", 2.0, 100, "duration", "m", 5), ["run", "kind"], "response_mod", "response")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def _dense_gradients(a, components):
    d = a.sum(axis=1)
    a = a / np.sqrt(np.outer(d, d))
    d = a.sum(axis=1)
    values, axes = np.linalg.eigh(a / np.sqrt(np.outer(d, d)))
    return [(axes[:, k] / np.sqrt(d) * abs(values[k]) / (1 - abs(values[k]))) for k in np.argsort(-np.abs(values))[1 : components + 1]]


@pytest.mark.parametrize("broadcast_bytes", [8 * 500 * 20])
def test_gradients_of_series_make_no_table_of_edges(spark, monkeypatch, broadcast_bytes):
    from checks import DATA

    from cortexa.operators import pairs
    from cortexa.plans import tables

    series = tables.series(spark, DATA)
    monkeypatch.setattr(pairs, "LEAST", 128)
    weights = grad.affinity(cm.correlation_edges(series)).collect()
    for module in (cm, grad):
        monkeypatch.setattr(module, "both_ways", None)
    got = {r.node: r.g for r in grad.gradients_of(series, 3, tolerance=1e-3, held=4, broadcast_bytes=broadcast_bytes).collect()}
    nodes = sorted(got)
    assert len(nodes) == 500
    a = np.zeros((500, 500))
    for r in weights:
        a[nodes.index(r.i), nodes.index(r.j)] = r.w
    for c, want in enumerate(_dense_gradients(a, 3)):
        g = np.array([got[n][c] for n in nodes])
        assert abs(np.corrcoef(g, want)[0, 1]) > 0.9999
        assert np.linalg.norm(g) / np.linalg.norm(want) == pytest.approx(1, abs=1e-3) and (g**3).sum() >= 0
