"""Small fixtures with results worked out by hand or in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexa.functions import distributions, scalar
from cortexa.operators import aggregates as agg, connectome as cm, gradients as grad, graph, labels as lab, stats, timeseries as ts, windows as win

CM = [(0, 1, 0.1), (0, 2, 0.5), (0, 3, -0.3), (1, 2, 0.9), (1, 3, 0.2), (2, 3, 0.4)]


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, w double")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_proportional_threshold(spark):
    assert rows(cm.proportional_threshold(edges_of(spark, CM), 0.5)) == [(0, 2, 0.5), (1, 2, 0.9), (2, 3, 0.4)]


def test_density_threshold(spark):
    assert [r[:2] for r in rows(cm.density_threshold(edges_of(spark, CM), 1 / 3, 4))] == [(0, 2), (1, 2)]


def test_participation(spark):
    edges = edges_of(spark, [(0, 1, 1.0), (0, 2, 1.0), (2, 3, 2.0)])
    modules = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2), (4, 1)], "node long, module int")
    got = {r.node: round(r.participation, 6) for r in cm.participation(edges, modules).collect()}
    assert got == {0: 0.5, 1: 0.0, 2: 0.444444, 3: 0.0, 4: 0.0}


def test_jaccard(spark):
    subject = spark.createDataFrame(list(enumerate([1, 1, 1, 2, 2, 3, 3, -1])), "node long, module int")
    target = spark.createDataFrame(list(enumerate([5, 5, 6, 6, 6, 0, 7, 5])), "node long, label int")
    got = {r.module: (r.network, round(r.jaccard, 4)) for r in lab.jaccard_assignment(subject, target).collect()}
    assert got == {1: (5, 0.5), 2: (6, 0.6667), 3: (7, 0.5)}
    assert {r.module: r.network for r in lab.greedy_assignment(subject, target, [6, 5, 7]).collect()} == {2: 6, 1: 5, 3: 7}


def test_votes(spark):
    votes = spark.createDataFrame([("a", v) for v in (3, 3, 2, 2, 0, 0, 0)] + [("b", 0)], "k string, label int")
    assert rows(agg.plurality(votes, ["k"], "label"), "k", "winner") == [("a", 2), ("b", 0)]
    labels = [("a", 0.1, 0), ("a", 0.2, 4), ("a", 0.3, 5), ("b", 0.1, 7), ("b", 0.2, 0), ("c", 0.1, 0)]
    got = agg.consensus(spark.createDataFrame(labels, "k string, t double, label int"), ["k"], "label", "t")
    assert rows(got.where("consensus is not null")) == [("a", 4), ("b", 7)]
    small = spark.createDataFrame([(m,) for m in (1, 1, 1, 2, 2)], "module int")
    assert sorted(r[0] for r in agg.suppress_small(small, [], "module", 3).collect()) == [0, 0, 1, 1, 1]


TWO = [("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (2, 4, 6, 8)]


def test_two_samples(spark):
    df = spark.createDataFrame(TWO, "g string, v double")
    welch = stats.t_test(df, [], "g", "v", "a", "b").first()
    assert (round(welch.t, 6), round(welch.df, 6)) == (-1.358732, 4.749415)
    pooled = stats.t_test(df, [], "g", "v", "a", "b", pooled=True).first()
    assert (round(pooled.t, 6), pooled.df) == (-1.440165, 7)
    assert abs(pooled.p - 0.193004) < 1e-5
    u = stats.mann_whitney(df, [], "g", "v", "a", "b").first()
    assert (u.u_a, u.u_b) == (5, 15)
    alone = stats.t_test(df.where("g = 'a'"), [], "g", "v", "a", "b").first()
    assert alone.t is None and alone.p is None


def test_corrections(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.2,), (None,)], "p double")
    got = {r.p: (round(r.p_bonferroni, 6), round(r.p_fdr, 6)) for r in stats.benjamini_hochberg(stats.bonferroni(df)).where("p is not null").collect()}
    assert got == {0.01: (0.04, 0.04), 0.04: (0.16, 0.053333), 0.03: (0.12, 0.053333), 0.2: (0.8, 0.2)}
    assert stats.benjamini_hochberg(df).count() == 5


def test_tails():
    assert np.allclose(distributions.t_two_sided([2.0, 0.0, 12.0], [10, 5, 3]), [0.073388, 1.0, 0.001246], atol=1e-5)
    assert np.allclose(distributions.f_upper([4.0, 1.0], [2, 1], [10, 1]), [0.052922, 0.5], atol=1e-5)
    assert np.allclose(distributions.normal_cdf([0.0, 1.959964]), [0.5, 0.975], atol=1e-6)


def test_normality_against_moments(spark):
    rng = np.random.default_rng(0)
    values = [("n", float(x)) for x in rng.normal(size=400)] + [("u", float(x) ** 4) for x in rng.random(400)] + [("few", 1.0)] * 9 + [("few2", 2.0)] * 3
    got = {r.k: r for r in stats.normality(spark.createDataFrame(values, "k string, v double"), ["k"], "v").collect()}
    assert got["n"].p > 0.05 and got["u"].p < 1e-6
    assert got["few"].k2 is None and got["few2"].p is None
    rows_ = [("n", g, float(v)) for g in "ab" for v in rng.normal(size=60)] + [("u", g, float(v) ** 6) for g in "ab" for v in rng.random(60)]
    picked = {r.k: r.test for r in stats.adaptive_test(spark.createDataFrame(rows_, "k string, g string, v double"), ["k"], "g", "v", "a", "b").collect()}
    assert picked == {"n": "t(118)", "u": "U(60, 60)"}


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = 3 + x @ [1.5, -2] + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(80), x]), y, rcond=None)
    got = {r.term: r for r in stats.ols(df, "y", ["a", "b"]).collect()}
    assert np.allclose([got[t].coef for t in ("intercept", "a", "b")], want)
    assert all(r.p < 1e-6 for r in got.values())


def test_mixed_anova_without_effect_of_group(spark):
    data = [(s, "g1" if s < 3 else "g2", t, float(s % 3 + 2 * (t == "y") + 0.1 * ((s + (t == "y")) % 2))) for s in range(6) for t in "xy"]
    got = {r.effect: r for r in stats.mixed_anova(spark.createDataFrame(data, "s int, g string, t string, v double"), "s", "g", "t", "v").collect()}
    assert got["within"].p < 0.01 and got["between"].p > 0.5


def test_interpolation(spark):
    df = spark.createDataFrame([(t, float(x), bool(k)) for t, (x, k) in enumerate(zip([5, 1, 9, 9, 4, 7], [0, 1, 0, 0, 1, 0], strict=True))], "t int, x double, keep boolean")
    assert [r.value_filled for r in win.interpolated(df, [], "t", "x", "keep").orderBy("t").collect()] == [1, 1, 2, 3, 4, 4]


def test_dispersion(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 4.0), (10.0, 4.0)], "g1 double, g2 double").withColumn("k", F.lit(1))
    assert agg.dispersion(df, ["k"], ["g1"]).first().dispersion == 14.75
    assert agg.dispersion(df, ["k"], ["g1", "g2"]).first().dispersion == pytest.approx(18.75)
    assert agg.dispersion(df, ["k"], ["g1", "g2"], "mean").first().dispersion == pytest.approx(16.5)
    ecc = spark.createDataFrame([(1, 1.0, 2.0, 2.0), (2, 3.0, 4.0, 0.0)], "k int, a double, b double, c double")
    assert rows(agg.eccentricity(ecc, ["k"], ["a", "b", "c"])) == [(1, 3.0), (2, 5.0)]


def test_transformed_mean(spark):
    df = spark.createDataFrame([(0.2,), (0.8,)], "r double")
    assert round(agg.transformed_mean(df, [], "r").first().mean_r, 6) == 0.572122
    assert round(agg.transformed_mean(df, [], "r", "atan").first().mean_r, 6) == 0.465986


def test_event_windows(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 2.3), (3, "a", 5.0)], "s int, kind string, onset double")
    got = {}
    for r in ts.event_frames(df, ["s"], "kind", "onset", 2.3, 3.0).collect():
        got.setdefault(r.s, []).append(r.frame)
    assert {k: sorted(v) for k, v in got.items()} == {1: [0, 1], 2: [1, 2], 3: [3, 4]}


def test_vertex_area(spark):
    faces = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "a long, b long, c long")
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0)], "node long, x double, y double, z double")
    got = {r.node: r.area for r in graph.vertex_areas(faces, vertices).collect()}
    assert all(abs(got[n] - a) < 1e-12 for n, a in {0: 1 / 3, 1: 1 / 6, 2: 1 / 3, 3: 1 / 6}.items())
    assert rows(graph.mesh_edges(faces)) == [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3)]


def test_eta_squared(spark):
    maps = spark.createDataFrame([(0, t, float(w)) for t, w in enumerate((1, 2, 3))], "node long, target int, w double")
    templates = spark.createDataFrame([(9, t, float(w)) for t, w in enumerate((1, 3, 2))], "template int, target int, w double")
    assert lab.eta_squared(maps, templates).first().eta2 == pytest.approx(0.75)


def test_scrub_rules(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([None, 0.2, 0.25, 0.3])], "k int, fd double")
    rule = lambda *a, **b: [r[0] for r in df.orderBy("k").select(ts.keep_frame(F.col("fd"), *a, **b)).collect()]
    assert rule(0.2, inclusive=True, missing_as_zero=True) == [True, True, False, False]
    assert rule(0.3) == [False, True, True, False]
    assert rule(0.3, missing_as_zero=True) == [True, True, True, False]


def test_trials_carry_over_runs(spark):
    data = [(r, k, t) for r, n in ((1, 2), (2, 1)) for k, t in enumerate(["stim1", "stim2", "choice"] * n)]
    df = spark.createDataFrame([("s", *x) for x in data], "s string, run int, row int, kind string")
    got = win.trial_counter(df, ["s"], ["run", "row"], F.col("kind") == "stim1").orderBy("run", "row").collect()
    assert [r.trial_nr for r in got] == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert scalar.nan_to_null(df, "x").agg(F.avg("x")).first()[0] == 2


@pytest.mark.parametrize("block", [1024, 3])
def test_correlations_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(10, 12))
    x[7] = 3.0  # constant: correlates with nothing
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, x array<double>")
    got = {(r.i, r.j): r.w for r in cm.correlation_edges(df, block=block).collect()}
    assert set(got) == {(i, j) for i in range(10) for j in range(i + 1, 10)}
    for (i, j), w in got.items():
        want = 0.0 if 7 in (i, j) else np.corrcoef(x[i], x[j])[0, 1]
        assert abs(w - want) < 1e-9
    above = cm.correlation_edges(df, above=0.3, block=block).collect()
    assert {(r.i, r.j) for r in above} == {k for k, w in got.items() if w > 0.3}
    assert [r.node for r in cm.varying(df).orderBy("node").collect()] == [0, 1, 2, 3, 4, 5, 6, 8, 9]


def test_components_and_patches(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (None, 4), (500, 500)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 300: 100}
    path = edges_of(spark, [(i, i + 1, 1.0) for i in range(6)])
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2), (4, 2), (5, 1), (6, 1)], "node long, label int")
    found = {r.node: (r.patch, r.n_nodes) for r in graph.patches(path, labels).collect()}
    assert found == {0: (0, 2), 1: (0, 2), 2: (2, 3), 3: (2, 3), 4: (2, 3), 5: (5, 2), 6: (5, 2)}
    merged = {r.node: r.label for r in graph.merged_small_patches(path, labels, 3).collect()}
    assert merged == {k: 2 for k in range(7)}
    areas = labels.select("node", F.lit(10.0).alias("area"))
    assert {r.node: r.label for r in graph.without_small_patches(path, labels, areas, 25.0).collect()} == {0: -1, 1: -1, 2: 2, 3: 2, 4: 2, 5: -1, 6: -1}
    assert rows(graph.border_nodes(path, spark.createDataFrame([(2,), (3,)], "node long"))) == [(1,), (4,)]


def test_label_propagation_splits_cliques(spark):
    clique = lambda ns: [(a, b, 1.0) for a in ns for b in ns if a < b]
    got = {r.node: r.module for r in graph.label_propagation(edges_of(spark, clique(range(5)) + clique(range(10, 15)) + [(4, 10, 0.1)])).collect()}
    assert len({got[k] for k in range(5)}) == len({got[k] for k in range(10, 15)}) == 1 and got[0] != got[10]


def test_label_propagation_runs_until_labels_stay(spark):
    path = [(k, k + 1, 100.0 - k) for k in range(14)]  # the first node's label moves on by one node a round
    assert {r.module for r in graph.label_propagation(edges_of(spark, path)).collect()} == {0}


def test_gradients_match_numpy(spark):
    n = 24
    at = np.linspace(0, 1, n) ** 1.3
    w = np.exp(-((at[:, None] - at[None, :]) ** 2) * 20)
    weights = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n)], "i long, j long, w double")
    d = w.sum(1)
    k = w / np.sqrt(np.outer(d, d))
    e = k.sum(1)
    values, vectors = np.linalg.eigh(k / np.sqrt(np.outer(e, e)))
    got = np.array([r.g for r in grad.diffusion_gradients(weights, 2).orderBy("node").collect()])
    for c in range(2):
        lam = values[-2 - c]
        want = vectors[:, -2 - c] / np.sqrt(e) * lam / (1 - lam)
        assert abs(np.corrcoef(got[:, c], want)[0, 1]) > 0.9999
        assert np.linalg.norm(got[:, c]) / np.linalg.norm(want) == pytest.approx(1, abs=0.01)


def test_procrustes_undoes_a_rotation(spark):
    rng = np.random.default_rng(3)
    g = rng.normal(size=(30, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    frame = lambda a: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)], "node long, g array<double>")
    got = np.array([r.g for r in grad.procrustes(frame(g @ turn), frame(g), 3).orderBy("node").collect()])
    assert np.allclose(got, g)


def test_cleaning_removes_confounds(spark):
    rng = np.random.default_rng(4)
    t = np.arange(120)
    noise, signal = rng.normal(size=120), np.sin(2 * np.pi * 0.03 * 2 * t)
    x = [signal + 5 * noise + 0.01 * t, 2 * signal - noise]
    series = spark.createDataFrame([("r", k, v.tolist()) for k, v in enumerate(x)], "run string, node long, x array<double>")
    confounds = spark.createDataFrame([("r", int(k), float(v), bool(k % 10 != 3)) for k, v in zip(t, noise, strict=True)], "run string, t int, c double, keep boolean")
    got = {r.node: np.array(r.x) for r in ts.cleaned(series, confounds, ["run"], ["c"]).collect()}
    assert np.corrcoef(got[0], signal)[0, 1] > 0.98
    short = {r.node: r.x for r in ts.cleaned(series, confounds, ["run"], ["c"], band=(0.009, 0.08), tr=2.0, excise=True, standardise=True).collect()}
    assert len(short[0]) == 108 and np.std(short[0], ddof=1) == pytest.approx(1)


def test_band_pass():
    t = np.arange(300)
    inside, outside = (np.sin(2 * np.pi * f * 2 * t)[None, :] for f in (0.03, 0.2))
    assert np.abs(ts.zero_phase(inside, 0.009, 0.08, 2.0) - inside)[:, 50:250].max() < 0.02
    assert np.abs(ts.zero_phase(outside, 0.009, 0.08, 2.0))[:, 50:250].max() < 0.02
    b, a = ts.butterworth(0.009, 0.08, 2.0)
    centre = np.exp(1j * 2 * math.atan(math.sqrt(math.tan(math.pi * 0.018) * math.tan(math.pi * 0.16))))
    assert abs(np.polyval(b, centre) / np.polyval(a, centre)) == pytest.approx(1, abs=1e-6)


def test_rank_matching_keeps_order(spark):
    df = spark.createDataFrame([("k", i, float((i * 7) % 10)) for i in range(10)], "k string, i int, v double")
    got = win.rank_matched(df, ["k"], "v", "i", seed=1).orderBy("v").collect()
    assert [r.resampled for r in got] == sorted(r.resampled for r in got)
    assert rows(win.rank_matched(df, ["k"], "v", "i", seed=1), "i", "resampled") == rows(win.rank_matched(df.repartition(3), ["k"], "v", "i", seed=1), "i", "resampled")


def test_design_with_response(spark):
    kernel = ts.response_kernel(2.0)
    assert sum(kernel) == pytest.approx(1)
    events = spark.createDataFrame([("s", "a", 4.0), ("s", "a", 500.0)], "s string, kind string, onset double")
    design = ts.design_matrix(events, ["s"], "kind", "onset", 2.0, 20, ["a"])
    assert [r.frame for r in design.where("a = 1").orderBy("frame").collect()] == [2, 19]
    curve = [r.a for r in ts.convolved(design, ["s"], ["a"], kernel).orderBy("frame").collect()]
    assert curve[:2] == [0, 0] and np.allclose(curve[2:19], (kernel + [0] * 20)[:17])


def test_near_pairs_match_brute_force(spark):
    rng = np.random.default_rng(5)
    p = rng.random((60, 3)) * 100 - 50
    df = spark.createDataFrame([(k, *map(float, v), k % 2) for k, v in enumerate(p)], "node long, x double, y double, z double, hemi int")
    got = {(r.i, r.j) for r in cm.near_pairs(df, ["x", "y", "z"], 30.0, same="hemi").collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 2 == j % 2 and np.linalg.norm(p[i] - p[j]) < 30}


def test_knee(spark):
    df = spark.createDataFrame([("a", float(x), 1 - math.exp(-x)) for x in range(11)], "k string, x double, y double")
    assert graph.knee(df, ["k"], "x", "y").first().x == 2


def test_geodesics_match_shortest_paths(spark):
    rng = np.random.default_rng(6)
    n = 25
    pairs = [(i, j, float(rng.integers(1, 9))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.15]
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for i, j, w in pairs:
        d[i, j] = d[j, i] = w
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    got = {(r.source, r.node): r.distance for r in graph.geodesics(edges_of(spark, pairs), spark.createDataFrame([(0,), (5,)], "node long"), 12.0).collect()}
    assert got == {(s, t): d[s, t] for s in (0, 5) for t in range(n) if d[s, t] <= 12}


def test_robust_correlation_leaves_outliers_out(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=60)
    y = x + rng.normal(size=60) * 0.3
    data = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [(100, 9.0, -9.0)]
    df = spark.createDataFrame(data, "k int, x double, y double")
    got = stats.shepherd_pi(df, "x", "y", "k").first()
    assert got.n < 61 and got.r > 0.9 and got.p < 1e-6


def test_corrections_over_many_ranges(spark):
    rng = np.random.default_rng(8)
    p = rng.random(500) ** 3
    order = np.argsort(p)
    want = np.minimum(1, np.minimum.accumulate((p[order] * 500 / np.arange(1, 501))[::-1])[::-1])
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(p)], "k int, p double")
    got = {r.k: r.p_fdr for r in stats.benjamini_hochberg(df, ties=["k"]).collect()}
    assert np.allclose([got[k] for k in order], want)


def test_ranks_without_keys(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 40, 300)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)] + [(-1, None)], "k int, x double")
    got = {r.k: r.rank_avg for r in stats.average_rank(df, [], "x").collect()}
    assert got == {k: (x < v).sum() + ((x == v).sum() + 1) / 2 for k, v in enumerate(x)}


@pytest.mark.parametrize("held", [{"held_ends": 7}, {"held_nodes": 3}])
def test_labels_of_packed_and_joined_graphs(spark, held):
    """Both ways of voting end in the same labels, in a graph of several rows."""
    rng = np.random.default_rng(5)
    edges = [(i, j, round(float(rng.random()), 2)) for i in range(30) for j in range(i + 1, 30) if rng.random() < (0.6 if i // 10 == j // 10 else 0.05)]
    label, seen = {n: n for e in edges for n in e[:2]}, []
    while label not in seen:
        seen.append(label)
        votes = {n: {m: max(w for i, j, w in edges if n in (i, j))} for n, m in label.items()}
        for i, j, w in edges + [(j, i, w) for i, j, w in edges]:
            votes[i][label[j]] = votes[i].get(label[j], 0.0) + w
        label = {n: min(v, key=lambda m: (-round(v[m], 9), m)) for n, v in votes.items()}
    cycle = seen[seen.index(label) :]
    want = {n: min(c[n] for c in cycle) for n in label}
    assert {r.node: r.module for r in graph.label_propagation(edges_of(spark, edges), **held).collect()} == want
