from __future__ import annotations

import numpy as np
import pytest

from rotogrid.functions import fourier as Fo
from rotogrid.operators import dense as D
from rotogrid.operators import masks as M
from rotogrid.operators import peaks as P
from rotogrid.operators import postprocess as Pp
from rotogrid.operators import refine as R
from rotogrid.operators import stencil as C
from tests.test_matching import MAP, voxels


def test_tilt_helpers():
    a = np.arange(20.0).reshape(4, 5)
    assert np.array_equal(Fo.shift(a), np.fft.fftshift(a))
    assert np.array_equal(Fo.shift(a, half=True), np.fft.fftshift(a, 0))
    assert Fo.pad_to_length(3, 4).tolist() == [3] * 4
    with pytest.raises(ValueError):
        Fo.pad_to_length([1, 2], 3)
    assert np.allclose(Fo.tilted_frequencies((8, 6, 4), 0), Fo.frequencies((6, 4)))
    assert Fo.tilted_frequencies((8, 6, 4), 60)[1, 0] == pytest.approx(2 * Fo.frequencies((6, 4))[1, 0])
    flat, steep = Fo.ctf_stack((8, 8, 8), [2e4], (0, 40), gradient=True, rate=4.0)
    assert np.allclose(flat, Fo.ctf((8, 8), 2e4, rate=4.0)) and not np.allclose(flat, steep)
    planes = np.ones((3, 9, 4))
    volume = Fo.insert_tilts(planes, (-30, 0, 30), 9)
    assert volume.max() == 1 and volume[4, 4, 0] == 1 and volume[0, 4, 0] == 0
    whole = Fo.tilt_filters((8, 8, 8), range(-60, 61, 5), low=4.0)
    assert whole.shape == (8, 8, 8) and 0 <= whole.min() and whole[0, 0, 0] == pytest.approx(1)


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    x = np.stack(np.meshgrid(*[np.arange(15.0)] * 3, indexing="ij"))
    data = np.exp(-((x - 7) ** 2).sum(0) / 18)
    points = rng.uniform(4, 10, (40, 3))
    weights = rng.random(40)
    g = R.gradient(data, points, weights)
    for i in range(3):
        step = np.zeros(3)
        step[i] = 0.25
        f = lambda p: R._value("NormalizedCrossCorrelation", R.interpolate(data, p), weights)
        assert g[i] == pytest.approx((f(points + step) - f(points - step)) / 0.5, abs=2e-3)
    assert np.allclose(R.gradient(np.zeros((9, 9, 9)), points % 8, weights), 0)
    assert R.gradient(data, points, weights, normalised=False).shape == (6,)


def test_single_placement_equals_the_map():
    rng = np.random.default_rng(4)
    data, g = rng.random((12, 11, 10)), rng.random((3, 5, 3))
    m = np.ones_like(g)
    whole = next(D.fft_scores(data, g, m, [np.eye(3)], "FLC"))
    for at in ((5, 5, 5), (0, 0, 0), (11, 10, 9)):
        assert R.local_score(data, g, m, at) == pytest.approx(whole[at], abs=1e-6)
    lap = R.laplacian(data)
    assert lap[3, 3, 3] == pytest.approx(data[2, 3, 3] + data[4, 3, 3] + data[3, 2, 3] + data[3, 4, 3] + data[3, 3, 2] + data[3, 3, 4] - 6 * data[3, 3, 3])


def test_fit_of_a_shifted_volume(spark):
    a = np.zeros((30, 30, 30))
    a[10:16, 12:15, 9:18] = 1
    a[10:12, 12:14, 9:12] = 3
    target, template = voxels(spark, a), voxels(spark, a, (-3, 2, 5))
    x, best = R.match_volumes(target, template)
    assert np.allclose(x[:3], [3, -2, -5], atol=0.05) and best == pytest.approx(1)
    with pytest.raises(ValueError):
        R.match_volumes(target, template.limit(0))
    with pytest.raises(ValueError):
        R.match_volumes(target.limit(0), template)


def test_bounded_and_gradient_optimisation():
    rng = np.random.default_rng(5)
    grid = np.stack(np.meshgrid(*[np.arange(20)] * 3, indexing="ij"), -1)
    blob = lambda c, w: np.exp(-(((grid - c) / w) ** 2).sum(-1))
    data = blob((10, 9, 11), (4, 2, 3))
    points = rng.integers(3, 17, (400, 3)).astype(float)
    weights = R.interpolate(data, points)
    away = points - (1.2, -0.8, 0.6)
    x, best = R.ascend(data, away, weights)
    assert np.allclose(x[:3], (1.2, -0.8, 0.6), atol=0.1) and best > 0.995
    x, best = R.ascend(data, away, weights, bounds=[(-0.5, 0.5)] * 3 + [(-5, 5)] * 3)
    assert np.abs(x[:3]).max() <= 0.5
    x, _ = R.optimise(data, away, weights, np.zeros(6), bounds=[(-1, 1)] * 3 + [(0, 0)] * 3)
    assert np.allclose(x, (1, -0.8, 0.6, 0, 0, 0), atol=0.1)
    with pytest.raises(ValueError):
        R.optimise(data, away, weights, np.ones(6), bounds=[(0, 0.5)] * 6)


def test_chamfer_is_exact_at_any_distance(spark):
    rng = np.random.default_rng(6)
    a, b = rng.random((40, 3)) * 100, rng.random((5, 3)) * 5
    frame = lambda p, extra=(): spark.createDataFrame([(*extra, *map(float, q)) for q in p], ("set_id int, " if extra else "") + "x double, y double, z double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min(1)
    row = R.chamfer(frame(a, (1,)), frame(b), 1.0).first()
    assert row.distance == pytest.approx(d.mean()) and row.n == 40
    assert R.chamfer(frame(a, (1,)), frame(b), 1.0, 20.0).first().distance == pytest.approx(np.minimum(d, 20).mean())
    assert R.chamfer(frame(a, (1,)), frame(b).limit(0), 1.0).count() == 0
    assert R.chamfer(frame(a, (1,)), frame(b).limit(0), 1.0, 20.0).first().distance == 20
    assert R.chamfer(frame(a, (1,)).limit(0), frame(b), 1.0).count() == 0


def test_polygon(spark):
    square = M.create_mask(spark, "polygon", shape=(8, 8, 2), corners=((1.5, 1.5), (5.5, 1.5), (5.5, 4.5), (1.5, 4.5)))
    assert {(r.x, r.y) for r in square.collect()} == {(x, y) for x in range(2, 6) for y in range(2, 5)} and square.count() == 24


def test_resampling(spark):
    a = np.random.default_rng(1).random((9, 7, 1))
    bounds = [(0, 8), (0, 6), (0, 0)]
    same = {(r.x, r.y): r.v for r in C.resample(voxels(spark, a), bounds, 1.0).collect()}
    assert all(same[at[:2]] == pytest.approx(a[at]) for at in np.ndindex(a.shape))
    half = {(r.x, r.y): r.v for r in C.resample(voxels(spark, a), bounds, 0.5).collect()}
    assert half[1, 0] == pytest.approx((a[0, 0, 0] + a[1, 0, 0]) / 2) and half[16, 12] == pytest.approx(a[8, 6, 0])


def test_merging_and_local_maxima(spark):
    a = spark.createDataFrame([(0, 0, 0, 5.0), (9, 0, 0, 3.0)], MAP)
    b = spark.createDataFrame([(1, 0, 0, 6.0), (9, 0, 0, 4.0), (20, 0, 0, 1.0)], MAP)
    assert [tuple(r) for r in P.merge(a, b, distance=3.0, n=2).collect()] == [(1, 0, 0, 6.0), (9, 0, 0, 4.0)]
    data = [(x, 0, 0, float(v)) for x, v in enumerate((9, 1, 2, 3, 2, 2, 3, 1, 0))]
    found = P.local_maxima(spark.createDataFrame(data, MAP), 1, [(0, 8), (0, 0), (0, 0)], 5)
    assert {r.tx for r in found.collect()} == {3, 6}


def test_postprocessing(spark):
    scores = spark.createDataFrame([(0, 0, 0, 5.0, 1), (0, 0, 0, 4.0, 2), (1, 0, 0, 1.0, 1), (1, 0, 0, 6.0, 2)], MAP + ", entity int")
    best = {(r.tx): (r.s, r.entity) for r in Pp.normalise(scores).collect()}
    assert best == {0: (2.0, 1), 1: (1.0, 2)}
    corrected = Pp.subtract_background(scores.where("entity = 1").drop("entity"), scores.where("entity = 2 and tx = 0"))
    assert {(r.tx, r.s) for r in corrected.collect()} == {(0, 5.0), (1, 0.0)}
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    found = Pp.discover(paths("/a/rec_t1_10.00Apx.mrc", "/a/t1_bin4.mrc", "/a/t2.mrc"), paths("/m/t1.xml", "/m/t2.xml", "/m/t3.xml"), paths("/k/t1_mask.mrc"))
    assert {tuple(r) for r in found.collect()} == {("t1", "/a/rec_t1_10.00Apx.mrc", "/m/t1.xml", "/k/t1_mask.mrc"), ("t2", "/a/t2.mrc", "/m/t2.xml", None)}
    assert Pp.discover(paths("/a/t2.mrc"), paths("/m/t2.xml"), paths("/k/t1.mrc"), True).count() == 0
    picks = spark.createDataFrame([(i, float(i)) for i in range(11)], "i int, score double")
    assert {r.i for r in Pp.rank_visible(picks, 20, 80).collect()} == set(range(2, 9))


def test_diameter(spark):
    from rotogrid.operators.grid import diameter, least_deviations

    rng = np.random.default_rng(7)
    for n in (1, 2, 60):
        points = rng.normal(size=(n, 3)) * (3, 1, 2)
        df = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double, z double")
        d, a, b = diameter(df)
        expected = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)).max()
        assert d == pytest.approx(expected) and np.linalg.norm(np.subtract(a, b)) == pytest.approx(d)
    assert diameter(df.limit(0)) is None
    d, a, b = diameter(df, most=0)
    assert d == pytest.approx(expected) and np.linalg.norm(np.subtract(a, b)) == pytest.approx(d)
    sphere = rng.normal(size=(3000, 3))
    sphere *= 10 / np.linalg.norm(sphere, axis=1)[:, None]
    cloud = spark.createDataFrame([tuple(map(float, p)) for p in sphere], "x double, y double, z double")
    assert diameter(cloud, most=10)[0] == pytest.approx(max(np.sqrt(((sphere - p) ** 2).sum(1)).max() for p in sphere))
    assert diameter(df.limit(1), most=0)[0] == 0
    assert least_deviations([[0, 5], [2, 4]]).tolist() == [[0, 1], [1, 0]]
