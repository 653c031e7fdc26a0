from __future__ import annotations

import math

import numpy as np
import pytest

from rotogrid.functions import fourier as Fo
from rotogrid.operators import masks as M
from rotogrid.operators import refine as R
from rotogrid.operators import stencil as C
from tests.test_matching import voxels

BOUNDS = [(0, 6), (0, 5), (0, 4)]


def random_volume():
    rng = np.random.default_rng(5)
    a = rng.integers(-2, 6, (7, 6, 5)).astype(float)
    a[rng.random(a.shape) < 0.3] = 0
    return a


def dense(df, shape=(7, 6, 5)):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.x, r.y, r.z] = r.v
    return out


def neighbours(a, mode, edge):
    low, high = edge // 2, (edge - 1) // 2
    p = np.pad(a, [(low, high)] * 3, mode)
    return np.stack([p[i : i + a.shape[0], j : j + a.shape[1], k : k + a.shape[2]] for i in range(edge) for j in range(edge) for k in range(edge)])


@pytest.mark.parametrize(("border", "mode"), [("zero", "constant"), ("wrap", "wrap"), ("reflect", "symmetric"), ("nearest", "edge")])
def test_stencils_by_border(spark, border, mode):
    a = random_volume()
    rng = np.random.default_rng(1)
    weights = {o: float(rng.integers(-3, 4)) for o in np.ndindex(3, 3, 3)}
    expected = sum(w * n for w, n in zip(weights.values(), neighbours(a, mode, 3)))
    moved = {tuple(i - 1 for i in o): w for o, w in weights.items() if w}
    assert np.allclose(dense(C.convolve(voxels(spark, a), moved, BOUNDS, border)), expected)


@pytest.mark.parametrize("edge", [2, 3])
@pytest.mark.parametrize(("border", "mode"), [("zero", "constant"), ("reflect", "symmetric")])
def test_ranks_and_extremes(spark, border, mode, edge):
    a = random_volume()
    n = np.sort(neighbours(a, mode, edge), 0)
    v = voxels(spark, a)
    assert np.allclose(dense(C.rank_filter(v, edge, 2, BOUNDS, border)), n[2])
    assert np.allclose(dense(C.median_filter(v, edge, BOUNDS, border)), n[len(n) // 2])
    assert np.allclose(dense(C.extreme_filter(v, edge, BOUNDS, True, border)), n[-1])
    assert np.allclose(dense(C.extreme_filter(v, edge, BOUNDS, False, border)), n[0])


def test_windows():
    for w in (C.gaussian_window(1.3), C.kaiser_window(7), C.kaiser_window(7, order=2), C.hamming_window(6)):
        assert w.sum() == pytest.approx(1) and np.allclose(w, w[::-1])
    assert len(C.gaussian_window(1.3)) == 2 * int(4 * 1.3 + 0.5) + 1


def test_depth_surface_and_erosion(spark):
    a = np.zeros((7, 6, 5))
    a[1:6, 1:5, 0:5] = 1
    a[3, 2, 2] = 0
    depth, layer, n = np.zeros_like(a), a.copy(), 0
    while layer.any():
        depth += layer
        p = np.pad(layer, 1)
        layer = layer * p[2:, 1:-1, 1:-1] * p[:-2, 1:-1, 1:-1] * p[1:-1, 2:, 1:-1] * p[1:-1, :-2, 1:-1] * p[1:-1, 1:-1, 2:] * p[1:-1, 1:-1, :-2]
        n += 1
    v = voxels(spark, a)
    assert np.array_equal(dense(C.core_depth(v, BOUNDS)), depth)
    assert np.array_equal(dense(C.erode(v, BOUNDS)), (depth > 1).astype(float))
    assert C.surface(v, BOUNDS).count() == int((depth == 1).sum())


def test_masks(spark):
    with pytest.raises(ValueError):
        M.create_mask(spark, "cone")
    assert M.box(spark, (20, 20, 20), (10, 10, 10), (4, 5, 6)).count() == 120
    assert M.box(spark, (20, 20, 20), (10, 10, 10), (4, 5, 6), wider=True).count() == 5 * 6 * 7
    soft = M.ellipse(spark, (15, 15, 15), 4, sigma=1.0).collect()
    assert {r.v for r in soft if math.dist((r.x, r.y, r.z), (7, 7, 7)) <= 4} == {1.0}
    assert 0 < min(r.v for r in soft) < 0.05


def test_fourier_filters():
    f = Fo.frequencies((8, 6))
    assert f[0, 0] == 0 and f.max() == pytest.approx(math.sqrt(0.5))
    assert np.allclose(Fo.frequencies((8, 6), half=True), f[:, :4])
    assert Fo.electron_wavelength(300e3) == pytest.approx(0.019687, abs=1e-5)
    c = Fo.ctf((64,), 2e4, rate=2.0)
    assert 0 <= c.min() and c.max() <= 1 and c[0] == pytest.approx(0.07, abs=1e-6)
    assert Fo.ctf((16, 16), 2e4, 2e4, rate=4.0) == pytest.approx(Fo.ctf((16, 16), 2e4, rate=4.0))
    w = Fo.continuous_wedge((16, 16, 16), 90, 90, cutoff=None)
    assert w.all()
    assert 0.3 < Fo.continuous_wedge((16, 16, 16), 45, 45, cutoff=None).mean() < 0.7
    assert Fo.step_wedge((8, 8, 8), [0])[0].all()
    with pytest.raises(ValueError):
        Fo.step_wedge((8, 8, 8), [0, 1], [1])
    with pytest.raises(ValueError):
        Fo.tilt_weights("dose", (4, 4), [0])
    with pytest.raises(ValueError):
        Fo.reconstruction_filter(8, "box")
    a = np.random.default_rng(0).random((8, 8, 8))
    assert np.allclose(np.abs(np.fft.rfftn(Fo.scramble_phases(a, 0.0))), np.abs(np.fft.rfftn(a)))
    assert Fo.resample_fourier(a, (16, 16, 16)).mean() == pytest.approx(a.mean())
    double = lambda **s: {"data": np.full(3, 2.0), "multiplicative": True}
    start = lambda **s: {"data": np.full(3, 5.0)}
    assert Fo.compose(start, double, lambda **s: {"note": 1})()["data"].tolist() == [10.0] * 3
    flat = Fo.apply(a, Fo.whitening(a))
    _, spectrum = Fo.radial_spectrum(flat)
    assert spectrum[1:4].std() / spectrum[1:4].mean() < 0.2


def test_back_projection_of_a_point():
    angles = range(-60, 61, 3)
    slices = np.zeros((len(angles), 15, 3))
    for i, a in enumerate(angles):
        at = 2 * math.cos(math.radians(a)) + 1 * math.sin(math.radians(a)) + 7
        slices[i, int(math.floor(at)), 1] += 1 - (at % 1)
        slices[i, int(math.floor(at)) + 1, 1] += at % 1
    volume = Fo.back_project(slices, angles, 15, "ramp-cont")
    assert np.unravel_index(volume.argmax(), volume.shape) == (8, 9, 1)


def test_pose_recovery():
    data = np.zeros((20, 20, 20))
    data[6:12, 8:13, 7:10] = 1
    points = np.argwhere(data > 0).astype(float)
    x, value = R.optimise(data, points + [1.0, -2.0, 1.0], np.ones(len(points)) + np.arange(len(points)) * 0.0, np.zeros(6), "CrossCorrelation")
    assert np.allclose(x[:3], [-1, 2, -1], atol=1.0) and value >= 0.9 * len(points)
    still, best = R.optimise(data, points, np.ones(len(points)), np.zeros(6), "CrossCorrelation")
    assert best == len(points) and np.allclose(still, 0)


def test_pose_scores(spark):
    a = random_volume()
    v = voxels(spark, a)
    poses = spark.createDataFrame([(1, 2, 2, 2), (2, 0, 0, 0), (3, 50, 0, 0)], "pose_id bigint, tx int, ty int, tz int")
    points = [(0, 0, 0, 1.0), (1, 0, 0, 2.0), (0, -1, 1, 3.0)]

    def values(t):
        return np.array([a[tuple(np.add(t, p[:3]))] if all(0 <= c < n for c, n in zip(np.add(t, p[:3]), a.shape)) else 0.0 for p in points])

    w = np.array([p[3] for p in points])
    for name in R.POSE_SCORES:
        got = {r.pose_id: r.s for r in R.pose_scores(v, poses, points, name).collect()}
        for i, t in ((1, (2, 2, 2)), (2, (0, 0, 0)), (3, (50, 0, 0))):
            assert got[i] == pytest.approx(R._value(name, values(t), w), abs=1e-9)
    with pytest.raises(ValueError):
        R.pose_scores(v, poses, points, "none")
    with pytest.raises(ValueError):
        R.register_pose_score("x", 3)
