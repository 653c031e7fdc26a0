from __future__ import annotations

import math
import random
from itertools import product

import numpy as np
import pytest

from pyspark.sql import functions as F

from rotogrid.functions import lattice as L
from rotogrid.operators import aggregate as A
from rotogrid.operators import dense as D
from rotogrid.operators import grid as G
from rotogrid.operators import peaks as P
from rotogrid.operators import score as S

VOX = "x int, y int, z int, v double"
MAP = "tx int, ty int, tz int, s double"


def voxels(spark, array, offset=(0, 0, 0)):
    return spark.createDataFrame([(*[int(i + o) for i, o in zip(at, offset)], float(array[tuple(at)])) for at in np.argwhere(array != 0)], VOX)


def box_in_box():
    """A box of ones in a larger volume and the same box in a template."""
    target, g = np.zeros((24, 20, 18)), np.zeros((9, 9, 7))
    target[10:14, 7:12, 6:9] = 1
    g[2:6, 2:7, 2:5] = 1
    center = [n // 2 for n in g.shape]
    points = tuple((*[int(i - c) for i, c in zip(at, center)], float(g[tuple(at)]), 1.0) for at in np.ndindex(g.shape))
    return target, g, S.Template(points, g.size), (12, 9, 7)


@pytest.mark.parametrize("name", ["CC", "CORR", "CAM", "FLC", "FLCSphericalMask", "MCC"])
def test_box_in_box(spark, name):
    target, g, template, peak = box_in_box()
    bounds = [(0, n - 1) for n in target.shape]
    best = S.match_template(voxels(spark, target), template, name, bounds=bounds, threshold=-1e9)
    row = best.orderBy(best.s.desc(), "tx", "ty", "tz").first()
    assert (row.tx, row.ty, row.tz) == peak and row.r == 0
    assert row.s == pytest.approx(60.0 if name == "CC" else 1.0, abs=0.35 if name in ("CORR", "CAM") else 1e-6)


def test_laplace_box(spark):
    target, g, template, peak = box_in_box()
    best = S.local_correlate(voxels(spark, target), template, bounds=[(0, n - 1) for n in target.shape], edge=g.shape)
    row = best.orderBy(best.s.desc()).first()
    assert (row.tx, row.ty, row.tz) == peak


def small():
    rng = np.random.default_rng(3)
    target = rng.integers(0, 5, (9, 8, 7)).astype(float)
    target[rng.random(target.shape) < 0.4] = 0
    g = rng.integers(1, 9, (3, 3, 3)).astype(float)
    m = np.ones_like(g)
    points = tuple((*[int(i) - 1 for i in at], float(g[tuple(at)]), 1.0) for at in np.ndindex(3, 3, 3))
    return target, g, m, S.Template(points, 27)


@pytest.mark.parametrize("name", ["CC", "FLC"])
def test_sparse_equals_dense(spark, name):
    target, g, m, template = small()
    bounds = [(0, n - 1) for n in target.shape]
    rotations = L.lattice_rotations()
    maps = list(D.fft_scores(target, g, m, np.array(rotations, float).reshape(-1, 3, 3), name))
    for r in S.SCORES[name](voxels(spark, target), template, rotations, bounds).collect():
        assert maps[r.r][r.tx, r.ty, r.tz] == pytest.approx(r.s, abs=1e-6)


def test_blocks_equal_one_volume(spark):
    target, g, m, template = small()
    rotations = np.array(L.lattice_rotations(), float).reshape(-1, 3, 3)
    whole = np.max(list(D.fft_scores(target, g, m, rotations, "CC")), 0)
    out = D.match_blocks(G.to_blocks(voxels(spark, target), 4, 1), g, m, rotations, 1, "CC", -1e9)
    grouped = D.match_blocks(G.to_blocks(voxels(spark, target), 4, 1), g, m, rotations, 1, "CC", -1e9, precision="float32", group=5)
    for rows, close in ((out, 1e-6), (grouped, 1e-3)):
        got = {(r.tx, r.ty, r.tz): r.s for r in rows.collect()}
        for at in np.ndindex(*target.shape):
            assert got[at] == pytest.approx(whole[at], abs=close)
    first = {(r.tx, r.ty, r.tz): r.r for r in out.collect()}
    assert len(first) == len(set(first)) and min(first.values()) == 0
    with pytest.raises(ValueError):
        D.match_blocks(G.to_blocks(voxels(spark, target), 4, 0), g, m, rotations, 0)


def test_edges_zero_and_wrap(spark):
    target = np.zeros((4, 1, 1))
    target[0, 0, 0] = 2.0
    t = S.Template(((-1, 0, 0, 3.0, 1.0),), 3)
    bounds = [(0, 3), (0, 0), (0, 0)]
    assert [tuple(r) for r in S.correlate(voxels(spark, target), t, bounds=bounds).collect()] == [(1, 0, 0, 0, 6.0)]
    t = S.Template(((1, 0, 0, 3.0, 1.0),), 3)
    assert S.correlate(voxels(spark, target), t, bounds=bounds).count() == 0
    assert [tuple(r) for r in S.correlate(voxels(spark, target), t, bounds=bounds, wrap=True).collect()] == [(3, 0, 0, 0, 6.0)]


def test_first_rotation_wins_ties_and_thresholds_are_exceeded(spark):
    scores = spark.createDataFrame([(0, 0, 0, 1, 2.0), (0, 0, 0, 0, 2.0), (1, 0, 0, 0, 1.0)], "tx int, ty int, tz int, r int, s double")
    assert {tuple(r) for r in A.best_over_rotations(scores, threshold=1.0).collect()} == {(0, 0, 0, 2.0, 0)}


def test_best_products_equal_the_best_of_scores(spark):
    target, _, _, template = small()
    signed = S.Template(tuple((*p[:3], p[3] - 5.0, 1.0) for p in template.points[::3]), 27)
    v, bounds, rotations = voxels(spark, target), [(0, n - 1) for n in target.shape], L.lattice_rotations()
    plain = A.best_over_rotations(S.correlate(v, signed, rotations, bounds), threshold=-3.0)
    assert sorted(map(tuple, A.best_products(v, signed, rotations, bounds, threshold=-3.0).collect())) == sorted(map(tuple, plain.collect()))


def test_registry():
    with pytest.raises(ValueError):
        S.register_score("CC", S.correlate)


def scattered(spark, n=120, seed=1):
    rng = random.Random(seed)
    points = rng.sample(list(product(range(20), range(20), range(4))), n)
    data = [(*p, float(rng.choice([-1, 0, 1, 2, 3, 3, 5, 8]))) for p in points]
    return data, spark.createDataFrame(data, MAP)


@pytest.mark.parametrize("box", [False, True])
@pytest.mark.parametrize("distance", [1.5, 3.0, 5.0])
def test_suppression_equals_the_greedy_loop(spark, distance, box):
    data, df = scattered(spark)
    kept = []
    for p in sorted(data, key=lambda p: (-p[3], p[:3])):
        far = all((max(abs(a - b) for a, b in zip(p, q[:3])) > distance) if box else math.dist(p[:3], q[:3]) >= distance for q in kept)
        if far:
            kept.append(p)
    assert {tuple(r) for r in P.suppress(df, distance, box=box).collect()} == set(kept)


def test_suppression_of_a_chain(spark):
    for n, options in ((3000, {}), (300, {"together": 0, "tile": 64})):
        data = [(i, 0, 0, float(n - i)) for i in range(n)]
        assert {r.tx for r in P.suppress(spark.createDataFrame(data, MAP), 1.5, **options).collect()} == set(range(0, n, 2))


def test_suppression_by_tiles_equals_one_task(spark):
    rng = np.random.default_rng(3)
    data = [(int(x), int(y), int(z), float(s), int(k)) for x, y, z, s, k in zip(*rng.integers(-20, 20, (3, 900)), rng.integers(0, 40, 900), rng.integers(0, 2, 900))]
    df = spark.createDataFrame(data, MAP + ", r int").withColumn("r", F.when(F.col("r") == 1, 1))  # a null key
    for box in (False, True):
        a = {tuple(r) for r in P.suppress(df, 3.0, ("r",), box).collect()}
        assert a == {tuple(r) for r in P.suppress(df, 3.0, ("r",), box, together=0, tile=8).collect()} == {tuple(r) for r in P.suppress(df, 3.0, ("r",), box, together=60, tile=8).collect()}


def test_dense_scores_do_not_depend_on_scale_or_offset():
    rng = np.random.default_rng(0)
    target, g = rng.random((14, 12, 10)), rng.random((5, 5, 5))
    m = np.ones_like(g)
    rotations = [np.eye(3)]
    for name in D.DENSE:
        whole = next(D.fft_scores(target, g, m, rotations, name))
        core = next(D.fft_scores(target, g, m, rotations, name, halo=2))
        inner = (slice(2, -2),) * 3
        for precision, close in ((np.float64, 1e-9), (np.float32, 2e-4)):
            for scale in (1e-6, 1.0, 1e6):
                factor = scale if name in ("CC", "LCC") else 1.0
                other = next(D.fft_scores(target * scale, g, m, rotations, name, precision=precision)) / factor
                assert np.abs(other - whole).max() <= close * np.abs(whole).max(), (name, precision, scale)
        if name in ("FLC", "FLCSphericalMask", "MCC", "batchFLC", "batchFLCSpherical"):
            moved = next(D.fft_scores(target + 1e4, g, m, rotations, name, precision=np.float32))
            assert np.abs(moved - whole)[inner].max() < 1e-3, name
            assert np.abs(core - whole[inner]).max() < 1e-6 or name == "MCC"
    with pytest.raises(ValueError):
        next(D.fft_scores(target, g, m, rotations, "nonsense"))


def test_retiled_blocks(spark):
    a = np.random.default_rng(4).random((11, 7, 9))
    rows = [(f"{k}", [i * 4 for i in k], list(p.shape), [11, 7, 9], bytearray(np.ascontiguousarray(p).tobytes())) for k in np.ndindex(3, 2, 3) for p in [a[tuple(slice(i * 4, i * 4 + 4) for i in k)]]]
    stored = spark.createDataFrame([("v", *r) for r in rows], "path string, block_id string, start array<int>, shape array<int>, volume array<int>, data binary")
    for wrap in (0, 1):
        padded = np.pad(a, 2)
        if wrap:
            for axis in range(3):
                inner = [slice(2, -2)] * 3
                low, high = list(inner), list(inner)
                low[axis], high[axis] = slice(1, 2), slice(padded.shape[axis] - 2, padded.shape[axis] - 1)
                padded[tuple(low)], padded[tuple(high)] = np.take(a, [-1], axis), np.take(a, [0], axis)
        got = G.retile(stored, 5, 2, ("path",), wrap).collect()
        assert len(got) == 3 * 2 * 2
        for r in got:
            whole = np.pad(padded, [(0, 30)] * 3)
            assert np.array_equal(D.cells(r.asDict()), whole[tuple(slice(s + 2, s + 2 + n) for s, n in zip(r.start, r.shape))])
            assert r.low == [0, 0, 0] and r.high == [10, 6, 8] and r.path == "v"



@pytest.mark.parametrize("edge", [1, 2, 3, 4])
def test_maximum_filter_with_empty_cells_and_negatives(spark, edge):
    data, df = scattered(spark)
    bounds = [(0, 19), (0, 19), (0, 3)]
    full = np.zeros((20, 20, 4))
    known = np.zeros((20, 20, 4), bool)
    for x, y, z, s in data:
        full[x, y, z], known[x, y, z] = s, True
    low, high = -(edge // 2), (edge - 1) // 2
    padded = np.pad(full, 4)
    expected = set()
    for x, y, z, s in data:
        window = padded[tuple(slice(c + low + 4, c + high + 5) for c in (x, y, z))]
        if s >= window.max():
            expected.add((x, y, z, s))
    assert {tuple(r) for r in P.maximum_filter(df, edge, bounds).collect()} == expected


def test_fast_peaks_and_buckets(spark):
    data, df = scattered(spark)
    order = lambda p: (-p[3], p[:3])
    tiles: dict = {}
    for p in sorted(data, key=order):
        tiles.setdefault(tuple(c // 5 for c in p[:3]), p)
    expected = {p for p in tiles.values() if not any(q[3] > p[3] and all(c - 5 <= d < c + 5 for c, d in zip(p[:3], q[:3])) for q in data)}
    assert {tuple(r) for r in P.fast_peaks(df, 5, [(0, 19), (0, 19), (0, 3)]).collect()} == expected
    low = [min(p[i] for p in data) for i in range(3)]
    cells: dict = {}
    for p in sorted(data, key=order):
        cells.setdefault(tuple((c - m) // 4 for c, m in zip(p[:3], low)), p)
    assert {tuple(r) for r in P.bucket_filter(df, 4).collect()} == set(cells.values())
    assert P.fast_peaks(df.limit(0), 5, [(0, 19), (0, 19), (0, 3)]).count() == 0
    assert P.suppress(df.limit(0), 2.0).count() == 0


def test_oversampling_finds_a_shift():
    x = np.arange(9)
    patch = np.exp(-((x - 4.25) ** 2) / 4)[:, None, None] * np.exp(-((x - 4) ** 2) / 4)[None, :, None] * np.exp(-((x - 3.75) ** 2) / 4)
    offset, value = P.oversample(patch, 8)
    assert np.allclose(offset, [0.25, 0, -0.25], atol=0.13) and value == pytest.approx(1, abs=0.1)


def test_tiles_cover_and_halos(spark):
    for equal in (True, False):
        covered = np.zeros((10, 7, 5), int)
        for t in G.tiles((10, 7, 5), (3, 2, 1), equal):
            covered[tuple(slice(a, b) for a, b in t)] += 1
        assert covered.min() == 1 and (not equal) <= (covered.max() == 1)
    assert len({tuple(b - a for a, b in t) for t in G.tiles((10, 7, 5), (3, 2, 1))}) == 1
    target = small()[0]
    assert {tuple(r) for r in G.from_blocks(G.to_blocks(voxels(spark, target), 4)).collect()} == {tuple(r) for r in voxels(spark, target).collect()}


def test_planner():
    splits = D.plan_tiles((400, 400, 200), (40, 40, 40), "FLC", 500_000_000)
    tile = [-(-n // k) for n, k in zip((400, 400, 200), splits)]
    assert D.memory_bytes(tile, (40, 40, 40), "FLC") <= 500_000_000 and max(splits) > 1
    with pytest.raises(ValueError):
        D.plan_tiles((400, 400, 400), (390, 390, 390), "FLC", 1000)
    edge, groups = D.plan_work((192,) * 3, (25,) * 3, "FLCSphericalMask", 1 << 30, 4, 64, 8)
    assert D.memory_bytes([edge + 24] * 3, [1] * 3, "FLCSphericalMask", 1, 4) <= 1 << 30 and D.fast_length(edge + 24) == edge + 24 or edge == 192
    assert -(-192 // edge) ** 3 * groups >= 8  # all tasks have work
    assert D.plan_work((64,) * 3, (9,) * 3, "FLC", 1 << 30, 4, 10000, 1)[1] == 1 and D.plan_work((64,) * 3, (9,) * 3, "FLC", 1 << 30, 4, 10000, 64)[1] > 1
    with pytest.raises(ValueError):
        D.plan_work((64,) * 3, (25,) * 3, "FLC", 1000)
    assert D.choose_path(1000, 10, 24, 10**6) == "sparse" and D.choose_path(10**6, 10**4, 24, 10**6) == "dense"
    assert [D.fast_length(n) for n in (1, 7, 11, 31, 97)] == [1, 8, 12, 32, 100]


def test_rotations():
    rots = L.lattice_rotations()
    assert len(set(rots)) == 24 and rots == sorted(rots)
    for m in [*np.array(rots, float).reshape(-1, 3, 3), *L.cone_rotations(20, 10, axis_sampling=45), *L.uniform_rotations(40)]:
        assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)
        assert np.allclose(L.euler_to_matrix(L.matrix_to_euler(m)), m, atol=1e-6)
    assert np.allclose(L.uniform_rotations(40)[0], np.eye(3))
    for base in ((1, 0, 0), (0, 0, -1), (0, 0, 1), (1, 2, 3)):
        assert np.allclose(L.align_vectors(base) @ (np.array(base) / np.linalg.norm(base)), [0, 0, 1])
    axes = L.cone_points(20, 5, (0, 1, 0))
    assert np.degrees(np.arccos(axes @ [0, 1, 0])).max() <= 20.0001
    assert L.sampling_of_diameter(300, 10, 40) == pytest.approx(360 * 40 / (math.pi * 300))


def test_lattice_rotation_of_blocks_is_exact():
    g = np.arange(27.0).reshape(3, 3, 3)
    for m in L.lattice_rotations():
        moved = np.zeros_like(g)
        for at in np.ndindex(3, 3, 3):
            moved[tuple(np.array(L.rotate_offset(m, tuple(i - 1 for i in at))) + 1)] = g[at]
        for order in (0, 1, 3):
            assert np.allclose(D.rotate(g, np.array(m).reshape(3, 3), order), moved, atol=1e-9)
    with pytest.raises(ValueError):
        D.rotate(g, np.eye(3), 2)


def test_constrained_scores(spark):
    scores = spark.createDataFrame([(x, 0, 0, r, float(x + r)) for x in range(8) for r in range(24)], "tx int, ty int, tz int, r int, s double")
    seeds = spark.createDataFrame([(1, 2, 0, 0, *map(float, L.IDENTITY)), (2, 3, 0, 0, *map(float, L.IDENTITY))], "seed_id int, x int, y int, z int, " + ", ".join(f"m{i} double" for i in range(9)))
    got = {(r.tx, r.r) for r in A.constrained(scores, seeds, L.lattice_rotations(), 30, 1.5).collect()}
    upright = [r for r, m in enumerate(L.lattice_rotations()) if m[8] == 1]
    assert got == {(x, r) for x in (1, 2, 3, 4) for r in upright}
