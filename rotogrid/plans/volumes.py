"""Queries of masks, stencils, tilt filters and dense blocks, and their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from rotogrid.functions import fourier
from rotogrid.operators import dense as D
from rotogrid.operators import grid as G
from rotogrid.operators import lines as L
from rotogrid.operators import masks as M
from rotogrid.operators import score as S
from rotogrid.operators import stencil as C
from rotogrid.plans import tables as t
from rotogrid.plans.matching import SQL as MATCHING_SQL
from rotogrid.plans.matching import six

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _grid(n: int = 20) -> str:
    axes = ", ".join(f"(SELECT CAST(unnest(range(0, {n})) AS INT) AS {c})" for c in "xyz")
    return f"g AS (SELECT * FROM {axes})"


# masks
add("mask_ellipse", lambda s, d: M.create_mask(s, "ellipse", shape=(20, 20, 20), radius=(6, 4, 5), center=(10, 9, 8)), f"WITH {_grid()} SELECT x, y, z, 1.0::DOUBLE AS v FROM g WHERE sqrt(((x - 10) / 6.0) ** 2 + ((y - 9) / 4.0) ** 2 + ((z - 8) / 5.0) ** 2) <= 1")
add(
    "mask_soft_ellipse",
    lambda s, d: six(M.ellipse(s, (20, 20, 20), 5, (10, 10, 10), sigma=1.5), "v"),
    f"WITH {_grid()}, k AS (SELECT *, sqrt((x - 10) ** 2 + (y - 10) ** 2 + (z - 10) ** 2) / 5.0 AS d FROM g) SELECT x, y, z, round(CASE WHEN d <= 1 THEN 1.0 ELSE exp(-((d - 1) ** 2) / (2 * 0.3 ** 2)) END, 6) AS v FROM k WHERE d <= 1 + 3 * 0.3",
)
_turn = (0, -1, 0, 1, 0, 0, 0, 0, 1)
add("mask_oriented_ellipse", lambda s, d: M.ellipse(s, (20, 20, 20), (7, 3, 4), (10, 10, 10), orientation=_turn), f"WITH {_grid()} SELECT x, y, z, 1.0::DOUBLE AS v FROM g WHERE sqrt(((y - 10) / 7.0) ** 2 + ((x - 10) / 3.0) ** 2 + ((z - 10) / 4.0) ** 2) <= 1")
add("mask_box", lambda s, d: M.create_mask(s, "box", shape=(20, 20, 20), center=(10, 10, 10), height=(5, 4, 3)), f"WITH {_grid()} SELECT x, y, z, 1.0::DOUBLE AS v FROM g WHERE x BETWEEN 8 AND 12 AND y BETWEEN 8 AND 11 AND z BETWEEN 9 AND 11")
add("mask_tube", lambda s, d: M.create_mask(s, "tube", shape=(20, 20, 20), axis=2, base=(10, 10, 10), inner=2, outer=6, height=8), f"WITH {_grid()} SELECT x, y, z, 1.0::DOUBLE AS v FROM g WHERE sqrt((x - 10) ** 2 + (y - 10) ** 2) <= 6 AND sqrt((x - 10) ** 2 + (y - 10) ** 2) > 2 AND z BETWEEN 6 AND 13")
_leaf = " + ".join(f"CASE WHEN abs(z - 10 - ({c})) <= 3.0 THEN exp(-((z - 10 - ({c})) ** 2) / (2 * 1.0)) ELSE 0.0 END" for c in (-4.0, 4.0))
add("mask_membrane", lambda s, d: six(M.create_mask(s, "membrane", shape=(20, 20, 20), radius=7, thickness=2, separation=8), "v"), f"WITH {_grid()} SELECT x, y, z, round({_leaf}, 6) AS v FROM g WHERE sqrt((x - 10) ** 2 + (y - 10) ** 2) <= 7 AND {_leaf} > 0")
_spread = f"WITH {t.V3}, {t.dense_sql('v3', t.V3_BOUNDS)}, st AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM dense)"
add("threshold_mask", lambda s, d: C.threshold_mask(t.volume(s, d), t.V3_BOUNDS, 1.5), _spread + " SELECT x, y, z, 1.0::DOUBLE AS v FROM dense, st WHERE abs(v - m) >= 1.5 * d")


# stencils over the volume: the SQL looks every neighbour up instead of scattering
def _fold(c: str, low: int, high: int, border: str) -> str:
    n = high - low + 1
    if border == "reflect":
        k = f"((({c} - {low}) % {2 * n} + {2 * n}) % {2 * n})"
        return f"(CASE WHEN {k} < {n} THEN {k} ELSE {2 * n - 1} - {k} END + {low})"
    if border == "wrap":
        return f"((({c} - {low}) % {n} + {n}) % {n} + {low})"
    return f"({c})"


def stencil_sql(weights: dict, border: str, source: str = "v3", bounds=t.V3_BOUNDS, name: str = "near") -> str:
    rows = t.values([(*o, float(w)) for o, w in weights.items()], "ox, oy, oz, w")
    folded = " AND ".join(f"s.{c} = {_fold(f'g.{c} + k.o{c}', a, b, border)}" for c, (a, b) in zip("xyz", bounds))
    axes = ", ".join(f"(SELECT CAST(unnest(range({a}, {b + 1})) AS INT) AS {c})" for c, (a, b) in zip("xyz", bounds))
    return f"{name} AS (SELECT g.x, g.y, g.z, k.w, coalesce(s.v, 0.0) AS v, s.v IS NOT NULL AS there FROM (SELECT * FROM {axes}) g CROSS JOIN (SELECT * FROM {rows}) k LEFT JOIN {source} s ON {folded})"


def _weights(spread) -> dict:
    return {(x, y, z): w for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (w := spread(x, y, z))}


_lap = _weights(lambda x, y, z: {0: -6.0, 1: 1.0}.get(abs(x) + abs(y) + abs(z), 0.0))
_smooth = {-1: 0.25, 0: 0.5, 1: 0.25}
_gauss = _weights(lambda x, y, z: _smooth[x] * _smooth[y] * _smooth[z])
_sobels = [_weights(lambda x, y, z, a=a: (x, y, z)[a] * math.prod(2.0 if c == 0 else 1.0 for i, c in enumerate((x, y, z)) if i != a)) for a in range(3)]


def _conv(name: str, weights: dict, border: str):
    add(name, lambda s, d: six(C.convolve(t.volume(s, d), weights, t.V3_BOUNDS, border), "v"), f"WITH {t.V3}, {stencil_sql(weights, border)} SELECT x, y, z, round(sum(v * w), 6) + 0.0 AS v FROM near GROUP BY ALL HAVING bool_or(there)")


_conv("laplace", _lap, "wrap")
_conv("gaussian3", _gauss, "reflect")
add("box_mean", lambda s, d: six(C.box_mean(t.volume(s, d), 3, t.V3_BOUNDS), "v"), f"WITH {t.V3}, {stencil_sql(_weights(lambda x, y, z: 1 / 27), 'reflect')} SELECT x, y, z, round(sum(v * w), 6) AS v FROM near GROUP BY ALL HAVING bool_or(there)")
add("box_median", lambda s, d: C.median_filter(t.volume(s, d), 3, t.V3_BOUNDS), f"WITH {t.V3}, {stencil_sql(_weights(lambda x, y, z: 1.0), 'reflect')} SELECT x, y, z, list_sort(list(v))[14] AS v FROM near GROUP BY ALL")
add("rank_filter", lambda s, d: C.rank_filter(t.volume(s, d), 3, 4, t.V3_BOUNDS, "zero"), f"WITH {t.V3}, {stencil_sql(_weights(lambda x, y, z: 1.0), 'zero')} SELECT x, y, z, list_sort(list(v))[5] AS v FROM near GROUP BY ALL")
add("box_maximum", lambda s, d: C.extreme_filter(t.volume(s, d), 3, t.V3_BOUNDS, True), f"WITH {t.V3}, {stencil_sql(_weights(lambda x, y, z: 1.0), 'reflect')} SELECT x, y, z, max(v) AS v FROM near GROUP BY ALL")
add("box_minimum", lambda s, d: C.extreme_filter(t.volume(s, d), 3, t.V3_BOUNDS, False, "zero"), f"WITH {t.V3}, {stencil_sql(_weights(lambda x, y, z: 1.0), 'zero')} SELECT x, y, z, min(v) AS v FROM near GROUP BY ALL")
_near = ", ".join(stencil_sql(w, "reflect", name=f"n{i}") for i, w in enumerate(_sobels))
add(
    "sobel_mag",
    lambda s, d: six(C.sobel_magnitude(t.volume(s, d), t.V3_BOUNDS), "v"),
    f"WITH {t.V3}, {_near}, parts AS (" + " UNION ALL ".join(f"SELECT x, y, z, sum(v * w) ** 2 AS v FROM n{i} GROUP BY ALL HAVING bool_or(there)" for i in range(3)) + ") SELECT x, y, z, round(sqrt(sum(v)), 6) AS v FROM parts GROUP BY ALL",
)


def _window_sql(window, bounds, source: str, tag: str) -> tuple[str, str]:
    parts, half = [], len(window) // 2
    for i, (a, b) in enumerate(bounds):
        if b > a:
            parts.append(stencil_sql({tuple(k - half if j == i else 0 for j in range(3)): w for k, w in enumerate(window)}, "reflect", source, bounds, f"{tag}n{i}"))
            parts.append(f"{tag}{i} AS (SELECT x, y, z, sum(v * w) AS v FROM {tag}n{i} GROUP BY ALL HAVING bool_or(there))")
            source = f"{tag}{i}"
    return ", ".join(parts), source


_low, _high = C.gaussian_window(0.8), C.gaussian_window(1.2)
_a, _an = _window_sql(_low, t.V2_BOUNDS, "v2", "a")
_b, _bn = _window_sql(_high, t.V2_BOUNDS, "v2", "b")
add("dog", lambda s, d: six(C.difference_of_gaussians(t.image(s, d), 0.8, 1.2, t.V2_BOUNDS), "v"), f"WITH {t.V2}, {_a}, {_b} SELECT x, y, z, round(sum(v), 6) + 0.0 AS v FROM (SELECT * FROM {_an} UNION ALL SELECT x, y, z, -v FROM {_bn}) GROUP BY ALL")
for _name, _window in (("kaiser_filter", C.kaiser_window(5)), ("blob_filter", C.kaiser_window(5, order=2)), ("hamming_filter", C.hamming_window(5))):
    _w, _wn = _window_sql(_window, t.V2_BOUNDS, "v2", "w")
    add(_name, lambda s, d, w=_window: six(C.separable(t.image(s, d), w, t.V2_BOUNDS), "v"), f"WITH {t.V2}, {_w} SELECT x, y, z, round(v, 6) + 0.0 AS v FROM {_wn}")

_cross = {(0, 0, 0): 1.0, **{tuple(s if i == k else 0 for k in range(3)): 1.0 for i in range(3) for s in (-1, 1)}}
_mask = "mk AS (SELECT x, y, z, 1.0 AS v FROM v3 WHERE v > 10)"
_eroded = f"WITH {t.V3}, {_mask}, {stencil_sql(_cross, 'zero', 'mk')}, er AS (SELECT x, y, z FROM near GROUP BY ALL HAVING sum(v) = 7)"


def _core(s, d):
    return t.volume(s, d).where("v > 10")


add("erode", lambda s, d: C.erode(_core(s, d), t.V3_BOUNDS), _eroded + " SELECT x, y, z, 1.0::DOUBLE AS v FROM er")
add("surface_voxels", lambda s, d: C.surface(_core(s, d), t.V3_BOUNDS), _eroded + " SELECT x, y, z FROM mk EXCEPT SELECT x, y, z FROM er")
add(
    "core_mask",
    lambda s, d: C.core_depth(_core(s, d), t.V3_BOUNDS),
    f"WITH {t.V3}, {_mask}, {t.dense_sql('mk', t.V3_BOUNDS)}, hole AS (SELECT x, y, z FROM dense WHERE v = 0) SELECT mk.x, mk.y, mk.z, CAST(least(mk.x, 51 - mk.x, mk.y + 1, 11 - mk.y, mk.z + 1, 9 - mk.z, min(abs(mk.x - h.x) + abs(mk.y - h.y) + abs(mk.z - h.z))) AS DOUBLE) AS v FROM mk, hole h GROUP BY mk.x, mk.y, mk.z",
)
_all = {k: 1.0 for k in _weights(lambda x, y, z: 1.0) if k != (0, 0, 0)}
_dirs = t.values([(*o,) for o in _all], "ox, oy, oz")
add(
    "normal_vectors",
    lambda s, d: six(C.normals(t.volume(s, d), t.volume(s, d).where("v > 16").select("x", "y", "z")), "nx", "ny", "nz"),
    f"WITH {t.V3}, pt AS (SELECT * FROM v3 WHERE v > 16), nb AS (SELECT p.x, p.y, p.z, p.v AS pv, k.*, coalesce(s.v, 0.0) AS v FROM pt p CROSS JOIN (SELECT * FROM {_dirs}) k LEFT JOIN v3 s ON s.x = p.x + ox AND s.y = p.y + oy AND s.z = p.z + oz), "
    "m AS (SELECT x, y, z, sum(CASE WHEN v > pv THEN ox ELSE 0 END) AS a, sum(CASE WHEN v > pv THEN oy ELSE 0 END) AS b, sum(CASE WHEN v > pv THEN oz ELSE 0 END) AS c FROM nb GROUP BY ALL) "
    "SELECT x, y, z, " + ", ".join(f"round(CASE WHEN a * a + b * b + c * c > 0 THEN {p} / sqrt(a * a + b * b + c * c) ELSE 0.0 END, 6) + 0.0 AS n{q}" for p, q in zip("abc", "xyz")) + " FROM m",
)


# tilt filters: numpy closed forms as tables, SQL from the formula
def _rows(array, places: int = 6):
    def query(s, d):
        data = np.asarray(array() if callable(array) else array)
        names = ["i", "j", "k"][: data.ndim]
        return s.createDataFrame([(*map(int, at), round(float(v), places) + 0.0) for at, v in np.ndenumerate(data)], ", ".join([*[f"{n} int" for n in names], "v double"]))

    return query


def _freq(n: int, axis: str) -> str:
    return f"(CASE WHEN {axis} < {(n + 1) // 2} THEN {axis} ELSE {axis} - {n} END / {float(n)})"


_g2 = "g AS (SELECT * FROM (SELECT CAST(unnest(range(0, 16)) AS INT) AS i), (SELECT CAST(unnest(range(0, 20)) AS INT) AS j))"
_f2 = f"f AS (SELECT i, j, sqrt({_freq(16, 'i')} ** 2 + {_freq(20, 'j')} ** 2) AS f FROM g)"
add("bandpass_mask", _rows(lambda: fourier.band_pass((16, 20), 4.0, 12.0)), f"WITH {_g2}, {_f2} SELECT i, j, round(exp(-(f * f) / (2 * (1 / (4.0 * sqrt(2 * ln(2)))) ** 2)) * (1 - exp(-(f * f) / (2 * (1 / (12.0 * sqrt(2 * ln(2)))) ** 2))), 6) + 0.0 AS v FROM f")
add("bandpass_hard", _rows(lambda: fourier.band_pass((16, 20), 4.0, 12.0, soft=False)), f"WITH {_g2}, {_f2} SELECT i, j, CASE WHEN f <= 0.25 AND f >= 1 / 12.0 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM f")
_wave = fourier.electron_wavelength(300e3)
add("ctf_curve", _rows(lambda: fourier.ctf((16, 20), 2.5e4, rate=4.0)), f"WITH {_g2}, {_f2}, c AS (SELECT i, j, f, pi() * {_wave!r} * (f / 4) ** 2 * (25000.0 - 2.7e7 * {_wave!r} ** 2 * (f / 4) ** 2 / 2) + atan(0.07 / sqrt(1 - 0.07 ** 2)) AS chi FROM f) SELECT i, j, round(CASE WHEN f <= 0.5 THEN abs(sin(-chi)) ELSE 0.0 END, 6) + 0.0 AS v FROM c")
_uneven = (-50.0, -20.0, -5.0, 3.5, 30.0, 60.0)
_kinds = ("ram-lak", "ramp-cont", "ramp", "shepp-logan", "cosine", "hamming")
add("reconstruction_filter", _rows(lambda: np.stack([fourier.reconstruction_filter(24, k, angles=_uneven) for k in _kinds])), f"""WITH g AS (SELECT CAST(unnest(range(0, 24)) AS INT) AS j), f AS (SELECT j, abs({_freq(24, 'j')}) AS f FROM g),
 o AS (SELECT least(k, 24 - k) AS d, k FROM (SELECT unnest(range(1, 24, 2)) AS k)), a AS (SELECT unnest([{', '.join(map(repr, _uneven))}]) AS a), step AS (SELECT min(d) AS d FROM (SELECT a - lag(a) OVER (ORDER BY a) AS d FROM a))
 SELECT 0 AS i, j, round(2 * f, 6) AS v FROM f UNION ALL SELECT 1, j, round(2 * (0.25 - sum(cos(2 * pi() * j * k / 24) / (pi() * d) ** 2)), 6) + 0.0 FROM f, o GROUP BY j
 UNION ALL SELECT 2, j, round(least(1.0, f * 24 * radians(d)), 6) FROM f, step
 UNION ALL SELECT 3, j, round(2 * f * CASE WHEN f = 0 THEN 1 ELSE sin(pi() * f) / (pi() * f) END, 6) FROM f UNION ALL SELECT 4, j, round(2 * f * cos(pi() * f), 6) + 0.0 FROM f UNION ALL SELECT 5, j, round(2 * f * (0.54 + 0.46 * cos(2 * pi() * f)), 6) FROM f""")
_k8 = f"g AS (SELECT * FROM (SELECT CAST(unnest(range(0, 8)) AS INT) AS p), (SELECT CAST(unnest(range(0, 8)) AS INT) AS q)), k AS (SELECT sqrt({_freq(8, 'p')} ** 2 + {_freq(8, 'q')} ** 2) AS k FROM g), t AS (SELECT * FROM (VALUES (0, -40e0, 1e0), (1, 0e0, 2e0), (2, 40e0, 3e0)) AS t(j, a, d))"
add(
    "tilt_weights",
    _rows(lambda: np.stack([fourier.tilt_weights(k, (8, 8), (-40, 0, 40), (1.0, 2.0, 3.0)).mean((1, 2)) for k in fourier.WEIGHTS])),
    f"""WITH {_k8} SELECT 0 AS i, j, 1e0 AS v FROM t UNION ALL SELECT 1, j, round(cos(radians(a)), 6) FROM t
 UNION ALL SELECT 2, j, round(avg(exp(-2 * pi() ** 2 * (d * 4 / (8 * pi() ** 2)) * k ** 2)) * cos(radians(any_value(a))), 6) FROM t, k GROUP BY j
 UNION ALL SELECT 3, j, round(avg(CASE WHEN k > 0 THEN exp(-d / (2 * (0.245 * k ** -1.665 + 2.81))) ELSE 1.0 END), 6) FROM t, k GROUP BY j""",
)
_g12 = "g AS (SELECT * FROM " + ", ".join(f"(SELECT CAST(unnest(range(0, 12)) AS INT) AS {c})" for c in "ijk") + ")"
_f12 = f"f AS (SELECT i, j, k, {_freq(12, 'i')} AS depth, {_freq(12, 'j')} AS side, {_freq(12, 'k')} AS along FROM g)"
add("wedge_mask", _rows(lambda: fourier.continuous_wedge((12, 12, 12), 50, 50)), f"WITH {_g12}, {_f12} SELECT i, j, k, CASE WHEN sqrt(depth ** 2 + side ** 2 + along ** 2) <= 0.5 AND (depth = 0 OR degrees(atan2(depth * CASE WHEN side < 0 THEN -1 ELSE 1 END, abs(side))) BETWEEN -50 AND 50) THEN 1e0 ELSE 0e0 END AS v FROM f")
add("step_wedge_mask", _rows(lambda: fourier.step_wedge((12, 12, 12), range(-60, 61, 20))), f"WITH {_g12}, {_f12}, a AS (SELECT radians(unnest(range(-60, 61, 20))) AS a) SELECT i, j, k, CASE WHEN min(abs(depth * cos(a) - side * sin(a))) * 12 <= 0.5 + 1e-9 THEN 1e0 ELSE 0e0 END AS v FROM f, a GROUP BY i, j, k")


# dense blocks
def _arrays(template):
    r = max(max(map(abs, p[:3])) for p in template.points)
    g, m = np.zeros((2 * r + 1,) * 3), np.zeros((2 * r + 1,) * 3)
    for x, y, z, v, w in template.points:
        g[x + r, y + r, z + r], m[x + r, y + r, z + r] = v, w
    return g, m


def _fft(score: str, template=t.TEMPLATE):
    def query(s, d):
        g, m = _arrays(template)
        volume = t.volume(s, d)
        blocks = G.to_blocks(G.wrap_faces(volume, t.V3_BOUNDS) if score == "LCC" else volume, 16, 4)
        rotations = np.array(t.ROTATIONS, float).reshape(-1, 3, 3)
        return _shown(D.match_blocks(blocks, g, m, rotations, 4, score, -1e9, bounds=t.V3_BOUNDS), "tx", "ty", "tz")

    return query


def _shown(scores, *keys):
    """Scores to four digits, moved off the ties of rounding; the sparse form has no rows without a contribution."""
    return scores.select(*keys, (F.round(F.round("s", 6) + 3e-7, 4) + 0.0).alias("s")).where("s <> 0")


def _fft_sql(source: str, keys: str = "tx, ty, tz", rotations: int = len(t.ROTATIONS)) -> str:
    """Best score of every position from the sparse form's SQL; rotations without a contribution score 0."""
    best = f"SELECT {keys}, CASE WHEN count(*) < {rotations} THEN greatest(max(s), 0.0) ELSE max(s) END AS s FROM ({source}) GROUP BY ALL"
    return f"SELECT {keys}, round(s + 3e-7, 4) + 0.0 AS s FROM ({best}) WHERE round(s + 3e-7, 4) <> 0"


for _name, _score in (("fft_score", "CC"), ("fft_lcc", "LCC"), ("fft_corr", "CORR"), ("fft_cam", "CAM"), ("fft_flc", "FLC"), ("fft_mcc", "MCC")):
    add(_name, _fft(_score), _fft_sql(MATCHING_SQL[_name.replace("fft_score", "cc").replace("fft_", "")]))


# a mask that no rotation changes, as this score wants
_value = {p[:3]: p[3] for p in t.TEMPLATE.points}
_ball = S.Template(tuple((x, y, z, float(_value.get((x, y, z), 0.0)), 1.0) for x in range(-2, 3) for y in range(-2, 3) for z in range(-2, 3) if x * x + y * y + z * z <= 4), 125)
_ball_sql = f"WITH {t.V3}, {t.expansion_sql(_ball.standardised(), t.ROTATIONS)}, {t.placed_sql('v3', t.V3_BOUNDS)}, sums AS (SELECT tx, ty, tz, r, sum(v * g) AS fg, sum(v * m) AS fm, sum(v * v * m) AS f2m FROM placed GROUP BY ALL)"
_ball_std = f"sqrt(greatest(0.0, f2m / {_ball.mass} - (fm / {_ball.mass}) ** 2))"
add("fft_flc_spherical", _fft("FLCSphericalMask", _ball), _fft_sql(f"{_ball_sql} SELECT tx, ty, tz, r, round(fg / (CASE WHEN {_ball_std} < 1.1920929e-07 THEN 1.0 ELSE {_ball_std} END * {_ball.mass}), 6) + 0.0 AS s FROM sums"))


def _fft_batch(score: str):
    def query(s, d):
        g, m = _arrays(t.FLAT)
        image = t.image(s, d, ("event_type",))
        blocks = G.to_blocks(image, 16, 4, keys=("event_type",))
        return _shown(D.match_blocks(blocks, g, m, np.eye(3)[None], 4, score, -1e9, bounds=t.V2_BOUNDS, keys=("event_type",)), "event_type", "tx", "ty", "tz")

    return query


for _name, _score in (("fft_batch_flc", "batchFLC"), ("fft_batch_flc_spherical", "batchFLCSpherical")):
    add(_name, _fft_batch(_score), _fft_sql(MATCHING_SQL["batch_flc"], "event_type, tx, ty, tz", 1))


def _seeded(s, d):
    g, m = _arrays(t.TEMPLATE)
    seeds = t.volume(s, d).where("v > 16").select("x", "y", "z", *[F.lit(float(c)).alias(f"m{i}") for i, c in enumerate((1, 0, 0, 0, 1, 0, 0, 0, 1))])
    rotations = np.array(t.ROTATIONS, float).reshape(-1, 3, 3)
    found = D.match_blocks(G.to_blocks(t.volume(s, d), 16, 4), g, m, rotations, 4, "CC", -1e9, bounds=t.V3_BOUNDS, seeds=seeds, radius=2.0, cone=30.0, group=7)
    return found.select("tx", "ty", "tz", F.round("s", 4).alias("s"))


_upright = ", ".join(str(r) for r, c in enumerate(t.ROTATIONS) if c[8] == 1)
add("fft_constrained", _seeded, f"""WITH {t.V3}, cc AS (SELECT tx, ty, tz, s FROM ({MATCHING_SQL['cc']}) WHERE r IN ({_upright})),
 near AS (SELECT DISTINCT g.x AS tx, g.y AS ty, g.z AS tz FROM v3 p, (SELECT * FROM (SELECT CAST(unnest(range(1, 51)) AS INT) AS x), (SELECT CAST(unnest(range(0, 11)) AS INT) AS y), (SELECT CAST(unnest(range(0, 9)) AS INT) AS z)) g
  WHERE p.v > 16 AND (g.x - p.x) ** 2 + (g.y - p.y) ** 2 + (g.z - p.z) ** 2 <= 4)
 SELECT tx, ty, tz, round(CASE WHEN count(s) < {_upright.count(',') + 1} THEN greatest(coalesce(max(s), 0.0), 0.0) ELSE max(s) END, 4) AS s FROM near LEFT JOIN cc USING (tx, ty, tz) GROUP BY ALL""")
add("bandpass_energy", lambda s, d: G.from_blocks(D.filter_blocks(G.to_blocks(t.volume(s, d), 64), fourier.band_pass((64, 64, 64), 3.0))).agg(F.round(F.sum("v"), 3).alias("total")), f"WITH {t.V3} SELECT round(sum(v), 3) AS total FROM v3")
