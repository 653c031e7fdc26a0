"""Further queries: pose scores of filtered volumes, resampling, merged peaks, tilt filters, fits, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rotogrid.functions import fourier
from rotogrid.operators import grid as G
from rotogrid.operators import lines as L
from rotogrid.operators import masks as M
from rotogrid.operators import peaks as P
from rotogrid.operators import postprocess as Pp
from rotogrid.operators import refine as R
from rotogrid.operators import score as S
from rotogrid.operators import stencil as C
from rotogrid.plans import tables as t
from rotogrid.plans.matching import IDENTITY, _ball, _cube, _first, _lap_points, _lap_tpl, _m2r, greedy_sql, six
from rotogrid.plans.structures import _POINTS, _poses
from rotogrid.plans.volumes import _rows, _window_sql

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_corners = ((3.0, 2.0), (15.0, 4.0), (12.0, 16.0), (5.0, 12.0))
_cross = " + ".join(f"CASE WHEN y >= {min(b, d)}::DOUBLE AND y < {max(b, d)}::DOUBLE AND x < (y - {b}::DOUBLE) / {d - b}::DOUBLE * {c - a}::DOUBLE + {a}::DOUBLE THEN 1 ELSE 0 END" for (a, b), (c, d) in zip(_corners, (*_corners[1:], _corners[0])))
add("shape_mask", lambda s, d: M.create_mask(s, "polygon", shape=(20, 20, 4), corners=_corners), f"WITH g AS (SELECT * FROM (SELECT CAST(unnest(range(0, 20)) AS INT) AS x), (SELECT CAST(unnest(range(0, 20)) AS INT) AS y), (SELECT CAST(unnest(range(0, 4)) AS INT) AS z)) SELECT x, y, z, 1.0::DOUBLE AS v FROM g WHERE ({_cross}) % 2 = 1")
_g, _gn = _window_sql(C.gaussian_window(1.0), t.V2_BOUNDS, "hard", "g")
add("lowpass_mask", lambda s, d: C.lowpass_mask(t.image(s, d), t.V2_BOUNDS), f"WITH {t.V2}, hard AS (SELECT x, y, z, 1.0 AS v FROM v2, (SELECT max(v) AS m FROM v2) WHERE v / m > exp(-2)), {_g} SELECT x, y, z, 1.0::DOUBLE AS v FROM {_gn} WHERE v > exp(-2)")
add("resample_volume", lambda s, d: six(C.resample(t.volume(s, d), t.V3_BOUNDS, 1.6), "v"), f"""WITH {t.V3}, k AS (SELECT * FROM (SELECT CAST(unnest(range(0, 31)) AS INT) AS i), (SELECT CAST(unnest(range(0, 7)) AS INT) AS j), (SELECT CAST(unnest(range(0, 6)) AS INT) AS l)),
 w AS (SELECT i AS x, j AS y, l AS z, v * (1 - abs(i * 1.6e0 + 1 - v3.x)) * (1 - abs(j * 1.6e0 - v3.y)) * (1 - abs(l * 1.6e0 - v3.z)) AS v FROM k, v3 WHERE abs(i * 1.6e0 + 1 - v3.x) < 1 AND abs(j * 1.6e0 - v3.y) < 1 AND abs(l * 1.6e0 - v3.z) < 1) SELECT x, y, z, round(sum(v), 6) AS v FROM w GROUP BY ALL""")
_m2 = f"WITH {t.V2}, m2 AS (SELECT x AS tx, y AS ty, z AS tz, v AS s FROM v2)"


def _map2(s, d):
    return t.image(s, d).select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("v").alias("s"))


def _top_poses(s, d):
    """Every local maximum of the volume."""
    best = P.maximum_filter(t.volume(s, d).select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("v").alias("s")), 3, t.V3_BOUNDS)
    return best.select(F.expr("tx * 1000 + ty * 10 + tz").cast("bigint").alias("pose_id"), "tx", "ty", "tz")


add("merge_peaks", lambda s, d: P.merge(_map2(s, d).where("tx <= 16"), _map2(s, d).where("tx >= 14"), distance=3.0, n=30), f"{_m2r}, {greedy_sql('SELECT * FROM m2', _ball.format(9), _first.format(30))}")
add("local_maxima", lambda s, d: P.local_maxima(_map2(s, d), 2, t.V2_BOUNDS, 30, 8.0), f"{_m2r}, {greedy_sql(f'SELECT * FROM m2 a WHERE s >= 8 AND tx BETWEEN {t.V2_BOUNDS[0][0] + 2} AND {t.V2_BOUNDS[0][1] - 2} AND ty BETWEEN {t.V2_BOUNDS[1][0] + 2} AND {t.V2_BOUNDS[1][1] - 2} AND NOT EXISTS (SELECT 1 FROM m2 b WHERE a.tx - b.tx BETWEEN -2 AND 2 AND a.ty - b.ty BETWEEN -2 AND 2 AND b.s > a.s)', _cube.format(2), _first.format(30))}")
add("laplace_cc_at_pose", lambda s, d: six(R.pose_scores(S.laplacian(t.volume(s, d), t.V3_BOUNDS), _poses(s, d), [(*p[:3], p[3]) for p in S.laplacian_template(t.TEMPLATE, (5, 5, 5)).points], "CrossCorrelation"), "s"), f"WITH {t.V3}, {t.expansion_sql(_lap_points, (IDENTITY,), 'lp')}, {t.placed_sql('v3', t.V3_BOUNDS, tpl='lp', wrap=True, name='lapped')}, lap AS (SELECT tx AS x, ty AS y, tz AS z, sum(v * g) AS v FROM lapped GROUP BY ALL), pt AS (SELECT * FROM {t.values([p[:4] for p in _lap_tpl.points], 'ox, oy, oz, w')}) SELECT CAST(p.x * 1000 + p.y * 10 + p.z AS BIGINT) AS pose_id, round(sum(w * coalesce(s.v, 0.0)), 6) + 0.0 AS s FROM v3 p CROSS JOIN pt LEFT JOIN lap s ON s.x = p.x + ox AND s.y = p.y + oy AND s.z = p.z + oz WHERE p.v > 15 GROUP BY 1")
add("extreme_poses", lambda s, d: six(R.pose_scores(t.volume(s, d), _top_poses(s, d), _POINTS, "NormalizedCrossCorrelationMean"), "s"), f"WITH {t.V3}, b AS (SELECT * FROM v3 a WHERE NOT EXISTS (SELECT 1 FROM v3 n WHERE abs(n.x - a.x) <= 1 AND abs(n.y - a.y) <= 1 AND abs(n.z - a.z) <= 1 AND n.v > a.v)), pt AS (SELECT * FROM {t.values(_POINTS, 'ox, oy, oz, w')}), sm AS (SELECT CAST(p.x * 1000 + p.y * 10 + p.z AS BIGINT) AS pose_id, w, coalesce(s.v, 0.0) AS v FROM b p CROSS JOIN pt LEFT JOIN v3 s ON s.x = p.x + ox AND s.y = p.y + oy AND s.z = p.z + oz) SELECT pose_id, round(CASE WHEN sqrt(greatest(0.0, sum(w * w) - sum(w) ** 2 / count(*))) * sqrt(greatest(0.0, sum(v * v) - sum(v) ** 2 / count(*))) > 1e-9 THEN (sum(w * v) - sum(w) * sum(v) / count(*)) / (sqrt(greatest(0.0, sum(w * w) - sum(w) ** 2 / count(*))) * sqrt(greatest(0.0, sum(v * v) - sum(v) ** 2 / count(*)))) ELSE 0.0 END, 6) + 0.0 AS s FROM sm GROUP BY 1")
add("ctf_stack", _rows(lambda: fourier.ctf_stack((12, 12, 12), [2e4], (-30, 0, 30), gradient=True, rate=4.0)))
add("tilt_series_filter", _rows(lambda: fourier.tilt_filters((12, 12, 12), range(-60, 61, 10), 4.0, np.arange(13) * 2.0, "grigorieff", 2e4, low=12.0)))
add("scramble_phases", lambda s, d: six(L.scramble_phases(t.volume(s, d), t.V3_BOUNDS), "v"))
add("local_gaussian", lambda s, d: six(L.local_gaussian(t.volume(s, d), t.V3_BOUNDS, 1.0), "v"))
add("edge_gaussian", lambda s, d: six(L.edge_gaussian(t.volume(s, d), t.V3_BOUNDS, "sobel", 1.0), "v"))


def _fit(s, d):
    v = t.volume(s, d)
    moved = v.select(*[(F.col(a) - k).alias(a) for a, k in zip("xyz", (2, 1, 1))], "v")
    x, best = R.match_volumes(v, moved)
    return s.createDataFrame([(i, round(float(c), 2) + 0.0) for i, c in enumerate([*x[:3], best])], "i int, value double")


add("match_volumes", _fit, "SELECT * FROM (VALUES (0, 2e0), (1, 1e0), (2, 1e0), (3, 1e0)) AS t(i, value)")


def _aligned(s, d):
    """Sub-volumes of the best picks, each turned back by its own rotation, and averaged."""
    v = t.volume(s, d)
    best = P.top(S.match_template(v, t.TEMPLATE, "CC", t.ROTATIONS, t.V3_BOUNDS), 30)
    picks = best.select(F.expr("tx * 1000 + ty * 10 + tz").cast("bigint").alias("pick_id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"), "r")
    cut = Pp.extract(v, picks, (5, 5, 5)).join(picks.select("pick_id", "r"), "pick_id")
    turned = s.createDataFrame([(r, [int(c) for c in m]) for r, m in enumerate(t.ROTATIONS)], "r int, m array<int>")
    rows = cut.join(F.broadcast(turned), "r")  # a row per rotation
    o = [F.col(f"d{a}") - 2 for a in "xyz"]
    back = [sum(F.col("m")[j * 3 + i] * o[j] for j in range(3)) + 2 for i in range(3)]
    return Pp.average(rows.select("pick_id", *[b.cast("int").alias(f"d{a}") for b, a in zip(back, "xyz")], "v"), 30)


_best = f"WITH {t.V3}, {t.expansion_sql(t.TEMPLATE, t.ROTATIONS)}, {t.placed_sql('v3', t.V3_BOUNDS)}, cc AS (SELECT tx, ty, tz, r, sum(v * g) AS s FROM placed GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz ORDER BY s DESC, r) AS k FROM cc) WHERE k = 1 ORDER BY s DESC, tx, ty, tz LIMIT 30)"
_rot = t.values([(r, *m) for r, m in enumerate(t.ROTATIONS)], "r, " + ", ".join(f"m{i}" for i in range(9)))
add("align_subtomos", lambda s, d: six(_aligned(s, d), "v"), _best + f", ex AS (SELECT b.r, s.x - b.tx AS ox, s.y - b.ty AS oy, s.z - b.tz AS oz, s.v FROM b, v3 s WHERE s.x - b.tx BETWEEN -2 AND 2 AND s.y - b.ty BETWEEN -2 AND 2 AND s.z - b.tz BETWEEN -2 AND 2) SELECT CAST(m0*ox + m3*oy + m6*oz + 2 AS INT) AS dx, CAST(m1*ox + m4*oy + m7*oz + 2 AS INT) AS dy, CAST(m2*ox + m5*oy + m8*oz + 2 AS INT) AS dz, round(sum(v) / 30, 6) AS v FROM ex JOIN (SELECT * FROM {_rot}) k ON ex.r = k.r GROUP BY ALL")


def _extent(s, d):
    best = G.diameter(t.image(s, d))
    return s.createDataFrame([(round(best[0], 6),)], "distance double")


add("pairwise_extremes", _extent, f"WITH {t.V2} SELECT round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)), 6) AS distance FROM v2 a, v2 b")
