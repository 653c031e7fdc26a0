"""Queries of scans, boxes, scores, analyzers and peaks, and their SQL."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from rotogrid.functions.lattice import IDENTITY, rotate_offset
from rotogrid.operators import aggregate as A
from rotogrid.operators import grid as G
from rotogrid.operators import peaks as P
from rotogrid.operators import score as S
from rotogrid.plans import tables as t

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def six(df, *columns):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


XYZ = "x, y, z"
# scans and rasters
add("rasterize_volume", t.volume, f"WITH {t.V3} SELECT * FROM v3")
add("rasterize_image", t.image, f"WITH {t.V2} SELECT * FROM v2")
add("rasterize_signal", t.signal, f"WITH {t.V1} SELECT * FROM v1")
add("embedding_to_volume", t.stack, f"WITH {t.E4} SELECT * FROM e4")
add("pointcloud_threshold", lambda s, d: G.point_cloud(t.volume(s, d), 12), f"WITH {t.V3} SELECT x, y, z FROM v3 WHERE v > 12")
add("volume_stats", lambda s, d: six(A.stats(t.volume(s, d), 50 * 11 * 9), "mean", "std"), f"WITH {t.V3}, {t.dense_sql('v3', t.V3_BOUNDS)} SELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, max(v) AS max FROM dense")
add("atom_table", lambda s, d: t.atoms(s, d).groupBy("chain", "element_symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx")), f"WITH {t.ATOMS} SELECT chain, element_symbol, count(*) AS n, sum(x) AS sx FROM atoms GROUP BY 1, 2")
# boxes
add("adjust_box", lambda s, d: G.crop(t.volume(s, d), [(-2, 20), (3, 12), (0, 4)]), f"WITH {t.V3} SELECT x + 2 AS x, y - 3 AS y, z AS z, v FROM v3 WHERE x BETWEEN -2 AND 20 AND y BETWEEN 3 AND 12 AND z BETWEEN 0 AND 4")
add("pad_center", lambda s, d: G.pad(t.volume(s, d), (50, 11, 9), (64, 16, 6)), f"WITH {t.V3} SELECT x + 7 AS x, y + 2 AS y, z - 2 AS z, v FROM v3 WHERE x + 7 BETWEEN 0 AND 63 AND y + 2 BETWEEN 0 AND 15 AND z - 2 BETWEEN 0 AND 5")
add("trim_box", lambda s, d: G.trim_bounds(t.volume(s, d), 22, 2, t.V3_BOUNDS), f"WITH {t.V3} SELECT greatest(min(x) - 2, 1) AS low_x, least(max(x) + 2, 50) AS high_x, greatest(min(y) - 2, 0) AS low_y, least(max(y) + 2, 10) AS high_y, greatest(min(z) - 2, 0) AS low_z, least(max(z) + 2, 8) AS high_z FROM v3 WHERE v > 22 HAVING count(*) > 0")
add("enclosing_edge", lambda s, d: G.enclosing_edge(t.volume(s, d), 14), f"WITH {t.V3}, c AS (SELECT * FROM v3 WHERE v > 14), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM c) SELECT CAST(ceil(2 * sqrt(max((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2))) + 1 AS BIGINT) AS edge FROM c, m")
add("density_boundary", lambda s, d: G.boundary_levels(t.volume(s, d), 400), f"WITH {t.V3}, f AS (SELECT v, sum(count(*)) OVER (ORDER BY v DESC) AS upto FROM v3 GROUP BY v) SELECT max(CASE WHEN upto >= 400 THEN v END) AS upper, max(CASE WHEN upto >= 440 THEN v END) AS lower FROM f")
_valid = t.bounds_sql([(3, 48), (2, 8), (2, 6)], ("x", "y", "z"))
add("conv_mode_valid", lambda s, d: t.volume(s, d).where(G.inside([(low + a, b + low) for (a, b), (low, _) in zip(G.convolution_bounds((50, 11, 9), (5, 5, 5), "valid"), t.V3_BOUNDS)])), f"WITH {t.V3} SELECT * FROM v3 WHERE {_valid}")
add("fourier_roll", lambda s, d: G.roll(t.volume(s, d), (-3, 4, 20), (50, 11, 9)), f"WITH {t.V3} SELECT CAST((x - 3 + 50) % 50 AS INT) AS x, CAST((y + 4) % 11 AS INT) AS y, CAST((z + 20) % 9 AS INT) AS z, v FROM v3")
add("bin_volume", lambda s, d: G.bin_voxels(t.volume(s, d), 3), f"WITH {t.V3} SELECT CAST(x // 3 AS INT) AS x, CAST(y // 3 AS INT) AS y, CAST(z // 3 AS INT) AS z, sum(v) AS v FROM v3 GROUP BY 1, 2, 3")
add("extraction_boxes", lambda s, d: G.extraction_boxes(t.volume(s, d).where("v > 15"), (50, 11, 9), (5, 4, 3)), f"""WITH {t.V3} SELECT *, greatest(x - 2, 0) AS start_x, least(x + 3, 50) AS stop_x, greatest(y - 2, 0) AS start_y, least(y + 2, 11) AS stop_y, greatest(z - 1, 0) AS start_z, least(z + 2, 9) AS stop_z,
 (x - 2 >= 0 AND x + 3 <= 50 AND y - 2 >= 0 AND y + 2 <= 11 AND z - 1 >= 0 AND z + 2 <= 9) AS whole FROM v3 WHERE v > 15""")
add("split_tiles", lambda s, d: G.assign_tiles(t.volume(s, d), (16, 6, 9), (2, 1, 0), (1, 0, 0)), f"""WITH {t.V3} SELECT v3.*, CAST(a.k AS INT) AS tile_x, CAST(b.k AS INT) AS tile_y, CAST(0 AS INT) AS tile_z FROM v3, (SELECT unnest(range(-1, 6)) AS k) a, (SELECT unnest(range(-1, 4)) AS k) b
 WHERE x - 1 BETWEEN a.k * 16 - 2 AND a.k * 16 + 17 AND y BETWEEN b.k * 6 - 1 AND b.k * 6 + 6""")
add("blocks_round_trip", lambda s, d: G.from_blocks(G.to_blocks(t.volume(s, d), 16)), f"WITH {t.V3} SELECT * FROM v3")

# scores
_STD = "CASE WHEN sqrt(greatest(0.0, f2m / {n} - (fm / {n}) ** 2)) < 1.1920929e-07 THEN 1.0 ELSE sqrt(greatest(0.0, f2m / {n} - (fm / {n}) ** 2)) END * {n}"
_SUMS = "sums AS (SELECT {k}tx, ty, tz, r, sum(v * g) AS fg, sum(v * m) AS fm, sum(v * v * m) AS f2m FROM placed GROUP BY ALL)"


def _score(name, **options):
    def query(s, d):
        return six(S.SCORES[name](t.volume(s, d), t.TEMPLATE, t.ROTATIONS, t.V3_BOUNDS, **options), "s")

    return query


_ready = t.TEMPLATE.standardised()
_flc = f"WITH {t.V3}, {t.expansion_sql(_ready, t.ROTATIONS)}, {t.placed_sql('v3', t.V3_BOUNDS)}, {_SUMS.format(k='')} "
add("cc", _score("CC"), f"WITH {t.V3}, {t.expansion_sql(t.TEMPLATE, t.ROTATIONS)}, {t.placed_sql('v3', t.V3_BOUNDS)} SELECT tx, ty, tz, r, round(sum(v * g), 6) AS s FROM placed GROUP BY ALL")
_lap_points = S.Template(((0, 0, 0, -6.0, 1.0), *((*(s if i == k else 0 for k in range(3)), 1.0, 1.0) for i in range(3) for s in (-1, 1))))
_lap_tpl = S.laplacian_template(t.TEMPLATE, (5, 5, 5))
add(
    "lcc",
    lambda s, d: six(S.local_correlate(t.volume(s, d), t.TEMPLATE, t.ROTATIONS, t.V3_BOUNDS, edge=(5, 5, 5)), "s"),
    f"WITH {t.V3}, {t.expansion_sql(_lap_points, (IDENTITY,), 'lp')}, {t.placed_sql('v3', t.V3_BOUNDS, tpl='lp', wrap=True, name='lapped')}, lap AS (SELECT tx AS x, ty AS y, tz AS z, sum(v * g) AS v FROM lapped GROUP BY ALL HAVING sum(v * g) <> 0), "
    f"{t.expansion_sql(_lap_tpl, t.ROTATIONS)}, {t.placed_sql('lap', t.V3_BOUNDS)} SELECT tx, ty, tz, r, round(sum(v * g), 6) AS s FROM placed GROUP BY ALL",
)


def _corr_sql(template, source):
    below = f"sqrt(greatest(0.0, (f2m - fm ** 2 / {template.volume}) * {template.squared_deviation()!r}))"
    return f"SELECT tx, ty, tz, r, round(CASE WHEN {below} > 1.1920929e-07 THEN (fg - {template.moments()[0]!r} * fm) / {below} ELSE 0.0 END, 6) + 0.0 AS s FROM sums"


add("corr", _score("CORR"), f"WITH {t.V3}, {t.expansion_sql(t.TEMPLATE, t.ROTATIONS)}, {t.placed_sql('v3', t.V3_BOUNDS)}, {_SUMS.format(k='')} {_corr_sql(t.TEMPLATE, 'v3')}")
_mean = sum(p[3] for p in t.TEMPLATE.points) / 125
_dev = math.sqrt(sum(p[3] ** 2 for p in t.TEMPLATE.points) / 125 - _mean**2)
_cam = S.Template(tuple((*p[:3], (p[3] - _mean) / _dev, p[4]) for p in t.TEMPLATE.points), 125)
add("cam", _score("CAM"), f"WITH {t.V3}, {t.dense_sql('v3', t.V3_BOUNDS)}, st AS (SELECT avg(v) AS a, stddev_pop(v) AS b FROM dense), scaled AS (SELECT x, y, z, (v - a) / b AS v FROM dense, st), {t.expansion_sql(_cam, t.ROTATIONS)}, {t.placed_sql('scaled', t.V3_BOUNDS)}, {_SUMS.format(k='')} {_corr_sql(_cam, 'scaled')}")
add("flc", _score("FLC"), _flc + f"SELECT tx, ty, tz, r, round(fg / ({_STD.format(n=6.0)}), 6) + 0.0 AS s FROM sums")
add(
    "flc_spherical",
    _score("FLCSphericalMask"),
    _flc + f"SELECT a.tx, a.ty, a.tz, a.r, round(a.fg / coalesce(b.below, 6.0), 6) + 0.0 AS s FROM sums a LEFT JOIN (SELECT tx, ty, tz, {_STD.format(n=6.0)} AS below FROM ("
    + f"WITH {t.expansion_sql(_ready, (IDENTITY,), 'one')}, {t.placed_sql('v3', t.V3_BOUNDS, tpl='one', name='p1')} SELECT tx, ty, tz, sum(v * m) AS fm, sum(v * v * m) AS f2m FROM p1 GROUP BY ALL)) b ON a.tx = b.tx AND a.ty = b.ty AND a.tz = b.tz",
)
add(
    "mcc",
    _score("MCC"),
    f"""WITH {t.V3}, {t.dense_sql('v3', t.V3_BOUNDS)}, {t.expansion_sql(t.TEMPLATE, t.ROTATIONS)}, {t.placed_sql('dense', t.V3_BOUNDS)},
 sums AS (SELECT tx, ty, tz, r, sum(v * g * m) AS fg, sum(v * m) AS fm, sum(v * v * m) AS f2m, sum(m) AS tm, sum(g * m) AS tg, sum(g * m * g) AS tg2 FROM placed GROUP BY ALL),
 two AS (SELECT *, fg - fm * tg / greatest(tm, 1.1920929e-07) AS up, sqrt(greatest(0.0, f2m - fm ** 2 / greatest(tm, 1.1920929e-07)) * greatest(0.0, tg2 - tg ** 2 / greatest(tm, 1.1920929e-07))) AS below FROM sums),
 three AS (SELECT *, max(below) OVER (PARTITION BY r) AS mb, max(tm) OVER (PARTITION BY r) AS mt FROM two)
 SELECT tx, ty, tz, r, round(CASE WHEN tm < 0.3 * mt THEN 0.0 ELSE greatest(-1.0, least(1.0, up / CASE WHEN below < 1e3 * 1.1920929e-07 * mb THEN 1.0 ELSE below END)) END, 6) + 0.0 AS s FROM three""",
)
_flat = t.FLAT.standardised()
_batch = f"WITH {t.V2K}, {t.expansion_sql(_flat, (IDENTITY,))}, {t.placed_sql('v2k', t.V2_BOUNDS, 'event_type')}, {_SUMS.format(k='event_type, ')} SELECT event_type, tx, ty, tz, r, round(fg / ({_STD.format(n=5.0)}), 6) + 0.0 AS s FROM sums"
for _name, _registered in (("batch_flc", "batchFLC"), ("batch_flc_spherical", "batchFLCSpherical")):
    add(_name, lambda s, d, k=_registered: six(S.SCORES[k](t.image(s, d, ("event_type",)), t.FLAT, (IDENTITY,), t.V2_BOUNDS, ("event_type",)), "s"), _batch)

# analyzers
_cc = f"WITH {t.V3}, {t.expansion_sql(t.TEMPLATE, t.ROTATIONS)}, {t.placed_sql('v3', t.V3_BOUNDS)}, cc AS (SELECT tx, ty, tz, r, sum(v * g) AS s FROM placed GROUP BY ALL)"
_best = _cc + ", best AS (SELECT tx, ty, tz, s, r FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz ORDER BY s DESC, r) AS k FROM cc) WHERE k = 1)"


def _scores(s, d):
    return S.correlate(t.volume(s, d), t.TEMPLATE, t.ROTATIONS, t.V3_BOUNDS)


def _best_map(s, d):
    return A.best_products(t.volume(s, d), t.TEMPLATE, t.ROTATIONS, t.V3_BOUNDS)


add("max_over_rotations", lambda s, d: P.top(_best_map(s, d), 100), _best + " SELECT * FROM best ORDER BY s DESC, tx, ty, tz LIMIT 100")
add("best_map", _best_map, _best + " SELECT * FROM best")
add("best_map_of_scores", lambda s, d: A.best_over_rotations(_scores(s, d)), _best + " SELECT * FROM best")
add("score_threshold", lambda s, d: A.best_over_rotations(_scores(s, d), threshold=150.0), _best + " SELECT * FROM best WHERE s > 150")
add("max_over_translations", lambda s, d: A.best_over_translations(_scores(s, d), ("tz",)), _cc + " SELECT r, tz, max(s) AS s FROM cc GROUP BY ALL")
add("merge_tiles", lambda s, d: A.merge_best(*[A.best_over_rotations(S.correlate(t.volume(s, d), t.TEMPLATE, t.ROTATIONS, [part, *t.V3_BOUNDS[1:]])) for part in ((1, 30), (20, 50))]), _best + " SELECT * FROM best")


def _constrained(s, d):
    seeds = t.volume(s, d).where("v > 16").select(F.expr("x * 1000 + y * 10 + z").alias("seed_id"), "x", "y", "z", *[F.lit(float(m)).alias(f"m{i}") for i, m in enumerate(IDENTITY)])
    reach = max(math.dist(p[:3], (0, 0, 0)) for p in t.POINTS)
    scores = S.correlate(A.near_seeds(t.volume(s, d), seeds, 2.0 + reach), t.TEMPLATE, t.ROTATIONS, t.V3_BOUNDS)
    return A.best_over_rotations(A.constrained(scores, seeds, t.ROTATIONS, 30.0, 2.0))


_upright = [r for r, m in enumerate(t.ROTATIONS) if m[8] == 1]
add("constrained_cone", _constrained, _cc + f", near AS (SELECT DISTINCT cc.* FROM cc, v3 WHERE v3.v > 16 AND (tx - x) ** 2 + (ty - y) ** 2 + (tz - z) ** 2 <= 4 AND r IN ({', '.join(map(str, _upright))})) SELECT tx, ty, tz, s, r FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz ORDER BY s DESC, r) AS k FROM near) WHERE k = 1")


# peaks, over the image
def _map2(s, d):
    return t.image(s, d).select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("v").alias("s"))


def _map2k(s, d):
    return t.image(s, d, ("event_type",)).select("event_type", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("v").alias("s"))


_m2 = f"WITH {t.V2}, m2 AS (SELECT x AS tx, y AS ty, z AS tz, v AS s FROM v2)"
_m2k = f"WITH {t.V2K}, m2 AS (SELECT event_type, x AS tx, y AS ty, z AS tz, v AS s FROM v2k)"
add("peaks_sort", lambda s, d: P.top(_map2(s, d), 50), _m2 + " SELECT * FROM m2 ORDER BY s DESC, tx, ty, tz LIMIT 50")
add("peaks_per_batch", lambda s, d: P.top(_map2k(s, d), 5, ("event_type",)), _m2k + " SELECT event_type, tx, ty, tz, s FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s DESC, tx, ty, tz) AS k FROM m2) WHERE k <= 5")
add("peaks_boundary", lambda s, d: P.admissible(_map2(s, d), t.V2_BOUNDS, 3, 14.0, 20.0), _m2 + " SELECT * FROM m2 WHERE s BETWEEN 14 AND 20 AND tx BETWEEN 4 AND 27 AND ty BETWEEN 3 AND 20")
_near2 = " a.tx - b.tx BETWEEN -2 AND 2 AND a.ty - b.ty BETWEEN -2 AND 2"
add("peaks_maxfilter", lambda s, d: P.maximum_filter(_map2(s, d), 5, t.V2_BOUNDS), _m2 + f" SELECT * FROM m2 a WHERE s >= 0 AND NOT EXISTS (SELECT 1 FROM m2 b WHERE {_near2} AND b.s > a.s)")
add("peaks_maxfilter_batch", lambda s, d: P.maximum_filter(_map2k(s, d), 4, t.V2_BOUNDS, ("event_type",)), _m2k + " SELECT * FROM m2 a WHERE s >= 0 AND NOT EXISTS (SELECT 1 FROM m2 b WHERE a.event_type = b.event_type AND b.tx - a.tx BETWEEN -2 AND 1 AND b.ty - a.ty BETWEEN -2 AND 1 AND b.s > a.s)")
add(
    "peaks_fast",
    lambda s, d: P.fast_peaks(_map2(s, d), 5, t.V2_BOUNDS),
    _m2 + ", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY (tx - 1) // 5, ty // 5 ORDER BY s DESC, tx, ty, tz) AS k FROM m2) WHERE k = 1) SELECT tx, ty, tz, s FROM f WHERE NOT EXISTS (SELECT 1 FROM m2 b WHERE b.tx >= f.tx - 5 AND b.tx < f.tx + 5 AND b.ty >= f.ty - 5 AND b.ty < f.ty + 5 AND b.s > f.s)",
)
add("bucket_filter", lambda s, d: P.bucket_filter(_map2(s, d), 4), _m2 + ", lo AS (SELECT min(tx) AS ax, min(ty) AS ay FROM m2) SELECT tx, ty, tz, s FROM (SELECT m2.*, row_number() OVER (PARTITION BY (tx - ax) // 4, (ty - ay) // 4 ORDER BY s DESC, tx, ty, tz) AS k FROM m2, lo) WHERE k = 1")
add("peak_clusters", lambda s, d: P.clusters(_map2k(s, d).select("tx", "ty", "tz", "s"), 4), _m2k + " SELECT tx, ty, tz, count(*) AS n, max(s) AS s FROM m2 GROUP BY ALL HAVING count(*) >= 4")
add("score_to_target", lambda s, d: P.to_target(_map2(s, d), (25, 24, 1), (32, 27, 1), (-4, 5, 0)), _m2 + " SELECT * FROM (SELECT CAST((tx - 4 + 32) % 32 AS INT) AS tx, CAST((ty + 5) % 27 AS INT) AS ty, tz, s FROM m2) WHERE tx <= 24 AND ty <= 23")


def greedy_sql(source: str, close: str, limit: str = "") -> str:
    """Peaks of ``source`` walked from the best down, each kept if no kept one is ``close`` (between p and k)."""
    return (
        f"ranked AS (SELECT *, row_number() OVER (ORDER BY s DESC, tx, ty, tz) AS n FROM ({source})), walk AS (SELECT 0::BIGINT AS n, []::STRUCT(x INT, y INT, z INT)[] AS kept UNION ALL SELECT p.n, "
        f"CASE WHEN len(list_filter(w.kept, lambda k: {close})) > 0 THEN w.kept ELSE list_append(w.kept, {{'x': p.tx, 'y': p.ty, 'z': p.tz}}) END FROM walk w JOIN ranked p ON p.n = w.n + 1), "
        f"stay AS (SELECT unnest(kept) AS k FROM (SELECT kept FROM walk ORDER BY n DESC LIMIT 1)) SELECT tx, ty, tz, s FROM ranked JOIN stay ON tx = k.x AND ty = k.y AND tz = k.z {limit}"
    )


_ball = "(p.tx - k.x) ** 2 + (p.ty - k.y) ** 2 + (p.tz - k.z) ** 2 < {}"
_cube = "greatest(abs(p.tx - k.x), abs(p.ty - k.y), abs(p.tz - k.z)) <= {}"
_first = "ORDER BY s DESC, tx, ty, tz LIMIT {}"
_m2r = _m2.replace("WITH ", "WITH RECURSIVE ", 1)
add("nms_greedy", lambda s, d: P.suppress(P.admissible(_map2(s, d), low=12.0), 4.0), f"{_m2r}, {greedy_sql('SELECT * FROM m2 WHERE s >= 12', _ball.format(16))}")
add("nms_greedy_by_tiles", lambda s, d: P.suppress(P.admissible(_map2(s, d), low=12.0), 2.0, together=0, tile=8), f"{_m2r}, {greedy_sql('SELECT * FROM m2 WHERE s >= 12', _ball.format(4))}")
add("recursive_masking", lambda s, d: P.recursive_masking(_map2(s, d), 3, 20, 10.0), f"{_m2r}, {greedy_sql('SELECT * FROM m2 WHERE s >= 10', _cube.format(3), _first.format(20))}")
add("oversample_peaks", lambda s, d: six(P.oversample_peaks(P.maximum_filter(_map2(s, d), 5, t.V2_BOUNDS), _map2(s, d)), "fx", "fy", "fz", "fs"))

def _by_sql(s, d):
    """The same scores written as Spark SQL over the registered views."""
    t.register(s, d)
    rows = [dict(zip(("r", "ox", "oy", "oz", "g"), (r, *rotate_offset(m, p[:3]), float(p[3])))) for r, m in enumerate(t.ROTATIONS) for p in t.POINTS]
    return s.sql(
        "SELECT x - ox AS tx, y - oy AS ty, z - oz AS tz, r, round(sum(v * g), 6) AS s FROM voxels LATERAL VIEW inline(from_json(:rows, 'array<struct<r:int,ox:int,oy:int,oz:int,g:double>>')) e "
        "WHERE x - ox BETWEEN 1 AND 50 AND y - oy BETWEEN 0 AND 10 AND z - oz BETWEEN 0 AND 8 GROUP BY ALL", {"rows": json.dumps(rows)},
    )


add("cc_by_sql", _by_sql, SQL["cc"])

# aggregates
add("center_of_mass_v", lambda s, d: six(A.center_of_mass(t.volume(s, d), 8), "x", "y", "z"), f"WITH {t.V3} SELECT round(sum(v * x) / sum(v), 6) AS x, round(sum(v * y) / sum(v), 6) AS y, round(sum(v * z) / sum(v), 6) AS z FROM v3 WHERE v > 8")
add("center_of_mass_v2", lambda s, d: six(A.center_of_mass(t.image(s, d, ("event_type",)), None, True, ("event_type",)), "x", "y", "z"), f"WITH {t.V2K} SELECT event_type, round(sum(v * v * x) / sum(v * v), 6) AS x, round(sum(v * v * y) / sum(v * v), 6) AS y, round(sum(v * v * z) / sum(v * v), 6) AS z FROM v2k GROUP BY 1")
add("pca_covariance", lambda s, d: six(A.covariance(t.volume(s, d)), *(f"c{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz"))), f"WITH {t.V3} SELECT " + ", ".join(f"round(sum(v * {a} * {b}) / sum(v) - sum(v * {a}) / sum(v) * (sum(v * {b}) / sum(v)), 6) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")) + " FROM v3")
add("radial_spectrum_bins", lambda s, d: six(A.radial_bins(t.volume(s, d), (25, 5, 4), 2.0), "power"), f"WITH {t.V3} SELECT CAST(floor(sqrt((x - 25) ** 2 + (y - 5) ** 2 + (z - 4) ** 2) / 2) AS INT) AS bin, count(*) AS n, round(avg(v * v), 6) AS power FROM v3 GROUP BY 1")
add("max_index_by_label", lambda s, d: A.best_by_label(t.table(s, d, "events"), "event_type", "value", "event_id"), "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1")
add("online_statistics", lambda s, d: t.table(s, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value"), 4).alias("variance"), F.min("value").alias("least"), F.max("value").alias("most")), "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
_bin = "least(greatest(floor(({c} - {a}) / ({b} - {a}.0) * 10), 0), 9)"
add(
    "mutual_information_hist",
    lambda s, d: six(A.mutual_information(t.table(s, d, "lineitem").select((F.rint(F.col("l_discount") * 100)).alias("a"), F.rint(F.col("l_tax") * 100).alias("b")), F.col("a"), F.col("b"), 10, 0.0, 11.0), "information"),
    "WITH c AS (SELECT floor(round_even(l_discount * 100, 0) / 11.0 * 10) AS i, floor(round_even(l_tax * 100, 0) / 11.0 * 10) AS j, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY i) / sum(n) OVER () AS pi, sum(n) OVER (PARTITION BY j) / sum(n) OVER () AS pj FROM c) SELECT round(sum(p * ln(p / (pi * pj))), 6) AS information FROM p",
)
