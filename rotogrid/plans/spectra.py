"""Queries of spectra, rotation sets, volume files and small operators, with SQL written from their formulas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rotogrid.functions import fourier, lattice
from rotogrid.operators import aggregate as A
from rotogrid.operators import atoms as At
from rotogrid.operators import grid as G
from rotogrid.operators import lines as L
from rotogrid.operators import peaks as P
from rotogrid.operators import postprocess as Pp
from rotogrid.operators import refine as R
from rotogrid.operators import score as S
from rotogrid.operators import stencil as C
from rotogrid.plans import tables as t
from rotogrid.plans.matching import SQL as MATCHING_SQL
from rotogrid.plans.matching import _first, _m2r, six
from rotogrid.sources import volumes as V

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# spectra of the whole volume: a plain Fourier sum along each axis
def dft_sql(source: str, bounds, inverse: bool = False, name: str = "d") -> str:
    """CTEs of the transform of ``source`` (x, y, z, re, im), the last named ``name``2."""
    parts = []
    for i, (c, (low, high)) in enumerate(zip("xyz", bounds)):
        n = high - low + 1
        others = ", ".join(o for o in "xyz" if o != c)
        re, im = ("re * cos(a) - im * sin(a)", "im * cos(a) + re * sin(a)") if inverse else ("re * cos(a) + im * sin(a)", "im * cos(a) - re * sin(a)")
        part = f" / {float(n)}" if inverse else ""
        parts.append(
            f"{name}{i} AS (SELECT CAST(k + {low} AS INT) AS {c}, {others}, sum({re}){part} AS re, sum({im}){part} AS im "
            f"FROM (SELECT *, 2 * pi() * ((({c} - {low}) * k) % {n}) / {n} AS a FROM {source}, (SELECT unnest(range({n})) AS k)) GROUP BY k, {others})"
        )
        source = f"{name}{i}"
    return ", ".join(parts)


def frequency_sql(bounds) -> str:
    return "sqrt(" + " + ".join(f"(CASE WHEN {c} - {low} < {(high - low + 2) // 2} THEN {c} - {low} ELSE {c} - {low} - {high - low + 1} END / {high - low + 1}.0) ** 2" for c, (low, high) in zip("xyz", bounds)) + ")"


_forward = f"WITH {t.V3}, v0 AS (SELECT x, y, z, v AS re, 0.0::DOUBLE AS im FROM v3), {dft_sql('v0', t.V3_BOUNDS)}, f AS (SELECT *, {frequency_sql(t.V3_BOUNDS)} AS f FROM d2)"
_back = dft_sql("g", t.V3_BOUNDS, True, "b") + " SELECT x, y, z, round(re, 6) + 0.0 AS v FROM b2"
_sigma = 1 / (3.0 * math.sqrt(2 * math.log(2)))
add("bandpass_apply", lambda s, d: six(L.filtered(L.spectrum(t.volume(s, d), t.V3_BOUNDS), t.V3_BOUNDS, lambda f: fourier.band_gain(f, 3.0)), "v"), f"{_forward}, g AS (SELECT x, y, z, re * exp(-(f * f) / (2 * {_sigma!r} ** 2)) AS re, im * exp(-(f * f) / (2 * {_sigma!r} ** 2)) AS im FROM f), {_back}")
add("spectrum", lambda s, d: six(L.spectrum(t.volume(s, d), t.V3_BOUNDS), "re", "im"), f"{_forward} SELECT x, y, z, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM f")
_bins = 26
add(
    "whiten",
    lambda s, d: six(L.whiten(t.volume(s, d), t.V3_BOUNDS), "v"),
    f"""{_forward}, means AS (SELECT k AS bin, coalesce(avg(sqrt(re * re + im * im)), 0.0) AS m FROM (SELECT unnest(range({_bins})) AS k) LEFT JOIN f ON least(floor(f / 0.5 * {_bins - 1} + 0.5), {_bins - 1}) = k GROUP BY k),
 inv AS (SELECT bin, CASE WHEN m > 0 THEN 1 / m ELSE 0.0 END AS i FROM means), most AS (SELECT max(i) AS most FROM inv),
 gains AS (SELECT f.*, (a.i + (b.i - a.i) * (least(f / 0.5 * {_bins - 1}, {_bins - 1}) - a.bin)) / most AS gain FROM f JOIN inv a ON a.bin = floor(least(f / 0.5 * {_bins - 1}, {_bins - 1})) JOIN inv b ON b.bin = least(a.bin + 1, {_bins - 1}), most),
 g AS (SELECT x, y, z, re * gain AS re, im * gain AS im FROM gains), {_back}""",
)
_tilts = np.linspace(-60, 60, t.V3_BOUNDS[0][1] - t.V3_BOUNDS[0][0] + 1)  # the volume's x slices as tilt images
_step = math.radians(float(np.diff(_tilts).min()))
add(
    "back_projection",
    lambda s, d: six(L.back_project(t.volume(s, d), t.V3_BOUNDS, _tilts, 9), "v"),
    f"""WITH {t.V3}, k AS (SELECT unnest(range(11)) AS k), w AS (SELECT k, least(1.0, least(k, 11 - k) * {_step!r}) AS w FROM k),
 h AS (SELECT a.k AS d, sum(w.w * cos(2 * pi() * ((w.k * a.k) % 11) / 11)) / 11 AS h FROM k a, w GROUP BY a.k),
 q AS (SELECT v3.x, k.k AS y, v3.z, sum(v * h) AS v FROM v3, k, h WHERE h.d = (k.k - v3.y + 11) % 11 GROUP BY ALL), a AS (SELECT CAST(i + 1 AS INT) AS x, radians(-60 + 120 * i / 49e0) AS a FROM (SELECT unnest(range(50)) AS i)),
 places AS (SELECT p.k AS depth, k.k AS side, a.x, (k.k - 5) * cos(a) + (p.k - 4) * sin(a) + 5 AS spot FROM (SELECT unnest(range(9)) AS k) p, k, a)
 SELECT CAST(depth AS INT) AS x, CAST(side AS INT) AS y, z, round(sum(v * greatest(0.0, 1 - abs(spot - q.y))) / 50, 6) + 0.0 AS v FROM places JOIN q ON q.x = places.x GROUP BY ALL""",
)


# rotation sets: the spirals' closed forms
def product_sql(a: list[str], b: list[str]) -> list[str]:
    return ["(" + " + ".join(f"({a[i * 3 + k]}) * ({b[k * 3 + j]})" for k in range(3)) + ")" for i in range(3) for j in range(3)]


def _matrix_rows(matrices):
    return lambda s, d: s.createDataFrame([(i, *[round(float(v), 6) + 0.0 for v in m.ravel()]) for i, m in enumerate(matrices())], "r int, " + ", ".join(f"m{i} double" for i in range(9)))


_q = ["1 - 2 * (y * y + z * z)", "2 * (x * y - z * w)", "2 * (x * z + y * w)", "2 * (x * y + z * w)", "1 - 2 * (x * x + z * z)", "2 * (y * z - x * w)", "2 * (x * z - y * w)", "2 * (y * z + x * w)", "1 - 2 * (x * x + y * y)"]
_shown = lambda names: ", ".join(f"round({c}, 6) + 0.0 AS m{i}" for i, c in enumerate(names))
_a, _b = [f"f.m{j * 3 + i}" for i in range(3) for j in range(3)], [f"m.m{i}" for i in range(9)]
add(
    "uniform_rotations",
    _matrix_rows(lambda: lattice.uniform_rotations(60)),
    f"""WITH k AS (SELECT unnest(range(CAST(round(6 ** 3 / pi()) AS INT))) AS k, round(6 ** 3 / pi()) AS n), s AS (SELECT k, sqrt((k + 0.5) / n) AS r, sqrt(1 - (k + 0.5) / n) AS q, 2 * pi() * (k + 0.5) / sqrt(2) AS a, 2 * pi() * (k + 0.5) / 1.533751168755204288118041413 AS b FROM k),
 u AS (SELECT k, r * sin(a) AS x, r * cos(a) AS y, q * sin(b) AS z, q * cos(b) AS w FROM s), m AS (SELECT k, {', '.join(f'{e} AS m{i}' for i, e in enumerate(_q))} FROM u)
 SELECT CAST(m.k AS INT) AS r, {_shown([f'CASE WHEN m.k = 0 THEN {float(i % 4 == 0)} ELSE {e} END' for i, e in enumerate(product_sql(_a, _b))])} FROM m, (SELECT * FROM m WHERE k = 0) f""",
)
_turn = ["0", "-u3", "u2", "u3", "0", "-u1", "-u2", "u1", "0"]
_about = [f"(({int(i % 4 == 0)}) + sin(t) * ({a}) + (1 - cos(t)) * ({b}))" for i, (a, b) in enumerate(zip(_turn, product_sql(_turn, _turn)))]
_tilt = ["u1", "-u2", "-u3", "u2", "1 - u2 * u2 / (1 + u1)", "-u2 * u3 / (1 + u1)", "u3", "-u2 * u3 / (1 + u1)", "1 - u3 * u3 / (1 + u1)"]
add(
    "cone_rotations",
    _matrix_rows(lambda: lattice.cone_rotations(15, 7.5, axis_sampling=60)),
    f"""WITH n AS (SELECT CAST(sum(ceil(360 * sin(radians(a)) / 7.5) + 1) + 2 AS INT) AS n FROM (SELECT unnest([0.0, 7.5, 15.0]) AS a)), k AS (SELECT unnest(range(n)) AS k, n FROM n),
 p AS (SELECT k, radians(15) * sqrt((k + 0.5) / n) AS a, pi() * (1 + sqrt(5)) * (k + 0.5) AS b FROM k), u AS (SELECT k, cos(a) AS u1, sin(a) * sin(b) AS u2, -sin(a) * cos(b) AS u3 FROM p), g AS (SELECT u.*, j, radians(60 * j) AS t FROM u, (SELECT unnest(range(6)) AS j))
 SELECT CAST(k * 6 + j AS INT) AS r, {_shown(product_sql(_about, _tilt))} FROM g""",
)
add(
    "aligned_vectors",
    lambda s, d: s.createDataFrame([(i, *[round(float(v), 6) + 0.0 for v in lattice.align_vectors(u, (1, 0, 0)).T.ravel()]) for i, u in enumerate(lattice.cone_points(40, 10))], "r int, " + ", ".join(f"m{i} double" for i in range(9))),
    f"""WITH n AS (SELECT CAST(sum(ceil(360 * sin(radians(a)) / 10) + 1) + 2 AS INT) AS n FROM (SELECT unnest([0.0, 10.0, 20.0, 30.0, 40.0]) AS a)), k AS (SELECT unnest(range(n)) AS k, n FROM n),
 p AS (SELECT k, radians(40) * sqrt((k + 0.5) / n) AS a, pi() * (1 + sqrt(5)) * (k + 0.5) AS b FROM k), u AS (SELECT k, cos(a) AS u1, sin(a) * sin(b) AS u2, -sin(a) * cos(b) AS u3 FROM p) SELECT CAST(k AS INT) AS r, {_shown(_tilt)} FROM u""",
)


def _normals(s, d):
    v = t.volume(s, d)
    n = C.normals(v, v.where("v > 14").select("x", "y", "z"))
    return six(R.normal_scores(n.withColumn("set_id", F.col("x") % 3), n.select("x", "y", "z", F.col("ny").alias("nx"), F.col("nx").alias("ny"), "nz")), "s")


_dirs = t.values([(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if x or y or z], "ox, oy, oz")
add(
    "normal_vector_score",
    _normals,
    f"""WITH {t.V3}, pt AS (SELECT * FROM v3 WHERE v > 14), nb AS (SELECT p.x, p.y, p.z, p.v AS pv, k.*, coalesce(s.v, 0.0) AS v FROM pt p CROSS JOIN (SELECT * FROM {_dirs}) k LEFT JOIN v3 s ON s.x = p.x + ox AND s.y = p.y + oy AND s.z = p.z + oz),
 m AS (SELECT x, y, z, sum(CASE WHEN v > pv THEN ox ELSE 0 END) AS a, sum(CASE WHEN v > pv THEN oy ELSE 0 END) AS b, sum(CASE WHEN v > pv THEN oz ELSE 0 END) AS c FROM nb GROUP BY ALL)
 SELECT x % 3 AS set_id, round(avg(CASE WHEN a * a + b * b + c * c > 0 THEN (2 * a * b + c * c) / (a * a + b * b + c * c) ELSE 0.0 END), 6) + 0.0 AS s FROM m GROUP BY 1""",
)


# volume files: the image of each event type, written as a file of its own and read again
def _files(kind: str):
    def query(s, d):
        def write(key, pdf):
            data = np.zeros([b - a + 1 for a, b in t.V2_BOUNDS], np.float32)
            data[tuple(pdf[c] - low for c, (low, _) in zip("xyz", t.V2_BOUNDS))] = pdf["v"]
            squeeze = len(key[0]) % 2 == 0
            body = {"mrc": lambda: V.write_mrc(data, (3.0, 0.0, 1.5), (2.0, 2.0, 2.0), squeeze), "em": lambda: V.write_em(data, 1.5, squeeze), "tif": lambda: V.write_tiff(data)}[kind]()
            return pd.DataFrame([(f"{key[0]}.{kind}{'.gz' if squeeze and kind != 'tif' else ''}", body)], columns=["path", "content"])

        return t.image(s, d, ("event_type",)).groupBy("event_type").applyInPandas(write, "path string, content binary")

    return query


def _read(kind: str, **options):
    def query(s, d):
        blocks = V.parse_volumes(_files(kind)(s, d), 16, **options).select(F.regexp_extract("path", r"^([^.]+)", 1).alias("event_type"), "start", F.col("block_shape").alias("shape"), "data")
        return G.from_blocks(blocks, ("event_type",))

    return query


for _kind in ("mrc", "em", "tif"):
    add(f"{_kind}_roundtrip", _read(_kind), f"WITH {t.V2K} SELECT event_type, x - 1 AS x, y, z, v FROM v2k")
add("mrc_subset", _read("mrc", subset=[(5, 20), (3, 20), (0, 1)]), f"WITH {t.V2K} SELECT event_type, x - 6 AS x, y - 3 AS y, z, v FROM v2k WHERE x - 1 BETWEEN 5 AND 19 AND y BETWEEN 3 AND 19")


def _header(kind: str):
    def query(s, d):
        blocks = V.parse_volumes(_files(kind)(s, d), 16).where("block_id = '0_0_0'")
        return blocks.select("path", F.concat_ws(",", "shape").alias("shape"), F.col("origin")[0].alias("begin"), F.col("rate")[1].alias("step"), "low", "high", F.round("mean", 6).alias("mean"))

    return query


for _kind, _begin, _rate in (("mrc", 3.0, 2.0), ("em", 0.0, 1.5)):
    add(f"{_kind}_header", _header(_kind), f"WITH {t.V2K} SELECT event_type || '.{_kind}' || CASE WHEN length(event_type) % 2 = 0 THEN '.gz' ELSE '' END AS path, '30,24,1' AS shape, {_begin}::DOUBLE AS begin, {_rate}::DOUBLE AS step, CASE WHEN count(*) < 720 THEN 0.0 ELSE min(v) END AS low, max(v) AS high, round(sum(v) / 720, 6) AS mean FROM v2k GROUP BY event_type")


# small operators
def _map2(s, d):
    return t.image(s, d).select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("v").alias("s"))


_m2 = f"WITH {t.V2}, m2 AS (SELECT x AS tx, y AS ty, z AS tz, v AS s FROM v2)"
add("peaks_to_volume", lambda s, d: Pp.peaks_to_volume(P.maximum_filter(_map2(s, d), 3, t.V2_BOUNDS), [(2, 25), (0, 20), (0, 0)]), _m2 + " SELECT tx AS x, ty AS y, tz AS z, s AS v FROM m2 a WHERE tx BETWEEN 2 AND 25 AND ty <= 20 AND NOT EXISTS (SELECT 1 FROM m2 b WHERE abs(a.tx - b.tx) <= 1 AND abs(a.ty - b.ty) <= 1 AND b.s > a.s)")
add("score_to_scores", lambda s, d: P.to_scores(_map2(s, d), (32, 27, 1), (-4, 5, 0)), _m2 + " SELECT CAST((tx + 4) % 32 AS INT) AS tx, CAST((ty - 5 + 27) % 27 AS INT) AS ty, tz, s FROM m2")
add("rotate_quarter", lambda s, d: G.rot90(t.volume(s, d), t.V3_BOUNDS, 1, ("x", "y")), f"WITH {t.V3} SELECT CAST(10 - y + 1 AS INT) AS x, CAST(x - 1 AS INT) AS y, z, v FROM v3")
add("rotate_three_quarters", lambda s, d: G.rot90(t.volume(s, d), t.V3_BOUNDS, 3, ("x", "z")), f"WITH {t.V3} SELECT CAST(z + 1 AS INT) AS x, y, CAST(50 - x AS INT) AS z, v FROM v3")
add(
    "merge_translations",
    lambda s, d: A.merge_translations(*[A.best_over_translations(S.correlate(t.volume(s, d), t.TEMPLATE, t.ROTATIONS, [part, *t.V3_BOUNDS[1:]])) for part in ((1, 30), (20, 50))]),
    f"SELECT r, max(s) AS s FROM ({MATCHING_SQL['cc']}) GROUP BY 1",
)
_plate = np.zeros((7, 7, 7))
_plate[1:6, 2:5, 3] = 1


def _masked_peaks(s, d):
    rows = _map2(s, d).withColumn("r", ((F.col("tx") + 2 * F.col("ty")) % 24).cast("int"))
    return P.recursive_masking(rows, 0, 40, 6.0, _plate, np.array(t.ROTATIONS, float).reshape(-1, 3, 3))


_plates = t.values([(r, x, y, z) for r, m in enumerate(t.ROTATIONS) for x, y, z in sorted(lattice.rotate_offset(m, tuple(int(c) - 3 for c in at)) for at in np.argwhere(_plate > 0))], "r, ox, oy, oz")
add(
    "recursive_masking_by_rotation",
    _masked_peaks,
    f"""{_m2r}, pl AS (SELECT r, list((ox, oy, oz)) AS offs FROM {_plates} GROUP BY r), ranked AS (SELECT m2.*, CAST((tx + 2 * ty) % 24 AS INT) AS r, offs, row_number() OVER (ORDER BY s DESC, tx, ty, tz) AS n FROM m2 JOIN pl ON pl.r = (tx + 2 * ty) % 24 WHERE s >= 6),
 walk AS (SELECT 0::BIGINT AS n, []::STRUCT(x INT, y INT, z INT)[] AS emptied, []::BIGINT[] AS kept UNION ALL SELECT p.n, CASE WHEN gone THEN emptied ELSE list_concat(emptied, list_transform(offs, lambda o: {{'x': tx + o[1], 'y': ty + o[2], 'z': tz + o[3]}})) END,
  CASE WHEN gone THEN kept ELSE list_append(kept, p.n) END FROM (SELECT p.*, w.emptied, w.kept, list_contains(w.emptied, {{'x': p.tx, 'y': p.ty, 'z': p.tz}}) AS gone FROM walk w JOIN ranked p ON p.n = w.n + 1) p)
 SELECT tx, ty, tz, s, r FROM ranked WHERE list_contains((SELECT kept FROM walk ORDER BY n DESC LIMIT 1), n) {_first.format(40)}""",
)


def _structure_fit(s, d):
    atoms = t.atoms(s, d)
    moved = atoms.withColumns({a: F.col(a) - k for a, k in zip("xyz", (2, 1, 1))})
    x, best = R.match_structure(At.to_volume(atoms, t.elements(s)), moved, t.elements(s))
    return s.createDataFrame([(i, round(float(c), 2) + 0.0) for i, c in enumerate([*x[:3], best])], "i int, value double")


add("match_structure", _structure_fit, "SELECT * FROM (VALUES (0, 2e0), (1, 1e0), (2, 1e0), (3, 1e0)) AS t(i, value)")

# SQL surface over the encodings' views
_levels = "(SELECT *, CASE WHEN v > 8 THEN 'high' ELSE 'low' END AS level FROM {})"


def _grouped(form: str):
    def query(s, d):
        t.register(s, d)
        return s.sql(f"SELECT level, x, y, count(*) AS n, sum(v) AS total FROM {_levels.format('voxels')} GROUP BY {form}")

    return query


for _name, _form in (("volume_cube", "CUBE (level, x, y)"), ("volume_rollup", "ROLLUP (level, x, y)"), ("volume_grouping_sets", "GROUPING SETS ((level, x), (y), ())")):
    add(_name, _grouped(_form), f"WITH {t.V3} SELECT level, x, y, count(*) AS n, sum(v) AS total FROM {_levels.format('v3')} GROUP BY {_form}")
