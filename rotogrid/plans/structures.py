"""Queries of atoms, rotations, file formats, picks and refinement, and their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from rotogrid.functions import lattice as L
from rotogrid.operators import aggregate as A
from rotogrid.operators import atoms as At
from rotogrid.operators import grid as G
from rotogrid.operators import peaks as P
from rotogrid.operators import postprocess as Pp
from rotogrid.operators import refine as R
from rotogrid.operators import score as S
from rotogrid.plans import tables as t
from rotogrid.plans.matching import six
from rotogrid.sources import picks as Pk
from rotogrid.sources import structures as St
from rotogrid.sources import text as Tx

QUERIES: dict = {}
SQL: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_at = f"WITH {t.ATOMS}, {t.ELEMENTS_SQL}"
_w = _at + ", w AS (SELECT a.*, coalesce(e.atomic_weight, 0.0) AS w FROM atoms a LEFT JOIN elements e ON a.element_symbol = e.element_symbol)"
KEYS = ("serial", "part")
add("subset_chain", lambda s, d: At.by_chain(t.atoms(s, d), "A,R"), _at + " SELECT * FROM atoms WHERE chain IN ('A', 'R')")
add("subset_range", lambda s, d: At.by_range(t.atoms(s, d), 3, 9, "N"), _at + " SELECT * FROM atoms WHERE chain = 'N' AND residue BETWEEN 3 AND 9")
add("chain_weights", lambda s, d: six(At.chain_weights(t.atoms(s, d), t.elements(s)), "weight"), _w + " SELECT chain, round(sum(w), 6) AS weight, count(*) AS n FROM w GROUP BY 1")
add("chain_ranges", lambda s, d: At.chain_ranges(t.atoms(s, d)), _at + " SELECT chain, min(residue) AS first, max(residue) AS last FROM atoms GROUP BY 1")
add("unique_chains", lambda s, d: At.unique_chains(At.chain_signatures(t.atoms(s, d), KEYS)).select("first_chain", "chains", "n"), _at + ", q AS (SELECT chain, count(*) AS n, hash(list((residue, element_symbol) ORDER BY residue, serial, part)) AS h FROM atoms GROUP BY 1) SELECT min(chain) AS first_chain, count(*) AS chains, any_value(n) AS n FROM q GROUP BY h")
add("structure_center", lambda s, d: six(At.center_of_mass(t.atoms(s, d), t.elements(s)), "x", "y", "z"), _w + " SELECT round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y, round(sum(w * z) / sum(w), 6) AS z FROM w")
_move = (0, -1, 0, 1, 0, 0, 0, 0, 1)
add("rigid_transform_atoms", lambda s, d: six(At.transform(t.atoms(s, d), _move, (1, 2, 3)), "x", "y", "z"), _at + ", c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM atoms) SELECT chain, residue, serial, part, round(-(y - cy) + cx + 1, 6) + 0.0 AS x, round((x - cx) + cy + 2, 6) + 0.0 AS y, round(z + 3, 6) + 0.0 AS z, element_symbol FROM atoms, c")
add("center_structure", lambda s, d: six(At.centered(t.atoms(s, d), t.elements(s)), "x", "y", "z"), _w + ", c AS (SELECT " + ", ".join(f"(min({a}) + max({a})) / 2 - sum(w * {a}) / sum(w) AS c{a}" for a in "xyz") + " FROM w) SELECT chain, residue, serial, part, element_symbol, round(x + cx, 6) + 0.0 AS x, round(y + cy, 6) + 0.0 AS y, round(z + cz, 6) + 0.0 AS z FROM atoms, c")


def _sites(s, d):
    """One atom for each (serial, part), at the least coordinates."""
    return t.atoms(s, d).groupBy(*KEYS).agg(*[F.min(a).alias(a) for a in "xyz"])


add("rmsd", lambda s, d: six(At.rmsd(_sites(s, d), _sites(s, d).withColumn("x", F.col("x") + F.col("part")), KEYS), "rmsd"), _at + " SELECT round(sqrt(avg(part * part)), 6) AS rmsd, count(*) AS n FROM (SELECT DISTINCT serial, part FROM atoms)")
add("to_volume_weight", lambda s, d: six(At.to_volume(t.atoms(s, d), t.elements(s), (2, 1, 1), (0.5, 0, 0), (20, 11, 9)), "v"), _w + " SELECT CAST(round_even((x - 0.5) / 2, 0) AS INT) AS x, CAST(round_even(y, 0) AS INT) AS y, CAST(round_even(z, 0) AS INT) AS z, round(sum(w), 6) AS v FROM w GROUP BY 1, 2, 3 HAVING CAST(round_even((any_value(w.x) - 0.5) / 2, 0) AS INT) < 20")
add("vdw_spheres", lambda s, d: At.vdw_spheres(t.atoms(s, d), t.elements(s)), f"{_at}, p AS (SELECT CAST(round_even(x, 0) AS INT) AS px, CAST(y AS INT) AS py, CAST(z AS INT) AS pz, CAST(ceil(vdw / 100.0) AS INT) AS k, count(*) AS n FROM atoms JOIN elements USING (element_symbol) GROUP BY ALL), o AS (SELECT * FROM (SELECT CAST(unnest(range(-2, 3)) AS INT) AS ox), (SELECT CAST(unnest(range(-2, 3)) AS INT) AS oy), (SELECT CAST(unnest(range(-2, 3)) AS INT) AS oz)) SELECT px + ox AS x, py + oy AS y, pz + oz AS z, CAST(sum(n) AS DOUBLE) AS v FROM p, o WHERE ox * ox + oy * oy + oz * oz <= k * k GROUP BY 1, 2, 3")


def _kabsch(s, d):
    a = _sites(s, d)
    b = At.transform(a, (0, -1, 0, 1, 0, 0, 0, 0, 1), (5, -3, 2))
    m, shift, before, after = At.superpose(a, b, KEYS)
    return s.createDataFrame([(i, j, round(float(m[i, j]), 6) + 0.0, round(after, 4) + 0.0) for i in range(3) for j in range(3)], "i int, j int, m double, rmsd double")


add("kabsch", _kabsch, f"SELECT * FROM {t.values([(i, j, float(_move[i * 3 + j]), 0.0) for i in range(3) for j in range(3)], 'i, j, m, rmsd')}")


# formats: written from the table, parsed back
def _records(s, d):
    return t.atoms(s, d).select(
        F.concat("chain", F.lit("_"), F.col("residue") % 7).alias("path"), F.lit("ATOM").alias("record_type"), (F.col("serial") * 8 + F.col("part")).alias("atom_serial_number"), F.col("element_symbol").alias("atom_name"), F.lit("").alias("alternate_location_indicator"),
        F.lit("ALA").alias("residue_name"), "chain", (F.col("residue") % 10000).cast("int").alias("residue"), F.lit("").alias("code_for_residue_insertion"), "x", "y", "z", F.lit(1.0).alias("occupancy"), F.lit(0.5).alias("temperature_factor"), F.lit("SEG1").alias("segment"), "element_symbol", F.lit("").alias("charge"),
    )


_written = f"{_at} SELECT serial * 8 + part AS atom_serial_number, element_symbol AS atom_name, chain, CAST(residue % 10000 AS INT) AS residue, x, y, z, 0.5::DOUBLE AS temperature_factor FROM atoms"
_back = ("atom_serial_number", "atom_name", "chain", "residue", "x", "y", "z", "temperature_factor")


def _pdb(s, d):
    rows = _records(s, d)
    return St.parse_pdb(rows.select("path", F.lit(0).alias("line_no"), St.format_pdb(rows).alias("value"))).select(*_back)


def _cif(s, d):
    rows = _records(s, d)
    lines = St.lines_of(rows, St.format_cif(rows), "atom_serial_number", [F.lit(h) for h in St.cif_header()])
    return St.parse_lines(lines, "cif", ("place", "line_no")).select(*_back)


add("pdb_roundtrip", _pdb, _written)
add("mmcif_roundtrip", _cif, _written)


def _gro(s, d):
    rows = _records(s, d)
    lines = St.lines_of(rows, St.format_gro(rows), "atom_serial_number", [F.lit("title t= 1.0"), F.col("n").cast("string")], [F.lit(" 0.0 0.0 0.0")])
    return St.parse_lines(lines, "gro", ("place", "line_no")).select(F.col("atom_serial_number"), "atom_name", "residue", "x", "y", "z")


add("gro_roundtrip", _gro, f"{_at} SELECT (serial * 8 + part) % 100000 AS atom_serial_number, element_symbol AS atom_name, CAST(residue % 10000 AS INT) AS residue, x, y, z FROM atoms")


def _picks(s, d):
    """Every pick once, null and NaN cells included."""
    names = ("x", "y", "z", "euler_x", "euler_y", "euler_z", "score", "detail")
    picks = t.table(s, d, "orientations").select("tomo_id", "pick_id", *names).distinct()
    return picks.withColumn("path", F.coalesce("tomo_id", F.lit("none")))


_blank = lambda c: f"CASE WHEN {c} = {c} AND NOT isnan({c}) THEN {c} END AS {c}"
_mine = ("x", "y", "z", "euler_x", "euler_y", "euler_z", "score")
_pk = f"WITH p AS (SELECT coalesce(tomo_id, 'none') AS path, {', '.join(map(_blank, (*_mine, 'detail')))} FROM (SELECT DISTINCT tomo_id, pick_id, {', '.join(_mine)}, detail FROM orientations))"


def _written_picks(kind):
    def query(s, d):
        p = _picks(s, d)
        text, header = {"text": (Pk.format_text, ["\t".join(Pk.COLUMNS)]), "star": (Pk.format_star, Pk.star_header()), "tbl": (Pk.format_dynamo, [])}[kind]
        rows = Pk.parse_picks(Pk.body_of(p, text(p), ("pick_id",), header), kind)
        return rows if kind != "tbl" else rows.drop("detail")

    return query


add("orientations_text", _written_picks("text"), f"{_pk} SELECT path, {', '.join(_mine)}, detail FROM p")
add("star_roundtrip", _written_picks("star"), f"{_pk} SELECT path, {', '.join(_mine)}, CASE WHEN isfinite(detail) THEN trunc(detail) ELSE -1.0 END AS detail FROM p")
add("dynamo_roundtrip", _written_picks("tbl"), f"{_pk} SELECT path, {', '.join(_mine)} FROM p")


def _mdoc(s, d):
    rows = t.table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 40).alias("path"), "o_orderkey", F.concat(F.lit("[ZValue = "), F.col("o_orderkey"), F.lit("]\nTiltAngle = "), F.col("o_totalprice"), F.lit("\nNote = a = b\n")).alias("t"))
    bodies = Pk.body_of(rows, F.col("t"), ("o_orderkey",), ["PixelSpacing = 1.5", "[T = made from orders]", ""])
    return Tx.parse_cells(bodies, "mdoc").select("path", "name", "row_no", F.expr("try_cast(value as double)").alias("number"), F.when(F.col("name") == "Note", F.col("value")).alias("text"))


add("mdoc_parse", _mdoc, """WITH o AS (SELECT 'c' || (o_custkey % 40) AS path, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS INT) AS row_no FROM orders)
 SELECT path, 'ZValue' AS name, row_no, CAST(o_orderkey AS DOUBLE) AS number, NULL::VARCHAR AS text FROM o UNION ALL SELECT path, 'TiltAngle', row_no, o_totalprice, NULL FROM o UNION ALL SELECT path, 'Note', row_no, NULL, 'a = b' FROM o UNION ALL SELECT DISTINCT path, 'PixelSpacing', 0, 1.5, NULL FROM o""")


def _mdoc_tilts(s, d):
    """Angles and doses of tilt series written as MDOC: one series for each customer, ordered by order."""
    rows = t.table(s, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("path"), "o_orderkey", F.concat(F.lit("[ZValue = 0]\nTiltAngle = "), F.round(F.col("o_totalprice") / 5000 - 60, 2), F.lit("\nExposureDose = "), F.col("o_orderkey") % 7, F.lit("\nDefocus = -"), F.col("o_orderkey") % 9, F.lit("\n")).alias("t"))
    return Pk.body_of(rows, F.col("t"), ("o_orderkey",), ["PixelSpacing = 1.5", ""])


_mdoc_rows = "WITH o AS (SELECT 'c' || o_custkey AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS tilt, o_orderkey, round(o_totalprice / 5000 - 60, 2) AS angle FROM orders)"
add("mdoc_tilts", lambda s, d: Tx.parse_table(_mdoc_tilts(s, d), "tilts", "mdoc").withColumn("angle", F.round("angle", 2)), f"{_mdoc_rows} SELECT path, tilt, angle, CAST(o_orderkey % 7 AS DOUBLE) AS weight FROM o")
add("mdoc_ctf", lambda s, d: Tx.parse_table(_mdoc_tilts(s, d), "ctf", "mdoc").select("path", "tilt", "defocus_x"), f"{_mdoc_rows} SELECT path, tilt, 10000e0 * (o_orderkey % 9) AS defocus_x FROM o")


def _table_texts(s, d, kind):
    """Tilt and CTF tables of suppliers' parts, written as text, star or estimation output."""
    rows = t.table(s, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("path"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("d"))
    text = {
        "text": F.concat_ws("\t", F.col("q") - 60, "d"), "star": F.concat_ws(" ", F.col("q") - 60, "d", F.lit("x")), "ctfstar": F.concat_ws(" ", F.col("q") * 100, F.col("q") * 90, "d"),
        "ctffind": F.concat_ws(" ", F.lit("1.0"), F.col("q") * 100, F.col("q") * 90, "d", F.lit("0.0 0.5 8.0")),
    }[kind]
    header = {
        "text": ["# tilts", "angles\tweights"], "star": ["data_tilts", "loop_", "_tilt_angle #1", "_exposure #2", "_other #3"], "ctfstar": ["data_ctf", "loop_", "_rlnDefocusU #1", "_rlnDefocusV #2", "_rlnDefocusAngle #3"],
        "ctffind": ["# Pixel size: 1.35 Angstroms ; acceleration voltage: 300.0 keV ; spherical aberration: 2.70 mm ; amplitude contrast: 0.07"],
    }[kind]
    return Pk.body_of(rows, text, ("l_orderkey", "l_linenumber", "q", "d"), header)


_li = "WITH o AS (SELECT 's' || l_suppkey AS path, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_discount) - 1 AS INT) AS tilt, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d FROM lineitem)"
for _kind in ("text", "star"):
    add(f"tilts_{_kind}", lambda s, d, k=_kind: Tx.parse_table(_table_texts(s, d, k), "tilts", k), f"{_li} SELECT path, tilt, q - 60 AS angle, d AS weight FROM o")
add("ctf_star", lambda s, d: Tx.parse_table(_table_texts(s, d, "ctfstar"), "ctf", "star").select("path", "tilt", "defocus_x", "defocus_y", "astigmatism"), f"{_li} SELECT path, tilt, q * 100 AS defocus_x, q * 90 AS defocus_y, d AS astigmatism FROM o")
add("ctf_ctffind", lambda s, d: Tx.parse_table(_table_texts(s, d, "ctffind"), "ctf", "ctffind").select("path", "tilt", "defocus_x", "defocus_y", "astigmatism", "voltage", "rate"), f"{_li} SELECT path, tilt, q * 100 AS defocus_x, q * 90 AS defocus_y, d AS astigmatism, 300e0 AS voltage, 1.35e0 AS rate FROM o")


def _xml_files(s, d):
    """Bodies that the nested flattening takes to be well formed have a tree; others give no rows."""
    return t.table(s, d, "ctf_docs").where("file_kind = 'xml' and body is not null").select(F.col("ctf_id").cast("string").alias("path"), "body")


add("xml_extract", lambda s, d: Tx.parse_cells(_xml_files(s, d), "xml").where("name in ('Angles', 'Dose', '@UnselectFilter') and section = 'TiltSeries'").select("path", "name", "row_no", "value"), """WITH d AS (SELECT CAST(ctf_id AS VARCHAR) AS path, regexp_replace(body, '<!--.*?-->', '', 'gs') AS body FROM ctf_docs WHERE file_kind = 'xml' AND regexp_matches(trim(body, chr(10) || chr(13) || ' '), '</TiltSeries\\s*>$')),
 c AS (SELECT path, n AS name, string_split_regex(trim(regexp_extract(body, '<' || n || '[^>]*>([^<]*)</' || n || '>', 1), chr(10) || chr(13) || ' '), '\\s*\\n\\s*') AS cells FROM d, (SELECT unnest(['Angles', 'Dose']) AS n)),
 f AS (SELECT path, name, CAST(generate_subscripts(cells, 1) - 1 AS INT) AS row_no, unnest(cells) AS v FROM c)
 SELECT path, name, row_no, CASE WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(CAST(v AS DOUBLE) AS VARCHAR) END AS value FROM f WHERE v <> ''
 UNION ALL SELECT path, '@UnselectFilter', 0, regexp_extract(body, '<TiltSeries[^>]*UnselectFilter\\s*=\\s*["'']([^"'']*)["'']', 1) FROM d WHERE regexp_matches(body, '<TiltSeries[^>]*UnselectFilter\\s*=')""")

# rotations


def _angles(s, d):
    c = F.col("event_id")
    return t.table(s, d, "events").select("event_id", ((c * 7) % 360).cast("double").alias("a"), ((c * 11) % 179 + 0.5).alias("b"), ((c * 13) % 360).cast("double").alias("c"))


_ang = "WITH e AS (SELECT event_id, radians(CAST((event_id * 7) % 360 AS DOUBLE)) AS a, radians(CAST((event_id * 11) % 179 + 0.5 AS DOUBLE)) AS b, radians(CAST((event_id * 13) % 360 AS DOUBLE)) AS c FROM events)"
_m = ("cos(c)*cos(b)*cos(a)-sin(c)*sin(a)", "-cos(c)*cos(b)*sin(a)-sin(c)*cos(a)", "cos(c)*sin(b)", "sin(c)*cos(b)*cos(a)+cos(c)*sin(a)", "-sin(c)*cos(b)*sin(a)+cos(c)*cos(a)", "sin(c)*sin(b)", "-sin(b)*cos(a)", "sin(b)*sin(a)", "cos(b)")
add("euler_to_matrix", lambda s, d: _angles(s, d).select("event_id", *[(F.round(m, 6) + 0.0).alias(f"m{i}") for i, m in enumerate(L.euler_columns(F.col("a"), F.col("b"), F.col("c")))]), _ang + " SELECT event_id, " + ", ".join(f"round({e}, 6) + 0.0 AS m{i}" for i, e in enumerate(_m)) + " FROM e")


def _back_to_euler(s, d):
    rows = _angles(s, d).select("event_id", *[m.alias(f"m{i}") for i, m in enumerate(L.euler_columns(F.col("a"), F.col("b"), F.col("c")))])
    angles = L.euler_of_columns([F.col(f"m{i}") for i in range(9)])
    return rows.select("event_id", *[F.round(F.pmod(F.round(x, 5) + 360.0, F.lit(360.0)), 4).alias(n) for x, n in zip(angles, "abc")])


add("matrix_to_euler", _back_to_euler, "SELECT event_id, CAST((event_id * 7) % 360 AS DOUBLE) AS a, CAST((event_id * 11) % 179 + 0.5 AS DOUBLE) AS b, CAST((event_id * 13) % 360 AS DOUBLE) AS c FROM events")
add("rotate_template_lattice", lambda s, d: s.range(1).select(F.explode(S.expansion(t.TEMPLATE, t.ROTATIONS)).alias("e")).select("e.r", "e.ox", "e.oy", "e.oz", "e.g"), "WITH rot AS (SELECT * FROM " + t.values([(r, *m) for r, m in enumerate(t.ROTATIONS)], "r, " + ", ".join(f"m{i}" for i in range(9))) + "), p AS (SELECT * FROM " + t.values([p[:4] for p in t.POINTS], "x, y, z, g") + ") SELECT r, m0*x+m1*y+m2*z AS ox, m3*x+m4*y+m5*z AS oy, m6*x+m7*y+m8*z AS oz, CAST(g AS DOUBLE) AS g FROM rot, p")


def _principal(s, d):
    m = A.principal_rotation(t.volume(s, d))
    return s.createDataFrame([(i, round(abs(float(v)), 4)) for i, v in enumerate(m.ravel())], "i int, m double")


add("align_to_axis", _principal)


# post-processing
def _entity_map(s, d):
    order = sorted(r[0] for r in t.table(s, d, "events").select("event_type").distinct().collect())  # a handful of types
    number = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    return t.image(s, d, ("event_type",)).select(number[F.col("event_type")].alias("entity"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("v").alias("s"))


_ent = f"WITH {t.V2K}, en AS (SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS entity, x AS tx, y AS ty, z AS tz, v AS s FROM v2k)"
_norm = _ent + ", me AS (SELECT entity, avg(s) AS m FROM en GROUP BY 1), nm AS (SELECT tx, ty, tz, s - m AS s, en.entity FROM en JOIN me ON en.entity = me.entity)"
add("normalize_foregrounds", lambda s, d: six(Pp.normalise(_entity_map(s, d)), "s"), _norm + " SELECT tx, ty, tz, round(s, 6) + 0.0 AS s, entity FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz ORDER BY s DESC, entity) AS k FROM nm) WHERE k = 1")
add("background_correction", lambda s, d: six(Pp.subtract_background(Pp.normalise(_entity_map(s, d).where("entity < 2")).drop("entity"), _entity_map(s, d).where("entity >= 2")), "s"), _norm + ", fg AS (SELECT tx, ty, tz, max(s) AS s FROM nm WHERE entity < 2 GROUP BY ALL), bg AS (SELECT tx, ty, tz, max(s) AS b FROM nm WHERE entity >= 2 GROUP BY ALL) SELECT fg.tx, fg.ty, fg.tz, round(CASE WHEN b IS NULL THEN 0.0 ELSE greatest(0.0, s - b) END, 6) + 0.0 AS s FROM fg LEFT JOIN bg ON fg.tx = bg.tx AND fg.ty = bg.ty AND fg.tz = bg.tz")
add("entity_stats", lambda s, d: Pp.entity_stats(_entity_map(s, d)).select("entity", *[F.round(c, 3).alias(c) for c in ("mean", "std", "most")]), _ent + " SELECT entity, round(avg(s), 3) AS mean, round(stddev_pop(s), 3) AS std, round(max(s), 3) AS most FROM en GROUP BY 1")
_m2 = f"WITH {t.V2}, m2 AS (SELECT x AS tx, y AS ty, z AS tz, v AS s FROM v2)"


def _map2(s, d):
    return t.image(s, d).select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("v").alias("s"))


add("mask_scores", lambda s, d: Pp.mask_scores(_map2(s, d), s.range(5, 20).select(F.col("id").cast("int").alias("x"), F.lit(7).alias("y"), F.lit(0).alias("z"), F.lit(0.5).alias("v")), 2.0), _m2 + " SELECT tx, ty, tz, s * 0.5 AS s FROM m2 WHERE ty = 7 AND tx BETWEEN 5 AND 19 AND s * 0.5 > 2")
from statistics import NormalDist  # noqa: E402

_z = NormalDist().inv_cdf(1 - 1 / 720)
add("false_positive_threshold", lambda s, d: six(Pp.noise_threshold(_map2(s, d), 1.0, 720), "threshold"), _m2 + f" SELECT round(sum(s) / 720 + {_z!r} * sqrt(sum(s * s) / 720 - (sum(s) / 720) ** 2), 6) AS threshold FROM m2")


def _out(s, d):
    angles = s.createDataFrame([(r, *[float(a) for a in L.matrix_to_euler(np.array(m, float).reshape(3, 3))]) for r, m in enumerate(t.ROTATIONS)], "r int, euler_x double, euler_y double, euler_z double")
    best = P.top(A.best_products(t.volume(s, d), t.TEMPLATE, t.ROTATIONS, t.V3_BOUNDS), 40)
    return six(Pp.orientations(best, angles, (2, 2, 2), (1, 0, 0)), "euler_x", "euler_y", "euler_z")


_eul = t.values([(r, *[round(float(a), 6) + 0.0 for a in L.matrix_to_euler(np.array(m, float).reshape(3, 3))]) for r, m in enumerate(t.ROTATIONS)], "r, euler_x, euler_y, euler_z")
add("orientations_out", _out, f"WITH {t.V3}, {t.expansion_sql(t.TEMPLATE, t.ROTATIONS)}, {t.placed_sql('v3', t.V3_BOUNDS)}, cc AS (SELECT tx, ty, tz, r, sum(v * g) AS s FROM placed GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tx, ty, tz ORDER BY s DESC, r) AS k FROM cc) WHERE k = 1 ORDER BY s DESC, tx, ty, tz LIMIT 40) SELECT CAST(tx * 2 + 1 AS DOUBLE) AS x, CAST(ty * 2 AS DOUBLE) AS y, CAST(tz * 2 AS DOUBLE) AS z, CAST(e.euler_x AS DOUBLE) AS euler_x, CAST(e.euler_y AS DOUBLE) AS euler_y, CAST(e.euler_z AS DOUBLE) AS euler_z, s AS score, CAST(-1.0 AS DOUBLE) AS detail FROM b JOIN (SELECT * FROM {_eul}) e ON b.r = e.r")
add("relion5_coords", lambda s, d: six(Pp.relative_coordinates(_picks(s, d).select("pick_id", "x", "y", "z"), (1000, 1000, 400), 1.5), "x_angst", "y_angst", "z_angst"), "WITH p AS (SELECT DISTINCT tomo_id, pick_id, x, y, z, euler_x, euler_y, euler_z, score, detail FROM orientations) SELECT pick_id, round((x - 499.5) * 1.5, 6) + 0.0 AS x_angst, round((y - 499.5) * 1.5, 6) + 0.0 AS y_angst, round((z - 199.5) * 1.5, 6) + 0.0 AS z_angst FROM p")


def _cut(s, d):
    picks = t.volume(s, d).where("v > 16").select(F.expr("x * 1000 + y * 10 + z").cast("bigint").alias("pick_id"), "x", "y", "z")
    return Pp.extract(t.volume(s, d), picks, (5, 4, 3))


_ex = f"WITH {t.V3}, ex AS (SELECT CAST(p.x * 1000 + p.y * 10 + p.z AS BIGINT) AS pick_id, s.x - (p.x - 2) AS dx, s.y - (p.y - 2) AS dy, s.z - (p.z - 1) AS dz, s.v FROM v3 p, v3 s WHERE p.v > 16 AND s.x - p.x BETWEEN -2 AND 2 AND s.y - p.y BETWEEN -2 AND 1 AND s.z - p.z BETWEEN -1 AND 1)"
add("extract_subtomos", _cut, _ex + " SELECT * FROM ex")
add("average_subtomos", lambda s, d: six(Pp.average(_cut(s, d), 100), "v"), _ex + " SELECT dx, dy, dz, round(sum(v) / 100, 6) AS v FROM ex GROUP BY ALL")
add("visible_points", lambda s, d: Pp.rank_visible(t.table(s, d, "events").select("event_id", F.col("value").alias("score")), 20, 90), "SELECT event_id, value AS score FROM events, (SELECT quantile_cont(value, 0.2) AS a, quantile_cont(value, 0.9) AS b FROM events) WHERE value BETWEEN a AND b")
add("join_attributes", lambda s, d: Pp.join_attributes(t.volume(s, d).select("x", "y", "z"), t.volume(s, d).where("v > 14").select("x", "y", "z", F.col("v").alias("score"), F.lit(5.0).alias("euler_x"))), f"WITH {t.V3} SELECT a.x, a.y, a.z, coalesce(b.v, 1.0) AS score, CASE WHEN b.v IS NULL THEN 0.0 ELSE 5.0 END::DOUBLE AS euler_x FROM v3 a LEFT JOIN v3 b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND b.v > 14")


def _discovered(s, d):
    f = t.table(s, d, "tomo_files")
    each = [f.where(F.col(c).isNotNull()).select(F.col(c).alias("path")) for c in ("tomogram", "metadata", "mask")]
    return Pp.discover(*each)


def _id_sql(c: str) -> str:
    name = f"regexp_replace(regexp_replace({c}, '^.*/', ''), '\\.[A-Za-z0-9]+$', '')"
    return f"regexp_replace(regexp_replace({name}, '(_(?:[0-9]+(?:\\.[0-9]+)?Apx|bin[0-9]+|lp[0-9]+|mask|rec|filtered))+$', ''), '^(rec_|tomo_|mask_)', '')"


add("discover_tomograms", _discovered, "WITH " + ", ".join(f"f_{c} AS (SELECT {_id_sql(c)} AS tomo, min({c}) AS {c} FROM tomo_files WHERE {c} IS NOT NULL GROUP BY 1)" for c in ("tomogram", "metadata", "mask")) + " SELECT tomo, tomogram, metadata, mask FROM f_tomogram JOIN f_metadata USING (tomo) LEFT JOIN f_mask USING (tomo)")

# refinement at fixed poses
_POINTS = tuple((x, y, z, float(g)) for x, y, z, g, _ in t.POINTS)


def _poses(s, d):
    return t.volume(s, d).where("v > 15").select(F.expr("x * 1000 + y * 10 + z").cast("bigint").alias("pose_id"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))


_sm = f"WITH {t.V3}, pt AS (SELECT * FROM {t.values(_POINTS, 'ox, oy, oz, w')}), sm AS (SELECT CAST(p.x * 1000 + p.y * 10 + p.z AS BIGINT) AS pose_id, CAST(w AS DOUBLE) AS w, coalesce(s.v, 0.0) AS v FROM v3 p CROSS JOIN pt LEFT JOIN v3 s ON s.x = p.x + ox AND s.y = p.y + oy AND s.z = p.z + oz WHERE p.v > 15)"
for _n, _score, _sql in (
    ("cc_at_pose", "CrossCorrelation", "sum(w * v)"),
    ("ncc_at_pose", "NormalizedCrossCorrelation", "sum(w * v) / (sqrt(sum(w * w)) * sqrt(sum(v * v)))"),
    ("masked_cc_at_pose", "MaskedCrossCorrelation", "CASE WHEN sqrt(greatest(0.0, sum(w * w) - sum(w) ** 2 / count(*))) * sqrt(greatest(0.0, sum(v * v) - sum(v) ** 2 / count(*))) > 1e-9 THEN (sum(w * v) - sum(w) * sum(v) / count(*)) / (sqrt(greatest(0.0, sum(w * w) - sum(w) ** 2 / count(*))) * sqrt(greatest(0.0, sum(v * v) - sum(v) ** 2 / count(*)))) ELSE 0.0 END"),
    ("plsq_at_pose", "PartialLeastSquareDifference", "-sum((v - w) ** 2)"),
):
    add(_n, lambda s, d, k=_score: six(R.pose_scores(t.volume(s, d), _poses(s, d), _POINTS, k), "s"), _sm + f" SELECT pose_id, round({_sql}, 6) + 0.0 AS s FROM sm GROUP BY 1")
add("envelope_at_pose", lambda s, d: R.envelope(t.volume(s, d), _poses(s, d), _POINTS, 12), _sm + " SELECT pose_id, sum(CASE WHEN v > 12 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS s FROM sm GROUP BY 1")


def _clouds(s, d):
    return t.image(s, d, ("event_type",)).where("v > 4").select(F.col("event_type").alias("set_id"), *[F.col(a).cast("double").alias(a) for a in "xyz"])


_chamfer = f"WITH {t.V2K}, {t.V2}, n AS (SELECT a.event_type AS set_id, a.x, a.y, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM v2k a LEFT JOIN v2 b ON b.v > 20 WHERE a.v > 4 GROUP BY ALL) SELECT set_id, round(avg({{}}), 6) AS distance, count(*) AS n FROM n GROUP BY 1"


def _chamfered(limit):
    def query(s, d):
        others = t.image(s, d).where("v > 20").select(*[F.col(a).cast("double").alias(a) for a in "xyz"])
        return six(R.chamfer(_clouds(s, d), others, 2.0, limit), "distance")

    return query


add("chamfer", _chamfered(None), _chamfer.format("d"))
add("chamfer_limited", _chamfered(4.0), _chamfer.format("least(coalesce(d, 4.0), 4.0)"))


def _optimised(s, d):
    best = P.maximum_filter(t.volume(s, d).select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), F.col("v").alias("s")), 5, t.V3_BOUNDS)
    picks = best.select(F.expr("tx * 1000 + ty * 10 + tz").cast("bigint").alias("pick_id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    patches = R.to_patches(Pp.extract(t.volume(s, d), picks, (9, 9, 9)), (9, 9, 9))
    return six(R.refine_patches(patches, [(x, y, z, g) for x, y, z, g in _POINTS]), "dx", "dy", "dz", "ax", "ay", "az", "s")


add("optimize_pose", _optimised)
