from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotogrid.operators import atoms as At
from rotogrid.operators import grid as G
from rotogrid.sources import picks as Pk
from rotogrid.sources import structures as St
from rotogrid.sources import text as Tx
from rotogrid.sources import volumes as V


@pytest.mark.parametrize("kind", ["mrc", "em"])
@pytest.mark.parametrize("dtype", ["float32", "int16", "float64", "complex64"])
@pytest.mark.parametrize("gz", [False, True])
def test_volume_files_round_trip(kind, dtype, gz):
    a = (np.arange(60).reshape(3, 4, 5) * 1.5).astype(dtype)
    content = V.write_mrc(a, (1, 2, 3), (2, 2, 2), gz) if kind == "mrc" else V.write_em(a, 2.0, gz)
    back, origin, rate = V.read(content, f"x.{kind}" + ".gz" * gz)
    assert np.allclose(back, a) and np.allclose(rate, 2) and (kind == "em" or np.allclose(origin, (1, 2, 3)))


def test_volume_source(spark, tmp_path):
    a = np.random.default_rng(2).random((10, 7, 5)).astype(np.float32)
    (tmp_path / "one.mrc").write_bytes(V.write_mrc(a, (0, 0, 0), (1.5, 1.5, 1.5)))
    blocks = V.read_volumes(spark, str(tmp_path), edge=4)
    assert blocks.count() == 3 * 2 * 2 and blocks.first().shape == [10, 7, 5]
    V.write_volume(blocks, str(tmp_path / "two.mrc.gz"), (10, 7, 5), (0, 0, 0), (1.5,) * 3)
    assert np.allclose(V.read((tmp_path / "two.mrc.gz").read_bytes(), "two.mrc.gz")[0], a)
    part = V.read_volumes(spark, str(tmp_path / "one.mrc"), 64, [(2, 6), (0, 7), (1, 3)]).first()
    assert np.allclose(np.frombuffer(part.data).reshape(part.block_shape), a[2:6, :, 1:3]) and part.origin == [3.0, 0.0, 1.5]
    for bad in ([(0, 1)], [(0, 11), (0, 1), (0, 1)], [(-1, 2), (0, 1), (0, 1)]):
        with pytest.raises(ValueError):
            V.validate_subset(bad, (10, 7, 5))
    with pytest.raises(NotImplementedError):
        V.read(b"", "x.h5")


CIF = """data_x
#
_exptl.method   'ELECTRON MICROSCOPY'
_em.note
;first line
second line
;
_em.voltage 300
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.Cartn_x
ATOM 1 "O5'" ALA 1.5
HETATM 2 'C A'
ZN x
loop_
_other.a
_other.b
1 2
3 4
"""


def test_mmcif_categories():
    c = St.cif_categories(CIF)
    assert c["exptl"]["method"] == ["ELECTRON MICROSCOPY"] and c["em"] == {"note": ["first line second line"], "voltage": ["300"]}
    assert c["atom_site"]["label_atom_id"] == ["O5'", "C A"] and c["atom_site"]["Cartn_x"] == ["1.5", "x"] and c["other"] == {"a": ["1", "3"], "b": ["2", "4"]}
    rows = list(St._cif_rows("p", CIF))
    assert rows[0]["x"] == 1.5 and rows[1]["x"] is None and rows[1]["residue_name"] == "ZN" and rows[0]["y"] == 0
    assert St.cif_categories("") == {}


def test_serials_and_bad_cells(spark):
    line = "ATOM  {}  CA  ALA A   1      11.000  12.000  {}  1.00  0.50      SEG1 C  "
    rows = spark.createDataFrame([("f", 0, line.format("    7", " 3.000")), ("f", 1, line.format("A0001", "   bad")), ("f", 2, "REMARK")], "path string, line_no int, value string")
    got = St.parse_pdb(rows).orderBy("line_no").collect()
    assert [r.atom_serial_number for r in got] == [7, 100001] and got[0].z == 3.0 and got[1].z is None and got[0].segment == "SEG1"
    assert St.parse_pdb(rows.limit(0)).count() == 0


def test_star_mdoc_xml():
    star = "# v\ndata_particles\nloop_\n_rlnCoordinateX #1\n_rlnCoordinateY #2\n_rlnCoordinateZ #3\n1 2 3\n4 5 6\ndata_other\n_key value\n"
    assert Tx.star_sections(star) == {"data_particles": {"rlnCoordinateX": ["1", "4"], "rlnCoordinateY": ["2", "5"], "rlnCoordinateZ": ["3", "6"]}, "data_other": {"key": ["value"]}}
    assert [r["x"] for r in Pk.parse_star(star)] == [1.0, 4.0] and Pk.parse_star(star)[0]["score"] is None and Pk.parse_star(star, "rlnCoordinateZ")[1]["score"] == 6.0
    with pytest.raises(ValueError):
        Pk.parse_star("data_\nloop_\n_a\n1\n")
    settings, columns, comments = Tx.mdoc("PixelSpacing = 2.5\n[T = made]\n[ZValue = 0]\nTiltAngle = -60\nExposureDose = 2\n[ZValue = 1]\nTiltAngle = -57.5\nExposureDose = 2\nDefocus = -3\n")
    assert settings == {"PixelSpacing": 2.5} and comments == ["made"] and columns["TiltAngle"] == [-60, -57.5] and columns["Defocus"] == [None, -3]
    assert Tx.xml_tree('<a b="1"><c>1\n2</c><d/><d x="t"/></a>') == {"a": {"@attributes": {"b": 1}, "c": [1, 2], "d": [{}, {"@attributes": {"x": "t"}}]}}


def test_tilts_and_ctf():
    assert [r["weight"] for r in Tx.tilts("[ZValue = 0]\nTiltAngle = 1\nExposureDose = 3\n[ZValue = 1]\nTiltAngle = 2\nExposureDose = 3\n", "mdoc")] == [3.0, 6.0]
    assert [r["angle"] for r in Tx.tilts("-3\n0\n3\n", "text")] == [-3.0, 0.0, 3.0]
    assert Tx.tilts("angles\tweights\n1\t2\n", "text") == [{"tilt": 0, "angle": 1.0, "weight": 2.0}]
    assert len(Tx.tilts("<T><Angles>1\n2</Angles><Dose>3\n4</Dose></T>", "xml")) == 2
    for bad in (("a\tb\n1\t2\n", "text"), ("<T><Angles>1\n2</Angles><Dose>3</Dose></T>", "xml"), ("", "pdf")):
        with pytest.raises(ValueError):
            Tx.tilts(*bad)
    head = "# Pixel size: 1.5 Angstroms ; acceleration voltage: 300.0 keV ; spherical aberration: 2.70 mm ; amplitude contrast: 0.07\n1.0 20000 19000 45 1.5707963 0.1 5\n"
    row = Tx.ctf_rows(head, "ctffind")[0]
    assert (row["defocus_x"], row["rate"], row["voltage"]) == (20000, 1.5, 300) and row["phase"] == pytest.approx(90)
    assert Tx.ctf_rows("data_\nloop_\n_defocus\n_cs\n2.5 2.7\n", "star")[0]["defocus_x"] == 25000
    assert Tx.ctf_rows("[ZValue = 0]\nDefocus = -2\n", "mdoc")[0]["defocus_x"] == 20000
    assert Tx.ctf_rows('<T><CTF><Param Name="Defocus" Value="3"/><Param Name="Cs" Value="2.7"/></CTF></T>', "xml")[0]["aberration"] == pytest.approx(2.7e7)
    with pytest.raises(ValueError):
        Tx.ctf_rows('<T><CTF><Param Name="Cs" Value="2.7"/><Param Name="A" Value="2.7"/></CTF></T>', "xml")


def test_pick_texts():
    assert Pk.parse_text("x\ty\tz\n1\t2\t3\n") == [{"x": 1.0, "y": 2.0, "z": 3.0, "euler_x": 0.0, "euler_y": 0.0, "euler_z": 0.0, "score": 0.0, "detail": -1.0}]
    assert Pk.parse_text("") == []
    with pytest.raises(ValueError):
        Pk.parse_dynamo("1 2 3")


def test_superposition_and_superstructures(spark):
    rng = np.random.default_rng(3)
    a = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(50, 3)))], "serial int, x double, y double, z double")
    m = (0, -1, 0, 1, 0, 0, 0, 0, 1)
    b = At.transform(a, m, (3, 1, -2))
    rotation, shift, before, after = At.superpose(a, b, ["serial"])
    assert np.allclose(rotation.ravel(), m) and after < 1e-6 < before
    assert At.rmsd(a, b, ["serial"]).first().rmsd == pytest.approx(before)
    with pytest.raises(ValueError):
        At.superpose(a, b.limit(0), ["serial"])
    with pytest.raises(NotImplementedError):
        At.weighted(a, None, "charge")
    mean = b.agg(*[F.avg(c) for c in "xyz"]).first()
    assert np.allclose([mean[0] - 3, mean[1] - 1, mean[2] + 2], list(a.agg(*[F.avg(c) for c in "xyz"]).first()))


def test_boxes(spark):
    v = spark.createDataFrame([(0, 0, 0, 5.0), (3, 4, 1, 1.0)], "x int, y int, z int, v double")
    assert G.trim_bounds(v, 9.0).count() == 0
    assert tuple(G.trim_bounds(v, 0.5, 1, [(0, 5)] * 3).first()) == (0, 4, 0, 5, 0, 2)
    assert G.enclosing_edge(v, 0.0).first().edge == math.ceil(2 * math.sqrt(1.5**2 + 2**2 + 0.5**2)) + 1
    assert G.convolution_bounds((10, 10, 10), (3, 4, 5), "valid") == [(1, 8), (2, 8), (2, 7)]
    assert G.convolution_bounds((10,), (3,), "full") == [(-1, 10)]
    with pytest.raises(ValueError):
        G.convolution_bounds((10,), (3,), "part")


def test_tiff():
    a = np.random.default_rng(3).random((5, 4, 3)).astype(np.float32)
    body = V.write_tiff(a)
    assert np.array_equal(V.read(body, "a.tif")[0], a) and np.array_equal(V.read(V.write_tiff(a[:, :, 0]), "a.tiff")[0][:, :, 0], a[:, :, 0])
    for wrong in (b"", b"II", b"no tiff at all", body[:9]):
        with pytest.raises((ValueError, struct.error)):
            V.read(wrong, "a.tif")
