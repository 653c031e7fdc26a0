"""Atom files as lines: of any length, a batch of which is held at a time."""

from __future__ import annotations

import pytest

from rotogrid.plans import catalog
from rotogrid.sources import structures as St
from tests import test_catalog

QUERIES = ["gro_roundtrip", "mmcif_roundtrip"]


@pytest.mark.skipif(not test_catalog.DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_no_row_holds_a_file(spark, name):
    plan = catalog.QUERIES[name](spark, str(test_catalog.DATA))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan
    test_catalog.test_equal_to_sql(spark, name)


def gro(n: int, frames: int = 1) -> list[str]:
    return [line for f in range(frames) for line in ("title", str(n), *[f"{i % 1000:5d}{'ALA':<5}{'CA':>5}{i % 100000:5d}{i % 70:8.3f}{f:8.3f}{-1:8.3f}" for i in range(n)], " 0 0 0")]


def test_gro_is_read_as_it_comes():
    seen = []
    batches = St._gro_batches("p", (seen.append(1) or line for line in gro(3 * St.ROWS)))
    first = next(batches)
    assert first.num_rows == St.ROWS and len(seen) <= St.ROWS + 3
    assert sum(b.num_rows for b in batches) == 2 * St.ROWS


def test_gro_frames_across_batches(spark):
    n = St.ROWS + 5
    files = {"two": gro(n, 2), "bad": ["t", "3", *gro(3)[2:4], "no atom"], "none": ["t", "x", "y"], "": [], "minus": ["t", "-3", "box", *gro(2)]}
    lines = spark.createDataFrame([(p, k, v) for p, text in files.items() for k, v in enumerate(text)][::-1], "path string, line_no int, value string").repartition(7)
    bodies = spark.createDataFrame([(p, "\n".join(text)) for p, text in files.items()] + [("null", None)], "path string, body string")
    for rows in (St.parse_lines(lines, "gro").collect(), St.parse_bodies(bodies, "gro").collect()):
        two = sorted((r for r in rows if r.path == "two"), key=lambda r: int(r.chain))
        assert [(r.atom_serial_number, r.residue, r.x, r.y, r.z, r.chain, r.element_symbol, r.charge) for r in two] == [(i % 100000, i % 1000, i % 70, f, -1, str(f), "C", None) for f in range(2) for i in range(n)]
        assert {p: sum(r.path == p for r in rows) for p in ("bad", "none", "", "minus", "null")} == {"bad": 2, "none": 0, "": 0, "minus": 2, "null": 0}
    with pytest.raises(NotImplementedError):
        St.parse_lines(lines, "pdb")


def cif(n: int) -> list[str]:
    """Every third row is wrapped, every fifth has a quoted name, every hundredth a folded one."""
    names = ["group_PDB", "id", "label_atom_id", "Cartn_x", "label_seq_id", "pdbx_formal_charge"]
    lines = ["data_x", "#", "_cell.a 1", "loop_", *[f"_atom_site.{c}" for c in names]]
    for i in range(n):
        lines += ["ATOM", f"{i}", "; C", "A", ";", f"{i % 70}.5 . ?"] if i % 100 == 0 else [f"ATOM {i}", f"\"C'\" {i % 70}.5 7 2+"] if i % 15 == 0 else [f"ATOM {i} 'C A' {i % 70}.5 7 2+"] if i % 5 == 0 else [f"ATOM {i}", f"CA {i % 70}.5 x 2+"] if i % 3 == 0 else [f"ATOM {i} CA {i % 70}.5 7 2+"]
    return [*lines, "#", "loop_", "_other.a", "1", "2"]


def atom(i: int) -> tuple:
    name = "C A" if i % 100 == 0 else "C'" if i % 15 == 0 else "C A" if i % 5 == 0 else "CA"
    return (i, name, i % 70 + 0.5, 0 if i % 100 == 0 else None if i % 5 and i % 3 == 0 else 7, None if i % 100 == 0 else "2+", 0.0, None)


def test_cif_is_read_as_it_comes():
    seen = []
    batches = St._cif_batches("p", (seen.append(1) or line for line in cif(3 * St.ROWS)))
    first = next(batches)
    assert first.num_rows == St.ROWS and len(seen) < 2 * St.ROWS
    assert sum(b.num_rows for b in batches) == 2 * St.ROWS


def test_cif_rows_across_batches(spark):
    n = 2 * St.ROWS + 7
    items = ["data_y", "_atom_site.id 1", "_atom_site.Cartn_x 2.5", "_cell.a 1", "data_z", "_atom_site.id 2", "_atom_site.Cartn_y 3.5"]
    files = {"long": cif(n), "items": items, "after": [*items, *cif(2)], "": [], "none": ["loop_", "1 2"], "bare": ["_atom_site.id"]}
    lines = spark.createDataFrame([(p, k, v) for p, text in files.items() for k, v in enumerate(text)][::-1], "path string, line_no int, value string").repartition(7)
    bodies = spark.createDataFrame([(p, "\n".join(text)) for p, text in files.items()] + [("null", None)], "path string, body string")
    for rows in (St.parse_lines(lines, "cif").collect(), St.parse_bodies(bodies, "cif").collect()):
        got = {p: [(r.atom_serial_number, r.atom_name, r.x, r.residue, r.charge, r.y, r.chain) for r in rows if r.path == p] for p in (*files, "null")}
        single = [(1, None, 2.5, 0, None, 0.0, None), (2, None, 0.0, 0, None, 3.5, None)]
        assert got == {"long": list(map(atom, range(n))), "items": single, "after": [*single, atom(0), atom(1)], "": [], "none": [], "bare": [], "null": []}


def test_bodies_are_split_in_parts(monkeypatch):
    monkeypatch.setattr(St, "CHARS", 5)
    body = "one\r\n\ntwo three four\x0bfive\n;six\n\n"
    assert list(St._lines(body)) == body.splitlines() and list(St._lines(body + "end")) == (body + "end").splitlines()
