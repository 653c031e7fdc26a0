from __future__ import annotations

import random
import re
from decimal import Decimal

from rotogrid.operators.rejects import parse_atom_lines, split_atom_lines

CIF = ["group_PDB", "id", "label_atom_id", "label_comp_id", "Cartn_x", "Cartn_y", "Cartn_z"]
CSV = ["record_type", "atom_name", "residue_name", "x", "y", "z", "details"]
LOOPS = [("c", "cif", CIF, 1), ("v", "csv", CSV, 1), ("p", "pdb", None, 1), ("odd", "csv", ["a"], 1), ("none", None, None, 1)]


def cif_tokens(line):
    out, i = [], 0
    while i < len(line):
        if line[i] in " \t":
            i += 1
            continue
        if line[i] in "'\"":
            q, j = line[i], i + 1
            while j < len(line) and not (line[j] == q and (j + 1 == len(line) or line[j + 1] in " \t")):
                j += 1
            if j >= len(line):
                return None
            out.append(line[i + 1 : j])
            i = j + 1
        else:
            j = i
            while j < len(line) and line[j] not in " \t":
                j += 1
            out.append(line[i:j])
            i = j
    return out


def csv_fields(line):
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            value, j = "", i + 1
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] != '"':
                        break
                    j += 1
                value += line[j]
                j += 1
            i = j + 1
            if i < len(line) and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            value = line[i:j]
            if '"' in value:
                return None
            i = j
        out.append(value)
        if i >= len(line):
            return out
        i += 1


def expected(structure, raw):
    if raw is None or not re.match('"?(ATOM|HETATM)', raw):
        return None
    layout = {s: (k, c) for s, k, c, _ in LOOPS}.get(structure)
    if layout is None or layout[0] is None:
        return "columns"
    kind, names = layout
    if kind == "pdb":
        if not 54 <= len(raw) <= 80:
            return "columns"
        name, residue, *xyz = (raw[a:b].strip(" ") for a, b in ((12, 16), (17, 20), (30, 38), (38, 46), (46, 54)))
    else:
        cells = (cif_tokens if kind == "cif" else csv_fields)(raw)
        if cells is None:
            return "quoting"
        if len(cells) != len(names):
            return "columns"
        row = dict(zip(names, cells))
        name, residue, *xyz = (row.get(c) for c in (("label_atom_id", "label_comp_id", "Cartn_x", "Cartn_y", "Cartn_z") if kind == "cif" else ("atom_name", "residue_name", "x", "y", "z")))
    if not all(v is not None and re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)", v) and abs(Decimal(v)) < 10000 for v in xyz):
        return "coordinate"
    if name is None or not re.fullmatch(r"""[A-Z0-9'"*]{1,4}""", name):
        return "atom_name"
    if residue is None or not re.fullmatch("[A-Z0-9]{1,3}", residue):
        return "residue_name"
    return ""


def lines():
    rng = random.Random(3)
    pdb = "ATOM    207  O   SER B  42     -72.564  19.468  19.594  1.00 12.55           O"
    fixed = [
        None, "", "#", "ATOM", '"ATOM"', "HETATM", "ATOMS x", "REMARK", '"ATOM 1', "'ATOM' 1", pdb, pdb[:54], pdb[:53], pdb.ljust(80), pdb.ljust(81), pdb.replace("19.468", "1e4   "), pdb.replace("-72.564", "  -    "),
        "ATOM 1 C ALA 1 2 3", "ATOM 1 C\tALA  1 2 3 ", "ATOM 1 \"O5'\" ALA 1. .5 +3", "ATOM 1 'O5'' ALA 1 2 3", "ATOM 1 'O5''' ALA 1 2 3", "ATOM 1 '' ALA 1 2 3", "ATOM 1 'a b ALA 1 2 3",
        "ATOM 1 C ALA 10000 2 3", "ATOM 1 C ALA 0009999.9 2 3", "ATOM 1 C ALA 1e2 2 3", "ATOM 1 C ALA １ 2 3", "ATOM 1 c ALA 1 2 3", "ATOM 1 C ALAX 1 2 3", "ATOM 1 ABCDE ALA 1 2 3",
        "ATOM,C,ALA,1,2,3,", "ATOM,C,ALA,1,2,3", 'ATOM,"C",ALA,1,2,3,"a,b"', 'ATOM,"C""",ALA,1,2,3,x', 'ATOM,"C"x,ALA,1,2,3,x', 'ATOM,C"x,ALA,1,2,3,x', 'ATOM,C,ALA,1,2,3,"x', '"ATOM",C,ALA,1,2,3,""', "ATOM,C,ALA,9999.99999999999999999,2,3,x\r", "ATOM," + "x" * 70000, "ATOM " + "y " * 40000,
    ]
    parts = ["ATOM", '"', "'", ",", " ", "\t", "C", "ALA", "1.5", "-2", "''", '""', "x"]
    made = ["ATOM" + "".join(rng.choice(parts) for _ in range(rng.randint(3, 20))) for _ in range(400)]
    return [(i, s, raw, "clash") for i, (s, raw) in enumerate((s, raw) for raw in fixed + made + fixed[:12] for s in ("c", "v", "p", "odd", "none", "gone", None))]


def test_failures_equal_a_character_scanner(spark):
    data = lines()
    table = spark.createDataFrame(data, "line_id bigint, structure_id string, raw string, kind string")
    loops = spark.createDataFrame(LOOPS, "structure_id string, file_kind string, column_names array<string>, raw int")
    rows = parse_atom_lines(table, loops).collect()
    got = {r.line_id: r.failure for r in rows}
    assert len(rows) == len(got)
    assert got == {i: e for i, s, raw, _ in data if (e := expected(s, raw)) is not None}
    atoms, rejects = split_atom_lines(table, loops)
    assert atoms.count() + rejects.count() == len(rows)
    one = atoms.orderBy("line_id").first()
    assert None not in tuple(one)


def test_empty_tables(spark):
    table = spark.createDataFrame([], "line_id bigint, structure_id string, raw string")
    loops = spark.createDataFrame([], "structure_id string, file_kind string, column_names array<string>")
    assert parse_atom_lines(table, loops).count() == 0
