"""STAR, MDOC and XML texts as tables, and the CTF and tilt tables read from them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame


def star_sections(body: str) -> dict[str, dict[str, list[str]]]:
    """Each ``data_`` section's columns as lists of strings."""
    out: dict[str, dict[str, list[str]]] = {}
    names: list[str] = []
    table: dict[str, list[str]] = {}
    rows = False
    for line in body.lstrip("﻿").splitlines():
        line = line.strip()
        if not line or line[0] == "#":
            continue
        if line.startswith("data_"):
            table, names, rows = out.setdefault(line.split()[0], {}), [], False
        elif line == "loop_":
            names, rows = [], False
        elif line[0] == "_" and not rows:
            name, *value = line[1:].split()
            if value and not value[0].startswith("#"):
                table[name] = [" ".join(value)]
            else:
                names.append(name)
                table[name] = []
        else:
            rows = True
            for n, v in zip(names, line.split()):
                table[n].append(v)
    return out


def value(text: str):
    """true and false, integers, decimals, else the text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for cast in (int, float):
        try:
            return cast(text)
        except ValueError:
            pass
    return text


def mdoc(body: str) -> tuple[dict, dict[str, list], list[str]]:
    """Global settings, per-section columns of the ``[ZValue = n]`` sections, and ``[T = ...]`` comments."""
    settings, columns, comments, n = {}, {}, [], 0
    section = False
    for line in body.splitlines():
        line = line.strip()
        if m := re.fullmatch(r"\[\s*(\w+)\s*=\s*(.*?)\s*\]", line):
            if m.group(1) == "T":
                comments.append(m.group(2))
            else:
                section = True
                n += 1
                columns.setdefault(m.group(1), []).append(value(m.group(2)))
        elif "=" in line:
            k, v = (x.strip() for x in line.split("=", 1))
            if section:
                column = columns.setdefault(k, [])
                column += [None] * (n - 1 - len(column)) + [value(v)]
            else:
                settings[k] = value(v)
    return settings, {k: v + [None] * (n - len(v)) for k, v in columns.items()}, comments


def xml_tree(body: str):
    """Element tree as nested dicts: attributes under ``@attributes``, repeated tags as lists, lines of text as lists."""

    def convert(e):
        out = {"@attributes": {k: value(v) for k, v in e.attrib.items()}} if e.attrib else {}
        for child in e:
            made = convert(child)
            if child.tag in out:
                out[child.tag] = (out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]) + [made]
            else:
                out[child.tag] = made
        text = (e.text or "").strip()
        if text and not out:
            lines = [value(x.strip()) for x in text.splitlines() if x.strip()]
            return lines if len(lines) > 1 else lines[0]
        return out

    root = ElementTree.fromstring(body)
    return {root.tag: convert(root)}


def _lines(x) -> list:
    return x if isinstance(x, list) else [x]


def tilts(body: str, kind: str) -> list[dict]:
    """angle and weight of each tilt from text, star, xml or mdoc; weights are 1 where none are given."""
    if kind == "xml":
        tree = next(iter(xml_tree(body).values()))
        angles, weights = _lines(tree["Angles"]), _lines(tree.get("Dose", [1.0] * len(_lines(tree["Angles"]))))
    elif kind == "mdoc":
        _, c, _ = mdoc(body)
        angles = c["TiltAngle"]
        dose = c.get("ExposureDose") or [None] * len(angles)
        weights = [(1 + z) * d if d is not None else 1.0 for z, d in zip(c.get("ZValue", range(len(angles))), dose)]
    elif kind == "star":
        table = next(t for t in star_sections(body).values() if {"tilt_angle", "wrpAxisAngle", "angles"} & set(t))
        angles = next(table[n] for n in ("tilt_angle", "wrpAxisAngle", "angles") if n in table)
        weights = next((table[n] for n in ("exposure", "wrpDose", "weights") if n in table), [1.0] * len(angles))
    elif kind == "text":
        rows = [x.split("\t") for x in body.lstrip("﻿").splitlines() if x.strip() and not x.startswith("#")]
        names = [n.strip() for n in rows[0]]
        if "angles" in names:
            angles = [r[names.index("angles")] for r in rows[1:]]
            weights = [r[names.index("weights")] for r in rows[1:]] if "weights" in names else [1.0] * len(angles)
        elif all(len(r) == 1 for r in rows):
            angles, weights = [r[0] for r in rows], [1.0] * len(rows)
        else:
            raise ValueError("tilts are one column without a header, or have a header with angles")
    else:
        raise ValueError(f"no tilt files of kind {kind}")
    if len(angles) != len(weights):
        raise ValueError("as many weights as angles")
    return [{"tilt": i, "angle": float(a), "weight": float(w)} for i, (a, w) in enumerate(zip(angles, weights))]


def ctf_rows(body: str, kind: str) -> list[dict]:
    """defocus (angstrom), astigmatism angle and phase shift (degrees) and the microscope's constants per tilt."""
    blank = dict.fromkeys(("voltage", "aberration", "contrast", "rate"))
    if kind == "ctffind":
        head = {k: float(m.group(1)) for k, p in (("rate", r"Pixel size:\s*([\d.]+)"), ("voltage", r"acceleration voltage:\s*([\d.]+)"), ("aberration", r"spherical aberration:\s*([\d.]+)"), ("contrast", r"amplitude contrast:\s*([\d.]+)")) if (m := re.search(p, body))}
        out = []
        for i, line in enumerate(x for x in body.splitlines() if x.strip() and not x.startswith("#")):
            c = [float(x) for x in line.split()]
            out.append({"tilt": i, "defocus_x": c[1], "defocus_y": c[2], "astigmatism": c[3], "phase": math.degrees(c[4]), **blank, **head})
        return out
    if kind == "star":
        table = next(t for t in star_sections(body).values() if {"defocus", "rlnDefocusU"} & set(t))
        n = len(next(iter(table.values())))
        number = lambda k, i, s=1.0: float(table[k][i]) * s if k in table else None
        if "defocus" in table:
            return [{"tilt": i, "defocus_x": number("defocus", i, 1e4), "defocus_y": number("defocus2", i, 1e4), "astigmatism": number("astig_ang", i), "phase": number("pshift", i), "voltage": number("voltage", i), "aberration": number("cs", i, 1e7), "contrast": number("amp_contrast", i), "rate": number("pixelsize", i)} for i in range(n)]
        return [{"tilt": i, "defocus_x": number("rlnDefocusU", i), "defocus_y": number("rlnDefocusV", i), "astigmatism": number("rlnDefocusAngle", i), "phase": number("rlnPhaseShift", i), "voltage": number("rlnVoltage", i), "aberration": number("rlnSphericalAberration", i, 1e7), "contrast": number("rlnAmplitudeContrast", i), "rate": None} for i in range(n)]
    if kind == "mdoc":
        _, c, _ = mdoc(body)
        return [{"tilt": i, "defocus_x": -1e4 * d, "defocus_y": None, "astigmatism": None, "phase": None, **blank} for i, d in enumerate(c["Defocus"])]
    if kind == "xml":
        tree = next(iter(xml_tree(body).values()))
        p = {x["@attributes"]["Name"]: x["@attributes"]["Value"] for x in _lines(tree["CTF"]["Param"])}
        if "Defocus" not in p:
            raise ValueError("no Defocus among the CTF parameters")
        grid = [n["@attributes"]["Value"] for n in _lines(tree["GridCTF"]["Node"])] if "GridCTF" in tree else [p["Defocus"]]
        return [{"tilt": i, "defocus_x": d * 1e4, "defocus_y": (d - p.get("DefocusDelta", 0.0)) * 1e4, "astigmatism": p.get("DefocusAngle", 0.0), "phase": p.get("PhaseShift", 0.0) * 180, "voltage": p.get("Voltage"), "aberration": p["Cs"] * 1e7 if "Cs" in p else None, "contrast": p.get("Amplitude"), "rate": p.get("PixelSize")} for i, d in enumerate(grid)]
    raise ValueError(f"no CTF files of kind {kind}")


TABLES = {
    "tilts": (tilts, "path string, tilt int, angle double, weight double"),
    "ctf": (ctf_rows, "path string, tilt int, defocus_x double, defocus_y double, astigmatism double, phase double, voltage double, aberration double, contrast double, rate double"),
}


def parse_table(files: DataFrame, table: str, kind: str) -> DataFrame:
    """Tilts or CTF rows of whole files (path, body)."""
    parser, columns = TABLES[table]
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in columns.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [{"path": path} | {k: None if v is None else float(v) if k not in ("tilt",) else v for k, v in r.items()} for r in parser(body, kind)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "body").mapInArrow(run, columns)


def xml_cells(body: str) -> dict[str, dict[str, list]]:
    """The values of an XML tree by the path of their element: attributes under ``@`` and their name, texts under the tag, in
    document order; nothing for a body that isn't well formed."""
    try:
        tree = xml_tree(body)
    except ElementTree.ParseError:
        return {}
    out: dict[str, dict[str, list]] = {}
    todo: list[tuple[str, str, object]] = [("", tag, node) for tag, node in tree.items()]
    while todo:
        path, tag, node = todo.pop()
        here = f"{path}/{tag}" if path else tag
        if isinstance(node, list):
            todo += [(path, tag, x) for x in reversed(node)]
        elif not isinstance(node, dict):
            out.setdefault(path, {}).setdefault(tag, []).append(node)
        else:
            for k, v in node.get("@attributes", {}).items():
                out.setdefault(here, {}).setdefault(f"@{k}", []).append(v)
            todo += [(here, k, x) for k, x in reversed(node.items()) if k != "@attributes"]
    return out


def parse_cells(files: DataFrame, kind: str) -> DataFrame:
    """(path, section, name, row_no, value) of every cell of star, mdoc or xml files: a table for any columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("section", pa.string()), ("name", pa.string()), ("row_no", pa.int32()), ("value", pa.string())])
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if kind == "star":
                    tables = star_sections(body or "")
                elif kind == "xml":
                    tables = xml_cells(body or "")
                else:
                    settings, columns, _ = mdoc(body or "")
                    tables = {"": {k: [v] for k, v in settings.items()}, "ZValue": columns}
                rows = [{"path": path, "section": s, "name": n, "row_no": i, "value": None if v is None else str(v)} for s, t in tables.items() for n, c in t.items() for i, v in enumerate(c)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "body").mapInArrow(run, "path string, section string, name string, row_no int, value string")
