"""Atom files (PDB, mmCIF, GRO) to rows and back."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, count, groupby, islice
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = (
    "path string, record_type string, atom_serial_number bigint, atom_name string, alternate_location_indicator string, residue_name string, chain string, "
    "residue int, code_for_residue_insertion string, x double, y double, z double, occupancy double, temperature_factor double, segment string, element_symbol string, charge string"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
#: Fixed places (0-based, half-open) of a PDB atom record, one layout for reading and writing.
PLACES = {
    "record_type": (0, 6), "atom_serial_number": (6, 11), "atom_name": (12, 16), "alternate_location_indicator": (16, 17), "residue_name": (17, 20), "chain": (21, 22), "residue": (22, 26),
    "code_for_residue_insertion": (26, 27), "x": (30, 38), "y": (38, 46), "z": (46, 54), "occupancy": (54, 60), "temperature_factor": (60, 66), "segment": (72, 76), "element_symbol": (76, 78), "charge": (78, 80),
}
#: Rows of a batch that a reader of text gives, and the characters of a body that it splits into lines at once.
ROWS, CHARS = 10_000, 1 << 20
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in COLUMNS.split(", ")])
KINDS = {"atom_serial_number": "bigint", "residue": "int", **dict.fromkeys(("x", "y", "z", "occupancy", "temperature_factor"), "double")}
CIF = {
    "record_type": "group_PDB", "atom_serial_number": "id", "atom_name": "label_atom_id", "alternate_location_indicator": "label_alt_id", "residue_name": "label_comp_id", "chain": "label_asym_id", "residue": "label_seq_id",
    "code_for_residue_insertion": "pdbx_PDB_ins_code", "x": "Cartn_x", "y": "Cartn_y", "z": "Cartn_z", "occupancy": "occupancy", "temperature_factor": "B_iso_or_equiv", "segment": "label_entity_id", "element_symbol": "type_symbol", "charge": "pdbx_formal_charge",
}


def serial(text: Column) -> Column:
    """Serial numbers, beyond 99,999 in base 36 from A0000 on."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")).when(
        text.rlike("^[A-Z][0-9A-Z]{4}$"), F.conv(text, 36, 10).cast("bigint") - (int("A0000", 36) - 100_000)
    )


def parse_pdb(lines: DataFrame) -> DataFrame:
    """ATOM and HETATM records of (path, line_no, value) rows by fixed places; cells that don't cast are null, one by one."""
    rows = lines.where(F.col("value").rlike("^(ATOM|HETATM)"))
    cells = {n: F.trim(F.substring("value", a + 1, b - a)) for n, (a, b) in PLACES.items()}
    out = []
    for n, c in cells.items():
        if n == "atom_serial_number":
            c = serial(c)
        elif n in KINDS:
            c = c.try_cast(KINDS[n])
        out.append(c.alias(n))
    return rows.select("path", "line_no", *out)


def format_pdb(atoms: DataFrame) -> Column:
    """The 80-character record of each atom; chains keep one character, serials beyond 99,999 turn to base 36."""
    c = F.col
    number = c("atom_serial_number")
    text = F.when(number < 100_000, F.lpad(number.cast("string"), 5, " ")).otherwise(F.lpad(F.conv((number + (int("A0000", 36) - 100_000)).cast("string"), 10, 36), 5, " "))
    blank = lambda n, w: F.rpad(F.coalesce(c(n), F.lit("")), w, " ")
    name = F.when(F.length("atom_name") < 4, F.rpad(F.concat(F.lit(" "), "atom_name"), 4, " ")).otherwise(F.substring("atom_name", 1, 4))
    return F.concat(
        F.rpad("record_type", 6, " "), text, F.lit(" "), name, blank("alternate_location_indicator", 1), F.lpad("residue_name", 3, " "), F.lit(" "), F.rpad(F.substring("chain", 1, 1), 1, " "),
        F.lpad(c("residue").cast("string"), 4, " "), blank("code_for_residue_insertion", 1), F.lit("   "), *[F.format_string("%8.3f", n) for n in "xyz"], F.format_string("%6.2f", "occupancy"), F.format_string("%6.2f", "temperature_factor"),
        F.lit("      "), blank("segment", 4), F.lpad(F.coalesce(c("element_symbol"), F.lit("")), 2, " "), blank("charge", 2),
    )


def split_cif(line: str) -> list[str]:
    """Tokens of an mmCIF line; quotes close before a blank or the line's end."""
    return [m.group(1) or m.group(2) or m.group(3) or "" for m in re.finditer(r"""'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(\S+)""", line)]


def cif_loops(lines: Iterable[str]) -> Iterator[tuple[bool, list[tuple[str, str]], list[str]]]:
    """(loop or not, (category, name) of each column, cells) of an mmCIF text in order: of a loop whole rows, some thousands at a time, of a single item its value."""
    names: list[tuple[str, str]] = []
    cells: list[str] = []
    loop = begun = False
    text: list[str] | None = None

    def ready() -> list[tuple[bool, list[tuple[str, str]], list[str]]]:
        """What is whole, taken from the cells."""
        if not names or not cells:
            return []
        if not loop:
            return [(False, names[-1:], [" ".join(cells)])]
        whole = cells[: len(cells) - len(cells) % len(names)]
        del cells[: len(whole)]
        return [(True, names, whole)] if whole else []

    for line in lines:
        if text is not None and not line.startswith(";"):
            text.append(line)
            continue
        if text is not None:
            words, text, first = [" ".join(t.strip() for t in text)], None, ""
        elif line.startswith(";"):
            text = [line[1:]]
            continue
        else:
            words = line.split()
            if not words or words[0][0] == "#":
                continue
            first = words[0]
            if "'" in line or '"' in line:
                words = split_cif(line)
        if first.startswith("data_") or first == "loop_":
            yield from ready()
            cells.clear()
            names, loop, begun = [], first == "loop_", False
        elif first.startswith("_"):
            category, _, name = first[1:].partition(".")
            if not loop or begun or names and names[0][0] != category:
                yield from ready()
                cells.clear()
                names, loop, begun = [], False, False
            names.append((category, name))
            cells += words[1:]
            begun = begun or len(words) > 1
        else:
            cells += words
            begun = True
            if loop and len(cells) >= ROWS * len(names):
                yield from ready()
    if text is not None:
        cells.append(" ".join(t.strip() for t in text))
    yield from ready()


def cif_categories(body: str) -> dict[str, dict[str, list[str]]]:
    """Categories of an mmCIF text: loops and single items as columns of strings."""
    out: dict[str, dict[str, list[str]]] = {}
    for _, names, cells in cif_loops(_lines(body)):
        for k, (category, name) in enumerate(names):
            out.setdefault(category, {}).setdefault(name, []).extend(cells[k :: len(names)])
    return out


def _cast(value: str | None, kind: str):
    if value is None or value in (".", "?"):
        return None if kind == "string" else 0
    try:
        return value if kind == "string" else int(value) if kind in ("int", "bigint") else float(value)
    except ValueError:
        return None


def _casts(cells: list[str], kind: str) -> list:
    if kind != "string":
        try:
            return list(map(float if kind == "double" else int, cells))
        except ValueError:
            pass
    return [_cast(c, kind) for c in cells]


def _site_batch(path: str, site: dict[str, list[str]]) -> pa.RecordBatch:
    """Atoms of columns of one length; those that are missing are null, numbers 0."""
    columns = {ours: _casts(site[theirs], KINDS.get(ours, "string")) for ours, theirs in CIF.items() if theirs in site}
    return _batch(len(next(iter(site.values()))), columns, {"path": path} | dict.fromkeys(KINDS, 0))


def _cif_batches(path: str, lines: Iterable[str]) -> Iterator[pa.RecordBatch]:
    item: dict[str, list[str]] = {}
    for loop, names, cells in cif_loops(lines):
        if names[0][0] != "atom_site":
            continue
        if item and (loop or names[0][1] in item):
            yield _site_batch(path, item)
            item = {}
        site = {name: cells[k :: len(names)] for k, (_, name) in enumerate(names)}
        if loop:
            yield _site_batch(path, site)
        else:
            item |= site
    if item:
        yield _site_batch(path, item)


def _cif_rows(path: str, body: str) -> Iterator[dict]:
    for batch in _cif_batches(path, _lines(body)):
        yield from batch.to_pylist()


def _batch(n: int, columns: dict[str, Sequence], constants: dict) -> pa.RecordBatch:
    """n atoms; what is in neither is null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.repeat(pa.scalar(constants.get(f.name), f.type), n) for f in SCHEMA], schema=SCHEMA)


@lru_cache(4096)
def _element(name: str) -> str:
    return (re.match("[A-Za-z]", name) or [""])[0].upper()


def _gro_batches(path: str, lines: Iterable[str]) -> Iterator[pa.RecordBatch]:
    """Frames one after the other; the frame's number is the chain and segment. Positions are kept in the file's unit."""
    lines = iter(lines)
    for frame in map(str, count()):
        next(lines, None)
        try:
            n = int(next(lines, ""))
        except ValueError:
            return
        while n > 0 and (part := list(islice(lines, min(n, ROWS)))):
            n, rows = n - len(part), []
            for line in part:
                try:
                    rows.append((int(line[:5]), line[5:10].strip(), name := line[10:15].strip(), int(line[15:20]), float(line[20:28]), float(line[28:36]), float(line[36:44]), _element(name)))
                except ValueError:
                    continue
            if rows:
                columns = dict(zip(("residue", "residue_name", "atom_name", "atom_serial_number", "x", "y", "z", "element_symbol"), zip(*rows)))
                yield _batch(len(rows), columns, {"path": path, "record_type": "ATOM", "chain": frame, "segment": frame, "occupancy": 0.0, "temperature_factor": 0.0})
        next(lines, None)


#: For each kind of file, what makes batches of atoms of (path, lines).
READERS = {"cif": _cif_batches, "gro": _gro_batches}


def _reader(kind: str):
    if kind not in READERS:
        raise NotImplementedError(kind)
    return READERS[kind]


def _lines(body: str) -> Iterator[str]:
    """Lines of a text, of which only a part is split at a time."""
    at = 0
    while at < len(body):
        end = body.find("\n", at + CHARS) + 1 or len(body)
        yield from body[at:end].splitlines()
        at = end


def parse_bodies(files: DataFrame, kind: str) -> DataFrame:
    """Atoms of whole files (path, body) of kind ``cif`` or ``gro``."""
    read = _reader(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from read(path, _lines(body or ""))

    return files.select("path", "body").mapInArrow(run, COLUMNS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Neighbouring lines of one path in a batch."""
    for batch in batches:
        paths, start = pc.run_end_encode(batch.column(0)), 0
        for path, end in zip(paths.values.to_pylist(), paths.run_ends.to_pylist()):
            yield path, pc.fill_null(batch.column(1).slice(start, end - start), "").to_pylist()
            start = end


def parse_lines(lines: DataFrame, kind: str, order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Atoms of files of kind ``cif`` or ``gro`` as lines (path, value) in ``order``. A task reads a file from its first line to its last and holds a batch of it, so files may be of any size."""
    read = _reader(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, runs in groupby(_runs(batches), itemgetter(0)):
            yield from read(path, chain.from_iterable(values for _, values in runs))

    return lines.repartition("path").sortWithinPartitions("path", *order).select("path", "value").mapInArrow(run, COLUMNS)


def lines_of(rows: DataFrame, text: Column, order: str, header: Sequence[Column] = (), footer: Sequence[Column] = ()) -> DataFrame:
    """Files (path, place, line_no, value) of a line for each row: by ``place`` the header, the rows by ``order``, the footer. Header and footer may use ``n``, the rows of the file."""
    ends = [F.struct(F.lit(place).alias("place"), F.lit(k).cast("bigint").alias("line_no"), t.alias("value")) for place, texts in ((0, header), (2, footer)) for k, t in enumerate(texts)]
    body = rows.select("path", F.lit(1).alias("place"), F.col(order).cast("bigint").alias("line_no"), text.alias("value"))
    return body.unionByName(rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", F.inline(F.array(*ends)))) if ends else body


def quote(value: Column) -> Column:
    """mmCIF quoting of values with blanks or quotes; empty and null become '.'."""
    value = F.coalesce(F.when(value == "", None).otherwise(value), F.lit("."))
    return F.when(value.contains("'"), F.concat(F.lit('"'), value, F.lit('"'))).when(value.rlike(r"\s"), F.concat(F.lit("'"), value, F.lit("'"))).otherwise(value)


def format_cif(atoms: DataFrame) -> Column:
    """The atom_site row of each atom, in the order of :func:`cif_header`."""
    cells = [F.format_string("%.3f", n) if n in "xyz" else F.format_string("%.2f", n) if KINDS.get(n) == "double" else quote(F.col(n).cast("string")) for n in CIF]
    return F.concat_ws(" ", *cells)


def cif_header(name: str = "structure") -> list[str]:
    return [f"data_{name}", "loop_", *[f"_atom_site.{c}" for c in CIF.values()]]


def format_gro(atoms: DataFrame) -> Column:
    return F.format_string("%5d%-5s%5s%5d%8.3f%8.3f%8.3f", F.col("residue") % 100000, "residue_name", "atom_name", F.col("atom_serial_number") % 100000, "x", "y", "z")


def select_atoms(atoms: DataFrame, elements: list[str] | None = None, residues: list[str] | None = None, keep_other_records: bool = False) -> DataFrame:
    """Filter by element and residue names and, by default, to ATOM records."""
    if elements:
        atoms = atoms.where(F.col("element_symbol").isin(list(elements)))
    if residues:
        atoms = atoms.where(F.col("residue_name").isin(list(residues)))
    return atoms if keep_other_records else atoms.where(F.col("record_type") == "ATOM")


def read_lines(spark, path: str) -> DataFrame:
    """(path, line_no, value) of text files, numbered from 0; a file is read whole, so that the numbers are its own."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "value"))
