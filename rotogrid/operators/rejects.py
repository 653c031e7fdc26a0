"""Loading of atom lines: valid atoms as a table, the other records with the reason of failure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotogrid.operators.skew import join_small

RECORD = r'^"?(ATOM|HETATM)'
#: Fields an atom needs, by the names each kind of file gives them.
NEEDED = {
    "csv": ("atom_name", "residue_name", "x", "y", "z"),
    "cif": ("label_atom_id", "label_comp_id", "Cartn_x", "Cartn_y", "Cartn_z"),
}
#: Fixed places (0-based, half-open) of the needed fields in a pdb line.
PDB_PLACES = ((12, 16), (17, 20), (30, 38), (38, 46), (46, 54))
PDB_LENGTHS = (54, 80)

CSV_LINE = r'^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$'
_IN_SINGLE, _IN_DOUBLE = r"(?:[^']|'+[^' \t])*", r'(?:[^"]|"+[^" \t])*'
CIF_LINE = rf"""^(?:(?:'{_IN_SINGLE}'+|"{_IN_DOUBLE}"+|[^ \t'"][^ \t]*)(?:[ \t]+|$))*$"""
CIF_TOKEN = rf"""(?:'({_IN_SINGLE}'*)'|"({_IN_DOUBLE}"*)"|([^ \t'"][^ \t]*))(?:[ \t]+|$)"""
CELL = "\x1f"

COORDINATE = r"^[+-]?(?:0*[0-9]{1,4}(?:\.[0-9]*)?|0*\.[0-9]+)$"
ATOM_NAME = r"""^[A-Z0-9'"*]{1,4}$"""
RESIDUE_NAME = r"^[A-Z0-9]{1,3}$"
LABELS = ("", "quoting", "columns", "coordinate", "atom_name", "residue_name")

_SCHEMA = pa.schema(
    [("line_id", pa.int64()), ("atom_name", pa.string()), ("residue_name", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("failure", pa.string())]
)


def _matches(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(values, pattern), False).to_numpy(zero_copy_only=False)


def _flat(values) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def _read_cells(lines: pa.Array, width: int, quoted: bool, delimiter: str) -> tuple[np.ndarray, pa.Table]:
    """Rows of exactly ``width`` cells, as strings, and their places in ``lines``. The CSV reader's
    callback skips the others; each line carries its place as a first cell."""
    marked = pc.binary_join_element_wise(pc.cast(pa.array(np.arange(len(lines))), pa.string()), lines, delimiter)
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(marked)], pa.int32()), marked), "\n")[0].as_buffer()
    names = [f"f{i}" for i in range(width + 1)]
    table = pacsv.read_csv(
        pa.BufferReader(data),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=min(max(1 << 16, 2 * data.size), 2**31 - 1)),
        parse_options=pacsv.ParseOptions(delimiter=delimiter, quote_char='"' if quoted else False, double_quote=True, ignore_empty_lines=False, invalid_row_handler=lambda row: "skip"),
        convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
    )
    return pc.cast(_flat(table["f0"]), pa.int64()).to_numpy(), table.drop_columns(["f0"])


def _pick(table: pa.Table, places: np.ndarray) -> pa.Array:
    """For every row the cell in the column of that row's (0-based) place; null where it is negative."""
    rows = table.num_rows
    cells = pa.chunked_array([c for col in table.columns for c in col.chunks], pa.string())
    at = places.astype(np.int64) * rows + np.arange(rows)
    return _flat(cells.take(pa.array(at, mask=places < 0)))


def parse_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Arrow kernel of :func:`parse_atom_lines` over (line_id, raw, kind, width, p0..p4)."""
    n = batch.num_rows
    raw = batch.column("raw")
    kind = pc.fill_null(batch.column("kind"), "").to_numpy(zero_copy_only=False)
    width = pc.fill_null(batch.column("width"), -1).to_numpy(zero_copy_only=False)
    places = [pc.subtract(pc.fill_null(batch.column(f"p{i}"), 0), 1).to_numpy(zero_copy_only=False) for i in range(5)]
    failure = np.zeros(n, np.int8)
    where, found = [], []  # rows that have cells, and their needed cells

    failure[~np.isin(kind, ("csv", "cif", "pdb"))] = 2
    for name, line, delimiter in (("csv", CSV_LINE, ","), ("cif", CIF_LINE, CELL)):
        own = np.flatnonzero(kind == name)
        if not len(own):
            continue
        lines = pc.replace_substring_regex(raw.take(pa.array(own)), f"[\r\n{CELL}]", "\x02")
        good = _matches(lines, line)
        failure[own[~good]] = 1
        own, lines = own[good], lines.filter(pa.array(good))
        if name == "cif":
            lines = pc.replace_substring_regex(lines, CIF_TOKEN, rf"\1\2\3{CELL}")
        for w in np.unique(width[own]):
            at = width[own] == w
            rows = own[at]
            failure[rows] = 2
            if w < 1:
                continue
            ok, table = _read_cells(lines.filter(pa.array(at)), int(w) + (name == "cif"), name == "csv", delimiter)
            rows = rows[ok]
            failure[rows] = 0
            if len(rows):
                where.append(rows)
                found.append([_pick(table, p[rows]) for p in places])

    own = np.flatnonzero(kind == "pdb")
    if len(own):
        lines = raw.take(pa.array(own))
        size = pc.utf8_length(lines).to_numpy(zero_copy_only=False)
        good = (size >= PDB_LENGTHS[0]) & (size <= PDB_LENGTHS[1])
        failure[own[~good]] = 2
        if good.any():
            lines = lines.filter(pa.array(good))
            where.append(own[good])
            found.append([pc.utf8_trim(pc.utf8_slice_codeunits(lines, a, b), " ") for a, b in PDB_PLACES])

    rows = np.concatenate(where) if where else np.empty(0, np.int64)
    cells = [pa.concat_arrays([_flat(f[i]) for f in found]) if found else pa.array([], pa.string()) for i in range(5)]
    checks = ((3, ~np.logical_and.reduce([_matches(c, COORDINATE) for c in cells[2:]])), (4, ~_matches(cells[0], ATOM_NAME)), (5, ~_matches(cells[1], RESIDUE_NAME)))
    for label, bad in reversed(checks):
        failure[rows[bad]] = label
    back = np.full(n, -1, np.int64)
    valid = failure[rows] == 0
    back[rows[valid]] = np.flatnonzero(valid)
    index = pa.array(back, mask=back < 0)
    plain = [pc.replace_substring_regex(pc.if_else(pa.array(valid), c, None), r"^\+", "") for c in cells[2:]]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("line_id"),
            cells[0].take(index),
            cells[1].take(index),
            *[pc.cast(c, pa.float64()).take(index) for c in plain],
            pa.array(np.array(LABELS, object)[failure], pa.string()),
        ],
        schema=_SCHEMA,
    )


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield parse_batch(batch)


def parse_atom_lines(lines: DataFrame, loops: DataFrame) -> DataFrame:
    """One row for each record line: (line_id, atom_name, residue_name, x, y, z, failure).

    ``failure`` is '' for a valid atom; of other records it names the first defect (quoting, columns,
    coordinate, atom_name, residue_name) and the values are null. Defined cases: null, empty, header and comment
    lines aren't records and give no row; repeated lines give a row each; records whose structure has no layout,
    or a layout without the needed fields, fail as ``columns`` and ``coordinate``; line ends within a line are
    part of its field; lines of any length are read; empty tables give no rows; further columns are ignored.

    Plan: records are filtered and joined to their layout in the JVM, where the layout shrinks to a kind, a
    width and five positions, so no name lists travel with the lines. The Arrow stage rejects broken quoting by
    a linear regular expression, lets the CSV reader's invalid-row callback reject wrong widths, reads all fields as
    strings and labels failing cells by vectorised matches. Rows are independent, and the join broadcasts
    the layouts or salts the lines, so a large structure is no hot spot.
    """
    def position(i: int):
        return F.when(F.col("file_kind") == "csv", F.array_position("column_names", NEEDED["csv"][i])).when(
            F.col("file_kind") == "cif", F.array_position("column_names", NEEDED["cif"][i])
        ).cast("int").alias(f"p{i}")

    layout = F.struct(F.col("file_kind").alias("kind"), F.size("column_names").alias("width"), *[position(i) for i in range(5)])
    # of several layouts of a structure the least counts, whatever the order of rows
    layouts = loops.where(F.col("structure_id").isNotNull()).groupBy("structure_id").agg(F.min(layout).alias("l")).select("structure_id", "l.*")
    records = lines.where(F.col("raw").rlike(RECORD)).select("line_id", "structure_id", "raw")
    return (
        join_small(records, layouts, ["structure_id"], "left")
        .select("line_id", "raw", "kind", "width", *[f"p{i}" for i in range(5)])
        .mapInArrow(_parse, "line_id bigint, atom_name string, residue_name string, x double, y double, z double, failure string")
    )


def split_atom_lines(lines: DataFrame, loops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid atoms (without ``failure``) and the rejects (line_id, failure) of :func:`parse_atom_lines`."""
    parsed = parse_atom_lines(lines, loops)
    return parsed.where(F.col("failure") == "").drop("failure"), parsed.where(F.col("failure") != "").select("line_id", "failure")
