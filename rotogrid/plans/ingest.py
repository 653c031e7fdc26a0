"""Queries of the ingestion problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotogrid.operators import drift, nested, rejects
from rotogrid.session import cut


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _changes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    files = _table(spark, sf, "export_files")
    ingested = cut(drift.ingest(files))
    return ingested, drift.changes(ingested, files)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)[1]


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    ingested, found = _changes(spark, sf)
    return drift.records(ingested, drift.approved_aliases(found))


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flatten_documents(_table(spark, sf, "ctf_docs"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).where(F.col("kind").isin("param", "node")).select("ctf_id", "parent_path", "item_path")


def p4_params(spark: SparkSession, sf: str) -> DataFrame:
    return nested.params(_flat(spark, sf))


def p4_grids(spark: SparkSession, sf: str) -> DataFrame:
    return nested.grids(_flat(spark, sf))


def p4_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nested.nodes(_flat(spark, sf))


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return rejects.split_atom_lines(_table(spark, sf, "atom_lines"), _table(spark, sf, "atom_loops"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)[1]


def p5_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf)[0]


_CELLS = """
WITH records AS (
  SELECT l.line_id, l.raw, o.file_kind, o.column_names FROM atom_lines l LEFT JOIN atom_loops o ON l.structure_id = o.structure_id
  WHERE regexp_matches(l.raw, '^"?(ATOM|HETATM)')
), opened AS (
  SELECT *, CASE file_kind
    WHEN 'csv' THEN regexp_matches(raw, '^("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*$')
    WHEN 'cif' THEN regexp_matches(raw, '^((''([^'']|''+[^'' \t])*''+|"([^"]|"+[^" \t])*"+|[^ \t''"][^ \t]*)([ \t]+|$))*$')
    ELSE true END AS closed
  FROM records
), tokens AS (
  SELECT *, CASE WHEN NOT closed THEN NULL
    WHEN file_kind = 'csv' THEN list_transform(regexp_extract_all(',' || raw, ',("(?:[^"]|"")*"|[^",]*)', 1),
      lambda t: CASE WHEN t[1] = '"' THEN replace(t[2:len(t) - 1], '""', '"') ELSE t END)
    WHEN file_kind = 'cif' THEN list_transform(regexp_extract_all(raw, '(?:''(?:[^'']|''+[^'' \t])*''+|"(?:[^"]|"+[^" \t])*"+|[^ \t''"][^ \t]*)(?:[ \t]+|$)'),
      lambda t: CASE WHEN t[1] IN ('"', '''') THEN (rtrim(t, chr(9) || ' '))[2:len(rtrim(t, chr(9) || ' ')) - 1] ELSE rtrim(t, chr(9) || ' ') END)
    END AS cells
  FROM opened
), picked AS (
  SELECT line_id, file_kind, closed,
    CASE WHEN file_kind = 'pdb' THEN length(raw) BETWEEN 54 AND 80 ELSE len(cells) = len(column_names) END AS fits,
    CASE file_kind WHEN 'pdb' THEN trim(raw[13:16], ' ') WHEN 'csv' THEN cells[list_position(column_names, 'atom_name')] ELSE cells[list_position(column_names, 'label_atom_id')] END AS atom_name,
    CASE file_kind WHEN 'pdb' THEN trim(raw[18:20], ' ') WHEN 'csv' THEN cells[list_position(column_names, 'residue_name')] ELSE cells[list_position(column_names, 'label_comp_id')] END AS residue_name,
    CASE file_kind WHEN 'pdb' THEN trim(raw[31:38], ' ') WHEN 'csv' THEN cells[list_position(column_names, 'x')] ELSE cells[list_position(column_names, 'Cartn_x')] END AS x,
    CASE file_kind WHEN 'pdb' THEN trim(raw[39:46], ' ') WHEN 'csv' THEN cells[list_position(column_names, 'y')] ELSE cells[list_position(column_names, 'Cartn_y')] END AS y,
    CASE file_kind WHEN 'pdb' THEN trim(raw[47:54], ' ') WHEN 'csv' THEN cells[list_position(column_names, 'z')] ELSE cells[list_position(column_names, 'Cartn_z')] END AS z
  FROM tokens
), plain AS (
  SELECT *, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$' AS decimal FROM picked
), labelled AS (
  SELECT *, CASE WHEN NOT closed THEN 'quoting' WHEN NOT coalesce(fits, false) THEN 'columns'
    WHEN NOT coalesce(regexp_matches(x, decimal) AND regexp_matches(y, decimal) AND regexp_matches(z, decimal), false) THEN 'coordinate'
    WHEN NOT coalesce(abs(try_cast(x AS DOUBLE)) < 10000 AND abs(try_cast(y AS DOUBLE)) < 10000 AND abs(try_cast(z AS DOUBLE)) < 10000, false) THEN 'coordinate'
    WHEN NOT coalesce(regexp_matches(atom_name, '^[A-Z0-9''"*]{1,4}$'), false) THEN 'atom_name'
    WHEN NOT coalesce(regexp_matches(residue_name, '^[A-Z0-9]{1,3}$'), false) THEN 'residue_name' ELSE '' END AS failure
  FROM plain
)"""

QUERIES = {
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p4_found": p4_found,
    "p4_params": p4_params,
    "p4_grids": p4_grids,
    "p4_nodes": p4_nodes,
    "p5_found": p5_found,
    "p5_atoms": p5_atoms,
}
SQL = {
    "p5_found": _CELLS + " SELECT line_id, failure FROM labelled WHERE failure <> ''",
    "p5_atoms": _CELLS + " SELECT line_id, atom_name, residue_name, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z FROM labelled WHERE failure = ''",
}
