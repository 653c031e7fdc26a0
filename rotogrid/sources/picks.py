"""Pick lists (tab-separated text, STAR, Dynamo tables) to rows and back."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotogrid.sources.text import star_sections

COLUMNS = ("x", "y", "z", "euler_x", "euler_y", "euler_z", "score", "detail")
#: STAR column names of each of ours.
STAR = {"x": "rlnCoordinateX", "y": "rlnCoordinateY", "z": "rlnCoordinateZ", "euler_x": "rlnAngleRot", "euler_y": "rlnAngleTilt", "euler_z": "rlnAnglePsi", "detail": "rlnClassNumber", "score": "rlnAutopickFigureOfMerit"}
#: 1-based columns of ours in a Dynamo table of 38.
DYNAMO = {"euler_x": 7, "euler_y": 8, "euler_z": 9, "score": 10, "x": 24, "y": 25, "z": 26}
SCHEMA = "path string, " + ", ".join(f"{c} double" for c in COLUMNS)


def _number(text: str | None) -> float | None:
    """A cell as a number; null where it isn't one, NaN included. Infinite values stay."""
    try:
        number = float(text)
    except (TypeError, ValueError):
        return None
    return None if number != number else number


def parse_text(body: str) -> list[dict]:
    """Header-driven tab-separated picks: missing angles are 0; if only coordinates are there, score 0 and detail -1."""
    lines = [x for x in body.lstrip("﻿").splitlines() if x.strip() and not x.startswith("#")]
    if not lines:
        return []
    names = [n.strip() for n in lines[0].split("\t")]
    rows = [dict(zip(names, (_number(v) for v in line.split("\t")))) for line in lines[1:]]
    bare = not set(names) & {"score", "detail"}
    default = dict.fromkeys(("euler_x", "euler_y", "euler_z"), 0.0) | ({"score": 0.0, "detail": -1.0} if bare else {})
    return [{c: r.get(c) if c in names else default.get(c) for c in COLUMNS} for r in rows]


def parse_star(body: str, score: str = STAR["score"]) -> list[dict]:
    """Angles and class are 0 where they have no column, the score (in the column named ``score``) is null."""
    sections = star_sections(body)
    table = sections.get("data_particles") or sections.get("data_") or next((s for s in sections.values() if STAR["x"] in s), None)
    if table is None or any(STAR[c] not in table for c in "xyz"):
        raise ValueError("a STAR pick list needs rlnCoordinateX, Y and Z")
    names = STAR | {"score": score}
    blank = dict.fromkeys(COLUMNS, 0.0) | {"score": None}
    return [{c: _number(table[names[c]][i]) if names[c] in table else blank[c] for c in COLUMNS} for i in range(len(table[STAR["x"]]))]


def parse_dynamo(body: str) -> list[dict]:
    """Tables of exactly 38 columns; detail is -1."""
    out = []
    for line in body.splitlines():
        cells = line.split()
        if not cells:
            continue
        if len(cells) != 38:
            raise ValueError(f"a Dynamo table has 38 columns, not {len(cells)}")
        out.append({c: _number(cells[DYNAMO[c] - 1]) if c in DYNAMO else -1.0 for c in COLUMNS})
    return out


PARSERS = {"text": parse_text, "star": parse_star, "tbl": parse_dynamo}


def parse_picks(files: DataFrame, kind: str, score: str | None = None) -> DataFrame:
    """Picks of whole files (path, body) of kind text, star or tbl; ``score`` names the score's column in star files."""
    if kind not in PARSERS:
        raise ValueError(f"kinds are {', '.join(PARSERS)}")
    parser = PARSERS[kind] if kind != "star" or score is None else partial(parse_star, score=score)
    schema = pa.schema([("path", pa.string()), *[(c, pa.float64()) for c in COLUMNS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [{"path": path, **r} for r in parser(body or "")]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "body").mapInArrow(run, SCHEMA)


def _cell(column: str, missing: str) -> Column:
    """A number as text; null and NaN, which no reader tells apart, as the format's mark of missing values."""
    c = F.col(column).cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(missing)).otherwise(c.cast("string"))


def format_text(picks: DataFrame) -> Column:
    """Tab-separated cells; missing values are empty."""
    return F.concat_ws("\t", *[_cell(c, "") for c in COLUMNS])


def format_star(picks: DataFrame, source: str | None = None) -> Column:
    """Missing values are ``.``, a missing class -1."""
    cells = [_cell(c, ".") for c in ("x", "y", "z", "euler_x", "euler_y", "euler_z")] + [F.coalesce(F.col("detail").try_cast("int"), F.lit(-1)).cast("string")]
    return F.concat_ws("\t", *cells, *([F.lit(source)] if source else []), _cell("score", "."))


def star_header(source: bool = False, version: str | None = None) -> list[str]:
    names = [STAR[c] for c in ("x", "y", "z", "euler_x", "euler_y", "euler_z", "detail")] + (["rlnMicrographName"] if source else []) + [STAR["score"]]
    return [*([f"# {version}", ""] if version else []), "data_particles", "", "loop_", *[f"_{n}" for n in names]]


def format_dynamo(picks: DataFrame, rate: float = 1.0, number: str = "pick_id", wedge: Sequence[float] = (-60, 60, -60, 60)) -> Column:
    """Missing values are ``nan``."""
    cells: list[Column] = [F.lit("0")] * 38
    cells[0] = F.coalesce(F.col(number).cast("string"), F.lit("0"))
    cells[1] = cells[2] = F.lit("1")
    cells[12] = F.lit("1")
    for k, w in zip((13, 14, 15, 16), wedge):
        cells[k] = F.lit(str(w))
    for c, k in DYNAMO.items():
        cells[k - 1] = _cell(c, "nan")
    cells[35] = F.lit(str(rate))
    return F.concat_ws(" ", *cells)


def body_of(lines: DataFrame, text: Column, order: Sequence[str], header: Sequence[str] = (), keys: Sequence[str] = ("path",)) -> DataFrame:
    """One body per file of formatted lines in order. A file is one row, as its readers want it."""
    packed = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], text.alias("t")))).alias("l"))
    return packed.select(*keys, F.concat_ws("\n", *[F.lit(h) for h in header], F.transform("l", lambda r: r["t"])).alias("body"))
