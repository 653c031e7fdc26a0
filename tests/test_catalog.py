"""Some of the named queries against DuckDB, where the test tables are there."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from rotogrid.plans import catalog

DATA = Path("/root/testdata/sf0.001")
NAMES = ("max_over_rotations", "corr", "flc", "mcc", "batch_flc", "constrained_cone", "peaks_maxfilter", "peaks_fast", "gaussian3", "box_median", "core_mask", "fft_score", "kabsch", "pdb_roundtrip", "star_roundtrip", "discover_tomograms", "ncc_at_pose", "align_subtomos", "p5_found", "p5_atoms", "stream_windows")


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, (float, int)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = catalog.QUERIES[name](spark, str(DATA))
    out = con.sql(catalog.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(out.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    places = [out.columns.index(c) for c in names]
    assert ours == sorted((tuple(plain(r[i]) for i in places) for r in out.fetchall()), key=str)
