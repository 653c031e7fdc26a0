"""Queries of volume filters against the filter of the whole volume in one array."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from rotogrid.functions import fourier, preprocess
from rotogrid.operators import lines as L
from rotogrid.plans import catalog
from rotogrid.plans import tables as t

DATA = Path("/root/testdata/sf0.001")
WHOLE = {
    "local_gaussian": lambda a: preprocess.apply_method(a, "local_gaussian", {"balance": 1.0}),
    "edge_gaussian": lambda a: preprocess.apply_method(a, "edge_gaussian", {"method": "sobel", "sigma": 1.0}),
    "bandpass_apply": lambda a: fourier.apply(a, fourier.band_pass(a.shape, 3.0)),
    "whiten": lambda a: fourier.apply(a, fourier.whitening(a)),
}


def dense(df) -> np.ndarray:
    out = np.zeros([b - a + 1 for a, b in t.V3_BOUNDS])
    p = df.toPandas()
    at = tuple(p[c].to_numpy() - low for c, (low, _) in zip("xyz", t.V3_BOUNDS))
    assert all((i >= 0).all() and (i < n).all() for i, n in zip(at, out.shape))
    out[at] = p["v"]
    return out


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", WHOLE)
def test_equal_to_the_untiled_filter(spark, name):
    whole = WHOLE[name](dense(t.volume(spark, str(DATA))))
    assert np.allclose(dense(catalog.QUERIES[name](spark, str(DATA))), whole, atol=2e-6)


@pytest.mark.parametrize("method", ("sobel", "prewitt", "laplace", "gaussian", "gaussian_laplace"))
def test_edges_by_windows(method):
    a = np.random.default_rng(2).random((7, 6, 5))
    parts = []
    for windows in preprocess.edge_windows(method, 1.0, 3):
        part = a
        for axis, each in enumerate(windows):
            for w in each:
                part = preprocess.correlate1d(part, w, axis)
        parts.append(part)
    made = sum(parts) if method.endswith("laplace") else np.sqrt(sum(p**2 for p in parts))
    assert np.allclose(made, preprocess.edges(a, method, 1.0))


def test_no_voxels(spark):
    empty = spark.createDataFrame([], "x int, y int, z int, v double")
    assert L.local_gaussian(empty, t.V3_BOUNDS, 1.0).count() == L.edge_gaussian(empty, t.V3_BOUNDS, "sobel", 1.0).count() == L.spectrum(empty, t.V3_BOUNDS).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_back_projection_of_the_table(spark):
    whole = fourier.back_project(dense(t.volume(spark, str(DATA))), np.linspace(-60, 60, 50), 9)
    p = catalog.QUERIES["back_projection"](spark, str(DATA)).toPandas()
    assert len(p) == whole.size and np.allclose(whole[p["x"], p["y"], p["z"]], p["v"], atol=2e-6)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_scrambled_phases_of_the_table(spark):
    a = dense(t.volume(spark, str(DATA)))
    rows = L.scramble_phases(t.volume(spark, str(DATA)), t.V3_BOUNDS, 0.0)
    assert np.allclose(dense(rows), a, atol=1e-9)
    b = dense(catalog.QUERIES["scramble_phases"](spark, str(DATA)))
    # planes z = 0 of a half spectrum lose their symmetry, so amplitudes are compared off them
    assert np.allclose(np.abs(np.fft.rfftn(b))[:, :, 1:], np.abs(np.fft.rfftn(a))[:, :, 1:], atol=0.1)
    assert not np.allclose(a, b, atol=1.0)
