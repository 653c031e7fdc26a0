"""Filters of whole volumes by their lines: every pass holds complete lines of one axis, so no tile has faces of its own."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rotogrid.functions.fourier import back_project as back_project_lines
from rotogrid.functions.fourier import whitening_gain
from rotogrid.functions.preprocess import correlate1d, edge_windows
from rotogrid.operators.grid import AXES, Bounds, inside
from rotogrid.operators.stencil import gaussian_window
from rotogrid.session import cut

#: Lines that a task holds at a time, beside each other along one further axis.
LINES = 32


def along(cells: DataFrame, axis: int, bounds: Bounds, f: Callable[[np.ndarray, np.ndarray], np.ndarray], names: Sequence[str]) -> DataFrame:
    """``f`` of all lines along an axis: values (line, place, column) and the lines' other two coordinates to (line, place, name).

    Absent voxels are 0. Lines without any voxel are left out, as what is linear leaves them 0.
    """
    u, w = (a for i, a in enumerate(AXES) if i != axis)
    low, high = bounds[axis]
    given = [c for c in cells.columns if c not in AXES]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines, place = np.unique(pdf[[u, w]].to_numpy(), axis=0, return_inverse=True)
        data = np.zeros((len(lines), high - low + 1, len(given)))
        data[place.ravel(), pdf[AXES[axis]].to_numpy() - low] = pdf[given].to_numpy(float)
        made = f(data, lines)
        places = {AXES[axis]: np.tile(np.arange(low, high + 1), len(lines)), u: np.repeat(lines[:, 0], made.shape[1]), w: np.repeat(lines[:, 1], made.shape[1])}
        return pd.DataFrame({**{a: places[a].astype(np.int32) for a in AXES}, **{n: made[:, :, k].ravel() for k, n in enumerate(names)}})

    return cells.groupBy(u, F.floor(F.col(w) / LINES)).applyInPandas(run, ", ".join(["x int, y int, z int", *[f"{n} double" for n in names]]))


def separable(voxels: DataFrame, windows: Mapping[str, Sequence[Sequence[Sequence[float]]]], bounds: Bounds) -> DataFrame:
    """Columns of ``v``, each by its own windows for every axis (applied in turn), with reflected borders of the volume."""
    names, out = list(windows), voxels.where(inside(bounds, AXES)).select(*AXES, "v")
    for axis in range(3):

        def f(data: np.ndarray, _, axis: int = axis) -> np.ndarray:
            made = []
            for k, n in enumerate(names):
                part = data[:, :, k if axis else 0]
                for window in windows[n][axis]:
                    part = correlate1d(part, window, 1)
                made.append(part)
            return np.stack(made, -1)

        out = along(out, axis, bounds, f, names)
    return out


def local_gaussian(voxels: DataFrame, bounds: Bounds, balance: float, smooth: float = 2.0, sigmas: Sequence[float] | None = None) -> DataFrame:
    """:func:`rotogrid.functions.preprocess.local_gaussian` of the whole volume against its own blur.

    Blurs with reflected borders keep the mean, so it is the same in both arrays and drops out.
    """
    sigmas = np.geomspace(0.1, 20, 12) if sigmas is None else np.asarray(sigmas, float)
    every = {f"s{k}": [[gaussian_window(s)]] * 3 for k, s in enumerate((*sigmas, smooth))}
    stack = separable(voxels, every, bounds)
    cost = lambda k, s: (F.col(f"s{k}") - F.col(f"s{len(sigmas)}")) ** 2 + float(balance * np.log1p(s))
    best = F.array_min(F.array(*[F.struct(cost(k, s).alias("cost"), F.lit(k).alias("k"), F.col(f"s{k}").alias("v")) for k, s in enumerate(sigmas)]))
    return stack.select(*AXES, best["v"].alias("v"))


def edge_gaussian(voxels: DataFrame, bounds: Bounds, method: str, sigma: float, reverse: bool = False) -> DataFrame:
    """:func:`rotogrid.functions.preprocess.edge_gaussian` of the whole volume, with its mean edge strength and largest weight."""
    parts = edge_windows(method, sigma, 3)
    every = {"raw": [[]] * 3, "blur": [[gaussian_window(sigma)]] * 3, **{f"e{k}": w for k, w in enumerate(parts)}}
    stack = separable(voxels, every, bounds)
    e = [F.col(f"e{k}") for k in range(len(parts))]
    strength = F.abs(sum(e)) if method in ("laplace", "gaussian_laplace") else F.sqrt(sum(c * c for c in e))
    stack = cut(stack.select(*AXES, "raw", "blur", strength.alias("strength")))
    mean = stack.agg(F.avg("strength")).first()[0] or 0.0
    marked = stack.select(*AXES, (F.col("strength") > mean).cast("double").alias("v"))
    weight = cut(separable(marked, {"weight": [[gaussian_window(sigma)]] * 3}, bounds))
    most = weight.agg(F.max("weight")).first()[0] or 1.0
    share = F.col("weight") / most
    share = 1 - share if reverse else share
    return stack.join(weight, list(AXES)).select(*AXES, (F.col("raw") * share + F.col("blur") * (1 - share)).alias("v"))


def _shape(bounds: Bounds) -> list[int]:
    return [b - a + 1 for a, b in bounds]


def transform(cells: DataFrame, axis: int, bounds: Bounds, inverse: bool = False) -> DataFrame:
    """FFT of every line of an axis: columns re, im; real values come as one column."""

    def f(data: np.ndarray, _) -> np.ndarray:
        values = data[:, :, 0] + 1j * data[:, :, 1] if data.shape[2] > 1 else data[:, :, 0]
        made = (np.fft.ifft if inverse else np.fft.fft)(values, axis=1)
        return np.stack([made.real, made.imag], -1)

    return along(cells, axis, bounds, f, ("re", "im"))


def spectrum(voxels: DataFrame, bounds: Bounds) -> DataFrame:
    """FFT of the whole volume: re, im at the places bounds' start + frequency number."""
    out = voxels.where(inside(bounds, AXES)).select(*AXES, "v")
    for axis in range(3):
        out = transform(out, axis, bounds)
    return out


def frequency(bounds: Bounds, lines: np.ndarray | None = None):
    """Norm of the frequency: of lines along z as an array, or of a spectrum's cells as a column."""
    if lines is not None:
        x, y, z = (np.fft.fftfreq(n) for n in _shape(bounds))
        return np.sqrt(x[lines[:, 0] - bounds[0][0], None] ** 2 + y[lines[:, 1] - bounds[1][0], None] ** 2 + z[None] ** 2)
    number = [F.col(a) - low for a, (low, _) in zip(AXES, bounds)]
    return F.sqrt(sum((F.when(k < (n + 1) // 2, k).otherwise(k - n) / float(n)) ** 2 for k, n in zip(number, _shape(bounds))))


def filtered(spectral: DataFrame, bounds: Bounds, gain: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The volume of a spectrum multiplied by a gain of the frequency."""

    def f(data: np.ndarray, lines: np.ndarray) -> np.ndarray:
        made = np.fft.ifft((data[:, :, 0] + 1j * data[:, :, 1]) * gain(frequency(bounds, lines)), axis=1)
        return np.stack([made.real, made.imag], -1)

    out = along(spectral, 2, bounds, f, ("re", "im"))
    for axis in (1, 0):
        out = transform(out, axis, bounds, True)
    return out.select(*AXES, F.col("re").alias("v"))


def whiten(voxels: DataFrame, bounds: Bounds) -> DataFrame:
    """The volume with its amplitudes evened out by frequency; the driver sees one mean per bin, half an axis of them."""
    spectral = cut(spectrum(voxels, bounds))
    bins = max(_shape(bounds)) // 2 + 1
    number = F.least(F.floor(frequency(bounds) / 0.5 * (bins - 1) + 0.5), F.lit(bins - 1)).cast("int")
    mean = np.zeros(bins)
    for r in spectral.groupBy(number.alias("bin")).agg(F.avg(F.hypot("re", "im")).alias("mean")).collect():
        mean[r.bin] = r["mean"]
    return filtered(spectral, bounds, lambda f: whitening_gain(f, mean))


def _ranked(rows: DataFrame, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows numbered from 0 in an order, by a range sort; no task sees all of them."""
    kept = rows.orderBy(*order).select(*keep)
    return rows.sparkSession.createDataFrame(kept.rdd.zipWithIndex().map(lambda r: Row(*r[0], r[1])), ", ".join([*[f"{n} {kind}" for n, kind in kept.dtypes], "rank bigint"]))


def scramble_phases(voxels: DataFrame, bounds: Bounds, share: float = 1.0, seed: int = 42) -> DataFrame:
    """Permute a share of the phases below Nyquist over the whole half spectrum; the amplitudes stay.

    Hashes of the seed and the place draw and order the cells, so the permutation doesn't depend on the partitions.
    """
    n = _shape(bounds)[2]
    half = spectrum(voxels, bounds).where(F.col("z") - bounds[2][0] <= n // 2)
    half = half.select(*AXES, F.hypot("re", "im").alias("amplitude"), F.atan2("im", "re").alias("phase"), F.xxhash64(F.lit(seed), *AXES).alias("key"))
    drawn = (frequency(bounds) <= 0.5) & (F.pmod(F.xxhash64(F.lit(seed + 1), *AXES), F.lit(1 << 30)) < int(share * (1 << 30)))
    half = cut(half.withColumn("drawn", drawn))
    chosen = half.where("drawn")
    to = _ranked(chosen, AXES, AXES)
    moved = to.join(_ranked(chosen, ("key", *AXES), ("phase",)).withColumnRenamed("phase", "other"), "rank").drop("rank")
    phase = F.coalesce("other", "phase")
    out = half.join(moved, list(AXES), "left").select(*AXES, (F.col("amplitude") * F.cos(phase)).alias("re"), (F.col("amplitude") * F.sin(phase)).alias("im"))
    for axis in (0, 1):
        out = transform(out, axis, bounds, True)

    def f(data: np.ndarray, _) -> np.ndarray:
        return np.fft.irfft((data[:, :, 0] + 1j * data[:, :, 1])[:, : n // 2 + 1], n=n, axis=1)[:, :, None]

    return along(out, 2, bounds, f, ("v",))


def back_project(slices: DataFrame, bounds: Bounds, angles: Sequence[float], depth: int, kind: str | None = "ramp") -> DataFrame:
    """:func:`rotogrid.functions.fourier.back_project` of pixels (x: tilt, y: side, z: tilt axis; v) to voxels (x: depth, y, z).

    What stands at one place of the tilt axis depends on no other place, so a task holds the tilts' lines of one place.
    """
    (first, last), (low, high), _ = bounds
    if len(angles) != last - first + 1:
        raise ValueError(f"{last - first + 1} tilts, not {len(angles)} angles")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros((len(angles), high - low + 1, 1))
        data[pdf["x"] - first, pdf["y"] - low, 0] = pdf["v"]
        x, y = np.indices((depth, high - low + 1), np.int32).reshape(2, -1)
        return pd.DataFrame({"x": x, "y": y + np.int32(low), "z": np.full(len(x), pdf["z"].iloc[0], np.int32), "v": back_project_lines(data, angles, depth, kind).ravel()})

    return slices.where(inside(bounds, AXES)).select(*AXES, "v").groupBy("z").applyInPandas(run, "x int, y int, z int, v double")
