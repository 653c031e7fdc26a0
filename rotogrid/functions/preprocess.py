"""Filters of dense arrays that have no sparse form: local and edge-aware smoothing, resampling, scattering profiles."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rotogrid.functions import fourier
from rotogrid.operators.stencil import gaussian_window, hamming_window, kaiser_window


def correlate1d(data: np.ndarray, window: Sequence[float], axis: int) -> np.ndarray:
    """Correlation along one axis with reflected borders."""
    half = len(window) // 2
    pads = [(half, len(window) - 1 - half) if i == axis else (0, 0) for i in range(data.ndim)]
    padded = np.pad(data, pads, "symmetric")
    n = data.shape[axis]
    return sum(w * np.take(padded, range(k, k + n), axis) for k, w in enumerate(window))


def separable(data: np.ndarray, window: Sequence[float]) -> np.ndarray:
    for axis in range(data.ndim):
        data = correlate1d(data, window, axis)
    return data


def gaussian(data: np.ndarray, sigma: float) -> np.ndarray:
    return separable(data, gaussian_window(sigma))


def local_gaussian(data: np.ndarray, aligned: np.ndarray, balance: float, sigmas: Sequence[float] | None = None) -> np.ndarray:
    """Per voxel the blur, out of a grid of sigmas, that comes nearest to the aligned array, against ``balance`` times its strength."""
    sigmas = np.geomspace(0.1, 20, 12) if sigmas is None else np.asarray(sigmas)
    target = aligned - aligned.mean()
    centred = data - data.mean()
    stack = np.stack([gaussian(centred, s) for s in sigmas])
    cost = (stack - target) ** 2 + balance * np.log1p(sigmas).reshape(-1, *[1] * data.ndim)
    return np.take_along_axis(stack, cost.argmin(0)[None], 0)[0] + data.mean()


def edges(data: np.ndarray, method: str = "sobel", sigma: float = 1.0) -> np.ndarray:
    """Edge strength by sobel, prewitt, laplace, gaussian (gradient) or gaussian_laplace."""
    if method in ("laplace", "gaussian_laplace"):
        source = gaussian(data, sigma) if method == "gaussian_laplace" else data
        return sum(correlate1d(source, (1.0, -2.0, 1.0), a) for a in range(data.ndim))
    side = {"sobel": (1.0, 2.0, 1.0), "prewitt": (1.0, 1.0, 1.0), "gaussian": None}
    if method not in side:
        raise ValueError(f"no edge method {method}")
    total = np.zeros_like(data, float)
    for a in range(data.ndim):
        part = gaussian(data, sigma) if method == "gaussian" else data
        for b in range(data.ndim):
            if b != a and side[method] is not None:
                part = correlate1d(part, side[method], b)
        total += correlate1d(part, (-1.0, 0.0, 1.0), a) ** 2
    return np.sqrt(total)


def edge_windows(method: str, sigma: float, ndim: int) -> list[list[list[np.ndarray]]]:
    """The parts of :func:`edges` as windows applied in turn along every axis."""
    side = {"sobel": (1.0, 2.0, 1.0), "prewitt": (1.0, 1.0, 1.0), "gaussian": None, "laplace": None, "gaussian_laplace": None}
    if method not in side:
        raise ValueError(f"no edge method {method}")
    blur = [gaussian_window(sigma)] if method.startswith("gaussian") else []
    centre = (1.0, -2.0, 1.0) if method.endswith("laplace") else (-1.0, 0.0, 1.0)
    return [[blur + ([centre] if b == a else [side[method]] if side[method] else []) for b in range(ndim)] for a in range(ndim)]


def edge_gaussian(data: np.ndarray, method: str, sigma: float, reverse: bool = False) -> np.ndarray:
    """Sharp at edges and blurred elsewhere, or the other way round; the edge map is binary and blurred."""
    strength = np.abs(edges(data, method, sigma))
    weight = gaussian((strength > strength.mean()).astype(float), sigma)
    weight = weight / (weight.max() or 1.0)
    weight = 1 - weight if reverse else weight
    return data * weight + gaussian(data, sigma) * (1 - weight)


def mipmap(data: np.ndarray, level: int) -> np.ndarray:
    """Halve every axis ``level`` times by means of two neighbours."""
    for _ in range(level):
        for axis in range(data.ndim):
            n = data.shape[axis] // 2 * 2
            if n >= 2:
                data = (np.take(data, range(0, n, 2), axis) + np.take(data, range(1, n, 2), axis)) / 2
    return data


def nearest_box(data: np.ndarray, shape: Sequence[int]) -> np.ndarray:
    for axis, n in enumerate(shape):
        data = np.take(data, np.minimum(((np.arange(n) + 0.5) * data.shape[axis] / n).astype(int), data.shape[axis] - 1), axis)
    return data


def center_window(data: np.ndarray, shape: Sequence[int], value: float = 0.0) -> np.ndarray:
    """Centred crop or pad of every axis."""
    for axis, n in enumerate(shape):
        old = data.shape[axis]
        if n < old:
            start = (old - n) // 2
            data = np.take(data, range(start, start + n), axis)
        elif n > old:
            before = (n - old) // 2
            data = np.pad(data, [(before, n - old - before) if i == axis else (0, 0) for i in range(data.ndim)], constant_values=value)
    return data


def kaiser_beta(attenuation: float) -> float:
    """Kaiser's shape parameter for an attenuation in decibels."""
    if attenuation > 50:
        return 0.1102 * (attenuation - 8.7)
    return 0.5842 * (attenuation - 21) ** 0.4 + 0.07886 * (attenuation - 21) if attenuation >= 21 else 0.0


def sinc_kaiser(omega: float, ripple: float, transition: float) -> np.ndarray:
    """A low-pass window with cutoff ``omega``: sinc times Kaiser, its length by the transition width; the sum is 1."""
    attenuation = -20 * math.log10(ripple)
    half = max(1, math.ceil((attenuation - 8) / (2.285 * transition) / 2))
    x = np.arange(-half, half + 1)
    w = np.sinc(omega * x / math.pi) * kaiser_window(2 * half + 1, kaiser_beta(attenuation))
    return w / w.sum()


def scattering(distance: np.ndarray, a: Sequence[float], b: Sequence[float], fourier_space: bool = False) -> np.ndarray:
    """Sum of Gaussians of an electron scattering table (coefficients a and b), in Fourier or real space."""
    d = np.asarray(distance, float)
    if fourier_space:
        return sum(x * np.exp(-y * d**2) for x, y in zip(a, b))
    return sum(x * (4 * math.pi / y) ** 1.5 * np.exp(-4 * math.pi**2 * d**2 / y) for x, y in zip(a, b) if y)


def atom_profile(radius: float, a: Sequence[float], b: Sequence[float], samples: int = 64, smooth: float = 0.0) -> Callable[[np.ndarray], np.ndarray]:
    """Radial profile of an atom, optionally low-passed, as an interpolating function; 0 beyond the radius."""
    r = np.linspace(0, radius, samples)
    values = scattering(r, a, b)
    if smooth:
        values = correlate1d(values, gaussian_window(smooth / (r[1] or 1.0)), 0)
    return lambda d: np.interp(d, r, values, right=0.0)


def fit_low_pass(profile: np.ndarray, transitions: Sequence[float] = (0.1, 0.2, 0.4), ripples: Sequence[float] = (1e-3, 1e-2), cutoffs: Sequence[float] | None = None) -> tuple[float, float, float, float]:
    """The (cutoff, ripple, transition, error) whose window keeps a radial profile best, by search over a grid."""
    cutoffs = np.linspace(0.3, 3.0, 10) if cutoffs is None else cutoffs
    error = lambda w, d, t: float(((correlate1d(profile, sinc_kaiser(w, d, t), 0) - profile) ** 2).sum())
    return min(((w, d, t, error(w, d, t)) for w in cutoffs for d in ripples for t in transitions), key=lambda x: x[3])


METHODS: dict[str, Callable[..., np.ndarray]] = {
    "gaussian": gaussian,
    "difference_of_gaussian": lambda data, low, high: gaussian(data, low) - gaussian(data, high),
    "local_gaussian": lambda data, balance, smooth=2.0: local_gaussian(data, gaussian(data, smooth), balance),
    "edge_gaussian": edge_gaussian,
    "mean": lambda data, width: separable(data, [1 / width] * width),
    "kaiser": lambda data, width: separable(data, kaiser_window(width)),
    "blob": lambda data, width: separable(data, kaiser_window(width, order=2)),
    "hamming": lambda data, width: separable(data, hamming_window(width)),
    "mipmap": mipmap,
    "interpolate_box": nearest_box,
    "window": center_window,
    "invert_contrast": lambda data: -data,
    "power_spectrum": lambda data: np.fft.fftshift(np.log1p(np.abs(np.fft.fftn(data)))),
    "scramble_phases": fourier.scramble_phases,
    "bandpass": lambda data, low=None, high=None, rate=1.0, soft=True: fourier.apply(data, fourier.band_pass(data.shape, low, high, rate, soft)),
    "ctf": lambda data, defocus, rate=1.0, **k: fourier.apply(data, fourier.ctf(data.shape, defocus, rate=rate, **k)),
    "wedge": lambda data, start, stop, opening_axis=0, tilt_axis=2: fourier.apply(data, fourier.continuous_wedge(data.shape, start, stop, opening_axis, tilt_axis, None)),
    "whitening": lambda data: fourier.apply(data, fourier.whitening(data)),
    "resample": fourier.resample_fourier,
}


def method_id(method: str, parameters: dict) -> str:
    """A stable name of a method with its parameters, whatever their order."""
    return json.dumps([method, sorted(parameters.items())], sort_keys=True, default=str)


def apply_method(data: np.ndarray, method: str, parameters: dict) -> np.ndarray:
    if method not in METHODS:
        raise NotImplementedError(method)
    return METHODS[method](data, **parameters)


def preprocess_blocks(blocks: DataFrame, method: str, parameters: dict) -> DataFrame:
    """Apply a method to every block; blocks whose shape changes keep their start and get their new shape."""
    if method not in METHODS:
        raise NotImplementedError(method)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.asarray(apply_method(np.frombuffer(r["data"]).reshape(r["shape"]), method, parameters), float) for r in batch.to_pylist()]
            names = batch.schema.names
            out = batch.set_column(names.index("data"), "data", pa.array([m.tobytes() for m in made], pa.binary()))
            yield out.set_column(names.index("shape"), "shape", pa.array([list(m.shape) for m in made], pa.list_(pa.int32())))

    return blocks.mapInArrow(run, blocks.schema)
