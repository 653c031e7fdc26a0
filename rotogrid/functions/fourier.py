"""Filters in Fourier space as small arrays, built once on the driver, and their composition."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

WEIGHTS = ("none", "angle", "relion", "grigorieff")


def frequencies(shape: Sequence[int], rate: Sequence[float] | float = 1.0, half: bool = False) -> np.ndarray:
    """Norm of the frequency at every FFT position (unshifted), in units of cycles per unit length."""
    rate = [rate] * len(shape) if np.isscalar(rate) else list(rate)
    axes = [np.fft.fftfreq(n, r) for n, r in zip(shape, rate)]
    if half:
        axes[-1] = np.abs(axes[-1][: shape[-1] // 2 + 1])
    return np.sqrt(sum(np.square(a) for a in np.meshgrid(*axes, indexing="ij")))


def centered_grid(shape: Sequence[int]) -> list[np.ndarray]:
    return np.meshgrid(*[np.arange(n) - n // 2 for n in shape], indexing="ij")


def tilt_shape(shape: Sequence[int], opening_axis: int, reduce: bool = False) -> tuple[int, ...]:
    return tuple(1 if i == opening_axis else n for i, n in enumerate(shape) if not (reduce and i == opening_axis))


def half_shape(shape: Sequence[int]) -> tuple[int, ...]:
    return (*shape[:-1], shape[-1] // 2 + 1)


def crop_half(data: np.ndarray) -> np.ndarray:
    return data[..., : data.shape[-1] // 2 + 1]


def band_pass(shape, low: float | None = None, high: float | None = None, rate: float = 1.0, soft: bool = True, half: bool = False) -> np.ndarray:
    """Keep wavelengths from ``low`` (low-pass) to ``high`` (high-pass): Gaussian edges or hard ones."""
    return band_gain(frequencies(shape, rate, half), low, high, soft)


def band_gain(f: np.ndarray, low: float | None = None, high: float | None = None, soft: bool = True) -> np.ndarray:
    """The band-pass at frequencies ``f``."""
    out = np.ones_like(f)
    if soft:
        width = lambda c: 1 / (c * math.sqrt(2 * math.log(2)))
        if low:
            out *= np.exp(-(f**2) / (2 * width(low) ** 2))
        if high:
            out *= 1 - np.exp(-(f**2) / (2 * width(high) ** 2))
        return out
    if low:
        out *= f <= 1 / low
    if high:
        out *= f >= 1 / high
    return out


def electron_wavelength(voltage: float) -> float:
    """Relativistic wavelength in angstrom of electrons accelerated by ``voltage`` volts."""
    charge, mass, light, planck = 1.602176634e-19, 9.1093837015e-31, 299792458.0, 6.62607015e-34
    return planck / math.sqrt(2 * mass * charge * voltage * (1 + charge * voltage / (2 * mass * light**2))) * 1e10


def ctf(shape, defocus_x: float, defocus_y: float | None = None, angle: float = 0.0, voltage: float = 300e3, aberration: float = 2.7e7, contrast: float = 0.07, phase: float = 0.0, rate: float = 1.0, flip: bool = True, cutoff: float = 0.5, half: bool = False) -> np.ndarray:
    """sin(-chi), chi = pi lambda k^2 (dz - Cs lambda^2 k^2 / 2) + phase + atan(A / sqrt(1 - A^2)); 0 beyond the cutoff."""
    wave = electron_wavelength(voltage)
    k = frequencies(shape, rate, half)
    defocus = np.full_like(k, defocus_x)
    if defocus_y is not None and len(shape) >= 2:
        axes = [np.fft.fftfreq(n, rate) for n in shape]
        if half:
            axes[-1] = np.abs(axes[-1][: shape[-1] // 2 + 1])
        grids = np.meshgrid(*axes, indexing="ij")
        turn = 2 * (np.arctan2(grids[1], grids[0]) - math.radians(angle))
        defocus = (defocus_x + defocus_y + (defocus_x - defocus_y) * np.cos(turn)) / 2
    chi = math.pi * wave * k**2 * (defocus - aberration * wave**2 * k**2 / 2) + phase + math.atan(contrast / math.sqrt(1 - contrast**2))
    out = np.sin(-chi)
    out = np.abs(out) if flip else -out
    return np.where(k * rate <= cutoff, out, 0.0)


def _planes(shape, opening_axis: int, tilt_axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (unshifted) along the opening axis and along the axis square to it and the tilt axis."""
    axes = np.meshgrid(*[np.fft.fftfreq(n) for n in shape], indexing="ij")
    other = next(i for i in range(len(shape)) if i not in (opening_axis, tilt_axis)) if len(shape) > 2 else 1 - opening_axis
    return axes[opening_axis], axes[other]


def continuous_wedge(shape, start: float, stop: float, opening_axis: int = 0, tilt_axis: int = 2, cutoff: float | None = 0.5) -> np.ndarray:
    """1 where a tilt between -start and stop degrees reaches."""
    depth, side = _planes(shape, opening_axis, tilt_axis)
    tilt = np.degrees(np.arctan2(depth * np.sign(np.where(side == 0, 1, side)), np.abs(side)))
    out = ((tilt >= -start) & (tilt <= stop)).astype(float)
    out[(depth == 0)] = 1.0
    return out if cutoff is None else out * (frequencies(shape) <= cutoff)


def step_wedge(shape, angles: Sequence[float], weights: Sequence[float] | None = None, opening_axis: int = 0, tilt_axis: int = 2, width: float = 1.0) -> np.ndarray:
    """Weights of the tilts whose central plane, one voxel thick, holds a frequency; the sum is capped at the largest."""
    weights = np.ones(len(angles)) if weights is None else np.asarray(weights, float)
    if len(weights) != len(angles):
        raise ValueError("as many weights as angles")
    depth, side = _planes(shape, opening_axis, tilt_axis)
    n = max(shape)
    out = np.zeros(tuple(shape))
    for a, w in zip(np.radians(angles), weights):
        out += w * (np.abs(depth * math.cos(a) - side * math.sin(a)) * n <= width / 2 + 1e-9)
    return np.minimum(out, weights.max())


def tilt_weights(kind: str, shape, angles: Sequence[float], doses: Sequence[float] | None = None, rate: float = 1.0) -> np.ndarray:
    """One plane of weights per tilt: none, angle (cosine), relion (dose envelope times cosine), grigorieff (critical dose)."""
    if kind not in WEIGHTS:
        raise ValueError(f"weights are {', '.join(WEIGHTS)}")
    k = frequencies(shape, rate)
    out = []
    for i, a in enumerate(angles):
        dose = float(doses[i]) if doses is not None else 0.0
        if kind == "none":
            out.append(np.ones_like(k))
        elif kind == "angle":
            out.append(np.full_like(k, math.cos(math.radians(a))))
        elif kind == "relion":
            sigma = math.sqrt(dose * 4 / (8 * math.pi**2))
            out.append(np.exp(-2 * math.pi**2 * sigma**2 * k**2) * math.cos(math.radians(a)))
        else:
            critical = 0.245 * np.where(k > 0, k, 1.0) ** -1.665 + 2.81
            out.append(np.where(k > 0, np.exp(-dose / (2 * critical)), 1.0))
    return np.stack(out)


def reconstruction_filter(n: int, kind: str = "ramp", **options) -> np.ndarray:
    """One-dimensional filters of weighted back-projection over unshifted frequencies.

    ``ram-lak`` is |w| in units of the Nyquist frequency; ``ramp-cont`` the transform of its sampled kernel, which isn't 0 at 0;
    ``ramp`` needs ``angles``: frequencies times n and the least increment of the angles, at most 1. The others are |w| in a window.
    """
    f = np.abs(np.fft.fftfreq(n))
    ramp = 2 * f
    if kind == "ram-lak":
        return ramp
    if kind == "ramp-cont":
        i = np.minimum(np.arange(n), n - np.arange(n))
        kernel = np.where(i == 0, 0.25, np.where(i % 2 != 0, -1 / (np.pi * np.where(i == 0, 1, i)) ** 2, 0.0))
        return 2 * np.real(np.fft.fft(kernel))
    if kind == "ramp":
        angles = options.get("angles")
        if angles is None or len(angles) < 2:
            raise ValueError("ramp needs two tilt angles or more")
        return np.minimum(1.0, f * n * math.radians(float(np.diff(np.sort(angles)).min())))
    if kind == "shepp-logan":
        return ramp * np.sinc(f)
    if kind == "cosine":
        return ramp * np.cos(np.pi * f)
    if kind == "hamming":
        return ramp * (0.54 + 0.46 * np.cos(2 * np.pi * f))
    raise ValueError(f"no reconstruction filter {kind}")


def radial_spectrum(data: np.ndarray, bins: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every frequency, and the mean amplitude of each bin."""
    f = frequencies(data.shape)
    bins = bins or max(data.shape) // 2 + 1
    number = np.minimum((f / 0.5 * (bins - 1) + 0.5).astype(int), bins - 1)
    amplitude = np.abs(np.fft.fftn(data))
    return number, np.bincount(number.ravel(), amplitude.ravel(), bins) / np.maximum(np.bincount(number.ravel(), minlength=bins), 1)


def whitening(data: np.ndarray, bins: int | None = None) -> np.ndarray:
    """Inverse mean amplitude by frequency, interpolated linearly, at most 1."""
    _, mean = radial_spectrum(data, bins)
    return whitening_gain(frequencies(data.shape), mean)


def whitening_gain(f: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The whitening filter at frequencies ``f``, from the mean amplitude of each bin."""
    inverse = np.divide(1.0, mean, out=np.zeros_like(mean), where=mean > 0)
    inverse /= inverse.max() or 1.0
    return np.interp(f / 0.5 * (len(mean) - 1), np.arange(len(mean)), inverse)


def compose(*filters: Callable[..., dict]) -> Callable[..., dict]:
    """Apply filters in order; each takes and gives keyword data. Multiplicative ones multiply into ``data``, others replace it."""

    def run(**state) -> dict:
        for f in filters:
            made = f(**state)
            if "data" not in made:
                continue
            if made.get("multiplicative") and state.get("data") is not None:
                made = {**made, "data": state["data"] * made["data"]}
            state = {**state, **made}
        return state

    return run


def apply(data: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.real(np.fft.ifftn(np.fft.fftn(data) * mask))


def scramble_phases(data: np.ndarray, share: float = 1.0, seed: int = 42) -> np.ndarray:
    """Permute a share of the phases below Nyquist; the amplitudes stay."""
    rng = np.random.default_rng(seed)
    spectrum = np.fft.rfftn(data)
    amplitude, phase = np.abs(spectrum), np.angle(spectrum)
    chosen = np.flatnonzero((frequencies(data.shape, 1.0, True) <= 0.5).ravel())
    chosen = chosen[rng.random(len(chosen)) < share]
    flat = phase.ravel()
    flat[chosen] = flat[rng.permutation(chosen)]
    return np.fft.irfftn(amplitude * np.exp(1j * flat.reshape(phase.shape)), s=data.shape, axes=range(data.ndim))


def resample_fourier(data: np.ndarray, shape: Sequence[int]) -> np.ndarray:
    """Crop or pad the centred spectrum; the mean stays."""
    spectrum = np.fft.fftshift(np.fft.fftn(data))
    out = np.zeros(tuple(shape), complex)
    src = tuple(slice(max(0, n // 2 - m // 2), max(0, n // 2 - m // 2) + min(n, m)) for n, m in zip(data.shape, shape))
    dst = tuple(slice(max(0, m // 2 - n // 2), max(0, m // 2 - n // 2) + min(n, m)) for n, m in zip(data.shape, shape))
    out[dst] = spectrum[src]
    return np.real(np.fft.ifftn(np.fft.ifftshift(out))) * (np.prod(shape) / data.size)


def back_project(slices: np.ndarray, angles: Sequence[float], depth: int, kind: str | None = "ramp") -> np.ndarray:
    """Weighted back-projection of tilt images (tilt, side, tilt axis) into (depth, side, tilt axis)."""
    n = slices.shape[1]
    if kind:
        weight = reconstruction_filter(n, kind, angles=angles)
        slices = np.real(np.fft.ifft(np.fft.fft(slices, axis=1) * weight[None, :, None], axis=1))
    z, x = np.meshgrid(np.arange(depth) - depth // 2, np.arange(n) - n // 2, indexing="ij")
    out = np.zeros((depth, n, slices.shape[2]))
    for image, a in zip(slices, np.radians(angles)):
        at = x * math.cos(a) + z * math.sin(a) + n // 2
        low = np.floor(at).astype(int)
        frac = at - low
        for k, w in ((low, 1 - frac), (low + 1, frac)):
            ok = (k >= 0) & (k < n)
            out += np.where(ok, w, 0.0)[:, :, None] * image[np.clip(k, 0, n - 1)]
    return out / max(len(angles), 1)


def shift(data: np.ndarray, half: bool = False) -> np.ndarray:
    """Move the zero frequency to the centre (or back, for even axes); the last axis of a half spectrum stays."""
    axes = range(data.ndim - 1) if half else range(data.ndim)
    return np.roll(data, [data.shape[a] // 2 for a in axes], list(axes))


def pad_to_length(values, n: int) -> np.ndarray:
    """Repeat one value to n; n values stay."""
    values = np.atleast_1d(values)
    if len(values) not in (1, n):
        raise ValueError(f"one value or {n}, not {len(values)}")
    return np.repeat(values, n) if len(values) == 1 else values


def tilted_frequencies(shape: Sequence[int], angle: float, rate: float = 1.0, opening_axis: int = 0, tilt_axis: int = 2) -> np.ndarray:
    """Norm of the frequency on the plane of a tilt, over the axes other than the opening one."""
    plane = [n for i, n in enumerate(shape) if i != opening_axis]
    names = [i for i in range(len(shape)) if i != opening_axis]
    axes = [np.fft.fftfreq(n, rate) * (1.0 if i == tilt_axis or angle == 0 else 1 / math.cos(math.radians(angle)) if abs(angle) < 90 else np.inf) for i, n in zip(names, plane)]
    return np.sqrt(sum(np.square(a) for a in np.meshgrid(*axes, indexing="ij")))


def ctf_stack(shape: Sequence[int], defocus: Sequence[float], angles: Sequence[float], gradient: bool = False, opening_axis: int = 0, tilt_axis: int = 2, rate: float = 1.0, **options) -> np.ndarray:
    """One CTF plane per tilt. With ``gradient`` each is the mean over the strips of the tilted specimen, whose heights differ."""
    plane = [n for i, n in enumerate(shape) if i != opening_axis]
    side = [i for i in range(len(shape)) if i != opening_axis].index(next(i for i in range(len(shape)) if i not in (opening_axis, tilt_axis)))
    out = []
    for d, a in zip(pad_to_length(defocus, len(angles)), angles):
        if not gradient or a == 0:
            out.append(ctf(plane, float(d), rate=rate, **options))
            continue
        heights = (np.arange(plane[side]) - plane[side] // 2) * rate * math.tan(math.radians(a))
        out.append(np.mean([ctf(plane, float(d + h), rate=rate, **options) for h in heights], 0))
    return np.stack(out)


def insert_tilts(stack: np.ndarray, angles: Sequence[float], depth: int) -> np.ndarray:
    """Put Fourier planes (tilt, side, tilt axis; centred) into a centred volume (depth, side, tilt axis), the mean where several meet."""
    n = stack.shape[1]
    total, count = np.zeros((depth, n, stack.shape[2])), np.zeros((depth, n, 1))
    side = np.arange(n) - n // 2
    for plane, a in zip(stack, np.radians(angles)):
        x, z = np.rint(side * math.cos(a)).astype(int) + n // 2, np.rint(side * math.sin(a) * depth / n).astype(int) + depth // 2
        ok = (x >= 0) & (x < n) & (z >= 0) & (z < depth)
        np.add.at(total, (z[ok], x[ok]), plane[ok])
        np.add.at(count, (z[ok], x[ok]), 1.0)
    return total / np.maximum(count, 1)


def tilt_filters(shape, angles: Sequence[float], rate: float = 1.0, doses: Sequence[float] | None = None, weight: str = "none", defocus: float | None = None, low: float | None = None, high: float | None = None) -> np.ndarray:
    """The filter of a tilt series over a volume: wedge, dose weights and CTF per tilt, put together and band-passed. Axis 0 opens, axis 2 tilts."""
    plane = (shape[1], shape[2])
    stack = tilt_weights(weight, plane, angles, doses, rate)
    if defocus is not None:
        stack = stack * ctf_stack(shape, [defocus], angles, rate=rate)
    centred = np.stack([np.fft.fftshift(p) for p in stack])
    whole = np.fft.ifftshift(insert_tilts(centred, angles, shape[0]))
    return whole * band_pass(shape, low, high, rate) if low or high else whole
