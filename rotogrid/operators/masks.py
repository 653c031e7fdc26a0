"""Masks as closed forms over a generated grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotogrid.operators.grid import AXES, dense_grid


def _grid(spark, shape: Sequence[int]) -> DataFrame:
    return dense_grid(spark, [(0, n - 1) for n in shape])


def _distance(radius: Sequence[float], center: Sequence[float], orientation: Sequence[float] | None) -> Column:
    """Norm of (p - c) / r, in the frame of a row-major orientation if one is given."""
    d = [F.col(a) - float(c) for a, c in zip(AXES, center)]
    if orientation is not None:
        d = [sum(d[i] * float(orientation[i * 3 + j]) for i in range(3)) for j in range(3)]
    return F.sqrt(sum((x / float(r)) ** 2 for x, r in zip(d, radius)))


def ellipse(spark, shape, radius, center=None, orientation=None, sigma: float = 0.0, cutoff: float = 3.0) -> DataFrame:
    """1 within the ellipsoid; with ``sigma`` a Gaussian edge beyond it, cut after ``cutoff`` deviations."""
    center = center or [n // 2 for n in shape]
    radius = [radius] * 3 if isinstance(radius, (int, float)) else list(radius)
    d = _distance(radius, center, orientation)
    width = sigma / (sum(radius) / len(radius))
    value = F.when(d <= 1, 1.0)
    if sigma:
        value = value.when(d <= 1 + cutoff * width, F.exp(-((d - 1) ** 2) / (2 * width**2)))
    return _grid(spark, shape).withColumn("v", value.otherwise(0.0)).where(F.col("v") > 0)


def box(spark, shape, center, height, wider: bool = False) -> DataFrame:
    """A box of exactly ``height`` voxels an axis (one more with ``wider``)."""
    out = _grid(spark, shape)
    for a, c, h in zip(AXES, center, height):
        out = out.where(F.col(a).between(c - h // 2, c - h // 2 + h - 1 + int(wider)))
    return out.withColumn("v", F.lit(1.0))


def tube(spark, shape, axis: int, base, inner: float, outer: float, height: int) -> DataFrame:
    """The ring between two radii about an axis, over a slab centred at the base."""
    flat = F.sqrt(sum((F.col(a) - float(c)) ** 2 for i, (a, c) in enumerate(zip(AXES, base)) if i != axis))
    low = base[axis] - height // 2
    inside = (flat <= outer) & (flat > inner if inner else F.lit(True)) & F.col(AXES[axis]).between(low, low + height - 1)
    return _grid(spark, shape).where(inside).withColumn("v", F.lit(1.0))


def membrane(spark, shape, radius: float, thickness: float, separation: float, axis: int = 2, center=None, cutoff: float = 3.0) -> DataFrame:
    """Two Gaussian leaflets ``separation`` apart within a disk."""
    center = center or [n // 2 for n in shape]
    flat = F.sqrt(sum((F.col(a) - float(c)) ** 2 for i, (a, c) in enumerate(zip(AXES, center)) if i != axis))
    h = F.col(AXES[axis]) - float(center[axis])
    leaf = sum(F.when(F.abs(h - s * separation / 2) <= cutoff * thickness / 2, F.exp(-((h - s * separation / 2) ** 2) / (2 * (thickness / 2) ** 2))).otherwise(0.0) for s in (-1, 1))
    return _grid(spark, shape).where(flat <= radius).withColumn("v", leaf).where(F.col("v") > 0)


MASKS = {"ellipse": ellipse, "box": box, "tube": tube, "membrane": membrane}


def create_mask(spark, kind: str, **arguments) -> DataFrame:
    if kind not in MASKS:
        raise ValueError(f"no mask {kind}; there are {', '.join(MASKS)}")
    return MASKS[kind](spark, **arguments)


def polygon(spark, shape, corners: Sequence[tuple[float, float]], axis: int = 2) -> DataFrame:
    """Voxels inside a polygon of the two other axes (even-odd rule), extruded along ``axis``."""
    u, v = (F.col(a).cast("double") for i, a in enumerate(AXES) if i != axis)
    crossings = F.lit(0)
    for (a, b), (c, d) in zip(corners, [*corners[1:], corners[0]]):
        if b != d:
            at = (v - float(b)) / float(d - b) * float(c - a) + float(a)
            crossings = crossings + F.when(((v >= min(b, d)) & (v < max(b, d))) & (u < at), 1).otherwise(0)
    return _grid(spark, shape).where(crossings % 2 == 1).withColumn("v", F.lit(1.0))


MASKS["polygon"] = polygon
