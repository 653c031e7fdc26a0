"""Correlation scores of a small template over all translations and rotations of a sparse volume.

Every voxel is exploded over the rotated template's offsets, shifted, and summed per translation and rotation: the
expansion is a literal array, so nothing is joined, and the sums are combined map-side before the only shuffle.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotogrid.functions.lattice import IDENTITY, rotate_offset
from rotogrid.operators.grid import AXES, Bounds, densify

EPS = 1.1920929e-07
T = ("tx", "ty", "tz")


@dataclass(frozen=True)
class Template:
    """Offsets from the box centre with values and mask weights; ``box`` is the number of voxels of the box."""

    points: tuple[tuple[int, int, int, float, float], ...]
    box: int = 0
    volume: int = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "volume", self.box or len(self.points))

    @property
    def mass(self) -> float:
        return sum(p[4] for p in self.points)

    def moments(self) -> tuple[float, float]:
        """Mean and population standard deviation under the mask."""
        n = self.mass
        mean = sum(p[3] * p[4] for p in self.points) / n
        return mean, math.sqrt(max(0.0, sum(p[3] ** 2 * p[4] for p in self.points) / n - mean**2))

    def standardised(self) -> "Template":
        mean, std = self.moments()
        return Template(tuple((x, y, z, (g - mean) / (std if std > EPS else 1.0) * m, m) for x, y, z, g, m in self.points), self.box)

    def squared_deviation(self) -> float:
        mean = self.moments()[0]
        return sum((p[3] - mean) ** 2 * p[4] for p in self.points)


def expansion(template: Template, rotations: Sequence[tuple] = (IDENTITY,)) -> Column:
    """A literal array of (r, ox, oy, oz, g, m): the offsets of the template in every rotation."""
    rows = [dict(zip(("r", "ox", "oy", "oz", "g", "m"), (r, *rotate_offset(rot, p[:3]), float(p[3]), float(p[4])))) for r, rot in enumerate(rotations) for p in template.points]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<r:int,ox:int,oy:int,oz:int,g:double,m:double>>")


def placed(target: DataFrame, template: Template, rotations: Sequence[tuple], bounds: Bounds, keys: Sequence[str] = (), wrap: bool = False) -> DataFrame:
    """Voxels shifted to the translations they take part in: keys, tx, ty, tz, r, g, m and the target's columns."""
    rows = target.withColumn("__e", F.explode(expansion(template, rotations)))
    shifted = [F.col(a) - F.col(f"__e.o{a}") for a in AXES]
    if wrap:
        shifted = [(F.pmod(s - low, F.lit(high - low + 1)) + low).cast("int") for s, (low, high) in zip(shifted, bounds)]
    rows = rows.select(*keys, *[s.alias(t) for s, t in zip(shifted, T)], "__e.r", "__e.g", "__e.m", *[c for c in target.columns if c not in (*AXES, *keys)])
    if not wrap:
        for t, (low, high) in zip(T, bounds):
            rows = rows.where(F.col(t).between(low, high))
    return rows


def correlate(target, template, rotations=(IDENTITY,), bounds=None, keys=(), wrap=False) -> DataFrame:
    """CC: the plain sum of products."""
    return placed(target, template, rotations, bounds, keys, wrap).groupBy(*keys, *T, "r").agg(F.sum(F.col("v") * F.col("g")).alias("s"))


def laplacian(voxels: DataFrame, bounds: Bounds, keys: Sequence[str] = ()) -> DataFrame:
    """2 d + 1 point Laplacian with wrapping borders; axes of one voxel add nothing."""
    live = [i for i, (a, b) in enumerate(bounds) if b > a]
    points = [(0, 0, 0, -2.0 * len(live), 1.0)] + [(*(s if i == k else 0 for k in range(3)), 1.0, 1.0) for i in live for s in (-1, 1)]
    out = correlate(voxels, Template(tuple(points)), bounds=bounds, keys=keys, wrap=True)
    return out.where(F.col("s") != 0).select(*keys, *[F.col(t).alias(a) for t, a in zip(T, AXES)], F.col("s").alias("v"))


def laplacian_template(template: Template, edge: Sequence[int]) -> Template:
    """The same of a template in its box of ``edge``, centre at edge // 2."""
    values: dict[tuple, float] = {}
    low = [-(e // 2) for e in edge]
    for x, y, z, g, _ in template.points:
        for i in range(3):
            if edge[i] == 1:
                continue
            for s, w in ((0, -2.0), (-1, 1.0), (1, 1.0)):
                p = [x, y, z]
                p[i] = (p[i] + s - low[i]) % edge[i] + low[i]
                values[tuple(p)] = values.get(tuple(p), 0.0) + w * g
    return Template(tuple((*p, v, 1.0) for p, v in sorted(values.items()) if v), math.prod(edge))


def local_correlate(target, template, rotations=(IDENTITY,), bounds=None, keys=(), wrap=False, edge=(3, 3, 3)) -> DataFrame:
    """LCC: correlation of Laplacians, not normalised further."""
    return correlate(laplacian(target, bounds, keys), laplacian_template(template, edge), rotations, bounds, keys, wrap)


def _sums(target, template, rotations, bounds, keys, wrap) -> DataFrame:
    v, g, m = F.col("v"), F.col("g"), F.col("m")
    return placed(target, template, rotations, bounds, keys, wrap).groupBy(*keys, *T, "r").agg(F.sum(v * g).alias("fg"), F.sum(v * m).alias("fm"), F.sum(v * v * m).alias("f2m"))


def normalised_correlate(target, template, rotations=(IDENTITY,), bounds=None, keys=(), wrap=False) -> DataFrame:
    """CORR: minus the means, over the root of the local target and template deviations; the local mean is over the
    template's whole box. Where the denominator vanishes the score is 0."""
    masked = Template(tuple((*p[:3], p[3] * p[4], p[4]) for p in template.points), template.box)
    mean, deviation = template.moments()[0], template.squared_deviation()
    below = F.sqrt(F.greatest(F.lit(0.0), (F.col("f2m") - F.col("fm") ** 2 / template.volume) * deviation))
    score = F.when(below > EPS, (F.col("fg") - mean * F.col("fm")) / below).otherwise(0.0)
    return _sums(target, masked, rotations, bounds, keys, wrap).select(*keys, *T, "r", score.alias("s"))


def standardised_correlate(target, template, rotations=(IDENTITY,), bounds=None, keys=(), wrap=False) -> DataFrame:
    """CAM: CORR of a target and template standardised over their whole volumes. Empty voxels count as 0 before that."""
    if keys:
        raise ValueError("CAM standardises one volume")
    total = math.prod(b - a + 1 for a, b in bounds)
    stats = target.agg(F.struct((F.sum("v") / total).alias("mean"), F.sqrt(F.sum(F.col("v") ** 2) / total - (F.sum("v") / total) ** 2).alias("std")).alias("x")).scalar()
    dense = densify(target, bounds).withColumn("__x", stats)
    whole = template.volume
    mean = sum(p[3] for p in template.points) / whole
    std = math.sqrt(max(0.0, sum(p[3] ** 2 for p in template.points) / whole - mean**2)) or 1.0
    scaled = Template(tuple((*p[:3], (p[3] - mean) / std, p[4]) for p in template.points), template.box)
    return normalised_correlate(dense.select(*AXES, ((F.col("v") - F.col("__x.mean")) / F.col("__x.std")).alias("v")), scaled, rotations, bounds, keys, wrap)


def _local_std(n: float) -> Column:
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("f2m") / n - (F.col("fm") / n) ** 2))
    return F.when(std < EPS, F.lit(1.0)).otherwise(std) * n


def fast_local_correlate(target, template, rotations=(IDENTITY,), bounds=None, keys=(), wrap=False) -> DataFrame:
    """FLC: the standardised template against local mean and deviation under the rotated mask, in one aggregation."""
    return _sums(target, template.standardised(), rotations, bounds, keys, wrap).select(*keys, *T, "r", (F.col("fg") / _local_std(template.mass)).alias("s"))


def spherical_local_correlate(target, template, rotations=(IDENTITY,), bounds=None, keys=(), wrap=False) -> DataFrame:
    """FLC whose deviations are taken once, under the mask as it stands, and shared by all rotations."""
    ready = template.standardised()
    products = correlate(target, Template(tuple(p for p in ready.points), template.box), rotations, bounds, keys, wrap)
    below = _sums(target, ready, (IDENTITY,), bounds, keys, wrap).select(*keys, *T, _local_std(template.mass).alias("below"))
    return products.join(below, [*keys, *T], "left").select(*keys, *T, "r", (F.col("s") / F.coalesce("below", F.lit(float(template.mass)))).alias("s"))


def masked_correlate(target, template, rotations=(IDENTITY,), bounds=None, keys=(), wrap=False, overlap: float = 0.3) -> DataFrame:
    """MCC: both sides masked. ``target`` may have a mask column ``t`` (default 1 for every voxel of the bounds).

    Scores are clipped to [-1, 1], and 0 where the masks' overlap is under ``overlap`` of its maximum; tiny
    denominators, relative to their maximum, count as 1.
    """
    from pyspark.sql import Window

    full = densify(target, bounds).withColumn("t", F.lit(1.0)) if "t" not in target.columns else target
    v, g, m, t = F.col("v"), F.col("g") * F.col("m"), F.col("m"), F.col("t")
    f = F.when(t > 0, v).otherwise(0.0)
    sums = placed(full, template, rotations, bounds, keys, wrap).groupBy(*keys, *T, "r").agg(
        F.sum(f * g).alias("fg"), F.sum(f * m).alias("fm"), F.sum(f * f * m).alias("f2m"), F.sum(t * m).alias("tm"), F.sum(t * g).alias("tg"), F.sum(t * g * F.col("g")).alias("tg2")
    )
    o = F.greatest(F.col("tm"), F.lit(EPS))
    sums = sums.withColumn("up", F.col("fg") - F.col("fm") * F.col("tg") / o).withColumn(
        "below", F.sqrt(F.greatest(F.lit(0.0), F.col("f2m") - F.col("fm") ** 2 / o) * F.greatest(F.lit(0.0), F.col("tg2") - F.col("tg") ** 2 / o))
    )
    peak = sums.groupBy(*keys, "r").agg(F.max("below").alias("most_below"), F.max("tm").alias("most_tm"))
    joined = sums.join(F.broadcast(peak) if not keys else peak, [*keys, "r"])  # without keys one row a rotation
    below = F.when(F.col("below") < 1e3 * EPS * F.col("most_below"), 1.0).otherwise(F.col("below"))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("up") / below))
    return joined.select(*keys, *T, "r", F.when(F.col("tm") < overlap * F.col("most_tm"), 0.0).otherwise(score).alias("s"))


SCORES: dict[str, Callable[..., DataFrame]] = {
    "CC": correlate,
    "LCC": local_correlate,
    "CORR": normalised_correlate,
    "CAM": standardised_correlate,
    "FLC": fast_local_correlate,
    "FLCSphericalMask": spherical_local_correlate,
    "MCC": masked_correlate,
    "batchFLC": fast_local_correlate,
    "batchFLCSpherical": spherical_local_correlate,
}


def register_score(name: str, score: Callable[..., DataFrame]) -> None:
    if name in SCORES:
        raise ValueError(f"{name} is registered")
    SCORES[name] = score


def match_template(target: DataFrame, template: Template, score: str = "FLCSphericalMask", rotations: Sequence[tuple] = (IDENTITY,), bounds: Bounds = None, keys: Sequence[str] = (), threshold: float = -1.0) -> DataFrame:
    """Best rotation of every translation: keys, tx, ty, tz, s, r; translations without a score above the threshold are left out."""
    from rotogrid.operators.aggregate import MOST_SUMS, best_over_rotations, best_products

    if score == "CC" and len(rotations) <= MOST_SUMS:
        return best_products(target, template, rotations, bounds, keys, threshold)
    return best_over_rotations(SCORES[score](target, template, rotations, bounds, keys), keys, threshold)
