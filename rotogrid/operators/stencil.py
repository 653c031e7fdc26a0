"""Real-space filters of voxel tables: weighted stencils, separable windows, ranks, edges, surfaces."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotogrid.operators.grid import AXES, Bounds, densify, inside, to_blocks


def _fold(c: Column, low: int, high: int, border: str) -> Column:
    """An index folded into the bounds: wrap, reflect (edge repeated), nearest, or left as it is (zero)."""
    n = high - low + 1
    if border == "wrap":
        return (F.pmod(c - low, F.lit(n)) + low).cast("int")
    if border == "reflect":
        k = F.pmod(c - low, F.lit(2 * n))
        return (F.when(k < n, k).otherwise(2 * n - 1 - k) + low).cast("int")
    if border == "nearest":
        return F.greatest(F.lit(low), F.least(F.lit(high), c)).cast("int")
    return c


def gather(grid: DataFrame, voxels: DataFrame, offsets: Sequence[tuple[int, int, int]], bounds: Bounds, border: str) -> DataFrame:
    """For every grid position and offset number ``k`` the value found there (absent ones as 0)."""
    rows = grid.select(*[F.col(a).alias(f"p{a}") for a in AXES], F.posexplode(F.array(*[F.struct(*[F.lit(o).alias(a) for o, a in zip(off, AXES)]) for off in offsets])).alias("k", "o"))
    rows = rows.select(*[f"p{a}" for a in AXES], "k", *[_fold(F.col(f"p{a}") + F.col(f"o.{a}"), low, high, border).alias(a) for a, (low, high) in zip(AXES, bounds)])
    return rows.join(voxels.select(*AXES, "v"), list(AXES), "left").select(*[f"p{a}" for a in AXES], "k", F.coalesce("v", F.lit(0.0)).alias("v"))


def convolve(voxels: DataFrame, weights: dict[tuple[int, int, int], float], bounds: Bounds, border: str = "zero") -> DataFrame:
    """out[p] = sum of weights[o] * v[p + o]. Zero and wrapping borders scatter the sparse voxels; the others scatter
    them to every position that folds onto them. One partial aggregation, one shuffle."""
    rows = voxels.withColumn("__o", F.explode(F.array(*[F.struct(*[F.lit(o).alias(a) for o, a in zip(off, AXES)], F.lit(float(w)).alias("w")) for off, w in weights.items()])))
    reach = [max(abs(o[i]) for o in weights) for i in range(3)]
    if border in ("reflect", "nearest"):
        # positions outside the volume that mirror a voxel, as further copies of it
        for a, (low, high), r in zip(AXES, bounds, reach):
            if r and high > low:
                c = F.col(a)
                n = high - low + 1
                copies = [c]
                if border == "reflect":
                    copies += [F.when(c - low < r, 2 * low - 1 - c), F.when(high - c < r, 2 * high + 1 - c)]
                else:
                    copies += [F.when(c == low, F.lit(low - k)) for k in range(1, r + 1)] + [F.when(c == high, F.lit(high + k)) for k in range(1, r + 1)]
                if border == "reflect" and r > n:
                    raise ValueError("the stencil reaches beyond one reflection")
                rows = rows.withColumn(a, F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())))
            elif r:
                rows = rows.withColumn(a, F.explode(F.sequence(c := F.col(a) - r, F.col(a) + r)))
    moved = [F.col(a) - F.col(f"__o.{a}") for a in AXES]
    if border == "wrap":
        moved = [_fold(c, low, high, border) for c, (low, high) in zip(moved, bounds)]
    out = rows.select(*[c.cast("int").alias(a) for c, a in zip(moved, AXES)], (F.col("v") * F.col("__o.w")).alias("v"))
    for a, (low, high) in zip(AXES, bounds):
        out = out.where(F.col(a).between(low, high))
    return out.groupBy(*AXES).agg(F.sum("v").alias("v"))


def separable(voxels: DataFrame, window: Sequence[float], bounds: Bounds, border: str = "reflect") -> DataFrame:
    """The same window along every axis longer than one voxel: d passes instead of one of width**d."""
    half = len(window) // 2
    for i, (a, b) in enumerate(bounds):
        if b > a:
            voxels = convolve(voxels, {tuple(k - half if j == i else 0 for j in range(3)): float(w) for k, w in enumerate(window)}, bounds, border)
    return voxels


def gaussian_window(sigma: float, truncate: float = 4.0) -> np.ndarray:
    half = int(truncate * sigma + 0.5)
    x = np.arange(-half, half + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2) if sigma else np.ones(1)
    return w / w.sum()


def _bessel_i(order: int, x: np.ndarray) -> np.ndarray:
    """Modified Bessel function of the first kind, by its power series."""
    x = np.asarray(x, float)
    return sum((x / 2) ** (2 * k + order) / (math.factorial(k) * math.factorial(k + order)) for k in range(40))


def kaiser_window(width: int, beta: float = 3.2, order: int = 0) -> np.ndarray:
    x = np.arange(width) - (width - 1) / 2
    root = np.sqrt(np.maximum(0.0, 1 - (2 * x / max(width - 1, 1)) ** 2))
    w = (root**order) * _bessel_i(order, beta * root) / _bessel_i(order, np.array(beta))
    return w / w.sum()


def hamming_window(width: int) -> np.ndarray:
    w = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(width) / max(width - 1, 1)) if width > 1 else np.ones(1)
    return w / w.sum()


def gaussian(voxels: DataFrame, sigma: float, bounds: Bounds, border: str = "reflect") -> DataFrame:
    return separable(voxels, gaussian_window(sigma), bounds, border)


def difference_of_gaussians(voxels: DataFrame, low: float, high: float, bounds: Bounds) -> DataFrame:
    a, b = gaussian(voxels, low, bounds), gaussian(voxels, high, bounds).select(*AXES, (-F.col("v")).alias("v"))
    return a.unionByName(b).groupBy(*AXES).agg(F.sum("v").alias("v"))


def box_mean(voxels: DataFrame, width: int, bounds: Bounds, border: str = "reflect") -> DataFrame:
    return separable(voxels, [1 / width] * width, bounds, border)


def sobel(voxels: DataFrame, bounds: Bounds, axis: int, border: str = "reflect") -> DataFrame:
    """Derivative along one axis, smoothed (1, 2, 1) along the other live ones."""
    live = [i for i, (a, b) in enumerate(bounds) if b > a]
    weights = {}
    for off in product((-1, 0, 1), repeat=3):
        if any(off[i] for i in range(3) if i not in live) or not off[axis]:
            continue
        w = off[axis] * math.prod((2 if off[i] == 0 else 1) for i in live if i != axis)
        weights[off] = float(w)
    return convolve(voxels, weights, bounds, border)


def sobel_magnitude(voxels: DataFrame, bounds: Bounds, border: str = "reflect") -> DataFrame:
    live = [i for i, (a, b) in enumerate(bounds) if b > a]
    parts = [sobel(voxels, bounds, i, border).select(*AXES, (F.col("v") ** 2).alias("v")) for i in live]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*AXES).agg(F.sqrt(F.sum("v")).alias("v"))


def _box(edge: int, bounds: Bounds) -> list[tuple[int, int, int]]:
    low, high = -(edge // 2), (edge - 1) // 2
    return [tuple(o) for o in product(*[range(low, high + 1) if b > a else (0,) for a, b in bounds])]


def _folded(p: int, low: int, high: int, border: str) -> int | None:
    """Where an index beyond the bounds takes its value from; None for zero."""
    n = high - low + 1
    if border == "wrap":
        return (p - low) % n + low
    if border == "reflect":
        k = (p - low) % (2 * n)
        return (k if k < n else 2 * n - 1 - k) + low
    return max(low, min(high, p)) if border == "nearest" else None


def beyond(voxels: DataFrame, bounds: Bounds, halo: int, border: str) -> DataFrame:
    """The voxels with ``halo`` layers beyond the live faces, as the border has them: only voxels near faces are repeated."""
    out = voxels
    for a, (low, high) in zip(AXES, bounds):
        to: dict[int, list[int]] = {}
        for p in [*range(low - halo, low), *range(high + 1, high + halo + 1)] if high > low else ():
            if (source := _folded(p, low, high, border)) is not None:
                to.setdefault(source, []).append(p)
        if to:
            places = F.create_map(*[c for k, ps in to.items() for c in (F.lit(k), F.array(*map(F.lit, ps)))])
            out = out.unionByName(out.where(F.col(a).isin(list(to))).withColumn(a, F.explode(F.element_at(places, F.col(a)))))
    return out


#: Edge of the blocks of rank filters.
BLOCK = 64


def rank_filter(voxels: DataFrame, edge: int, rank: int, bounds: Bounds, border: str = "reflect", block: int = BLOCK) -> DataFrame:
    """The rank-th smallest value (0-based, negative from the end) of the box around every voxel of the bounds.

    Voxels are gathered into dense blocks with a halo of half the box, once; boxes are windows of numpy within a block, a plane at a
    time. Every block of the bounds is there, as empty places count as 0.
    """
    window = [edge if b > a else 1 for a, b in bounds]
    at = rank % math.prod(window)
    halo = edge // 2
    counts = [-(-(b - a + 1) // block) for a, b in bounds]
    corner = [(F.expr(f"id div {math.prod(counts[i + 1:])}") % counts[i] * block + low).cast("int").alias(a) for i, (a, (low, _)) in enumerate(zip(AXES, bounds))]
    corners = voxels.sparkSession.range(math.prod(counts)).select(*corner, F.lit(0.0).alias("v"))
    inner = voxels.where(inside(bounds, AXES)).select(*AXES, F.col("v").cast("double").alias("v"))
    blocks = to_blocks(beyond(inner, bounds, halo, border).unionByName(corners), block, halo, [a for a, _ in bounds])
    skip = [halo - w // 2 for w in window]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data = np.frombuffer(row["data"]).reshape(row["shape"])
                begin = [s + halo for s in row["start"]]
                size = [min(block, b - s + 1) for s, (_, b) in zip(begin, bounds)]
                if min(size) < 1 or any(s < a for s, (a, _) in zip(begin, bounds)):
                    continue  # a block that halos alone made
                out = np.empty(size)
                view = sliding_window_view(data, window)
                for x in range(size[0]):
                    plane = view[x + skip[0], skip[1] : skip[1] + size[1], skip[2] : skip[2] + size[2]].reshape(size[1], size[2], -1)
                    out[x] = np.partition(plane, at, axis=-1)[..., at]
                places = np.indices(size, np.int32).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([*[pa.array(p + np.int32(s)) for p, s in zip(places, begin)], pa.array(out.ravel())], names=[*AXES, "v"])

    return blocks.mapInArrow(run, "x int, y int, z int, v double")


def median_filter(voxels: DataFrame, edge: int, bounds: Bounds, border: str = "reflect") -> DataFrame:
    n = len(_box(edge, bounds))
    return rank_filter(voxels, edge, n // 2, bounds, border)


def extreme_filter(voxels: DataFrame, edge: int, bounds: Bounds, largest: bool, border: str = "reflect") -> DataFrame:
    """Box minimum or maximum over the dense volume, one axis after the other."""
    f = F.max if largest else F.min
    out = densify(voxels, bounds)
    low, high = -(edge // 2), (edge - 1) // 2
    for i, (a, b) in enumerate(bounds):
        if b > a:
            out = gather_axis(out, i, range(low, high + 1), bounds, border).groupBy(*AXES).agg(f("v").alias("v"))
    return out


def gather_axis(dense: DataFrame, axis: int, offsets: Sequence[int], bounds: Bounds, border: str) -> DataFrame:
    """Every value at every position along one axis whose neighbourhood holds it. Outside is 0 with a zero border."""
    name, (low, high) = AXES[axis], bounds[axis]
    c = F.col(name)
    reach = max(abs(o) for o in offsets)
    copies = [c]
    if border == "reflect":
        copies += [F.when(c - low < reach, 2 * low - 1 - c), F.when(high - c < reach, 2 * high + 1 - c)]
    rows = dense.withColumn("__at", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())))
    if border == "zero":
        outside = F.array(*[F.lit(k) for k in (*range(low - reach, low), *range(high + 1, high + 1 + reach))])
        edge = dense.where(c == low).withColumn("v", F.lit(0.0)).withColumn("__at", F.explode(outside))
        rows = rows.unionByName(edge)
    rows = rows.withColumn(name, F.explode(F.transform(F.lit(list(offsets)), lambda o: F.col("__at") - o))).drop("__at")
    return rows.where(F.col(name).between(low, high))


def erode(mask: DataFrame, bounds: Bounds) -> DataFrame:
    """Binary erosion by the 2 d + 1 cross; outside is empty."""
    live = [i for i, (a, b) in enumerate(bounds) if b > a]
    weights = {(0, 0, 0): 1.0} | {tuple(s if j == i else 0 for j in range(3)): 1.0 for i in live for s in (-1, 1)}
    return convolve(mask.where(F.col("v") > 0).select(*AXES, F.lit(1.0).alias("v")), weights, bounds).where(F.col("v") == len(weights)).select(*AXES, F.lit(1.0).alias("v"))


def core_depth(mask: DataFrame, bounds: Bounds) -> DataFrame:
    """Number of erosions that each voxel survives, plus one: its city-block distance to the outside.

    Distances spread along the axes in order: d(p) = min over the line of d(q) + |p - q|, three passes in place of one
    job per erosion.
    """
    longest = max(b - a + 2 for a, b in bounds)
    dense = densify(mask.where(F.col("v") > 0).select(*AXES, F.lit(float(longest)).alias("v")), bounds)
    for i, (a, b) in enumerate(bounds):
        if b > a:
            name = AXES[i]
            others = [x for x in AXES if x != name]
            line = dense.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct(name, "v"))).alias("l"))  # one line of the volume
            nearest = F.transform("l", lambda p: F.struct(p[name].alias(name), F.least(p["v"], (p[name] - (a - 1)).cast("double"), ((b + 1) - p[name]).cast("double"), F.array_min(F.transform("l", lambda q: q["v"] + F.abs(p[name] - q[name])))).alias("v")))
            dense = line.select(*others, F.explode(nearest).alias("c")).select(*[F.col(f"c.{name}").alias(name) if x == name else F.col(x) for x in AXES], F.col("c.v").alias("v"))
    return dense.where(F.col("v") > 0)


def surface(mask: DataFrame, bounds: Bounds) -> DataFrame:
    """Voxels of a mask that an erosion removes."""
    return mask.where(F.col("v") > 0).select(*AXES).join(erode(mask, bounds).select(*AXES), list(AXES), "left_anti")


def normals(voxels: DataFrame, points: DataFrame) -> DataFrame:
    """Unit mean direction from each point to the brighter voxels among its 26 neighbours; zero if there is none."""
    offsets = [o for o in product((-1, 0, 1), repeat=3) if any(o)]
    near = points.select(*[F.col(a).alias(f"p{a}") for a in AXES], F.explode(F.array(*[F.struct(*[F.lit(k).alias(a) for k, a in zip(o, AXES)]) for o in offsets])).alias("o"))
    near = near.select("px", "py", "pz", *[F.col(f"o.{a}").alias(f"o{a}") for a in AXES], *[(F.col(f"p{a}") + F.col(f"o.{a}")).alias(a) for a in AXES])
    own = voxels.select(*[F.col(a).alias(f"p{a}") for a in AXES], F.col("v").alias("pv"))
    rows = near.join(voxels, list(AXES), "left").join(own, ["px", "py", "pz"], "left")
    brighter = F.coalesce("v", F.lit(0.0)) > F.coalesce("pv", F.lit(0.0))
    mean = rows.groupBy("px", "py", "pz").agg(*[F.sum(F.when(brighter, F.col(f"o{a}")).otherwise(0)).alias(f"n{a}") for a in AXES])
    size = F.sqrt(sum(F.col(f"n{a}") ** 2 for a in AXES))
    return mean.select(*[F.col(f"p{a}").alias(a) for a in AXES], *[F.when(size > 0, F.col(f"n{a}") / size).otherwise(0.0).alias(f"n{a}") for a in AXES])


def threshold_mask(voxels: DataFrame, bounds: Bounds, deviations: float = 5.0, invert: bool = False) -> DataFrame:
    """Voxels at least so many population deviations from the mean of the whole volume, on either side."""
    total = math.prod(b - a + 1 for a, b in bounds)
    x = voxels.agg(F.struct((F.sum("v") / total).alias("m"), F.sqrt(F.sum(F.col("v") ** 2) / total - (F.sum("v") / total) ** 2).alias("d")).alias("x")).scalar()
    rows = densify(voxels, bounds).withColumn("__x", x)
    far = F.abs(F.col("v") - F.col("__x.m")) >= deviations * F.col("__x.d")
    return rows.where(~far if invert else far).select(*AXES, F.lit(1.0).alias("v"))


def lowpass_mask(voxels: DataFrame, bounds: Bounds, sigma: float = 1.0) -> DataFrame:
    """Voxels over exp(-2) of the maximum, blurred, and again over exp(-2)."""
    level = math.exp(-2)
    most = voxels.agg(F.max("v").alias("m")).scalar()
    hard = voxels.withColumn("__m", most).where(F.col("v") / F.col("__m") > level).select(*AXES, F.lit(1.0).alias("v"))
    return gaussian(hard, sigma, bounds).where(F.col("v") > level).select(*AXES, F.lit(1.0).alias("v"))


def resample(voxels: DataFrame, bounds: Bounds, factor: float) -> DataFrame:
    """Linear interpolation onto a grid whose voxels are ``factor`` times as large: each voxel is scattered to the at most
    (2 / factor + 1)**3 new positions it weighs in, one aggregation in all."""
    out = voxels
    for a, (low, high) in zip(AXES, bounds):
        if high == low:
            continue
        n = int((high - low) / factor) + 1
        at = (F.col(a) - low) / factor
        first, last = F.greatest(F.lit(0), F.ceil(at - 1 / factor).cast("int")), F.least(F.lit(n - 1), F.floor(at + 1 / factor).cast("int"))
        out = out.where(first <= last).withColumn("__k", F.explode(F.sequence(first, last)))
        weight = 1 - F.abs(F.col("__k") * factor + low - F.col(a))
        out = out.withColumn("v", F.col("v") * F.greatest(F.lit(0.0), weight)).withColumn(a, F.col("__k").cast("int")).drop("__k").where(F.col("v") != 0)
    return out.groupBy(*AXES).agg(F.sum("v").alias("v"))
