"""Scores of one placement of a template's points in a volume, over many poses at once, and their refinement."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotogrid.functions.lattice import euler_to_matrix
from rotogrid.operators.grid import AXES
from rotogrid.session import cut


def sample(voxels: DataFrame, poses: DataFrame, points: Sequence[tuple[int, int, int, float]]) -> DataFrame:
    """pose_id, w, v: the point weights and the values under them at integer shifts tx, ty, tz; outside is 0.

    Points are a literal array; each (pose, point) is one row of an equi-join with the voxels.
    """
    rows = poses.withColumn("__p", F.explode(F.array(*[F.struct(*[F.lit(int(c)).alias(a) for c, a in zip(p, AXES)], F.lit(float(p[3])).alias("w")) for p in points])))
    rows = rows.select("pose_id", *[(F.col(f"t{a}") + F.col(f"__p.{a}")).cast("int").alias(a) for a in AXES], F.col("__p.w").alias("w"))
    return rows.join(voxels.select(*AXES, "v"), list(AXES), "left").select("pose_id", "w", F.coalesce("v", F.lit(0.0)).alias("v"))


def _cc(n: Column) -> Column:
    return F.sum(F.col("w") * F.col("v"))


def _ncc(n: Column) -> Column:
    size = F.sqrt(F.sum(F.col("w") ** 2)) * F.sqrt(F.sum(F.col("v") ** 2))
    return F.when(size > 0, F.sum(F.col("w") * F.col("v")) / size).otherwise(0.0)


def _centred(n: Column) -> Column:
    cov = F.sum(F.col("w") * F.col("v")) - F.sum("w") * F.sum("v") / n
    vw, vv = F.sum(F.col("w") ** 2) - F.sum("w") ** 2 / n, F.sum(F.col("v") ** 2) - F.sum("v") ** 2 / n
    size = F.sqrt(F.greatest(F.lit(0.0), vw)) * F.sqrt(F.greatest(F.lit(0.0), vv))
    return F.when(size > 1e-9, cov / size).otherwise(0.0)


def _least_squares(n: Column) -> Column:
    return F.sum((F.col("v") - F.col("w")) ** 2)


POSE_SCORES: dict[str, tuple[Callable[[Column], Column], int]] = {  # expression, and 1 if higher is better
    "CrossCorrelation": (_cc, 1),
    "NormalizedCrossCorrelation": (_ncc, 1),
    "NormalizedCrossCorrelationMean": (_centred, 1),
    "MaskedCrossCorrelation": (_centred, 1),
    "PartialLeastSquareDifference": (_least_squares, -1),
}


def register_pose_score(name: str, expression: Callable[[Column], Column], sign: int = 1) -> None:
    if not callable(expression):
        raise ValueError("a pose score is an expression of the number of points")
    POSE_SCORES[name] = (expression, sign)


def pose_scores(voxels: DataFrame, poses: DataFrame, points, score: str = "NormalizedCrossCorrelation") -> DataFrame:
    """pose_id and the score of each pose; higher is better, so distances are negated. Unknown scores raise ValueError."""
    if score not in POSE_SCORES:
        raise ValueError(f"no pose score {score}")
    expression, sign = POSE_SCORES[score]
    return sample(voxels, poses, points).groupBy("pose_id").agg((expression(F.count(F.lit(1))) * sign).alias("s"))


def envelope(voxels: DataFrame, poses: DataFrame, points, threshold: float) -> DataFrame:
    """Points on voxels above the threshold minus points elsewhere."""
    return sample(voxels, poses, points).groupBy("pose_id").agg(F.sum(F.when(F.col("v") > threshold, 1.0).otherwise(-1.0)).alias("s"))


def chamfer(points: DataFrame, others: DataFrame, reach: float, limit: float | None = None) -> DataFrame:
    """Mean distance of each set's points (set_id) to the nearest of the others, exactly; with ``limit``, that at most.

    Neighbours meet by cells of ``reach``, which decides every point with one within it; the others' cells are doubled until
    all are decided, so far points cost rounds, not pairs. Without any others there are no rows.
    """
    size = float(reach)
    left = cut(points.select("set_id", *AXES).withColumn("__n", F.monotonically_increasing_id()))
    apart = cut(others.select(*[F.col(c).alias(f"o{c}") for c in AXES]).distinct())
    if apart.isEmpty() and limit is None:
        return points.sparkSession.createDataFrame([], f"set_id {points.schema['set_id'].dataType.simpleString()}, distance double, n bigint")
    d = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in AXES))
    parts = []
    while True:
        size = size if limit is None else min(size, float(limit))
        a = left.withColumns({f"c{c}": F.floor(F.col(c) / size) for c in AXES})
        b = apart
        for c in AXES:
            b = b.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"o{c}") / size) - 1, F.floor(F.col(f"o{c}") / size) + 1)))
        nearest = cut(a.join(b, ["cx", "cy", "cz"]).groupBy("set_id", "__n").agg(F.min(d).alias("d")).where(F.col("d") <= size))
        parts.append(nearest.select("set_id", "d"))
        left = cut(left.join(nearest.select("__n"), "__n", "left_anti"))
        if left.isEmpty():
            break
        if limit is not None and size >= limit:
            parts.append(left.select("set_id", F.lit(float(limit)).alias("d")))
            break
        size *= 2
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("set_id").agg(F.avg("d").alias("distance"), F.count(F.lit(1)).alias("n"))


def normal_scores(points: DataFrame, normals: DataFrame) -> DataFrame:
    """Mean cosine between the points' normals (nx, ny, nz) and those at the same voxels."""
    o = normals.select(*AXES, *[F.col(f"n{a}").alias(f"o{a}") for a in AXES])
    dot = sum(F.col(f"n{a}") * F.col(f"o{a}") for a in AXES)
    size = F.sqrt(sum(F.col(f"n{a}") ** 2 for a in AXES)) * F.sqrt(sum(F.col(f"o{a}") ** 2 for a in AXES))
    return points.join(o, list(AXES)).groupBy("set_id").agg(F.avg(F.when(size > 0, dot / size).otherwise(0.0)).alias("s"))


def interpolate(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Trilinear values at positions (n, 3); outside is 0."""
    low = np.floor(at).astype(int)
    frac = at - low
    out = np.zeros(len(at))
    for corner in np.ndindex(2, 2, 2):
        p = low + corner
        ok = ((p >= 0) & (p < data.shape)).all(1)
        w = np.prod(np.where(np.array(corner) == 1, frac, 1 - frac), 1)
        out[ok] += w[ok] * data[tuple(p[ok].T)]
    return out


def _value(score: str, values: np.ndarray, weights: np.ndarray) -> float:
    if score == "PartialLeastSquareDifference":
        return -float(((values - weights) ** 2).sum())
    if score in ("NormalizedCrossCorrelationMean", "MaskedCrossCorrelation"):
        values, weights = values - values.mean(), weights - weights.mean()
    product = float(values @ weights)
    if score == "CrossCorrelation":
        return product
    size = float(np.linalg.norm(values) * np.linalg.norm(weights))
    return product / size if size > 0 else 0.0


def optimise(data: np.ndarray, points: np.ndarray, weights: np.ndarray, start: np.ndarray, score: str = "NormalizedCrossCorrelation", steps=(2.0, 2.0, 2.0, 10.0, 10.0, 10.0), tolerance: float = 0.01, bounds: Sequence[tuple[float, float]] | None = None) -> tuple[np.ndarray, float]:
    """Pattern search over (translation, zyz angles) about the points' mean, halving the steps; the start if nothing is better.
    ``bounds``: least and largest value of each of the six, which the start must keep."""
    if bounds is not None and not all(a <= v <= b for v, (a, b) in zip(start, bounds)):
        raise ValueError("the start isn't within the bounds")
    center = points.mean(0)

    def at(x):
        moved = (points - center) @ euler_to_matrix(x[3:]).T + center + x[:3]
        return _value(score, interpolate(data, moved), weights)

    x, steps = np.array(start, float), np.array(steps, float)
    best = at(x)
    while steps.max() > tolerance:
        better = False
        for i in range(6):
            for sign in (1, -1):
                y = x.copy()
                y[i] += sign * steps[i]
                if bounds is not None:
                    y[i] = min(max(y[i], bounds[i][0]), bounds[i][1])
                if (v := at(y)) > best + 1e-12:
                    x, best, better = y, v, True
        if not better:
            steps /= 2
    return x, best


def refine_patches(patches: DataFrame, points: Sequence[tuple[float, float, float, float]], score: str = "NormalizedCrossCorrelation") -> DataFrame:
    """Refine each pick within its own dense patch: pick_id, data (float64 bytes), shape -> shift, angles and score.

    Patches are independent and of fixed size, so any number of picks spreads evenly. A patch is small and its search is
    long, so patches are spread over four times the cluster's tasks, whatever their bytes.
    """
    patches = patches.repartition(4 * patches.sparkSession.sparkContext.defaultParallelism, "pick_id")
    array = np.array(points, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"]).reshape(row["shape"])
                center = (np.array(data.shape) - 1) // 2
                x, value = optimise(data, array[:, :3] + center, array[:, 3], np.zeros(6), score)
                rows.append({"pick_id": row["pick_id"], **dict(zip(("dx", "dy", "dz", "ax", "ay", "az"), x.tolist())), "s": value})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return patches.mapInArrow(run, "pick_id bigint, dx double, dy double, dz double, ax double, ay double, az double, s double")


def to_patches(extracted: DataFrame, box: Sequence[int]) -> DataFrame:
    """Dense patches of extracted voxels (pick_id, dx, dy, dz, v); a task holds one box at a time."""

    def build(key, pdf):
        import pandas as pd

        data = np.zeros(tuple(box))
        np.add.at(data, (pdf.dx.to_numpy(), pdf.dy.to_numpy(), pdf.dz.to_numpy()), pdf.v.to_numpy())
        return pd.DataFrame([(key[0], data.tobytes(), list(box))], columns=["pick_id", "data", "shape"])

    return extracted.groupBy("pick_id").applyInPandas(build, "pick_id bigint, data binary, shape array<int>")


def laplacian(data: np.ndarray) -> np.ndarray:
    """2 d + 1 point Laplacian with wrapping borders."""
    live = [a for a in range(data.ndim) if data.shape[a] > 1]
    return sum(np.roll(data, 1, a) + np.roll(data, -1, a) - 2 * data for a in live)


def gradient(data: np.ndarray, points: np.ndarray, weights: np.ndarray, normalised: bool = True) -> np.ndarray:
    """Derivative of the (normalised) cross-correlation by translation and by turning about the points' mean, six values."""
    slopes = np.stack([interpolate(g, points) for g in np.gradient(data)], 1)
    values = interpolate(data, points)
    turns = np.cross(points - points.mean(0), slopes)
    step = np.concatenate([slopes, turns], 1)
    if not normalised:
        return weights @ step
    size = np.linalg.norm(values)
    if size == 0:
        return np.zeros(6)
    return (weights @ step) / (np.linalg.norm(weights) * size) - (weights @ values) * (values @ step) / (np.linalg.norm(weights) * size**3)


def ascend(data: np.ndarray, points: np.ndarray, weights: np.ndarray, rounds: int = 100, normalised: bool = True, bounds: Sequence[tuple[float, float]] | None = None) -> tuple[np.ndarray, float]:
    """Gradient ascent of the (normalised) cross-correlation: the shift, the rotation vector (degrees) and the score reached.

    Each step goes along the derivative of shift and turn, both scaled to voxels at the points' mean radius, and is halved until the
    score rises; it ends where no step of a thousandth of a voxel does. ``bounds`` of the six values stop single ones.
    """
    from rotogrid.functions.lattice import vector_to_matrix

    name = "NormalizedCrossCorrelation" if normalised else "CrossCorrelation"
    center = points.mean(0)
    radius = max(1.0, float(np.sqrt(((points - center) ** 2).sum(1).mean())))
    x = np.zeros(6)

    def moved(v):
        return (points - center) @ vector_to_matrix(np.radians(v[3:])).T + center + v[:3]

    best = _value(name, interpolate(data, moved(x)), weights)
    size = 1.0
    for _ in range(rounds):
        slope = gradient(data, moved(x), weights, normalised)
        slope[3:] /= radius
        norm = np.linalg.norm(slope)
        if norm == 0:
            break
        while size > 1e-3:
            step = slope / norm * size
            y = x.copy()
            y[:3] += step[:3]
            y[3:] += np.degrees(step[3:] / radius)
            if bounds is not None:
                y = np.clip(y, [a for a, _ in bounds], [b for _, b in bounds])
            if (v := _value(name, interpolate(data, moved(y)), weights)) > best + 1e-12:
                x, best, size = y, v, min(1.0, size * 1.5)
                break
            size /= 2
        else:
            break
    return x, best


def local_score(data: np.ndarray, template: np.ndarray, mask: np.ndarray, at: Sequence[int]) -> float:
    """FLC of one placement: the template's index size // 2 lies on ``at``; beyond the volume is 0."""
    low = [p - n // 2 for p, n in zip(at, template.shape)]
    patch = np.zeros(template.shape)
    src = tuple(slice(max(0, a), max(0, min(s, a + n))) for a, n, s in zip(low, template.shape, data.shape))
    dst = tuple(slice(s.start - a, s.stop - a) for s, a in zip(src, low))
    patch[dst] = data[src]
    n = mask.sum()
    mean, local = (template * mask).sum() / n, (patch * mask).sum() / n
    std = np.sqrt(max(0.0, (template**2 * mask).sum() / n - mean**2)) or 1.0
    spread = np.sqrt(max(0.0, (patch**2 * mask).sum() / n - local**2)) or 1.0
    return float((patch * (template - mean) / std * mask).sum() / (n * spread))


def match_volumes(target: DataFrame, template: DataFrame, cutoff_target: float = 0.0, cutoff_template: float = 0.0, score: str = "NormalizedCrossCorrelation", margin: int = 4) -> tuple[np.ndarray, float]:
    """Fit one volume's voxels into another: centres of mass first, then the pattern search. Translation and zyz angles, and the score.

    Both are cut to the voxels above their cutoff; the target's surroundings of the template's size reach the driver.
    """
    from rotogrid.operators.aggregate import center_of_mass

    points = template.where(F.col("v") > cutoff_template).toPandas()
    if points.empty:
        raise ValueError("no template voxels above the cutoff")
    xyz, w = points[list(AXES)].to_numpy(float), points["v"].to_numpy(float)
    c = center_of_mass(target, cutoff_target).first()
    if c.x is None:
        raise ValueError("no target voxels above the cutoff")
    coarse = np.array([c.x, c.y, c.z]) - (xyz * w[:, None]).sum(0) / w.sum()
    reach = int(np.ceil(np.abs(xyz - xyz.mean(0)).max())) + margin
    low = np.floor(xyz.mean(0) + coarse).astype(int) - reach
    near = target.where(F.col("v") > cutoff_target)
    for a, k in zip(AXES, low):
        near = near.where(F.col(a).between(int(k), int(k) + 2 * reach))
    data = np.zeros((2 * reach + 1,) * 3)
    got = near.select(*AXES, "v").toPandas()
    data[tuple(got[a].to_numpy() - k for a, k in zip(AXES, low))] = got["v"].to_numpy()
    start = np.concatenate([coarse, np.zeros(3)])
    x, best = optimise(data, xyz - low, w, start, score)
    return x, best


def match_structure(target: DataFrame, atoms: DataFrame, elements: DataFrame, rate: float = 1.0, resolution: float | None = None, bounds=None, cutoff_target: float = 0.0, score: str = "NormalizedCrossCorrelation") -> tuple[np.ndarray, float]:
    """Fit a structure into a volume: its atoms' weights (blurred to ``resolution`` if given) as a volume, then :func:`match_volumes`."""
    from rotogrid.operators.atoms import gaussian_map, to_volume

    made = to_volume(atoms, elements, (rate,) * 3) if resolution is None else gaussian_map(atoms, elements, resolution, rate, bounds)
    return match_volumes(target, made, cutoff_target, 0.0, score)
