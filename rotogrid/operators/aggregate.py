"""Aggregation of score spaces and of voxel, atom and pick tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotogrid.functions.lattice import rotate_offset
from rotogrid.operators.grid import AXES, Bounds, inside
from rotogrid.operators.score import T, Template
from rotogrid.operators.skew import join_small

#: Rotations whose sums fit into one row.
MOST_SUMS = 64


def best_over_rotations(scores: DataFrame, keys: Sequence[str] = (), threshold: float | None = None) -> DataFrame:
    """Per translation the highest score and the first rotation that reaches it; scores must exceed the threshold.

    A maximum over (score, -rotation) is combined map-side, so no score is sorted.
    """
    rows = scores if threshold is None else scores.where(F.col("s") > threshold)
    return (
        rows.groupBy(*keys, *T).agg(F.max(F.struct(F.col("s"), (-F.col("r")).alias("q"))).alias("b"))
        .select(*keys, *T, F.col("b.s").alias("s"), (-F.col("b.q")).cast("int").alias("r"))
    )


def best_products(target: DataFrame, template: Template, rotations: Sequence[tuple], bounds: Bounds, keys: Sequence[str] = (), threshold: float | None = None) -> DataFrame:
    """The best map of plain correlations in one aggregation: equal to ``best_over_rotations(correlate(...))``.

    A voxel is exploded over the distinct offsets of all rotations together, each with one weight per rotation, and the
    sums of all rotations travel in one row per translation: fewer rows and one shuffle instead of two. For up to
    ``MOST_SUMS`` rotations.
    """
    weights: dict[tuple, dict[int, float]] = {}
    for r, rot in enumerate(rotations):
        for p in template.points:
            at = weights.setdefault(rotate_offset(rot, p[:3]), {})
            at[r] = at.get(r, 0.0) + float(p[3])
    names = [f"w{r}" for r in range(len(rotations))]
    rows = [dict(zip(("ox", "oy", "oz"), o)) | {f"w{r}": w for r, w in by.items()} for o, by in sorted(weights.items())]
    literal = F.from_json(F.lit(json.dumps(rows)), "array<struct<ox:int,oy:int,oz:int," + ",".join(f"{n}:double" for n in names) + ">>")
    moved = target.withColumn("__e", F.explode(literal))
    moved = moved.select(*keys, *[(F.col(a) - F.col(f"__e.o{a}")).alias(t) for a, t in zip(AXES, T)], "v", "__e").where(inside(bounds, T))
    sums = moved.groupBy(*keys, *T).agg(*[F.sum(F.col("v") * F.col(f"__e.{n}")).alias(n) for n in names])
    # a rotation without a contribution is null, which is the least
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("s"), F.lit(-r).alias("q")) for r, n in enumerate(names)]))
    out = sums.withColumn("b", best).select(*keys, *T, F.col("b.s").alias("s"), (-F.col("b.q")).cast("int").alias("r"))
    return out if threshold is None else out.where(F.col("s") > threshold)


def best_over_translations(scores: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per rotation (and kept axes) the highest score over all translations."""
    return scores.groupBy("r", *keep).agg(F.max("s").alias("s"))


def merge_translations(*states: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Merge partial maxima over translations, such as those of tiles."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("r", *keep).agg(F.max("s").alias("s"))


def merge_best(*states: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Merge partial best maps, such as those of tiles."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return best_over_rotations(out, keys)


def constrained(scores: DataFrame, seeds: DataFrame, rotations: Sequence[tuple], cone_angle: float, radius: float, reference=(0, 0, 1)) -> DataFrame:
    """Scores within ``radius`` of a seed whose rotation tilts the reference by at most ``cone_angle`` from the seed's.

    ``seeds``: seed_id, x, y, z and the row-major matrix m0..m8. The range join runs over cells of the radius, so a
    score meets only the seeds of its neighbourhood.
    """
    turned = [(r, *(float(sum(m[i * 3 + j] * reference[j] for j in range(3))) for i in range(3))) for r, m in enumerate(rotations)]
    spark = scores.sparkSession
    axes = F.broadcast(spark.createDataFrame(turned, "r int, ax double, ay double, az double"))  # one row a rotation
    cell = max(1, int(np.ceil(radius)))
    near = seeds
    for a in AXES:
        near = near.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(a) / cell) - 1, F.floor(F.col(a) / cell) + 1)))
    near = near.select("seed_id", *[F.col(a).alias(f"s{a}") for a in AXES], *[f"m{i}" for i in range(9)], "cx", "cy", "cz")
    rows = scores
    for a, t in zip(AXES, T):
        rows = rows.withColumn(f"c{a}", F.floor(F.col(t) / cell))
    distance = sum((F.col(t) - F.col(f"s{a}")) ** 2 for t, a in zip(T, AXES))
    local = [F.col("m0") * F.col("ax") + F.col("m3") * F.col("ay") + F.col("m6") * F.col("az"), F.col("m1") * F.col("ax") + F.col("m4") * F.col("ay") + F.col("m7") * F.col("az"), F.col("m2") * F.col("ax") + F.col("m5") * F.col("ay") + F.col("m8") * F.col("az")]
    in_cone = F.sqrt(local[0] ** 2 + local[1] ** 2) <= local[2] * float(np.tan(np.radians(cone_angle))) + 1e-9
    return rows.join(near, ["cx", "cy", "cz"]).where(distance <= radius**2).join(axes, "r").where(in_cone).select(*scores.columns).distinct()


def near_seeds(voxels: DataFrame, seeds: DataFrame, reach: float) -> DataFrame:
    """The voxels within ``reach`` of a seed's cell, to be taken before a constrained search scores anything: with the radius and
    the template's own reach put together, scores near seeds stay complete."""
    cell = max(1, int(np.ceil(reach)))
    near = seeds
    for a in AXES:
        near = near.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(a) / cell) - 1, F.floor(F.col(a) / cell) + 1)))
    near = near.select("cx", "cy", "cz").distinct()
    rows = voxels.withColumns({f"c{a}": F.floor(F.col(a) / cell) for a in AXES})
    return join_small(rows, near, ["cx", "cy", "cz"], "left_semi").drop("cx", "cy", "cz")


def stats(voxels: DataFrame, cells: int | None = None) -> DataFrame:
    """Mean, population deviation, minimum and maximum; over all ``cells`` of the volume if given, absent ones as 0."""
    extreme = (F.min("v"), F.max("v")) if cells is None else (F.when(F.count(F.lit(1)) < cells, F.least(F.min("v"), F.lit(0.0))).otherwise(F.min("v")), F.when(F.count(F.lit(1)) < cells, F.greatest(F.max("v"), F.lit(0.0))).otherwise(F.max("v")))
    share = F.lit(1.0) if cells is None else F.count("v") / F.lit(cells)
    # absent cells are 0: their part of the variance is that of two groups with means apart
    variance = share * F.var_pop("v") + share * (1 - share) * F.avg("v") ** 2
    return voxels.agg((share * F.avg("v")).alias("mean"), F.sqrt(variance).alias("std"), extreme[0].alias("min"), extreme[1].alias("max"))


def center_of_mass(voxels: DataFrame, cutoff: float | None = None, squared: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Mean position weighted by the values above the cutoff, or by their squares."""
    rows = voxels if cutoff is None else voxels.where(F.col("v") > cutoff)
    w = F.col("v") ** 2 if squared else F.col("v")
    return rows.groupBy(*keys).agg(*[(F.sum(w * F.col(a)) / F.sum(w)).alias(a) for a in AXES]) if keys else rows.agg(*[(F.sum(w * F.col(a)) / F.sum(w)).alias(a) for a in AXES])


def covariance(voxels: DataFrame) -> DataFrame:
    """Weighted covariance of positions (six entries), about the centre of mass."""
    center = voxels.agg(F.struct(*[(F.sum(F.col("v") * F.col(a)) / F.sum("v")).alias(a) for a in AXES]).alias("m")).scalar()
    rows = voxels.withColumn("__m", center)
    d = {a: F.col(a) - F.col("__m").getField(a) for a in AXES}
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return rows.agg(*[(F.sum(F.col("v") * d[a] * d[b]) / F.sum("v")).alias(f"c{a}{b}") for a, b in pairs])


def principal_rotation(voxels: DataFrame, axis: int = 2, flip: bool = False, eigenvector: int = 0) -> np.ndarray:
    """The rotation that takes a principal axis of the positive voxels to a coordinate axis; only six sums leave Spark."""
    from rotogrid.functions.lattice import align_vectors

    row = covariance(voxels.where(F.col("v") > 0)).first()
    m = np.array([[row.cxx, row.cxy, row.cxz], [row.cxy, row.cyy, row.cyz], [row.cxz, row.cyz, row.czz]])
    _, vectors = np.linalg.eigh(m)
    chosen = vectors[:, ::-1][:, eigenvector]
    return align_vectors(-chosen if flip else chosen, np.eye(3)[axis])


def radial_bins(voxels: DataFrame, center: Sequence[float], width: float = 1.0) -> DataFrame:
    """Mean power in shells about a centre."""
    d = F.sqrt(sum((F.col(a) - c) ** 2 for a, c in zip(AXES, center)))
    return voxels.groupBy(F.floor(d / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("v") ** 2).alias("power"))


def best_by_label(rows: DataFrame, label: str, score: str, order: str) -> DataFrame:
    """Per label the row of highest score, the smallest ``order`` among equals."""
    return rows.groupBy(label).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("q"))).alias("b")).select(label, (-F.col("b.q")).alias(order), F.col("b.s").alias(score))


def mutual_information(pairs: DataFrame, a: Column, b: Column, bins: int, low: float, high: float, log: bool = True) -> DataFrame:
    """Mutual information of two columns over a bins x bins histogram; without ``log`` the plain ratio sum."""
    from pyspark.sql import Window

    def number(c):
        return F.least(F.greatest(F.floor((c - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))

    cells = pairs.groupBy(number(a).alias("i"), number(b).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over at most bins**2 rows
    p, pi, pj = F.col("n") / total, F.sum("n").over(Window.partitionBy("i")) / total, F.sum("n").over(Window.partitionBy("j")) / total
    ratio = p / (pi * pj)
    return cells.select((p * (F.log(ratio) if log else ratio)).alias("t")).agg(F.sum("t").alias("information"))
