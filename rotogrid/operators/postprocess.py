"""From score maps to picks: normalisation, background, statistics, exports, extraction, averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotogrid.operators.grid import AXES
from rotogrid.operators.score import T


def normalise(foregrounds: DataFrame, cells: int | None = None) -> DataFrame:
    """Subtract each entity's mean and keep, per translation, the best entity: tx, ty, tz, s, entity and r if there is one.

    ``cells``: voxels of a volume, absent ones counting as 0 in the mean. The means are one row per entity.
    """
    mean = foregrounds.groupBy("entity").agg((F.avg("s") if cells is None else F.sum("s") / cells).alias("__m"))
    rows = foregrounds.join(mean, "entity").withColumn("s", F.col("s") - F.col("__m")).drop("__m")
    other = [c for c in rows.columns if c not in ("s", "entity", *T)]
    best = rows.groupBy(*T).agg(F.max(F.struct("s", (-F.col("entity")).alias("q"), *other)).alias("b"))
    return best.select(*T, F.col("b.s").alias("s"), (-F.col("b.q")).alias("entity"), *[F.col(f"b.{c}").alias(c) for c in other])


def subtract_background(foreground: DataFrame, backgrounds: DataFrame) -> DataFrame:
    """Subtract the highest of the mean-free backgrounds, not below 0; positions without one become 0."""
    mean = backgrounds.groupBy("entity").agg(F.avg("s").alias("__m"))
    worst = backgrounds.join(mean, "entity").groupBy(*T).agg(F.max(F.col("s") - F.col("__m")).alias("__b"))
    return foreground.join(worst, list(T), "left").withColumn("s", F.when(F.col("__b").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("s") - F.col("__b")))).drop("__b")


def entity_stats(scores: DataFrame) -> DataFrame:
    return scores.groupBy("entity").agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), F.max("s").alias("most"))


def mask_scores(scores: DataFrame, mask: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Scores times the mask; absent mask voxels are 0. Only scores above the threshold stay."""
    m = mask.select(*[F.col(a).alias(t) for a, t in zip(AXES, T)], F.col("v").alias("__v"))
    return scores.join(m, list(T)).withColumn("s", F.col("s") * F.col("__v")).drop("__v").where(F.col("s") > threshold)


def noise_threshold(scores: DataFrame, false_positives: float, cells: int) -> DataFrame:
    """The score that Gaussian noise of the map's mean and deviation exceeds ``false_positives`` times in ``cells``."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - false_positives / cells)
    mean = F.sum("s") / cells
    return scores.agg((mean + z * F.sqrt(F.sum(F.col("s") ** 2) / cells - mean**2)).alias("threshold"))


def orientations(peaks: DataFrame, angles: DataFrame, rate: Sequence[float] = (1, 1, 1), origin: Sequence[float] = (0, 0, 0)) -> DataFrame:
    """Picks with Euler angles in real units: x, y, z, euler_x, euler_y, euler_z, score, detail.

    ``angles`` has a row per rotation: r, euler_x, euler_y, euler_z; rotation -1 or none means no turn.
    """
    rows = peaks.join(F.broadcast(angles), "r", "left")  # as many rows as rotations
    detail = F.col("detail") if "detail" in peaks.columns else F.lit(-1.0)
    return rows.select(*[(F.col(t) * float(s) + float(o)).alias(a) for t, a, s, o in zip(T, AXES, rate, origin)], *[F.coalesce(f"euler_{a}", F.lit(0.0)).alias(f"euler_{a}") for a in AXES], F.col("s").alias("score"), detail.cast("double").alias("detail"))


def relative_coordinates(picks: DataFrame, shape: Sequence[int], rate: float) -> DataFrame:
    """Angstrom coordinates from the volume's centre."""
    return picks.select(*[((F.col(a) - (n - 1) / 2) * rate).alias(f"{a}_angst") for a, n in zip(AXES, shape)], *[c for c in picks.columns if c not in AXES])


def extract(voxels: DataFrame, picks: DataFrame, box: Sequence[int]) -> DataFrame:
    """Voxels of the box around each pick: pick_id, dx, dy, dz (from the box's first voxel), v.

    The range join runs over cells as large as the box: a voxel meets only the picks of its neighbourhood.
    """
    cells = picks
    for a, b in zip(AXES, box):
        cells = cells.withColumn(f"low_{a}", F.col(a).cast("int") - b // 2).withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"low_{a}") / b), F.floor((F.col(f"low_{a}") + b - 1) / b))))
    cells = cells.select("pick_id", *[f"low_{a}" for a in AXES], "cx", "cy", "cz")
    rows = voxels.select(*AXES, "v", *[F.floor(F.col(a) / b).alias(f"c{a}") for a, b in zip(AXES, box)])
    d = [F.col(a) - F.col(f"low_{a}") for a in AXES]
    inside = (d[0] >= 0) & (d[0] < box[0]) & (d[1] >= 0) & (d[1] < box[1]) & (d[2] >= 0) & (d[2] < box[2])
    return rows.join(cells, ["cx", "cy", "cz"]).where(inside).select("pick_id", d[0].alias("dx"), d[1].alias("dy"), d[2].alias("dz"), "v")


def average(extracted: DataFrame, picks: int) -> DataFrame:
    """Mean over all picks of each box position."""
    return extracted.groupBy("dx", "dy", "dz").agg((F.sum("v") / picks).alias("v"))


def rank_visible(picks: DataFrame, low: float, high: float) -> DataFrame:
    """Picks whose score lies between two percentiles (linear interpolation, both ends included)."""
    from rotogrid.operators.order import percentiles

    a, b = percentiles(picks, "score", (low / 100, high / 100))
    return picks.where(F.col("score").between(F.lit(a).cast("double"), F.lit(b).cast("double")))


def peaks_to_volume(peaks: DataFrame, bounds) -> DataFrame:
    """Stored peaks as a sparse volume: their best score at each position within the bounds."""
    from rotogrid.operators.grid import inside

    rows = peaks.where(inside(bounds, ("tx", "ty", "tz")) & F.col("s").isNotNull())
    return rows.groupBy(F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z")).agg(F.max("s").alias("v"))


def join_attributes(points: DataFrame, originals: DataFrame) -> DataFrame:
    """Points with the attributes of equal originals; missing angles are 0, missing scores 1."""
    joined = points.join(originals, list(AXES), "left")
    fill = {c: 0.0 for c in joined.columns if c.startswith("euler_")} | {"score": 1.0}
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if c in joined.columns})


def discover(tomograms: DataFrame, metadata: DataFrame, masks: DataFrame | None = None, require_mask: bool = False) -> DataFrame:
    """Match files by a normalised id: metadata must be there, masks may; of several files the first path counts.

    Each input has a ``path``; pixel size, binning and filter suffixes and known prefixes don't count.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(normal_id(F.col("path")).alias("tomo")).agg(F.min("path").alias(name))

    out = keyed(tomograms, "tomogram").join(keyed(metadata, "metadata"), "tomo")
    return out if masks is None else out.join(keyed(masks, "mask"), "tomo", "inner" if require_mask else "left")


def normal_id(path: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    name = F.regexp_replace(name, r"(_(?:[0-9]+(?:\.[0-9]+)?Apx|bin[0-9]+|lp[0-9]+|mask|rec|filtered))+$", "")
    return F.regexp_replace(name, "^(rec_|tomo_|mask_)", "")
