"""Atomic structures as tables: subsets, metadata, transforms, superposition, rasterising."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotogrid.operators.grid import AXES


def by_chain(atoms: DataFrame, chains: str | None) -> DataFrame:
    """Atoms of the chains in a comma list; None keeps all."""
    return atoms if chains is None else atoms.where(F.col("chain").isin([c.strip() for c in chains.split(",")]))


def by_range(atoms: DataFrame, start: int, stop: int, chains: str | None = None) -> DataFrame:
    """Residues from start to stop, both included."""
    return by_chain(atoms, chains).where(F.col("residue").between(start, stop))


def weighted(atoms: DataFrame, elements: DataFrame, weight: str = "atomic_weight") -> DataFrame:
    """A column ``w``: the element's property, 0 for unknown elements, 1 for ``equal``. The table has a row per element."""
    if weight == "equal":
        return atoms.withColumn("w", F.lit(1.0))
    if weight not in ("atomic_weight", "atomic_number", "vdw"):
        raise NotImplementedError(weight)
    return atoms.join(F.broadcast(elements.select("element_symbol", F.col(weight).cast("double").alias("w"))), "element_symbol", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def center_of_mass(atoms: DataFrame, elements: DataFrame, weight: str = "atomic_weight") -> DataFrame:
    return weighted(atoms, elements, weight).agg(*[(F.sum(F.col("w") * F.col(a)) / F.sum("w")).alias(a) for a in AXES])


def chain_weights(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    return weighted(atoms, elements).groupBy("chain").agg(F.sum("w").alias("weight"), F.count(F.lit(1)).alias("n"))


def chain_ranges(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("chain").agg(F.min("residue").alias("first"), F.max("residue").alias("last"))


def chain_signatures(atoms: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per chain a signature of its element sequence, from per-residue sums of hashed (place, element) pairs.

    Equal chains have equal signatures whatever task their atoms are in, and no sequence is collected.
    """
    place = F.row_number().over(Window.partitionBy("chain", "residue").orderBy(*order))
    rows = atoms.withColumn("__p", place)
    first = atoms.groupBy("chain").agg(F.min("residue").alias("__first"))
    part = F.xxhash64(F.col("residue") - F.col("__first"), "__p", "element_symbol")
    return rows.join(first, "chain").groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.sum((part % 1_000_003).cast("bigint")).alias("h1"), F.bit_xor(part).alias("h2"))


def unique_chains(signatures: DataFrame) -> DataFrame:
    """Chains of one sequence together, by the first of them."""
    return signatures.groupBy("n", "h1", "h2").agg(F.min("chain").alias("first_chain"), F.count(F.lit(1)).alias("chains"))


def transform(atoms: DataFrame, matrix: Sequence[float], translation: Sequence[float] = (0, 0, 0), geometric: bool = False) -> DataFrame:
    """Rotate about the mean (or the middle of the enclosing box), which stays in place, then translate."""
    c = atoms.agg(F.struct(*[((F.min(a) + F.max(a)) / 2 if geometric else F.avg(a)).alias(a) for a in AXES]).alias("c")).scalar()
    rows = atoms.withColumn("__c", c)
    d = [F.col(a) - F.col("__c").getField(a) for a in AXES]
    moved = [sum(float(matrix[i * 3 + j]) * d[j] for j in range(3)) + F.col("__c").getField(a) + float(translation[i]) for i, a in enumerate(AXES)]
    return rows.withColumns(dict(zip(AXES, moved))).drop("__c")


def centered(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """Move the centre of mass to the middle of the enclosing box."""
    w = weighted(atoms, elements)
    c = w.agg(F.struct(*[((F.min(a) + F.max(a)) / 2 - F.sum(F.col("w") * F.col(a)) / F.sum("w")).alias(a) for a in AXES]).alias("c")).scalar()
    return atoms.withColumn("__c", c).withColumns({a: F.col(a) + F.col("__c").getField(a) for a in AXES}).drop("__c")


def rmsd(a: DataFrame, b: DataFrame, keys: Sequence[str], weights: bool = False) -> DataFrame:
    """Root mean squared distance of atoms matched by keys; ``weights``: by the mean of both sides' column ``w``."""
    other = b.select(*keys, *[F.col(c).alias(f"o{c}") for c in AXES], *([F.col("w").alias("ow")] if weights else []))
    d2 = sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in AXES)
    mean = F.avg(d2 * (F.col("w") + F.col("ow")) / 2) if weights else F.avg(d2)
    return a.join(other, list(keys)).agg(F.sqrt(mean).alias("rmsd"), F.count(F.lit(1)).alias("n"))


def superpose(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Rotation and translation that take ``a`` onto ``b`` best, and the deviation before and after.

    One join and one aggregation of raw moments; only these sums reach the driver's singular value decomposition.
    """
    other = b.select(*keys, *[F.col(c).alias(f"o{c}") for c in AXES])
    sums = a.join(other, list(keys)).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in AXES], *[F.sum(f"o{c}").alias(f"t{c}") for c in AXES],
        *[F.sum(F.col(c) * F.col(f"o{e}")).alias(f"m{c}{e}") for c in AXES for e in AXES], F.sum(sum(F.col(c) ** 2 for c in AXES)).alias("aa"), F.sum(sum(F.col(f"o{c}") ** 2 for c in AXES)).alias("bb"),
    ).first()
    n = sums["n"]
    if not n:
        raise ValueError("no atoms in common")
    p, q = (np.array([sums[f"{k}{c}"] for c in AXES]) / n for k in "st")
    cross = np.array([[sums[f"m{c}{e}"] for e in AXES] for c in AXES]) / n
    h = cross - np.outer(p, q)
    u, _, vt = np.linalg.svd(h)
    rotation = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    shift = q - rotation @ p
    before = sums["aa"] / n + sums["bb"] / n - 2 * np.trace(cross)
    after = (sums["aa"] / n - p @ p) + (sums["bb"] / n - q @ q) - 2 * np.trace(rotation @ h)
    return rotation, shift, math.sqrt(max(0.0, before)), math.sqrt(max(0.0, after))


def _voxel(c: Column, rate: float, origin: float) -> Column:
    return F.rint((c - origin) / rate).cast("int")


def to_volume(atoms: DataFrame, elements: DataFrame, rate: Sequence[float] = (1, 1, 1), origin: Sequence[float] = (0, 0, 0), shape: Sequence[int] | None = None, weight: str = "atomic_weight") -> DataFrame:
    """Sum of weights per voxel; positions round half to even, those outside the shape are dropped."""
    rows = weighted(atoms, elements, weight).select(*[_voxel(F.col(a), r, o).alias(a) for a, r, o in zip(AXES, rate, origin)], "w")
    if shape:
        for a, n in zip(AXES, shape):
            rows = rows.where(F.col(a).between(0, n - 1))
    return rows.groupBy(*AXES).agg(F.sum("w").alias("v"))


def vdw_spheres(atoms: DataFrame, elements: DataFrame, rate: float = 1.0, shape: Sequence[int] | None = None) -> DataFrame:
    """Each atom as a sphere of its van der Waals radius (in hundredths of an angstrom), added up."""
    rows = weighted(atoms, elements, "vdw").withColumn("k", F.ceil(F.col("w") / (100 * rate)).cast("int")).select(*[_voxel(F.col(a), rate, 0).alias(a) for a in AXES], "k")
    rows = rows.groupBy(*AXES, "k").agg(F.count(F.lit(1)).alias("n"))  # equal spheres once
    for a in AXES:
        rows = rows.withColumn(f"d{a}", F.explode(F.sequence(-F.col("k"), F.col("k"))))
    rows = rows.where(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2 <= F.col("k") ** 2)
    rows = rows.select(*[(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES], "n")
    if shape:
        for a, n in zip(AXES, shape):
            rows = rows.where(F.col(a).between(0, n - 1))
    return rows.groupBy(*AXES).agg(F.sum("n").cast("double").alias("v"))


def gaussian_map(atoms: DataFrame, elements: DataFrame, resolution: float, rate: float, bounds) -> DataFrame:
    """Weights blurred to a resolution: sigma = resolution / (pi sqrt 2)."""
    from rotogrid.operators.stencil import gaussian

    return gaussian(to_volume(atoms, elements, (rate,) * 3), resolution / (math.pi * math.sqrt(2)) / rate, bounds, "zero")
