"""The whole way from volume files to pick lists, for one tomogram or a folder of them."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotogrid.functions import fourier, lattice
from rotogrid.operators import dense, grid, lines, peaks, postprocess
from rotogrid.session import cut
from rotogrid.sources import picks as picks_io
from rotogrid.sources import volumes
from rotogrid.sources.files import read_bytes, write_parts


def rotation_set(sampling: float, dim: int = 3, cone: float | None = None, cone_sampling: float | None = None, symmetry: int = 1) -> np.ndarray:
    """Identity alone from 180 degrees on, a cone if one is given, otherwise a quasi-uniform set."""
    if sampling >= 180:
        return np.eye(dim)[None]
    if cone is not None:
        return lattice.cone_rotations(cone, cone_sampling or sampling, axis_sampling=sampling, symmetry=symmetry)
    return lattice.uniform_rotations(sampling, dim)


#: Bytes that one task of matching may take.
TASK_BYTES = 1 << 30


def template_filters(shape: Sequence[int], rate: float, lowpass: float | None = None, highpass: float | None = None, tilts: Sequence[dict] | None = None, weight: str = "none", ctf: Sequence[dict] | None = None) -> np.ndarray | None:
    """The filter that rotated templates take: a band, the tilts that a series reaches with their weights, and its CTF.

    ``tilts`` are rows of :func:`sources.text.tilts`, ``ctf`` of :func:`sources.text.ctf_rows`; None if nothing is asked for.
    """
    if tilts:
        angles, doses = [t["angle"] for t in tilts], [t["weight"] for t in tilts]
        defocus = float(np.mean([c["defocus_x"] for c in ctf])) if ctf else None
        return fourier.tilt_filters(shape, angles, rate, doses, weight, defocus, lowpass, highpass)
    out = fourier.band_pass(shape, lowpass, highpass, rate=rate) if lowpass or highpass else None
    if ctf:
        curve = fourier.ctf(shape, float(np.mean([c["defocus_x"] for c in ctf])), rate=rate)
        out = curve if out is None else out * curve
    return out


def _filtered_target(blocks: DataFrame, keys: Sequence[str], shape: Sequence[int], rate: float, lowpass: float | None, highpass: float | None, whiten: bool) -> DataFrame:
    """A band of the whole volume's spectrum, or its whitening, line by line along every axis."""
    if keys:
        raise ValueError("targets are filtered one volume at a time")
    bounds = [(0, n - 1) for n in shape]
    voxels = grid.from_blocks(blocks)
    if lowpass or highpass:
        voxels = lines.filtered(lines.spectrum(voxels, bounds), bounds, lambda f: fourier.band_gain(f / rate, lowpass, highpass))
    if whiten:
        voxels = lines.whiten(voxels, bounds)
    return voxels


def match(
    spark: SparkSession, target: str, template: str, mask: str | None = None, out: str | None = None, rotations: np.ndarray | None = None, sampling: float = 60.0, score: str = "FLCSphericalMask",
    edge: int | None = None, lowpass: float | None = None, order: int = 1, threshold: float = -1.0, precision: str = "float32", group: int | None = None, highpass: float | None = None, tilts: Sequence[dict] | None = None,
    weight: str = "none", ctf: Sequence[dict] | None = None, target_lowpass: float | None = None, target_highpass: float | None = None, whiten: bool = False, seeds: DataFrame | None = None, radius: float = 10.0, cone: float = 15.0,
    memory: int = TASK_BYTES,
) -> DataFrame:
    """Score a template file at every voxel and rotation of a target file, by any of ``dense.DENSE``. Columns tx, ty, tz, s, r.

    The template is filtered after its rotation (:func:`template_filters`), the target as a whole. ``seeds`` (x, y, z and the
    matrix m0..m8 of each pick) keep the search within ``radius`` voxels of them and rotations within ``cone`` degrees.
    The best maps are written to ``out`` if given, with ``meta`` beside them: shape, origin, voxel size and the rotations.

    Plan: stored blocks are cut into slabs that are shuffled once into blocks with halos, as large as ``memory`` allows unless
    ``edge`` is given; these are written to the shared folder and scored in narrow tasks, whose maps stay blocks of bytes. Where
    blocks are fewer than the cluster's tasks, rotations are put into groups (``group`` at a time), whose maps are merged.
    """
    stored = volumes.read_volumes(spark, target)
    head = stored.select("shape", "origin", "rate").first()
    maps, meta = _match(spark, stored, (), head, template, mask, rotations, sampling, score, edge, lowpass, order, threshold, precision, group, highpass, tilts, weight, ctf, (target_lowpass, target_highpass, whiten), seeds, radius, cone, memory)
    if out:
        maps.write.mode("overwrite").parquet(f"{out}/maps")
        _write_meta(spark, out, meta)
        maps = spark.read.parquet(f"{out}/maps")
    return dense.best_rows(maps)


def _match(spark, stored, keys, head, template, mask, rotations, sampling, score, edge, lowpass, order, threshold, precision, group, highpass, tilts, weight, ctf, on_target, seeds, radius, cone, memory, files=1):
    g, _, rate = volumes.read(read_bytes(spark, template), template)
    g = np.asarray(g, float)
    m = np.asarray(volumes.read(read_bytes(spark, mask), mask)[0], float) if mask else np.ones_like(g)
    if m.shape != g.shape:
        raise ValueError("mask and template have different shapes")
    rotations = rotation_set(sampling) if rotations is None else rotations
    halo = max(g.shape) // 2 + (score == "LCC")
    planned = dense.plan_work(head.shape, g.shape, score, memory, np.dtype(precision).itemsize, len(rotations), spark.sparkContext.defaultParallelism, files)
    if edge is None:
        edge, parts = planned
        group = group or (-(-len(rotations) // parts) if parts > 1 else None)
    elif group is None:
        group = groups(files * math.prod(-(-n // edge) for n in head.shape), len(rotations), spark.sparkContext.defaultParallelism)
    blocks = stored.select(*keys, "block_id", "start", F.col("block_shape").alias("shape"), F.col("shape").alias("volume"), "data")
    if any(on_target):
        bounds = [(0, n - 1) for n in head.shape]
        voxels = _filtered_target(blocks, keys, head.shape, float(head.rate[0]), *on_target)
        tiles = grid.to_blocks(grid.wrap_faces(voxels, bounds) if score == "LCC" else voxels, edge, halo)
        tiles = tiles.withColumn("low", F.array(*[F.lit(0)] * 3)).withColumn("high", F.array(*[F.lit(n - 1) for n in head.shape]))
    else:
        tiles = grid.retile(blocks, edge, halo, keys, 1 if score == "LCC" else 0, precision, min(20_000, files * math.prod(-(-n // edge) for n in head.shape)))
    tiles = cut(tiles)
    keep = template_filters(g.shape, float(rate[0]), lowpass, highpass, tilts, weight, ctf)
    maps = dense.best_blocks(tiles, g, m, rotations, halo, score, threshold, order, precision, group, None, keys, keep, seeds, radius, cone)
    meta = {"shape": list(head.shape), "origin": list(head.origin), "rate": list(head.rate), "rotations": np.asarray(rotations).reshape(len(rotations), -1).tolist()}
    return maps, meta


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a search (x, y, z, m0..m8) from a pick list file: positions with the matrices of their angles."""
    kind = {"star": "star", "tbl": "tbl"}.get(path.rsplit(".", 1)[-1], "text")
    body = spark.createDataFrame([(path, read_bytes(spark, path).decode())], "path string, body string")
    rows = picks_io.parse_picks(body, kind).where("x is not null and y is not null and z is not null")
    matrix = lattice.euler_columns(*[F.coalesce(f"euler_{a}", F.lit(0.0)) for a in "xyz"])
    return rows.select("x", "y", "z", *[m.alias(f"m{i}") for i, m in enumerate(matrix)])


def groups(blocks: int, rotations: int, tasks: int) -> int | None:
    """Rotations to a group so that blocks and groups give every task some work; None where blocks alone do."""
    wanted = -(-2 * tasks // max(blocks, 1))
    return None if wanted < 2 or rotations < 2 else max(1, -(-rotations // wanted))


def _places(path: str) -> tuple[str, str]:
    """Where the maps and the meta of a run are; ``folder/name=volume`` is one volume of a folder's run."""
    base, _, name = path.rstrip("/").rpartition("/")
    return (f"{base}/maps/{name}", f"{base}/meta/{name}.json") if name.startswith("name=") else (f"{path}/maps", f"{path}/meta/meta.json")


def _write_meta(spark: SparkSession, out: str, meta: dict) -> None:
    write_parts(spark, _places(out)[1], [json.dumps(meta).encode()])


def load_scores(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The best map of a run as rows, and its meta."""
    maps, meta = _places(path)
    return dense.best_rows(spark.read.parquet(maps)), json.loads(read_bytes(spark, meta))


def call(
    scores: DataFrame, meta: dict, n: int = 1000, distance: float = 5.0, boundary: int = 0, low: float | None = None, high: float | None = None, caller: str = "maximum_filter", false_positives: float | None = None,
    background: DataFrame | None = None, mask: DataFrame | None = None,
) -> DataFrame:
    """Picks of a score map: correct the background, mask, threshold, propose, suppress neighbours, keep the best n."""
    bounds = [(0, k - 1) for k in meta["shape"]]
    rows = scores
    if background is not None:
        rows = postprocess.subtract_background(rows, background)
    if mask is not None:
        rows = postprocess.mask_scores(rows, mask)
    if false_positives is not None:
        low = float(postprocess.noise_threshold(rows, false_positives, int(np.prod(meta["shape"]))).first()[0])
    rows = peaks.admissible(rows, bounds, boundary, low, high)
    if caller == "maximum_filter":
        rows = peaks.maximum_filter(rows, max(1, int(distance)), bounds)
    elif caller == "fast":
        rows = peaks.fast_peaks(rows, max(1, int(distance)), bounds)
    elif caller == "recursive":
        kept = peaks.recursive_masking(rows, int(distance), n)
        return kept
    elif caller != "sort":
        raise ValueError("callers are maximum_filter, fast, recursive and sort")
    return peaks.top(peaks.suppress(rows, distance), n)


def angle_table(spark: SparkSession, rotations: Sequence) -> DataFrame:
    """Euler angles of each rotation; a pull rotation's inverse turns the template into the target."""
    rows = []
    for r, m in enumerate(rotations):
        m = np.asarray(m, float)
        d = int(round(len(m.ravel()) ** 0.5))
        rows.append((r, *[float(a) for a in lattice.matrix_to_euler(m.reshape(d, d))]))
    return spark.createDataFrame(rows, "r int, euler_x double, euler_y double, euler_z double")


def picks_of(spark: SparkSession, found: DataFrame, meta: dict) -> DataFrame:
    return postprocess.orientations(found, angle_table(spark, meta["rotations"]))


def write_picks(picks: DataFrame, path: str, kind: str | None = None) -> None:
    """One pick list file by suffix, by the file system of the path: .tsv or .txt, .star, .tbl. The list is the result of a top-n report."""
    kind = kind or {"star": "star", "tbl": "tbl"}.get(path.rsplit(".", 1)[-1], "text")
    rows = picks.withColumn("pick_id", F.xxhash64("x", "y", "z", "euler_x", "euler_y", "euler_z"))
    text, header = {"text": (picks_io.format_text, ["\t".join(picks_io.COLUMNS)]), "star": (picks_io.format_star, picks_io.star_header()), "tbl": (picks_io.format_dynamo, [])}[kind]
    lines = rows.select(F.col("score"), "x", "y", "z", text(rows).alias("t")).orderBy(F.desc("score"), "x", "y", "z").select("t")
    write_parts(picks.sparkSession, path, (f"{t}\n".encode() for t in [*header, *(r.t for r in lines.toLocalIterator())]))


def match_folder(spark: SparkSession, pattern: str, template: str, out: str, **options) -> dict[str, str]:
    """Match a template in every volume of a glob, all in one job. Returns each volume's result folder or its error.

    Volumes are told apart by their path: blocks of all files are scored together, each with its own statistics, so a few large
    files and many small ones fill the cluster alike. A file that can't be read is reported and stops no other. Options are
    those of :func:`match` that hold for all volumes; filters of the target and seeds don't.
    """
    stored = cut(volumes.read_volumes(spark, pattern, errors=True))
    names = stored.select("path", "shape", "origin", "rate", F.when(F.col("data").isNull(), F.col("block_id")).alias("error")).dropDuplicates(["path"])
    named = names.withColumn("name", F.regexp_extract("path", r"([^/]+?)(\.[^/]*)?$", 1))
    heads = named.collect()  # a row for each file
    found = {h.name: h.error or f"{out}/name={h.name}" for h in heads}
    good = [h for h in heads if h.error is None]
    if not good:
        return found
    largest = max(good, key=lambda h: max(h.shape))
    own = {k: options.pop(k, v) for k, v in (("mask", None), ("rotations", None), ("sampling", 60.0), ("score", "FLCSphericalMask"), ("edge", None), ("lowpass", None), ("order", 1), ("threshold", -1.0), ("precision", "float32"), ("group", None), ("highpass", None), ("tilts", None), ("weight", "none"), ("ctf", None))}
    if options.keys() - {"memory"}:
        raise ValueError(f"options that don't hold for all volumes: {', '.join(options)}")
    maps, meta = _match(spark, stored.where("data is not null"), ("path",), largest, template, *own.values(), (None, None, False), None, 0.0, 180.0, options.get("memory", TASK_BYTES), len(good))
    maps.withColumn("name", F.regexp_extract("path", r"([^/]+?)(\.[^/]*)?$", 1)).write.mode("overwrite").partitionBy("name").parquet(f"{out}/maps")
    for h in good:
        _write_meta(spark, found[h.name], meta | {"shape": list(h.shape), "origin": list(h.origin), "rate": list(h.rate)})
    return found
