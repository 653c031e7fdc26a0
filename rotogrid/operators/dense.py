"""Dense blocks: scores by FFT, rotation by interpolation, filters. The path for large templates and rotation sets."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotogrid.functions.fourier import apply
from rotogrid.operators.grid import AXES
from rotogrid.operators.skew import join_small
from rotogrid.session import cut

EPS = 1.1920929e-07


def fast_length(n: int) -> int:
    """The next length without prime factors over 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def rotate(data: np.ndarray, matrix: np.ndarray, order: int = 1) -> np.ndarray:
    """Pull values through the inverse rotation about (shape - 1) / 2; outside is 0. Orders 0 and 1, and 3 by cubic splines."""
    center = (np.array(data.shape) - 1) / 2
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in data.shape], indexing="ij"), -1).reshape(-1, data.ndim)
    at = (grid - center) @ np.asarray(matrix) + center
    if order == 0:
        p = np.rint(at).astype(int)
        ok = ((p >= 0) & (p < data.shape)).all(1)
        out = np.zeros(len(at))
        out[ok] = data[tuple(p[ok].T)]
        return out.reshape(data.shape)
    if order not in (1, 3):
        raise ValueError("orders are 0, 1 and 3")
    source = spline_coefficients(data) if order == 3 else data
    low = np.floor(at).astype(int)
    frac = at - low
    taps = range(-1, 3) if order == 3 else range(2)
    out = np.zeros(len(at))
    inside = ((at >= -1e-9) & (at <= np.array(data.shape) - 1 + 1e-9)).all(1)
    for corner in np.ndindex(*[len(taps)] * data.ndim):
        step = np.array([taps[c] for c in corner])
        p = low + step
        w = np.prod(_cubic(frac - step) if order == 3 else np.maximum(0.0, 1 - np.abs(frac - step)), 1)
        p = np.where(p < 0, -p, p)
        p = np.where(p >= data.shape, 2 * (np.array(data.shape) - 1) - p, p)
        out += w * source[tuple(np.clip(p, 0, np.array(data.shape) - 1).T)]
    return np.where(inside, out, 0.0).reshape(data.shape)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 2 / 3 - x**2 + x**3 / 2, np.where(x < 2, (2 - x) ** 3 / 6, 0.0))


def spline_coefficients(data: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients with mirrored borders: a tridiagonal system along every axis."""
    out = data.astype(float)
    for axis in range(data.ndim):
        n = data.shape[axis]
        if n < 2:
            continue
        system = (np.diag(np.full(n, 4.0)) + np.diag(np.full(n - 1, 1.0), 1) + np.diag(np.full(n - 1, 1.0), -1)) / 6
        system[0, 1] += 1 / 6
        system[-1, -2] += 1 / 6
        out = np.moveaxis(np.linalg.solve(system, np.moveaxis(out, axis, 0).reshape(n, -1)).reshape(np.moveaxis(out, axis, 0).shape), 0, axis)
    return out


class Block:
    """Spectra of one block of a volume, and products of them with small kernels at the positions of the kernel's index size // 2.

    Without a halo the block is padded and every position is exact to its edges. With one of at least half the kernel the
    transforms are circular in the block's own size, whose wrap stays within the halo, and maps hold the core only;
    each axis is cut to the core as soon as it is transformed back. Values are (target - ``mean``) / ``scale`` within the volume
    (``inside``, all by default) and 0 beyond it, so results don't depend on the target's amplitude or offset.
    """

    def __init__(self, target: np.ndarray, edge: Sequence[int], halo: int | None, precision, inside: np.ndarray | None, mean: float, scale: float) -> None:
        self.precision, self.mean, self.scale = precision, mean / scale, scale
        self.dim, self.volume = target.ndim, math.prod(edge)
        self.single = np.dtype(precision) == np.float32
        self.shape = [fast_length(n if halo is not None else n + m - 1) for n, m in zip(target.shape, edge)]
        start = [(m - 1 - m // 2) + (halo or 0) for m in edge]
        self.keep = [slice(s, s + n - 2 * (halo or 0)) for s, n in zip(start, target.shape)]
        values = (np.asarray(target, float) - mean) / scale
        whole = inside is None or bool(inside.all())
        #: Is the volume's end in sight, so that the mask's part within it matters?
        self.face = halo is None or not whole
        t = np.ones(target.shape) if inside is None else np.asarray(inside, float)
        if not whole:
            values = values * t
        self._fields = {"f": values, "f2": values**2, "t": t}
        self._spectra: dict[str, np.ndarray] = {}
        self.kept: dict = {}

    def spectrum(self, a: np.ndarray) -> np.ndarray:
        return np.fft.rfftn(np.asarray(a, self.precision), s=self.shape, axes=range(self.dim))

    def kernel(self, a: np.ndarray) -> np.ndarray:
        return self.spectrum(a[(slice(None, None, -1),) * self.dim])

    def product(self, name: str, kernel: np.ndarray) -> np.ndarray:
        """Correlation of the field ``f``, ``f2`` or ``t`` (inside) with a kernel's spectrum."""
        if name not in self._spectra:
            self._spectra[name] = self.spectrum(self._fields[name])
        out = self._spectra[name] * kernel
        for axis in range(self.dim - 1):
            out = _cut(np.fft.ifft(out, axis=axis), axis, self.keep[axis])
        return _cut(np.fft.irfft(out, n=self.shape[-1], axis=-1), self.dim - 1, self.keep[-1])

    def inside_share(self, mask: np.ndarray, n: float) -> np.ndarray | float:
        """The part of a mask (spectrum, of sum ``n``) that lies within the volume; 1 where that is all but rounding."""
        if not self.face:
            return 1.0
        share = self.product("t", mask) / n
        return np.where(share > 1 - 1e-5, 1.0, np.maximum(share, 0.0))

    def deviations(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """Local deviation under a mask times its sum, and the mask's part within the volume. Where the deviation vanishes
        next to the volume's scale it counts as 1."""
        n, mask, c = m.sum(), self.kernel(m), self.mean
        share = self.inside_share(mask, n)
        first = self.product("f", mask) / n
        # values beyond the volume are 0, not the mean: what that adds to the variance
        variance = self.product("f2", mask) / n - first**2 + (2 * c * first * (1 - share) + c * c * share * (1 - share) if self.face and c else 0.0)
        local = np.sqrt(np.maximum(0.0, variance))
        return np.where(local < (1e-3 if self.single else 1e-6), 1.0, local) * n, share


def _plain(block: Block, g: np.ndarray, m: np.ndarray, _) -> np.ndarray:
    return block.product("f", block.kernel(g)) * block.scale


def _local(block: Block, g: np.ndarray, m: np.ndarray, _, below=None) -> np.ndarray:
    n = m.sum()
    mean = (g * m).sum() / n
    std = math.sqrt(max(0.0, (g**2 * m).sum() / n - mean**2)) or 1.0
    below, share = block.deviations(m) if below is None else below
    kernel = block.kernel((g - mean) / std * m)
    out = block.product("f", kernel)
    if block.face and block.mean:
        out = out + np.where(share == 1.0, 0.0, block.mean * block.product("t", kernel))
    return out / below


def _spherical(block: Block, g: np.ndarray, m: np.ndarray, _) -> np.ndarray:
    """Deviations once under the mask as it stands, shared by all rotations."""
    if "below" not in block.kept:
        block.kept["below"] = block.deviations(m)
    return _local(block, g, m, None, block.kept["below"])


def _normalised(block: Block, g: np.ndarray, m: np.ndarray, moments: tuple[float, float]) -> np.ndarray:
    mean, deviation = moments
    mask = block.kernel(m)
    sums = block.product("f", mask)
    below = np.maximum(0.0, block.product("f2", mask) - sums**2 / block.volume)
    fits = below > (1e-6 if block.single else 1e-12) * m.sum()
    up = block.product("f", block.kernel(g * m)) - mean * sums
    return np.where(fits, up / np.sqrt(np.where(fits, below, 1.0) * deviation), 0.0) if deviation else np.zeros_like(up)


def _masked(block: Block, g: np.ndarray, m: np.ndarray, peak: tuple[float, float] | None, overlap: float = 0.3) -> np.ndarray | tuple:
    """``peak``: the largest denominator and overlap of the rotation over the whole volume, by default this block's."""
    g = g * m
    mask, kernel = block.kernel(m), block.kernel(g)
    fg, fm, f2m = block.product("f", kernel), block.product("f", mask), block.product("f2", mask)
    if block.face:
        tm, tg, tg2 = block.product("t", mask), block.product("t", kernel), block.product("t", block.kernel(g * g))
    else:
        tm, tg, tg2 = (np.full(fg.shape, a.sum()) for a in (m, g, g * g))
    o = np.maximum(tm, EPS)
    below = np.sqrt(np.maximum(0.0, f2m - fm**2 / o) * np.maximum(0.0, tg2 - tg**2 / o))
    if peak == "ask":
        return float(below.max()), float(tm.max())
    most_below, most_overlap = peak or (float(below.max()), float(tm.max()))
    score = (fg - fm * tg / o) / np.where(below < 1e3 * EPS * most_below, 1.0, below)
    return np.where(tm < overlap * most_overlap, 0.0, np.clip(score, -1.0, 1.0))


#: Scores of dense blocks: function, does the mask turn with the template, and is the target's mean taken off.
DENSE = {
    "CC": (_plain, False, False), "LCC": (_plain, False, False), "CORR": (_normalised, True, False), "CAM": (_normalised, True, True), "FLC": (_local, True, True),
    "FLCSphericalMask": (_spherical, False, True), "MCC": (_masked, True, True), "batchFLC": (_local, True, True), "batchFLCSpherical": (_spherical, False, True),
}


def laplacian(a: np.ndarray) -> np.ndarray:
    """2 d + 1 point Laplacian with wrapping borders; axes of one cell add nothing."""
    live = [i for i, n in enumerate(a.shape) if n > 1]
    return sum((np.roll(a, 1, i) + np.roll(a, -1, i) for i in live), -2.0 * len(live) * a)


def fft_scores(
    target: np.ndarray, template: np.ndarray, mask: np.ndarray, rotations: Sequence[np.ndarray], score: str = "FLC", order: int = 1, template_filter=None, halo: int | None = None, precision=np.float64,
    inside: np.ndarray | None = None, stats: tuple[float, float, float] | None = None, peaks: Sequence | str | None = None, filtered: bool = False,
) -> Iterator[np.ndarray]:
    """Score maps of one dense block (see :class:`Block`), one rotation after the other.

    ``stats``: mean, deviation and largest absolute value of the whole volume, by default this block's. ``peaks``: for MCC, the
    largest denominator and overlap of each rotation over the whole volume; ``"ask"`` yields this block's instead of maps.
    ``filtered``: the target of LCC is a Laplacian already. Unknown scores raise ValueError.
    """
    if score not in DENSE:
        raise ValueError(f"scores are {', '.join(DENSE)}")
    function, turns, shifted = DENSE[score]
    target, template, mask = (np.asarray(a, float) for a in (target, template, mask))
    if score == "LCC":
        template = laplacian(template)
        target = target if filtered else laplacian(target)
    if stats is None or score == "LCC" and not filtered:
        own = target if inside is None else target[inside]
        stats = (float(own.mean()), float(own.std()), float(np.abs(own).max())) if own.size else (0.0, 1.0, 1.0)
    mean, std, peak = stats
    # CAM standardises the whole volume; the others take any scale that keeps sums small, and the exact mean where it cancels
    scale = (std if score == "CAM" else max(peak, abs(mean)) if not shifted else std) or 1.0
    block = Block(target, template.shape, halo, precision, inside, mean if shifted else 0.0, scale)
    if score == "CAM":
        template = (template - template.mean()) / (template.std() or 1.0)
    n = mask.sum()
    average = (template * mask).sum() / n
    moments = (average, ((template - average) ** 2 * mask).sum())
    for k, matrix in enumerate(rotations):
        g = rotate(template, matrix, order)
        if template_filter is not None:
            g = apply(g, template_filter)
        m = rotate(mask, matrix, order) if turns else mask
        yield function(block, g, m, (peaks if isinstance(peaks, str) or peaks is None else peaks[k]) if score == "MCC" else moments)


def _cut(a: np.ndarray, axis: int, part: slice) -> np.ndarray:
    return a[tuple(part if i == axis else slice(None) for i in range(a.ndim))]


def cells(row: dict) -> np.ndarray:
    """The array of a block row; single or double precision is told by its length."""
    n = math.prod(row["shape"])
    return np.frombuffer(row["data"], f"f{len(row['data']) // max(n, 1) or 8}").reshape(row["shape"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Each row with its batch; blocks are large, so one at a time becomes Python values."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, batch.slice(i, 1).to_pylist()[0]


def _within(start: Sequence[int], shape: Sequence[int], low: Sequence[int] | None, high: Sequence[int] | None) -> np.ndarray | None:
    """Which cells of a block lie in the volume; None if all do."""
    if low is None or all(a <= s and s + n - 1 <= b for s, n, a, b in zip(start, shape, low, high)):
        return None
    sides = [(np.arange(n) + s >= a) & (np.arange(n) + s <= b) for s, n, a, b in zip(start, shape, low, high)]
    return np.logical_and.reduce(np.meshgrid(*sides, indexing="ij"))


def _core_of(row: dict, halo: int, inside: np.ndarray | None) -> np.ndarray:
    core = tuple(slice(halo, n - halo) for n in row["shape"])
    values = cells(row)[core]
    return values.ravel() if inside is None else values[inside[core]]


def volume_stats(blocks: DataFrame, halo: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation and largest absolute value of every volume over the cores of its blocks: keys, v_mean, v_std, v_peak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                own = _core_of(row, halo, _within(row["start"], row["shape"], row["low"], row["high"]))
                found.append((len(own), own.mean(), own.var() * len(own), np.abs(own).max()) if len(own) else (0, 0.0, 0.0, 0.0))
            columns = [pa.array([float(f[i]) for f in found], pa.float64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *columns], names=[*keys, "n", "m", "q", "p"])

    kinds = [f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys]
    parts = blocks.select(*keys, "start", "shape", "data", "low", "high").mapInArrow(run, ", ".join([*kinds, "n double", "m double", "q double", "p double"]))
    mean = F.sum(F.col("n") * F.col("m")) / F.greatest(F.sum("n"), F.lit(1.0))
    spread = F.sum("q") + F.sum(F.col("n") * F.col("m") * F.col("m")) - mean * mean * F.sum("n")
    # parts of nearly equal means: the second and third terms cancel to less than rounding of the first
    return parts.groupBy(*keys).agg(mean.alias("v_mean"), F.sqrt(F.greatest(F.lit(0.0), spread) / F.greatest(F.sum("n"), F.lit(1.0))).alias("v_std"), F.max("p").alias("v_peak"))


def _parts(rotations: int, group: int | None) -> list[tuple[int, int]]:
    return [(a, min(a + group, rotations)) for a in range(0, rotations, group)] if group else [(0, rotations)]


#: Columns of best maps: the core's begin and shape, the best score (doubles or singles) and rotation (ints) of every cell.
MAPS = "start array<int>, shape array<int>, scores binary, best binary"


def best_blocks(
    blocks: DataFrame, template: np.ndarray, mask: np.ndarray, rotations: np.ndarray, halo: int, score: str = "FLC", threshold: float = -1.0, order: int = 1, precision: str = "float64", group: int | None = None,
    bounds: Sequence[tuple[int, int]] | None = None, keys: Sequence[str] = (), template_filter: np.ndarray | None = None, seeds: DataFrame | None = None, radius: float = 0.0, cone: float = 180.0, reference: Sequence[float] = (0, 0, 1),
) -> DataFrame:
    """The best score and rotation of every cell of the blocks' cores as one row of maps for each block (keys, ``MAPS``).

    The halo must hold half the template (one cell more for LCC), so cores are complete and tiles need no merging. Only the best
    map of a block is in memory beside the current rotation's; the first rotation wins ties; cells without a score over the
    threshold have rotation -1. ``float32`` halves time and memory. With ``group`` a block meets so many rotations at a time,
    in tasks of their own, so few blocks and many rotations still fill a cluster; maps, not rows, are then shuffled once and
    merged one after the other. ``bounds`` (or columns ``low`` and ``high``) tell where the volume ends; cells beyond are 0 to every
    score and have none themselves. ``keys`` tell volumes apart, each with its own statistics.

    ``seeds`` (keys, x, y, z, m0..m8): cells within ``radius`` of a seed alone are scored, by rotations that tilt ``reference`` by
    at most ``cone`` degrees from the seed's; blocks without seeds do no work.
    """
    if score not in DENSE:
        raise ValueError(f"scores are {', '.join(DENSE)}")
    if halo < max(template.shape) // 2 + (score == "LCC"):
        raise ValueError("the halo must hold half the template, and a cell more for LCC")
    keys = list(keys)
    if "low" not in blocks.columns:
        ends = [F.array(*[F.lit(int(b[i])) for b in bounds]) if bounds is not None else F.lit(None).cast("array<int>") for i in (0, 1)]
        blocks = blocks.withColumn("low", ends[0]).withColumn("high", ends[1])
    blocks = blocks.select(*keys, "start", "shape", "data", "low", "high")
    if score == "LCC":
        blocks = _laplacians(blocks, keys)
    stats = volume_stats(blocks, halo, keys)
    if keys:
        rows = join_small(blocks, cut(stats), keys)
    else:
        known = stats.first()
        rows = blocks.select("*", *[F.lit(float(known[c] or 0.0)).alias(c) for c in ("v_mean", "v_std", "v_peak")])
    shared = blocks.sparkSession.sparkContext.broadcast((np.asarray(template, float), np.asarray(mask, float), np.asarray(rotations, float), template_filter))
    if seeds is not None:
        rows = _seeded(rows, seeds, keys, halo, radius)
    parts = _parts(len(rotations), group)
    rows = rows.withColumn("__part", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in parts]))).select(*[c for c in rows.columns], "__part.a", "__part.b")
    if len(parts) > 1:
        # groups of a block are dealt to partitions in turn
        count = 4 * blocks.sparkSession.sparkContext.defaultParallelism
        rows = rows.repartitionById(count, F.pmod(F.xxhash64(*keys, "start") + F.expr(f"a div {group}"), F.lit(count)).cast("int"))
    kind = np.dtype(precision).type
    kinds = [f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys]
    tangent = float(np.tan(np.radians(min(cone, 89.999)))) if cone < 90 else None

    def maps(row: dict, peaks=None) -> Iterator[np.ndarray]:
        g, m, rots, keep = shared.value
        inside = _within(row["start"], row["shape"], row["low"], row["high"])
        return fft_scores(cells(row), g, m, rots[row["a"] : row["b"]], score, order, keep, halo, kind, inside, (row["v_mean"], row["v_std"], row["v_peak"]), peaks, True)

    if score == "MCC":
        # denominators and overlaps are judged by their largest over the whole volume: a first pass finds these
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, row in _rows(batches):
                found = list(maps(row, "ask"))
                r = np.arange(row["a"], row["b"])
                yield pa.RecordBatch.from_arrays([*[pa.array([row[k]] * len(r), batch.schema.field(k).type) for k in keys], pa.array(np.full(len(r), row["a"]), pa.int32()), pa.array(r, pa.int32()), *[pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]], names=[*keys, "a", "r", "below", "overlap"])

        asked = rows.mapInArrow(ask, ", ".join([*kinds, "a int", "r int", "below double", "overlap double"]))
        most = asked.groupBy(*keys, "a", "r").agg(F.max("below").alias("below"), F.max("overlap").alias("overlap"))
        most = cut(most.groupBy(*keys, "a").agg(F.sort_array(F.collect_list(F.struct("r", "below", "overlap"))).alias("peaks")))  # one entry a rotation of the group
        rows = join_small(rows, most, [*keys, "a"])
    asked_peaks, seeded = score == "MCC", seeds is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _rows(batches):
            core = [n - 2 * halo for n in row["shape"]]
            begin = [s + halo for s in row["start"]]
            best, which = np.full(core, threshold, kind), np.full(core, -1, np.int32)
            peaks = [(p["below"], p["overlap"]) for p in row["peaks"]] if asked_peaks else None
            inside = _within(begin, core, row["low"], row["high"])
            balls = _balls(row["seeds"], begin, core, radius) if seeded else None
            for r, s in enumerate(maps(row, peaks), row["a"]):
                better = s > best
                if seeded:
                    better &= _allowed(balls, shared.value[2][r], tangent, reference, core)
                best[better], which[better] = s[better], r
            if inside is not None:
                which[~inside] = -1
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([row[k]], batch.schema.field(k).type) for k in keys], pa.array([begin], pa.list_(pa.int32())), pa.array([core], pa.list_(pa.int32())), pa.array([best.tobytes()], pa.binary()), pa.array([which.tobytes()], pa.binary())],
                names=[*keys, "start", "shape", "scores", "best"],
            )

    schema = ", ".join([*kinds, MAPS])
    out = rows.mapInArrow(run, schema)
    if len(parts) == 1:
        return out

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row_type = None, None
        for batch, row in _rows(batches):
            row_type = batch.schema
            at = (*[row[k] for k in keys], *row["start"])
            s, r = np.frombuffer(row["scores"], kind), np.frombuffer(row["best"], np.int32)
            if held is not None and held[0] == at:
                # the higher score, of equal ones the earlier rotation
                better = (r >= 0) & ((held[3] < 0) | (s > held[2]) | (s == held[2]) & (r < held[3]))
                held[2][better], held[3][better] = s[better], r[better]
                continue
            if held is not None:
                yield _map_row(held, row_type)
            held = (at, row, s.copy(), r.copy())
        if held is not None:
            yield _map_row(held, row_type)

    return out.repartition(count, *keys, "start").sortWithinPartitions(*keys, "start").mapInArrow(merge, schema)


def _map_row(held: tuple, schema: pa.Schema) -> pa.RecordBatch:
    row = held[1] | {"scores": held[2].tobytes(), "best": held[3].tobytes()}
    return pa.RecordBatch.from_pylist([row], schema)


def _laplacians(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Laplacians of blocks: exact but for the outermost layer, which halos have to spare; 0 beyond the volume."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for row in batch.to_pylist():
                inside = _within(row["start"], row["shape"], row["low"], row["high"])
                data.append((laplacian(cells(row)) * (1.0 if inside is None else inside)).tobytes())
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))

    return blocks.mapInArrow(run, blocks.schema)


def _seeded(rows: DataFrame, seeds: DataFrame, keys: Sequence[str], halo: int, radius: float) -> DataFrame:
    """Blocks with the seeds whose balls meet their cores; blocks of one size are told by their place in the grid."""
    first = rows.select("shape", "start").first()
    if first is None:
        return rows.withColumn("seeds", F.lit(None).cast("array<struct<x:double>>"))
    edges = [n - 2 * halo for n in first["shape"]]
    origin = [(s + halo) % e for s, e in zip(first["start"], edges)]
    near = seeds
    for a, e, o in zip(AXES, edges, origin):
        tile = lambda c: F.floor((c - o) / e).cast("int")  # noqa: B023, E731
        near = near.withColumn(f"tile_{a}", F.explode(F.sequence(tile(F.col(a) - radius), tile(F.col(a) + radius))))
    numbers = F.struct(*[F.col(a).cast("double").alias(a) for a in AXES], *[F.col(f"m{i}").cast("double").alias(f"m{i}") for i in range(9)])
    by_block = near.groupBy(*keys, *[f"tile_{a}" for a in AXES]).agg(F.collect_set(numbers).alias("seeds"))
    for i, (a, e, o) in enumerate(zip(AXES, edges, origin)):
        rows = rows.withColumn(f"tile_{a}", F.floor((F.col("start")[i] + halo - o) / e).cast("int"))
    return rows.join(by_block, [*keys, *[f"tile_{a}" for a in AXES]]).drop(*[f"tile_{a}" for a in AXES])


def _balls(seeds: list[dict], begin: Sequence[int], core: Sequence[int], radius: float) -> list[tuple[tuple, np.ndarray, np.ndarray]]:
    """For each seed the part of the core around it, the cells there within the radius, and its rotation."""
    out = []
    for s in seeds:
        at = [s[a] - b for a, b in zip(AXES, begin)]
        low = [max(0, math.ceil(c - radius)) for c in at]
        high = [min(n, math.floor(c + radius) + 1) for c, n in zip(at, core)]
        if any(b <= a for a, b in zip(low, high)):
            continue
        sides = np.meshgrid(*[np.arange(a, b) - c for a, b, c in zip(low, high, at)], indexing="ij")
        out.append((tuple(slice(a, b) for a, b in zip(low, high)), sum(x**2 for x in sides) <= radius**2, np.array([s[f"m{i}"] for i in range(9)]).reshape(3, 3)))
    return out


def _allowed(balls: list, rotation: np.ndarray, tangent: float | None, reference: Sequence[float], core: Sequence[int]) -> np.ndarray:
    """Cells near a seed from which the rotation tilts the reference by no more than the cone."""
    out = np.zeros(core, bool)
    axis = rotation @ np.asarray(reference, float)
    for part, ball, own in balls:
        x, y, z = own.T @ axis
        if tangent is None or math.hypot(x, y) <= z * tangent + 1e-9:
            out[part] |= ball
    return out


def best_rows(maps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each scored cell of best maps: keys, tx, ty, tz, s, r. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row in _rows(batches):
            which = np.frombuffer(row["best"], np.int32).reshape(row["shape"])
            best = np.frombuffer(row["scores"], f"f{len(row['scores']) // max(which.size, 1) or 8}").reshape(row["shape"])
            at = np.nonzero(which >= 0)
            own = [pa.array([row[k]], batch.schema.field(k).type).take(pa.array(np.zeros(len(at[0]), np.int64))) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*own, *[pa.array((i + s).astype(np.int32)) for i, s in zip(at, row["start"])], pa.array(best[at].astype(np.float64)), pa.array(which[at])], names=[*keys, "tx", "ty", "tz", "s", "r"]
            )

    kinds = [f"`{k}` {maps.schema[k].dataType.simpleString()}" for k in keys]
    return maps.select(*keys, "start", "shape", "scores", "best").mapInArrow(run, ", ".join([*kinds, "tx int, ty int, tz int, s double, r int"]))


def match_blocks(blocks: DataFrame, template: np.ndarray, mask: np.ndarray, rotations: np.ndarray, halo: int, *args, **options) -> DataFrame:
    """Best score and rotation of every voxel of the blocks' cores as rows (tx, ty, tz, s, r), see :func:`best_blocks`."""
    keys = options.get("keys", ())
    return best_rows(best_blocks(blocks, template, mask, rotations, halo, *args, **options), keys)


def filter_blocks(blocks: DataFrame, mask: np.ndarray) -> DataFrame:
    """Multiply the spectrum of every block by a filter of its shape."""
    shared = blocks.sparkSession.sparkContext.broadcast(np.asarray(mask, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [apply(cells(r), shared.value).tobytes() for r in batch.to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))

    return blocks.mapInArrow(run, blocks.schema)


#: Arrays of :class:`Block` and of one rotation by score: spectra of fields, kernels' spectra, and real maps held at once.
HELD = {"CC": (1, 1, 1), "LCC": (1, 1, 1), "CORR": (2, 2, 4), "CAM": (2, 2, 4), "FLC": (3, 2, 5), "FLCSphericalMask": (3, 1, 4), "MCC": (3, 3, 9)}


def memory_bytes(target: Sequence[int], template: Sequence[int], score: str, cores: int = 1, cell: int = 8) -> int:
    """Bytes that a block takes in each of ``cores`` tasks: the target in double precision with its fields, spectra of the padded
    shape (kernels' with one product beside them), real maps, and the best map with its rotations."""
    if score not in DENSE:
        raise ValueError(f"scores are {', '.join(DENSE)}")
    spectra, kernels, maps = HELD[score.replace("batchFLCSpherical", "FLCSphericalMask").replace("batchFLC", "FLC")]
    shape = [fast_length(a + b - 1) for a, b in zip(target, template)]
    half = 2 * cell * math.prod([*shape[:-1], shape[-1] // 2 + 1])
    return cores * (4 * 8 * math.prod(target) + (spectra + kernels + 1) * half + maps * cell * math.prod(target) + (cell + 4) * math.prod(target))


#: Transforms that a block costs before its first rotation, and that merging a group's maps costs, in rotations of the same cells.
SETUP, MERGING = 8, 2


def plan_work(shape: Sequence[int], template: Sequence[int], score: str, memory: int, cell: int = 8, rotations: int = 1, tasks: int = 1, volumes: int = 1) -> tuple[int, int]:
    """The edge of cubic cores and the number of groups of rotations that finish first.

    Blocks have halos of half the template, sizes that are transformed fast, and fit into a task's ``memory``. Large
    blocks waste less on halos; small ones and groups fill the ``tasks`` of a cluster, but each group sets its blocks up anew and has
    its maps merged. All edges and powers of two of groups are weighed by the cells that the busiest task transforms.
    """
    halo = max(template) // 2 + (score == "LCC")
    best = None
    for size in range(2 * halo + 1, max(shape) + 2 * halo + 32):
        if memory_bytes([size] * len(shape), [1] * len(shape), score, 1, cell) > memory:
            break
        if fast_length(size) != size:
            continue
        edge = min(size - 2 * halo, max(shape))
        blocks = volumes * math.prod(-(-n // edge) for n in shape)
        groups = 1
        while groups <= rotations:
            each = -(-rotations // groups)
            cost = -(-blocks * groups // tasks) * size ** len(shape) * math.log2(size) * (SETUP + each + MERGING * (groups > 1))
            if best is None or cost < best[0]:
                best = (cost, edge, groups)
            groups *= 2
        if size - 2 * halo >= max(shape):
            break
    if best is None:
        raise ValueError("not even a block of the template's size fits")
    return best[1], best[2]


def plan_tiles(shape: Sequence[int], template: Sequence[int], score: str, memory: int, cores: int = 1) -> tuple[int, ...]:
    """Splits of each axis, doubling the longest tile's axis until a tile fits into the memory."""
    splits = [1] * len(shape)
    while memory_bytes([-(-n // k) for n, k in zip(shape, splits)], template, score, cores) > memory:
        tile = [-(-n // k) for n, k in zip(shape, splits)]
        if max(tile) <= max(template):
            raise ValueError("not even a tile of the template's size fits")
        splits[tile.index(max(tile))] *= 2
    return tuple(splits)


def choose_path(voxels: int, points: int, rotations: int, cells: int) -> str:
    """``sparse`` joins or ``dense`` FFT blocks, by the rows of the one and the butterflies of the other."""
    return "sparse" if voxels * points * rotations < 4 * cells * math.log2(max(cells, 2)) * rotations else "dense"
