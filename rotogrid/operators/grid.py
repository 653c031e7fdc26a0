"""Volumes as sparse voxel tables: rasterising, boxes, tiles, and conversion to dense blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
Bounds = Sequence[tuple[int, int]]  # first and last index of each axis


def rasterize(rows: DataFrame, x: Column, y: Column, z: Column, weight: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of weights (or number of rows) per voxel; one partial aggregation, no dense grid."""
    value = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight.cast("double"))
    return rows.groupBy(*keys, x.cast("int").alias("x"), y.cast("int").alias("y"), z.cast("int").alias("z")).agg(value.alias("v"))


def inside(bounds: Bounds, names: Sequence[str] = AXES) -> Column:
    condition = F.lit(True)
    for (low, high), name in zip(bounds, names):
        condition = condition & F.col(name).between(low, high)
    return condition


def dense_grid(spark, bounds: Bounds) -> DataFrame:
    """Every voxel of the bounds; rows are generated by nested explodes, nothing is shuffled."""
    (a, b), (c, d), (e, f) = bounds
    return (
        spark.range(a, b + 1).select(F.col("id").cast("int").alias("x"))
        .select("x", F.explode(F.sequence(F.lit(c), F.lit(d))).alias("y"))
        .select("x", "y", F.explode(F.sequence(F.lit(e), F.lit(f))).alias("z"))
    )


def densify(voxels: DataFrame, bounds: Bounds) -> DataFrame:
    """All voxels of the bounds, absent ones as 0."""
    return dense_grid(voxels.sparkSession, bounds).join(voxels.select(*AXES, "v"), list(AXES), "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def point_cloud(voxels: DataFrame, threshold: float = 0.0) -> DataFrame:
    return voxels.where(F.col("v") > threshold).select(*AXES)


def crop(voxels: DataFrame, bounds: Bounds) -> DataFrame:
    """The voxels within bounds, renumbered from 0; indices beyond the volume stay empty."""
    return voxels.where(inside(bounds)).select(*[(F.col(n) - low).alias(n) for n, (low, _) in zip(AXES, bounds)], "v")


def pad(voxels: DataFrame, shape: Sequence[int], new_shape: Sequence[int], center: bool = True) -> DataFrame:
    """Shift into a larger (or smaller) box, centred or at the top left."""
    shift = [(n - o) // 2 if center else 0 for o, n in zip(shape, new_shape)]
    moved = voxels.select(*[(F.col(a) + s).alias(a) for a, s in zip(AXES, shift)], "v")
    return moved.where(inside([(0, n - 1) for n in new_shape]))


def trim_bounds(voxels: DataFrame, cutoff: float, margin: int = 0, bounds: Bounds | None = None) -> DataFrame:
    """Tightest bounds of the voxels above the cutoff, widened by the margin within the volume; no row if none is above."""
    out = voxels.where(F.col("v") > cutoff).agg(*[f(n).alias(f"{p}_{n}") for n in AXES for f, p in ((F.min, "low"), (F.max, "high"))])
    limits = bounds or [(None, None)] * 3
    columns = []
    for n, (a, b) in zip(AXES, limits):
        low, high = F.col(f"low_{n}") - margin, F.col(f"high_{n}") + margin
        columns += [(low if a is None else F.greatest(low, F.lit(a))).alias(f"low_{n}"), (high if b is None else F.least(high, F.lit(b))).alias(f"high_{n}")]
    return out.where(F.col("low_x").isNotNull()).select(*columns)


def enclosing_edge(voxels: DataFrame, cutoff: float) -> DataFrame:
    """Edge of a cube that holds the thresholded cloud in any rotation about its mean: ceil(2 max distance) + 1."""
    cloud = point_cloud(voxels, cutoff)
    mean = cloud.agg(F.struct(*[F.avg(n).alias(n) for n in AXES]).alias("m")).scalar()
    distance = sum((F.col(n) - F.col("m").getField(n)) ** 2 for n in AXES)
    return cloud.withColumn("m", mean).agg((F.ceil(2 * F.sqrt(F.max(distance))) + 1).cast("bigint").alias("edge"))


def boundary_levels(voxels: DataFrame, count: int, fraction: float = 0.1) -> DataFrame:
    """The count-th and the count * (1 + fraction)-th largest value: a threshold pair for an expected volume.
    Null where there aren't as many voxels."""
    from rotogrid.operators.order import order_statistics

    n = voxels.count()
    upper, lower = order_statistics(voxels, "v", [n - count, n - int(count * (1 + fraction))])
    return voxels.sparkSession.createDataFrame([(upper, lower)], "upper double, lower double")


def convolution_bounds(shape: Sequence[int], template: Sequence[int], mode: str) -> list[tuple[int, int]]:
    """Bounds of score translations, the template's centre being its index size // 2, in target coordinates."""
    if mode == "full":
        return [(-(m - 1 - m // 2), n - 1 + m // 2) for n, m in zip(shape, template)]
    if mode == "same":
        return [(0, n - 1) for n in shape]
    if mode == "valid":
        return [(m // 2, n - 1 - (m - 1 - m // 2)) for n, m in zip(shape, template)]
    raise ValueError("mode is full, same or valid")


def roll(voxels: DataFrame, shift: Sequence[int], shape: Sequence[int]) -> DataFrame:
    return voxels.select(*[F.pmod(F.col(a) + s, F.lit(n)).cast("int").alias(a) for a, s, n in zip(AXES, shift, shape)], "v")


def rot90(voxels: DataFrame, bounds: Bounds, times: int = 1, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Quarter turns in the plane of two axes, the first towards the second; the box turns with its voxels and begins where it did."""
    a, b = axes
    (la, ha), (lb, hb) = (bounds[AXES.index(c)] for c in axes)
    out = voxels
    for _ in range(times % 4):
        # (a, b) -> (size of b - 1 - b, a)
        out = out.withColumns({a: (F.lit(hb) - F.col(b) + la).cast("int"), b: (F.col(a) - la + lb).cast("int")})
        (la, ha), (lb, hb) = (la, la + hb - lb), (lb, lb + ha - la)
    return out


def bin_voxels(voxels: DataFrame, factor: int) -> DataFrame:
    """Coarser voxels as sums over cubes of ``factor``."""
    return voxels.groupBy(*[F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]).agg(F.sum("v").alias("v"))


def extraction_boxes(picks: DataFrame, shape: Sequence[int], box: Sequence[int]) -> DataFrame:
    """Crop box of each pick, clamped to the volume, and whether it was whole."""
    out, keep = picks, F.lit(True)
    for a, n, b in zip(AXES, shape, box):
        center = F.col(a).cast("int")
        start, stop = center - b // 2, center + b // 2 + b % 2
        out = out.withColumn(f"start_{a}", F.greatest(start, F.lit(0))).withColumn(f"stop_{a}", F.least(stop, F.lit(n)))
        keep = keep & (start >= 0) & (stop <= n)
    return out.withColumn("whole", keep)


def tiles(shape: Sequence[int], splits: Sequence[int], equal: bool = True) -> list[list[tuple[int, int]]]:
    """Slices (start, stop) of every tile. Equal tiles have one shape, the last reaching back over its neighbour."""
    axes = []
    for n, k in zip(shape, splits):
        size = -(-n // k)
        cuts = [(min(i * size, n - size), min(i * size, n - size) + size) if equal else (i * size, min((i + 1) * size, n)) for i in range(k)]
        axes.append([c for c in dict.fromkeys(cuts) if c[1] > c[0]])
    return [list(t) for t in product(*axes)]


def assign_tiles(voxels: DataFrame, edge: Sequence[int], halo: Sequence[int], origin: Sequence[int] = (0, 0, 0)) -> DataFrame:
    """Each voxel once for every tile of ``edge`` whose core or halo holds it, with tile numbers tile_x, tile_y, tile_z.

    Tiles are numbered by arithmetic, so only voxels near a face are repeated and no tile table is joined.
    """
    out = voxels
    for a, e, h, o in zip(AXES, edge, halo, origin):
        at = F.col(a) - o
        out = out.withColumn(f"tile_{a}", F.explode(F.sequence(F.floor((at - h) / e), F.floor((at + h) / e)))).withColumn(f"tile_{a}", F.col(f"tile_{a}").cast("int"))
    return out


BLOCK_SCHEMA = "block_id string, start array<int>, shape array<int>, data binary"


def to_blocks(voxels: DataFrame, edge: int, halo: int = 0, origin: Sequence[int] = (0, 0, 0), keys: Sequence[str] = ()) -> DataFrame:
    """Dense float64 tiles of edge + 2 halo, of each volume told by ``keys``. A task holds one tile at a time, of fixed size whatever the volume."""
    keys = list(keys)

    def build(key, pdf):
        size = edge + 2 * halo
        tile = key[len(keys) :]
        start = [int(k) * edge + o - halo for k, o in zip(tile, origin)]
        data = np.zeros((size,) * 3)
        np.add.at(data, tuple(pdf[a].to_numpy() - s for a, s in zip(AXES, start)), pdf["v"].to_numpy())
        import pandas as pd

        return pd.DataFrame([(*key[: len(keys)], "_".join(str(k) for k in tile), start, [size] * 3, data.tobytes())], columns=[*keys, "block_id", "start", "shape", "data"])

    schema = ", ".join([*[f"`{k}` {voxels.schema[k].dataType.simpleString()}" for k in keys], BLOCK_SCHEMA])
    return assign_tiles(voxels, (edge,) * 3, (halo,) * 3, origin).groupBy(*keys, "tile_x", "tile_y", "tile_z").applyInPandas(build, schema)


def from_blocks(blocks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The non-zero voxels of blocks without halo: keys, x, y, z, v."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                data = np.frombuffer(row["data"], f"f{len(row['data']) // max(math.prod(row['shape']), 1) or 8}").reshape(row["shape"]).astype(float)
                at = np.nonzero(data)
                own = [batch.column(k).take(pa.array(np.full(len(at[0]), i))) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array((i + s).astype(np.int32)) for i, s in zip(at, row["start"])], pa.array(data[at])], names=[*keys, *AXES, "v"])

    kinds = [f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys]
    return blocks.mapInArrow(run, ", ".join([*kinds, "x int, y int, z int, v double"]))


def wrap_faces(voxels: DataFrame, bounds: Bounds, width: int = 1) -> DataFrame:
    """The voxels with those near each face repeated beyond the opposite one, as a volume that wraps has them."""
    out = voxels
    for a, (low, high) in zip(AXES, bounds):
        n = high - low + 1
        for part, shift in ((F.col(a) < low + width, n), (F.col(a) > high - width, -n)):
            out = out.unionByName(voxels.where(part).withColumn(a, (F.col(a) + shift).cast("int")))
    return out


def retile(blocks: DataFrame, edge: int, halo: int, keys: Sequence[str] = (), wrap: int = 0, precision: str = "float64", parts: int | None = None) -> DataFrame:
    """Dense blocks of edge + 2 halo from stored ones without halo (keys, start, shape, volume, data), beginning at 0.

    Every stored block is cut into the slabs that the new blocks want of it, and slabs of bytes are shuffled once, so the cost
    is the volume and its halos, not a row for each voxel. Cells beyond the volume are 0, but for ``wrap`` layers that
    come from the opposite face. ``low`` and ``high`` tell where the volume ends. A task holds one block at a time. Blocks are
    dealt to ``parts`` partitions (four times the cluster's tasks by default) in turn, as the work that follows is by block, not by byte.
    """
    keys = list(keys)
    kinds = [f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys]
    slab = "tile array<int>, volume array<int>, at array<int>, size array<int>, data binary"
    kind = np.dtype(precision)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                cells = math.prod(row["shape"])
                data = np.frombuffer(row["data"], f"f{len(row['data']) // max(cells, 1) or 8}").reshape(row["shape"])
                found = []
                # the block itself, and its layers at a face as they wrap
                turns = [[(0, s, s + n)] + ([(v, s, min(wrap, s + n)), (-v, max(v - wrap, s), s + n)] if wrap else []) for s, n, v in zip(row["start"], row["shape"], row["volume"])]
                for turn in product(*turns):
                    if sum(t[0] != 0 for t in turn) > 1 or any(b <= a for _, a, b in turn):
                        continue
                    begin, stop = [a + t for t, a, _ in turn], [b + t for t, _, b in turn]
                    last = [-(-v // edge) - 1 for v in row["volume"]]
                    for tile in product(*[range(max(0, (a - halo) // edge), min((b - 1 + halo) // edge, m) + 1) for a, b, m in zip(begin, stop, last)]):
                        low = [max(a, k * edge - halo) for a, k in zip(begin, tile)]
                        high = [min(b, (k + 1) * edge + halo) for b, k in zip(stop, tile)]
                        if any(b <= a for a, b in zip(low, high)):
                            continue
                        part = data[tuple(slice(a - t[0] - s, b - t[0] - s) for a, b, t, s in zip(low, high, turn, row["start"]))]
                        found.append((list(tile), [a - k * edge + halo for a, k in zip(low, tile)], list(part.shape), part.astype(kind).tobytes()))
                if found:
                    tiles, at, sizes, parts = zip(*found)
                    ints = pa.list_(pa.int32())
                    own = [pa.array([row[k]] * len(found), batch.schema.field(k).type) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(tiles, ints), pa.array([row["volume"]] * len(found), ints), pa.array(at, ints), pa.array(sizes, ints), pa.array(parts, pa.binary())], names=[*keys, "tile", "volume", "at", "size", "data"])

    schema = ", ".join([*kinds, BLOCK_SCHEMA, "low array<int>, high array<int>"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done():
            head, data = held
            tile, volume = head["tile"], head["volume"]
            row = {k: head[k] for k in keys} | {"block_id": "_".join(map(str, tile)), "start": [k * edge - halo for k in tile], "shape": list(data.shape), "data": data.tobytes(), "low": [0] * len(tile), "high": [n - 1 for n in volume]}
            ints = pa.list_(pa.int32())
            types = {"block_id": pa.string(), "start": ints, "shape": ints, "data": pa.binary(), "low": ints, "high": ints}
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(k) or field(k)) for k, v in row.items()], names=list(row))

        for batch in batches:
            field = lambda k: batch.schema.field(k).type  # noqa: B023, E731
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held is None or any(held[0][k] != row[k] for k in (*keys, "tile")):
                    if held is not None:
                        yield done()
                    held = (row, np.zeros([edge + 2 * halo] * len(row["tile"]), kind))
                part = np.frombuffer(row["data"], kind).reshape(row["size"])
                held[1][tuple(slice(a, a + n) for a, n in zip(row["at"], row["size"]))] = part
        if held is not None:
            yield done()

    slabs = blocks.select(*keys, "start", "shape", "volume", "data").mapInArrow(split, ", ".join([*kinds, slab]))
    parts = parts or 4 * blocks.sparkSession.sparkContext.defaultParallelism
    across = [F.ceil(F.col("volume")[i] / edge) for i in range(3)]
    number = (F.col("tile")[0] * across[1] + F.col("tile")[1]) * across[2] + F.col("tile")[2]
    turn = F.pmod(number + (F.hash(*keys).cast("bigint") if keys else F.lit(0)), F.lit(parts)).cast("int")
    return slabs.repartitionById(parts, turn).sortWithinPartitions(*keys, "tile").mapInArrow(build, schema)


#: Points that may end a diameter and are compared on the driver; more are compared by pairs of cells.
MOST_ENDS = 50_000
#: Cells of the grid of ends along the diameter found so far.
END_CELLS = 12


def diameter(points: DataFrame, most: int = MOST_ENDS) -> tuple[float, tuple, tuple] | None:
    """The largest distance between two points and its ends, exactly and without forming all pairs; None for no point.

    Walking from farthest point to farthest point gives a lower bound L. With R the largest distance from a centre, a
    point nearer to it than L - R can't be an end. Up to ``most`` others are compared block by block on the driver; more (a
    cloud like a sphere's surface) are put into cells of L / ``END_CELLS``, of which the driver sees the numbers, and only points of
    cells that lie as far apart as L meet, a pair of cells at a time.
    """
    xyz = points.select(*AXES).distinct()
    middle = xyz.agg(*[((F.min(a) + F.max(a)) / 2).alias(a) for a in AXES]).first()
    if middle.x is None:
        return None

    def distance(p):
        return F.sqrt(sum((F.col(a) - float(p[i])) ** 2 for i, a in enumerate(AXES)))

    def farthest(p):
        return xyz.agg(F.max(F.struct(distance(p).alias("d"), *AXES)).alias("m")).first().m

    radius = farthest(middle).d
    at, low, ends = farthest(middle), 0.0, None
    for _ in range(4):
        other = farthest((at.x, at.y, at.z))
        if ends is None or other.d > low:
            ends = ((at.x, at.y, at.z), (other.x, other.y, other.z))
        if other.d <= low:
            break
        low, at = other.d, other
    left = xyz.where(distance(middle) >= low - radius - 1e-9)
    rows = left.limit(most + 1).toPandas().to_numpy(float)
    if len(rows) > most:
        return _by_cells(left, low, ends)
    rows = rows[np.lexsort(rows.T[::-1])]
    best = (0.0, tuple(rows[0]), tuple(rows[0]))
    for k in range(0, len(rows), 256):
        d = np.sqrt(((rows[k : k + 256, None] - rows[None]) ** 2).sum(-1))
        i, j = np.unravel_index(d.argmax(), d.shape)
        if d[i, j] > best[0]:
            best = (float(d[i, j]), tuple(rows[k + i]), tuple(rows[j]))
    return best


def _by_cells(points: DataFrame, low: float, ends: tuple) -> tuple[float, tuple, tuple]:
    """The farthest pair of points at least ``low`` apart, ``ends`` being such a pair."""
    edge = low / END_CELLS if low > 0 else 1.0
    celled = points.select(*AXES, *[F.floor(F.col(a) / edge).alias(f"c{a}") for a in AXES])
    cells = np.array(sorted(tuple(r) for r in celled.select("cx", "cy", "cz").distinct().collect()), np.int64)  # a few thousand for any cloud
    found = []
    for i in range(len(cells)):
        # the farthest that points of two cells can be apart
        reach = np.sqrt(((np.abs(cells[i:] - cells[i]) + 1) ** 2).sum(1)) * edge
        found += [(i, int(j) + i) for j in np.flatnonzero(reach >= low - 1e-9)]
    spark = points.sparkSession
    number = spark.createDataFrame([(*map(int, c), i) for i, c in enumerate(cells)], "cx bigint, cy bigint, cz bigint, cell int")
    pairs = spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate(found)], "pair int, a int, b int")
    own = celled.join(number, ["cx", "cy", "cz"]).select("cell", *AXES)
    sides = [own.join(pairs.select("pair", F.col(c).alias("cell")), "cell").select("pair", F.lit(c).alias("side"), *AXES) for c in ("a", "b")]

    def run(pdf):
        import pandas as pd

        a, b = (pdf.loc[pdf["side"] == c, list(AXES)].to_numpy(float) for c in ("a", "b"))
        best = (-1.0, 0, 0)
        for k in range(0, len(a), 1024):
            d = np.sqrt(((a[k : k + 1024, None] - b[None]) ** 2).sum(-1))
            i, j = np.unravel_index(d.argmax(), d.shape)
            if d[i, j] > best[0]:
                best = (float(d[i, j]), k + i, j)
        return pd.DataFrame([(best[0], *a[best[1]], *b[best[2]])], columns=["d", "ax", "ay", "az", "bx", "by", "bz"])

    far = sides[0].unionByName(sides[1]).groupBy("pair").applyInPandas(run, "d double, ax double, ay double, az double, bx double, by double, bz double")
    top = far.agg(F.max(F.struct("d", "ax", "ay", "az", "bx", "by", "bz")).alias("m")).first().m
    if top is None or top.d < low:
        return low, *ends
    return top.d, (top.ax, top.ay, top.az), (top.bx, top.by, top.bz)


def least_deviations(points: np.ndarray) -> np.ndarray:
    """Matrix of min over axes of the absolute differences of all pairs of a small set of points."""
    points = np.asarray(points, float)
    return np.abs(points[:, None] - points[None]).min(-1)
