"""Volume files (MRC and EM, plain or gzipped, and TIFF stacks) as dense blocks."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: MRC modes and EM type codes, as fixed by the formats.
MRC_MODES = {0: "i1", 1: "i2", 2: "f4", 4: "c8", 6: "u2", 12: "f2"}
EM_TYPES = {1: "i1", 2: "i2", 4: "i4", 5: "f4", 8: "c8", 9: "f8"}
SCHEMA = "path string, shape array<int>, origin array<double>, rate array<double>, low double, high double, mean double, block_id string, start array<int>, block_shape array<int>, data binary"
TYPES = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())


def is_gzipped(content: bytes) -> bool:
    return content[:2] == b"\x1f\x8b"


def read_mrc(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Array in x, y, z order, origin and voxel size."""
    if len(content) < 1024:
        raise ValueError("an MRC header has 1024 bytes")
    order = ">" if content[212:214] == b"\x11\x11" else "<"
    nx, ny, nz, mode, *start = struct.unpack_from(f"{order}7i", content, 0)
    grid = struct.unpack_from(f"{order}3i", content, 28)
    cell = struct.unpack_from(f"{order}3f", content, 40)
    axes = [a - 1 for a in struct.unpack_from(f"{order}3i", content, 64)]
    extended = struct.unpack_from(f"{order}i", content, 92)[0]
    origin = np.array(struct.unpack_from(f"{order}3f", content, 196), float)
    if mode not in MRC_MODES or min(nx, ny, nz) < 1:
        raise ValueError(f"MRC mode {mode} or shape ({nx}, {ny}, {nz}) isn't supported")
    if sorted(axes) != [0, 1, 2]:
        axes = [0, 1, 2]
    data = np.frombuffer(content, np.dtype(MRC_MODES[mode]).newbyteorder(order), nx * ny * nz, 1024 + extended).reshape(nz, ny, nx)
    data = np.transpose(data.transpose(2, 1, 0), np.argsort(axes))
    rate = np.array([c / g if g else 1.0 for c, g in zip(cell, grid)])
    rate[rate == 0] = 1.0
    if not origin.any():
        origin = np.array(start, float)[np.argsort(axes)] * rate
    return data, origin, rate


def write_mrc(data: np.ndarray, origin: Sequence[float] = (0, 0, 0), rate: Sequence[float] = (1, 1, 1), compress: bool = False) -> bytes:
    data = np.asarray(data)
    mode = {"int8": 0, "int16": 1, "float32": 2, "complex64": 4, "uint16": 6, "float16": 12}.get(data.dtype.name)
    if mode is None:
        data, mode = data.astype(np.float32), 2
    header = bytearray(1024)
    real = np.abs(data) if mode == 4 else data
    struct.pack_into("<10i", header, 0, *data.shape, mode, *np.rint(np.array(origin) / rate).astype(int), *data.shape)
    struct.pack_into("<6f", header, 40, *(n * r for n, r in zip(data.shape, rate)), 90, 90, 90)
    struct.pack_into("<3i3f", header, 64, 1, 2, 3, *((float(real.min()), float(real.max()), float(real.mean())) if data.size else (0, 0, 0)))
    struct.pack_into("<3f", header, 196, *origin)
    header[208:212], header[212:216] = b"MAP ", b"DD\x00\x00"
    body = bytes(header) + np.ascontiguousarray(data.transpose(2, 1, 0)).tobytes()
    return gzip.compress(body) if compress else body


def read_em(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Array in x, y, z order; the voxel size is user parameter 6 in thousandths, 1 if it is 0."""
    if len(content) < 512:
        raise ValueError("an EM header has 512 bytes")
    order = ">" if content[0] in (0, 5) and content[3] not in EM_TYPES else "<"
    code = content[3]
    nx, ny, nz = struct.unpack_from(f"{order}3i", content, 4)
    size = struct.unpack_from(f"{order}i", content, 96 + 5 * 4)[0] / 1000
    if code not in EM_TYPES:
        raise ValueError(f"EM type {code} isn't supported")
    data = np.frombuffer(content, np.dtype(EM_TYPES[code]).newbyteorder(order), nx * ny * nz, 512).reshape(nz, ny, nx).transpose(2, 1, 0)
    return data, np.zeros(3), np.full(3, size or 1.0)


def write_em(data: np.ndarray, rate: float = 1.0, compress: bool = False) -> bytes:
    data = np.asarray(data)
    code = {"int8": 1, "int16": 2, "int32": 4, "float32": 5, "complex64": 8, "float64": 9}.get(data.dtype.name)
    if code is None:
        data, code = data.astype(np.float32), 5
    header = bytearray(512)
    header[0], header[3] = 6, code
    struct.pack_into("<3i", header, 4, *data.shape)
    struct.pack_into("<i", header, 96 + 5 * 4, int(round(rate * 1000)))
    body = bytes(header) + np.ascontiguousarray(data.transpose(2, 1, 0)).tobytes()
    return gzip.compress(body) if compress else body


#: TIFF field types' sizes and codes, as fixed by the format: bytes, shorts and longs.
TIFF_TYPES = {1: "B", 3: "H", 4: "I"}
TIFF_FORMATS = {1: "u", 2: "i", 3: "f"}


def read_tiff(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Uncompressed grey images in strips; the pages of a file, one shape, are the z axis. No voxel size."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack_from(f"{order}H", content, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(f"{order}I", content, 4)[0]
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack_from(f"{order}H", content, at)[0]
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(f"{order}HHI", content, at + 2 + 12 * i)
            if kind in TIFF_TYPES:
                size = struct.calcsize(TIFF_TYPES[kind]) * n
                place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(f"{order}I", content, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{order}{n}{TIFF_TYPES[kind]}", content, place)
        if tags.get(259, (1,))[0] != 1 or tags.get(277, (1,))[0] != 1:
            raise ValueError("only uncompressed TIFF files of one channel are read")
        width, height, bits, form = (tags.get(k, (d,))[0] for k, d in ((256, 0), (257, 0), (258, 1), (339, 1)))
        if bits not in (8, 16, 32, 64) or form not in TIFF_FORMATS:
            raise ValueError(f"TIFF cells of {bits} bits and format {form} aren't supported")
        data = b"".join(content[o : o + n] for o, n in zip(tags[273], tags[279]))
        pages.append(np.frombuffer(data, np.dtype(f"{TIFF_FORMATS[form]}{bits // 8}").newbyteorder(order), width * height).reshape(height, width))
        at = struct.unpack_from(f"{order}I", content, at + 2 + 12 * count)[0]
    if not pages or len({p.shape for p in pages}) > 1:
        raise ValueError("a TIFF stack needs pages of one shape")
    return np.stack(pages).transpose(2, 1, 0), np.zeros(3), np.ones(3)


def write_tiff(data: np.ndarray) -> bytes:
    """Pages of an array (x, y, z) in single precision, one strip each."""
    data = np.asarray(data, np.float32)
    data = data[:, :, None] if data.ndim == 2 else data
    width, height, depth = data.shape
    size = width * height * 4
    entries = 9
    length = 2 + 12 * entries + 4
    out = [b"II", struct.pack("<HI", 42, 8)]
    for z in range(depth):
        begin = 8 + z * (length + size)
        fields = ((256, width), (257, height), (258, 32), (259, 1), (262, 1), (273, begin + length), (277, 1), (279, size), (339, 3))
        out += [struct.pack("<H", entries), *(struct.pack("<HHII", tag, 4, 1, v) for tag, v in fields), struct.pack("<I", begin + length + size if z + 1 < depth else 0), data[:, :, z].T.tobytes()]
    return b"".join(out)


def read(content: bytes, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if is_gzipped(content):
        content, name = gzip.decompress(content), name.removesuffix(".gz")
    if name.endswith((".h5", ".hdf5")):
        raise NotImplementedError("HDF5 needs h5py, which this library doesn't ask for")
    if name.endswith((".tif", ".tiff")):
        return read_tiff(content)
    return read_em(content) if name.endswith(".em") else read_mrc(content)


def validate_subset(bounds: Sequence[tuple[int, int]], shape: Sequence[int]) -> None:
    if len(bounds) != len(shape):
        raise ValueError("as many bounds as axes")
    for (a, b), n in zip(bounds, shape):
        if a < 0 or b < a or b > n:
            raise ValueError(f"{(a, b)} isn't within an axis of {n}")


def read_volumes(spark: SparkSession, path: str, edge: int = 128, subset: Sequence[tuple[int, int]] | None = None, errors: bool = False) -> DataFrame:
    """Every volume under a path, see :func:`parse_volumes`. A file is one row of the binary source and so limited to 2 GB."""
    return parse_volumes(spark.read.format("binaryFile").load(path), edge, subset, errors)


def parse_volumes(files: DataFrame, edge: int = 128, subset: Sequence[tuple[int, int]] | None = None, errors: bool = False) -> DataFrame:
    """Volumes of whole files (path, content) in blocks of ``edge`` (columns ``SCHEMA``), with header and statistics; ``subset`` is a box
    whose first voxel becomes 0. With ``errors`` a file that can't be read gives one row whose ``block_id`` is the reason and whose
    data are null. Blocks of a file are emitted one at a time. Volumes are best written to Parquet once: block_id and start
    then prune what a query reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    data, origin, rate = read(content, name)
                except (ValueError, NotImplementedError, OSError, EOFError, struct.error) as e:
                    if not errors:
                        raise
                    schema = pa.schema([(c.split()[0], t) for c, t in zip(SCHEMA.split(", "), TYPES)])
                    yield pa.RecordBatch.from_pylist([{"path": name, "block_id": f"error: {e}"}], schema)
                    continue
                low = [0] * data.ndim
                if subset is not None:
                    validate_subset(subset, data.shape)
                    data, low = data[tuple(slice(a, b) for a, b in subset)], [a for a, _ in subset]
                    origin = origin + np.array(low) * rate
                real = np.abs(data) if np.iscomplexobj(data) else data.astype(float)
                head = [name, list(data.shape), origin.tolist(), rate.tolist(), *(float(f()) if real.size else None for f in (real.min, real.max, real.mean))]
                for k in np.ndindex(*[-(-n // edge) for n in data.shape]):
                    part = real[tuple(slice(i * edge, (i + 1) * edge) for i in k)]
                    rows = [[h] for h in (*head, "_".join(map(str, k)), [i * edge for i in k], list(part.shape), np.ascontiguousarray(part).tobytes())]
                    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, TYPES)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def write_volume(blocks: DataFrame, path: str, shape: Sequence[int], origin: Sequence[float] = (0, 0, 0), rate: Sequence[float] = (1, 1, 1)) -> None:
    """Put blocks (start, block_shape, data) together into one MRC, EM or TIFF file by suffix, by the file system of the path. One file
    is put together by the driver, block by block; whole collections are best kept as Parquet."""
    from rotogrid.sources.files import write_parts

    out = np.zeros(tuple(shape), np.float32)
    for row in blocks.select("start", "block_shape", "data").toLocalIterator():
        n = int(np.prod(row.block_shape))
        part = np.frombuffer(row.data, f"f{len(row.data) // max(n, 1) or 8}").reshape(row.block_shape)
        out[tuple(slice(s, s + n) for s, n in zip(row.start, row.block_shape))] = part
    compress = path.endswith(".gz")
    name = path.removesuffix(".gz")
    write_parts(blocks.sparkSession, path, [write_em(out, rate[0], compress) if name.endswith(".em") else write_tiff(out) if name.endswith((".tif", ".tiff")) else write_mrc(out, origin, rate, compress)])
