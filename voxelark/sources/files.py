"""Plain point files, grids, transforms and images."""

from __future__ import annotations

import shutil
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import folder
from .ply import store

POINT = ("x", "y", "z", "nx", "ny", "nz")


def read_ascii(spark: SparkSession, path: str, columns: Sequence[str] = POINT) -> DataFrame:
    """White-space separated numbers, a point a line; a line of fewer numbers is an error."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).filter("size(t) > 1 OR t[0] <> ''")
    t = t.withColumn("t", F.when(F.size("t") >= len(columns), F.col("t")).otherwise(F.raise_error(F.lit(f"a line has fewer than {len(columns)} numbers"))))
    return t.select(*(F.col("t")[n].cast("double").alias(c) for n, c in enumerate(columns)))


def read_ascii_tokens(spark: SparkSession, path: str, columns: Sequence[str] = POINT) -> DataFrame:
    """As ``read_ascii`` where a point's numbers may run over lines: tokens are counted over each whole file."""
    n = len(columns)
    t = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("t"))
    rows = t.select(F.explode(F.expr(f"transform(sequence(0, cast(size(t) / {n} as int) - 1), i -> slice(t, i * {n} + 1, {n}))")).alias("r"))
    return rows.select(*(F.col("r")[k].cast("double").alias(c) for k, c in enumerate(columns)))


def write_ascii(points: DataFrame, path: str, columns: Sequence[str] = POINT) -> None:
    points.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))).write.text(path)


def write_values(points: DataFrame, path: str, axes: Sequence[str], value: str) -> None:
    """Positions and a value, a line each."""
    write_ascii(points, path, (*axes, value))


def read_binary(spark: SparkSession, path: str, kind: str = "6<f4", columns: Sequence[str] = POINT) -> DataFrame:
    """Packed records (``.bnpts``): ``kind`` is a numpy type of all fields, or a comma-separated list of them, as ``6<f4,3u1`` for colours.

    Files on a disk that all share are read in ranges of records, in their order; those of other stores a file a task, each of under 2 GB.
    """
    dtype = np.dtype([(f"f{n}", t if t[0] in "<>" or not t[0].isdigit() else (t.lstrip("0123456789"), int(t[: len(t) - len(t.lstrip("0123456789"))]))) for n, t in enumerate(kind.split(","))])
    schema = ", ".join(f"{c} double" for c in columns)

    def unpacked(raw: bytes) -> pa.RecordBatch:
        rows = np.frombuffer(raw, dtype=dtype)
        flat = [np.asarray(rows[f]).reshape(len(rows), -1).astype(np.float64) for f in dtype.names]
        whole = np.concatenate(flat, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(whole[:, k])) for k in range(len(columns))], list(columns))

    whole = spark.read.format("binaryFile").load(path).filter("length > 0")
    found = sorted(whole.select("path", "length").collect())
    if not all(name.startswith("file:") for name, _ in found):
        return whole.select("content").mapInArrow(lambda batches: (unpacked(raw) for batch in batches for raw in batch.column(0).to_pylist()), schema)

    step = dtype.itemsize << 18
    first = [0, *accumulate(-(-length // step) for _, length in found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                k = bisect_right(first, n) - 1
                with open(found[k][0].removeprefix("file:"), "rb") as f:
                    f.seek((n - first[k]) * step)
                    yield unpacked(f.read(step))

    return spark.range(0, first[-1], 1, max(1, min(first[-1], 1 << 14))).mapInArrow(run, schema)


def write_binary(points: DataFrame, path: str, columns: Sequence[str] = POINT) -> None:
    """Packed 32-bit floats, in the table's order, to one file; a null, or a number too large for 32 bits, is an error.

    Tasks pack their rows into parts in the shared folder; the driver puts these together.
    """
    at = folder(points.sparkSession)
    system, plain = store(at)
    system.create_dir(plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{at}/{uuid.uuid4().hex}"  # an attempt's own
        system, plain = store(name)
        with system.open_output_stream(plain) as f:
            for batch in batches:
                if any(c.null_count for c in batch.columns):
                    raise ValueError("a point has a null")
                with np.errstate(over="raise"):
                    f.write(np.stack([c.to_numpy().astype("<f4") for c in batch.columns], axis=1).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([name])], ["part", "name"])

    try:
        parts = points.select(*(F.col(c).cast("double").alias(c) for c in columns)).mapInArrow(run, "part long, name string").collect()
        with open(path, "wb") as f:
            for _, name in sorted(parts):
                system, part = store(name)
                with system.open_input_stream(part) as g:
                    shutil.copyfileobj(g, f, 1 << 22)
    finally:
        system.delete_dir(plain)


def read_transform(path: str, dim: int = 3) -> np.ndarray:
    with open(path) as f:
        x = np.array(f.read().split(), dtype=float)
    return x.reshape(dim + 1, dim + 1)


def write_grid(grid: DataFrame, path: str, resolution: Sequence[int], transform: np.ndarray, value: str = "val") -> None:
    """Header lines (dimension, channels and type, resolution, the transform by columns), then 32-bit floats, first axis fastest."""
    d = len(resolution)
    axes = ("i", "j", "k")[:d]
    head = [f"G{d}", "1 FLOAT", " ".join(map(str, resolution)), *(" ".join(repr(float(transform[i, j])) for i in range(d + 1)) for j in range(d + 1))]
    with open(path, "wb") as f:
        f.write(("\n".join(head) + "\n").encode())
        for row in grid.orderBy(*axes[::-1]).select(value).toLocalIterator(prefetchPartitions=True):
            f.write(struct.pack("<f", row[0]))


def read_grid(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, ...], np.ndarray]:
    """Rows (axes, val) with the resolution and transform; a file of one channel."""
    with open(path, "rb") as f:
        d = int(f.readline().strip()[1:])
        channels, kind = f.readline().split()
        resolution = tuple(map(int, f.readline().split()))
        t = np.array([f.readline().split() for _ in range(d + 1)], dtype=float).T
        start = f.tell()
    if int(channels) != 1:
        raise ValueError("one channel only")
    size = {b"FLOAT": ("<f4", 4), b"DOUBLE": ("<f8", 8), b"INT": ("<i4", 4), b"UCHAR": ("u1", 1)}[kind]
    total, axes = int(np.prod(resolution)), ("i", "j", "k")[:d]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                n = min(1 << 20, total - a)
                with open(path, "rb") as f:
                    f.seek(start + a * size[1])
                    x = np.frombuffer(f.read(n * size[1]), dtype=size[0]).astype(np.float64)
                index = np.unravel_index(np.arange(a, a + n), resolution, order="F")
                yield pa.RecordBatch.from_arrays([*(pa.array(i.astype(np.int32)) for i in index), pa.array(x)], [*axes, "val"])

    starts = spark.range(0, total, 1 << 20)
    return starts.mapInArrow(run, ", ".join([*(f"{a} int" for a in axes), "val double"])), resolution, t


def decode_png(raw: bytes) -> np.ndarray:
    """Rows x columns x channels of an 8-bit, not interlaced PNG."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, size = 8, b"", (0, 0, 0)
    while at < len(raw):
        (n,), kind = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, bits, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if bits != 8 or interlaced or color not in (0, 2, 4, 6):
                raise ValueError("8 bits, grey or colour, not interlaced")
            size = (h, w, {0: 1, 2: 3, 4: 2, 6: 4}[color])
        elif kind == b"IDAT":
            data += body
        at += n + 12
    h, w, c = size
    lines = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(h, w * c + 1)
    out = np.zeros((h + 1, w * c), dtype=np.int64)
    for y in range(h):
        mode, x = lines[y, 0], lines[y, 1:].astype(np.int64)
        up = out[y]
        if mode == 2:
            x = x + up
        elif mode in (1, 3, 4):
            for k in range(w * c):
                left = x[k - c] if k >= c else 0
                corner = up[k - c] if k >= c else 0
                if mode == 1:
                    guess = left
                elif mode == 3:
                    guess = (left + up[k]) // 2
                else:
                    p = left + up[k] - corner
                    guess = min((left, up[k], corner), key=lambda q: (abs(p - q), (left, up[k], corner).index(q)))
                x[k] = (x[k] + guess) & 255
        out[y + 1] = x & 255
    return out[1:].reshape(h, w, c).astype(np.uint8)


def encode_png(image: np.ndarray) -> bytes:
    h, w, c = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((h, 1), dtype=np.uint8), image.reshape(h, w * c)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, row, col, r, g, b) of PNG files; JPEG has no decoder here and is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = decode_png(raw)
                h, w, c = image.shape
                rgb = image[..., :3] if c >= 3 else np.repeat(image[..., :1], 3, axis=2)
                for y in range(h):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * w), pa.array(np.full(w, y, dtype=np.int32)), pa.array(np.arange(w, dtype=np.int32)), *(pa.array(rgb[y, :, k].astype(np.int32)) for k in range(3))], ["path", "row", "col", "r", "g", "b"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row int, col int, r int, g int, b int")


def label_of(r: F.Column, g: F.Column, b: F.Column) -> F.Column:
    """A label colour as a number; white is none."""
    packed = F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)
    return F.when((r == 255) & (g == 255) & (b == 255), -1).otherwise(packed)


def to_pixel(c: F.Column) -> F.Column:
    """A value of 0 to 1 as a byte, cut off, not rounded."""
    return F.least(F.greatest((c * 255).cast("int"), F.lit(0)), F.lit(255))


def write_chunks(rows: DataFrame, path: str, columns: Sequence[str] = ("cx", "cy", "cz")) -> None:
    """A folder for each cube."""
    rows.write.partitionBy(*columns).parquet(path)


def write_slabs(rows: DataFrame, path: str) -> None:
    rows.repartition("slab").write.partitionBy("slab").parquet(path)
