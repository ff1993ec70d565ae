"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to lower case and the ASCII white space to blanks; all other bytes stay.
SPACED = bytes(
    0x20 if b in (9, 10, 11, 12, 13, 32) else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
#: A-Z to lower case; ASCII bytes that are neither digits nor letters to blanks.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0x20
    for b in range(256)
)

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's address under ``spark.checkpoint.dir``.

    Where that is unset a local folder is made and set, if all runs on one machine; otherwise each machine
    would have a folder of its own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='voxelark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes within go at the end, but those to keep."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield
    finally:
        _scratch.pop()
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, narrow: bool = False, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors lose nothing.

    ``narrow``: the result of a shuffle, small beside the documents; an eighth as many files do.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if _scratch and not keep:
        _scratch[-1].append(path)
    (df.coalesce(max(8, shuffle_partitions(spark) // 8)) if narrow else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def dispose(df: DataFrame) -> None:
    """Delete the table that ``materialize`` wrote for ``df``; others stay."""
    if path := getattr(df, "_written_at", None):
        _delete(df.sparkSession, path)


def small(ids: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``ids`` (one number a row), marked for broadcast if they are at most ``rows``; otherwise joins shuffle."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def batches_of(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most_bytes`` of ``column`` each; a single row may hold more."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        cum = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = cum[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(cum, base + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 64), 0x9E3779B97F4A7C15 | 1, dtype=np.uint64)
            steps[0] = 1
            _POWERS = np.cumprod(steps)
    return _POWERS


class Words:
    """The words of many texts as arrays: where each starts, its length and its 64-bit hash.

    ``per_text`` has each text's number of words. The hash depends on a word's bytes alone.
    """

    def __init__(self, texts: list[str], byte_map: bytes = SPACED, hashes: bool = True):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.buffer = (b" ".join(raw) + b" ").translate(byte_map)
        a = np.frombuffer(self.buffer, dtype=np.uint8)
        inside = np.zeros(len(a) + 2, dtype=np.int8)
        inside[1:-1] = a != 0x20
        edge = np.diff(inside)
        self.starts = np.flatnonzero(edge == 1)
        self.lengths = np.flatnonzero(edge == -1) - self.starts
        bounds = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)), out=bounds[1:])
        self.first = np.searchsorted(self.starts, bounds)
        self.per_text = np.diff(self.first)
        if hashes:
            self.hashes = self._hash(a, inside[1:-1].astype(bool))

    def _hash(self, a: np.ndarray, inside: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        begin = np.zeros(len(self.starts), dtype=np.int64)
        np.cumsum(self.lengths[:-1], out=begin[1:])
        place = np.arange(int(self.lengths.sum()), dtype=np.int32) - np.repeat(begin, self.lengths).astype(np.int32)
        with np.errstate(over="ignore"):
            value = _BYTE[a[inside]] * _powers(int(self.lengths.max()))[place]
            total = np.add.reduceat(value, begin) + self.lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        return mix64(total)


def ceil_div(a: int, b: int) -> int:
    return math.ceil(a / b)
