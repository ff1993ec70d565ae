"""PLY files: header, a Spark data source that reads row ranges, and writers.

``spark.read.format("ply").load(path)`` gives the vertices with all scalar properties as columns,
in their order, ``idx`` before them; option ``element`` takes another element, a list property
becomes an array. Fixed-size binary elements are read in ranges of rows by as many tasks;
others, and text, by one task per file. Paths are read through pyarrow's file systems.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Type names of the format, each with its code in ``struct``; unsigned types widen in Spark.
TYPES = {
    "char": "b", "uchar": "B", "short": "h", "ushort": "H", "int": "i", "uint": "I", "float": "f", "double": "d",
    "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "float32": "f", "float64": "d",
    "int64": "q", "uint64": "Q", "longlong": "q", "ulonglong": "Q",
}
_SPARK = {
    "b": T.ByteType(), "B": T.ShortType(), "h": T.ShortType(), "H": T.IntegerType(), "i": T.IntegerType(), "I": T.LongType(),
    "q": T.LongType(), "Q": T.DecimalType(20, 0), "f": T.FloatType(), "d": T.DoubleType(),
}


@dataclass
class Element:
    name: str
    count: int
    properties: list[tuple[str, str, str | None]] = field(default_factory=list)  # name, type, type of a list's length

    @property
    def fixed(self) -> bool:
        return all(n is None for _, _, n in self.properties)

    def row_format(self, order: str) -> str:
        return order + "".join(TYPES[t] for _, t, _ in self.properties)

    def schema(self) -> T.StructType:
        fields = [T.StructField("idx", T.LongType(), False)]
        for name, kind, n in self.properties:
            t = _SPARK[TYPES[kind]]
            fields.append(T.StructField(name, T.ArrayType(t) if n else t))
        return T.StructType(fields)


@dataclass
class Header:
    form: str
    elements: list[Element]
    comments: list[str]
    size: int

    @property
    def order(self) -> str:
        return ">" if self.form == "binary_big_endian" else "<"

    def element(self, name: str) -> Element:
        found = next((e for e in self.elements if e.name == name), None)
        if found is None:
            raise ValueError(f"no element {name}")
        return found


def store(path: str):
    """The file system of an address, and its name there."""
    from pyarrow import fs

    p = urlparse(path)
    return (fs.LocalFileSystem(), p.path) if p.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def _open(path: str):
    system, name = store(path)
    return system.open_input_file(name)


def read_header(path: str) -> Header:
    with _open(path) as f:
        raw = b""
        while b"end_header" not in raw or b"\n" not in raw[raw.index(b"end_header") :]:
            block = f.read(4096)
            if not block:
                raise ValueError(f"{path}: no PLY header")
            raw += block
    size = raw.index(b"\n", raw.index(b"end_header")) + 1
    lines = raw[:size].decode("ascii", "replace").splitlines()
    if lines[0].strip() != "ply":
        raise ValueError(f"{path}: not a PLY file")
    form, elements, comments = "", [], []
    for line in lines[1:]:
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            form = w[1]
        elif w[0] == "comment":
            comments.append(line.split(" ", 1)[1] if " " in line else "")
        elif w[0] == "element":
            elements.append(Element(w[1], int(w[2])))
        elif w[0] == "property":
            elements[-1].properties.append((w[4], w[3], w[2]) if w[1] == "list" else (w[2], w[1], None))
    return Header(form, elements, comments, size)


@dataclass
class _Range(InputPartition):
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, element: str, rows: int):
        self.path, self.name, self.rows = path, element, rows
        self.header = read_header(path)
        self.element = self.header.element(element)

    def _ranged(self) -> bool:
        before = self.header.elements[: self.header.elements.index(self.element)]
        return self.header.form != "ascii" and self.element.fixed and all(e.fixed for e in before)

    def partitions(self) -> list[InputPartition]:
        n = self.element.count
        if not self._ranged() or n == 0:
            return [_Range(0, n)]
        return [_Range(a, min(n, a + self.rows)) for a in range(0, n, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple | pa.RecordBatch]:
        if self._ranged():
            yield from self._read_range(partition)
        elif self.header.form == "ascii":
            yield from self._read_text()
        else:
            yield from self._read_rows()

    def _read_range(self, p: _Range) -> Iterator[pa.RecordBatch]:
        order = self.header.order
        start = self.header.size
        for e in self.header.elements:
            if e is self.element:
                break
            start += e.count * struct.calcsize(e.row_format(order))
        kind = np.dtype([(n, order + TYPES[t]) for n, t, _ in self.element.properties])
        schema = pa.schema([("idx", pa.int64())] + [(f.name, _arrow(f.dataType)) for f in self.element.schema()[1:]])
        with _open(self.path) as f:
            for a in range(p.begin, p.end, 65_536):
                n = min(65_536, p.end - a)
                f.seek(start + a * kind.itemsize)
                rows = np.frombuffer(f.read(n * kind.itemsize), dtype=kind)
                columns = [pa.array(np.arange(a, a + n))]
                for name, t in zip(kind.names, schema.types[1:], strict=True):
                    x = np.ascontiguousarray(rows[name]).astype(rows[name].dtype.newbyteorder("="))
                    columns.append(pa.array(x).cast(t))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def _read_text(self) -> Iterator[tuple]:
        with _open(self.path) as f:
            f.seek(self.header.size)
            words = iter(f.read().split())
        for e in self.header.elements:
            for idx in range(e.count):
                row: list = [idx]
                for _, kind, n in e.properties:
                    to = float if TYPES[kind] in "fd" else int
                    row.append([to(next(words)) for _ in range(int(next(words)))] if n else to(next(words)))
                if e is self.element:
                    yield tuple(row)
            if e is self.element:
                return

    def _read_rows(self) -> Iterator[tuple]:
        order = self.header.order
        with _open(self.path) as f:
            f.seek(self.header.size)
            raw, at = f.read(), 0
        for e in self.header.elements:
            for idx in range(e.count):
                row: list = [idx]
                for _, kind, n in e.properties:
                    if n:
                        (size,) = struct.unpack_from(order + TYPES[n], raw, at)
                        at += struct.calcsize(TYPES[n])
                        row.append(list(struct.unpack_from(f"{order}{size}{TYPES[kind]}", raw, at)))
                        at += size * struct.calcsize(TYPES[kind])
                    else:
                        row.append(struct.unpack_from(order + TYPES[kind], raw, at)[0])
                        at += struct.calcsize(TYPES[kind])
                if e is self.element:
                    yield tuple(row)
            if e is self.element:
                return


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


class PlyDataSource(DataSource):
    """Options: path, element (vertex), rows (a partition's, 1,000,000)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        return read_header(self.options["path"]).element(self.options.get("element", "vertex")).schema()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("element", "vertex"), int(self.options.get("rows", 1_000_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlyDataSource)


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, ...) and faces (fid, ids)."""
    register(spark)
    v = spark.read.format("ply").load(path).withColumnRenamed("idx", "vid")
    name = read_header(path).element("face").properties[0][0]
    f = spark.read.format("ply").option("element", "face").load(path)
    return v, f.select(F.col("idx").alias("fid"), F.col(name).cast("array<bigint>").alias("ids"))


def read_envelope(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A mesh of triangles; anything else is an error."""
    v, f = read_mesh(spark, path)
    if not f.filter("size(ids) <> 3").isEmpty():
        raise ValueError(f"{path}: not a simplex")
    return v, f


_OF_SPARK = {"tinyint": "char", "smallint": "short", "int": "int", "bigint": "int64", "float": "float", "double": "double"}


def write(path: str, elements: Iterable[tuple[str, DataFrame, str]], form: str = "binary_little_endian", comments: Iterable[str] = (), narrow: bool = True) -> None:
    """Write elements (name, rows, order column) as one file; the order column is left out.

    Counts are taken first and written into the header; a row more or less is an error. Rows come
    in order, partition by partition, so the driver holds one partition at a time. ``narrow``:
    doubles as float, longs in lists as int, as meshes use.
    """
    from pyarrow import fs

    p = urlparse(path)
    system, name = (fs.LocalFileSystem(), p.path) if p.scheme in ("", "file") else fs.FileSystem.from_uri(path)
    order = ">" if form == "binary_big_endian" else "<"
    parts = []
    head = ["ply", f"format {form} 1.0", *(f"comment {c}" for c in comments)]
    for label, rows, by in elements:
        n = rows.count()
        columns = [(f.name, f.dataType) for f in rows.schema if f.name != by]
        kinds = []
        head.append(f"element {label} {n}")
        for c, t in columns:
            listed = isinstance(t, T.ArrayType)
            k = _OF_SPARK[(t.elementType if listed else t).simpleString()]
            k = {"double": "float", "int64": "int"}.get(k, k) if narrow else k
            head.append(f"property list uchar {k} {c}" if listed else f"property {k} {c}")
            kinds.append((c, k, listed))
        parts.append((n, rows.orderBy(by).select(*(c for c, _ in columns)), kinds))
    with system.open_output_stream(name) as f:
        f.write(("\n".join([*head, "end_header"]) + "\n").encode())
        for n, rows, kinds in parts:
            seen = 0
            for row in rows.toLocalIterator(prefetchPartitions=True):
                f.write(_row(row, kinds, form, order))
                seen += 1
            if seen != n:
                raise ValueError(f"{seen} rows written, {n} declared")


def _row(row, kinds: list[tuple[str, str, bool]], form: str, order: str) -> bytes:
    if form == "ascii":
        words = []
        for value, (_, _, listed) in zip(row, kinds, strict=True):
            words += [str(len(value)), *map(str, value)] if listed else [repr(value) if isinstance(value, float) else str(value)]
        return (" ".join(words) + "\n").encode()
    out = b""
    for value, (_, kind, listed) in zip(row, kinds, strict=True):
        out += struct.pack(f"{order}B{len(value)}{TYPES[kind]}", len(value), *value) if listed else struct.pack(order + TYPES[kind], value)
    return out


def write_points(path: str, points: DataFrame, key: str = "pid", **options) -> None:
    write(path, [("vertex", points, key)], **options)


def write_mesh(path: str, vertices: DataFrame, faces: DataFrame, **options) -> None:
    write(path, [("vertex", vertices, "vid"), ("face", faces.select("fid", F.col("ids").alias("vertex_indices")), "fid")], **options)


def write_curve(path: str, vertices: DataFrame, segments: DataFrame, **options) -> None:
    write(path, [("vertex", vertices, "vid"), ("edge", segments.select("eid", F.col("a").cast("int").alias("v1"), F.col("b").cast("int").alias("v2")), "eid")], **options)
