"""WARC archives: writing, normalising and reading.

``write_archives`` writes one gzip stream over a whole file, as many crawlers do. Such a file can't
be read from its middle. ``normalise`` inflates the stream once, rewrites each record as a gzip
member of its own and writes a sidecar index of their places; ``read_archives`` then takes
records by place, each on its own. Neither holds more than one record and one block of input.
Files appear under their name only when complete, so a task that runs twice does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, shared_dir, small

_BLOCK = 1 << 20
GZIP = 31  # zlib's window bits for a gzip header and trailer


def _filesystem(uri: str):
    """(filesystem, path): local for plain paths and file:, else whatever pyarrow knows."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


@contextmanager
def _whole_file(uri: str):
    """A stream to write to; the file gets its name on success only."""
    system, path = _filesystem(uri)
    task = TaskContext.get()
    part = f"{path}.{task.taskAttemptId() if task else os.getpid()}.part"
    system.create_dir(os.path.dirname(path), recursive=True)
    try:
        with system.open_output_stream(part, compression=None) as f:
            yield f
    except BaseException:
        system.delete_file(part)
        raise
    system.move(part, path)


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(payload)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + payload + b"\r\n\r\n"


def _header_value(text: str) -> str:
    """One line: a URL may hold anything; one that needs escaping holds a backslash then."""
    return json.dumps(text)[1:-1] if any(ord(c) < 32 or c == "\\" for c in text) else text


def _from_header(value: str | None) -> str | None:
    return json.loads(f'"{value}"', strict=False) if value and "\\" in value else value


def page_record(page_id, url: str | None, payload: bytes, winner) -> bytes:
    """A response record, or a revisit of page ``winner`` without payload but with its digest and length."""
    revisit = winner is not None and page_id is not None and winner != page_id
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(len(payload))),
    ] + ([("WARC-Target-URI", _header_value(url))] if url else [])
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{winner}>")]
        payload = b""
    return record(headers, payload)


def _records(f) -> Iterator[bytes]:
    """The records in a gzip file of any number of members, inflated as a stream."""
    inflate, held, need = zlib.decompressobj(GZIP), bytearray(), 0
    while block := f.read(_BLOCK):
        while block:
            held += inflate.decompress(block, _BLOCK)
            if inflate.eof:
                block = inflate.unused_data
                inflate = zlib.decompressobj(GZIP)
            else:
                block = inflate.unconsumed_tail
            while len(held) >= max(need, 1):
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    need = len(held) + 1
                    break
                size = next(int(x.split(b":")[1]) for x in bytes(held[:head]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = head + 4 + size + 4
                if len(held) < need:
                    break
                yield bytes(held[:need])
                del held[:need]
                need = 0
    if held:
        raise ValueError("an archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.decode().split(": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    return headers, rest[: int(headers["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0, level: int = 1) -> list[str]:
    """Write a gzip archive per partition and return their addresses.

    Of pages with equal payloads (by SHA-1) of at least ``min_payload`` bytes, that with the largest
    id is the response and the others revisit it. Pages without an id are responses; so are
    repeated rows of the largest id. Null html is the empty payload, null and empty urls are left
    out; payloads are written whole; an empty table gives no archives; further columns are not
    looked at.

    Only ids and digests meet by digest; pages find their response by id and digest then, as
    a broadcast where few pages are revisits, so that no payload is dealt by what many pages share.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    keys = rows.filter((F.octet_length("payload") >= min_payload) & F.col("id").isNotNull()).select("id", "digest")
    with scratch(pages.sparkSession):
        keys = materialize(keys)
        winners = materialize(keys.groupBy("digest").agg(F.max("id").alias("winner"), F.min("id").alias("least")).filter("least < winner").drop("least"))
        revisits = materialize(keys.join(small(winners, 500_000), "digest").filter("id <> winner").distinct())
        return _written(rows.join(small(revisits, 500_000), ["id", "digest"], "left").select("id", "url", "payload", "winner"), folder, level)


def _written(rows: DataFrame, folder: str, level: int) -> list[str]:
    """Archives of (id, url, payload, winner), one per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        path, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with _whole_file(path) as f:
            stream = zlib.compressobj(level, zlib.DEFLATED, GZIP)
            while batch is not None:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    f.write(stream.compress(page_record(*row)))
                    n += 1
                batch = next(batches, None)
            f.write(stream.flush())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], ["path", "n"])

    return sorted(r["path"] for r in rows.mapInArrow(run, "path string, n long").collect())


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))


def normalise(spark: SparkSession, paths: list[str], folder: str, level: int = 6, remove: bool = False) -> list[str]:
    """Rewrite archives with a gzip member for each record, each beside its index ``.idx``.

    A line of the index is a record's offset and compressed length. ``remove``: delete an
    archive once its successor is complete. Archives without records get empty successors; one
    that ends within a record is an error; a record is held whole, nothing else is; no paths give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for path in batch.column(0).to_pylist():
                new = f"{folder}/{os.path.basename(path)}"
                old_system, old = _filesystem(path)
                new_system, new_path = _filesystem(new)
                ready = new_system.get_file_info([f"{new_path}.idx"])[0].is_file
                if not ready:
                    with old_system.open_input_stream(old, compression=None) as f, _whole_file(new) as out:
                        places, at = [], 0
                        for raw in _records(f):
                            member = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                            data = member.compress(raw) + member.flush()
                            out.write(data)
                            places.append(f"{at} {len(data)}\n")
                            at += len(data)
                    with _whole_file(f"{new}.idx") as index:
                        index.write("".join(places).encode())
                if remove and old_system.get_file_info([old])[0].is_file:
                    old_system.delete_file(old)
                made.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(made, type=pa.string())], ["path"])

    return sorted(r["path"] for r in _files(spark, paths).mapInArrow(run, "path string").collect())


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of normalised archives.

    Records are taken one by one at the places in the index, whole. A revisit's payload is empty, its
    size and digest are those of the page; ids, urls and references that weren't written are null;
    records that were written twice are read twice; no paths give no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn[10:-1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _filesystem(path)
                with system.open_input_stream(f"{name}.idx", compression=None) as f:
                    places = [tuple(map(int, x.split())) for x in f.read().decode().splitlines()]
                rows, held = [], 0
                with system.open_input_file(name) as f:
                    for at, size in places:
                        f.seek(at)
                        h, body = parse(zlib.decompress(f.read(size), GZIP))
                        kind = h["WARC-Type"]
                        rows.append((number(h["WARC-Record-ID"]), _from_header(h.get("WARC-Target-URI")), body, int(h["X-Payload-Bytes"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), kind, number(h.get("WARC-Refers-To"))))
                        held += len(body)
                        if held > 8 * _BLOCK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _files(spark, paths).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives, normalised and read back from the shared folder; nulls, empty
    pages, ties, repeats and empty tables as in ``write_archives`` and ``read_archives``."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    whole = write_archives(pages, f"{folder}/whole")
    return read_archives(spark, normalise(spark, whole, f"{folder}/members", remove=True))
