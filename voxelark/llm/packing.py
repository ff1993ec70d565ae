"""Best-fit packing by hierarchical residual packing.

Each input partition cuts its documents into pieces and packs them best-fit decreasing into
sequences. Nearly full sequences are done. Underfull ones travel on as items of their length:
they are dealt to fewer partitions (``fan_in`` to one) and packed again, until one partition is
left or nothing more fits. What travels is pieces' numbers, never texts or ids; a partition's
share of underfull sequences stays under ``rows_per_task`` by the number of partitions kept.

The first round holds at most about ``block`` pieces at a time: sequences that close leave at once,
underfull ones stay as items for the pieces that follow.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, materialize, scratch, strings

END_ID = 2
CAPACITY = 1024
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = pa.schema([("total", pa.int32()), ("done", pa.bool_()), ("sequence_id", pa.int64()), ("pieces", pa.list_(_PIECE))])
BINS = "total int, done boolean, sequence_id long, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


class Tokenizer:
    """The ids that ``tokenizers`` gives, from the same vocabulary's faster library where both agree.

    Texts with letters beyond Latin, with a special token's string or with long runs of white space
    (the faster library's pattern recurses over those until its stack ends) go to ``tokenizers``
    itself, and so does any text on which the faster library panics.
    """

    _rare = re.compile("[^\x00-ɏ]|<\\|")
    _blanks = re.compile("\\s{1000}")

    def __init__(self, name: str = "byte_bpe_50k"):
        import base64

        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer as Slow

        with open(P.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Slow.from_file(P.path(f"{name}.json"))

    def ids(self, text: str) -> list[int]:
        if not self._rare.search(text) and not self._blanks.search(text):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:
                if type(e).__name__ != "PanicException":  # not an Exception; its class can't be imported
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Item numbers of each bin, best-fit decreasing; equal sizes in the order given.

    Open bins are kept by what is left in them, with a bit for each residual in use, so that
    the tightest bin that holds an item is one shift and one lowest bit away.
    """
    bins: list[list[int]] = []
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = used >> size
        if fits:
            residual = size + (fits & -fits).bit_length() - 1
            b = by_residual[residual].pop()
            if not by_residual[residual]:
                used ^= 1 << residual
            bins[b].append(k)
        else:
            residual, b = capacity, len(bins)
            bins.append([k])
        if left := residual - size:
            by_residual[left].append(b)
            used |= 1 << left
    return bins


def _bins(items: list[tuple[int, list[dict]]], capacity: int) -> list[tuple[int, list[dict]]]:
    """Bins of items, both as (tokens, pieces)."""
    sizes = np.array([n for n, _ in items], dtype=np.int64)
    return [(int(sizes[members].sum()), [p for m in members for p in items[m][1]]) for members in best_fit(sizes, capacity)]


class _Rows:
    """Record batches of bins with numbers that are unique by level, partition and order."""

    def __init__(self, level: int, full: int):
        task = TaskContext.get()
        self.next, self.full = (level << 56) | ((task.partitionId() if task else 0) << 32), full

    def __call__(self, bins: list[tuple[int, list[dict]]]) -> pa.RecordBatch:
        numbers = range(self.next, self.next + len(bins))
        self.next += len(bins)
        columns = [n for n, _ in bins], [n >= self.full for n, _ in bins], list(numbers), [p for _, p in bins]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _BINS, strict=True)], schema=_BINS)


def tokenize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY) -> DataFrame:
    """Rows (id_col, piece, start, length, ids): each document's ids, end id last, cut into pieces.

    Null and empty texts are the end id alone; long texts are read whole; null ids and repeated
    rows give rows like others; an empty table gives none; further columns are not looked at.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Tokenizer(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids = [*coder.ids(text), END_ID]
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    for column, value in zip(out, (key, k, start, n, ids[start : start + n]), strict=True):
                        column.append(value)
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], ["id", "piece", "start", "length", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids array<int>").withColumnRenamed("id", id_col)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, slack: int = 4, fan_in: int = 8, rows_per_task: int = 50_000, block: int = 65_536) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    ``slack``: free tokens at which a sequence counts as full. Null and empty texts are the end id
    alone; texts of any length are read whole and only their pieces' numbers are held; equal
    lengths are packed in the order given; null ids and repeated rows are packed like others; an
    empty table has no sequences; further columns are not looked at.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, rows, items = Tokenizer(tokenizer), _Rows(0, capacity - slack), []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids = np.array([*coder.ids(text), END_ID], dtype="<u4")
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    items.append((n, [{"doc_id": key, "piece": k, "start": start, "length": n, "ids_crc32": zlib.crc32(ids[start : start + n].tobytes())}]))
                if len(items) >= block:
                    bins = _bins(items, capacity)
                    items = [b for b in bins if b[0] < rows.full]
                    if 2 * len(items) > block:  # they hardly fit together
                        yield rows(bins)
                        items = []
                    else:
                        yield rows([b for b in bins if b[0] >= rows.full])
        yield rows(_bins(items, capacity))

    def again(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [r for b in batches for r in b.select(["total", "sequence_id", "pieces"]).to_pylist()]
            got.sort(key=lambda r: r["sequence_id"])
            yield _Rows(level, capacity - slack)(_bins([(r["total"], r["pieces"]) for r in got], capacity))

        return run

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with scratch(df.sparkSession):
        state = materialize(rows.mapInArrow(first, BINS))
        done, level, parts = state.filter("done"), 0, max(1, rows.rdd.getNumPartitions())
        left = state.filter("NOT done")
        n_left, before = left.count(), None
        while n_left and (parts > 1 or level == 0):
            level += 1
            parts = max(ceil_div(parts, fan_in), ceil_div(n_left, rows_per_task))
            state = materialize(left.repartition(parts, "sequence_id").mapInArrow(again(level), BINS))
            done, left = done.union(state.filter("done")), state.filter("NOT done")
            before, n_left = n_left, left.count()
            if n_left > 0.98 * before and parts == ceil_div(before, rows_per_task):
                break  # what is left doesn't fit together
        bins = done.union(left)
        placed = bins.select("sequence_id", F.expr("""
            transform(pieces, (p, i) -> named_struct('p', p, 'offset', aggregate(slice(pieces, 1, i), 0L, (s, x) -> s + x.length)))
        """).alias("placed"))  # fmt: skip
        return materialize(placed.select("sequence_id", F.explode("placed").alias("x")).select("x.p.*", "sequence_id", "x.offset"), keep=True)
