"""Approximate nearest neighbours with a hash-prefix forest.

One forest covers the whole table. Each of its ``trees`` is a sorted array of hash strings, one for
each distinct vector: the first seven bits name the nearest of 64 random directions and its sign, the
others tell on which side of further random planes the vector lies. The arrays are dealt by tree and first
bits; a part that holds more than ``cell_rows`` strings is cut into chunks of that size.

A query descends in every tree to the strings that share its own longest prefix, and then ascends in all trees
at once, a bit a step: the prefixes' strings are counted where they lie, the counts are summed by query, and
the longest length at which all trees together have ``candidates`` strings is the query's. Strings
under it are its candidates. They go to where the vectors lie, dealt by number; distances are
computed there from the original vectors in double precision, and each part's nearest go on to the
final ranking. A query that isn't given enough by the first bits is held against all vectors.

How many candidates are needed depends on the data, so it is measured: at most ``probes`` queries are answered
by brute force over all rows, and the least number with which the forest finds ``target`` of their
neighbours is taken. Hashes and counts follow from the vectors alone, so results don't depend on how rows are dealt.

Equal vectors are one entry, with the ``k + 1`` smallest ids: more can't be among a query's nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_div, materialize, scratch, shuffle_partitions, small

_U = np.uint64
_DIRECTIONS, _FIRST, _PLANES = 64, 7, 33
_BITS = _FIRST + _PLANES
#: Prefix lengths, from the whole string up to the first bits.
_LENGTHS = np.arange(_BITS, _FIRST - 1, -1)
_MASKS = (_U(1) << (_BITS - _LENGTHS).astype(np.uint64)) - _U(1)


@lru_cache(maxsize=512)
def _tree(n: int, t: int) -> np.ndarray:
    """The directions and planes of a tree, for vectors of length ``n``; directions are orthogonal where they can be."""
    rng = np.random.default_rng((n, t, 7))
    m = rng.standard_normal((n, _DIRECTIONS + _PLANES))
    if n >= _DIRECTIONS:
        m[:, :_DIRECTIONS] = np.linalg.qr(m[:, :_DIRECTIONS])[0]
    return m


def strings_of(x: np.ndarray, t: int, mean: np.ndarray) -> np.ndarray:
    """Hash strings of the rows of ``x`` in a tree."""
    y = (x - mean) @ _tree(x.shape[1], t)
    far = np.abs(y[:, :_DIRECTIONS]).argmax(axis=1)
    first = far.astype(np.uint64) * _U(2) + (y[np.arange(len(y)), far] > 0)
    bits = (y[:, _DIRECTIONS:] > 0).astype(np.uint64) @ (_U(1) << np.arange(_PLANES - 1, -1, -1, dtype=np.uint64))
    return (first << _U(_PLANES)) | bits


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=np.float64) for v in column.to_pylist()]


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    vectors = _vectors(column)
    lengths = np.array([len(v) for v in vectors], dtype=np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.stack([vectors[k] for k in at])


def _sound(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    ok = F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull()).filter(ok)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v) as (vec, ids): vectors as bytes, equal ones of a batch once, with their ids."""
    for batch in batches:
        column = batch.column(1)
        ends, flat = column.offsets.to_numpy(), np.ascontiguousarray(column.values.to_numpy() + 0.0)  # + 0.0: one zero
        found: dict[bytes, list[int]] = {}
        for k, key in enumerate(batch.column(0).to_pylist()):
            found.setdefault(flat[ends[k] : ends[k + 1]].tobytes(), []).append(key)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.binary()), pa.array(list(found.values()), type=pa.list_(pa.int64()))], ["vec", "ids"])


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """Rows (e, vec, ids) of distinct vectors with their ``k + 1`` smallest ids; a common vector travels once a batch."""
    least = F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1)
    sent = rows.mapInArrow(_packed, "vec binary, ids array<long>").select("vec", least.alias("ids"))
    one = sent.groupBy("vec").agg(F.flatten(F.collect_list("ids")).alias("ids")).select("vec", least.alias("ids"))
    return materialize(one.withColumn("e", F.monotonically_increasing_id()))


def _means(entries: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Mean vector of each length over a sample of about ``rows`` at most, picked by a hash of the vector."""
    n = entries.count()
    picked = entries.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < int(min(1.0, rows / max(n, 1)) * (1 << 20)) + 1).select("vec").limit(4 * rows)
    out: dict[int, list[np.ndarray]] = {}
    for v in _vectors(picked.orderBy("vec").toArrow().column(0)):
        out.setdefault(len(v), []).append(v)
    return {k: np.mean(v, axis=0) for k, v in out.items()}


def _strings(rows: DataFrame, number: str, trees: int, means) -> DataFrame:
    """Rows (t, cell, key, number) of (number, vec) for each tree; a cell is a vector length with the string's first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(0).to_numpy()
            for at, x in _by_length(batch.column(1)):
                mean = means.value.get(x.shape[1], np.zeros(x.shape[1]))
                for t in range(trees):
                    h = strings_of(x, t, mean)
                    cell = (h >> _U(_PLANES)).astype(np.int64) | (x.shape[1] << _FIRST)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), t, dtype=np.int32)), pa.array(cell), pa.array(h.view(np.int64)), pa.array(numbers[at])], ["t", "cell", "key", "number"])

    return rows.select(number, "vec").mapInArrow(run, "t int, cell long, key long, number long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple[np.ndarray, ...], list[np.ndarray]]]:
    """For each (t, cell, chunk) its sorted strings with their entries, and the rows of the queries that come after them.

    Yields ((keys, entries), query columns) once for each run of query rows; rows: t, cell, chunk, asks, key, number, length.
    """
    group, keys, entries, ready = None, [], [], None
    for batch in batches:
        t, cell, chunk, asks, key, number, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        if not len(t):
            continue
        edge = np.flatnonzero((np.diff(t) != 0) | (np.diff(cell) != 0) | (np.diff(chunk) != 0) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *edge], [*edge, len(t)], strict=True):
            own = (t[a], cell[a], chunk[a])
            if own != group:
                group, keys, entries, ready = own, [], [], None
            if asks[a]:
                if ready is None:
                    h = np.concatenate(keys).view(np.uint64) if keys else np.zeros(0, dtype=np.uint64)
                    order = np.argsort(h, kind="stable")
                    ready = h[order], (np.concatenate(entries) if entries else np.zeros(0, dtype=np.int64))[order]
                yield ready, key[a:b].view(np.uint64), number[a:b], length[a:b]
            else:
                keys.append(key[a:b])
                entries.append(number[a:b])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, counts): strings under a query's prefix of each length, summed over what the task sees."""
    total: dict[int, np.ndarray] = {}

    def sums() -> pa.RecordBatch:
        flat = np.concatenate(list(total.values())).astype(np.int64) if total else np.zeros(0, dtype=np.int64)
        ends = np.arange(len(total) + 1, dtype=np.int32) * len(_LENGTHS)
        return pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["q", "counts"])

    for (keys, _), h, q, _ in _groups(batches):
        low = np.searchsorted(keys, (h[:, None] & ~_MASKS).ravel())
        high = np.searchsorted(keys, (h[:, None] | _MASKS).ravel(), side="right")
        for number, n in zip(q.tolist(), (high - low).reshape(len(h), -1), strict=True):
            total[number] = total[number] + n if number in total else n
        if len(total) > 50_000:
            yield sums()
            total.clear()
    yield sums()


def _collect(parts: int):
    """(p, q, found): entries under a query's prefix, by the part of the vectors that they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys, entries), h, q, length in _groups(batches):
            mask = (_U(1) << (_BITS - length).astype(np.uint64)) - _U(1)
            low, high = np.searchsorted(keys, h & ~mask), np.searchsorted(keys, h | mask, side="right")
            for number, a, b in zip(q.tolist(), low.tolist(), high.tolist(), strict=True):
                if a < b:
                    e = np.sort(entries[a:b])
                    p = _part(e, parts)
                    order = np.argsort(p, kind="stable")
                    own, first = np.unique(p[order], return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), number)), pa.ListArray.from_arrays(pa.array(np.append(first, len(e)).astype(np.int32)), pa.array(e[order]))], ["p", "q", "found"])

    return run


def _part(e: np.ndarray, parts: int) -> np.ndarray:
    """The part of an entry, the same as ``_part_sql``: numbers of one task run on in their low bits."""
    return ((e & 0x1FFFFFFFF) + (e >> 33) * 7919) % parts


def _part_sql(parts: int) -> F.Column:
    return F.expr(f"cast(((e & 8589934591) + (e >> 33) * 7919) % {parts} as int)")


def _nearest(x: np.ndarray, members: list[list[int]], q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the ``k`` nearest, by distance and id, of vectors with their ids; the query's own id is left out."""
    far = np.sqrt(((x - q) ** 2).sum(axis=1))
    use = np.arange(len(far))
    if len(far) > k + 1:
        use = np.flatnonzero(far <= np.partition(far, k)[k])  # k + 1 vectors: one may be the query's own
    near = np.array([i for n in use for i in members[n]], dtype=np.int64)
    dist = np.repeat(far[use], [len(members[n]) for n in use])
    other = near != own
    near, dist = near[other], dist[other]
    best = np.lexsort((near, dist))[:k]
    return near[best], dist[best]


def _ranked(k: int):
    """(q, query_id, vec_id, score): a part's nearest; its entries come before the queries. Rows: p, asks, e, vec, ids, q, found; asks 2: all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ready = None, [], {}
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for p, asks, e, vec, ids, q, found in zip(*(c.to_pylist() if n != 6 else c for n, c in enumerate(batch.columns)), strict=True):
                if p != part:
                    part, held, ready = p, [], {}
                v = np.frombuffer(vec, dtype=np.float64)
                if not asks:
                    held.append((e, v, ids))
                    continue
                if held:
                    for n in {len(x) for _, x, _ in held}:
                        own = sorted((h for h in held if len(h[1]) == n), key=lambda h: h[0])
                        ready[n] = np.array([h[0] for h in own]), np.stack([h[1] for h in own]), [h[2] for h in own]
                    held = []
                if len(v) not in ready:
                    continue
                numbers, x, members = ready[len(v)]
                if asks == 1:
                    at = np.searchsorted(numbers, found.values.to_numpy())
                    x, members = x[at], [members[n] for n in at]
                near, dist = _nearest(x, members, v, ids[0], k)
                for column, values in zip(rows, ([q] * len(near), [ids[0]] * len(near), near.tolist(), dist.tolist()), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "query_id", "vec_id", "score"])

    return run


def _probe(entries: DataFrame, asked: DataFrame, k: int, trees: int, means, probes: int) -> list[tuple[int, int]]:
    """(q, length): of at most ``probes`` queries, picked by a hash, the nearest by brute force, each with the longest prefix that it shares with its query in some tree."""
    rows = asked.orderBy(F.xxhash64("vec", "id"), "id").limit(probes).select("q", "id", "vec").collect()
    at = [(r["q"], r["id"], np.frombuffer(r["vec"], dtype=np.float64)) for r in rows]
    strings = {q: [strings_of(v[None], t, means.value.get(len(v), np.zeros(len(v))))[0] for t in range(trees)] for q, _, v in at}
    sent = entries.sparkSession.sparkContext.broadcast((at, strings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, strings = sent.value
        for batch in batches:
            ids = batch.column(1).to_pylist()
            out: list[tuple] = []
            for place, x in _by_length(batch.column(0)) if batch.num_rows else ():
                mean = means.value.get(x.shape[1], np.zeros(x.shape[1]))
                best: list[tuple] = []
                for q, own, v in at:
                    if len(v) != x.shape[1]:
                        continue
                    far = np.sqrt(((x - v) ** 2).sum(axis=1))
                    far[[n for n in np.flatnonzero(far == 0) if ids[place[n]] == [own]]] = np.inf
                    near = np.argsort(far, kind="stable")[:k]
                    best += [(q, float(far[n]), int(n)) for n in near if far[n] < np.inf]
                used = np.unique([n for _, _, n in best]).astype(np.int64)
                h = np.stack([strings_of(x[used], t, mean) for t in range(trees)]) if len(used) else None
                for q, d, n in best:
                    differ = h[:, np.searchsorted(used, n)] ^ np.array(strings[q])
                    length = int(max(_BITS - int(y).bit_length() for y in differ))
                    out.append((q, d, length if length >= _FIRST else 0))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int32()))], ["q", "far", "length"])

    found = entries.select("vec", "ids").mapInArrow(run, "q long, far double, length int")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("far", "length"))).filter(F.col("rank") <= k)
    return [(r["q"], r["length"]) for r in found.collect()]


def _enough(counts: dict[int, list[int]], found: list[tuple[int, int]], target: float) -> int | None:
    """The least number of candidates with which the forest finds ``target`` of the probes' neighbours; None if no number does."""
    c = 64.0
    most = max((max(x) for x in counts.values()), default=0)
    while c <= 2 * most:
        length = {q: next((int(n) for n, x in zip(_LENGTHS, row, strict=True) if x >= c), 0) for q, row in counts.items()}
        if sum(n >= length.get(q, 0) for q, n in found) >= target * len(found):
            return int(c)
        c *= 2**0.25
    return None


def nearest(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, trees: int = 64, target: float = 0.93, candidates: int | None = None, probes: int = 128, sample_rows: int = 20_000, cell_rows: int = 200_000, part_rows: int = 50_000) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` nearest rows of ``df`` by Euclidean distance.

    ``candidates``: strings that a query ascends to at least; measured on ``probes`` queries for a recall of
    ``target`` if not given. Hashes are centred on the mean of about ``sample_rows`` vectors; every row is indexed.

    Rows that bear the query's id are its own and never its neighbours. Null ids and vectors that
    are null, empty, zero or hold null or non-finite components take no part, neither as rows
    nor as queries; vectors of another length than the query's aren't compared with it. Rows
    repeated with id and vector count once. Ties go to the smaller id. Empty tables give no rows;
    further columns are not looked at.
    """
    with scratch(df.sparkSession):
        return materialize(_search(df, queries, id_col, vector_col, k, trees, target, candidates, probes, sample_rows, cell_rows, part_rows), keep=True)


def _search(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, trees: int, target: float, candidates: int | None, probes: int, sample_rows: int, cell_rows: int, part_rows: int) -> DataFrame:
    spark = df.sparkSession
    entries = _entries(_sound(df, id_col, vector_col), k)
    asked = _sound(queries, id_col, vector_col).distinct().mapInArrow(_packed, "vec binary, ids array<long>").select("vec", F.explode("ids").alias("id"))
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()))
    n = entries.count()
    means = spark.sparkContext.broadcast(_means(entries, sample_rows))
    shuffle = shuffle_partitions(spark)
    index = materialize(_strings(entries, "e", trees, means))
    # a row for each tree and cell, so at most trees x 128 for each vector length
    cells = materialize(index.groupBy("t", "cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("chunks")), narrow=True)
    cells = small(cells)
    index = index.join(cells, ["t", "cell"]).withColumn("chunk", F.pmod(F.hash("number"), F.col("chunks"))).select("t", "cell", "chunk", F.lit(False).alias("asks"), "key", "number", F.lit(0).alias("length"))
    strings = materialize(_strings(asked, "q", trees, means).join(cells, ["t", "cell"]).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))))

    def met(lengths: DataFrame | None) -> DataFrame:
        rows = strings.withColumn("length", F.lit(0)) if lengths is None else strings.join(lengths, F.col("number") == F.col("q"))
        rows = index.union(rows.select("t", "cell", "chunk", F.lit(True), "key", "number", "length"))
        return rows.repartition(shuffle, "t", "cell", "chunk").sortWithinPartitions("t", "cell", "chunk", "asks")

    counts = met(None).mapInArrow(_count, "q long, counts array<long>").select("q", F.posexplode("counts").alias("step", "n"))
    counts = materialize(counts.groupBy("q", "step").agg(F.sum("n").alias("n")), narrow=True)
    if candidates is None:
        found = _probe(entries, asked, k, trees, means, probes)
        by_query: dict[int, list[int]] = {q: [0] * len(_LENGTHS) for q, _ in found}
        for r in counts.join(F.broadcast(spark.createDataFrame([(q,) for q in by_query], "q long")), "q").collect():  # of the probes alone
            by_query[r["q"]][r["step"]] = r["n"]
        candidates = _enough(by_query, found, target)
    least = candidates if candidates is not None else n + 1
    lengths = counts.filter(F.col("n") >= least).groupBy("q").agg((_BITS - F.min("step")).cast("int").alias("length"))
    lengths = materialize(lengths.filter(F.lit(trees * n >= least)), narrow=True)
    parts = max(shuffle, ceil_div(n, part_rows))
    near = met(lengths).mapInArrow(_collect(parts), "p int, q long, found array<long>")
    near = near.groupBy("p", "q").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")).withColumn("asks", F.lit(1))
    rest = asked.select("q").join(lengths, "q", "left_anti")  # too few under the first bits: held against all
    rest = rest.select(F.explode(F.expr(f"sequence(0, {parts - 1})")).alias("p"), "q", F.expr("cast(array() as array<long>)").alias("found"), F.lit(2).alias("asks"))
    near = near.unionByName(rest).join(asked, "q").select("p", "asks", F.lit(0).cast("long").alias("e"), "vec", F.array("id").alias("ids"), "q", "found")
    held = entries.select(_part_sql(parts).alias("p"), F.lit(0).alias("asks"), "e", "vec", "ids", F.lit(0).cast("long").alias("q"), F.expr("cast(array() as array<long>)").alias("found"))
    both = held.union(near).repartition(parts, "p").sortWithinPartitions("p", "asks")
    answers = both.mapInArrow(_ranked(k), "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    best = answers.withColumn("rank", F.row_number().over(order))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
