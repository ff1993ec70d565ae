"""Removal of repeated substrings by prefix-free parsing.

A rolling hash over windows of ``TRIGGER`` bytes picks triggers: the trigger of a string of ``SPAN``
bytes is its window of least hash. Neighbouring strings with one trigger make a phrase, so a text
is parsed into phrases that overlap by ``SPAN - 1`` bytes. A trigger depends on its string alone: equal
strings lie in phrases of equal triggers at equal distances, and no phrase's strings are part of
the next one's, which makes the parse prefix-free with respect to strings of ``SPAN`` bytes.

The dictionary holds each distinct phrase once, however often it occurs; the parse holds the
phrase's number (128 bits of BLAKE2b) for each of its places. A string repeats if its phrase is twice in the
parse, or if another phrase of the dictionary has it. For the latter, the dictionary is sorted two ways
per trigger: by what follows (suffixes, forwards) and by what precedes (prefixes, backwards), each
with the lengths that neighbours share. Strings that start ``o`` bytes before the trigger are
neighbours in corpus order and share ``SPAN`` bytes where both orders agree, to ``o`` and to ``SPAN - o``.
What a phrase learns so goes back to all its places in the parse.

Only triggers that occur twice are looked at: their hashes are matched first, once for each unit of
neighbouring rows. Where more than ``group_rows`` distinct phrases share a trigger, the range of ``o``
is halved and each half's phrases are grouped by the bytes that its strings must share, again and
again; at a single ``o`` a group's phrases share the string itself and need only be counted. So no
task holds more than a group of that size, whatever passage is common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, materialize, mix64, scratch, shuffle_partitions, small

SPAN = 200
TRIGGER = 64
LEFT = SPAN - TRIGGER
_RUN = SPAN - TRIGGER + 1
_SEGMENT = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_U = np.uint64
_BYTES = mix64(np.arange(11, 267, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_STEP = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)]


def window_hashes(a: np.ndarray) -> np.ndarray:
    """Hashes of all windows of ``TRIGGER`` bytes, by doubling."""
    h, size = _BYTES[a], 1
    with np.errstate(over="ignore"):
        for c in _STEP:
            if len(h) <= size:
                return h[:0]
            h = h[:-size] * c + h[size:]
            size *= 2
    return mix64(h)


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's phrases: (first string's start, last string's start, trigger's place, trigger's hash)."""
    starts, places, hashes = [], [], []
    for base in range(0, len(raw) - SPAN + 1, _SEGMENT):  # segments share SPAN - 1 bytes
        a = np.frombuffer(raw, dtype=np.uint8, offset=base, count=min(len(raw) - base, _SEGMENT + SPAN - 1))
        h = window_hashes(a)
        n = len(h)
        key = (h & ~_PLACE) | (_PLACE - np.arange(n, dtype=np.uint64))  # of equal hashes the last
        padded = np.full(-(-n // _RUN) * _RUN, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:n] = key
        rows = padded.reshape(-1, _RUN)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - _RUN + 1], ahead[_RUN - 1 : n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        at = (_PLACE - (least[first] & _PLACE)).astype(np.int64)
        starts.append(first + base)
        places.append(at + base)
        hashes.append(h[at])
    if not starts:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    start, place, h = np.concatenate(starts), np.concatenate(places), np.concatenate(hashes)
    new = np.concatenate([[True], place[1:] != place[:-1]])  # a phrase may go on in the next segment
    start, place, h = start[new], place[new], h[new]
    return start, np.append(start[1:] - 1, len(raw) - SPAN), place, h


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row, at most ``most``."""
    differs = a != b
    first = differs.argmax(axis=1)
    return np.minimum(np.where(differs.any(axis=1), first, a.shape[1]), most)


def _sorted_common(g: np.ndarray, text: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and shared lengths: the order by (group, text), and what each row shares with the one before."""
    key = np.concatenate([g.astype(">u4").view(np.uint8).reshape(-1, 4), text, have.astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), kind="stable")
    t, n, g = text[order], have[order], g[order]
    shared = np.full(len(g), -1, dtype=np.int64)
    shared[1:] = np.where(g[1:] == g[:-1], _common(t[1:], t[:-1], np.minimum(n[1:], n[:-1])), -1)
    return order, shared


def repeated(g: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) distance before its trigger, from ``low`` to ``high``, at which each phrase has a string that another of its group has; -1 for none.

    ``left``: the bytes before the trigger, backwards; ``right``: those from it on.
    """
    m = len(g)
    least, most = np.full(m, -1, dtype=np.int64), np.full(m, -1, dtype=np.int64)
    l_order, l_shared = _sorted_common(g, left, n_left)
    r_order, r_shared = _sorted_common(g, right, n_right)
    l_class, r_class = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        whole = np.flatnonzero((n_left >= o) & (n_right >= SPAN - o) & (low <= o) & (o <= high))
        if len(whole) < 2:
            continue
        l_class[l_order] = np.cumsum(l_shared < o)
        r_class[r_order] = np.cumsum(r_shared < SPAN - o)
        pair = l_class[whole] * (m + 1) + r_class[whole]
        order = np.argsort(pair, kind="stable")
        same = np.diff(pair[order]) == 0
        hit = whole[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        most[hit] = o
        least[hit] = np.where(least[hit] < 0, o, least[hit])
    return least, most


def _pairs_repeated(g: np.ndarray, left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``repeated`` for groups of two."""
    l = _common(left[::2], left[1::2], np.minimum(n_left[::2], n_left[1::2]))  # noqa: E741
    r = _common(right[::2], right[1::2], np.minimum(n_right[::2], n_right[1::2]))
    least, most = np.maximum(SPAN - r, low[::2]), np.minimum(l, high[::2])
    ok = least <= most
    return np.repeat(np.where(ok, least, -1), 2), np.repeat(np.where(ok, most, -1), 2)


_GROUPED = "key binary, low int, high int, phrase_id binary, n_left int, phrase binary"
_FOUND = "phrase_id binary, least int, most int"


def _of_groups(rows: list[tuple]) -> pa.RecordBatch:
    """Repeated strings of whole groups, whose rows come one after the other."""
    key, low, high, numbers, n_left, phrases = zip(*rows, strict=True)
    m = len(key)
    g = np.cumsum(np.fromiter((k > 0 and key[k] != key[k - 1] for k in range(m)), dtype=np.int64, count=m))
    low, high, n_left = (np.array(x, dtype=np.int64) for x in (low, high, n_left))
    size = np.fromiter(map(len, phrases), dtype=np.int64, count=m)
    both = np.zeros((m, LEFT + SPAN), dtype=np.uint8)
    data = np.frombuffer(b"".join(phrases), dtype=np.uint8)
    column = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(LEFT - n_left, size)
    both[np.repeat(np.arange(m), size), column] = data
    left, right = both[:, :LEFT][:, ::-1], both[:, LEFT:]
    count = np.bincount(g)[g]
    least, most = np.full(m, -1, dtype=np.int64), np.full(m, -1, dtype=np.int64)
    for use, f in ((count == 2, _pairs_repeated), (count > 2, repeated)):
        if use.any():
            least[use], most[use] = f(*(x[use] for x in (g, left, n_left, right, size - n_left, low, high)))
    hit = np.flatnonzero(most >= 0)
    return pa.RecordBatch.from_arrays([pa.array([numbers[k] for k in hit], type=pa.binary()), pa.array(least[hit], type=pa.int32()), pa.array(most[hit], type=pa.int32())], ["phrase_id", "least", "most"])


def _match_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their keys; groups are put together across batches."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        if len(held) < 20_000:
            continue
        cut = len(held) - 1
        while cut and held[cut - 1][0] == held[-1][0]:
            cut -= 1
        if cut:
            yield _of_groups(held[:cut])
            held = held[cut:]
    if held:
        yield _of_groups(held)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row in the halves of its range of distances in which it has strings; a half's key are the bytes that they share."""
    for batch in batches:
        rows = []
        for low, high, number, n_left, phrase in zip(*(c.to_pylist() for c in batch.select(["low", "high", "phrase_id", "n_left", "phrase"]).columns), strict=True):
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                if n_left >= a and len(phrase) - n_left >= SPAN - b:
                    shared = phrase[n_left - a : n_left + SPAN - b]
                    rows.append((hashlib.blake2b(shared, digest_size=16, salt=bytes((a, b))).digest(), a, b, number, n_left, phrase))
        if rows:
            types = [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "low", "high", "phrase_id", "n_left", "phrase"])


def _shared_strings(rows: DataFrame, group_rows: int) -> DataFrame:
    """Rows (phrase_id, least, most) of phrases that share strings with others; ``rows``: (key, low, high, phrase_id, n_left, phrase)."""
    parts, found = shuffle_partitions(rows.sparkSession), []
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        rows = materialize(rows.join(sizes, "key"))
        alike = F.col("low") == F.col("high")  # the key is the string itself
        found.append(rows.filter(alike).select("phrase_id", F.col("low").alias("least"), F.col("low").alias("most")))
        rest = rows.filter(~alike)
        near = rest.filter(F.col("size") <= group_rows).drop("size").repartition(parts, "key").sortWithinPartitions("key")
        found.append(near.mapInArrow(_match_groups, _FOUND))
        rows = rest.filter(F.col("size") > group_rows)
        if rows.isEmpty():
            break
        rows = materialize(rows.mapInArrow(_halves, _GROUPED))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.groupBy("phrase_id").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def _repeated_triggers(texts: DataFrame) -> DataFrame:
    """Rows (unit, hashes): the triggers' hashes of each unit that occur twice in all; texts (unit, text).

    A unit sends a hash once, or twice if it has it twice, so that a common one travels once per
    unit, not once per place. Equal numbers of different triggers only mean work, no results.
    """
    spark = texts.sparkSession
    parts = shuffle_partitions(spark)
    ids = spark.range(parts * 40).select(F.col("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
    send_to = {r["p"]: r["v"] for r in ids.groupBy("p").agg(F.min("id").alias("v")).collect()}
    values = [send_to.get(p, p) for p in range(parts)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, size = None, [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            h, n = np.unique(np.concatenate(held), return_counts=True)
            h = np.repeat(h, np.minimum(n, 2))
            dest = (h % _U(parts)).astype(np.int64)
            order = np.argsort(dest, kind="stable")
            ends = np.cumsum(np.bincount(dest, minlength=parts))
            rows = [(values[p], unit, h[o].view(np.int64)) for p, o in enumerate(np.split(order, ends[:-1])) if len(o)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["p", "unit", "hashes"])

        for batch in batches:
            for u, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if u != unit or size > 2_000_000:
                    yield from sent()
                    unit, held, size = u, [], 0
                held.append(parse(text.encode("utf-8", "surrogatepass"))[3])
                size += len(held[-1])
        yield from sent()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, hashes = [], []
        for b in batches:
            column = b.column(2)
            units.append(np.repeat(b.column(1).to_numpy(), np.diff(column.offsets.to_numpy())))
            hashes.append(column.flatten().to_numpy())
        if not units:
            return
        unit, h = np.concatenate(units), np.concatenate(hashes)
        _, of, n = np.unique(h, return_inverse=True, return_counts=True)
        twice = n[of] > 1
        unit, h = unit[twice], h[twice]
        order = np.lexsort((h, unit))
        unit, h = unit[order], h[order]
        new = np.concatenate([[True], (unit[1:] != unit[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, dtype=bool)
        unit, h = unit[new], h[new]
        own, first = np.unique(unit, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(own, type=pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(first, len(h)), type=pa.int32()), pa.array(h, type=pa.int64()))], ["unit", "hashes"])

    return texts.mapInArrow(emit, "p int, unit long, hashes array<long>").repartition(parts, "p").mapInArrow(match, "unit long, hashes array<long>")


_PARSED = pa.schema([("key", pa.binary()), ("phrase_id", pa.binary()), ("n_left", pa.int32()), ("phrase", pa.binary()), ("rows", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of texts about repeated triggers, each distinct one of a batch once with its places.

    Rows (unit, hashes, r, text) in order of units, a unit's hashes before its texts.
    """
    unit, known = None, np.zeros(0, dtype=np.int64)
    for batch in batches_of(batches, "text", 2 << 20):
        found: dict[bytes, tuple] = {}
        for u, hashes, r, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if u != unit:
                unit, known = u, np.zeros(0, dtype=np.int64)
            if text is None:
                known = np.union1d(known, hashes.values.to_numpy())
                continue
            raw = text.encode("utf-8", "surrogatepass")
            start, end, place, h = parse(raw)
            use = np.isin(h.view(np.int64), known)
            for a, b, t, x in zip(start[use].tolist(), end[use].tolist(), place[use].tolist(), h[use].tolist(), strict=True):
                phrase = raw[a : b + SPAN]
                number = hashlib.blake2b(phrase, digest_size=16, salt=(t - a).to_bytes(2)).digest()
                if (seen := found.get(number)) is None:
                    found[number] = seen = (x.to_bytes(8), number, t - a, phrase, [], [])
                seen[4].append(r)
                seen[5].append(a)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found.values(), strict=True), _PARSED, strict=True)], schema=_PARSED)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 20_000) -> DataFrame:
    """Rows (id_col, n_bytes, text, runs, whole_sha256), one per row of ``df``.

    ``runs``: maximal runs of bytes, end exclusive, that strings of SPAN bytes cover which also start
    elsewhere in the table, in the same text or another; ``text`` is null where there are none.
    Null, empty and short texts have no runs; long ones are read whole. Texts equal in length and
    SHA-256, and so repeated rows, cover each other wholly if they have SPAN bytes; null ids are
    ids like others. An empty table gives no rows; further columns are not looked at.
    """
    with scratch(df.sparkSession):
        return _repeated_spans(df, id_col, text_col, group_rows)


def _repeated_spans(df: DataFrame, id_col: str, text_col: str, group_rows: int) -> DataFrame:
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("r"))
    docs = docs.select("id", "r", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    docs = materialize(docs, keep=True)
    long_docs = docs.filter(F.col("n_bytes") >= SPAN)
    copies = materialize(long_docs.groupBy("sha", "n_bytes").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), narrow=True)
    alike = materialize(long_docs.select("r", "sha", "n_bytes").join(small(copies, 200_000), ["sha", "n_bytes"]).select("r", (F.col("r") == F.col("first")).alias("goes_on")), narrow=True)
    # of equal texts one goes on, for others to be held against; 256 neighbouring rows are a unit
    once = long_docs.join(small(alike.filter("NOT goes_on").select("r")), "r", "left_anti").select(F.expr("r >> 8").alias("unit"), "r", "text")
    hashes = _repeated_triggers(once.select("unit", "text"))
    asked = hashes.selectExpr("unit", "hashes", "cast(null as long) as r", "cast(null as string) as text")
    asked = asked.union(once.selectExpr("unit", "cast(null as array<long>)", "r", "text")).withColumn("is_text", F.col("text").isNotNull())
    asked = asked.repartition(parts, "unit").sortWithinPartitions("unit", "is_text")
    parsed = materialize(asked.select("unit", "hashes", "r", "text").mapInArrow(_phrases, "key binary, phrase_id binary, n_left int, phrase binary, rows array<long>, starts array<long>"))
    dictionary = parsed.groupBy("key", "phrase_id").agg(F.sum(F.size("rows")).alias("n"), F.first("n_left").alias("n_left"), F.first("phrase").alias("phrase"))
    dictionary = materialize(dictionary)
    edges = _shared_strings(dictionary.selectExpr("key", "0 as low", f"{LEFT} as high", "phrase_id", "n_left", "phrase"), group_rows)
    twice = dictionary.filter("n > 1").selectExpr("phrase_id", "cast(0 as long) as a", "cast(length(phrase) as long) as b")
    edges = edges.join(dictionary.filter("n = 1").select("phrase_id", "n_left"), "phrase_id").selectExpr("phrase_id", "cast(n_left - most as long) as a", f"cast(n_left - least + {SPAN} as long) as b")
    found = materialize(twice.union(edges))
    spans = parsed.select("phrase_id", "rows", "starts").join(found, "phrase_id").select(F.explode(F.arrays_zip("rows", "starts")).alias("x"), "a", "b")
    spans = spans.selectExpr("x.rows as r", "x.starts + a as start", "x.starts + b as end")
    # maximal runs: a span that starts beyond all before it begins one
    before = Window.partitionBy("r").orderBy("start", "end")
    spans = spans.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1).cast("long"))).cast("int"))
    spans = spans.withColumn("run", F.sum("new").over(before)).groupBy("r", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = spans.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    runs = materialize(runs, keep=True)
    whole = materialize(alike.select("r", F.lit(True).alias("whole")), narrow=True, keep=True)
    out = docs.join(small(whole), "r", "left").join(runs, "r", "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    out = out.withColumn("runs", F.when(F.col("whole"), all_of_it).otherwise(F.coalesce("runs", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))))
    return out.select(F.col("id").alias(id_col), "n_bytes", F.when(F.size("runs") > 0, F.col("text")).alias("text"), "runs", F.lower(F.hex("sha")).alias("whole_sha256"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``repeated_spans``' rows, one each; texts without runs are kept whole, null and empty ones are no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, sha = [], [], []
            for text, runs, whole in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                removed.append(sum(r["end"] - r["start"] for r in runs))
                spans.append(len(runs))
                if runs:
                    raw, digest_, at = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0
                    for r in runs:
                        digest_.update(raw[at : r["start"]])
                        at = r["end"]
                    digest_.update(raw[at:])
                    whole = digest_.hexdigest()
                sha.append(whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, type=pa.int64()), pa.array(spans, type=pa.int64()), pa.array(sha, type=pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
