"""N-gram Jaccard join by parity sketches.

A document's shingles are dealt by hash into the blocks of a sketch; a block is the XOR of its
shingles' hashes, so a shingle that two documents share cancels out, and the number of blocks in
which two sketches differ is at most the symmetric difference of the sets. For each size band
the similarity bounds that difference by ``d``; with ``d + 1 + slack`` blocks two linked
documents agree in ``slack + 1`` of them (pigeonhole). As that is more than one, a document may
leave out its ``slack`` blocks of fewest shingles, which alone would match by chance.

Rows of equal blocks are found by sorting block numbers within hash partitions; only groups of
two or more go on. First each group's members are held against its first member, then, as long
as a group spans several components, each against its nearest members of other components that
are not yet refuted. A finer sketch of one parity bit per shingle bounds the difference from
below (Hamming distance) and drops most pairs before their sets are compared.

Documents of equal sets share one class number throughout, so copies never multiply. Shingles
are 64-bit numbers. A class number has 64 bits, and each set another 64 beside it: should two sets have one
class number and differ in the other or in size, all numbers are made anew with another seed, so
sets are told apart by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, batches_of, materialize, mix64, scratch, shuffle_partitions, small, strings
from .graph import components, extended

_U = np.uint64
_BATCH = 1 << 20
_BAND = 1.3
_SLACK = 0.25
_CHUNK = 4096


class Plan:
    """Size bands for documents of similarity ``num / den`` or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(n, 1)) / math.log(_BAND) + 1e-9).astype(np.int64)

    @lru_cache(maxsize=4096)  # noqa: B019
    def blocks(self, g: int) -> tuple[int, int, int]:
        """(blocks, slack, weak): blocks with ``weak`` or fewer shingles may be left out."""
        least = math.exp((g - 1e-9) * math.log(_BAND))
        low = max(1, math.ceil(least))
        top = max(low, math.ceil(math.exp((g + 1) * math.log(_BAND))) + 1)
        d = (self.den - self.num) * (top + top * self.den // self.num) // (self.den + self.num)
        slack = math.ceil(_SLACK * d) + (d > 0)
        k = d + 1 + slack
        mean = low / k
        weak, share = -1, 0.0
        for w in range(3):
            share += math.exp(-mean) * mean**w / math.factorial(w)
            if share * k + math.sqrt(share * k) <= slack:
                weak = w
        return k, slack, weak

    def most_different(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.den - self.num) * (a + b) // (self.den + self.num)


def shingle_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, shingles): each text's distinct shingles as 64-bit numbers, in order, one text after the other."""
    w = Words(texts, SPACED)
    h, n_texts = w.hashes, len(texts)
    owner = np.repeat(np.arange(n_texts, dtype=np.int64), w.per_text)
    keys = []
    with np.errstate(over="ignore"):
        if len(h) >= k:
            s = np.zeros(len(h) - k + 1, dtype=np.uint64)
            for i in range(k):
                s = s * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
            same = owner[: len(s)] == owner[k - 1 :]
            keys.append((owner[: len(s)][same], mix64(s[same])))
        short = np.flatnonzero((w.per_text > 0) & (w.per_text < k))
        if len(short):
            one = np.zeros(len(short), dtype=np.uint64)
            for j, t in enumerate(short):
                for x in h[w.first[t] : w.first[t + 1]]:
                    one[j] = one[j] * _U(0x9E3779B97F4A7C15) + x
            keys.append((short, mix64(one ^ (w.per_text[short].astype(np.uint64) << _U(56)))))
    if not keys:
        return np.zeros(n_texts, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    own = np.concatenate([x for x, _ in keys])
    low = np.concatenate([x for _, x in keys])
    order = np.argsort(low)
    order = order[np.argsort(own[order].astype(np.uint16) if n_texts < 1 << 16 else own[order], kind="stable")]
    own, low = own[order], low[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (low[1:] != low[:-1])])
    own, low = own[new], low[new]
    return np.bincount(own, minlength=n_texts), low


def class_numbers(sizes: np.ndarray, flat: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit number per set; empty sets get 0. Other seeds give unrelated numbers."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        begin = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix64(flat ^ mix64(np.array([seed + 0x51ED27], dtype=np.uint64))), begin)
        out[some] = mix64(total ^ sizes[some].astype(np.uint64)) | _U(1)
    return out


def bit_sketches(sizes: np.ndarray, flat: np.ndarray) -> list[bytes]:
    """One parity bit per shingle in about four times as many bits, a power of two of 64-bit words."""
    words = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(sizes, 1) * 4 / 64)).clip(0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(int(begin[-1]), dtype=np.uint64)
    h = mix64(flat + _U(0xB5297A4D))
    bit = h & (np.repeat(words, sizes).astype(np.uint64) * _U(64) - _U(1))
    at = np.repeat(begin[:-1], sizes) + (bit >> _U(6)).astype(np.int64)
    np.bitwise_xor.at(out, at, _U(1) << (bit & _U(63)))
    raw = out.tobytes()
    return [raw[8 * a : 8 * b] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def hamming(a: bytes | np.ndarray, b: bytes | np.ndarray) -> int:
    """Distance of two sketches; the longer is folded onto the shorter, which keeps parities."""
    x, y = (np.frombuffer(v, dtype=np.uint64) if isinstance(v, bytes) else v for v in (a, b))
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)))
    elif len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)))
    return int(np.bitwise_count(x ^ y).sum())


def block_keys(plan: Plan, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set's place, key) of all blocks to match on."""
    if not len(flat):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first_band, last_band = plan.band(np.ceil(sizes * plan.num / plan.den)), plan.band(sizes)
    h = mix64(flat + _U(0x2545F491))
    start = np.concatenate([[0], np.cumsum(sizes)])
    owners, keys = [], []
    for step in range(int((last_band - first_band).max()) + 1):
        g = first_band + step
        use = np.flatnonzero((g <= last_band) & (sizes > 0))
        if not len(use):
            continue
        shape = np.array([plan.blocks(int(x)) for x in g[use]], dtype=np.int64)
        k, slack, weak = shape.T
        base = np.concatenate([[0], np.cumsum(k)])
        if len(use) == len(sizes):
            hs, reps = h, sizes
        else:
            mask = np.zeros(len(sizes), dtype=bool)
            mask[use] = True
            hs, reps = h[np.repeat(mask, sizes)], sizes[use]
        at = np.repeat(base[:-1], reps) + ((hs >> _U(32)) % np.repeat(k, reps).astype(np.uint64)).astype(np.int64)
        block = np.zeros(int(base[-1]), dtype=np.uint64)
        np.bitwise_xor.at(block, at, hs)
        filled = np.bincount(at, minlength=len(block))
        of = np.repeat(np.arange(len(use)), k)
        thin = filled <= np.repeat(weak, k)
        spare = np.bincount(of, weights=thin, minlength=len(use)) <= slack
        keep = ~(thin & spare[of])
        number = np.arange(len(block)) - base[of]
        with np.errstate(over="ignore"):
            tag = g[use][of].astype(np.uint64) * _U(0x9E3779B97F4A7C15) + number.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
        owners.append(use[of[keep]])
        keys.append(mix64(block[keep] ^ mix64(tag[keep])))
    del start
    return np.concatenate(owners), np.concatenate(keys)


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def describe(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Rows (id, n, cls, other, sketch) of every document (id, text); ``other``: a second number of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text", _BATCH):
            sizes, flat = shingle_sets(strings(batch.column(1)), k)
            numbers = [_i64(class_numbers(sizes, flat, s)) for s in (seed, ~seed & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *numbers, pa.array(bit_sketches(sizes, flat), type=pa.binary())], ["id", "n", "cls", "other", "sketch"])

    return df.mapInArrow(run, f"id {dict(df.dtypes)['id']}, n long, cls long, other long, sketch binary")


def _classes(docs: DataFrame, k: int, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """``describe``'s rows, the least id of each class, and the seed with which no two sets share a class."""
    while True:
        all_docs = materialize(describe(docs, k, seed))
        firsts = all_docs.filter("n > 0").groupBy("cls").agg(F.min("id").alias("id"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("n", "other")))
        firsts = materialize(firsts)
        if firsts.filter("min_n <> max_n OR min_other <> max_other").isEmpty():
            return all_docs, firsts.select("cls", "id"), seed
        seed += 1


def _matching_blocks(df: DataFrame, k: int, plan: Plan, seed: int) -> DataFrame:
    """Rows (members): the classes, in order, of every block number that two or more classes have.

    Keys travel in arrays, one for each batch of texts and hash partition, and are matched by a
    sort in the partition.
    """
    spark = df.sparkSession
    parts = shuffle_partitions(spark)
    # a value for every partition that Spark's hash sends just there
    ids = spark.range(parts * 40).select(F.col("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"))
    send_to = {r["p"]: r["v"] for r in ids.groupBy("p").agg(F.min("id").alias("v")).collect()}
    values = np.array([send_to.get(p, p) for p in range(parts)], dtype=np.int32)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches_of(batches, "text", _BATCH):
            sizes, flat = shingle_sets(strings(batch.column(1)), k)
            cls = class_numbers(sizes, flat, seed)
            fresh = np.zeros(len(cls), dtype=bool)  # each class once a task
            for j, c in enumerate(cls.tolist()):
                if c and c not in done:
                    done.add(c)
                    fresh[j] = True
            flat, sizes = flat[np.repeat(fresh, sizes)], np.where(fresh, sizes, 0)
            owner, key = block_keys(plan, sizes, flat)
            if not len(key):
                continue
            dest = (key % _U(parts)).astype(np.int64)
            order = np.lexsort((owner, dest))
            dest, number = dest[order], cls.view(np.int64)[owner[order]]
            first = np.concatenate([[True], (dest[1:] != dest[:-1]) | (number[1:] != number[:-1])])
            head = np.flatnonzero(first)
            n = np.diff(np.concatenate([head, [len(dest)]]))
            to, runs = np.unique(dest[head], return_counts=True)
            _, held = np.unique(dest, return_counts=True)
            ends = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
            columns = [pa.array(values[to]), pa.ListArray.from_arrays(ends(runs), pa.array(number[head])), pa.ListArray.from_arrays(ends(runs), pa.array(n)), pa.ListArray.from_arrays(ends(held), _i64(key[order]))]
            yield pa.RecordBatch.from_arrays(columns, ["p", "cls", "n", "keys"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, keys = [], []
        for b in batches:
            c, n, x = (b.column(i).flatten().to_numpy() for i in (1, 2, 3))
            owners.append(np.repeat(c, n))
            keys.append(x)
        if not keys:
            return
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([head, [len(key)]]))
        seen: set[bytes] = set()
        out: list[np.ndarray] = []
        for a, c in zip(head[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            members = np.unique(owner[order[a : a + c]])
            if len(members) > 1 and (tag := members.tobytes()) not in seen:
                seen.add(tag)
                out.append(members)
        for a in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[a : a + 20_000], type=pa.list_(pa.int64()))], ["members"])

    sent = df.select("id", "text").mapInArrow(emit, "p int, cls array<long>, n array<long>, keys array<long>")
    return sent.repartition(parts, "p").mapInArrow(match, "members array<long>")


def _refute(pairs: DataFrame, about: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that sizes and bit sketches don't rule out."""
    x, y = (about.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, sa, nb, sb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "n_a", "s_a", "n_b", "s_b"))
            most = plan.most_different(na.to_numpy(), nb.to_numpy())
            keep = [hamming(p, q) <= m for p, q, m in zip(sa.to_pylist(), sb.to_pylist(), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    near = pairs.join(x, "a").join(y, "b").filter(f"least(n_a, n_b) * {plan.den} >= greatest(n_a, n_b) * {plan.num}")
    return near.mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, k: int, plan: Plan, seed: int) -> DataFrame:
    """Rows (a, b, linked) by comparing whole sets, made anew from the texts of the classes at hand."""
    ends = pairs.selectExpr("a as cls").union(pairs.selectExpr("b")).distinct()
    sets = materialize(_sets(docs, materialize(ends.join(firsts, "cls").select("id").distinct(), narrow=True), k, seed))
    sets = sets.join(small(materialize(ends, narrow=True)), "cls", "left_semi")
    x, y = (sets.select(F.col("cls").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "s_a", "s_b"))
            linked = []
            for p, q in zip(sa, sb, strict=True):
                p, q = p.values.to_numpy(), q.values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(plan.den * both >= plan.num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(linked, type=pa.bool_())], ["a", "b", "linked"])

    return pairs.join(x, "a").join(y, "b").mapInArrow(run, "a long, b long, linked boolean").distinct()


def _sets(docs: DataFrame, ids: DataFrame, k: int, seed: int) -> DataFrame:
    """Rows (cls, shingles) of the documents whose id is in ``ids`` or null, each class once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches_of(batches, "text", _BATCH):
            sizes, flat = shingle_sets(strings(batch.column(1)), k)
            cls = class_numbers(sizes, flat, seed).view(np.int64)
            parts = np.split(flat.view(np.int64), np.cumsum(sizes)[:-1])
            fresh = [n for n, c in enumerate(cls.tolist()) if c not in done and not done.add(c)]
            yield pa.RecordBatch.from_arrays([pa.array(cls[fresh]), pa.array([parts[n] for n in fresh], type=pa.list_(pa.int64()))], ["cls", "shingles"])

    found = docs.join(small(ids), "id", "left_semi").union(docs.filter("id IS NULL")).select("id", "text")
    return found.mapInArrow(run, "cls long, shingles array<long>")


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (g, lo, hi) at a time, of rows sorted by these; a group may go over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("g", "lo", "hi")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[:, a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _next_pairs(groups: DataFrame, about: DataFrame, comp: DataFrame, refuted: DataFrame, plan: Plan, nearest: int) -> DataFrame:
    """For groups that span components: rows (g, open, a, b).

    ``open``: members with a pair across components that is neither ruled out nor refuted; others are
    settled for good. ``a``, ``b``: the ``nearest`` such pairs of each member outside the chunk's largest
    component; every pair across components has an end there. Groups are cut into chunks of about
    ``_CHUNK`` members and compared chunk against chunk, so no task holds more than two chunks of
    a group. Groups, most of which are small, go to a task one after the other in batches of many,
    not as an Arrow stream each.
    """
    rows = groups.withColumn("parts", F.ceil(F.size("members") / _CHUNK).cast("int")).select("g", "parts", F.explode("members").alias("cls"))
    rows = rows.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = rows.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("g")
    rows = rows.join(mixed, "g", "left_semi").withColumn("c", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    rows = rows.join(about, "cls").join(refuted, "cls", "left")
    side = F.explode(F.expr("transform(sequence(0, parts - 1), o -> struct(least(c, o) as lo, greatest(c, o) as hi))"))
    rows = rows.select("g", "cls", "comp", "n", "sketch", "no", side.alias("pair")).select("g", "pair.*", "cls", "comp", "n", "sketch", "no")
    lists = pa.list_(pa.int64())

    def across(table: pa.Table) -> pa.RecordBatch | None:
        cls, comp, n = (table.column(c).to_numpy() for c in ("cls", "comp", "n"))
        no = table.column("no").to_pylist()
        sketch = [np.frombuffer(s, dtype=np.uint64) for s in table.column("sketch").to_pylist()]
        width = min(map(len, sketch))
        m = np.stack([np.bitwise_xor.reduce(s.reshape(-1, width)) for s in sketch])
        open_, a, b = np.zeros(len(cls), dtype=bool), [], []
        kinds, size = np.unique(comp, return_counts=True)
        for i in np.flatnonzero(comp != kinds[size.argmax()]):
            others = np.flatnonzero((comp != comp[i]) & (np.minimum(n, n[i]) * plan.den >= np.maximum(n, n[i]) * plan.num))
            far = np.bitwise_count(m[others] ^ m[i]).sum(axis=1)
            near = far <= plan.most_different(n[others], n[i])
            if no[i]:
                near &= ~np.isin(cls[others], no[i])
            others, far = others[near], far[near]
            if len(others):
                for j in others[np.argsort(far, kind="stable")[:nearest]]:
                    a.append(min(cls[i], cls[j]))
                    b.append(max(cls[i], cls[j]))
                open_[i] = True
                open_[others] = True
        if not a:
            return None
        columns = [pa.array([table.column("g")[0].as_py()]), *(pa.array([x], type=lists) for x in (cls[open_], a, b))]
        return pa.RecordBatch.from_arrays(columns, ["g", "open", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups_of(batches):
            if (found := across(table)) is not None:
                yield found

    keys = ("g", "lo", "hi")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "g long, open array<long>, a array<long>, b array<long>")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows (id_col, n_shingles, component_id), one per row of ``df``.

    Two documents link when ``den`` times their common shingles of ``k`` words are at least ``num``
    times their union; component_id is the least id that links reach. Texts of fewer words are one
    shingle; null and blank texts have none and link with nothing. Repeated rows and copies are
    one class. Null ids take part in links but are never the least id, unless alone.
    """
    with scratch(df.sparkSession):
        return _components(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), id_col, k, Plan(num, den))


def _components(docs: DataFrame, id_col: str, k: int, plan: Plan) -> DataFrame:
    all_docs, firsts, seed = _classes(docs, k)
    some = all_docs.filter("n > 0")
    about = some.dropDuplicates(["cls"]).select("cls", "n", "sketch")
    groups = materialize(_matching_blocks(docs, k, plan, seed))
    stars = groups.select(F.col("members")[0].alias("a"), F.explode(F.expr("slice(members, 2, size(members))")).alias("b")).distinct()
    pairs = materialize(_refute(stars, about, plan))
    large = groups.filter("size(members) > 2").distinct().withColumn("g", F.xxhash64("members"))
    in_play = pairs.selectExpr("a as cls").union(pairs.selectExpr("b")).union(large.select(F.explode("members"))).distinct()
    about = materialize(in_play.join(about, "cls"))
    checked = materialize(_verify(pairs, docs, firsts, k, plan, seed))
    large = materialize(large)
    comp, refuted = components(checked.filter("linked")), checked.filter("NOT linked")
    nearest = 1  # most links join components at once; what is left then are pairs just under the threshold
    while True:
        no = refuted.union(refuted.select("b", "a", "linked")).groupBy(F.col("a").alias("cls")).agg(F.collect_list("b").alias("no"))
        more = materialize(_next_pairs(large, about, comp, no, plan, nearest))
        if more.isEmpty():
            break
        nearest *= 8
        large = more.groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list("open"))).alias("members"))
        pairs = more.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b").distinct()
        checked = materialize(_verify(pairs, docs, firsts, k, plan, seed))
        comp, refuted = extended(comp, checked.filter("linked")), refuted.union(checked.filter("NOT linked"))
    labelled = all_docs.select("id", "n", "cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = firsts.join(comp.withColumnRenamed("node", "cls"), "cls", "left").groupBy(F.coalesce("comp", "cls").alias("comp")).agg(F.min("id").alias("least"))
    out = labelled.join(least, "comp", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return materialize(out, keep=True)
