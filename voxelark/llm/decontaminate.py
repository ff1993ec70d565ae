"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of ``window`` words (an item of fewer words is one pattern).
A shift table over blocks of two words tells how far the search may jump when the block at hand
ends nowhere near a pattern; a block that ends patterns selects a bucket, split by the pattern's
first word; word-for-word comparison confirms. Patterns shorter than the window are searched in
a second pass with tables of their own, so they don't shorten the jumps of the others.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, ceil_div, materialize, strings


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split()


class WuManber:
    """Finds all of ``patterns`` (tuples of words) in lists of words."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = b = min(2, m)
        self.jump = m - b + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(lambda: defaultdict(list))
        for k, p in enumerate(patterns):
            for end in range(b, m + 1):
                key = p[end - b : end] if b > 1 else p[end - 1]
                if self.shift.get(key, self.jump) > m - end:
                    self.shift[key] = m - end
            self.buckets[key][p[0]].append(k)
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        m, jump, shift, buckets, pairs = self.m, self.jump, self.shift, self.buckets, self.block > 1
        at, n = m - 1, len(words)
        while at < n:
            key = (words[at - 1], words[at]) if pairs else words[at]
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            start = at - m + 1
            for k in buckets[key].get(words[start], ()):
                p = self.patterns[k]
                if tuple(words[start : start + len(p)]) == p:
                    yield start, k
            at += 1


class Matcher:
    """Windows of the items and the searches for them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                owners[tuple(w[i : i + window])].add(item)
        self.searches = []
        for group in ([p for p in owners if len(p) == window], [p for p in owners if len(p) < window]):
            if group:
                self.searches.append((WuManber(group), [sorted(owners[p]) for p in group]))

    def hits(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, maximal runs of hit words and the items with occurring windows."""
        words, found, items, seen = words_of(text), [], set(), set()
        for search, owners in self.searches:
            for start, k in search.find(words):
                found.append((start, start + len(search.patterns[k])))
                if (id(search), k) not in seen:
                    seen.add((id(search), k))
                    items.update(owners[k])
        return len(words), merged(found), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RUNS = "array<struct<start:long,end:long>>"


def find_leaks(df: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """``columns`` of ``df`` with n_words, hit_runs (word numbers, end exclusive) and items.

    The items go to every task, and so are split into blocks of about ``block_bytes`` of text by
    a sum taken first; one pass over the documents a block, each adding to the runs and items
    of the one before, with its result written between. Null texts have no words; items without
    words have no windows; a null item id is written as ``null``. Repeated rows and items stay
    as they are; ``df`` may hold columns of any other names.
    """
    spark = df.sparkSession
    columns = columns or [c for c in df.columns]
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    blocks = max(1, ceil_div(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0, block_bytes))
    held = text_col in columns
    kept = df.select(F.struct(*columns, *([] if held else [text_col])).alias("row"))
    state = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part])
        source = kept.withColumns({"hit_runs": F.array().cast(RUNS), "items": F.array().cast("array<string>")}) if state is None else state

        def run(batches: Iterator[pa.RecordBatch], sent=sent, window=window) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, window)
            for batch in batches:
                at = batch.schema.get_field_index
                n_words, runs, names = [], [], []
                for text, old, held in zip(strings(batch.column(at("row")).field(text_col)), batch.column(at("hit_runs")).to_pylist(), batch.column(at("items")).to_pylist(), strict=True):
                    n, new, found = matcher.hits(text)
                    n_words.append(n)
                    runs.append([{"start": a, "end": b} for a, b in merged(new + [(x["start"], x["end"]) for x in old])])
                    names.append(sorted(found.union(held)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(at("row")), pa.array(runs, type=_RUNS), pa.array(names, type=pa.list_(pa.string())), pa.array(n_words, type=pa.int64())],
                    ["row", "hit_runs", "items", "n_words"],
                )

        state = source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("n_words", T.LongType())]))
        state = materialize(state.drop("n_words") if k + 1 < blocks else state) if blocks > 1 else state
    return state.select(*(F.col("row")[c].alias(c) for c in columns), "n_words", "hit_runs", "items")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_leaks``' rows, one each; without hits counts are 0 and the digest that of nothing."""
    n_hit = F.expr("aggregate(hit_runs, 0L, (s, x) -> s + x.end - x.start)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
