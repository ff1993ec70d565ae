import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxelark.llm import packing as p

from .conftest import brute


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=200, deadline=None)
def test_best_fit(sizes):
    bins = p.best_fit(np.array(sizes, dtype=np.int64), 64)
    assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in b) <= 64 for b in bins)
    assert len(bins) <= 1.7 * -(-sum(sizes) // 64) + 1


def test_cuts():
    assert p.cuts(1024) == [(0, 1024)] and p.cuts(2048) == [(0, 1024), (1024, 1024)]
    assert p.cuts(1025) == [(0, 1), (1, 1024)] and p.cuts(1) == [(0, 1)]


def test_ids_are_the_tokenizers():
    slow, fast = Tokenizer.from_file(P.path("byte_bpe_50k.json")), p.Tokenizer()
    for text in ("", "Hello  world\n\n x", "naïve Straße é", "日本語 text", "<|endoftext|> a", "a\u00a0b\u2003c", "x" * 3000, "don't 123 ...", "\x00\x1f"):
        assert fast.ids(text) == slow.encode(text, add_special_tokens=False).ids


def test_long_runs_of_one_letter():
    slow, fast = Tokenizer.from_file(P.path("byte_bpe_50k.json")), p.Tokenizer()
    for text in (" " * 10**6 + "x", "\n" * 10**6 + "x", "a" * 10**6, "7" * 10**6, "é" * 10**5 + " " * 3000):
        assert fast.ids(text) == slow.encode(text, add_special_tokens=False).ids
    fast._blanks = p.re.compile("(?!)")  # a panic of the faster library falls back too
    assert fast.ids(" " * 10**6 + "x") == slow.encode(" " * 10**6 + "x", add_special_tokens=False).ids


def test_blocks_hold_few_pieces(spark, messy):
    def filled(df):
        by = {}
        for r in df.collect():
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all(sum(n for _, n in b[:k]) == at for b in map(sorted, by.values()) for k, (at, _) in enumerate(b))
        return len(by), sorted(n for b in by.values() for _, n in b)

    many = spark.createDataFrame([(k, "w " * (k * 7 % 900)) for k in range(400)] + [(k, "w " * 600) for k in range(90)], "doc_id long, text string").repartition(2)
    (n, lengths), (few, same) = filled(p.pack(many)), filled(p.pack(many, block=16))
    assert lengths == same and few <= 1.1 * n + 2
    assert filled(p.pack(messy, block=1))[1] == filled(p.pack(messy))[1]


def test_sequences(messy, nothing):
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in brute(messy):
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        want += [(-1 if i is None else i, n, s, m, zlib.crc32(ids[s : s + m].tobytes())) for n, (s, m) in enumerate(p.cuts(len(ids)))]
    rows = p.pack(messy).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) <= 1.1 * sum(r["length"] for r in rows) / 1024 + 1
    assert p.pack(nothing).count() == 0
    assert p.tokenize(messy).count() == len(want)
