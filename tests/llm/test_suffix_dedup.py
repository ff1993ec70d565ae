import hashlib
from collections import Counter

import numpy as np
import pytest

from voxelark.llm import suffix_dedup as s

from .conftest import brute


def expected(docs):
    raw = [(i, t.encode()) for i, t in docs]
    n = Counter(r[p : p + 200] for _, r in raw for p in range(len(r) - 199))
    out = []
    for i, r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - 199):
            if n[r[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(1 for p in range(len(r)) if gone[p] and (not p or not gone[p - 1]))
        out.append((-1 if i is None else i, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group_rows", [20_000, 2])
def test_against_brute_force(messy, group_rows):
    got = sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in s.digest(s.repeated_spans(messy, group_rows=group_rows)).collect())
    assert got == expected(brute(messy))


def test_empty(nothing):
    assert s.digest(s.repeated_spans(nothing)).count() == 0


def test_every_string_lies_in_one_phrase(monkeypatch):
    raw = np.random.default_rng(0).integers(97, 101, 5000).astype(np.uint8).tobytes()
    start, end, place, h = s.parse(raw)
    assert start[0] == 0 and end[-1] == 4800 and (start[1:] == end[:-1] + 1).all()
    assert ((place - end >= 0) & (place - start <= s.LEFT)).all()
    monkeypatch.setattr(s, "_SEGMENT", 500)
    assert all((x == y).all() for x, y in zip(s.parse(raw), (start, end, place, h), strict=True))
    alone = {raw[p : p + 200]: place[k] - p for k in range(len(start)) for p in range(start[k], end[k] + 1)}
    for text, at in alone.items():
        a, b, t, _ = s.parse(text)
        assert len(a) == 1 and t[0] == at
    assert all(len(x) == 0 for x in s.parse(b"x" * 199)) and len(s.parse(b"x" * 200)[0]) == 1


def test_common_passages_and_single_letters(spark):
    rng = np.random.default_rng(1)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage, half = word(420), word(300)
    docs = [(k, word(int(rng.integers(0, 300))) + passage[int(rng.integers(0, 30)) : 400 + int(rng.integers(0, 20))] + word(int(rng.integers(0, 300)))) for k in range(60)]
    docs += [(100 + k, passage[k * 7 :] + half[: 150 + k]) for k in range(20)]
    docs += [(200, "a" * 3000), (201, "b" * 200), (202, "ab" * 300), (203, "x" * 199), (204, "é" * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for most in (20_000, 3):
        assert sorted(tuple(r) for r in s.digest(s.repeated_spans(df, group_rows=most)).collect()) == expected(docs)
