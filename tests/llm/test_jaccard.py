import random
import re

import numpy as np
import pyarrow as pa
import pytest

from voxelark.llm import jaccard as j
from voxelark.llm.graph import components

from .conftest import brute


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def expected(docs, k, num, den):
    s = [shingles(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted(((i if i is not None else -1), len(s[a]), (least.get(root(a), -1) if s[a] else i if i is not None else -1)) for a, (i, _) in enumerate(docs))


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (1, 70)])
def test_against_brute_force(messy, k, num):
    got = sorted(tuple(-1 if x is None else x for x in r) for r in j.jaccard_components(messy, k=k, num=num).collect())
    assert got == expected(brute(messy), k, num, 100)


def test_random_near_copies(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        w = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(8, 300))]
        for _ in range(rng.randrange(2, 14)):
            x = list(w)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                x[rng.randrange(len(x))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(x[rng.randrange(3) :])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, j.jaccard_components(df, k=4, num=85).collect())) == expected(rows, 4, 85, 100)


def test_shared_class_numbers_are_made_anew(messy, monkeypatch):
    monkeypatch.setattr(j, "describe", lambda docs, k, seed=0, f=j.describe: f(docs, k, seed).withColumn("cls", j.F.when(j.F.lit(seed == 0), j.F.col("cls").bitwiseAND(7)).otherwise(j.F.col("cls"))))
    docs = messy.selectExpr("doc_id as id", "text")
    all_docs, firsts, seed = j._classes(docs, 4)
    assert seed == 1 and firsts.count() == all_docs.filter("n > 0").select("n", "cls", "other").distinct().count()


def test_groups_go_over_batches():
    rows = [(1, 0, 0), (1, 0, 0), (1, 0, 1), (2, 0, 1), (2, 0, 1), (2, 0, 1), (2, 1, 1), (-5, 0, 0)]
    whole = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["g", "lo", "hi"])
    for step in (1, 2, 3, 5, 8):
        cut = [whole.slice(a, step) for a in range(0, len(rows), step)]
        got = [[tuple(r.values()) for r in t.to_pylist()] for t in j._groups_of(iter([whole.slice(0, 0), *cut]))]
        assert got == [rows[:2], rows[2:3], rows[3:6], rows[6:7], rows[7:]]
    assert not list(j._groups_of(iter([])))


def test_small_groups_share_a_stream(spark, monkeypatch):
    """Pairs across components are the same when groups are cut by small batches; no group has an Arrow stream of its own."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 40)).astype(np.uint64) for _ in range(30)]
    about = spark.createDataFrame([(c, 40, bytearray(j.bit_sketches(np.array([40]), np.concatenate([sets[c // 4][:38], sets[c % 30][-2:]]))[0])) for c in range(120)], "cls long, n long, sketch binary")
    groups = spark.createDataFrame([(g, [*range(4 * g, 4 * g + 4), *range(8 * g % 120, 8 * g % 120 + 3)]) for g in range(30)], "g long, members array<long>")
    comp = spark.createDataFrame([(4 * g + 1, 4 * g) for g in range(30)], "node long, comp long")
    refuted = spark.createDataFrame([(4 * g + 2, [4 * g + 3]) for g in range(9)], "cls long, no array<long>")
    results = []
    for most in (10_000, 3):
        monkeypatch.setattr(j, "_CHUNK", 4)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            out = j._next_pairs(groups, about, comp, refuted, j.Plan(85, 100), 1)
            assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
            results.append(sorted((r.g, sorted(r.open), sorted(zip(r.a, r.b, strict=True))) for r in out.collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(results[0]) > 20 and results[0] == results[1]


def test_empty(nothing):
    assert j.jaccard_components(nothing).count() == 0


def test_blocks_differ_at_most_as_sets_do():
    rng = np.random.default_rng(0)
    a = np.sort(rng.choice(1 << 40, 300, replace=False)).astype(np.uint64)
    b = np.sort(np.concatenate([a[20:], rng.choice(1 << 40, 15, replace=False).astype(np.uint64)]))
    x, y = (j.bit_sketches(np.array([len(s)]), s)[0] for s in (a, b))
    assert j.hamming(x, y) <= len(np.setxor1d(a, b))
    assert j.hamming(x, j.bit_sketches(np.array([40]), a[:40])[0]) <= 260


@pytest.mark.parametrize("one_task", [1000, 0])
def test_components(spark, one_task):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(102, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(e, one_task).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(e.filter("false"), one_task).count() == 0


def test_documents_without_an_id_link_others(spark):
    rng = random.Random(9)
    w = [f"q{rng.randrange(10**6)}" for _ in range(100)]
    a, b, c = " ".join(w), " ".join(w[:-9]), " ".join(w[:-18])
    df = spark.createDataFrame([(5, a), (None, b), (3, c), (None, "zz " * 9)], "doc_id long, text string")
    got = sorted(tuple(-1 if x is None else x for x in (r[0], r[2])) for r in j.jaccard_components(df, k=1, num=85).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (5, 3)]
