import hashlib
import random

import pytest

from voxelark.llm import decontaminate as d

from .conftest import brute


def expected(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, names = d.words_of(t), set(), set()
        for name, text in items:
            p = d.words_of(text)
            if not p:
                continue
            m = min(window, len(p))
            wins = {tuple(p[a : a + m]) for a in range(len(p) - m + 1)}
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in wins:
                    hit.update(range(a, a + m))
                    names.add(str(name))
        out.append((i if i is not None else -1, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 25, 300])
def test_against_brute_force(spark, messy, nothing, block):
    docs = brute(messy)
    long = next(t for i, t in docs if i == 90).split()
    items = [(1, " ".join(long[40:70]).upper()), (2, "One, two!"), (3, "w1"), (4, None), (5, ""), (6, " ".join(long[60:69])), (10, " ".join(long[45:60])), (6, " ".join(long[60:69]))]
    b = spark.createDataFrame(items, "item_id long, text string")
    found = d.find_leaks(messy, b, ["doc_id"], block_bytes=block)
    got = sorted((r[0] if r[0] is not None else -1, *tuple(r)[1:]) for r in d.digest(found).collect())
    assert got == expected(docs, [(i, t or "") for i, t in items])
    assert d.find_leaks(nothing, b, ["doc_id"]).count() == 0
    assert d.find_leaks(messy, b.filter("false"), ["doc_id", "text", "n"]).filter("size(hit_runs) > 0").count() == 0


def test_search_finds_all():
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(40)]
        p = list({tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 6))) for _ in range(8)})
        want = sorted((s, k) for k, x in enumerate(p) for s in range(len(w)) if tuple(w[s : s + len(x)]) == x)
        assert sorted(d.WuManber(p).find(w)) == want
