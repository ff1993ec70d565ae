import numpy as np
import pytest

from voxelark.llm import neighbours as n


def rows(spark, rng, count):
    x = rng.standard_normal((count, 8))
    data = [(k, [float(v) for v in x[k]], 1) for k in range(count)]
    data += [(count, None, 1), (count + 1, [0.0] * 8, 1), (count + 2, [float("nan")] * 8, 1), (count + 3, [1.0, None] + [0.0] * 6, 1), (None, [1.0] * 8, 1), (5, data[5][1], 1)]
    data += [(1000 + k, [0.5] * 8, 1) for k in range(40)] + [(2000, [1.0, 2.0], 1)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, rank int").repartition(4)


@pytest.mark.parametrize("candidates", [10**9, None])
def test_exact_where_all_are_candidates(spark, candidates):
    df = rows(spark, np.random.default_rng(0), 300)
    got = {}
    for r in n.nearest(df, df.filter("vec_id % 100 = 0"), candidates=candidates, target=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = {r["vec_id"]: np.array(r["embedding"]) for r in df.collect() if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    for q in (x for x in ok if x % 100 == 0):
        d = sorted((float(np.sqrt(((ok[k] - ok[q]) ** 2).sum())), k) for k in ok if k != q and len(ok[k]) == len(ok[q]))[:10]
        assert [k for _, k, _ in sorted(got.get(q, []))] == [k for _, k in d]
        assert np.allclose([s for _, _, s in sorted(got.get(q, []))], [x for x, _ in d])
    assert n.nearest(df.filter("false"), df).count() == 0 and n.nearest(df, df.filter("false")).count() == 0


def test_recall_and_share_looked_at(spark, monkeypatch):
    """Noise, the hardest case: nine in ten neighbours from well under half of the rows, the same however rows are dealt."""
    count = 12_000
    x = np.random.default_rng(2).standard_normal((count, 64))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    data = [(k, v) for k, v in enumerate(x.tolist())]
    wanted = {j: set(np.argsort(np.where(np.arange(count) == j, np.inf, ((x - x[j]) ** 2).sum(axis=1)))[:10].tolist()) for j in range(0, count, 100)}
    enough, chosen = n._enough, []
    monkeypatch.setattr(n, "_enough", lambda *a: chosen.append((a[0], enough(*a))) or chosen[-1][1])
    answers = []
    for parts, chunk in ((1, 200_000), (7, 50)):
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(parts)
        got = {}
        for r in n.nearest(df, df.filter("vec_id % 100 = 0"), cell_rows=chunk).collect():
            got.setdefault(r["query_id"], set()).add((r["vec_id"], r["score"]))
        answers.append(got)
        assert sum(len({v for v, _ in got[j]} & wanted[j]) for j in wanted) >= 0.9 * 10 * len(wanted)
        counts, c = chosen[-1]
        share = np.mean([next((r for r in row if r >= c), count) for row in counts.values()]) / count
        assert share < 0.4, share
    assert answers[0] == answers[1]


def test_strings_of_close_vectors_share_prefixes():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 16))
    near, far = x + 0.05 * rng.standard_normal(x.shape), rng.standard_normal(x.shape)
    length = lambda y: np.mean([max(n._BITS - int(a).bit_length() for a in row) for row in np.stack([n.strings_of(x, t, 0.0) ^ n.strings_of(y, t, 0.0) for t in range(8)], axis=1)])
    assert length(near) > length(far) + 8 and length(x) == n._BITS
