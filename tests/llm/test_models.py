import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from voxelark.llm import language_model as lm
from voxelark.llm import rnn, toxicity
from voxelark.llm.lookup import Lookup

from .conftest import brute


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    assert (Lookup(keys).find(keys) == np.arange(len(keys))).all()
    assert (Lookup(keys).find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (Lookup(keys[:0]).find(keys) == -1).all()


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    w = rnn.gru_init(rng, 3, 4)
    x, h, d = rng.normal(size=(5, 2, 12)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), rng.normal(size=(5, 2, 4)).astype(np.float32)
    mask = np.ones((5, 2), dtype=np.float32)
    mask[3:, 1] = 0
    loss = lambda: float((rnn.gru_run(x, h, w["U"], mask)[0] * d).sum())
    dx, dU = rnn.gru_back(d, rnn.gru_run(x, h, w["U"], mask)[1], w["U"])
    for a, g, at in ((x, dx, (1, 0, 5)), (x, dx, (2, 1, 9)), (w["U"], dU, (1, 7)), (w["U"], dU, (3, 11))):
        a[at] += 1e-2
        up = loss()
        a[at] -= 2e-2
        down = loss()
        a[at] += 1e-2
        assert math.isclose((up - down) / 2e-2, g[at], rel_tol=3e-2, abs_tol=3e-3)


def test_model_is_a_distribution_and_windows_carry_state():
    m = lm.Model(np.array([50] + [10] * 99), 30, n=8)
    m.train([np.array([1, 2, 3, 0] * 200)], epochs=1)
    H = np.random.default_rng(0).normal(size=(1, 8)).astype(np.float32)
    p = np.exp([m.log_probs(H, np.array([k]))[0] for k in range(101)])
    assert math.isclose(p.sum(), 1, rel_tol=1e-4)
    ids = np.random.default_rng(1).integers(0, 101, 150)
    both = m.score(np.concatenate([ids, ids[:40]]), np.array([150, 40]))
    m.WINDOW = 7
    assert np.allclose(both, m.score(np.concatenate([ids, ids[:40]]), np.array([150, 40])), rtol=1e-4)
    assert np.allclose(both[0], m.score(ids, np.array([150]))[0], rtol=1e-4)


def test_scores(messy, nothing):
    got = lm.score_documents(messy, head=50).collect()
    tok = lambda s: [*re.findall(r"[^\x20\x09-\x0D]+", s.translate({i: i + 32 for i in range(65, 91)})), None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    docs = brute(messy)
    c = Counter(w for i, t in docs if not out(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, out(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in docs)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lm.score_documents(nothing).count() == 0


def texts(rng, n):
    plain, bad = [f"w{k}" for k in range(300)], ["vile", "nasty", "lowei"]
    rows = []
    for k in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        y = int(k % 3 == 0)
        if y:
            for _ in range(rng.randrange(1, 4)):
                b = rng.choice(bad)
                w[rng.randrange(len(w))] = b + rng.choice(["", f"{rng.randrange(50)}x"])
        rows.append((k, " ".join(w), y))
    return rows


def test_toxicity(spark, messy, nothing):
    rows = texts(random.Random(0), 900)
    net = toxicity.fit([t for _, t, _ in rows[:600]], np.array([y for _, _, y in rows[:600]]))
    df = spark.createDataFrame(rows[600:], "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(df, net, ["doc_id"]).collect()}
    right = sum((got[i] >= 0.5) == bool(y) for i, _, y in rows[600:])
    assert right >= 0.97 * 300 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score_texts(messy, net, ["doc_id", "text", "n"]).count() == messy.count()
    assert toxicity.score_texts(nothing, net, ["doc_id"]).count() == 0
    assert toxicity.score_texts(df, None, ["doc_id"]).filter("score <> 0").count() == 0


def test_windows_cover_whole_texts():
    b = toxicity.Batch(["", "a", " ".join(["x"] * 48), " ".join(["x"] * 49), " ".join(["x"] * 500)])
    for text, n in enumerate(b.per_text):
        own = b.owner == text
        seen = set()
        for s, m in zip(b.start[own], b.length[own], strict=True):
            seen.update(range(s, s + m))
        assert len(seen) == n and own.any()


def test_training_rows(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(150)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    t, y = toxicity.training_rows(docs, labels)
    ids = [k for k in range(150) if zlib.crc32(str(k).encode()) % 5]
    assert t == [f"text {k}" for k in ids] and list(y) == [k % 2 for k in ids]
    assert toxicity.fit(*toxicity.training_rows(docs, labels.filter("false"))) is None


def test_every_training_document_is_learnt_from(messy, monkeypatch):
    seen, averaged = [], lm.averaged
    monkeypatch.setattr(lm, "averaged", lambda model, train, *rest: seen.append(sorted(r["text"] for r in train.collect())) or averaged(model, train, *rest))
    lm.score_documents(messy).count()
    assert seen == [sorted(t for i, t in brute(messy) if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2)]


def test_training_leaves_no_token_out():
    m = lm.Model(np.array([50] + [10] * 99), 30, n=8)
    before = m.w["o"].copy()
    m.train([np.array([1, 2, 3, 0] * 32 + [98])], epochs=1, streams=2)
    assert (m.w["o"] - before)[98] > 0 > (m.w["o"] - before)[1:98].min()


def test_scores_are_those_of_single_steps():
    m = lm.Model(np.array([50] + [10] * 99), 30, n=8)
    m.train([np.array([1, 2, 3, 0, 7, 100, 0] * 100)], epochs=1)
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 101, k).tolist() + [0] for k in (0, 1, 31, 32, 33, 150)]
    want = []
    for text in texts:
        h, last, total = np.zeros((1, 8)), 0, 0.0
        for y in text:
            a, u = m.w["E"][last] @ m.w["W"] + m.w["b"], h @ m.w["U"]
            z, r = (1 / (1 + np.exp(-(a[k : k + 8] + u[0, k : k + 8]))) for k in (0, 8))
            new = np.tanh(a[16:] + r * u[0, 16:])
            h = (new + z * (h[0] - new))[None]
            by_class = (h @ m.w["C"] + m.w["c"])[0]
            c = int(m.class_of[y])
            total += by_class[c] - np.log(np.exp(by_class).sum())
            if y < m.words:
                own = np.flatnonzero(m.class_of[:-1] == c)
                word = m.w["O"][own] @ h[0] + m.w["o"][own]
                total += word[y - own[0]] - np.log(np.exp(word).sum())
            last = y
        want.append(total)
    assert np.allclose(m.score(np.concatenate(texts), np.array([len(t) for t in texts])), want, rtol=1e-4)


def test_documents_start_afresh_within_windows():
    """Gradients of a window that holds two documents are those of the documents alone."""
    rng = np.random.default_rng(0)
    w = rnn.gru_init(rng, 3, 4)
    x, d = rng.normal(size=(5, 1, 12)).astype(np.float32), rng.normal(size=(5, 1, 4)).astype(np.float32)
    fresh = np.array([[True], [False], [True], [False], [False]])
    zero = np.zeros((1, 4), dtype=np.float32)
    H, held = rnn.gru_run(x, zero + 1, w["U"], fresh=fresh)
    dx, dU = rnn.gru_back(d, held, w["U"])
    alone = [(rnn.gru_run(x[s], zero, w["U"]), d[s]) for s in (slice(0, 2), slice(2, 5))]
    assert np.allclose(H, np.concatenate([r[0] for r, _ in alone]), atol=1e-6)
    back = [rnn.gru_back(g, r[1], w["U"]) for r, g in alone]
    assert np.allclose(dx, np.concatenate([b[0] for b in back]), atol=1e-6) and np.allclose(dU, sum(b[1] for b in back), atol=1e-5)


def test_held_out_documents_gain_over_counts(spark):
    rng = random.Random(5)
    follows = {f"w{k}": [f"w{(7 * k + j) % 60}" for j in range(3)] for k in range(60)}
    rows = []
    for k in range(1500):
        w = [f"w{rng.randrange(60)}"]
        while len(w) < 60:
            w.append(rng.choice(follows[w[-1]]))
        rows.append((k, " ".join(w)))
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).filter("held_out").collect()
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got)


def test_changes_are_summed_as_a_tree(spark):
    rows = [("a", p, t, 2, [float(t), 1.0]) for p in range(2) for t in range(30)]
    got = sorted(tuple(r) for r in lm._summed(spark.createDataFrame(rows, lm._CHANGES), fan_in=3).collect())
    assert got == [("a", p, 0, 60, [435.0, 30.0]) for p in range(2)]


def test_logits_are_those_of_single_words():
    rows = texts(random.Random(1), 300)
    net = toxicity.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows]), rounds=1)
    b, lookup = toxicity.Batch(["", "one", rows[0][1], "two " * 100]), Lookup(net.known)
    w, (_, x) = net.w, net.inputs(b, lookup)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def read(places, side):
        h, out, n = np.zeros(net.n), [], net.n
        for p in places:
            a, u = x[p] @ w[f"W{side}"] + w[f"b{side}"], h @ w[f"U{side}"]
            z, r = sig(a[:n] + u[:n]), sig(a[n : 2 * n] + u[n : 2 * n])
            new = np.tanh(a[2 * n :] + r * u[2 * n :])
            h = new + z * (h - new)
            out.append(h)
        return out

    want = []
    for s, m in zip(b.start, b.length, strict=True):
        places = b.of[s : s + m].tolist()
        H = np.array([np.concatenate(p) for p in zip(read(places, "f"), read(places[::-1], "b")[::-1], strict=True)]).reshape(-1, 2 * net.n)
        e = np.exp(np.tanh(H @ w["A"] + w["a"]) @ w["v"])
        want.append(((e / e.sum())[:, None] * H).sum(axis=0) @ w["o"] + w["p"][0] if m else w["p"][0])
    assert np.allclose(net.logits(b, lookup), want, atol=1e-3)


def test_rows_beyond_a_floats_range():
    a = np.array([[200.0, 199.0], [-200.0, -201.0], [1.0, 0.0]], dtype=np.float32)
    _, total, top = lm._exp_rows(a)
    assert np.allclose(a[:, 0] - top - np.log(total), -math.log(1 + math.exp(-1)), atol=1e-4)
