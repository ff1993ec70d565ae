"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is its own vector, if the model knows the word, beside the mean of the vectors of
its character strings of 3 to 5 bytes, hashed. Two recurrent passes read a window of words from either side,
attention pools their states into one, and a logistic unit scores it. A text's score is that of its
highest window; windows of ``WINDOW`` words start every ``STRIDE`` words until the end of the text,
so they overlap and cover all of it.

Training is multiple-instance: texts have labels, windows don't. In each round the network picks
each training text's highest window, and a random one of each text that isn't toxic, and learns
from those. Words' and strings' vectors start with their log odds in the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, batches_of, mix64, strings
from .language_model import held_out
from .lookup import Lookup
from .rnn import Adam, gru_back, gru_init, gru_run, gru_step, sigmoid

WINDOW, STRIDE = 48, 32
_GRAMS = 16_384
_U = np.uint64


class Batch:
    """Texts as distinct words with their character strings, and windows over them."""

    def __init__(self, texts: list[str]):
        w = Words(texts, ALNUM)
        self.per_text = w.per_text
        hashes, first, self.of = np.unique(w.hashes, return_index=True, return_inverse=True)
        self.hashes = hashes
        a = np.frombuffer(w.buffer, dtype=np.uint8).astype(np.uint32)
        start, n = w.starts[first], w.lengths[first]
        m = n + 2  # with a blank at either end
        begin = np.cumsum(m) - m
        place = np.arange(int(m.sum())) - np.repeat(begin, m)
        at = place + np.repeat(start - 1, m)
        code = np.where((place == 0) | (place == np.repeat(m - 1, m)), 32, a[np.clip(at, 0, max(len(a) - 1, 0))]).astype(np.uint64) if len(m) else np.zeros(0, dtype=np.uint64)
        owner, left = np.repeat(np.arange(len(m)), m), np.repeat(m, m) - place
        owners, grams = [], []
        h = code
        for size in range(2, 6):
            h = h[:-1] * _U(0x9E3779B97F4A7C15) + code[size - 1 :] if len(h) else h
            if size > 2:
                whole = left[: len(h)] >= size
                owners.append(owner[: len(h)][whole])
                grams.append((mix64(h[whole] + _U(size)) % _U(_GRAMS)).astype(np.int64))
        order = np.argsort(own := np.concatenate(owners), kind="stable")
        self.grams, self.n_grams = np.concatenate(grams)[order], np.bincount(own, minlength=len(m))
        self.begin = np.cumsum(self.n_grams) - self.n_grams
        count = np.maximum(1, -(-(self.per_text - (WINDOW - STRIDE)) // STRIDE))
        self.owner = np.repeat(np.arange(len(texts)), count)
        number = np.arange(len(self.owner)) - np.repeat(np.cumsum(count) - count, count)
        offset = np.cumsum(self.per_text) - self.per_text
        self.start = offset[self.owner] + number * STRIDE
        self.length = np.clip(self.per_text[self.owner] - number * STRIDE, 0, WINDOW)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(time, window): distinct word of each place, and a mask."""
        t = np.arange(WINDOW)[:, None]
        mask = t < self.length[which]
        at = np.minimum(self.start[which] + t, max(len(self.of) - 1, 0))
        return (self.of[at] if len(self.of) else np.zeros(at.shape, dtype=np.int64)), mask.astype(np.float32)


class Network:
    def __init__(self, known: np.ndarray, odds: np.ndarray, gram_odds: np.ndarray, n: int = 12, dim: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.known, self.n, self.dim = known, n, dim
        f, b = gru_init(rng, 2 * dim, n), gru_init(rng, 2 * dim, n)
        words = rng.normal(0, 0.1, (len(known) + 1, dim))
        words[:, 0] = np.append(odds, 0.0)
        grams = rng.normal(0, 0.1, (_GRAMS, dim))
        grams[:, 0] = gram_odds
        self.w = {f"{k}f": v for k, v in f.items()} | {f"{k}b": v for k, v in b.items()} | {
            "E": words.astype(np.float32), "T": grams.astype(np.float32),
            "A": rng.normal(0, 1 / np.sqrt(2 * n), (2 * n, n)).astype(np.float32), "a": np.zeros(n, dtype=np.float32), "v": rng.normal(0, 0.5, n).astype(np.float32),
            "o": rng.normal(0, 0.3, 2 * n).astype(np.float32), "p": np.zeros(1, dtype=np.float32),
        }
        self.cut, self.scale = 0.0, 1.0

    def inputs(self, b: Batch, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
        """(place in E, input vector) of each distinct word."""
        place = lookup.find(b.hashes)
        place[place < 0] = len(self.known)
        if not len(place):
            return place, np.zeros((1, 2 * self.dim), dtype=np.float32)
        chars = np.add.reduceat(self.w["T"][b.grams], b.begin, axis=0) / b.n_grams[:, None]
        return place, np.concatenate([self.w["E"][place], chars.astype(np.float32)], axis=1)

    def logits(self, b: Batch, lookup: Lookup, step: int = 4096) -> np.ndarray:
        """A logit for each window."""
        w = self.w
        _, x = self.inputs(b, lookup)
        xf, xb = x @ w["Wf"] + w["bf"], x @ w["Wb"] + w["bb"]
        out = np.empty(len(b.owner), dtype=np.float32)
        order = np.argsort(-b.length, kind="stable")  # full windows together
        for s in range(0, len(order), step):
            which = order[s : s + step]
            of, mask = b.windows(which)
            rows, whole = len(which), bool(mask.all())
            H = np.empty((WINDOW, rows, 2 * self.n), dtype=np.float32)
            hf = np.zeros((rows, self.n), dtype=np.float32)
            hb = np.zeros((rows, self.n), dtype=np.float32)
            for t in range(WINDOW):
                u = WINDOW - 1 - t
                hf = gru_step(xf[of[t]], hf, w["Uf"])
                hb = gru_step(xb[of[u]], hb, w["Ub"])
                if not whole:
                    hb *= mask[u][:, None]  # before the text's end
                H[t, :, : self.n], H[u, :, self.n :] = hf, hb
            out[which] = self._pool(H, mask)[0]
        return out

    def _pool(self, H: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
        w = self.w
        u = np.tanh(H @ w["A"] + w["a"])
        s = np.where(mask > 0, u @ w["v"], np.float32(-1e9))
        alpha = np.exp(s - s.max(axis=0))
        alpha *= mask
        alpha /= np.maximum(alpha.sum(axis=0), 1e-9)
        pooled = (alpha[:, :, None] * H).sum(axis=0)
        return pooled @ w["o"] + w["p"][0], pooled, alpha, u

    def learn(self, b: Batch, lookup: Lookup, which: np.ndarray, label: np.ndarray, adam: Adam) -> None:
        w, n = self.w, self.n
        place, x = self.inputs(b, lookup)
        of, mask = b.windows(which)
        xf, xb = x @ w["Wf"] + w["bf"], x @ w["Wb"] + w["bb"]
        zero = np.zeros((len(which), n), dtype=np.float32)
        Hf, held_f = gru_run(xf[of], zero, w["Uf"], mask)
        Hb, held_b = gru_run(xb[of[::-1]], zero, w["Ub"], mask[::-1])
        H = np.concatenate([Hf, Hb[::-1]], axis=2)
        logit, pooled, alpha, u = self._pool(H, mask)
        d = (sigmoid(logit) - label).astype(np.float32) / len(which)
        g = {"o": pooled.T @ d, "p": np.array([d.sum()], dtype=np.float32)}
        dpool = d[:, None] * w["o"]
        dalpha = (H * dpool).sum(axis=2)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        du = ds[:, :, None] * w["v"] * (1 - u**2)
        g["v"] = (u * ds[:, :, None]).sum(axis=(0, 1))
        g["A"], g["a"] = H.reshape(-1, 2 * n).T @ du.reshape(-1, n), du.sum(axis=(0, 1))
        dH = alpha[:, :, None] * dpool + du @ w["A"].T
        dxf, g["Uf"] = gru_back(dH[:, :, :n], held_f, w["Uf"])
        dxb, g["Ub"] = gru_back(dH[::-1, :, n:], held_b, w["Ub"])
        by_word = np.zeros((2, len(x), 3 * n), dtype=np.float32)
        np.add.at(by_word[0], of.ravel(), dxf.reshape(-1, 3 * n))
        np.add.at(by_word[1], of[::-1].ravel(), dxb.reshape(-1, 3 * n))
        dx = by_word[0] @ w["Wf"].T + by_word[1] @ w["Wb"].T
        for k, side in (("f", by_word[0]), ("b", by_word[1])):
            g[f"W{k}"], g[f"b{k}"] = x.T @ side, side.sum(axis=0)
        g["E"], g["T"] = np.zeros_like(w["E"]), np.zeros_like(w["T"])
        np.add.at(g["E"], place, dx[:, : self.dim])
        np.add.at(g["T"], b.grams, np.repeat(dx[:, self.dim :] / b.n_grams[:, None], b.n_grams, axis=0).astype(np.float32))
        adam.step(g)


def highest(b: Batch, logits: np.ndarray) -> np.ndarray:
    """Number of each text's highest window."""
    order = np.lexsort((logits, b.owner))
    return order[np.concatenate([b.owner[order][1:] != b.owner[order][:-1], [True]])]


def _gram_odds(batches: list[Batch], labels: np.ndarray) -> np.ndarray:
    """Log odds of each character string, counted once a text."""
    count = np.zeros((2, _GRAMS))
    for k, b in enumerate(batches):
        text = np.repeat(np.arange(len(b.per_text)), b.per_text)
        in_text = np.unique(np.stack([text, b.of]), axis=1)
        n = b.n_grams[in_text[1]]
        of = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(b.begin[in_text[1]], n)
        both = np.unique(np.stack([np.repeat(in_text[0], n), b.grams[of]]), axis=1)
        np.add.at(count, (labels[both[0] + 32 * k], both[1]), 1)
    odds = np.log((count[1] + 0.5) / (labels.sum() + 1)) - np.log((count[0] + 0.5) / ((1 - labels).sum() + 1))
    return np.where(count.sum(axis=0) >= 3, np.where(np.abs(odds) > 0.5, odds, 0.0), 0.0)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 4, rate: float = 5e-3, words: int = 16_384, seed: int = 0) -> Network | None:
    """A network fitted on texts of both labels; None if either is missing."""
    if not len(labels) or labels.min() == labels.max():
        return None
    parts = [texts[i : i + 32] for i in range(0, len(texts), 32)]
    batches = [Batch(p) for p in parts]
    seen = [np.unique(np.stack([np.repeat(np.arange(len(p)), b.per_text) + 32 * k, b.of]), axis=1) for k, (p, b) in enumerate(zip(parts, batches, strict=True))]
    hashes = np.concatenate([b.hashes[s[1]] for b, s in zip(batches, seen, strict=True)])
    toxic = np.concatenate([labels[s[0]] for s in seen])
    known, of, df = np.unique(hashes, return_inverse=True, return_counts=True)
    pos = np.bincount(of, weights=toxic, minlength=len(known))
    odds = np.log((pos + 0.5) / (labels.sum() + 1)) - np.log((df - pos + 0.5) / ((1 - labels).sum() + 1))
    strength = np.where(df >= 3, np.abs(odds) * np.sqrt(df), -1.0)
    keep = np.sort(np.argsort(-strength, kind="stable")[:words])
    keep = keep[strength[keep] >= 0]
    net = Network(known[keep], np.where(np.abs(odds[keep]) > 1, odds[keep], 0.0), _gram_odds(batches, labels), seed=seed)
    lookup, adam, rng = Lookup(net.known), Adam(net.w, rate), np.random.default_rng(seed)
    by_odds = np.append(net.w["E"][:-1, 0], 0.0)
    for r in range(rounds):
        adam.rate = rate * (0.5 ** max(0, r - rounds // 2))
        for k in rng.permutation(len(batches)):
            b = batches[k]
            y = labels[32 * k : 32 * k + len(parts[k])].astype(np.float32)
            if r:
                score = net.logits(b, lookup)
            else:  # nothing learned yet: the window with the strongest words
                of_word, mask = b.windows(np.arange(len(b.owner)))
                place = lookup.find(b.hashes)
                score = (by_odds[place][of_word] * mask).max(axis=0) if len(place) else np.zeros(len(b.owner))
            top = highest(b, score)
            other = rng.random(len(b.owner))
            other = highest(b, other)[y == 0]
            which = np.concatenate([top, other])
            net.learn(b, lookup, which, y[b.owner[which]], adam)
    top = np.concatenate([(z := net.logits(b, lookup))[highest(b, z)] for b in batches])
    net.cut = _best_cut(top, labels)
    return net


def _best_cut(score: np.ndarray, label: np.ndarray) -> float:
    """Between the two scores where most of either label fall on their side."""
    order = np.argsort(score)
    s, y = score[order].astype(np.float64), label[order]
    right = np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum()) + (y.sum() - np.concatenate([[0], np.cumsum(y)])) / max(1, y.sum())
    best = np.flatnonzero(right >= right.max() - 1e-12)
    k = int(best[len(best) // 2])
    low, high = (s[k - 1] if k else s[0] - 1), (s[k] if k < len(s) else s[-1] + 1)
    return float(low + 0.7 * (high - low))  # nearer to the toxic side: clean texts are many more


def training_rows(documents: DataFrame, labels: DataFrame, most: int = 1000) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most about ``most`` rows of either label, by a hash of the id.

    Only ids whose crc32 as text isn't divisible by 5 are taken. A document with several labels
    is toxic if any says so.
    """
    y = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    y = y.filter(~held_out(F.col("doc_id"), 5, 0))
    n = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}
    steps = 1 << 20
    share = F.when(F.col("toxic") == 1, int(steps * min(1.0, most / max(1, n.get(1, 0))))).otherwise(int(steps * min(1.0, most / max(1, n.get(0, 0)))))
    picked = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < share).limit(4 * most)  # bounded, so it may go to every task
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    found = rows.orderBy("doc_id", "text").select("text", "toxic").toArrow()
    return found.column(0).to_pylist(), found.column(1).to_numpy().astype(np.int64)


def score_texts(df: DataFrame, net: Network | None, columns: list[str], text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``columns`` of ``df`` with ``score``: 0 to 1, from 0.5 on toxic.

    Null, empty and wordless texts get what a window without words gets. Without a network
    all scores are 0.
    """
    sent = df.sparkSession.sparkContext.broadcast(net)
    rows = df.select(*columns, *([] if text_col in columns else [text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        lookup = Lookup(net.known) if net else None
        for batch in batches_of(batches, text_col, batch_bytes):
            score = np.zeros(batch.num_rows)
            if net:
                b = Batch(strings(batch.column(batch.schema.get_field_index(text_col))))
                logits = net.logits(b, lookup)
                score = sigmoid(logits[highest(b, logits)].astype(np.float64) - net.cut)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(score)], [*columns, "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(columns)], T.StructField("score", T.DoubleType())]))
