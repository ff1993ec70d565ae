"""Corpus language-model scores: a gated recurrent model over words, and word counts.

Counts cover every training document: each task sums the words of its texts, a shuffle sums
those. The most frequent words (``HEAD``) go to all tasks; the rest stays a table that documents'
rare words are joined with, so nothing sent around grows with the vocabulary.

The recurrent model knows the most frequent ``model_words`` words, the end and one mark for all
rarer words. Its output softmax is factored: first a class, then a word of that class. It is trained by
backpropagation truncated to windows, the state carried from one window to the next: first on the
driver on a bounded sample, then by every task on all of its own training documents, and
the tasks' changes are averaged by their tokens. Output biases start from the counts of the whole corpus.
A rare word's probability is the mark's times its share in the counts of rare words. Documents
are scored whole, window after window with the state carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, batches_of, materialize, scratch
from .lookup import Lookup
from .rnn import Adam, gru_init, wide_back, wide_run, wide_step

HEAD = 131_072
_END = np.uint64(0xE5D)  # the end token's number; words' numbers are 64-bit hashes
_LN10 = np.log(10)
_ROWS = 1024  # of classes at once: small arrays stay in the cache
_STEPS = 16_384  # tokens scored at once


def held_out(id_col: F.Column, mod: int, rest: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod) == rest


def token_numbers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens a text): each text's word hashes and the end."""
    w = Words(texts, SPACED)
    per_text = w.per_text + 1
    out = np.empty(int(per_text.sum()), dtype=np.uint64)
    ends = np.cumsum(per_text) - 1
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside], out[ends] = w.hashes, _END
    return out, per_text


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (h, c) over the column ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for batch in batches_of(batches, "text", 2 << 20):
            held.append(token_numbers([t or "" for t in batch.column(0).to_pylist()])[0])
            size += len(held[-1])
            if size > 2_000_000:
                yield summed()
                held, size = [], 0
        if held:
            yield summed()

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _exp_rows(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp of the rows, each row's sum, and what was taken off the rows first: their largest, where plain sums leave a float's range."""
    ones = np.ones(a.shape[1], dtype=a.dtype)
    with np.errstate(over="ignore"):
        e = np.exp(a)
        total = e @ ones
    if np.isfinite(total).all() and (total > 1e-30).all():
        return e, total, 0.0
    top = a.max(axis=1)
    e = np.exp(a - top[:, None])
    return e, e @ ones, top


def _exp_runs(a: np.ndarray, start: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """``_exp_rows`` of rows of any length that follow one another in ``a``, which is overwritten."""
    top = 0.0
    if not -60 < a.min() <= a.max() < 60:
        top = np.maximum.reduceat(a, start)
        a -= np.repeat(top, width)
    np.exp(a, out=a)
    return np.add.reduceat(a, start), top


def _and_one(H: np.ndarray) -> np.ndarray:
    """``H`` with a column of ones, which takes the biases."""
    out = np.ones((len(H), H.shape[1] + 1), dtype=np.float32)
    out[:, :-1] = H
    return out


class Model:
    """Words 0 (the end) to ``words - 1`` and the mark ``words`` for all others.

    Classes are runs of words with about equal sums of the roots of their counts: few of the
    frequent words a class, many of the rare ones.
    """

    CLASSES = 48
    WINDOW = 32

    def __init__(self, counts: np.ndarray, rare: int, n: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.words, self.n = len(counts), n
        p = np.maximum(np.concatenate([counts, [rare]]).astype(np.float64), 1)
        mass = np.cumsum(np.sqrt(p[:-1]))
        _, self.first = np.unique(np.minimum(self.CLASSES * (mass - np.sqrt(p[:-1])) / mass[-1], self.CLASSES - 1).astype(np.int64), return_index=True)
        self.classes = len(self.first) + 1  # the mark is a class of its own
        self.sizes = np.diff(np.concatenate([self.first, [self.words, self.words + 1]]))
        self.class_of = np.repeat(np.arange(self.classes), self.sizes)
        by_class = np.add.reduceat(p[:-1], self.first)
        gru = gru_init(rng, n, n)
        self.w = {
            "E": rng.normal(0, 0.1, (self.words + 1, n)).astype(np.float32), "W": gru["W"], "U": gru["U"], "b": gru["b"],
            "C": rng.normal(0, 0.05, (n, self.classes)).astype(np.float32), "c": np.log(np.concatenate([by_class, p[-1:]]) / p.sum()).astype(np.float32),
            "O": rng.normal(0, 0.05, (self.words, n)).astype(np.float32), "o": np.log(p[:-1] / by_class[self.class_of[:-1]]).astype(np.float32),
        }

    def _inside(self, H: np.ndarray, ids: np.ndarray, O: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, slice, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        """Logits within the classes of ``ids``, but the mark's and those of one word: all rows in one array, as their lengths differ.

        (the tokens by class, the logits, (words, rows, logits) of each class, where each row starts, its length, the place of its token's logit)
        """
        cls = self.class_of[ids]
        order = np.flatnonzero(self.sizes[cls] > 1)
        order = order[np.argsort(cls[order].astype(np.int16), kind="stable")]
        cls = cls[order]
        width = self.sizes[cls]
        ends = np.cumsum(width)
        start = ends - width
        flat, H = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.float32), H.take(order, axis=0)
        bounds = np.searchsorted(cls, np.arange(self.classes)).tolist()
        groups = []
        for c, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if i < j:
                words = slice(int(self.first[c]), int(self.first[c] + self.sizes[c]))
                a = flat[start[i] : ends[j - 1]].reshape(j - i, -1)
                np.matmul(H[i:j], O[words].T, out=a)
                groups.append((words, slice(i, j), a))
        return order, flat, groups, start, width, start + ids[order] - self.first[cls]

    def log_probs(self, H: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural logs of the probabilities of ``ids`` after the states ``H``."""
        w = self.w
        cls = self.class_of[ids]
        H = _and_one(H)
        C, O = np.concatenate([w["C"], w["c"][None]]), np.concatenate([w["O"], w["o"][:, None]], axis=1)
        out = np.empty(len(ids), dtype=np.float32)
        for k in range(0, len(ids), _ROWS):
            a = H[k : k + _ROWS] @ C
            _, total, top = _exp_rows(a)
            out[k : k + _ROWS] = a[np.arange(len(a)), cls[k : k + _ROWS]] - top - np.log(total)
        order, flat, _, start, width, right = self._inside(H, ids, O)
        if len(order):
            logit = flat[right]
            total, top = _exp_runs(flat, start, width)
            out[order] += logit - top - np.log(total)
        return out

    def _loss(self, H: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients of the mean loss: of ``H`` and of the output weights."""
        w, m, n = self.w, len(ids), self.n
        cls, each = self.class_of[ids], np.float32(1 / m)
        H = _and_one(H)
        C, O = np.concatenate([w["C"], w["c"][None]]), np.concatenate([w["O"], w["o"][:, None]], axis=1)
        dH, gC, gO = np.empty((m, n), dtype=np.float32), np.zeros_like(C), np.zeros_like(O)
        for k in range(0, m, _ROWS):
            h = H[k : k + _ROWS]
            d, total, _ = _exp_rows(h @ C)
            d *= (each / total)[:, None]
            d[np.arange(len(d)), cls[k : k + _ROWS]] -= each
            np.matmul(d, w["C"].T, out=dH[k : k + _ROWS])
            gC += h.T @ d
        order, flat, groups, start, width, right = self._inside(H, ids, O)
        if len(order):
            total, _ = _exp_runs(flat, start, width)
            flat *= np.repeat(each / total, width)
            flat[right] -= each
            H, inside = H.take(order, axis=0), np.empty((len(order), n), dtype=np.float32)
            for words, at, d in groups:
                np.matmul(d, w["O"][words], out=inside[at])
                np.matmul(d.T, H[at], out=gO[words])
            dH[order] += inside
        return dH, {"C": gC[:n], "c": gC[n], "O": gO[:, :n], "o": gO[:, n]}

    def train(self, docs: list[np.ndarray], epochs: int = 3, streams: int = 32, rate: float = 4e-3, adam: Adam | None = None) -> None:
        """``docs``: token places, ends included, read as ``streams`` parallel streams of equal length.

        The last stream is filled up with the first tokens, so none is left out. Every document
        starts from a state of zeros, wherever in a window; a stream that starts within one is given
        the word before. ``adam`` carries on the steps of an earlier part.
        """
        flat = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
        if not len(flat):
            return
        streams = max(1, min(streams, len(flat) // (2 * self.WINDOW)))
        per = -(-len(flat) // streams)
        text = np.resize(flat, per * streams).reshape(streams, per).T
        before = np.concatenate([np.concatenate([[0], text[-1, :-1]]).astype(text.dtype)[None], text[:-1]])
        adam = adam or Adam(self.w, rate)
        inputs, states = np.empty((2, self.WINDOW, 3 * self.n, streams), dtype=np.float32), np.empty((4, self.WINDOW, self.n, streams), dtype=np.float32)
        for epoch in range(epochs):
            adam.rate = rate / (1 + epoch)
            h = np.zeros((self.n, streams), dtype=np.float32)
            for a in range(0, per, self.WINDOW):
                x_ids, y = before[a : a + self.WINDOW], text[a : a + self.WINDOW].ravel()
                e = self.w["E"].take(x_ids, axis=0)
                x = np.matmul(self.w["W"].T, e.transpose(0, 2, 1), out=inputs[0, : len(e)])
                x += self.w["b"][:, None]
                H, held = wide_run(x, h, self.w["U"], x_ids == 0, states[:3])
                dH, g = self._loss(H.transpose(0, 2, 1).reshape(-1, self.n), y)
                d = states[3, : len(e)]
                d[...] = dH.reshape(-1, streams, self.n).transpose(0, 2, 1)
                dx, g["U"] = wide_back(d, held, self.w["U"], inputs[1])
                flat_dx = dx.transpose(0, 2, 1).reshape(-1, dx.shape[1])
                g["W"], g["b"] = e.reshape(-1, self.n).T @ flat_dx, np.ones(len(flat_dx), dtype=np.float32) @ flat_dx
                g["E"] = np.zeros_like(self.w["E"])
                order = np.argsort(x_ids.ravel().astype(np.int16) if self.words < 1 << 15 else x_ids.ravel(), kind="stable")
                own = x_ids.ravel()[order]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                g["E"][own[first]] = np.add.reduceat((flat_dx @ self.w["W"].T).take(order, axis=0), first)
                adam.step(g)
                h = H[-1]

    def score(self, ids: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Natural log-probability of each text, read to its end with the state carried on."""
        table = np.ascontiguousarray((self.w["E"] @ self.w["W"] + self.w["b"]).T)
        order = np.argsort(-per_text, kind="stable")
        first = (np.cumsum(per_text) - per_text)[order]
        length = per_text[order]
        total = np.zeros(len(per_text), dtype=np.float64)
        h = np.zeros((self.n, len(per_text)), dtype=np.float32)
        last = np.zeros(len(per_text), dtype=np.int64)
        longest = int(length[0]) if len(length) else 0
        live = np.searchsorted(-length, -np.arange(longest)).tolist()  # texts longer than each step's number
        states, wanted, held = [], [], 0
        for t, n in enumerate(live):
            if n < h.shape[1]:
                h, last, first = h[:, :n].copy(), last[:n], first[:n]
            h = wide_step(table.take(last, axis=1), h, self.w["U"])
            last = ids.take(first + t)
            states.append(h.T)
            wanted.append(last)
            held += n
            if held >= _STEPS or t + 1 == longest:
                p = self.log_probs(np.concatenate(states), np.concatenate(wanted))
                at = 0
                for y in wanted:
                    total[: len(y)] += p[at : at + len(y)]
                    at += len(y)
                states, wanted, held = [], [], 0
        out = np.empty(len(per_text), dtype=np.float64)
        out[order] = total
        return out


_PIECES = 16
_PART = 4 << 20  # tokens that a task holds at once
_CHANGES = "name string, piece long, task long, n long, change array<double>"


def _summed(changes: DataFrame, fan_in: int = 64) -> DataFrame:
    """One row (name, piece, 0, n, change) for each piece of each weight, added up as a tree: ``fan_in`` rows a task."""

    def total(table: pa.Table) -> pa.Table:
        x = np.sum([np.asarray(c.values) for c in table.column("change")], axis=0)
        first = lambda c: [table.column(c)[0].as_py()]
        return pa.table({"name": first("name"), "piece": first("piece"), "task": first("task"), "n": [sum(table.column("n").to_pylist())], "change": pa.array([x.tolist()], type=pa.list_(pa.float64()))})

    changes = materialize(changes)
    most = changes.agg(F.max("task")).first()[0] or 0
    while True:
        most //= fan_in
        changes = materialize(changes.withColumn("task", F.expr(f"task div {fan_in}")).groupBy("name", "piece", "task").applyInArrow(total, _CHANGES), narrow=True)
        if not most:
            return changes


def averaged(model: Model, train: DataFrame, known: np.ndarray, rate: float = 1e-3) -> Model:
    """``model`` moved by the mean change of its copies that each task trains on its rows of ``train`` (text), weighted by tokens.

    A task reads each of its documents once, so the weights follow how rows are dealt to tasks; with the
    same partitions they are the same. Changes are summed in pieces as a tree; the driver gets one sum of each.
    """
    spark = train.sparkSession
    sent = spark.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value
        vocabulary, docs, n, held = Lookup(known), [], 0, 0
        before = {k: v.copy() for k, v in model.w.items()}
        model.w = {k: v.copy() for k, v in before.items()}
        adam = Adam(model.w, rate)

        def learn() -> None:
            model.train(docs, epochs=1, streams=256, rate=rate, adam=adam)
            docs.clear()

        for batch in batches_of(batches, "text", 2 << 20):
            ids = vocabulary.find(token_numbers(batch.column(0).to_pylist())[0])
            docs.append(np.where(ids < 0, model.words, ids).astype(np.int32))
            n, held = n + len(ids), held + len(ids)
            if held >= _PART:
                learn()
                held = 0
        learn()
        if not n:
            return
        task = TaskContext.get().partitionId()
        for k, v in model.w.items():
            for piece, x in enumerate(np.array_split((v - before[k]).ravel().astype(np.float64) * n, _PIECES)):
                columns = [pa.array([y]) for y in (k, piece, task, n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tolist()], type=pa.list_(pa.float64()))], ["name", "piece", "task", "n", "change"])

    sums = _summed(train.select("text").mapInArrow(run, _CHANGES)).collect()
    for k, v in model.w.items():
        parts = [(r["piece"], np.array(r["change"]) / r["n"]) for r in sums if r["name"] == k]
        if parts:
            v += np.concatenate([x for _, x in sorted(parts, key=lambda y: y[0])]).reshape(v.shape).astype(np.float32)
    return model


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2, model_words: int = 2048, train_bytes: int = 3 << 20, head: int = HEAD) -> DataFrame:
    """Rows (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score), one per row of ``df``.

    Training documents are those whose id's crc32 doesn't leave ``rest``; counts cover all of them,
    the recurrent weights are fitted on a sample of about ``train_bytes`` of text at most, of
    documents no longer than that, and then by all tasks on all training documents. Scores are log10.
    Null and empty texts are the end token alone. Null ids are training documents; repeated
    rows count and are scored each. Without training documents every token is unknown.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), held_out(F.col(id_col), mod, rest).alias("held_out"))
    with scratch(df.sparkSession):
        return materialize(_scored(docs, model_words, train_bytes, head).withColumnRenamed("id", id_col), keep=True)


def _scored(docs: DataFrame, model_words: int, train_bytes: int, head: int) -> DataFrame:
    spark = docs.sparkSession
    train = docs.filter("NOT held_out")
    counts = materialize(word_counts(train))
    top = counts.orderBy(F.col("c").desc(), "h").limit(head).toArrow()
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy().astype(np.int64)
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    N, V = whole["n"] or 0, whole["v"]
    # the end is word 0 of the model, the others by count
    frequent = np.flatnonzero(h != _END)[: model_words - 1]
    known = np.concatenate([[_END], h[frequent]]).astype(np.uint64)
    ends = c[h == _END]
    in_model = np.concatenate([ends if len(ends) else [1], c[frequent]])
    n_rare, v_rare = max(0, N - int(in_model.sum())), max(0, V - len(known))
    model = Model(in_model, n_rare)
    vocabulary = Lookup(known)

    size = train.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    steps = 1 << 20
    picked = F.pmod(F.xxhash64("id"), F.lit(steps)) < int(min(1.0, train_bytes / max(size, 1)) * steps) + 1
    sample = train.filter(picked & (F.octet_length("text") <= train_bytes)).select("id", "text")
    sample = sample.orderBy("id", "text").select("text").toArrow().column(0).to_pylist()
    docs_ids = []
    for text in sample:
        ids = vocabulary.find(token_numbers([text])[0])
        docs_ids.append(np.where(ids < 0, model.words, ids))
    model.train(docs_ids)
    model = averaged(model, train, known)

    sent = spark.sparkContext.broadcast((model, known, h, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, h, c = sent.value
        vocabulary, frequent = Lookup(known), Lookup(h)
        logs = np.log10(np.append(c, 0) + 1.0)
        task = TaskContext.get().partitionId() << 40
        done = 0
        for batch in batches_of(batches, "text", 8 << 20):  # the longest text sets the number of steps
            parts = [token_numbers(b.column(1).to_pylist()) for b in batches_of(iter([batch]), "text", 1 << 20)]
            tokens, per_text = (np.concatenate([p[n] for p in parts]) for n in range(2))
            ids = vocabulary.find(tokens)
            rare = ids < 0
            lm = model.score(np.where(rare, model.words, ids), per_text)
            place = frequent.find(tokens)
            begin = np.cumsum(per_text) - per_text
            sums = lambda x, b=begin: np.add.reduceat(x, b)
            is_tail = place < 0
            own = np.repeat(np.arange(len(per_text)), per_text)[is_tail]
            ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(per_text)))]).astype(np.int32)
            columns = [
                batch.column(0), batch.column(2), pa.array(task + done + np.arange(len(per_text))), pa.array(per_text.astype(np.int64)),
                pa.array(sums((~is_tail).astype(np.int64))), pa.array(sums(logs[place] * ~is_tail)), pa.array(lm / _LN10), pa.array(sums(rare.astype(np.int64))),
                pa.array(sums(logs[place] * (rare & ~is_tail))), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens[is_tail].view(np.int64))),
            ]
            done += len(per_text)
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "row", "n_tokens", "n_head", "head_sum", "lm", "n_rare", "rare_sum", "tail"])

    kind = dict(docs.dtypes)["id"]
    scored = materialize(docs.select("id", "text", "held_out").mapInArrow(run, f"id {kind}, held_out boolean, row long, n_tokens long, n_head long, head_sum double, lm double, n_rare long, rare_sum double, tail array<long>"))
    tail = scored.select("row", F.explode("tail").alias("h")).join(counts, "h")
    tail = tail.groupBy("row").agg(F.count(F.lit(1)).alias("n_tail"), F.sum(F.log10(F.col("c") + 1)).alias("tail_sum"))
    out = scored.drop("tail").join(tail, "row", "left").fillna(0, ["n_tail", "tail_sum"])
    return out.select(
        "id", "held_out", "n_tokens", (F.col("n_head") + F.col("n_tail")).alias("n_known"), F.lit(N).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * F.lit(float(np.log10(N + V + 1)))).alias("base_score"),
        (F.col("lm") + F.col("rare_sum") + F.col("tail_sum") - F.col("n_rare") * F.lit(float(np.log10(n_rare + v_rare + 1)))).alias("score"),
    )
