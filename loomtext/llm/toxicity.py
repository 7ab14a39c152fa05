"""Toxicity from a bidirectional gated recurrent network with attention pooling (operator 1).

A word's input joins a word part (its smoothed log-odds in the labelled sample and a
learned vector of its hash) and a character part (the highest log-odds of its four-byte
pieces and the mean learned vector of its three-byte pieces), so that unseen forms of a
known stem count too. Two gated recurrent units read a window of ``WINDOW`` words from
either side, attention pools their states, and a logistic unit scores the window. Windows
overlap by half, all of them are scored, and a document is as toxic as its worst window.

Trained in numpy (back-propagation through time, Adam) on a bounded sample of labelled
documents. Only documents are labelled, so a toxic one contributes the window that looks
worst so far (by log-odds at first, then by the network), a clean one its worst and some
others.

Defined results: a null or wordless text has no window, score 0 and is not toxic; without
labels of both kinds all scores are null; labels without a document or value,
and those of a document whose labels disagree, are left out; of sampled rows that share a
doc_id one is taken;
repeated rows are scored alike, each on its own; of equally bad windows the first is named;
a score of exactly 0.5 is toxic; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import agreed, large, sample_ids, sampled, trimmed
from .kernel import U64, buffers, lowered, mix, rows_of, slices, words

#: Bound of the labelled sample: documents of each label.
SAMPLE_DOCS = 1500
WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION, WORD_DIM, CHAR_DIM = 8, 8, 4, 6
WORD_ROWS, CHAR_ROWS, ODDS_ROWS = 4096, 2048, 1 << 16
ROUNDS, EPOCHS, STEPS, BATCH, RATE, OTHERS = 2, 6, 150, 256, 0.01, 3
SCHEMA = "doc_id bigint, n_windows bigint, toxicity double, at_word int, toxic boolean"


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash class, first): the n-byte pieces of each word, the last bytes padded with blanks; every word has one."""
    size = np.maximum(ends - starts - n + 1, 1)
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - starts, size)
    end = np.repeat(ends, size)
    code = np.zeros(len(at), np.uint64)
    for i in range(n):
        inside = at + i < end
        code = code * U64(256) + np.where(inside, data[np.minimum(at + i, len(data) - 1)], 32).astype(np.uint64)
    return (mix(code) % U64(rows)).astype(np.int64), first


class Slice:
    """Words of some texts, each different word once, with what its input is made of."""

    def __init__(self, column: pa.Array):
        low = lowered(column)
        data, _ = buffers(low)
        h, self.first, starts, ends = words(low)
        self.hash, one, self.word = np.unique(h, return_index=True, return_inverse=True)
        starts, ends = starts[one], ends[one]
        self.tri, self.tri_first = pieces(data, starts, ends, 3, CHAR_ROWS) if len(one) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.quad, self.quad_first = pieces(data, starts, ends, 4, ODDS_ROWS) if len(one) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.bucket = (self.hash % U64(WORD_ROWS)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word of each place, windows x WINDOW, -1 beyond the text's end; row; start)."""
        size = np.diff(self.first)
        count = np.where(size > 0, np.maximum(-(-(size - WINDOW) // STRIDE), 0) + 1, 0)
        row = np.repeat(np.arange(len(size)), count)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        at = start[:, None] + np.arange(WINDOW)
        inside = at < size[row][:, None]
        if not len(self.word):
            return np.full(at.shape, -1, np.int32), row, start
        return np.where(inside, self.word[np.minimum(self.first[row][:, None] + at, len(self.word) - 1)], -1).astype(np.int32), row, start


def _odds(positive: np.ndarray, negative: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """Log-odds of document frequencies, drawn to 0 where there are few documents."""
    seen = positive + negative
    return (np.log((positive + 0.5) / (n[1] + 1)) - np.log((negative + 0.5) / (n[0] + 1))) * seen / (seen + 5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights, forward and backward passes. ``x`` is windows x WINDOW x inputs, ``mask`` 1 where there is a word."""

    def __init__(self, inputs: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": 0.1 * init(WORD_ROWS, WORD_DIM) * np.sqrt(WORD_ROWS), "char": 0.1 * init(CHAR_ROWS, CHAR_DIM) * np.sqrt(CHAR_ROWS)}
        for d in "fb":
            self.p |= {f"W{d}": init(inputs, 3 * HIDDEN), f"U{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": init(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": init(ATTENTION), "w": init(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, project: dict[str, np.ndarray], mask: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits. ``project[d](t)`` gives the input parts of all gates at place ``t`` (bias included)."""
        n, steps, h1 = len(mask), mask.shape[1], HIDDEN
        states = np.zeros((n, steps, 2 * h1), mask.dtype)
        for k, d in enumerate("fb"):
            u = self.p[f"U{d}"]
            h = np.zeros((n, h1), mask.dtype)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g = project[d](t)
                s = h @ u
                zr = _sigmoid(g[:, : 2 * h1] + s[:, : 2 * h1])
                z, r = zr[:, :h1], zr[:, h1:]
                c = np.tanh(g[:, 2 * h1 :] + r * s[:, 2 * h1 :])
                m = mask[:, t : t + 1]
                new = h + m * (1 - z) * (c - h)
                if trace is not None:
                    trace[d, t] = h, z, r, c, s[:, 2 * h1 :]
                h = new
                states[:, t, k * h1 : (k + 1) * h1] = h
        key = np.tanh(states @ self.p["A"] + self.p["a"])
        score = np.where(mask > 0, key @ self.p["v"], -1e9)
        weight = np.exp(score - score.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, states)
        if trace is not None:
            trace |= {"states": states, "key": key, "weight": weight, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """(mean log loss, gradients of the weights, of the inputs)."""
        p, tr, h1 = self.p, {}, HIDDEN
        gates = {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
        logit = self.run({d: (lambda t, g=gates[d]: g[:, t]) for d in "fb"}, mask, tr)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        dl = (_sigmoid(logit) - y) / len(y)
        g = {"w": tr["pooled"].T @ dl, "b": np.array([dl.sum()])}
        dpool = dl[:, None] * p["w"]
        dweight = np.einsum("nh,nth->nt", dpool, tr["states"])
        dstates = tr["weight"][:, :, None] * dpool[:, None, :]
        dscore = tr["weight"] * (dweight - (tr["weight"] * dweight).sum(1, keepdims=True))
        g["v"] = np.einsum("nt,nta->a", dscore, tr["key"])
        dkey = dscore[:, :, None] * p["v"] * (1 - tr["key"] ** 2)
        g["A"], g["a"] = np.einsum("nth,nta->ha", tr["states"], dkey), dkey.sum((0, 1))
        dstates = dstates + dkey @ p["A"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p[f"U{d}"]
            dgate = np.zeros((*mask.shape, 3 * h1), x.dtype)
            du, dh = np.zeros_like(u), np.zeros((len(x), h1), x.dtype)
            steps = range(mask.shape[1] - 1, -1, -1) if d == "f" else range(mask.shape[1])
            for t in steps:
                h, z, r, c, s = tr[d, t]
                dh = dh + dstates[:, t, k * h1 : (k + 1) * h1]
                m = mask[:, t : t + 1]
                dc = dh * m * (1 - z) * (1 - c * c)
                dz = dh * m * (h - c) * z * (1 - z)
                dr = dc * s * r * (1 - r)
                part = np.concatenate([dz, dr, dc * r], 1)
                du += h.T @ part
                dgate[:, t] = np.concatenate([dz, dr, dc], 1)
                dh = dh * (1 - m * (1 - z)) + part @ u.T
            g[f"U{d}"], g[f"c{d}"] = du, dgate.sum((0, 1))
            g[f"W{d}"] = np.einsum("nti,ntg->ig", x, dgate)
            dx += dgate @ p[f"W{d}"].T
        return loss, g, dx


class Model:
    """The network with the log-odds of its labelled sample."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 5):
        self.net = None
        y = np.array(labels, np.int64)
        sl = Slice(pa.array(texts, pa.large_string()))
        if len(set(labels)) < 2 or not len(sl.word):
            return
        n = (int((y == 0).sum()), int((y == 1).sum()))
        row = rows_of(sl.first)

        def frequency(pieces_of, classes: int) -> np.ndarray:
            """Log-odds of the classes, from some documents at a time."""
            seen = np.zeros((2, classes))
            for lo in range(0, len(y), 100):
                hi = min(len(y), lo + 100)
                a, b = sl.first[lo], sl.first[hi]
                pair = np.unique(row[a:b] * len(sl.hash) + sl.word[a:b])
                rows, code = pieces_of(pair // len(sl.hash), pair % len(sl.hash))
                pair = np.unique(rows * classes + code)
                for k in (0, 1):
                    seen[k] += np.bincount((pair % classes)[y[pair // classes] == k], minlength=classes)
            return _odds(seen[1], seen[0], n).astype(np.float32)

        def quads(rows: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = np.diff(sl.quad_first)[word]
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - sl.quad_first[word], size)
            return np.repeat(rows, size), sl.quad[at]

        self.known, self.odds = sl.hash, frequency(lambda rows, word: (rows, word), len(sl.hash))
        self.quads = frequency(quads, ODDS_ROWS)
        self.net = Network(3 + WORD_DIM + CHAR_DIM, seed)
        self._train(sl, y, np.random.default_rng(seed))

    def fixed(self, sl: Slice) -> np.ndarray:
        """Of each word its log-odds, those of its worst piece, and its length."""
        at = np.minimum(np.searchsorted(self.known, sl.hash), len(self.known) - 1)
        word = np.where(self.known[at] == sl.hash, self.odds[at], 0)
        piece = np.maximum.reduceat(self.quads[sl.quad], sl.quad_first[:-1]) if len(sl.hash) else np.zeros(0)
        return np.stack([word, piece, np.minimum(np.diff(sl.quad_first), 20) / 10], 1).astype(np.float32)

    def inputs(self, sl: Slice, fixed: np.ndarray | None = None) -> np.ndarray:
        """Input of each word."""
        p = self.net.p
        total = np.concatenate([np.zeros((1, CHAR_DIM)), np.cumsum(p["char"][sl.tri], 0, dtype=np.float64)])
        char = (total[sl.tri_first[1:]] - total[sl.tri_first[:-1]]) / np.diff(sl.tri_first)[:, None]
        return np.concatenate([self.fixed(sl) if fixed is None else fixed, p["word"][sl.bucket], char], 1).astype(np.float32)

    def logits(self, sl: Slice, index: np.ndarray, batch: int = 1024, fixed: np.ndarray | None = None) -> np.ndarray:
        """Logit of each window. Gates' input parts are computed once a word."""
        x = self.inputs(sl, fixed)
        project = {d: np.concatenate([x @ self.net.p[f"W{d}"] + self.net.p[f"c{d}"], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"}
        out = np.empty(len(index), np.float32)
        for i in range(0, len(index), batch):
            own = np.ascontiguousarray(index[i : i + batch].T)
            mask = (index[i : i + batch] >= 0).astype(np.float32)
            out[i : i + batch] = self.net.run({d: (lambda t, g=project[d]: g[own[t]]) for d in "fb"}, mask)
        return out

    def _train(self, sl: Slice, y: np.ndarray, rng: np.random.Generator) -> None:
        index, row, _ = sl.windows()
        fixed = self.fixed(sl)
        pad = np.concatenate([fixed, np.zeros((1, fixed.shape[1]), np.float32)])
        look = np.concatenate([np.maximum(pad[i, 0], 0).sum(1) + np.maximum(pad[i, 1], 0).max(1) for i in np.array_split(index, -(-len(index) // 4096))])
        p = self.net.p
        m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        share = np.diff(sl.tri_first)
        for turn in range(ROUNDS):
            if turn:
                look = self.logits(sl, index, fixed=fixed)
            order = np.lexsort((-look, row))
            worst = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
            clean = np.flatnonzero(y[row] == 0)
            more = rng.choice(clean, min(len(clean), OTHERS * len(worst)), replace=False) if len(clean) else clean
            chosen = np.unique(np.concatenate([worst, more]))
            for _ in range(max(EPOCHS, -(-STEPS // max(1, len(chosen) // BATCH)))):
                for own in np.array_split(rng.permutation(chosen), max(1, len(chosen) // BATCH)):
                    at, inverse = np.unique(index[own], return_inverse=True)
                    inverse = inverse.reshape(index[own].shape)
                    x = self.inputs(sl, fixed)[np.maximum(at, 0)] if len(sl.hash) < 4096 else self._some(sl, fixed, np.maximum(at, 0))
                    mask = (index[own] >= 0).astype(np.float32)
                    _, g, dx = self.net.gradients(x[inverse], mask, y[row[own]].astype(np.float32))
                    flat = np.zeros((len(at), dx.shape[2]), np.float32)
                    np.add.at(flat, inverse.ravel(), (dx * mask[:, :, None]).reshape(-1, dx.shape[2]))
                    live = at >= 0
                    at, flat = at[live], flat[live]
                    g["word"] = np.zeros_like(p["word"])
                    np.add.at(g["word"], sl.bucket[at], flat[:, 3 : 3 + WORD_DIM])
                    n = share[at]
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - sl.tri_first[at], n)
                    g["char"] = np.zeros_like(p["char"])
                    np.add.at(g["char"], sl.tri[place], np.repeat(flat[:, 3 + WORD_DIM :] / n[:, None], n, 0))
                    step += 1
                    for k in p:
                        m[k] += 0.1 * (g[k] - m[k])
                        v[k] += 0.01 * (g[k] ** 2 - v[k])
                        p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def _some(self, sl: Slice, fixed: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Inputs of some of the words."""
        n = np.diff(sl.tri_first)[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - sl.tri_first[at], n)
        char = np.add.reduceat(self.net.p["char"][sl.tri[place]], np.cumsum(n) - n, 0) / n[:, None]
        return np.concatenate([fixed[at], self.net.p["word"][sl.bucket[at]], char], 1).astype(np.float32)

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, score of the worst one, its first word) of each row."""
        sl = Slice(column)
        index, row, start = sl.windows()
        n = np.bincount(row, minlength=len(column))
        score, at = np.zeros(len(column)), np.zeros(len(column), np.int32)
        if self.net is None:
            return n, np.full(len(column), np.nan), at
        if len(row):
            logit = self.logits(sl, index)
            first = np.concatenate([[0], np.cumsum(n)])[:-1][n > 0]
            order = np.lexsort((start, -logit, row))[first]
            score[n > 0] = _sigmoid(logit[order].astype(np.float64))
            at[n > 0] = start[order]
        return n, score, at


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_DOCS) -> Model:
    """The model of at most ``per_label`` documents of each label."""
    labels = agreed(labels.where("toxic in (0, 1)"), "doc_id", "toxic")
    ids = sample_ids(labels, "doc_id", "toxic", per_label)
    if not ids:
        return Model([], [])
    known = {r[0]: r[1] for r in labels.where(F.col("doc_id").isin(ids)).collect()}
    rows = [(r[0], r[1] or "") for r in sampled(docs, "doc_id", ids, "text")]
    return Model([t for _, t in rows], [known[i] for i, _ in rows])


def score(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """One row (``SCHEMA``) for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batches):
        for batch in batches:
            text = large(batch, "text")
            for a, b in slices(text, 2 << 20):
                n, s, at = sent.value.judge(text.slice(a, b - a))
                with np.errstate(invalid="ignore"):
                    yield pa.record_batch([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float64(), mask=np.isnan(s)), pa.array(at, pa.int32()), pa.array(s >= 0.5)], names=["doc_id", "n_windows", "toxicity", "at_word", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)
