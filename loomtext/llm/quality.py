"""Document quality from a linear-chain conditional random field over lines (operator 10).

Each non-blank line is good or bad. Its features are measures of the line and of its two
neighbours; the field adds weights for the pairs of neighbouring labels. It is trained in
numpy on a bounded sample of labelled documents, whose lines all take the document's
label, by maximum conditional likelihood (Adam). Forward-backward marginals of all lines,
weighted by their bytes, give the document's quality: the expected share of good text.

Defined results: a null text or one of blank lines has no lines, a null quality and is not
good; without labels of both kinds, quality is null throughout; labels without a document
or value, and those of a document whose labels disagree, are left out; of sampled rows that
share a doc_id one is taken; repeated rows are scored alike, each on its own; a quality of
exactly 0.5 is good; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import agreed, large, sample_ids, sampled, trimmed
from .kernel import buffers, lowered, slices, span_hashes, word_spans

#: Bound of the labelled sample: documents of each label.
SAMPLE_DOCS = 500
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
SCHEMA = "doc_id bigint, n_lines bigint, quality double, good boolean"
_KINDS: list = []


def _kinds() -> np.ndarray:
    """Flags of each byte: letter, upper case, digit, sentence mark, other mark, bar."""
    if not _KINDS:
        t = np.zeros((6, 256), bool)
        t[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = True
        t[1, 65:91] = True
        t[2, 48:58] = True
        t[3, [ord(c) for c in ".,;:?'\"-()"]] = True
        t[4, [ord(c) for c in "#$%&*!+=<>@^_~/\\[]{}"]] = True
        t[5, ord("|")] = True
        _KINDS.append(t)
    return _KINDS[0]


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, first): of each non-blank line, and of each row its first line."""
    column = pa.array(column.fill_null(""), pa.large_string())
    data, off = buffers(column)
    n = len(off) - 1
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([off[:-1], cut + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    if not len(begin):
        return np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    total = lambda flag: np.add.reduceat(flag, begin, dtype=np.int64)
    solid = total((data > 32).astype(np.uint8))
    counts = [total(t[data].view(np.uint8)) for t in _kinds()]
    keep = solid > 0
    low, lo_off = buffers(lowered(column))
    if len(low) == len(data):
        starts, ends, _ = word_spans(low, lo_off)
        word = span_hashes(low, starts, ends)
    else:  # lower case changed some length; words are taken as they are
        starts, ends, _ = word_spans(data, off)
        word = span_hashes(data, starts, ends)
    line = np.searchsorted(begin, starts, "right") - 1
    n_words = np.bincount(line, minlength=len(begin))
    order = np.lexsort((word, line))
    new = np.concatenate([[True], (word[order][1:] != word[order][:-1]) | (line[order][1:] != line[order][:-1])]) if len(word) else np.zeros(0, bool)
    distinct = np.bincount(line[order][new], minlength=len(begin))
    text = span_hashes(data, begin, np.maximum(end - (data[end - 1] == 10), begin))
    row = np.searchsorted(off, begin, "right") - 1
    begin, end, row, text = begin[keep], end[keep], row[keep], text[keep]
    solid, n_words, distinct = solid[keep], n_words[keep], distinct[keep]
    letter, upper, digit, mark, odd, bar = (c[keep] for c in counts)
    size = np.maximum(solid, 1)
    _, inverse, times = np.unique(np.stack([row.astype(np.uint64), text]), axis=1, return_inverse=True, return_counts=True)
    inverse = inverse.ravel()
    same = np.zeros(len(row), bool)
    same[1:] = (row[1:] == row[:-1]) & (text[1:] == text[:-1])
    last = data[np.maximum(end - 1 - (data[end - 1] == 10), begin)]
    own = np.stack(
        [
            np.log1p(solid) / 5,
            np.log1p(n_words) / 3,
            letter / size,
            upper / np.maximum(letter, 1),
            digit / size,
            mark / size,
            odd / size * 4,
            bar / size * 10,
            np.minimum(letter / np.maximum(n_words, 1), 20) / 10,
            distinct / np.maximum(n_words, 1),
            np.isin(last, np.frombuffer(b".?!\"'", np.uint8)).astype(float),
            same.astype(float),
            np.minimum(times[inverse] - 1, 5) / 5,
        ],
        axis=1,
    )
    blank = np.zeros((1, own.shape[1]))
    first = np.searchsorted(row, np.arange(n + 1))
    before, after = np.concatenate([blank, own[:-1]]), np.concatenate([own[1:], blank])
    head, tail = np.zeros(len(row), bool), np.zeros(len(row), bool)
    live = first[1:] > first[:-1]
    head[first[:-1][live]] = True
    tail[first[1:][live] - 1] = True
    before[head], after[tail] = 0, 0
    return np.concatenate([np.ones((len(row), 1)), own, before, after, head[:, None], tail[:, None]], 1), end - begin, first


def marginals(score: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of good, pair marginals summed, log normaliser of each row) of all chains at once.

    ``score``: of each line for good over bad; ``pair``: 2 x 2 weights of neighbouring labels.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    node = np.stack([np.zeros(len(score)), score], 1)
    shift = node.max(1)
    node = np.exp(node - shift[:, None])
    trans = np.exp(pair - pair.max())
    alpha, scale = np.zeros_like(node), np.ones(len(node))
    for t in range(longest):
        at = begin[: active[t]] + t
        a = node[at] if t == 0 else (alpha[at - 1] @ trans) * node[at]
        z = a.sum(1)
        alpha[at], scale[at] = a / z[:, None], z
    beta = np.ones_like(node)
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        ahead = node[at + 1] * beta[at + 1] / scale[at + 1, None]
        beta[at] = ahead @ trans.T
        pairs += trans * (alpha[at].T @ ahead)
    log = np.concatenate([[0], np.cumsum(np.log(scale) + shift)])
    norm = log[first[1:]] - log[first[:-1]] + np.maximum(np.diff(first) - 1, 0) * pair.max()
    return (alpha * beta)[:, 1], pairs, norm


class Field:
    """Weights of the field, trained on whole labelled documents."""

    def __init__(self, texts: list[str], labels: list[int]):
        self.weight = None
        x, _, first = lines(pa.array(texts, pa.large_string()))
        y = np.repeat(np.array(labels, float), np.diff(first))
        if len(set(labels)) < 2 or len(set(y)) < 2:
            return
        self.mean, self.dev = x.mean(0), x.std(0) + 1e-6
        self.mean[0], self.dev[0] = 0, 1
        x = (x - self.mean) / self.dev
        n = len(x)
        inner = np.ones(n, bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), 1)
        w = np.zeros(x.shape[1] + 4)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, STEPS + 1):
            p, pairs, _ = marginals(x @ w[:-4], w[-4:].reshape(2, 2), first)
            g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / n - RIDGE * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weight = w

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lines, quality) of each row; quality is NaN where it is undefined."""
        x, size, first = lines(column)
        n = np.diff(first)
        if self.weight is None or not len(x):
            return n, np.full(len(n), np.nan)
        p, _, _ = marginals(((x - self.mean) / self.dev) @ self.weight[:-4], self.weight[-4:].reshape(2, 2), first)
        good, all_ = (np.concatenate([[0], np.cumsum(s)]) for s in (p * size, size.astype(float)))
        with np.errstate(invalid="ignore"):
            return n, np.where(n > 0, (good[first[1:]] - good[first[:-1]]) / np.maximum(all_[first[1:]] - all_[first[:-1]], 1), np.nan)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_DOCS) -> Field:
    """The field of at most ``per_label`` documents of each label."""
    labels = agreed(labels.where("quality in (0, 1)"), "doc_id", "quality")
    ids = sample_ids(labels, "doc_id", "quality", per_label)
    if not ids:
        return Field([], [])
    known = {r[0]: r[1] for r in labels.where(F.col("doc_id").isin(ids)).collect()}
    rows = [(r[0], r[1] or "") for r in sampled(docs, "doc_id", ids, "text")]
    return Field([t for _, t in rows], [known[i] for i, _ in rows])


def score(docs: DataFrame, labels: DataFrame | None = None, field: Field | None = None) -> DataFrame:
    """One row (``SCHEMA``) for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(field or train(docs, labels))

    def run(batches):
        for batch in batches:
            text = large(batch, "text")
            for a, b in slices(text, 2 << 20):
                n, q = sent.value.judge(text.slice(a, b - a))
                with np.errstate(invalid="ignore"):
                    yield pa.record_batch([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(q, pa.float64(), mask=np.isnan(q)), pa.array(q >= 0.5)], names=["doc_id", "n_lines", "quality", "good"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)
