"""Benchmark decontamination by latent semantic retrieval (operator 6).

1. Passages are windows of two neighbouring blocks of ``BLOCK`` words. Their terms are the
   words of the benchmark, weighted by inverse document frequency over all documents;
   words of more than a share ``COMMON`` of the documents weigh nothing.
2. A randomised SVD of the passages' TF-IDF matrix ``X``: every task adds its rows to
   ``X'X`` times a random matrix, the sums are reduced by blocks of rows, and the
   Nystroem form of that sketch gives the right singular vectors without another pass.
3. Every passage is folded in (projected and divided by the singular values) and compared with every item; a cosine of at least
   ``COSINE`` makes it a candidate, with no cap on their number.
4. A candidate counts if the longest common subsequence of words, over the passage with an
   item's length on either side, covers ``LCS`` of the item (a copy), or ``LCS_PARAPHRASE``
   of it and nearly all the weighty words of the item's answer, its last sentence (a
   paraphrase).

The text is read three times and never shuffled; only sums the size of the benchmark's
vocabulary move.

Defined results: a null or wordless text has no leak, a null or wordless item is never
leaked, and neither is any without a benchmark; ties go to the passage first in the text;
repeated rows are judged alike, each on its own; empty tables give an empty result; other
columns are not read, and ``drop_leaks`` returns them unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import large, trimmed
from .kernel import U64, lowered, rows_of, slices, words

BLOCK, RANK, OVERSAMPLE = 16, 128, 8
COSINE, LCS, LCS_PARAPHRASE, ANSWER = 0.50, 0.7, 0.5, 0.8
#: Share of the documents beyond which a word has no weight.
COMMON = 0.2
#: Fewest words of an answer; a shorter last sentence is extended to the left.
ANSWER_WORDS = 5
SCHEMA = "doc_id bigint, item_id bigint, cosine double, lcs double, paraphrase boolean"


class Items:
    """The benchmark, read to the driver: its size doesn't follow the corpus."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [r for r in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")) if r[0] is not None and r[1]]
        h, first, _, _ = words(lowered(pa.array([r[1] for r in rows], pa.large_string())))
        self.ids, self.words, self.answers = [], [], []
        for i, (item, text) in enumerate(rows):
            own = h[first[i] : first[i + 1]]
            if len(own):
                tail = text.rstrip().rstrip(".!?").replace("!", ".").replace("?", ".").rpartition(".")[2]
                n = max(ANSWER_WORDS, len(words(lowered(pa.array([tail], pa.large_string())))[0]))
                self.ids.append(item)
                self.words.append(own)
                self.answers.append(own[-n:])
        self.vocabulary = np.unique(np.concatenate(self.words or [np.zeros(0, np.uint64)]))
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.vocabulary >> U64(44)).astype(np.int64)] = True
        self.idf = np.zeros(len(self.vocabulary), np.float32)

    def weigh(self, idf: np.ndarray) -> None:
        """Set the weights; words without one are no longer looked up."""
        self.idf = idf
        self.gate[:] = False
        self.gate[(self.vocabulary[idf > 0] >> U64(44)).astype(np.int64)] = True

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, term): the words that the vocabulary has."""
        at = np.flatnonzero(self.gate[(h >> U64(44)).astype(np.int64)])
        own = h[at]
        term = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        hit = self.vocabulary[term] == own
        return at[hit], term[hit]


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block of each word, row of each block): blocks of BLOCK words within each row."""
    size = np.diff(first)
    count = -(-size // BLOCK)
    base = np.cumsum(count) - count
    row = rows_of(first)
    return base[row] + (np.arange(first[-1]) - first[row]) // BLOCK, np.repeat(np.arange(len(size)), count)


def _sums(table: np.ndarray, term: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Of each block the sum of its terms' rows of the table; ``block`` ascends.

    All blocks' first terms are added at once, then all their second ones, and so on: a
    block has few, and ``reduceat`` is slow at short runs.
    """
    out = np.zeros((n, *table.shape[1:]), np.float32)
    if len(block):
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        size = np.diff(np.append(edge, len(block)))
        k = 0
        while len(edge):
            out[block[edge]] += table[term[edge + k]]
            k += 1
            keep = size > k
            edge, size = edge[keep], size[keep]
    return out


def _windows(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of each block the sum with the next one of its row: the passage that starts there."""
    out = x.copy()
    same = row[1:] == row[:-1]
    out[:-1][same] += x[1:][same]
    return out


def _batches(batches, most: int = 2 << 20):
    for batch in batches:
        text = large(batch, "text")
        for a, b in slices(text, most):
            yield batch, a, b, words(lowered(text.slice(a, b - a)))


def _reduced(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of packed float64 blocks (block int, data binary), added up on the executors."""

    def add(key, table):
        data = [np.frombuffer(x.as_py(), np.float64) for x in table.column("data")]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([np.sum(data, 0).tobytes()], pa.binary())})

    rows = sorted(parts.groupBy("block").applyInArrow(add, "block int, data binary").collect())
    return np.concatenate([np.frombuffer(r[1], np.float64) for r in rows]).reshape(shape) if rows else np.zeros(shape)


def _packed(x: np.ndarray, pieces: int = 12) -> pa.RecordBatch:
    cut = np.array_split(x.ravel(), pieces)
    return pa.record_batch([pa.array(range(pieces), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], names=["block", "data"])


def document_frequency(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """(documents that hold each vocabulary word, documents), over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        it = sent.value
        total = np.zeros(len(it.vocabulary) + 1)
        for _, a, b, (h, first, _, _) in _batches(batches, 2 << 20):
            at, term = it.terms(h)
            for lo in range(0, b - a, 2048):
                hi = min(b - a, lo + 2048)
                i, j = np.searchsorted(at, [first[lo], first[hi]])
                row = np.searchsorted(first, at[i:j], "right") - 1 - lo
                seen = np.zeros((hi - lo, len(total) - 1), bool)
                seen[row, term[i:j]] = True
                total[:-1] += seen.sum(0)
            total[-1] += b - a
        yield _packed(total)

    total = _reduced(docs.select("text").mapInArrow(trimmed(run), "block int, data binary"), (len(items.vocabulary) + 1,))
    return total[:-1], int(total[-1])


def singular_vectors(docs: DataFrame, items: Items, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Right singular vectors (terms x rank) of the passages' row-normalised TF-IDF matrix, over their singular values."""
    n = len(items.vocabulary)
    width = min(rank + OVERSAMPLE, n)
    omega = np.random.default_rng(seed).standard_normal((n, width)).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((items, omega))

    def run(batches):
        it, random = sent.value
        total = np.zeros((n, width))
        weighted = random * it.idf[:, None]
        for _, _, _, (h, first, _, _) in _batches(batches, 2 << 20):
            at, term = it.terms(h)
            if not len(at):
                continue
            block, row = _blocks(first)
            block = block[at]
            norm = _windows(_sums(it.idf**2, term, block, len(row)), row)
            s = _windows(_sums(weighted, term, block, len(row)), row) / np.maximum(norm, 1e-6)[:, None]
            back = s.copy()  # of each block, what the two passages that hold it give
            same = row[1:] == row[:-1]
            back[1:][same] += s[:-1][same]
            order = np.argsort(term, kind="stable")
            t = term[order]
            edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            total[t[edge]] += np.add.reduceat(back[block[order]], edge, 0) * it.idf[t[edge], None]
        yield _packed(total)

    y = _reduced(docs.select("text").mapInArrow(trimmed(run), "block int, data binary"), (n, width))
    # Nystroem: X'X is about y (omega' y)^-1 y', so its eigenvectors are the left singular vectors of y c^-1/2
    shift = 1e-7 * max(np.linalg.norm(y), 1e-30)
    y = y + shift * omega
    c = omega.T @ y
    value, vector = np.linalg.eigh((c + c.T) / 2)
    good = value > max(value.max(), 0) * 1e-9
    f = y @ (vector[:, good] / np.sqrt(value[good]))
    u, s, _ = np.linalg.svd(f, full_matrices=False)
    live = s[:rank] > s[0] * 1e-6 if len(s) else s[:rank] > 0
    return (u[:, :rank][:, live] / s[:rank][live]).astype(np.float32)


def lcs_length(masks: dict[int, int], m: int, seq: list[int], least: float = 0) -> int:
    """Length of the longest common subsequence with the item of ``m`` words that ``masks`` stands for, bit-parallel.

    0 at once where so few words are the item's that it can't reach ``least``.
    """
    own = [masks[w] for w in seq if w in masks]
    if len(own) < least:
        return 0
    full = (1 << m) - 1
    v = full
    for x in own:
        u = v & x
        if u:
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


class Checker:
    """Projections of the items and all that a candidate's check needs."""

    def __init__(self, items: Items, basis: np.ndarray):
        self.items = items
        self.basis = basis * items.idf[:, None]
        latent = []
        for w in items.words:
            _, term = items.terms(w)
            latent.append(self.basis[term].sum(0) if len(term) else np.zeros(basis.shape[1], np.float32))
        latent = np.array(latent, np.float32)
        self.latent = latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]
        self.masks, self.weighty = [], []
        for w, answer in zip(items.words, items.answers):
            mask: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                mask[x] = mask.get(x, 0) | 1 << i
            self.masks.append(mask)
            self.weighty.append(set(answer[items.terms(answer)[0]].tolist()) or set(answer.tolist()))

    def leaks(self, h: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, float, bool]]:
        """(row, item) -> (cosine, share of the item, paraphrase) of the passage that covers the item best."""
        found: dict[tuple[int, int], tuple[float, float, bool]] = {}
        at, term = self.items.terms(h)
        if not len(at):
            return found
        block, row = _blocks(first)
        latent = _windows(_sums(self.basis, term, block[at], len(row)), row)
        live = np.flatnonzero(np.abs(latent).max(1) > 0)
        latent = latent[live]
        least = COSINE * np.linalg.norm(latent, axis=1)
        begin = np.searchsorted(block, live)
        for lo in range(0, len(live), 8192):
            cosine = latent[lo : lo + 8192] @ self.latent.T
            for i, k in zip(*np.nonzero(cosine >= np.maximum(least[lo : lo + 8192], 1e-12)[:, None])):
                r, m, p = int(row[live[lo + i]]), len(self.items.words[k]), int(begin[lo + i])
                region = h[max(first[r], p - m) : min(first[r + 1], p + 2 * BLOCK + m)].tolist()
                share = lcs_length(self.masks[k], m, region, LCS_PARAPHRASE * m) / m
                if share >= LCS_PARAPHRASE:
                    own = set(region)
                    copied = share >= LCS
                    if copied or sum(x in own for x in self.weighty[k]) >= ANSWER * len(self.weighty[k]):
                        c = float(cosine[i, k] / max(least[lo + i] / COSINE, 1e-12))
                        if (r, int(k)) not in found or found[r, int(k)][1] < share:
                            found[r, int(k)] = (c, share, not copied)
        return found


def fit(docs: DataFrame, benchmark: DataFrame) -> Checker | None:
    """Weights and singular vectors over all documents; None without any item."""
    items = Items([tuple(r) for r in benchmark.select("item_id", "text").collect()])
    if not items.ids:
        return None
    df, n = document_frequency(docs, items)
    weight = np.where((df > 0) & (df <= max(COMMON * n, 1)), np.log((1 + n) / np.maximum(df, 1)), 0)
    if not weight.any():  # a corpus too small for any word to be rare
        weight = np.where(df > 0, 1.0, 0)
    items.weigh(weight.astype(np.float32))
    return Checker(items, singular_vectors(docs, items))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row (``SCHEMA``) for each document and item of which a passage is in the document."""
    checker = fit(docs, benchmark)
    sent = docs.sparkSession.sparkContext.broadcast(checker)

    def run(batches):
        names = ["doc_id", "item_id", "cosine", "lcs", "paraphrase"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        for batch, a, b, (h, first, _, _) in _batches(batches):
            found = sent.value.leaks(h, first) if sent.value else {}
            if found:
                ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                rows = [(ids[r], sent.value.items.ids[k], *v) for (r, k), v in sorted(found.items())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, all their columns unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, benchmark))

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for _, a, b, (h, first, _, _) in _batches([batch]):
                for r, _ in sent.value.leaks(h, first) if sent.value else ():
                    keep[a + r] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)
