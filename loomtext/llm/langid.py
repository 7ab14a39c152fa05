"""Language identification by cross-parsing against suffix automata (operator 7).

For each language a suffix automaton is built over a bounded sample of labelled text.
A document is parsed greedily: each phrase is the longest match of what remains against
that automaton (at least one symbol). With ``c`` phrases over ``n`` symbols and ``m``
symbols of labelled text, the cross-parsing entropy is ``c * log2(m) / n`` bits a symbol,
and the language of the fewest bits wins.

The automata are turned into one dense transition table whose entries also carry the
"phrase ends here" flag, so that a step of all documents in all languages is a handful of
numpy operations. Whole texts are parsed; nothing is shuffled but the sample's keys.

Defined results: a null text counts as empty; a text of fewer than two letters, one none of
whose letters the best language's sample has, or a table without labelled text gives a null
language and ``rejected``; ties go to the language first in alphabetical order; of sampled
rows that share a doc_id one is taken; repeated rows are judged alike, each on its own; an empty
table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, large, sample_ids, sampled, trimmed
from .kernel import buffers, lowered, slices

#: Bounds of the labelled sample that the automata are built from: documents, and symbols of
#: these. Texts are taken whole; one that would go beyond the bound is
#: passed over, unless all do: then the shortest is the sample.
SAMPLE_DOCS, SAMPLE_SYMBOLS = 60, 24_000
#: Bits a symbol, without the last phrase, beyond which no known language fits a text.
REJECT_BITS = 5.0
SCHEMA = "doc_id bigint, language string, bits double, margin double, rejected boolean"


def alphabet(texts: list[str]) -> np.ndarray:
    """Symbol of each code point: 0 for all that is no letter, 1 for a letter not seen."""
    lut = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000).astype(np.uint16)
    for n, ch in enumerate(sorted({c for t in texts for c in t.lower() if c.isalpha()})):
        lut[ord(ch)] = n + 2
    return lut


def symbols(column: pa.Array, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of a column: lower case, each run of other characters as one 0, none at the edges."""
    data, off = buffers(lowered(column))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    sym = lut[code].astype(np.int32)
    keep = sym != 0
    inner = ~keep
    inner[1:] &= keep[:-1]
    inner[0] = False
    edge = at[:-1]
    inner[edge[edge < len(inner)]] = False
    keep |= inner
    kept = np.concatenate([[0], np.cumsum(keep)])[at]
    sym = sym[keep]
    last = kept[1:] - 1  # a text that ends in other characters ends in a 0 that doesn't count
    last = last[(kept[1:] > kept[:-1])]
    tail = np.zeros(len(sym), bool)
    tail[last[sym[last] == 0]] = True
    if tail.any():
        gone = np.concatenate([[0], np.cumsum(tail)])
        sym, kept = sym[~tail], kept - gone[kept]
    return sym, kept


def automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def table_of(automata: list[list[dict[int, int]]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(table, roots): entry ``state * size + symbol`` holds ``target * size * 2 + flag``.

    The flag says that the symbol began a new phrase. Frequent states come first; the last
    one follows a symbol that the language doesn't have, a phrase by itself.
    """
    rows, roots, base = [], [], 0
    for nxt in automata:
        order, seen = [0], {0}
        for s in order:  # breadth first: short contexts lie together
            for t in nxt[s].values():
                if t not in seen:
                    seen.add(t)
                    order.append(t)
        new = np.empty(len(nxt), np.int64)
        new[order] = np.arange(len(order))
        root = np.full(size, (base + len(order)) * size * 2 + 1, np.int64)
        for c, t in nxt[0].items():
            root[c] = (base + new[t]) * size * 2 + 1
        block = np.tile(root, (len(order) + 1, 1))
        for s in order:
            for c, t in nxt[s].items():
                block[new[s], c] = (base + new[t]) * size * 2
        block[0] = root & ~1  # the very first symbol continues the first phrase, counted beforehand
        rows.append(block)
        roots.append(base * size)
        base += len(order) + 1
    return np.concatenate(rows).ravel().astype(np.int32), np.array(roots, np.int32)


def phrases(sym: np.ndarray, off: np.ndarray, table: np.ndarray, roots: np.ndarray, width: int = 512) -> np.ndarray:
    """Phrase counts, rows x languages. Rows advance together, longest first, so the active ones are a prefix."""
    n, langs = len(off) - 1, len(roots)
    size = np.diff(off)
    out = np.zeros((n, langs), np.int64)
    order = np.argsort(-size, kind="stable")
    for a in range(0, n, width):
        rows = order[a : a + width]
        ends = size[rows]
        rows = rows[: np.count_nonzero(ends)]
        ends = ends[: len(rows)]
        if not len(rows):
            break
        begin = off[rows]
        state = np.repeat(roots[:, None], len(rows), 1)
        count = np.ones((langs, len(rows)), np.int32)
        active = np.searchsorted(-ends, -np.arange(1, ends[0] + 1), "right")  # rows longer than t
        few = int(np.searchsorted(-active, -12, "right")) if len(rows) > 12 else 0  # then one by one
        st = state
        for t in range(few):
            k = active[t]
            if k != st.shape[1]:
                state[:, : st.shape[1]] = st
                st = state[:, :k]
            v = table.take(st + sym[begin[:k] + t])
            count[:, :k] += v & 1
            st = v >> 1
        state[:, : st.shape[1]] = st
        for i in range(active[few] if few < len(active) else 0):
            rest = sym[begin[i] + few : begin[i] + ends[i]].tolist()
            for j in range(langs):
                s, c = int(state[j, i]), 0
                for x in rest:
                    v = int(table[s + x])
                    c += v & 1
                    s = v >> 1
                count[j, i] += c
        out[rows] = count.T
    return out


class Model:
    """Automata of all languages, small enough to be sent to every task (bounded by SAMPLE_SYMBOLS)."""

    def __init__(self, labelled: list[tuple[str, str]], most: int = SAMPLE_SYMBOLS, reject: float = REJECT_BITS):
        texts: dict[str, list[str]] = {}
        for label, text in labelled:
            if label is not None and text:
                texts.setdefault(label, []).append(text)
        self.lut = alphabet([t for ts in texts.values() for t in ts])
        self.reject, self.langs, self.bits, self.has, automata = reject, [], [], [], []
        for lang in sorted(texts):
            parts, total = [], 0
            for p in (symbols(pa.array([t]), self.lut)[0] for t in texts[lang]):
                if total + len(p) <= most:
                    parts.append(p)
                    total += len(p)
            if not total:  # all of them are longer
                parts = [min((symbols(pa.array([t]), self.lut)[0] for t in texts[lang]), key=len)]
            seq = np.concatenate([np.append(p, 0) for p in parts if len(p)] or [np.zeros(0, np.int32)])
            if len(seq) > 1:
                self.langs.append(lang)
                self.bits.append(np.log2(len(seq)))
                automata.append(automaton(seq.tolist()))
                self.has.append(np.bincount(seq, minlength=int(self.lut.max()) + 1) > 0)
        self.size = int(self.lut.max()) + 1
        if automata:
            self.table, self.roots = table_of(automata, self.size)

    def judge(self, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(language, bits, margin to the second, rejected) of each row."""
        n = len(column)
        if not self.langs:
            return [None] * n, np.full(n, np.nan), np.full(n, np.nan), np.ones(n, bool)
        sym, off = symbols(column, self.lut)
        size = np.diff(off)
        count, unit = phrases(sym, off, self.table, self.roots), np.array(self.bits) / np.maximum(size, 1)[:, None]
        score = count * unit
        best = score.argmin(1)
        order = np.sort(score, 1)
        low = order[:, 0]
        margin = order[:, 1] - low if order.shape[1] > 1 else np.full(n, np.nan)
        # the phrase that the text's end cuts short says nothing, which matters in texts of a word or two
        none = (size == 0) | (((count - 1) * unit)[np.arange(n), best] > self.reject)
        # where every symbol is a phrase, the language may have none of the letters
        for i in np.flatnonzero((count[np.arange(n), best] >= size) & ~none):
            own = sym[off[i] : off[i + 1]]
            own = own[own > 0]
            none[i] = len(own) < 2 or not self.has[best[i]][own].any()
        low, margin = np.where(size == 0, np.nan, low), np.where(size == 0, np.nan, margin)
        return [None if z else self.langs[b] for b, z in zip(best, none)], low, margin, none


def train(docs: DataFrame, label: str = "lang", per_label: int = SAMPLE_DOCS, most: int = SAMPLE_SYMBOLS, reject: float = REJECT_BITS) -> Model:
    """Automata from at most ``per_label`` labelled documents of each language, whole, and ``most`` symbols."""
    ids = sample_ids(docs, "doc_id", label, per_label)
    return Model([(r[1], r[2]) for r in sampled(docs, "doc_id", ids, label, "text")], most, reject)


def _judged(model, batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple]]:
    text = large(batch, "text")
    for a, b in slices(text, 3 << 20):
        yield a, b, model.value.judge(text.slice(a, b - a))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each document: ``SCHEMA``. ``model`` is trained on ``docs.lang`` where not given."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("language", pa.string()), ("bits", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        for batch in batches:
            for a, b, (lang, bits, margin, none) in _judged(shared, batch):
                number = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
                yield batch_of(schema, [batch.column("doc_id").slice(a, b - a).cast(pa.int64()), lang, number(bits), number(margin), none])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents whose language is known, all their columns unchanged; filtered in one pass, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches):
        for batch in batches:
            keep = np.concatenate([~d[3] for _, _, d in _judged(shared, batch)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(trimmed(run), docs.schema)
