"""Language-model scoring with a probabilistic suffix tree (operator 8).

Texts are strings over 256 symbols: the most frequent characters of the corpus (counted in
a pass of its own, lower case) are symbols of their own, all others share 16 symbols by
their block of 128 code points, so that scripts stay apart. A string of 8 symbols is one
64-bit number.

All documents are counted: each task counts the strings of ``DEPTH + 1`` symbols of its
documents, and buckets by the three symbols before the last one add the counts up, so that a
context of three symbols or more meets all its extensions. A context that occurs ``n >= LEAST``
times is a node of the tree if its next-symbol distribution diverges from that of the next
shorter context by so much (Kullback-Leibler) that ``n`` times the divergence is at least
``GAIN`` nats; so are all suffixes of a node. Whether a context is a node depends on its own
counts, not on the size of the corpus, so the tree grows with the corpus (README); ``SHARE`` of
the number of symbols, where it isn't 0, is asked of the nats as well and bounds the tree at the
cost of its rarer contexts.
A node's distribution is smoothed towards that of its parent with the weight of
``PRIOR`` occurrences, the root's towards the uniform one.

Every symbol of every document is scored by the longest node that ends before it. Nodes stand
as sorted ranges of contexts, and a piece of text (``PIECE``) is looked up in their order; a node
has a bit for each symbol that it counts (others are the parent's, scaled), and the bits set before
it are the place of the symbol's cost: 4 bytes a count, some 80 a node.

Defined results: a null or empty text has no symbols and a null score; a document starts
after ``DEPTH`` symbols of a class of its own; characters of equal frequency are ordered by
code point; repeated rows are counted and scored each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large, partitions, release, trimmed, trimmed_group
from .kernel import U64, buffers, lowered, mix, slices

SYMBOLS, OWN, DEPTH = 256, 239, 7
#: 64-bit numbers that hold a bit for each symbol.
WORDS = SYMBOLS // 64
LEAST, GAIN, SHARE, PRIOR = 16, 32.0, 0.0, 8.0
#: Strings that a task holds before it sends their counts on.
HELD = 4_000_000
#: Symbols that are scored, or strings that are sent, at once.
PIECE = 1 << 18
#: Buckets up to which there are four for each partition: a task's row for a bucket stays of some 4,000 strings.
FINE = 1024
SCHEMA = "doc_id bigint, n_symbols bigint, bits double, bits_per_symbol double"


def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the lower-cased rows."""
    data, off = buffers(lowered(column))
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), at


def alphabet(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(symbol of each code point, symbols of the corpus). 0 is kept for what is before a text."""

    def run(batches):
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            text = large(batch, "text")
            for a, b in slices(text):
                n = np.bincount(points(text.slice(a, b - a))[0])
                total[: len(n)] += n
        code = np.flatnonzero(total)
        yield pa.record_batch([pa.array(code.astype(np.int32)), pa.array(total[code])], names=["code", "n"])

    # as many rows as there are characters in use
    found = docs.select("text").mapInArrow(trimmed(run), "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    lut = (240 + (np.arange(0x110000) >> 7) % 16).astype(np.uint8)
    for k, r in enumerate(sorted(found, key=lambda r: (-r[1], r[0]))[:OWN]):
        lut[r[0]] = k + 1
    return lut, sum(r[1] for r in found)


def strings(column: pa.Array, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): each row's symbols after DEPTH zeros."""
    code, at = points(column)
    n = len(at) - 1
    start = at + DEPTH * np.arange(n + 1)
    out = np.zeros(start[-1], np.uint8)
    out[np.arange(len(code)) + DEPTH * np.repeat(np.arange(1, n + 1), np.diff(at))] = lut[code]
    return out, start


def _real(start: np.ndarray) -> np.ndarray:
    """Places of the rows' own symbols."""
    size = np.diff(start) - DEPTH
    return np.arange(size.sum()) + DEPTH * np.repeat(np.arange(1, len(size) + 1), size)


def codes(sym: np.ndarray, depth: int) -> np.ndarray:
    """Number of the ``depth`` symbols up to each place (from place depth - 1 on), the last one lowest."""
    n = len(sym) - depth + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(depth):
        out <<= U64(8)
        out |= sym[i : i + n]
    return out


def _mask(depth: int) -> np.uint64:
    return U64((1 << 8 * depth) - 1)


def _tally(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(x, return_counts=True)
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[edge], np.add.reduceat(n, edge) if len(x) else n


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of sorted counts, made a range of codes at a time: what is held besides is no second copy of all."""
    n = sum(len(x) for x, _ in parts)
    code, count, end = np.empty(n, np.uint64), np.empty(n, np.uint32), 0  # pages that aren't written aren't held
    longest = max((x for x, _ in parts), key=len)
    edges = np.concatenate([longest[:: 1 << 16][1:], longest[:0]])
    cuts = [[0, *np.searchsorted(x, edges), len(x)] for x, _ in parts]
    for k in range(len(edges) + 1):
        x, m = _tally(*(np.concatenate([part[i][cut[k] : cut[k + 1]] for part, cut in zip(parts, cuts)]) for i in (0, 1)))
        code[end : end + len(x)], count[end : end + len(x)] = x, m
        end += len(x)
    return code[:end], count[:end]


def _planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all highest bytes together: sorted codes and small counts compress to a fraction."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(planes: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(_planes(x), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int, kind) -> np.ndarray:
    return _numbers(pa.decompress(packed, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _all_numbers(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([_numbers(x.as_py(), kind) for x in column] or [np.zeros(0, kind)])


def counted(docs: DataFrame, lut, buckets: int) -> DataFrame:
    """bucket, code, count, packed: strings of DEPTH + 1 symbols, a few rows for each task and bucket, sent in small batches."""
    kinds = pa.schema([("bucket", pa.int32()), ("code", pa.binary()), ("count", pa.binary())])

    def sent(code, count):
        bucket = np.empty(len(code), np.min_scalar_type(buckets - 1))
        for a in range(0, len(code), PIECE):
            bucket[a : a + PIECE] = mix((code[a : a + PIECE] >> U64(8)) & _mask(3)) % U64(buckets)
        order = np.argsort(bucket, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
        out, held = [], 0
        for k in np.flatnonzero(np.diff(cut)):
            own = order[cut[k] : cut[k + 1]]
            out.append({"bucket": int(k), "code": _planes(code[own]), "count": _planes(count[own])})
            held += len(own)
            if held > PIECE:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    def run(batches):
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        whole, new = none, []
        for batch in batches:
            text = large(batch, "text")
            for a, b in slices(text, 1 << 20):
                sym, start = strings(text.slice(a, b - a), lut.value)
                if len(sym) > DEPTH:
                    code, count = _tally(codes(sym, DEPTH + 1)[_real(start) - DEPTH])
                    new.append((code, count.astype(np.uint32)))
                if sum(len(x) for x, _ in new) > max(len(whole[0]), HELD // 4):  # added up when they are as many
                    whole, new = _added([whole, *new]), []
                if len(whole[0]) > HELD:
                    yield from sent(*whole)
                    whole = none
        whole, new = _added([whole, *new]), []
        yield from sent(*whole)

    return docs.select("text").mapInArrow(trimmed(run), "bucket int, code binary, count binary")


def _gains(code: np.ndarray, n: np.ndarray, up: np.ndarray, m: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, occurrences, occurrences times divergence from the next shorter context) from the counts of two depths."""
    context, row = np.unique(code >> U64(8), return_inverse=True)
    total = np.bincount(row, n, len(context))
    shorter, which = np.unique(up >> U64(8), return_inverse=True)
    all_ = np.bincount(which, m, len(shorter))
    at = np.searchsorted(up, code & _mask(depth))
    gain = n * (np.log(n / total[row]) - np.log(m[at] / all_[which[at]]))
    return context, total, np.bincount(row, gain, len(context))


def _chosen(levels: dict[int, tuple], deepest: int, first: int, least: int, gain: float, forced: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Nodes of each depth from ``deepest`` down to ``first``; ``forced``: contexts of ``deepest`` that are nodes in any case."""
    nodes, below = {}, forced
    for d in range(deepest, first - 1, -1):
        context, total, gained = _gains(*levels[d], *levels[d - 1], d)
        on = (total >= least) & (gained >= gain)
        if below is not None and len(below):
            on |= np.isin(context, below)
        nodes[d] = context[on]
        below = nodes[d] & _mask(d - 1)
    return nodes


def nodes(docs: DataFrame, least: int = LEAST, gain: float = GAIN, share: float = SHARE) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(symbol of each code point, depth -> (strings of a node and a next symbol, their counts)).

    The nodes and their counts come to the driver, compressed.
    """
    spark = docs.sparkSession
    lut, total = alphabet(docs)
    enough = max(gain, share * total)
    kinds = pa.schema([("depth", pa.int32()), ("n", pa.int64()), ("code", pa.binary()), ("count", pa.binary())])

    def run(key, table):
        code, count = _tally(_all_numbers(table.column("code"), np.uint64), _all_numbers(table.column("count"), np.uint32).astype(np.int64))
        levels = {DEPTH: (code, count)}
        for d in range(DEPTH - 1, 1, -1):
            levels[d] = _tally(levels[d + 1][0] & _mask(d + 1), levels[d + 1][1])
        own = _chosen(levels, DEPTH, 4, least, enough)
        context, row = np.unique(levels[3][0] >> U64(8), return_inverse=True)
        often = np.bincount(row, levels[3][1], len(context)) >= least
        forced = own[4] & _mask(3)
        own[3] = context[often | np.isin(context, forced)]
        out = []
        for d in (2, *own):
            x, n = levels[d]
            on = np.isin(x >> U64(8), own[d]) if d > 2 else slice(None)
            out.append({"depth": d, "n": len(x[on]), "code": _packed(x[on]), "count": _packed(n[on])})
        forced = np.unique(forced)
        out.append({"depth": -3, "n": len(forced), "code": _packed(forced), "count": b""})
        return pa.Table.from_pylist(out, schema=kinds)

    parts = partitions(spark)
    buckets = max(parts, min(4 * parts, FINE))  # several a partition, so that none has far more than others
    grown = counted(docs, spark.sparkContext.broadcast(lut), buckets).groupBy("bucket").applyInArrow(trimmed_group(run), "depth int, n bigint, code binary, count binary").collect()
    rows: dict[int, list] = {}
    while grown:  # each depth's rows are let go once they are joined
        r = grown.pop()
        rows.setdefault(r[0], []).append(r)
    part = lambda rows, i, t: np.concatenate([_unpacked(r[i], r[1], t) for r in rows] or [np.zeros(0, t)])
    forced = part(rows.pop(-3, []), 2, np.uint64)
    out = {}
    for d in range(2, DEPTH + 1):
        own = rows.pop(d, [])
        out[d] = part(own, 2, np.uint64), part(own, 3, np.int64)
        del own
        out[d] = _tally(*out[d])
    for d in (1, 0):
        out[d] = _tally(out[d + 1][0] & _mask(d + 1), out[d + 1][1])
    low = _chosen(out, 3, 1, least, enough, forced)
    for d in (1, 2, 3):
        on = np.isin(out[d][0] >> U64(8), low[d])
        out[d] = out[d][0][on], out[d][1][on]
    return lut, out


class Tree:
    """The tree as tables: node of each context, cost in bits of each counted next symbol, and of leaving it to the parent.

    A context is read from its last symbol backwards, so that those that end with a node are a range of
    numbers, and the ranges of deeper nodes lie within: ``node`` is the longest node from each of ``breaks``
    to the next one. Nodes are numbered in that order. ``bits`` has WORDS numbers for each node, ``before``
    the bits that are set before each of them.
    """

    def __init__(self, lut: np.ndarray, levels: dict[int, tuple[np.ndarray, np.ndarray]], prior: float = PRIOR):
        self.given, self.bits = (lut, levels, prior), None  # the tables are built where texts are scored

    def _build(self, lut: np.ndarray, level, prior: float) -> None:
        """From the counts of one depth at a time, so that no more of them is held at once."""
        self.lut = lut
        cost = lambda p: (-np.log2(p)).astype(np.float32)
        code, n = level(0)
        root = np.zeros(SYMBOLS)
        root[code.astype(np.int64)] = n
        p = (root + 1 / SYMBOLS) / (root.sum() + 1)
        owns, sizes, leave, bits, costs = [np.zeros(1, np.uint64)], [np.full(1, SYMBOLS)], [np.ones(1)], [np.full(WORDS, ~U64(0))], [cost(p)]
        last = np.arange(SYMBOLS, dtype=np.uint64), p  # strings and probabilities a depth higher
        for d in range(1, DEPTH + 1):
            code, n = level(d)  # ascending
            own, first, size = np.unique(code >> U64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(own) else np.zeros(0, np.int64)
            owns.append(own)
            sizes.append(size)
            leave.append(prior / (total + prior))
            p = prior * last[1][np.searchsorted(last[0], code & _mask(d))]
            p += n
            p /= np.repeat(total + prior, size)
            costs.append(cost(p))
            symbol = code & U64(255)
            at = WORDS * np.repeat(np.arange(len(own)), size) + (symbol >> U64(6)).astype(np.int64)
            edge = np.flatnonzero(np.diff(at, prepend=-1))
            bits.append(np.zeros(WORDS * len(own), np.uint64))
            if len(own):
                bits[-1][at[edge]] = np.bitwise_or.reduceat(U64(1) << (symbol & U64(63)), edge)
            last = code, p
        del code, n, p, last, symbol, at, edge
        low = [own.byteswap() for own in owns]  # the last symbol highest
        order = np.argsort(np.concatenate([(x >> U64(5)) | U64(d) for d, x in enumerate(low)]))  # a node before the deeper ones of its range
        base = np.cumsum([0, *map(len, owns)])
        number = np.empty(base[-1], np.int32)
        number[order] = np.arange(base[-1], dtype=np.int32)
        own = [number[a:b] for a, b in zip(base, base[1:])]
        size = np.concatenate(sizes)[order]
        start = np.cumsum(size) - size
        self.costs = np.empty(size.sum(), np.float32)
        for d in range(DEPTH + 1):
            inner = np.cumsum(sizes[d]) - sizes[d]
            self.costs[np.repeat(start[own[d]] - inner, sizes[d]) + np.arange(len(costs[d]))] = costs[d]
            costs[d] = None
        self.bits = np.concatenate(bits).reshape(-1, WORDS)[order].ravel()
        self.leave = cost(np.concatenate(leave)[order])
        parent = [np.zeros(1, np.int32), *(own[d - 1][np.searchsorted(owns[d - 1], owns[d] & _mask(d - 1))] for d in range(1, DEPTH + 1))]
        self.parent = np.concatenate(parent)[order]
        before = np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)
        before[1:], before[:1] = before[:-1].copy(), 0
        self.before = before if len(self.costs) > np.iinfo(np.uint32).max else before.astype(np.uint32)
        # a range ends where the numbers of 64 bits begin anew: that is the root's range, which begins at 0
        self.breaks = np.unique(np.concatenate([x + (U64(1) << U64(64 - 8 * d)) if d else x for d, x in enumerate(low)] + low[1:]))
        self.node = np.zeros(len(self.breaks), np.int32)
        for d in range(1, DEPTH + 1):
            if len(low[d]):
                by = np.argsort(low[d])
                ranges, at = low[d][by], self.breaks & ~(U64(0xFFFFFFFFFFFFFFFF) >> U64(8 * d))
                found = np.minimum(np.searchsorted(ranges, at), len(ranges) - 1)
                on = ranges[found] == at
                self.node[on] = own[d][by[found[on]]]

    def __getstate__(self) -> tuple:
        """What travels: the counts alone, compressed; each worker makes its tables of them once."""
        lut, levels, prior = self.given
        packed = lambda x: (x.dtype.str, len(x), _packed(x))
        return packed(lut), {d: (packed(x), packed(n)) for d, (x, n) in levels.items()}, prior

    def __setstate__(self, state: tuple) -> None:
        lut, levels, prior = state
        found = lambda x: _unpacked(x[2], x[1], x[0])
        self.given = None  # a worker doesn't send the tree on
        self._build(found(lut), lambda d: tuple(map(found, levels[d])), prior)
        release()

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, bits) of each row."""
        if self.bits is None:
            lut, levels, prior = self.given
            self._build(lut, levels.__getitem__, prior)
        sym, start = strings(column, self.lut)
        size = np.diff(start) - DEPTH
        if not size.sum():
            return size, np.zeros(len(size))
        at, bits = _real(start), np.empty(size.sum())
        for a in range(0, len(at), PIECE):
            i = at[a : a + PIECE]
            first = i[0] - DEPTH
            bits[a : a + PIECE] = self._bits(codes(sym[first : i[-1] + 1], DEPTH)[i - i[0]], sym[i])
        cost = np.concatenate([[0.0], np.cumsum(bits)])
        ends = np.concatenate([[0], np.cumsum(size)])
        return size, cost[ends[1:]] - cost[ends[:-1]]

    def _bits(self, before: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Cost of each symbol after the DEPTH symbols before it, looked up in the order of the nodes."""
        key = before.byteswap() | own
        order = np.argsort(key)
        key = key[order]
        node = self.node[np.searchsorted(self.breaks, key, "right") - 1]
        bits, left = np.zeros(len(key)), np.arange(len(key))
        word, bit = ((key >> U64(6)) & U64(3)).astype(np.int64), U64(1) << (key & U64(63))
        while len(left):
            slot = WORDS * node.astype(np.int64) + word
            there = self.bits[slot]
            on = (there & bit) != 0
            bits[left[on]] += self.costs[self.before[slot[on]] + np.bitwise_count(there[on] & (bit[on] - U64(1)))]
            off = np.flatnonzero(~on)
            left, node, word, bit = left[off], node[off], word[off], bit[off]
            bits[left] += self.leave[node]
            node = self.parent[node]
        out = np.empty(len(key))
        out[order] = bits
        return out


def train(docs: DataFrame, least: int = LEAST, gain: float = GAIN, share: float = SHARE) -> Tree:
    return Tree(*nodes(docs, least, gain, share))


def score(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """One row (``SCHEMA``) for each document, under a tree of all documents where none is given."""
    sent = docs.sparkSession.sparkContext.broadcast(tree or train(docs))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = large(batch, "text")
            for a, b in slices(text, PIECE):
                n, bits = sent.value.score(text.slice(a, b - a))
                none = n == 0
                each = [pa.array(x, pa.float64(), mask=none) for x in (bits, bits / np.maximum(n, 1))]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int64()), *each], names=["doc_id", "n_symbols", "bits", "bits_per_symbol"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), SCHEMA)
