"""Removal of repeated passages by threshold-bounded interval expansion (operator 9).

A *repeat* is a window of ``least`` words that occurs at more than one place of the corpus.
The first place, by (doc_id, word), keeps it; at all others it is dropped. Overlapping
windows are merged into spans of words.

Windows are brought together by their minimizer: among the word k-grams of a window the
one of the smallest hash, a function of the window's words alone, so equal windows meet.
Consecutive windows of one minimizer travel as one segment, and only those whose
minimizer occurs twice need to: the tasks get a filter of the repeated minimizers, a bit for
each of up to 2**``FILTER_BITS`` hash values, so that beyond some 50 million of them more
and more single ones pass it too and are found to be no repeats in their bucket. Each bucket of segments is then searched as one
string: a suffix array gives its Burrows-Wheeler transform, and breadth-first backward
extension of intervals sets the common-prefix values 0, 1, 2, ... in turn. It stops at
``least``: what has no value by then is a repeat.

Defined results: null or short texts have no repeats; rows with a null doc_id are left out
and kept unchanged by ``drop_repeats``; a place is (doc_id, word), so rows that repeat a
doc_id and its text are one place; ties can't arise; an empty table gives no spans; other
columns are not read, and ``drop_repeats`` returns them as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, large, partitions, trimmed, trimmed_group, unused
from .kernel import U64, _powers, buffers, grams, lowered, mix, slices, words
from .ngram_join import _joined, _pack

LEAST, ANCHOR = 50, 10
#: The filter of repeated minimizers has at most this many bits, as a power of two (64 MB), and this many for each of them.
FILTER_BITS, BITS_EACH = 29, 16
#: Documents with dropped spans up to this many are broadcast to the texts; beyond, the join shuffles.
BROADCAST_DOCS = 1_000_000
_AT = U64((1 << 24) - 1)


def segments(h: np.ndarray, first: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor hash) of each run of windows with one minimizer; start is an index into ``h``."""
    none = np.zeros(0, np.int64)
    n = len(h) - k + 1
    if n < least - k + 1:
        return none, none, none, np.zeros(0, np.uint64)
    g = grams(h, np.array([0, len(h)]), k)[0]
    width, done = least - k + 1, 1
    if n - 1 <= int(_AT):
        low = (g & ~_AT) | np.arange(n, dtype=np.uint64)  # the leftmost of equal ones
        lower = np.minimum
    else:  # a place that doesn't fit beside the hash: the same choice by places alone
        low, high = np.arange(n), g & ~_AT
        lower = lambda x, y: np.where(high[y] < high[x], y, x)
    while done * 2 <= width:
        low = lower(low[:-done], low[done:])
        done *= 2
    if done < width:
        low = lower(low[: len(low) - (width - done)], low[width - done :])
    anchor = (low & _AT).astype(np.int64) if n - 1 <= int(_AT) else low
    size = np.maximum(np.diff(first) - least + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first[:-1], size)
    anchor = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(at) else none
    return row[new], at[new], np.diff(np.append(new, len(at))), g[anchor[new]]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; the text must end in a symbol that occurs once."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


def bounded_lcp(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp): common-prefix length of neighbouring suffixes where below ``least``, else -1.

    Level by level, each interval of suffixes that start with a string is extended to the
    left by every symbol that precedes it. The end of the interval so found, if it has no
    value yet, gets the level as its value, and only then is the interval extended further.
    """
    n = len(text)
    sa = suffix_array(text)
    head = text[sa]
    order = np.argsort(text[sa - 1], kind="stable")  # psi: rank of the suffix one symbol shorter
    psi = np.concatenate([order, [n]])
    lf = np.empty(n, np.int64)
    lf[order] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    lo = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    hi = np.append(lo[1:], n) - 1
    lcp[lo] = 0
    same_next = np.concatenate([head[1:] == head[:-1], [False]])
    for level in range(1, least):
        if not len(lo):
            break
        size = hi - lo + 1
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)
        k = lf[at]
        left, right = np.repeat(lo, size), np.repeat(hi, size)
        last = ~same_next[k] | (psi[k + 1] > right)
        before = np.maximum(k - 1, 0)
        begin = (k == 0) | ~same_next[before] | (psi[before] < left)
        lo, hi = np.sort(k[begin]), np.sort(k[last])
        fresh = lcp[hi + 1] < 0
        lo, hi = lo[fresh], hi[fresh]
        lcp[hi + 1] = level
    return sa, lcp[:n]


def _anchors(docs: DataFrame, least: int, k: int, buckets: int) -> DataFrame:
    """Minimizers that occur twice or more, packed."""
    kinds = pa.schema([("bucket", pa.int32()), ("anchor", pa.binary())])

    def run(batches):
        for batch in batches:
            text = large(batch, "text")
            for a, b in slices(text):
                h, first, _, _ = words(lowered(text.slice(a, b - a)))
                x, count = np.unique(segments(h, first, least, k)[3], return_counts=True)
                x = np.repeat(x, np.minimum(count, 2))
                bucket = (((_spread(x) >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)
                x = x[np.argsort(bucket, kind="stable")]
                cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
                out = [{"bucket": i, "anchor": x[cut[i] : cut[i + 1]].tobytes()} for i in range(buckets) if cut[i] < cut[i + 1]]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    def twice(key, table):
        x, count = np.unique(_joined(table, "anchor", np.uint64), return_counts=True)
        x = x[count > 1]
        return pa.table({"n": pa.array([len(x)], pa.int64()), "anchor": pa.array([x.tobytes()], pa.binary())})

    return docs.where("doc_id is not null").select("text").mapInArrow(trimmed(run), "bucket int, anchor binary").groupBy("bucket").applyInArrow(trimmed_group(twice), "n bigint, anchor binary")


def _spread(anchor: np.ndarray) -> np.ndarray:
    """Even hashes of minimizers, which are small hashes themselves."""
    return mix(anchor + U64(0x3C6EF372FE94F82B))


def _filter(anchors: DataFrame) -> tuple[np.ndarray, int]:
    """(bits, shift): a bit for each value of a hash's leading bits, set where a repeated minimizer has it.

    Buckets are ranges of the hash, so each task makes its own piece of the filter and only
    these come to the driver: together the size of the filter, whatever the number of minimizers.
    """
    n = anchors.agg(F.sum("n")).first()[0] or 0
    bits = min(FILTER_BITS, max(10, math.ceil(math.log2(max(n, 1) * BITS_EACH))))
    shift = U64(64 - bits)

    def run(batches):
        for batch in batches:
            for x in batch.column("anchor"):
                at = (_spread(np.frombuffer(x.as_py(), np.uint64)) >> shift).astype(np.int64)
                if len(at):
                    first = int(at.min()) >> 3
                    piece = np.zeros(((int(at.max()) >> 3) - first + 1) * 8, bool)
                    piece[at - first * 8] = True
                    yield pa.record_batch([pa.array([first], pa.int64()), pa.array([np.packbits(piece, bitorder="little").tobytes()], pa.binary())], names=["first", "piece"])

    out = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    for first, piece in anchors.mapInArrow(trimmed(run), "first bigint, piece binary").toLocalIterator():
        out[first : first + len(piece)] |= np.frombuffer(piece, np.uint8)
    return out, 64 - bits


def _passes(anchor: np.ndarray, known: tuple[np.ndarray, int]) -> np.ndarray:
    at = (_spread(anchor) >> U64(known[1])).astype(np.int64)
    return (known[0][at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _segments(docs: DataFrame, repeated, least: int, k: int, buckets: int) -> DataFrame:
    """Packed segments by bucket of their minimizer. Segments equal to an earlier one of their slice travel without words."""
    kinds = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("doc", "start", "windows", "more", "word"))])

    def run(batches):
        known = repeated.value
        for batch in batches:
            text, ids = large(batch, "text"), batch.column("doc_id").cast(pa.int64()).to_numpy()
            for a, b in slices(text):
                h, first, _, _ = words(lowered(text.slice(a, b - a)))
                row, start, windows, anchor = segments(h, first, least, k)
                hit = _passes(anchor, known)
                row, start, windows, anchor = row[hit], start[hit], windows[hit], anchor[hit]
                if not len(row):
                    continue
                size = windows + least - 1
                power, inverse = _powers(len(h) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])])
                content = mix((total[start + size] - total[start]) * inverse[start] + size.astype(np.uint64))
                doc, place = ids[a:b][row], start - first[row]
                order = np.lexsort((place, doc, content))
                same = np.concatenate([[False], content[order][1:] == content[order][:-1]])
                # 0: alone so far, 1: has equals elsewhere, 2: equals an earlier one, all of it is dropped
                more = np.zeros(len(row), np.uint8)
                more[order[same]] = 2
                again = same & np.concatenate([[False], (doc[order][1:] == doc[order][:-1]) & (place[order][1:] == place[order][:-1])])
                more[order[again]] = 3  # the same place read twice
                heads = np.flatnonzero(~same)
                more[order[heads]] = np.maximum.reduceat((more[order] == 2).astype(np.uint8), heads)
                bucket = (anchor % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                order = order[more[order] != 3]
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = []
                for i in range(buckets):
                    own = order[cut[i] : cut[i + 1]]
                    if len(own):
                        full = own[more[own] != 2]
                        n = size[full]
                        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start[full], n)
                        out.append({"bucket": i} | _pack(doc=doc[own], start=place[own].astype(np.int32), windows=windows[own].astype(np.int32), more=more[own], word=h[at].astype(np.uint32)))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(trimmed(run), "bucket int, doc binary, start binary, windows binary, more binary, word binary")


def _found(parts: DataFrame, least: int) -> DataFrame:
    """doc_id, first and last window and drop: runs of windows that are repeats."""
    kinds = pa.schema([("doc_id", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("drop", pa.bool_())])

    def runs(doc, start, windows, flag):
        """Rows of equal consecutive flags within a segment."""
        seg = np.repeat(np.arange(len(doc)), windows)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
        new = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (flag[1:] != flag[:-1])])) if len(seg) else np.zeros(0, np.int64)
        end = np.append(new[1:], len(seg)) - 1 if len(seg) else new
        on = flag[new] > 0
        new, end = new[on], end[on]
        return [doc[seg[new]], (start[seg[new]] + at[new]).astype(np.int32), (start[seg[new]] + at[end]).astype(np.int32), flag[new] == 2]

    def run(key, table):
        doc, start, windows = _joined(table, "doc", np.int64), _joined(table, "start", np.int32).astype(np.int64), _joined(table, "windows", np.int32).astype(np.int64)
        more, word = _joined(table, "more", np.uint8), _joined(table, "word", np.uint32)
        whole = more == 2
        out = [doc[whole], start[whole].astype(np.int32), (start + windows - 1)[whole].astype(np.int32), np.ones(whole.sum(), bool)]
        doc, start, windows, more = doc[~whole], start[~whole], windows[~whole], more[~whole]
        if len(doc):
            size = windows + least - 1
            begin = np.cumsum(size) - size
            order = np.lexsort((start, doc))
            same = np.concatenate([[False], (doc[order][1:] == doc[order][:-1]) & (start[order][1:] == start[order][:-1])])
            order = order[~same]
            doc, start, windows, more, size, begin = (x[order] for x in (doc, start, windows, more, size, begin))
            # the string: each segment's words and an end of its own
            length = size + 1
            base = np.cumsum(length) - length
            at = np.arange(length.sum()) - np.repeat(base - begin, length)
            stop = base + size
            at[stop] = 0
            text = word[at].astype(np.int64) + len(doc)
            text[stop] = np.arange(len(doc))[::-1]
            sa, lcp = bounded_lcp(text, least)
            group = np.cumsum(lcp >= 0) - 1
            count = np.bincount(group)
            earliest = np.minimum.reduceat(sa, np.flatnonzero(lcp >= 0))
            flag = np.zeros(len(text), np.int8)
            flag[sa] = np.where(count[group] < 2, 0, np.where(sa == earliest[group], 1, 2))
            w = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows - base, windows)
            flag = np.maximum(flag[w], np.repeat(more, windows).astype(np.int8))
            out = [np.concatenate(x) for x in zip(out, runs(doc, start, windows, flag))]
        return pa.table([pa.array(x, f.type) for x, f in zip(out, kinds)], schema=kinds)

    return parts.groupBy("bucket").applyInArrow(trimmed_group(run), "doc_id bigint, a int, b int, drop boolean")


def repeated_windows(docs: DataFrame, least: int = LEAST, k: int = ANCHOR) -> DataFrame:
    buckets = max(4, partitions(docs.sparkSession))
    anchors = durable(_anchors(docs, least, k, buckets))
    return _found(_segments(docs, docs.sparkSession.sparkContext.broadcast(_filter(anchors)), least, k, buckets), least)


def repeated_spans(docs: DataFrame, least: int = LEAST, k: int = ANCHOR) -> DataFrame:
    """doc_id, drop, start_word, end_word (exclusive): merged spans; drop is false where the first occurrence stays."""
    w = Window.partitionBy("doc_id", "drop").orderBy("a", "b")
    return (
        repeated_windows(docs, least, k)
        .withColumn("end", F.col("b") + least)
        .withColumn("before", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("island", F.sum(F.when(F.col("a") <= F.col("before"), 0).otherwise(1)).over(w))
        .groupBy("doc_id", "drop", "island")
        .agg(F.min("a").alias("start_word"), F.max("end").alias("end_word"))
        .select("doc_id", "drop", "start_word", "end_word")
    )


def drop_repeats(docs: DataFrame, least: int = LEAST, k: int = ANCHOR) -> DataFrame:
    """The documents without the spans to drop, ``n_chars`` (if it is a whole number) set anew; one left without a word goes."""
    name = unused(docs, "spans")
    cuts = durable(repeated_spans(docs, least, k).where("drop").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(name)))
    joined = docs.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_DOCS else cuts, "doc_id", "left").select(*docs.columns, name)
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            text, spans = batch.column("text").to_pylist(), batch.column(name).to_pylist()
            keep = np.ones(len(text), bool)
            for i, own in enumerate(spans):
                if own:
                    raw = text[i]
                    column = lowered(pa.array([raw], pa.large_string()))
                    data, _ = buffers(column)
                    _, _, starts, ends = words(column)
                    same = len(data) == len(raw.encode())  # else lower case changed some length
                    body = raw.encode() if same else data.tobytes()
                    at, left, kept = 0, [], 0
                    for s in own:
                        a, b = s["start_word"], min(s["end_word"], len(starts))
                        left.append(body[at : starts[a]])
                        kept += b - a
                        at = ends[b - 1]
                    left.append(body[at:])
                    text[i] = b"".join(left).decode("utf-8", "ignore").strip()
                    keep[i] = kept < len(starts)
            columns = []
            for f, c in zip(batch.schema, batch.columns):
                if f.name == "text":
                    c = pa.array(text, f.type)
                elif f.name == "n_chars" and pa.types.is_integer(f.type):
                    c = pa.array([len(t) if own and t is not None else n for t, own, n in zip(text, spans, c.to_pylist())], f.type)
                if f.name != name:
                    columns.append(c)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(trimmed(run), schema)


ORACLE = f"""
WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - {LEAST} + 1)) AS a FROM w WHERE len(w) >= {LEAST}),
g AS (SELECT doc_id, a, md5(array_to_string(w[a + 1:a + {LEAST}], ' ')) AS h FROM p),
f AS (SELECT doc_id, a, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, a) > 1 AS drop FROM g),
m AS (SELECT *, max(a + {LEAST}) OVER (PARTITION BY doc_id, drop ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f WHERE n > 1),
i AS (SELECT *, sum(CASE WHEN a <= before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, drop ORDER BY a) AS island FROM m)
SELECT doc_id, drop, min(a)::INTEGER AS start_word, max(a + {LEAST})::INTEGER AS end_word FROM i GROUP BY doc_id, drop, island
"""
