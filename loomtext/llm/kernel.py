"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the raw UTF-8 buffer of an Arrow string column: one pass of
numpy over all the bytes of a batch instead of a Python loop over its rows.

A *word* is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes of
the lower-cased text (regex ``[a-z0-9\\u0080-\\U0010FFFF]+``).
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Python regex and RE2/Java spellings of the word rule above, for oracles and brute force.
WORD_RE = r"[a-z0-9\u0080-\U0010ffff]+"
WORD_RE2 = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: An odd multiplier is invertible modulo 2**64, so prefix sums give any word's hash.
_R = 0x9E3779B97F4A7C15


def _tables() -> dict:
    """Constants, kept outside of the package: functions that travel by value would each make them anew."""
    state = sys.modules.setdefault("_loomtext_constants", types.ModuleType("_loomtext_constants")).__dict__
    if "word" not in state:
        rng = np.random.default_rng(20240229)
        state["value"] = rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
        word = np.zeros(256, bool)
        word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
        state["word"] = word
        state["pow"] = np.ones(1, np.uint64)
        state["inv"] = np.ones(1, np.uint64)
    return state


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    t = _tables()
    if len(t["pow"]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("pow", _R), ("inv", pow(_R, -1, 2**64))):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            t[name] = np.multiply.accumulate(p)
    return t["pow"][:n], t["inv"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash over all the others."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def lowered(column: pa.Array) -> pa.Array:
    """The column as lower-case Arrow strings; nulls become empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string column without nulls; offsets start at 0."""
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most_bytes`` each; a longer single row is a range of its own."""
    n = len(column)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + most_bytes, "right")) - 1)
        yield a, b
        a = b


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte span of each word, and of each row its first word (len rows + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = _tables()["word"][data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edge = off[1:-1]
    before[edge[edge < len(data)]] = False  # a word never spans two rows
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    edge = edge[(edge > 0) & (edge <= len(data))]
    after[edge - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: equal bytes give equal hashes wherever they lie."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_tables()["value"][data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row, starts, ends) of a lowered column."""
    data, off = buffers(column)
    starts, ends, first = word_spans(data, off)
    return span_hashes(data, starts, ends), first, starts, ends


def word_hash(word: str) -> int:
    """The hash that ``words`` gives this single word."""
    return int(words(lowered(pa.array([word])))[0][0])


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): hashes of all word n-grams that lie within one row."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    own = np.concatenate([[0], np.cumsum(count)])
    if not own[-1]:
        return np.zeros(0, np.uint64), own
    at = np.arange(own[-1]) - np.repeat(own[:-1] - first[:-1], count)
    g = np.zeros(own[-1], np.uint64)
    for i in range(n):
        g = (g + h[at + i]) * U64(_R)
    return mix(g), own
