"""Hashes of shingles, counts of trigrams and byte hashes by numpy over whole Arrow buffers, for many long texts."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa

#: White space as Java's ``(?U)\\s`` has it; ``str.split`` splits at four control characters too.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(f"[{SPACE}]+")
#: Characters of the texts that are held as numbers at a time.
SLICE = 1 << 21


def words(text: str) -> list[str]:
    """The tokens of ``text.tokens``."""
    return [w for w in _SPACES.split(text) if w] if _CONTROL.search(text) else text.split()


def shingle_digests(lowered: str | None, k: int = 3) -> np.ndarray:
    """md5 of the distinct word k-grams of a lower-case text, a row of 16 bytes each."""
    w = words(lowered or "")
    md5 = hashlib.md5
    grams = set(map(" ".join, zip(*(w[i:] for i in range(k)))))
    return np.frombuffer(b"".join([md5(g.encode()).digest() for g in grams]), np.uint8).reshape(-1, 16)


def simhash(digests: np.ndarray) -> int:
    """64 majority votes over the first 64 bits, ties 0, as a signed number."""
    if not len(digests):
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, len(digests), 4096):
        votes += np.unpackbits(digests[i : i + 4096, :8], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(digests)).tobytes(), "big", signed=True)


def minhash(digests: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of ``(h * a + b) % 2**32`` over the first 32 bits; zeros for no digest."""
    if not len(digests):
        return np.zeros(len(a), np.int64)
    h = np.unique(np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64))
    return np.min([((h[i : i + 4096, None] * a + b) & 0xFFFFFFFF).min(0) for i in range(0, len(h), 4096)], 0)


def bounds(column: pa.LargeStringArray) -> np.ndarray:
    """Where each row starts and ends in the column's bytes."""
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)


def slices(column: pa.LargeStringArray, most: int = SLICE):
    """(from, to) of the rows that have some ``most`` bytes together, one row at least."""
    size = np.diff(bounds(column))
    at, ends = 0, np.cumsum(size)
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def characters(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in turn, and where each row starts and ends among them."""
    offsets = bounds(column)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), lead[offsets - offsets[0]]


def trigrams(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count, alphabet): distinct character trigrams of each row, by row; a gram is three places in the alphabet, to its base."""
    points, at = characters(column)
    alphabet, code = np.unique(points, return_inverse=True)
    base = max(1, len(alphabet))
    size = np.maximum(np.diff(at) - 2, 0)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[:-1], size)
    gram = (code[place] * base + code[place + 1]) * base + code[place + 2] if len(place) else np.zeros(0, np.int64)
    if base**3 * max(1, len(size)) < 1 << 63:
        key = np.sort(row * base**3 + gram)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        row, gram = np.divmod(key[start], base**3)
    else:
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])]))
        row, gram = row[start], gram[start]
    return row, gram, np.diff(np.append(start, len(place))), alphabet


def spelled(gram: np.ndarray, alphabet: np.ndarray) -> pa.LargeStringArray:
    """The trigrams as strings."""
    base = max(1, len(alphabet))
    points = np.ascontiguousarray(alphabet[np.stack([gram // base // base, gram // base % base, gram % base], 1)].astype("<u4"))
    size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(size.sum(1))]).astype(np.int64)
    data = points.tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(gram), pa.py_buffer(offsets), pa.py_buffer(data))


def fnv1a(texts: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each, a byte of all texts at a time."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-size, kind="stable")
    at = (np.cumsum(size) - size)[order]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    h = np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    live, prime = len(texts), np.uint64(0x100000001B3)
    ascending = size[order][::-1]
    for i in range(int(size.max(initial=0))):
        live = len(texts) - int(np.searchsorted(ascending, i, "right"))
        if live < 24:
            break
        h[:live] = (h[:live] ^ raw[at[:live] + i].astype(np.uint64)) * prime
    else:
        live = 0
    for k in range(live):  # the few longest one by one
        x = int(h[k])
        for b in texts[order[k]][i:]:
            x = (x ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        h[k] = x
    out = np.empty(len(texts), np.uint64)
    out[order] = h
    return out
