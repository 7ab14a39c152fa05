"""Content hashes, exact and block keys, signatures and similarities."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from . import grams as G
from . import text as T
from .text import BLOCK_STOPWORDS, col


@F.pandas_udf(StringType())
def xxh64(s: pd.Series) -> pd.Series:
    """Hexadecimal xxHash64 of seed 0 (the built-in one has seed 42)."""
    return s.map(lambda x: xxhash.xxh64_hexdigest(x.encode() if isinstance(x, str) else x), na_action="ignore")


def content_hash(c: Column | str, algorithm: str = "xxhash") -> Column:
    """xxhash, md5 or sha256; any other name means sha256."""
    return xxh64(col(c)) if algorithm == "xxhash" else F.md5(col(c)) if algorithm == "md5" else F.sha2(col(c), 256)


def is_intact(c: Column | str, expected: Column | str, algorithm: str = "xxhash") -> Column:
    return content_hash(c, algorithm) == F.lower(col(expected))


def chunk_key(c: Column | str) -> Column:
    return F.sha2(T.strip(F.lower(col(c))), 256)


def sentence_key(c: Column | str) -> Column:
    return F.md5(F.btrim(F.regexp_replace(T.strip(F.lower(col(c))), "(?U)\\s+", " "), F.lit(".,!?;:")))


def chunk_block(c: Column | str) -> Column:
    """Hundreds of characters and tens of words."""
    return F.concat_ws("_", F.floor(F.length(col(c)) / 100), F.floor(T.word_count(c) / 10))


def sentence_block(c: Column | str) -> Column:
    """Number, first and last of the longer words that are no stopwords."""
    words = F.filter(T.tokens(F.lower(col(c))), lambda w: (F.length(w) > 2) & ~w.isin(*BLOCK_STOPWORDS))
    end = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    return F.concat_ws("_", F.size(words), end(F.lit(0)), end(F.size(words) - 1))


def word_set(c: Column | str) -> Column:
    return F.array_distinct(T.tokens(F.lower(col(c))))


def bare_word_set(c: Column | str) -> Column:
    return F.array_distinct(T.tokens(F.regexp_replace(F.lower(col(c)), "(?U)[^\\w\\s]", "")))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1)))


def set_overlap(a: Column | str, b: Column | str) -> Column:
    """As ``jaccard``, but 0 if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(col(a), col(b))) / F.greatest(union, F.lit(1)))


def trigram_jaccard(a: Column | str, b: Column | str) -> Column:
    return set_overlap(T.character_ngrams(a), T.character_ngrams(b))


def trigram_cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of trigram counts; 0 if either text has none."""
    counts = lambda grams: T.let(grams, lambda g: F.map_from_entries(F.transform(F.array_distinct(g), lambda k: F.struct(k.alias("k"), F.size(F.filter(g, lambda x: x == k)).cast("double").alias("n")))))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, n: s + n * n))

    def of(x, y):
        dot = F.aggregate(F.map_keys(x), F.lit(0.0), lambda s, k: s + F.try_element_at(x, k) * F.coalesce(F.try_element_at(y, k), F.lit(0.0)))
        return F.when(norm(x) * norm(y) > 0, dot / (norm(x) * norm(y))).otherwise(F.lit(0.0))

    return T.let(counts(T.character_ngrams(a)), lambda x: T.let(counts(T.character_ngrams(b)), lambda y: of(x, y)))


def fuzzy_similarity(a: Column | str, b: Column | str) -> Column:
    """1 less edit distance over the longer length, not below 0; 0 for two empty texts."""
    longer = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.when(longer > 0, F.greatest(F.lit(0.0), 1 - F.levenshtein(col(a), col(b)) / F.greatest(longer, F.lit(1)))).otherwise(F.lit(0.0))


def _number(s: Column) -> Column:
    """First 32 bits of a string's md5 as a number."""
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def coefficients(n: int = 128, seed: int = 1) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, 1 << 31), rng.randrange(1 << 31)) for _ in range(n)]


def minhash(sets: Column | str, n: int = 128, seed: int = 1) -> Column:
    """``n`` seeded minima over the elements of an array of strings; zeros for an empty one."""
    slot = lambda code, a, b: F.array_min(F.transform(code, lambda h: F.pmod(h * F.lit(a) + F.lit(b), F.lit(1 << 32))))
    least = T.let(F.transform(col(sets), _number), lambda code: F.array(*(slot(code, a, b) for a, b in coefficients(n, seed))))
    return F.when(F.size(col(sets)) > 0, least).otherwise(F.array_repeat(F.lit(0).cast("bigint"), n))


def minhash_udf(n: int = 128, seed: int = 1):
    """The same signature by numpy, for many elements."""
    a, b = (np.array(x, np.int64) for x in zip(*coefficients(n, seed)))

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        import hashlib

        def one(items):
            if items is None or not len(items):
                return np.zeros(n, np.int64)
            h = np.array([int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in items], np.int64)
            return ((h[:, None] * a + b) % (1 << 32)).min(0)

        return s.map(one)

    return run.asNondeterministic()  # else the optimiser may move it into a lambda, where it can't run


def signature_similarity(a: Column | str, b: Column | str) -> Column:
    """Share of equal places; signatures of different lengths are an error."""
    n = F.size(col(a))
    same = F.size(F.filter(F.zip_with(col(a), col(b), lambda x, y: x == y), lambda x: x))
    return F.when(n != F.size(col(b)), F.raise_error("signatures differ in length").cast("double")).when(n == 0, F.lit(0.0)).otherwise(same / F.greatest(n, F.lit(1)))


def simhash(sets: Column | str) -> Column:
    """64 majority votes over the md5 bits of the elements, ties 0, as a signed number."""
    half = lambda i: F.transform(col(sets), lambda s: F.conv(F.substring(F.md5(s), i, 8), 16, 10).cast("bigint"))

    def votes(h, shift):
        """One pass over the hashes: the 32 counts, packed into a number where they are positive."""
        zero = F.array_repeat(F.lit(0), 32)
        bits = F.sequence(F.lit(0), F.lit(31))
        tally = F.aggregate(h, zero, lambda a, x: F.zip_with(a, bits, lambda n, bit: n + F.when(F.getbit(x, bit) == 1, 1).otherwise(-1)))
        return F.aggregate(F.zip_with(tally, bits, lambda n, bit: F.when(n > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit + shift)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))

    return votes(half(1), 32).bitwiseOR(votes(half(9), 0))


@F.pandas_udf(LongType())
def _shingle_simhash(lowered: pd.Series) -> pd.Series:
    return lowered.map(lambda x: G.simhash(G.shingle_digests(x))).astype("int64")


def shingle_simhash(c: Column | str) -> Column:
    """``simhash(shingles(c))`` by numpy, without the shingles as rows' arrays; 0 for null."""
    return _shingle_simhash(F.lower(col(c)))


def shingle_minhash(c: Column | str, n: int = 128, seed: int = 1) -> Column:
    """``minhash(shingles(c), n, seed)`` likewise."""
    a, b = (np.array(x, np.int64) for x in zip(*coefficients(n, seed)))

    @F.pandas_udf("array<bigint>")
    def run(lowered: pd.Series) -> pd.Series:
        return lowered.map(lambda x: G.minhash(G.shingle_digests(x), a, b))

    return run(F.lower(col(c)))


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def similarity_hash(sets: Column | str, method: str = "minhash") -> Column:
    if method not in ("minhash", "simhash"):
        raise ValueError(f"unknown method: {method}")
    return minhash(sets) if method == "minhash" else simhash(sets)


def _fnv(s: pd.Series) -> np.ndarray:
    """Of a series without nulls, some texts at a time."""
    out, texts, load = [np.zeros(0, np.uint64)], [], 0
    for x in s:
        texts.append(x.encode())
        load += len(texts[-1])
        if load > 8 * G.SLICE:
            out.append(G.fnv1a(texts))
            texts, load = [], 0
    return np.concatenate([*out, G.fnv1a(texts)])


def _filled(s: pd.Series, hashes: np.ndarray) -> pd.Series:
    out = pd.Series(pd.NA, s.index, "Int64")
    out[s.notna()] = hashes.view(np.int64)
    return out


@F.pandas_udf(LongType())
def fnv1a(s: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed number."""
    return _filled(s, _fnv(s.dropna()))


@F.pandas_udf(LongType())
def fnv1a_mixed(s: pd.Series) -> pd.Series:
    """FNV-1a, then folded, multiplied by the golden-ratio constant and folded again."""
    h = _fnv(s.dropna())
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return _filled(s, h ^ h >> np.uint64(32))


def normalized_for_hash(c: Column | str) -> Column:
    """Lower case, without ASCII punctuation, single spaces."""
    return T.collapse_ascii_whitespace(F.regexp_replace(F.lower(col(c)), "[!-/:-@\\[-`{-~]", ""))


def sentence_hash(c: Column | str) -> Column:
    return fnv1a_mixed(normalized_for_hash(c))
