"""Chunking: packing of sentences, paragraphs or related groups, and fixed-size slides over words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..functions.text import ABBREVIATIONS, RELATION_STOPWORDS, col, split_for_chunks

PIECE = "array<struct<text:string,start_char:bigint,end_char:bigint>>"
_WORD = re.compile(r"\b\w+\b")


def count_words(s: str) -> int:
    return len(s.split())


def split_sentences(text: str, least: int, shortest: int) -> list[str]:
    """The plain-Python form of ``functions.text.chunk_sentences``, for parts made during packing."""
    out, acc = [], ""
    for piece in re.findall(r"[^.!?]*[.!?]+|[^.!?]+$", text):
        acc += piece
        if piece[-1] in ".!?":
            last = acc.split()
            if not (last and last[-1].lower() in ABBREVIATIONS):
                out.append(acc)
                acc = ""
    out = [s.strip() for s in [*out, acc] if len(s.strip()) >= max(least, 1)]
    return out or ([text] if len(text) >= shortest else [])


class Packer:
    """Greedy packing under a token limit; ``carry`` says which of a full chunk's parts begin the next one."""

    def __init__(self, size: int, glue: str, carry):
        self.size, self.glue, self.carry = size, glue, carry
        self.parts: list[str] = []
        self.tokens = self.start = 0
        self.chunks: list[tuple[str, int, int]] = []

    def flush(self, carry: bool = True) -> None:
        text = self.glue.join(self.parts)
        end = self.start + len(text)
        self.chunks.append((text, self.start, end))
        self.parts = self.carry(self.parts) if carry and len(self.parts) > 1 else []
        self.tokens = sum(map(count_words, self.parts))
        self.start = end - len(self.glue.join(self.parts))

    def add(self, parts: list[str], tokens: int) -> None:
        if self.parts and self.tokens + tokens > self.size:
            self.flush()
        self.parts = [*self.parts, *parts]
        self.tokens += tokens

    def done(self) -> list[tuple[str, int, int]]:
        if self.parts:
            self.flush(False)
        return self.chunks


def _tail(overlap: int):
    """The longest run of last parts within the overlap."""

    def carry(parts: list[str]) -> list[str]:
        n, left = len(parts), overlap
        while n and count_words(parts[n - 1]) <= left:
            n -= 1
            left -= count_words(parts[n])
        return parts[n:] if overlap > 0 else []

    return carry


def pack_sentences(sentences: list[str], size: int, overlap: int) -> list[tuple[str, int, int]]:
    p = Packer(size, " ", _tail(overlap))
    for s in sentences:
        p.add([s], count_words(s))
    return p.done()


def pack_paragraphs(paragraphs: list[str], size: int, overlap: int, least: int = 100, shortest: int = 5, fix_order: bool = False) -> list[tuple[str, int, int]]:
    """As sentences; an oversize paragraph is packed by sentences on the spot, ahead of what is pending unless ``fix_order``."""
    p = Packer(size, "\n\n", lambda parts: parts[-1:] if 0 < count_words(parts[-1]) <= overlap else [])
    for s in paragraphs:
        n = count_words(s)
        if n > size:
            if fix_order and p.parts:
                p.flush(False)
            p.chunks += pack_sentences(split_sentences(s, least, shortest), size, overlap)
        else:
            p.add([s], n)
    return p.done()


def related(a: str, b: str, threshold: float = 0.2) -> bool:
    x, y = ({w.lower() for w in _WORD.findall(s)} - set(RELATION_STOPWORDS) for s in (a, b))
    return bool(x | y) and len(x & y) / len(x | y) > threshold


def pack_related(sentences: list[str], size: int, overlap: int, least: int = 100, shortest: int = 5) -> list[tuple[str, int, int]]:
    """Groups of neighbours that share words are packed whole, without overlap; an oversize group by its sentences."""
    groups: list[list[str]] = []
    for s in sentences:
        if groups and related(groups[-1][-1], s):
            groups[-1].append(s)
        else:
            groups.append([s])
    p = Packer(size, " ", lambda parts: [])
    for g in groups:
        text = " ".join(g)
        if count_words(text) > size:
            p.chunks += pack_sentences(split_sentences(text, least, shortest), size, overlap)
        else:
            p.add(g, count_words(text))
    return p.done()


def chunks(c: Column | str, strategy: str = "sentence", size: int = 512, overlap: int = 50, least: int = 100, shortest: int = 5, fix_order: bool = False) -> Column:
    """Array of (text, start_char, end_char). Packing, and splitting into sentences, is done by one Arrow UDF."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the chunk size")
    if strategy in ("token", "word"):
        return word_chunks(c, size, overlap)
    if strategy not in ("sentence", "paragraph", "semantic", "fixed"):
        raise ValueError(f"unknown strategy: {strategy}")

    @F.pandas_udf(PIECE)
    def run(parts: pd.Series) -> pd.Series:
        def one(x):
            x = [] if x is None else list(x) if strategy == "paragraph" else split_for_chunks(x, least, shortest)
            if strategy == "paragraph":
                found = pack_paragraphs(x, size, overlap, least, shortest, fix_order)
            else:
                found = pack_related(x, size, overlap, least, shortest) if strategy == "semantic" else pack_sentences(x, size, overlap)
            return [dict(zip(("text", "start_char", "end_char"), f)) for f in found]

        return parts.map(one)

    return run(T.paragraphs(c) if strategy == "paragraph" else col(c))


def word_chunks(c: Column | str, size: int = 512, overlap: int = 0) -> Column:
    """Slide of ``size`` words by ``size - overlap``; the last one reaches the end and nothing starts after it."""
    step = size - overlap

    def of(words):
        n = F.size(words)
        last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")

        joined = lambda i, n: F.array_join(F.slice(words, i * step + 1, n), " ")
        # characters before each step's words, a space after each word
        before = F.aggregate(F.sequence(F.lit(0), last), F.array(F.lit(0).cast("bigint")), lambda a, i: F.concat(a, F.array(F.element_at(a, -1) + F.length(joined(i, step)) + 1)))

        def pieces(at):
            def piece(i):
                start = F.greatest(F.get(at, i) - 1, F.lit(0).cast("bigint"))
                return F.struct(joined(i, size).alias("text"), start.alias("start_char"), (start + F.length(joined(i, size))).alias("end_char"))

            return F.transform(F.sequence(F.lit(0), last), piece)

        return F.when(n > 0, T.let(before, pieces)).otherwise(F.array().cast(PIECE))

    return T.let(T.tokens(c), of)


def token_spans(n: Column | str, size: int, overlap: int = 0) -> Column:
    """(first, end) of the slide over ``n`` tokens of any tokenizer."""
    n, step = col(n), size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).alias("first"), F.least(i * step + size, n).alias("end")))).otherwise(F.array().cast("array<struct<first:int,end:int>>"))


def explode_chunks(df: DataFrame, pieces: Column, filename: Column | str) -> DataFrame:
    """One row for each chunk with its id, index, offsets and counts."""
    return (
        df.select("*", F.posexplode(pieces).alias("chunk_index", "_piece"))
        .select("*", "_piece.*")
        .drop("_piece")
        .withColumn("chunk_id", F.concat_ws("_", col(filename), F.col("chunk_index")))
        .withColumn("char_count", F.length("text"))
        .withColumn("word_count", T.word_count("text"))
    )


def _related_words(sentence: Column) -> Column:
    low = F.lower(sentence)
    # among ASCII the plain classes find the same words sooner
    found = F.when(F.octet_length(low) == F.length(low), F.regexp_extract_all(low, F.lit("\\w+"), F.lit(0))).otherwise(F.regexp_extract_all(low, F.lit("(?U)\\b\\w+\\b"), F.lit(0)))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, RELATION_STOPWORDS)))


def islands(sentences: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Number of the related group of each (doc_id, idx, sentence), by comparing neighbours."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    df = sentences.withColumn("_words", _related_words(F.col("sentence")))
    return df.withColumn("_before", F.lag("_words").over(w)).withColumn("_new", F.when(H.set_overlap("_words", "_before") > threshold, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w)).drop("_words", "_before", "_new")


def document_islands(sentences: Column, threshold: float = 0.2) -> Column:
    """The groups (island, first, last) of an array of one document's sentences in turn, where nothing is sorted or shuffled."""

    def related(a: Column, b: Column) -> Column:
        common = F.size(F.array_intersect(a, b))
        return common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1)) > threshold

    fresh = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | ~related(F.get(w, i), F.get(w, i - 1)))
    spans = lambda w, at: F.transform(at, lambda first, k: F.struct((k + 1).cast("bigint").alias("island"), first.alias("first"), (F.coalesce(F.get(at, k + 1), F.size(w)) - 1).alias("last")))
    return T.let(F.transform(sentences, _related_words), lambda w: F.when(F.size(w) > 0, T.let(fresh(w), lambda at: spans(w, at))))
