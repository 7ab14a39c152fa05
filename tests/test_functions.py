import hashlib
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import detect as D
from loomtext.functions import hashing as H
from loomtext.functions import text as T
from loomtext.operators import chunking as K


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} {'binary' if isinstance(v, bytes) else 'string'}" for n, v in zip(names, values))).select(column).first()[0]


@pytest.mark.parametrize(
    "column, text, expected",
    [
        (lambda: T.plain_characters("c0"), "\u2018a\u2019 \u201cb\u201d \u2013\u2014 \u2026 x\u00a0y", "\u2018a' \"b\" -- ... x y"),
        (lambda: T.plain_characters("c0"), "a: \"'\", b", "a'b"),
        (lambda: T.to_normal_form("c0"), "e\u0301", "\u00e9"),
        (lambda: T.to_normal_form("c0", "none"), "e\u0301", "e\u0301"),
        (lambda: T.strip_control("c0"), "a\x00\x01\tb\nc\rd\x7f\x85\x1f", "a\tb\nc\rd\x7f\x85"),
        (lambda: T.strip_control("c0", True), "a\x7fb", "ab"),
        (lambda: T.standard_punctuation("c0"), "a...b what?? 3.14 e.g. x site.com", "a. b what? 3.14 e. g. x site. com"),
        (lambda: T.collapse_whitespace("c0"), "  a \t\n\u2003 b ", "a b"),
        (lambda: T.drop_short_lines("c0"), "123456789\n1234567890", "1234567890"),
        (lambda: T.drop_stopwords("c0"), "The cat, the", "cat,"),
        (lambda: T.clean("c0"), "short", ""),
        (lambda: T.detect_language("c0"), "x der y", "de"),
        (lambda: T.detect_language("c0"), "nothing", "unknown"),
        (lambda: T.sentences("c0"), "Dr. Smith left. He ran.", ["Dr. Smith left.", "He ran."]),
        (lambda: T.sentences("c0"), "a. B", ["a. B"]),
        (lambda: T.chunk_sentences("c0", 100), "a" * 98 + ". " + "b" * 99 + ".", ["b" * 99 + "."]),
        (lambda: T.chunk_sentences("c0", 100), "Short one. Short two.", ["Short one. Short two."]),
        (lambda: T.paragraphs("c0"), "a\n \nb\n\n\n", ["a", "b"]),
        (lambda: T.shingles("c0"), "A b", []),
        (lambda: T.shingles("c0"), "A b c d b c d", ["a b c", "b c d", "c d b", "d b c"]),
        (lambda: T.character_ngrams("c0"), "aaaa", ["aaa", "aaa"]),
        (lambda: T.slices("c0", 2), "abcde", ["ab", "cd", "e"]),
        (lambda: T.slices("c0", 2), "", []),
        (lambda: D.by_extension("c0"), "x/y.b/z.MARKDOWN", "markdown"),
        (lambda: D.data_format("c0"), "a.ndjson.gz", "jsonl"),
        (lambda: D.url_filename("c0"), "https://a.b/c/d.html?x=/y", "d.html"),
        (lambda: D.url_filename("c0"), "https://a.b", "downloaded_content"),
        (lambda: D.by_content("c0"), "From: a\nTo: b\nSubject: <html>\n\nx", "txt"),
        (lambda: D.by_content("c0"), "<p>x</p>", "html"),
        (lambda: D.by_content("c0"), "<a>x</a>", "xml"),
        (lambda: D.by_content("c0"), '{"a": 1}', "json"),
        (lambda: D.by_content("c0"), "a,b\n1,2\n3,4", "csv"),
        (lambda: D.by_content("c0"), "# x\n**y**", "markdown"),
        (lambda: D.by_content("c0"), "plain words", "txt"),
        (lambda: D.by_content("c0"), "  ", "unknown"),
    ],
)
def test_text(spark, column, text, expected):
    assert one(spark, column(), text) == expected


def test_hashes(spark):
    assert one(spark, H.content_hash("c0"), "hello") == "26c7827d889f6da3"
    assert one(spark, H.content_hash("c0", "other"), "hello") == hashlib.sha256(b"hello").hexdigest()
    assert one(spark, H.sentence_key("c0"), " Hello,  World!! ") == hashlib.md5(b"hello, world").hexdigest()
    assert one(spark, H.chunk_key("c0"), " Ab ") == hashlib.sha256(b"ab").hexdigest()
    assert one(spark, H.fuzzy_similarity("c0", "c1"), "", "") == 0.0
    assert one(spark, H.fuzzy_similarity("c0", "c1"), "abcd", "abce") == 0.75
    assert one(spark, H.simhash(T.shingles("c0")), "a") == 0
    assert one(spark, H.minhash(T.shingles("c0"), 4), "a") == [0, 0, 0, 0]
    assert one(spark, H.minhash(T.shingles("c0"), 8), "a b c d e") == list(spark.createDataFrame([(["a b c", "b c d", "c d e"],)], "s array<string>").select(H.minhash_udf(8)("s")).first()[0])
    assert one(spark, H.fnv1a("c0"), "") == 0xCBF29CE484222325 - (1 << 64)
    with pytest.raises(ValueError):
        H.similarity_hash("x", "other")


def test_chunks(spark):
    text = " ".join(" ".join([w] * 40) + "." for w in "abc")
    got = one(spark, K.chunks("c0", "sentence", 100, 50, 50), text)
    assert [c.text[0] + c.text[-2] for c in got] == ["ab", "bc"]
    assert (got[0].start_char, got[0].end_char, got[1].start_char) == (0, 159 + 2, 161 - 80)
    assert K.pack_paragraphs(["p one", "q " * 120, "r two"], 100, 0, 1, 1)[-1][0] == "p one\n\nr two"
    for n, size, overlap in ((0, 5, 0), (1, 5, 0), (5, 5, 2), (6, 5, 2), (23, 5, 2), (23, 5, 0)):
        words = [f"w{i}" for i in range(n)]
        got = [c.text.split() for c in one(spark, K.word_chunks("c0", size, overlap), " ".join(words))]
        assert [w for k, c in enumerate(got) for w in c[overlap if k else 0 :]] == words
        assert all(len(c) <= size for c in got)
    with pytest.raises(ValueError):
        K.chunks("c0", "sentence", 10, 10)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab .,!?\n\t\u00e9\u2019\u00a0E", max_size=60), min_size=1, max_size=8))
def test_clean_as_plain_python(spark, texts):
    def clean(t):
        t = unicodedata.normalize("NFC", t)
        for a, b in (("–", "-"), ("—", "-"), ("…", "..."), ("\u00a0", " "), ("’", "'"), ("“", '"'), ("”", '"'), (": \"'\", ", "'")):
            t = t.replace(a, b)
        t = "".join(c for c in t if ord(c) >= 32 or c in "\t\n\r")
        t = re.sub(r"!{2,}", "!", re.sub(r"\?{2,}", "?", re.sub(r"\.{2,}", ".", t)))
        t = re.sub(r"\s+", " ", re.sub(r"([.!?])([A-Za-z])", r"\1 \2", t)).strip()
        t = t if len(t) >= 10 else ""
        return " ".join(w for w in t.split() if w.lower() not in T.STOPWORDS)

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[1] for r in df.select("i", T.clean("t")).orderBy("i").collect()] == [clean(t) for t in texts]


def test_null_texts(spark):
    df = spark.createDataFrame([(None,)], "c0 string")
    assert df.select(T.clean("c0"), H.content_hash("c0"), T.standard_punctuation("c0")).first() == (None, None, None)
    assert df.select(F.size(F.coalesce(T.sentences("c0"), F.array()))).first()[0] == 0
