"""Cleaning, sentence and paragraph splitting, shingles: Column in, Column out.

Functions are built from JVM expressions, so a chain of them stays in one projection;
the exceptions are Unicode normalisation, which no built-in offers, and the splitter of
chunks, which folds pieces in turn.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import grams as G

#: Tokens that the stopword step drops, compared in lower case as whole tokens.
STOPWORDS = tuple("a all an and any are as at be been being both by can could did do does doing each few for from had has have he how in is it its just may might more most must no nor not now of on only other own same shall should so some such than that the their them there these they this those to too very was what when where which who why will with would".split())
#: Those left out of a sentence's block key, and those that don't relate sentences.
BLOCK_STOPWORDS = tuple("a an and are as at be been being by can could did do does for from had has have he in is it its may might of on should that the to was will with would".split())
RELATION_STOPWORDS = tuple("a an and at but by for in of on or the to with".split())
_SPECIAL = ("–— ’“”", "-- '\"\"")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def normalization(form: str):
    """Pandas UDF of any normal form."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return run


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda, a free expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_normal_form(c: Column | str, form: str | None = "NFC") -> Column:
    """A Unicode normal form; ``None`` or "none" leaves the text as it is."""
    text = col(c)
    if form is None or form.lower() == "none":
        return text
    run = _nfc if form == "NFC" else normalization(form)
    # ASCII is the same in all forms and needn't travel to Python
    return F.coalesce(run(F.when(F.octet_length(text) != F.length(text), text)), text)


def plain_characters(c: Column | str) -> Column:
    """Dashes, ellipses, hard spaces and typographic quotes as plain ASCII; U+2018 is left alone."""
    return F.replace(F.translate(F.replace(col(c), F.lit("…"), F.lit("...")), *_SPECIAL), F.lit(": \"'\", "), F.lit("'"))


def strip_control(c: Column | str, delete: bool = False) -> Column:
    """Without control characters below 32 other than tab, newline and return; ``delete``: nor 127."""
    return F.regexp_replace(col(c), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f" + ("\\x7f" if delete else "") + "]", "")


def standard_punctuation(c: Column | str) -> Column:
    """Runs of a sentence mark become one, and a letter after one is set off by a space."""
    for mark, one in (("\\.{2,}", "."), ("\\?{2,}", "?"), ("!{2,}", "!"), ("([.!?])([A-Za-z])", "$1 $2")):
        c = F.regexp_replace(col(c), mark, one)
    return c


def collapse_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), "(?U)\\s+", " "))


def collapse_ascii_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), "[ \\t\\n\\x0b\\f\\r]+", " "))


def strip(c: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(col(c), F.lit(G.SPACE))


def drop_short_lines(c: Column | str, least: int = 10) -> Column:
    """Trimmed lines of at least ``least`` characters."""
    return F.array_join(F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: F.length(x) >= least), "\n")


def drop_stopwords(c: Column | str, words: tuple[str, ...] = STOPWORDS) -> Column:
    """Without whole tokens whose lower case is a stopword; tokens are rejoined by single spaces."""
    tokens = F.split(F.regexp_replace(col(c), "(?U)\\s+", " "), " ")
    return F.array_join(F.filter(tokens, lambda w: (w != "") & ~F.lower(w).isin(*words)), " ")


def clean(
    c: Column | str, form: str | None = "NFC", control: bool = True, punctuation: bool = True, whitespace: bool = True, boilerplate: bool = True, stopwords: bool = True, least: int = 10, words: tuple[str, ...] = STOPWORDS
) -> Column:
    """All cleaning steps in their order; white space first, so that by default the line filter sees one line."""
    out = plain_characters(to_normal_form(c, form))
    if control:
        out = strip_control(out)
    if punctuation:
        out = standard_punctuation(out)
    if whitespace:
        out = collapse_whitespace(out)
    if boilerplate:
        out = drop_short_lines(out, least)
    return drop_stopwords(out, words) if stopwords else out


def clean_native(c: Column | str, replacements: list[tuple[str, str]] = (), least: int = 3) -> Column:
    """The second cleaning profile: own replacements first, ASCII white space, lines counted in bytes, no stopwords."""
    for pattern, new in replacements:
        c = F.regexp_replace(col(c), pattern, new)
    out = collapse_ascii_whitespace(standard_punctuation(strip_control(plain_characters(c), delete=True)))
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: F.octet_length(x) >= least), "\n")


def drop_short_stopwords(c: Column | str, words: tuple[str, ...] = STOPWORDS, preserve: bool = True) -> Column:
    """Second profile of stopword removal: matched without ASCII punctuation; ``preserve`` keeps longer tokens."""
    bare = lambda w: F.lower(F.regexp_replace(w, "[!-/:-@\\[-`{-~]", ""))
    keep = lambda w: (~bare(w).isin(*words)) | ((F.length(bare(w)) > 2) & w.rlike("[A-Za-z0-9]") if preserve else F.lit(False))
    return F.array_join(F.filter(F.split(F.regexp_replace(col(c), "[ \\t\\n\\x0b\\f\\r]+", " "), " "), lambda w: (w != "") & keep(w)), " ")


def is_blank(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), "[ \\t\\n\\x0b\\f\\r]+", "")) == ""


MARKERS = {"en": (" the ", " and ", " of "), "es": (" el ", " la ", " de "), "fr": (" le ", " la ", " du "), "de": (" der ", " die ", " das ")}
LANGUAGE_STOPWORDS = {
    "en": tuple("a an and are as at be been but by call come could day did do down each find first for from get go had has have he her him how if in into is it its like long made make many may more my no now of oil on out part said she so some than that the their them then these they this time to two up was water way what which who will with would".split()),
    "es": tuple("a ah al algo con da de del el en es esta ha la le lo los me mi mismo mucho muy no o para por puede que se ser si son su te tener todo tu un una y ya".split()),
    "fr": tuple("aller autre avec avoir bien ce dans de dire en et faire falloir grand il le ne par pas plus pour pouvoir que savoir se son sur tout un une voir à être".split()),
    "de": tuple("aber als an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen er es für haben hat im in ist man mehr mit nach nicht noch nur oder sei sein sich sie so und von vor war werden wie wird wurde zu zum zur über".split()),
}


def detect_language(c: Column | str) -> Column:
    """The language of the most marker words (one is enough); in doubt en, es, fr, de in this order."""
    low = F.lower(col(c))
    out = F.lit("unknown")
    for lang in reversed(MARKERS):
        hit = F.lit(False)
        for m in MARKERS[lang]:
            hit = hit | F.contains(low, F.lit(m))
        out = F.when(hit, F.lit(lang)).otherwise(out)
    return out


def language_stopwords(lang: Column | str) -> Column:
    """The stopword list of a language column; empty for others."""
    out = F.array().cast("array<string>")
    for k, v in LANGUAGE_STOPWORDS.items():
        out = F.when(col(lang) == k, F.array(*map(F.lit, v))).otherwise(out)
    return out


def mask_personal(c: Column | str) -> Column:
    """E-mail addresses, card, social security, telephone and IPv4 numbers as tags."""
    for pattern, tag in (
        ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[EMAIL]"),
        ("\\b\\d{3}-\\d{2}-\\d{4}\\b", "[SSN]"),
        ("\\b(?:\\d{4}[- ]?){3}\\d{4}\\b", "[CARD]"),
        ("\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b", "[IP]"),
        ("\\+?\\d{0,2}[ .-]?\\(?\\d{3}\\)?[ .-]?\\d{3}[ .-]?\\d{4}\\b", "[PHONE]"),
    ):
        c = F.regexp_replace(col(c), pattern, tag.replace("[", "\\[").replace("]", "\\]"))
    return c


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "<[^>]*>", "")


def tokens(c: Column | str) -> Column:
    """Non-empty white-space tokens."""
    return F.filter(F.split(col(c), "(?U)\\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(tokens(c))


# Sentences and paragraphs ---------------------------------------------------------------

_BREAK = "(?U)(?<!\\w\\.\\w.)(?<![A-Z][a-z]\\.)(?<=\\.|\\?|!)(?=\\s+[A-Z])"
ABBREVIATIONS = tuple("b.a. b.s. co. corp. dr. e.g. etc. i.e. inc. jr. ltd. m.a. m.d. m.s. mr. mrs. ms. no. ph.d. prof. sr. u.k. u.s. vol. vs.".split())



_PIECES = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")


def sentences(c: Column | str, least: int = 5) -> Column:
    """Sentences for deduplication: split before a capital after a full stop; the whole text if none is long enough."""
    text = col(c)
    parts = F.filter(F.transform(F.split(text, _BREAK, -1), strip), lambda s: F.length(s) >= least)
    return let(parts, lambda p: F.when(F.size(p) > 0, p).when(F.length(text) > 0, F.array(text)).otherwise(p))


def _folded(c: Column, abbreviation, keep) -> Column:
    """Pieces that end in sentence marks, joined on where the text so far ends in an abbreviation."""
    pieces = F.regexp_extract_all(c, F.lit("([^.!?]*[.!?]+|[^.!?]+$)"), F.lit(1))
    start = F.struct(F.lit("").alias("acc"), F.array().cast("array<string>").alias("out"))

    def step(a, piece):
        text = F.concat(a["acc"], piece)
        more = abbreviation(text)
        return F.struct(F.when(more, text).otherwise(F.lit("")).alias("acc"), F.when(more, a["out"]).otherwise(F.concat(a["out"], F.array(text))).alias("out"))

    done = F.aggregate(pieces, start, step, lambda a: F.when(a["acc"] != "", F.concat(a["out"], F.array(a["acc"]))).otherwise(a["out"]))
    return F.filter(F.transform(done, strip), keep)


def split_for_chunks(text: str, least: int = 100, shortest: int = 5) -> list[str]:
    """``chunk_sentences`` of one text."""
    out, acc = [], ""
    for piece in _PIECES.findall(text):
        acc += piece
        end = acc.rstrip(G.SPACE)
        # no abbreviation has more than 8 characters
        if not (end.endswith(".") and G.words(end[-9:])[-1].lower() in ABBREVIATIONS):
            out.append(acc)
            acc = ""
    out = [s for x in (*out, acc) if (s := x.strip(G.SPACE)) and len(s) >= least] if least > 0 else [x.strip(G.SPACE) for x in ([*out, acc] if acc else out)]
    if out:
        return out
    whole = text.strip(G.SPACE)
    return [whole] if len(whole) >= shortest else []


def chunk_sentences(c: Column | str, least: int = 100, shortest: int = 5) -> Column:
    """Sentences for chunking: shorter ones than ``least`` are dropped; if none is left, the whole text."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: split_for_chunks(x, least, shortest), na_action="ignore")

    return run(col(c))


def plain_sentences(c: Column | str, least: int = 11) -> Column:
    """Sentences by marks with a short list of case-sensitive abbreviations; longer than ten characters."""
    guard = lambda t: F.rtrim(t).rlike("(?:Prof|Mrs|etc|Dr|Mr|Ms|vs|e\\.g|i\\.e)\\.$")
    return _folded(col(c), guard, lambda s: F.length(s) >= least)


def bare_sentences(c: Column | str, least: int = 10) -> Column:
    """Sentences without their end marks."""
    return F.filter(F.split(col(c), "[.!?]+[ \\t\\n\\x0b\\f\\r]+"), lambda s: F.length(s) >= least)


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), "\\n\\s*\\n"), strip), lambda p: p != "")


def shingles(c: Column | str, k: int = 3) -> Column:
    """Distinct lower-case word k-grams."""

    def of(words):
        n = F.size(words) - k
        grams = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, k), " "))
        return F.when(n >= 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))

    return let(tokens(F.lower(col(c))), of)


def character_ngrams(c: Column | str, n: int = 3) -> Column:
    """All character n-grams in turn."""
    text = col(c)
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def slices(c: Column | str, size: int = 65536) -> Column:
    """The text cut into pieces of ``size`` characters."""
    text = col(c)
    last = F.floor((F.length(text) - 1) / size).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
