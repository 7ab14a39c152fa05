"""Content-type detection as Column expressions over a path, a text or the first bytes of a file."""

from __future__ import annotations

import io
import mimetypes
import zipfile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col, strip

EXTENSIONS = {
    "md": "markdown", "markdown": "markdown", "xml": "xml", "json": "json", "csv": "csv", "txt": "txt", "eml": "txt", "msg": "txt",
    "htm": "html", "html": "html", "pptx": "pptx", "docx": "docx", "pdf": "pdf",
}
COMPRESSED = "\\.(gz|bz2|br|lz4|zst)$"
HEADERS = tuple(f"{h}:" for h in "content-type date delivered-to from message-id received return-path subject to x-original-to".split())
TAGS = ("<!doctype html", "<a href", "<body", "<div", "<head", "<html", "<p>")
MARKS = ("](", "[", "`", "1. ", "- ", "* ", "__", "**", *("#" * n + " " for n in (1, 2, 3)))
SNIFFED = 8192


def extension(path: Column | str) -> Column:
    """Lower-case suffix of the last path part, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_extract(col(path), "([^/]*)$", 1), "^.+\\.([^.]+)$", 1))


def by_extension(path: Column | str) -> Column:
    ext, out = extension(path), F.lit("unknown")
    for kind in sorted(set(EXTENSIONS.values())):
        out = F.when(ext.isin(*(k for k, v in EXTENSIONS.items() if v == kind)), F.lit(kind)).otherwise(out)
    return out


def supported(path: Column | str) -> Column:
    return extension(path).isin(*EXTENSIONS)


def data_format(path: Column | str) -> Column:
    """json, jsonl, parquet, csv, tsv or unknown, after one compression suffix is taken off."""
    ext = F.regexp_extract(F.regexp_replace(F.lower(col(path)), COMPRESSED, ""), "\\.([^./]+)$", 1)
    return F.when(ext == "ndjson", "jsonl").when(ext.isin("json", "jsonl", "parquet", "csv", "tsv"), ext).otherwise("unknown")


def by_mime(path: Column | str) -> Column:
    """Guess from the registered MIME type of the suffix."""
    kinds = {"application/xml": "xml", "application/json": "json", "application/pdf": "pdf", "text/markdown": "markdown", "text/xml": "xml", "text/csv": "csv", "text/html": "html"}
    known: dict[str, list[str]] = {}
    for suffix, mime in sorted(mimetypes.types_map.items()):
        kind = kinds.get(mime) or ("docx" if mime.endswith("wordprocessingml.document") else "pptx" if mime.endswith("presentationml.presentation") else "txt" if mime.startswith("text/") else None)
        if kind:
            known.setdefault(kind, []).append(suffix[1:])
    ext, out = extension(path), F.lit("unknown")
    for kind, suffixes in known.items():
        out = F.when(ext.isin(*suffixes), F.lit(kind)).otherwise(out)
    return out


def by_magic(content: Column | str) -> Column:
    """pdf, zip (an office file or archive), or null where the first bytes say nothing usable."""
    head = F.hex(F.substring(col(content), 1, 8))
    other = F.lit(False)
    for magic in ("FFD8FF", "89504E470D0A1A0A", "474946383761", "474946383961", "1F8B", "425A", "377ABCAF271C", "526172211A07", "EFBBBF", "FFFE", "FEFF"):
        other = other | head.startswith(magic)
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(other, "unknown")


@F.pandas_udf(StringType())
def office_kind(content: pd.Series) -> pd.Series:
    """docx or pptx by the names in a zip file, else unknown."""

    def one(data: bytes | None) -> str:
        try:
            with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                names = z.namelist()
                for prefix, kind in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "unknown")):
                    if any(n.startswith(prefix) for n in names):
                        return kind
                types = z.read("[Content_Types].xml").decode("utf-8", "ignore") if "[Content_Types].xml" in names else ""
                return "docx" if "wordprocessingml" in types else "pptx" if "presentationml" in types else "unknown"
        except (zipfile.BadZipFile, KeyError, OSError):
            return "unknown"

    return content.map(one)


def is_archive(path: Column | str, content: Column | str | None = None) -> Column:
    """By suffix, or by the first bytes (zip, gzip, bzip2, tar) where there are any."""
    out = F.regexp_extract(F.lower(col(path)), "\\.(zip|tar|gz|bz2|7z|rar|tgz|xz)$", 1) != ""
    if content is not None:
        head = F.hex(F.substring(col(content), 1, 4))
        out = out | head.startswith("504B") | head.startswith("1F8B") | head.startswith("425A") | (F.hex(F.substring(col(content), 258, 5)) == "7573746172")
    return out


def _count(low: Column, marks: tuple[str, ...]) -> Column:
    n = F.lit(0)
    for m in marks:
        n = n + F.contains(low, F.lit(m)).cast("int")
    return n


def is_email(text: Column | str) -> Column:
    """Three header words anywhere, or two of from, to, subject as headers of the first block."""
    block = F.split(col(text), "\\r?\\n\\r?\\n", 2).getItem(0)
    parsed = F.lit(0)
    for h in ("from", "to", "subject"):
        parsed = parsed + block.rlike(f"(?im)^{h}:[ \\t]*\\S").cast("int")
    return (_count(F.lower(col(text)), HEADERS) >= 3) | (block.rlike("^[!-9;-~]+:") & (parsed >= 2))


def is_html(text: Column | str) -> Column:
    return _count(F.lower(col(text)), TAGS) > 0


def is_xml(text: Column | str) -> Column:
    t = strip(text)
    return t.startswith("<?xml") | (t.startswith("<") & t.endswith(">") & t.contains("</"))


def is_json(text: Column | str) -> Column:
    return F.try_parse_json(F.nullif(strip(text), F.lit(""))).isNotNull()


def is_csv(text: Column | str) -> Column:
    """Two lines or more, of the first five at least 80 % with commas, their number within half of the mean."""
    lines = F.split(strip(text), "\n")
    commas = F.transform(F.slice(lines, 1, 5), lambda x: F.length(x) - F.length(F.replace(x, F.lit(","))))
    some = F.filter(commas, lambda c: c > 0)
    mean = F.aggregate(commas, F.lit(0), lambda a, x: a + x) / F.size(commas)
    return (F.size(lines) >= 2) & (F.size(some) >= F.size(commas) * 0.8) & F.forall(some, lambda c: F.abs(c - mean) <= mean * 0.5)


def is_markdown(text: Column | str) -> Column:
    return _count(col(text), MARKS) >= 2


def by_content(text: Column | str) -> Column:
    """The first of e-mail (as txt), html, xml, json, csv, markdown that fits the first characters, else txt; unknown if blank."""
    t = F.substring(col(text), 1, SNIFFED)
    return (
        F.when(strip(t) == "", "unknown").when(is_email(t), "txt").when(is_html(t), "html").when(is_xml(t), "xml").when(is_json(t), "json").when(is_csv(t), "csv").when(is_markdown(t), "markdown").otherwise("txt")
    )


def detect(path: Column | str, content: Column | str) -> Column:
    """Suffix, then first bytes, then content, then MIME type."""
    known, magic = by_extension(path), by_magic(content)
    sniffed = by_content(F.try_validate_utf8(F.substring(col(content), 1, SNIFFED).cast("string")))
    mime = by_mime(path)
    return F.when(known != "unknown", known).when(magic == "zip", office_kind(col(content))).when(magic.isNotNull(), magic).when(sniffed.isNotNull() & (sniffed != "unknown"), sniffed).otherwise(mime)


def url_filename(url: Column | str) -> Column:
    """Last part of a URL's path, or ``downloaded_content``."""
    path = F.regexp_extract(col(url), "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(name == "", "downloaded_content").otherwise(name)
