"""Sources: files of many formats, tables of text, JSON lines, URLs; and their text extractors."""

from __future__ import annotations

import bz2
import email
import email.policy
import gzip
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import detect as D
from ..functions import text as T

SCHEMES = {"s3": "s3a", "gs": "gs", "azure": "abfss"}
SUFFIXES = ("txt", "pdf", "docx", "html", "htm", "md", "pptx")


def uri(path: str) -> str:
    """A path with its scheme as Hadoop names it."""
    scheme, mark, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{mark}{rest}" if mark else path


def read_files(spark: SparkSession, paths: list[str] | str, most_mb: int = 100) -> DataFrame:
    """path, length, modificationTime, content and, for files beyond the limit, ``error`` in place of content."""
    paths = [paths] if isinstance(paths, str) else paths
    df = spark.read.format("binaryFile").load([uri(p) for p in paths])
    big = F.col("length") > most_mb << 20
    return df.withColumn("error", F.when(big, F.format_string("file of %d bytes is beyond the limit", "length"))).withColumn("content", F.when(~big, F.col("content")))


def within_size(length: Column | str, most_mb: int = 100) -> Column:
    return T.col(length) <= most_mb << 20


def read_directory(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, most_files: int | None = None, most_mb: int = 100) -> DataFrame:
    """Files of the supported kinds, in the order of their paths up to a number."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(uri(path)).where(D.extension("path").isin(*SUFFIXES)).where(within_size("length", most_mb))
    return df.orderBy("path").limit(most_files) if most_files is not None else df


def read_texts(df: DataFrame, text: str = "text", filename: str = "text_input", file_type: str = "txt") -> DataFrame:
    """A table of texts with the columns of a scanned document."""
    return df.withColumns({"filename": F.lit(filename), "file_type": F.lit(file_type), "file_size": F.octet_length(text).cast("bigint"), "word_count": T.word_count(text)})


def uploads(df: DataFrame, filename: str, length: str, most_files: int = 100, most_mb: int = 100, most_total: int = 1 << 30) -> DataFrame:
    """Which of the files of a request are accepted, and why the others aren't."""
    from pyspark.sql import Window

    w = Window.orderBy(filename).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(
        "rejected",
        F.when(~D.extension(filename).isin(*SUFFIXES), "type").when(F.col(length) > most_mb << 20, "size").when(F.row_number().over(Window.orderBy(filename)) > most_files, "count").when(F.sum(length).over(w) > most_total, "total"),
    )


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(uri(path))


def read_jsonl(spark: SparkSession, path: str, schema, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line is an error, or is left out if not ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(uri(path))


def stream_jsonl(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(uri(path))


def fetch_urls(urls: DataFrame, url: str = "url", most_mb: int = 100, timeout: float = 30) -> DataFrame:
    """url, filename, status, text and error of each URL, fetched by the tasks that hold them."""

    def run(batches):
        from urllib.request import urlopen

        for pdf in batches:
            rows = []
            for u in pdf[url]:
                try:
                    with urlopen(u, timeout=timeout) as r:
                        if int(r.headers.get("Content-Length") or 0) > most_mb << 20:
                            raise ValueError("content is beyond the limit")
                        rows.append((u, r.status, r.read().decode("utf-8", "ignore"), None))
                except Exception as e:  # noqa: BLE001 - any failure is that URL's result
                    rows.append((u, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "status", "text", "error"])

    return urls.select(url).mapInPandas(run, "url string, status int, text string, error string").withColumn("filename", D.url_filename("url"))


# Extractors -------------------------------------------------------------------------------


class _Text(HTMLParser):
    def __init__(self, skip: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.skip, self.depth, self.parts = skip, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skip

    def handle_endtag(self, tag):
        if tag in self.skip and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


FILE_SKIP = frozenset({"script", "style", "nav", "footer"})
PLAIN_SKIP = frozenset({"script", "style"})


def html_text(html: str | None, skip: frozenset[str] = FILE_SKIP) -> str:
    """Text outside the skipped elements, in stripped phrases, one a line."""
    p = _Text(skip)
    p.feed(html or "")
    p.close()
    phrases = (x.strip() for line in "".join(p.parts).splitlines() for x in line.strip().split("  "))
    return "\n".join(x for x in phrases if x)


def html_column(c: Column | str, skip: frozenset[str] = FILE_SKIP) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html_text(x, skip))

    return run(T.col(c))


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def docx_text(data: bytes) -> str:
    """Paragraphs a line each, then tables: cells set off by spaces, rows a line each."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml").find(f"{w}body")
    plain = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = "".join(plain(p) + "\n" for p in body.findall(f"{w}p"))
    return out + "".join("".join(plain(c) + " " for c in r.findall(f"{w}tc")) + "\n" for t in body.findall(f"{w}tbl") for r in t.findall(f"{w}tr"))


def pptx_text(data: bytes) -> str:
    """The text of each shape of each slide, a line each."""
    a, p = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        shapes = [s for n in slides for s in _xml(z, n).iter(f"{p}sp")]
    return "".join("\n".join("".join(t.text or "" for t in par.iter(f"{a}t")) for par in s.iter(f"{a}p")) + "\n" for s in shapes)


def pdf_text(data: bytes) -> str:
    """Text of each page, by whichever optional reader is there."""
    try:
        from pypdf import PdfReader
    except ImportError:
        from PyPDF2 import PdfReader
    return "".join((page.extract_text() or "") + "\n" for page in PdfReader(io.BytesIO(data)).pages)


def email_text(data: bytes) -> str:
    """Subject and plain-text parts."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    parts = [p.get_content() for p in m.walk() if p.get_content_type() == "text/plain"]
    return f"Subject: {m.get('Subject', '')}\n\n" + "".join(parts)


def plain_text(data: bytes) -> str:
    return data.decode("utf-8", "ignore")


EXTRACTORS = {"pdf": pdf_text, "docx": docx_text, "pptx": pptx_text, "email": email_text, "html": lambda b: html_text(plain_text(b))}


def extract(files: DataFrame, kind: str = "file_type", content: str = "content") -> DataFrame:
    """Adds text and extract_error; every other kind is plain text, and a failure is the file's error, not the job's."""
    schema = S.StructType([*(S.StructField(f.name, f.dataType) for f in files.schema), S.StructField("text", S.StringType()), S.StructField("extract_error", S.StringType())])

    def run(batches):
        for pdf in batches:
            out = []
            for k, data in zip(pdf[kind], pdf[content]):
                try:
                    out.append((None if data is None else EXTRACTORS.get(k, plain_text)(bytes(data)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pdf.assign(text=[t for t, _ in out], extract_error=[e for _, e in out])

    return files.mapInPandas(run, schema)


def read_documents(spark: SparkSession, paths: list[str] | str, most_mb: int = 100) -> DataFrame:
    """Files with their detected type and extracted text."""
    return extract(read_files(spark, paths, most_mb).withColumn("file_type", D.detect("path", "content"))).drop("content")


def decompress(path: str, data: bytes) -> bytes:
    """By suffix; unknown ones are left as they are."""
    if path.endswith(".gz"):
        return gzip.decompress(data)
    if path.endswith(".bz2"):
        return bz2.decompress(data)
    if path.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if path.endswith(".lz4"):
        import lz4.frame

        return lz4.frame.decompress(data)
    if path.endswith(".br"):
        import brotli

        return brotli.decompress(data)
    return data


def decompressed(path: Column | str, content: Column | str) -> Column:
    @F.pandas_udf("binary")
    def run(p: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else decompress(x, bytes(d)) for x, d in zip(p, c)])

    return run(T.col(path), T.col(content))
