"""The text-preparation plan: clean, remove repeated sentences, chunk, remove repeated chunks, embed, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import chunking, dedup, embed, stats
from ..sources import files, sinks
from .config import Config
from .session import durable


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """The rows with the place, from 0 on, of their unique key in order. Only keys are sorted, by ranges."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    keys = durable(df.select(key).orderBy(key).select(key, F.spark_partition_id().alias("_p"), place.alias("_k")))
    # as many rows as there are ranges
    before = keys.groupBy("_p").count().withColumn("_before", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).drop("count")
    return df.join(keys.join(before, "_p").select(key, (F.col("_before") + F.col("_k")).cast("bigint").alias(name)), key)


class Result:
    """Lazy tables of a run."""

    def __init__(self, chunks: DataFrame, documents: DataFrame, errors: DataFrame | None, config: Config):
        self.chunks, self.documents, self.errors, self.config = chunks, documents, errors, config

    @property
    def stats(self) -> DataFrame:
        final = stats.final_stats(self.chunks)
        return final.crossJoin(self.documents.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size_bytes")))

    def write(self, path: str) -> None:
        o = self.config.output
        sinks.write(sinks.fields(self.chunks, o.include_text, o.include_embeddings, o.include_metadata, o.include_stats), path, o.format, o.compression, keep_nulls=o.include_metadata)


class TextPipeline:
    """Runs over tables or files. Documents are taken in the order of ``doc_id``: of equal sentences and chunks the first stays."""

    def __init__(self, config: Config = Config()):
        self.config = config

    def clean(self, c):
        o = self.config.cleaning
        c = T.strip_tags(c) if o.strip_html_tags else c
        c = T.mask_personal(c) if o.mask_personal_data else c
        return T.clean(c, o.normalize_unicode, punctuation=o.standardize_punctuation, whitespace=o.normalize_whitespace, boilerplate=o.remove_boilerplate, stopwords=o.remove_stopwords, least=o.min_text_length, words=o.stopwords or T.STOPWORDS)

    def process(self, docs: DataFrame, final: bool = False) -> Result:
        """``docs``: doc_id, filename, file_type, text. ``final``: greedy deduplication of chunks too, as for files."""
        c = self.config
        seen = files.read_texts(docs.select("doc_id", "text")).select("doc_id", "file_size", "word_count").join(docs.select("doc_id", "filename", "file_type"), "doc_id")
        texts = docs.select("doc_id", self.clean("text").alias("text"))
        if c.dedup.sentence_dedup and c.dedup.enable_fuzzy_dedup:
            texts = dedup.greedy_sentences(durable(texts), threshold=c.dedup.similarity_threshold, least=c.dedup.min_sentence_length)
        k = c.chunking
        pieces = chunking.chunks("text", k.strategy, k.chunk_size, k.chunk_overlap, k.min_chunk_size, k.min_sentence_length, k.fix_order)
        named = texts.join(docs.select("doc_id", "filename"), "doc_id")
        rows = named.select("doc_id", "filename", pieces.alias("_pieces")).where(F.size("_pieces") > 0)
        rows = chunking.explode_chunks(rows, F.col("_pieces"), "filename").drop("_pieces").withColumn("text_hash", H.content_hash("text", c.dedup.hash_algorithm)).withColumn("seq", dedup.seq_of("doc_id", "chunk_index"))
        if c.dedup.enable_exact_dedup:
            rows = dedup.first_of_each(rows, "text_hash", "seq").drop("copies")
        if final and c.dedup.chunk_dedup and c.dedup.enable_fuzzy_dedup:
            rows = dedup.greedy_chunks(durable(rows), "seq", "text", c.dedup.similarity_threshold)
        rows = rows.join(seen.select("doc_id", F.struct("file_type", "file_size", F.col("word_count").alias("words")).alias("source_document")), "doc_id").withColumn("token_count", F.lit(0))
        load = embed.factory(c.embedding.model_name, c.embedding.size)
        if load:
            rows = embed.with_embeddings(rows, load=load, name=c.embedding.model_name)
        return Result(rows.drop("seq"), seen, None, c)

    def process_text(self, spark: SparkSession, text: str, filename: str = "text_input") -> Result:
        return self.process(spark.createDataFrame([(0, filename, "txt", text)], "doc_id bigint, filename string, file_type string, text string"))

    def process_files(self, spark: SparkSession, paths: list[str] | str) -> Result:
        """Files that can't be read or extracted are in ``errors`` and don't stop the others; one named twice counts once."""
        read = durable(files.read_documents(spark, paths, self.config.processing.max_file_size_mb))
        bad = F.coalesce("error", "extract_error")
        good = read.where(bad.isNull()).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "file_type", "text").dropDuplicates(["path"])
        result = self.process(durable(numbered(good, "path", "doc_id")).select("doc_id", "filename", "file_type", "text"), final=True)
        result.errors = read.where(bad.isNotNull()).select("path", bad.alias("error"))
        return result
