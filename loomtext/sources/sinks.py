"""Sinks: JSON lines, JSON and Parquet, with the choice of fields and compression."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import uri

META = ("source_document", "processing_stats", "embedding_model", "start_page", "end_page")


def fields(df: DataFrame, text: bool = True, embeddings: bool = True, metadata: bool = True, stats: bool = True) -> DataFrame:
    """Only the asked-for groups of columns."""
    gone = ([] if text else ["text"]) + ([] if embeddings else ["embedding"]) + ([] if metadata else list(META)) + ([] if stats else ["processing_stats"])
    return df.drop(*gone)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write(df: DataFrame, path: str, kind: str = "jsonl", compression: str | None = None, mode: str = "overwrite", partition_by: tuple[str, ...] = (), keep_nulls: bool = True) -> None:
    """Parquet, one JSON array (small results only) or, for any other kind, JSON lines."""
    if kind == "json":
        rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_nulls).lower()})).toLocalIterator()]
        with open(path, "w", encoding="utf-8") as f:
            json.dump(rows, f, ensure_ascii=False)
        return
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    if kind == "parquet":
        writer.parquet(uri(path))
    else:
        writer.option("ignoreNullFields", not keep_nulls).json(uri(path))
