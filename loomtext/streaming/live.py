"""Structured Streaming forms: cleaning, deduplication, rate limits, debounce, watched folders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import hashing as H
from ..functions import text as T
from ..sources import sinks


def clean_stream(stream: DataFrame, text: str = "text", **options) -> DataFrame:
    """Whole records cleaned, so nothing breaks at block boundaries."""
    return stream.withColumn(text, T.clean(text, **options))


def dedup_stream(stream: DataFrame, ts: str, text: str = "text", delay: str = "10 minutes") -> DataFrame:
    """First record of each content within the watermark's delay."""
    return stream.withColumn("text_hash", H.content_hash(text, "sha256")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["text_hash"])


def windowed_counts(stream: DataFrame, key: str, ts: str, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Records of each key and window; late ones are left out beyond the delay."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("n"))


def _stateful(stream: DataFrame, key: str, kind: str, ts: str, accept) -> DataFrame:
    """Rows accepted one by one in event time within each batch; the state is the list of times that matter."""
    schema = stream.schema

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(ts, kind="stable")
        keep = []
        for t in pdf[ts].astype("datetime64[us]").astype("int64") / 1e6:
            ok, times = accept(t, times)
            keep.append(ok)
        state.update((times,))
        yield pdf[keep]

    return stream.groupBy(key).applyInPandasWithState(run, schema, "times array<double>", kind, GroupStateTimeout.NoTimeout)


def debounce_stream(stream: DataFrame, key: str, ts: str, seconds: float) -> DataFrame:
    return _stateful(stream, key, "append", ts, lambda t, s: (True, [t]) if not s or t - s[0] >= seconds else (False, s))


def sliding_limit_stream(stream: DataFrame, key: str, ts: str, limit: int = 60, seconds: float = 60) -> DataFrame:
    def accept(t, s):
        s = [x for x in s if x > t - seconds]
        return (True, [*s, t]) if len(s) < limit else (False, s)

    return _stateful(stream, key, "append", ts, accept)


def tumbling_limit_stream(stream: DataFrame, key: str, ts: str, limit: int = 60, seconds: float = 60) -> DataFrame:
    def accept(t, s):
        s = [x for x in s if x // seconds == t // seconds]
        return (True, [*s, t]) if len(s) < limit else (False, s)

    return _stateful(stream, key, "append", ts, accept)


def watch(spark: SparkSession, folder: str, out: str, process, checkpoint: str, available_now: bool = True, pattern: str = "*.{txt,md,html,htm}"):
    """Files that appear in a folder are processed batch by batch and written as JSON lines; returns the query."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        sinks.write(process(batch), f"{out}/batch={number}", "jsonl")

    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
