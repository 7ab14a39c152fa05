"""Statistics of runs, texts and timings; rolling baselines; batch forms of rate limits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ..functions import text as T


def ratio(a, b):
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def final_stats(chunks: DataFrame, text: str = "text", seconds: float = 0.0, files: int = 0, size: int = 0) -> DataFrame:
    """Chunks, characters and words that survived, and time per file and per megabyte."""
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("total_text_length"), F.coalesce(F.sum(T.word_count(text)), F.lit(0)).alias("total_word_count")).withColumns(
        {"avg_processing_time_per_file": F.lit(seconds / files if files else 0.0), "avg_processing_time_per_mb": F.lit(seconds / (size / 1048576) if size else 0.0)}
    )


def compression_ratio(chunks: DataFrame, doc: str, chunk_words: str, doc_words: str) -> DataFrame:
    """Words of chunks over words of their documents: each counted once a chunk (the usual figure), and once."""
    per = chunks.groupBy(doc).agg(F.sum(chunk_words).alias("c"), F.count(F.lit(1)).alias("n"), F.max(doc_words).alias("d"))
    return per.agg(ratio(F.sum("c"), F.sum(F.col("d") * F.col("n"))).alias("per_chunk"), ratio(F.sum("c"), F.sum("d")).alias("per_document"))


def text_stats(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Bytes, characters and words of each text."""
    return df.select(key, F.octet_length(text).alias("file_size"), F.length(text).alias("text_length"), T.word_count(text).alias("word_count"))


def clean_stats(df: DataFrame, key: str, text: str, cleaned: str, empty: float = 0.0) -> DataFrame:
    """Lengths before and after cleaning and their ratio, ``empty`` for an empty text."""
    before, after = F.length(text), F.length(cleaned)
    return df.select(key, before.alias("original_length"), after.alias("cleaned_length"), F.when(before > 0, after / F.greatest(before, F.lit(1))).otherwise(F.lit(empty)).alias("compression_ratio"))


def merge_results(*results: DataFrame) -> DataFrame:
    """Union by name of batch results; columns that one lacks are null."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def request_stats(results: DataFrame, status: str = "status") -> DataFrame:
    """Files in all, processed and failed."""
    done = F.coalesce(F.sum((F.col(status) == "completed").cast("bigint")), F.lit(0))
    return results.agg(F.count(F.lit(1)).alias("total_files"), done.alias("successful_files"), (F.count(F.lit(1)) - done).alias("failed_files"))


def dedup_counters(decisions: DataFrame, removed: str, exact: str, block: str) -> DataFrame:
    gone = F.coalesce(F.sum(F.col(removed).cast("bigint")), F.lit(0))
    return decisions.agg(F.count(F.lit(1)).alias("processed"), gone.alias("removed"), (F.count(F.lit(1)) - gone).alias("kept"), F.count_distinct(F.when(~F.col(removed), F.col(exact))).alias("hashes"), F.count_distinct(F.when(~F.col(removed), F.col(block))).alias("buckets"))


def cache_info(chunks: DataFrame, text: str, key: str) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("cached_chunks"), F.coalesce(F.sum(F.length(text) + F.length(key)), F.lit(0)).alias("cache_size"))


def timings(df: DataFrame, op: str, value: str) -> DataFrame:
    """Count, total, mean, median, least, most and sample deviation of each operation."""
    v = F.col(value)
    return df.groupBy(op).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"))


def memory_stats(df: DataFrame, op: str, *columns: str) -> DataFrame:
    return df.groupBy(op).agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))))


def tree(spark: SparkSession, entries: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Depth and path of each entry of a parent-child table; an unknown parent makes a root."""
    entries.select(F.col(key).alias("k"), F.col(parent).alias("p"), F.col(name).alias("n")).createOrReplaceTempView("_tree_entries")
    return spark.sql(
        """WITH RECURSIVE t(k, depth, path) AS (
          SELECT k, 0, n FROM _tree_entries e WHERE p IS NULL OR p NOT IN (SELECT k FROM _tree_entries)
          UNION ALL SELECT e.k, t.depth + 1, concat(t.path, '/', e.n) FROM t JOIN _tree_entries e ON e.p = t.k)
        SELECT k, depth, path FROM t"""
    ).toDF(key, "depth", "path")


#: Rows of an operation in one task.
STRETCH = 1 << 16


def regressions(df: DataFrame, op: str, ts: str, value: str, *ties: str, window: int = 1000, least: int = 10, limit: float = 2.0, floor: float | None = 0.001) -> DataFrame:
    """z-score of each value against the last ``window`` ones, itself included; active from ``least`` values on.

    ``floor`` is the least deviation to divide by; without one, a deviation of 0 gives no score.
    """
    # the rows of an operation in turn, cut into stretches that each see the window - 1 rows before them
    stretch = max(STRETCH, 4 * window)
    place = F.row_number().over(Window.partitionBy(op).orderBy(ts, *ties)) - 1
    rows = df.withColumn("_at", place).withColumn("_stretch", F.floor(F.col("_at") / stretch))
    halo = F.col("_at") % stretch >= stretch - window + 1
    rows = rows.withColumn("_stretch", F.explode(F.when(halo, F.array("_stretch", F.col("_stretch") + 1)).otherwise(F.array("_stretch"))))
    schema = StructType([*df.schema.fields, StructField("samples", LongType()), StructField("z", DoubleType()), StructField("regression", BooleanType())])
    columns = df.columns

    def run(key, table):
        table = table.sort_by("_at").combine_chunks()
        v = table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        known = table.column(value).is_valid().to_numpy()
        filled = np.concatenate([np.zeros(window - 1), np.where(known, v, 0.0)])
        on = np.concatenate([np.zeros(window - 1, bool), known])
        n, mean, std = np.zeros(len(v), np.int64), np.full(len(v), np.nan), np.full(len(v), np.nan)
        for i in range(0, len(v), 2048):
            x = sliding_window_view(filled[i : i + 2048 + window - 1], window)
            have = sliding_window_view(on[i : i + 2048 + window - 1], window)
            k = have.sum(1)
            m = x.sum(1) / np.maximum(k, 1)
            s = np.sqrt(((x - m[:, None]) ** 2 * have).sum(1) / np.maximum(k - 1, 1))
            n[i : i + 2048], mean[i : i + 2048], std[i : i + 2048] = k, m, np.where(k > 1, s, np.nan)
        least_std = np.fmax(std, floor) if floor is not None else np.where(std == 0, np.nan, std)
        z = (v - mean) / least_std
        bad = np.isnan(z) | ~known | (n < least)
        own = table.column("_at").to_numpy() // stretch == key[1].as_py()
        out = [*(table.column(c).combine_chunks() for c in columns), pa.array(n), pa.array(np.where(bad, 0.0, z), mask=bad), pa.array(~bad & (z > limit))]
        return pa.table(out, names=[f.name for f in schema]).filter(pa.array(own))

    return rows.groupBy(op, "_stretch").applyInArrow(run, schema)


def running_mean(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("running_mean", F.avg(value).over(w))


def error_rate(df: DataFrame, key: str, failed: str) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(key).agg(n.alias("requests"), F.sum(F.col(failed).cast("bigint")).alias("errors"), (F.sum(F.col(failed).cast("bigint")) / F.greatest(n, F.lit(1))).alias("error_rate"))


def recent(df: DataFrame, n: int, *order: str, key: str | None = None) -> DataFrame:
    """The last ``n`` rows, of each key if one is given."""
    descending = [F.col(c).desc() for c in order]
    if key is None:
        return df.orderBy(*descending).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*descending))).where(F.col("_n") <= n).drop("_n")


def config_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed (section, key) of two flattened settings: those of the new side that are new or differ."""
    o = old.select("section", "key", F.col("value").alias("old_value"))
    return new.select("section", "key", F.col("value").alias("new_value")).join(o, ["section", "key"], "left").where(~F.col("new_value").eqNullSafe(F.col("old_value")))


def expired(df: DataFrame, key: str, ts: str, now, seconds: int = 3600, default: str = "default") -> DataFrame:
    """Keys whose last event is older than ``seconds``, other than the default one."""
    return df.groupBy(key).agg(F.max(ts).alias("last")).where((F.col(key).cast("string") != default) & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last") > seconds))


def tumbling_limit(df: DataFrame, key: str, ts: str, limit: int = 60, window: str = "1 minute", *ties: str) -> DataFrame:
    """Rows admitted: the first ``limit`` of each key and window."""
    w = Window.partitionBy(key, F.window(ts, window)).orderBy(ts, *ties)
    return df.withColumn("admitted", F.row_number().over(w) <= limit)


def sliding_count(df: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Rows of the key in the last ``seconds``, this one included."""
    w = Window.partitionBy(key).orderBy(F.unix_timestamp(ts)).rangeBetween(-(seconds - 1), 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w))


def _admissions(pdf, accept):
    keep, state = [], []
    for t in pdf["_t"]:
        ok, state = accept(t, state)
        keep.append(ok)
    return keep


def _keyed(df: DataFrame, key: str, ts: str, ties: tuple[str, ...], accept, out: str) -> DataFrame:
    from pyspark.sql import types as S

    schema = S.StructType([*df.schema.fields, S.StructField(out, S.BooleanType())])

    def run(pdf):
        pdf = pdf.sort_values([ts, *ties], kind="stable")
        pdf[out] = _admissions(pdf.assign(_t=pdf[ts].astype("datetime64[us]").astype("int64") / 1e6), accept)
        return pdf

    return df.groupBy(key).applyInPandas(run, schema)


def sliding_limit(df: DataFrame, key: str, ts: str, limit: int = 60, seconds: float = 60, *ties: str) -> DataFrame:
    """Rows admitted while fewer than ``limit`` admitted ones lie in the last ``seconds``."""

    def accept(t, state):
        state = [x for x in state if x > t - seconds]
        return (True, [*state, t]) if len(state) < limit else (False, state)

    return _keyed(df, key, ts, ties, accept, "admitted")


def debounce(df: DataFrame, key: str, ts: str, seconds: float, *ties: str) -> DataFrame:
    """Rows accepted: at least ``seconds`` after the last accepted one of the key."""

    def accept(t, state):
        return (True, [t]) if not state or t - state[0] >= seconds else (False, state)

    return _keyed(df, key, ts, ties, accept, "accepted")
