"""Session helpers of the corpus operators: tables, durable checkpoints, bounded labelled samples."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH, _BATCH_KEY = "8388608b", "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``; only
    where that is unset (tests, one machine) a folder of our own is used. On a cluster
    without a named folder this is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomtext-checkpoint-"))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one where the columns have it already in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, which the cluster sizes with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sample_ids(labelled: DataFrame, key: str, label: str, per_label: int) -> list:
    """At most ``per_label`` keys of each label, those of the smallest hash.

    Only the two narrow columns are read, and the rank limit runs before the shuffle.
    """
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.col(key), F.lit(11)), F.col(key))
    rows = (
        labelled.select(F.col(key), F.col(label))
        .where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= per_label)
        .collect()
    )
    return sorted({r[0] for r in rows})


def sampled(docs: DataFrame, key: str, ids: list, *columns: str) -> list:
    """One row of the columns for each of the keys, so as many at most: of rows that share a key the one of the smallest hash."""
    if not ids:
        return []
    by = Window.partitionBy(key).orderBy(F.xxhash64(*columns), *columns)
    return docs.where(F.col(key).isin(ids)).select(key, *columns).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n").orderBy(key).collect()


def agreed(labels: DataFrame, key: str, label: str) -> DataFrame:
    """key and label, one row for each key whose rows all give it the same label; null labels don't count."""
    own = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("_other"))
    return own.where(F.col(label) == F.col("_other")).select(key, label)


def release() -> None:
    """Give freed memory back to the system: a worker lives on after its task, beside the others of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A function of batches that releases memory at its end.

    Texts are long, so where the session has Arrow's usual 64 MB a batch, it gets ``BATCH``:
    each task holds a batch twice, in the executor and in its worker.
    """
    spark = SparkSession.getActiveSession()
    if spark and spark.conf.get(_BATCH_KEY) in ("67108864b", "67108864", "64m"):
        spark.conf.set(_BATCH_KEY, BATCH)

    def each(batches):
        yield from run(batches)
        release()

    return each


def trimmed_group(run):
    """The same for a function of a group."""

    def each(key, table):
        out = run(key, table)
        release()
        return out

    return each


def large(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column of a batch; one that is all null may come without a string type."""
    return batch.column(name).cast(pa.large_string())


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch of numpy or Arrow columns under a fixed schema."""
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
