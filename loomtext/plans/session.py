"""Durable cuts of long lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession) -> None:
    """Batches of 8 MB for workers where the session has Arrow's usual 64 MB: texts are long, and a worker holds a batch several times."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m"):
        spark.conf.set(key, "8388608b")


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``; where that is unset, in a folder of our own on one machine, an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomtext-"))
    return df.checkpoint(eager=True)
