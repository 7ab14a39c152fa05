"""Command line: process files or folders, clean a text, show settings."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .functions import text as T
from .plans import config as C
from .plans.pipeline import TextPipeline


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomtext", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--profile", choices=sorted(C.PROFILES))
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("process")
    run.add_argument("paths", nargs="+")
    run.add_argument("--output", required=True)
    sub.add_parser("clean").add_argument("text")
    sub.add_parser("config-show")
    a = p.parse_args(argv)
    config = C.from_environment(C.load(a.config) if a.config else C.Config())
    config = C.profile(a.profile, config) if a.profile else config
    if a.command == "config-show":
        print(json.dumps({".".join(k): v for k, v in config.flat().items()}, indent=2))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.command == "clean":
        print(spark.createDataFrame([(a.text,)], "text string").select(T.clean("text")).first()[0])
    else:
        TextPipeline(config).process_files(spark, a.paths).write(a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
