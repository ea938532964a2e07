"""What both jobs share: command line, config file, session, log."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("quillstone.jobs")


def config(spark: SparkSession, path: str | None, known: dict) -> dict:
    """``known`` with what the JSON file at ``path`` says otherwise; it may be remote. Unknown names are an error."""
    said = spark.read.option("multiLine", True).json(path).first() if path else None
    said = {k: v for k, v in (said.asDict(recursive=True) if said else {}).items() if v is not None}
    if set(said) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(set(said) - set(known)))}")
    return known | said


def main(run: Callable, known: dict, *paths: str, argv: list[str] | None = None) -> None:
    """Parse ``--<path>`` options and ``--config``, call ``run(spark, *paths, **settings)`` in a session of its own, stop it."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help=f"JSON file; settings: {', '.join(known)}")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, *[getattr(args, p) for p in paths], **config(spark, args.config, known))
    finally:
        spark.stop()
