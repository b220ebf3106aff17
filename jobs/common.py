"""What the jobs' command lines share: a config file, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def main(run: Callable, description: str, *paths: str) -> None:
    """Call ``run`` with a session, the named paths and the options of a JSON file; the session is stopped."""
    parser = argparse.ArgumentParser(description=description)
    for path in paths:
        parser.add_argument(path)
    parser.add_argument("--config", help="JSON file of options")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    options = {}
    if config := given.pop("config"):
        with open(config) as f:
            options = json.load(f)
    spark = SparkSession.builder.appName(description.split(":")[0]).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **given, **options)
    finally:
        spark.stop()
