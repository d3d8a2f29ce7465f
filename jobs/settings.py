"""Settings of a job from its small JSON file, and what its command line needs."""

from __future__ import annotations

import argparse
import json
import logging
import os
from typing import Any

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def settings(job: str, text: str | None = None) -> dict[str, Any]:
    """The job's own settings, changed by those in ``text`` (JSON); a setting that the job does not know is an error."""
    with open(os.path.join(HERE, f"{job}.json"), encoding="utf-8") as f:
        found = json.load(f)
    given = json.loads(text) if text else {}
    if unknown := given.keys() - found.keys():
        raise ValueError(f"unknown settings of {job}: {', '.join(sorted(unknown))}")
    return found | given


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, wherever Spark can read it."""
    return "\n".join(r["value"] for r in spark.read.text(path).collect())  # a settings file


def arguments(about: str | None, *paths: tuple[str, str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=about)
    for name, what in paths:
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", help="JSON file with settings that differ from the job's own")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return parser.parse_args()
