"""Makes the package importable on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


def on_path() -> None:
    """For sessions that start later: their Python workers get the repository on PYTHONPATH."""
    known = os.environ.get("PYTHONPATH", "")
    if str(ROOT) not in known.split(":"):
        os.environ["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")


def ship(spark: SparkSession) -> None:
    """For a session that runs already: send the package as a zip, once, unless its workers have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_siftwork_shipped", False):
        return
    sc._siftwork_shipped = True
    env = sc._jvm.System.getenv("PYTHONPATH") or ""
    if str(ROOT) not in env.split(":") and sc._jvm.System.getProperty("user.dir") != str(ROOT):
        folder = tempfile.mkdtemp(prefix="siftwork-code-")
        sc.addPyFile(shutil.make_archive(f"{folder}/siftwork", "zip", ROOT, "siftwork"))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = getattr(query, "__name__", "query")
    return run
