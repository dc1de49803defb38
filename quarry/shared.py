"""The folder for what is written on the way: all executors must see it."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_OWN: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. A session without one gets a temporary folder if it runs on this machine alone, as in tests; it is deleted when Python ends. On a cluster the setting must be there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quarry-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"
