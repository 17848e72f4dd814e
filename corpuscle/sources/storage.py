"""Where the engine keeps tables of its own: under ``spark.checkpoint.dir``, which all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder, and only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "corpuscle")


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/engine/{name}-{uuid.uuid4().hex}"
