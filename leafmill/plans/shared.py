"""Folders that all executors see, for queries that write and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; below a private one
    only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='leafmill-')}"
    return f"{root.rstrip('/')}/leafmill-plans/{uuid.uuid4().hex}"
