"""Where tables and checkpoints shared by all executors are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; a cluster gets an error,
    because executors cannot see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="catalens-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
