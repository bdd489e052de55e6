"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder of what driver and executors share; in local mode of a temporary one where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxelframe-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/voxelframe/{uuid.uuid4().hex}/{name}"
