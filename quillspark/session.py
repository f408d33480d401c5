"""Spark sessions with the settings that the library's results rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "quillspark", cores: str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    """A local session: UTC, adaptive execution, few shuffle partitions.  On a cluster pass your own builder's session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"}
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared(frame: DataFrame) -> str:
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame cut from its lineage, in the folder that the cluster shares; a temporary one only where none is set and the master is local."""
    _shared(frame)
    return frame.checkpoint()


def written(frame: DataFrame) -> DataFrame:
    """As `checkpointed`, but in compressed columns: for wide frames, whose checkpoints are many times as large; how rows are dealt is lost."""
    path = f"{_shared(frame)}/written-{uuid.uuid4().hex}"
    frame.write.parquet(path, compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
