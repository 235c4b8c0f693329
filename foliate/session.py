"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # One split of 128 MB of compressed text explodes to a few times that in blocks.
    "spark.sql.files.maxPartitionBytes": "134217728",
}


def build_session(master: str | None = None, app: str = "foliate", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword arguments override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Where the session names none, the folder of ``setCheckpointDir`` serves. Without either, a session in one
    local process (tests, a laptop) gets a folder of its own; a cluster fails, as each executor would write to its own disk.
    The caller removes what it asked for.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="foliate-")
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root.rstrip("/"), f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several others derive from, once, and read it back.

    The table lies in the shared folder, so lost executors cost neither it nor a recomputation.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
