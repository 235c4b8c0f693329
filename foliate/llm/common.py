"""Plans that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, the folder of ``setCheckpointDir`` serves. Without either a session
    in one local process (tests, a laptop) gets a folder of its own; a cluster fails, as rows written to machine-local folders
    would be lost.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="foliate-")
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root.rstrip("/"), f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing that is still to be computed reads it."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: sizes the number of groups, so that a group stays small at any scale."""
    return int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def group_count(df: DataFrame, per_group: int, text: str = "text") -> int:
    return max(8, -(-text_bytes(df, text) // per_group))


def group_of(key: Column | str, groups: int) -> Column:
    """An even, repeatable group number of a key; a null key has one as well."""
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
