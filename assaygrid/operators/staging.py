"""Stage results between steps that would otherwise be planned again and again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir. Only a local session may do without that setting."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Written to the shared folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """As `staged`, but a Parquet table: later steps read only the columns they need, and joins know its size. `compression`: another than the session's."""
    at = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(at)


BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """For broadcast if its counted rows are few; else the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df
