"""Small things that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session (tests on one machine) without that setting gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and drop the lineage: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As a Parquet table in the shared folder, computed once; unlike a checkpoint, readers take only the columns they use."""
    at = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


#: Rows that may be broadcast, under 150 MB as a hash table; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """For broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(doc_id, folds: int):
    """crc32 of the id as decimal text, modulo `folds`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
