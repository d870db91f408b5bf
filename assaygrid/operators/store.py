"""Keyed tables for rows that are asked for by a label: quads by property, restrictions by role."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from assaygrid.operators.staging import shared_folder, written

#: A key with more rows than this under one label would make one bucket, thus one task, too large.
HOT = 1_000_000


@dataclass(frozen=True)
class Labelled:
    """Rows in two tables, both partitioned by label.

    `even` is bucketed by key as well, so that joins on the key need no exchange. Labels under which some key has more than `HOT`
    rows stand in `uneven`, without buckets: their joins shuffle, and adaptive execution can split the hot key.
    """

    even: DataFrame
    uneven: DataFrame
    hot: frozenset
    label: str

    def of(self, value: str) -> DataFrame:
        """The rows of one label: a scan of one folder."""
        return (self.uneven if value in self.hot else self.even).where(F.col(self.label) == value)

    def all(self) -> DataFrame:
        return self.even.unionByName(self.uneven) if self.hot else self.even


def labelled(rows: DataFrame, label: str, key: str, buckets: int | None = None, most: int = HOT) -> Labelled:
    """Rows stored by label and key. Labels must be few, as they become folders (the properties of an ontology are).

    Rows with a null label or an empty one are asked for by nobody and are left out. A null key is a key like others. The tables lie in
    the shared folder; their catalogue entries are new names in the current database and last as long as the session's catalogue.
    """
    spark, rows = rows.sparkSession, written(rows.where(F.col(label) != ""))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = frozenset(r[0] for r in rows.groupBy(label, key).count().where(F.col("count") > most).select(label).distinct().collect())  # labels are few
    name = f"labelled_{uuid.uuid4().hex}"
    at = f"{shared_folder(spark)}/{name}"
    even = rows.where(~F.col(label).isin(*hot)) if hot else rows
    even.repartition(n, key).write.partitionBy(label).bucketBy(n, key).option("path", at).format("parquet").saveAsTable(name)
    uneven = rows.where(F.col(label).isin(*hot)) if hot else rows.limit(0)
    return Labelled(spark.table(name).select(*rows.columns), uneven, hot, label)


def unsorted(rows: DataFrame, label: str) -> Labelled:
    """Rows in one table as they come, without a shuffle or a second copy: a label is read by the row groups that hold it, and joins on the key shuffle.

    Names of nodes are hashes in hexadecimal, which zstd halves.
    """
    rows = written(rows.where(F.col(label) != ""), "zstd")
    return Labelled(rows, rows.limit(0), frozenset(), label)
