"""What is registered: queries by name, and the SQL that must give the same rows. Doubles are rounded to 6 digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

QUERIES: dict = {}
ORACLE: dict = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            ORACLE[name] = sql
        return f

    return put
