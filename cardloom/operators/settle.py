"""Where derived columns are computed once, and rows are dealt to all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def settled(df: DataFrame) -> DataFrame:
    """df with its columns computed here: filters on them are not expanded, with all they are made of, into the scan below."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


#: Tasks for each core that rows are dealt to.
TASKS = 3


def spread(df: DataFrame, key: str) -> DataFrame:
    """df with its rows dealt to all tasks by a key that few rows share. A table of narrow rows is read by few tasks, as a million of
    them may lie in one row group: costly work on each row comes after this."""
    spark = df.sparkSession
    return df.repartition(max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col(f"`{key}`"))
