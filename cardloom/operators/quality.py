"""Data-quality checks and grouped summaries: counts by condition, duplicates, ordered documents, fingerprints, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def duplicates(df: DataFrame, *keys: Column) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def finding(df: DataFrame, check: str, id_col: str | None = None) -> DataFrame:
    """One row of an audit: the check, how many rows it finds and a digest of their ids in order; the ids stay where they are.

    The digest adds up a hash of each id, so it does not gather them.
    """
    ids = F.sum(F.xxhash64(id_col).cast("decimal(38,0)") % F.lit(1_000_003).cast("decimal(38,0)")) if id_col else F.lit(None).cast("decimal(38,0)")
    return df.agg(F.lit(check).alias("check_name"), F.count("*").alias("finding_count"), ids.alias("ids_digest"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def percentile_rank(column: str, p: float) -> Column:
    """Nearest-rank percentile: the least value that p of the rows do not exceed."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def histogram(df: DataFrame, by: str, of: str) -> DataFrame:
    """For each by the counts of each value of of, as 'value=n' in order; the values are few."""
    counts = df.groupBy(by, of).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat(F.col(of), F.lit("="), F.col("n").cast("string"))))
    return counts.groupBy(by).agg(F.array_join(parts, ",").alias("histogram"))


def fingerprint(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, row_hash) of each key's row: what a snapshot compares."""
    return df.select(key, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256).alias("row_hash"))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Additions, removals, modifications and unchanged keys between two sets of (key, row_hash)."""
    joined = old.withColumnRenamed("row_hash", "_old").join(new.withColumnRenamed("row_hash", "_new"), key, "full")
    kind = F.when(F.col("_old").isNull(), F.lit("addition")).when(F.col("_new").isNull(), F.lit("removal")).when(F.col("_old") == F.col("_new"), F.lit("unchanged")).otherwise(F.lit("modification"))
    return joined.select(key, kind.alias("change"))


def canonical_key(df: DataFrame, key: list[Column], order: list[str], id_col: str) -> DataFrame:
    """id and key: the first row of a normalised key has the key, the others legacy:<id>."""
    text = F.concat_ws("|", *key)
    first = df.groupBy(text.alias("_key")).agg(F.min(F.struct(*order)).alias("_first"))
    joined = df.withColumn("_key", text).join(first, "_key")
    mine = F.struct(*order) == F.col("_first")
    return joined.select(id_col, F.when(mine, F.col("_key")).otherwise(F.concat(F.lit("legacy:"), F.col(id_col).cast("string"))).alias("canonical_key"))
