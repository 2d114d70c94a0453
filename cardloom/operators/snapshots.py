"""What changed between two snapshots of tables, by a tree of digests.

Rows get hashes that do not depend on their order; the hashes of a bucket of keys add up to its digest, and digests of buckets to
that of the table. Where a table's digests agree nothing else is done; else only the rows of buckets whose digests differ are
shuffled and compared by key. A table of any size costs two scans and one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of a table, at most; the buckets that differ are broadcast.
BUCKETS = 4096


def row_hash(columns: list[str], seed: int = 0) -> Column:
    """A hash of a row in which a null and where it stands count."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")


def digests(df: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, d1, d2): rows of each bucket of keys and the sums of two hashes of them."""
    wide = lambda seed: F.sum(row_hash([key, *columns], seed).cast("decimal(38,0)"))
    return df.groupBy(_bucket(key, buckets).alias("bucket")).agg(F.count("*").alias("n"), wide(0).alias("d1"), wide(1).alias("d2"))


def differing_buckets(old: DataFrame, new: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket) of those whose digests are not the same; a row a bucket at most."""
    a, b = digests(old, key, columns, buckets), digests(new, key, columns, buckets)
    both = a.select("bucket", F.struct("n", "d1", "d2").alias("a")).join(b.select("bucket", F.struct("n", "d1", "d2").alias("b")), "bucket", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def changed_rows(old: DataFrame, new: DataFrame, key: str, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(key, change, fields): added, removed and modified keys, and which columns of a modified one differ, in order of their names.

    Keys are distinct in a snapshot; of rows that share one, the sum of their hashes counts and fields stays empty.
    """
    differ = F.broadcast(differing_buckets(old, new, key, columns, buckets))

    def side(df, name):
        rows = df.withColumn("bucket", _bucket(key, buckets)).join(differ, "bucket", "left_semi")
        hashes = [F.sum(row_hash([c], 2).cast("decimal(38,0)")).alias(f"{name}_{i}") for i, c in enumerate(columns)]
        return rows.groupBy(F.col(f"`{key}`").alias("key")).agg(F.count("*").alias(f"{name}_n"), *hashes)

    both = side(old, "a").join(side(new, "b"), "key", "full")
    fields = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"a_{i}") != F.col(f"b_{i}"), F.lit(c)) for i, c in enumerate(columns)])))
    change = F.when(F.col("a_n").isNull(), F.lit("added")).when(F.col("b_n").isNull(), F.lit("removed")).when((F.size(fields) > 0) | (F.col("a_n") != F.col("b_n")), F.lit("modified"))
    listed = F.when(change == "modified", F.array_join(fields, ",")).otherwise(F.lit(""))
    return both.select(F.col("key").cast("string").alias("key"), change.alias("change"), listed.alias("fields")).where("change IS NOT NULL")


def snapshot_diff(pairs: dict[str, tuple[DataFrame, DataFrame, str, list[str]]], buckets: int = BUCKETS) -> DataFrame:
    """(table, key, change, fields) over several tables, each (old, new, key, columns)."""
    out = None
    for name, (old, new, key, columns) in pairs.items():
        own = changed_rows(old, new, key, columns, buckets).select(F.lit(name).alias("table"), "key", "change", "fields")
        out = own if out is None else out.unionByName(own)
    return out


def mutated_tables(pairs: dict[str, tuple[DataFrame | None, DataFrame | None, str, list[str]]]) -> DataFrame:
    """(table, mutated): whether its counts or digests differ, or it is in one snapshot only; no row is compared with another."""
    out = None
    for name, (old, new, key, columns) in pairs.items():
        if old is None or new is None:
            known = new if old is None else old
            own = known.limit(0).agg(F.lit(True).alias("mutated"))
        else:
            own = differing_buckets(old, new, key, columns).agg((F.count("*") > 0).alias("mutated"))
        own = own.select(F.lit(name).alias("table"), "mutated")
        out = own if out is None else out.unionByName(own)
    return out
