"""Vectors against stated queries: which rows take part, and how shards meet the queries.

Vectors are dealt by a hash of their id to shards of about ``shard_rows`` and cross the network once. Every shard must see
every query, so it is the few queries that are copied, once for each shard. A task reads a shard, indexes it once, and then
takes the queries as they stream in, ``query_rows`` at a time: it never holds more than one shard and one such block. Each
query gets the shard's best k; a window over the shards' bests gives the k of all.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

SHARD_ROWS, QUERY_ROWS = 16384, 1024


def sound_vectors(df: DataFrame, id_col: str, vec_col: str, allow_zero: bool) -> DataFrame:
    """(vec_id, v, dim) of rows with an id and a vector without null or non-finite components; v is array<double>."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & good)
    if not allow_zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


class _Side:
    """Rows of one side as they come: ids and vectors."""

    def __init__(self, dim: int):
        self.dim, self.ids, self.vectors, self.n = dim, [], [], 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors.reshape(-1, self.dim))
        self.n += len(ids)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All rows so far; of rows that share an id the least vector counts."""
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        at = np.concatenate(self.vectors) if self.vectors else np.zeros((0, self.dim))
        self.ids, self.vectors, self.n = [], [], 0
        if len(np.unique(ids)) < len(ids):
            order = np.lexsort((*at.T[::-1], ids))
            ids, first = np.unique(ids[order], return_index=True)
            at = at[order[first]]
        return ids, np.ascontiguousarray(at)


def _searching(index, score: str, query_rows: int):
    """Rows come shard by shard, a shard's vectors before the queries."""

    def run(batches):
        import pyarrow as pa

        now = side = ready = None

        def table(found):
            kind = pa.int64() if score == "long" else pa.float64()
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2]).cast(kind)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            dim, shard, asks, ids = (np.asarray(batch.column(i)) for i in range(4))
            vectors = batch.column(4)
            offsets, flat = np.asarray(vectors.offsets), np.asarray(vectors.values)
            change = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip(np.r_[0, change], np.r_[change, len(ids)]):
                if a == b:
                    continue
                key = int(dim[a]), int(shard[a])
                if now is None or now[:2] != key or now[2] != bool(asks[a]):
                    if now is not None and now[2] and side.n and ready is not None:
                        yield table(ready(*side.take()))
                    if now is not None and now[:2] == key:  # the vectors are all here
                        ready = index(*side.take())
                    else:
                        side, ready = None, None
                    now, side = (*key, bool(asks[a])), _Side(key[0])
                for c in range(a, b, query_rows):
                    d = min(b, c + query_rows)
                    side.add(ids[c:d], flat[offsets[c] : offsets[d]])
                    if now[2] and side.n >= query_rows:
                        own = side.take()
                        if ready is not None:
                            yield table(ready(*own))
        if now is not None and now[2] and side.n and ready is not None:
            yield table(ready(*side.take()))

    return run


def search_shards(rows: DataFrame, every: int, k: int, index, score: str, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows whose vec_id is divisible by every, the k best that the index finds.

    index(ids, X) gets a shard, of one dimension and without repeated ids, and gives a function (query_ids, Q) -> arrays
    (query_id, vec_id, score) with at most k entries for a query, which is called for one block of queries after another.
    """
    n = max([1, *(r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect())])  # a row for each dimension
    shards = math.ceil(n / shard_rows)
    data = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("dim", "vec_id").agg(F.min("v").alias("v"))
    asked = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v")
    # a shard of each dimension to each partition
    dealt = data.union(asked).repartitionById(shards, F.pmod(F.xxhash64("dim") + F.col("shard"), F.lit(shards)).cast("int")).sortWithinPartitions("dim", "shard", "asks")
    near = dealt.mapInArrow(_searching(index, score, query_rows), f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(k: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
