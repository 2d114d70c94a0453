"""Streams over tables of files: rate windows, de-duplication and bounded histories, with results as tables.

``run`` drains a stream and returns its result as a table: in update mode every batch adds the new values of the keys it
changed, and of a key the value of the last batch counts. State and results lie in the folder that the cluster shares.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

KEPT = 24


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a single machine (local[*], as in tests) gets a folder; a cluster gets an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cardloom-stream-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of files as a stream, a file at a time."""
    at = f"{sf_dir}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(at).schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(at) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Drains stream and returns its rows; keys: of each key only the last batch's row."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/n={n}")  # a batch run again puts its rows in place

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out").drop("n")
    if keys is None:
        return out.drop("_batch")
    rest = [c for c in out.columns if c not in keys]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest if c != "_batch"])


def rate_windows(events: DataFrame, limit: int = 5, late: str = "1 hour") -> DataFrame:
    """Attempts of each user in each 15 minutes; windows leave the state once they are that late."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "15 minutes").alias("w"), "user_id").agg(F.count("*").alias("attempts"))
    return counts.select(F.col("w.start").alias("bucket"), "user_id", "attempts", (F.col("attempts") <= limit).alias("allowed"))


def once(events: DataFrame, key: list[str], late: str = "1 day") -> DataFrame:
    """The first of rows of equal key that come within the time that late allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def histories(events: DataFrame, most: int = KEPT) -> DataFrame:
    """(user_id, entries): each user's newest event of each kind, the newest most of them, as 'kind@id' in order."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        held = dict(zip(*state.get)) if state.exists else {}
        for b in batches:
            for kind, number in zip(b["event_type"], b["event_id"]):
                held[kind] = max(held.get(kind, -1), int(number))
        kept = sorted(held.items(), key=lambda x: -x[1])[:most]  # at most most entries are ever held
        state.update(([k for k, _ in kept], [n for _, n in kept]))
        yield pd.DataFrame({"user_id": [key[0]], "entries": [",".join(f"{k}@{n}" for k, n in kept)]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, entries string", "kinds array<string>, ids array<long>", "update", GroupStateTimeout.NoTimeout)


def sliding(events: DataFrame, span_us: int = 3_600_000_000, late_us: int = 86_400_000_000) -> DataFrame:
    """(event_id, recent): of each event how many of its user's came in the span up to it, itself and those of its instant included.

    Events may come late and out of order: one that comes later raises the counts of those after it, which are given out again
    (in update mode the last row of an event counts). A user's state is the events of the last late_us and the span before;
    what is older changes no more. An event that comes later still counts among those that are held.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches: Iterator, state: GroupState):
        import numpy as np
        import pandas as pd

        ids, at, given = (np.array(x, dtype="int64") for x in (state.get if state.exists else ([], [], [])))
        for b in batches:
            ids, at, given = np.concatenate([ids, b["event_id"]]), np.concatenate([at, b["at"]]), np.concatenate([given, np.zeros(len(b), "int64")])
        order = np.argsort(at, kind="stable")
        ids, at, given = ids[order], at[order], given[order]
        recent = np.searchsorted(at, at, "right") - np.searchsorted(at, at - span_us, "left")
        recent = np.maximum(recent, given)  # of old events what came before them may be gone
        new = recent != given
        yield pd.DataFrame({"event_id": ids[new], "recent": recent[new]})
        held = at >= at[-1] - late_us - span_us
        state.update((ids[held].tolist(), at[held].tolist(), recent[held].tolist()))

    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "event_id long, recent long", "ids array<long>, at array<long>, given array<long>", "update", GroupStateTimeout.NoTimeout)
