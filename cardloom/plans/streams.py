"""Queries of streams: a table replayed as a stream gives what a batch query gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.plans.register import query
from cardloom.streaming import replay as R


@query("SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2001-01-01') AS bucket, user_id, count(*) AS attempts, count(*) <= 5 AS allowed FROM events GROUP BY 1, 2")
def stm1_rate_windows(spark, sf_dir):
    events = R.source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = R.run(R.rate_windows(events), "update", ["bucket", "user_id"])
    return out.withColumn("bucket", F.to_timestamp_ntz(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss")))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) <= 10 AS allowed FROM events")
def stm2_sliding(spark, sf_dir):
    """Requests of a user in the hour up to each request, as they stream in, late ones too."""
    out = R.run(R.sliding(R.source(spark, sf_dir, "events")), "update", ["event_id"])
    return out.select("event_id", "recent", (F.col("recent") <= 10).alias("allowed"))


@query("WITH k AS (SELECT user_id, event_type, max(event_id) AS id FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '@' || id, ',' ORDER BY id DESC) AS entries FROM k GROUP BY user_id")
def stm3_histories(spark, sf_dir):
    return R.run(R.histories(R.source(spark, sf_dir, "events")), "update", ["user_id"])


@query("SELECT event_id, user_id FROM events")
def stm4_once(spark, sf_dir):
    """Events that come twice, each kept once."""
    events = R.source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.run(R.once(events.union(events), ["event_id"]), "append").select("event_id", "user_id")
