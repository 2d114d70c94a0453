"""Benefits that a crawl no longer sees: which of them may be retired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Crawls of a card that count, and how far apart two absences must be.
REMEMBERED, APART = 24, "INTERVAL '7' DAY"


def absences(history: DataFrame, now: Column, most: int = REMEMBERED) -> DataFrame:
    """(card_id, id, observed_at, seq): every id that a complete crawl did not see, of the newest most crawls of each card up to now;
    seq numbers the card's complete crawls among them. history: (card_id, observed_at, complete, absent_ids)."""
    newest = Window.partitionBy("card_id").orderBy(F.desc("observed_at"), F.desc("complete"))
    kept = history.where(F.col("observed_at") <= now).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    whole = kept.where("complete").withColumn("seq", F.dense_rank().over(Window.partitionBy("card_id").orderBy("observed_at")))
    return whole.select("card_id", F.explode(F.array_distinct("absent_ids")).alias("id"), "observed_at", "seq").where("id <> ''").distinct()


def streaks(absent: DataFrame) -> DataFrame:
    """(card_id, id, streak): the longest unbroken run of complete crawls without the id."""
    place = F.row_number().over(Window.partitionBy("card_id", "id").orderBy("seq"))
    runs = absent.select("card_id", "id", (F.col("seq") - place).alias("island")).groupBy("card_id", "id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("card_id", "id").agg(F.max("n").alias("streak"))


def removal_policy(removals: DataFrame, crawls: DataFrame, history: DataFrame, now: str) -> DataFrame:
    """(card_id, benefit_id, suppressed, eligible, reason, observations, streak) for each possible removal.

    removals: (card_id, benefit_id, dedupe_key, effective_to), distinct; crawls: (card_id, complete, observed_at), the crawl that proposes them. An
    incomplete crawl, or none, suppresses all of its removals. Else a past end date retires, one to come does not, and without
    one two complete absences seven days apart do, the proposing crawl's own and those under either name in history counted.
    """
    clock = F.lit(now).cast("timestamp_ntz")
    absent = absences(history, clock)
    names = F.array_distinct(F.array_compact(F.array("benefit_id", "dedupe_key")))
    keyed = removals.join(crawls.select("card_id", F.coalesce("complete", F.lit(False)).alias("complete"), F.col("observed_at").alias("own_at")), "card_id", "left").withColumn("suppressed", ~F.coalesce("complete", F.lit(False)))
    key = ["card_id", "benefit_id", "dedupe_key"]
    each = keyed.where(~F.col("suppressed")).select(*key, "own_at", F.explode(names).alias("id"))
    seen = each.join(absent.select("card_id", "id", "observed_at"), ["card_id", "id"]).select(*key, "observed_at").union(each.select(*key, F.col("own_at").alias("observed_at")))
    spans = seen.groupBy(*key).agg(F.count_distinct("observed_at").alias("n"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last"))
    runs = each.join(streaks(absent), ["card_id", "id"]).groupBy(*key).agg(F.max("streak").alias("streak"))
    # dedupe_key may be missing
    same = F.struct("card_id", "benefit_id", F.coalesce(F.concat(F.lit("="), "dedupe_key"), F.lit("")))
    rows = keyed.withColumn("_key", same)
    for side in (spans, runs):
        rows = rows.join(side.withColumn("_key", same).drop(*key), "_key", "left")
    today = clock.cast("date")
    wide = (F.col("n") >= 2) & (F.col("last") >= F.col("first") + F.expr(APART))
    reason = (
        F.when(F.col("suppressed"), F.lit("suppressed")).when(F.col("effective_to") < today, F.lit("explicit_past_end_date")).when(F.col("effective_to").isNotNull(), F.lit("explicit_end_date_not_past"))
        .when(F.col("last") > clock, F.lit("invalid_observation_history")).when(wide, F.lit("two_complete_observations")).otherwise(F.lit("insufficient_complete_observations"))
    )
    return rows.select("card_id", "benefit_id", "suppressed", reason.isin("explicit_past_end_date", "two_complete_observations").alias("eligible"), reason.alias("reason"), F.coalesce("n", F.lit(0)).alias("observations"), F.coalesce("streak", F.lit(0)).alias("streak"))
