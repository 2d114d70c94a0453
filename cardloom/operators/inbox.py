"""What waits for an operator, from all sources, in the order in which it presses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Severities in order, what is to be done about jobs by their status, and what feedback is about.
SEVERITIES = ("critical", "high", "normal")
JOBS = {"review_required": ("high", "Review benefits"), "failed": ("high", "Recover benefits"), "quarantined": ("high", "Review quarantined benefits"), "staged": ("normal", "Review benefits")}
FEATURES = {"statement_processing": "statement processing", "card_data": "card data", "recommendation": "recommendation"}
#: Characters of a label's part, and items of a page.
LABEL, MOST = 80, 100
ITEM = ("id", "type", "severity", "title", "source_status", "age_seconds")


def label_part(c: Column) -> Column:
    """A name that may be shown: no control characters, white space as one space, two characters at least; null if there is none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{Cc}\p{Cf}]", " "), r"\s+", " "))
    return F.when(F.length(plain) >= 2, F.substring(plain, 1, LABEL))


def _age(c: Column, now: str) -> Column:
    """Whole seconds; what is not known or to come is none old."""
    micros = F.timestamp_diff("MICROSECOND", c, F.lit(now).cast("timestamp_ntz"))
    return F.coalesce(F.greatest(F.floor(micros / 1_000_000), F.lit(0)), F.lit(0)).cast("long")


def _items(rows: DataFrame, kind: str, prefix: str, key: Column, severity: Column, title: Column, status: Column, at: Column, now: str) -> DataFrame:
    return rows.select(F.concat(F.lit(f"{prefix}:"), key.cast("string")).alias("id"), F.lit(kind).alias("type"), severity.alias("severity"), title.alias("title"), status.alias("source_status"), _age(at, now).alias("age_seconds"))


def items(reviews: DataFrame, jobs: DataFrame, cards: DataFrame, controls: DataFrame, feedback: DataFrame, now: str) -> DataFrame:
    """Every item (id, type, severity, title, source_status, age_seconds).

    reviews: (id, status, created_at); jobs: (id, status, card_id, parser_version, run_mode, next_retry_at, created_at); cards: (card_id, bank, card_name);
    controls: (is_paused, updated_at), a row; feedback: (id, feature_key, severity, review_status, created_at). Identities
    that are pending; jobs of a status that needs someone, oldest parsers left out, with their card's label where both parts may be shown; one item if
    scheduled work waits while it is paused; feedback that nobody has read.
    """
    waiting = reviews.where("status = 'pending' AND id IS NOT NULL")
    out = _items(waiting, "card_identity_review", "card-identity", F.col("id"), F.lit("normal"), F.lit("Review card identity"), F.col("status"), F.col("created_at"), now)
    own = jobs.where(F.col("parser_version") != "catalog-v1")
    shown = own.where(F.col("status").isin(*JOBS) & F.col("id").isNotNull()).join(cards.select("card_id", label_part(F.col("bank")).alias("_bank"), label_part(F.col("card_name")).alias("_card")), "card_id")
    pick = lambda i: F.create_map(*[F.lit(x) for k, v in JOBS.items() for x in (k, v[i])])[F.col("status")]
    title = F.concat(pick(1), F.coalesce(F.concat(F.lit(": "), "_bank", F.lit(" — "), "_card"), F.lit("")))
    out = out.unionByName(_items(shown, "benefit_enrichment_review", "benefit-enrichment", F.col("id"), pick(0), title, F.col("status"), F.col("created_at"), now))
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= F.lit(now).cast("timestamp_ntz"))
    backlog = own.where((F.col("run_mode") == "scheduled") & F.col("status").isin("queued", "failed") & due).agg(F.count("*").alias("n"))
    paused = controls.where("is_paused").agg(F.max("updated_at").alias("updated_at")).withColumn("k", F.lit(1)).join(backlog.where("n > 0").withColumn("k", F.lit(1)), "k").where("updated_at IS NOT NULL")
    out = out.unionByName(_items(paused, "paused_pipeline", "system", F.lit("benefit_enrichment_scheduled:paused"), F.lit("critical"), F.lit("Scheduled benefit enrichment is paused"), F.lit("paused"), F.col("updated_at"), now))
    unread = feedback.where("review_status = 'pending' AND id IS NOT NULL")
    about = F.coalesce(F.create_map(*[F.lit(x) for kv in FEATURES.items() for x in kv])[F.coalesce("feature_key", F.lit(""))], F.lit("AI output"))
    severity = F.when(F.col("severity").isin("critical", "high"), F.col("severity")).otherwise(F.lit("normal"))
    return out.unionByName(_items(unread, "feedback_review", "feedback", F.col("id"), severity, F.concat(F.lit("Review "), about, F.lit(" feedback")), F.col("review_status"), F.col("created_at"), now))


def ranked(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The most pressing items: severity, then age, then id."""
    order = F.coalesce(*[F.when(F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)])
    return rows.orderBy(order, F.desc("age_seconds"), "id").limit(most)
