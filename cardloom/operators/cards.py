"""Cards, statements and payments: latest statements, archives, allocation of credits, writes that repeat safely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN = ("pending", "partial", "overdue")


def outstanding() -> Column:
    return F.greatest(F.col("total_amount") - F.col("paid_amount"), F.lit(0))


def latest_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """For each key the row that is greatest by order; combined before the shuffle, as a window would not be."""
    rest = [c for c in df.columns if c not in (key, *order)]
    held = df.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return held.select(key, *[F.col(f"_row.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def due_bills(statements: DataFrame) -> DataFrame:
    """Latest statements that are not paid and have something outstanding."""
    last = latest_by(statements, "user_card_id", "statement_date", "id")
    return last.where((F.col("payment_status") != "paid") & (outstanding() > 0)).withColumn("outstanding", outstanding())


def allocate_payments(statements: DataFrame, credits: DataFrame) -> DataFrame:
    """First in, first out: each credit pays older open statements of its card, oldest first.

    credits: (source_id, user_card_id, source_date, credit). Gives one row for each statement paid from a credit, and the
    status it then has; what stays unmatched is credit less the payments. The running sum is over one card's open
    statements, whose number a card's life bounds.
    """
    open_ = statements.where(F.col("payment_status").isin(*OPEN) & (F.col("total_amount") > F.col("paid_amount")))
    older = open_.join(credits, "user_card_id").where((F.col("statement_date") < F.col("source_date")) & (F.col("id") != F.col("source_id")))
    due = F.col("total_amount") - F.col("paid_amount")
    line = Window.partitionBy("source_id").orderBy("statement_date", "due_date", "id")
    before = F.coalesce(F.sum(due).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    payment = F.greatest(F.least(due, F.col("credit") - before), F.lit(0))
    paid = older.withColumn("payment", payment).where("payment > 0")
    status = F.when(F.col("paid_amount") + F.col("payment") >= F.col("total_amount"), F.lit("paid")).otherwise(F.lit("partial"))
    return paid.select("source_id", "id", F.col("payment").cast("double").alias("payment"), status.alias("status"))


def applied_payment(amount: Column) -> tuple[Column, Column, Column]:
    """(accepted, new paid amount, new status) of a payment of a statement: positive and no greater than what is left."""
    ok = (amount > 0) & (amount <= F.col("total_amount") - F.col("paid_amount"))
    new = F.when(ok, F.col("paid_amount") + amount).otherwise(F.col("paid_amount"))
    return ok, new, F.when(~ok, F.col("payment_status")).when(new >= F.col("total_amount"), F.lit("paid")).otherwise(F.lit("partial"))


def unbilled(txns: DataFrame, statements: DataFrame) -> DataFrame:
    """Transactions without statement after the latest statement of their card; none for a card without statements."""
    closed = statements.groupBy("user_card_id").agg(F.max("statement_date").alias("closed"))
    return txns.join(closed, "user_card_id").where(F.col("statement_id").isNull() & (F.col("transaction_date") > F.col("closed").cast("timestamp_ntz")))


def active_benefits(benefits: DataFrame, as_of: str) -> DataFrame:
    """Neither retired nor inactive nor outside their validity on a day."""
    day = F.lit(as_of).cast("date")
    inside = F.coalesce(F.col("valid_from") <= day, F.lit(True)) & F.coalesce(F.col("valid_until") >= day, F.lit(True))
    return benefits.where(F.col("is_active") & F.col("retired_at").isNull() & inside)


def insert_new(target: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows to append: those whose natural key the target lacks, each key once (its least row by all columns)."""
    rest = [c for c in incoming.columns if c not in key]
    once = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return once.join(target.select(*key), key, "left_anti").select(*incoming.columns)


def upsert(target: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Target with incoming rows in place of those of equal key; of incoming rows of one key the greatest counts."""
    rest = [c for c in target.columns if c not in key]
    both = target.withColumn("_new", F.lit(0)).unionByName(incoming.select(*target.columns).withColumn("_new", F.lit(1)))
    held = both.groupBy(*key).agg(F.max(F.struct("_new", *rest)).alias("_row"))
    return held.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*target.columns)


def write_outcomes(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """How many incoming rows are new, repaired (a hole of the existing row filled), skipped or failed (no key)."""
    joined = incoming.join(existing.select(F.col(key), F.col("value").alias("_had"), F.lit(True).alias("_there")), key, "left")
    outcome = F.when(F.col(key).isNull(), F.lit("failed")).when(F.col("_there").isNull(), F.lit("new")).when(F.col("_had").isNull() & F.col("value").isNotNull(), F.lit("repaired")).otherwise(F.lit("skipped"))
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def resolve_once(matches: DataFrame, key: str, score: list[str], chosen: str) -> DataFrame:
    """The best match of each key by score, or null if two are best: ambiguity never picks one."""
    top = matches.groupBy(key).agg(F.max(F.struct(*score)).alias("_best"))
    best = matches.join(top, key).where(F.struct(*score) == F.col("_best"))
    return best.groupBy(key).agg(F.when(F.count_distinct(chosen) == 1, F.min(chosen)).alias(chosen))
