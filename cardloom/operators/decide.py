"""Small decisions over rows, as column expressions: what to do with a job, a proposal, a removal, a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FINISHED = ("completed", "staged", "quarantined", "review_required", "failed")


def requeue_action(mode: Column, status: Column, next_run: Column, now: Column, eligible: Column, staged: Column) -> Column:
    """queue, clear or none for a finished job."""
    clear = F.when(next_run.isNull(), F.lit("none")).otherwise(F.lit("clear"))
    unknown = now.isNull() | eligible.isNull() | staged.isNull() | ~F.coalesce(status.isin(*FINISHED), F.lit(False))
    due = next_run.isNull() | (next_run <= now)
    return F.when(unknown, F.lit("none")).when((mode != "scheduled") | ~eligible, clear).when(due, F.lit("queue")).otherwise(F.lit("none"))


def lifecycle(discontinued: Column, http: Column, validated: Column, explicit: Column) -> tuple[Column, Column]:
    """(suggestion, observation): whether a card comes back or ends, and whether what was seen agrees with what is held."""
    good = (http == 200) & validated
    suggestion = F.when(discontinued & good & ~explicit, F.lit("reactivate")).when(~discontinued & ((http == 410) | (good & explicit)), F.lit("mark_discontinued"))
    seen = F.coalesce(suggestion, F.when((http == 410) & discontinued | good & (discontinued == explicit), F.lit("observe_current")))
    return suggestion, seen


def disposition(complete: Column, current: Column, proposed: Column) -> Column:
    """What a crawl's proposals amount to."""
    return F.when(~complete & (proposed == 0), F.lit("incomplete")).when(proposed > 0, F.lit("material")).when(current > 0, F.lit("removal_review")).otherwise(F.lit("no_change"))


def publish_reasons(official: Column, confidence: Column, product: Column, statements: Column, candidates: Column) -> Column:
    """Reasons against publishing without review; none means go. product: official product key; statements: keys seen in statements."""
    known = F.exists(statements, lambda s: (F.length(s) >= 4) & (s == product))
    return F.array_compact(F.array(
        F.when(~official, F.lit("unofficial_source")), F.when(confidence < 0.9, F.lit("low_confidence")), F.when(F.size(statements) == 0, F.lit("missing_statement_signal")).when(~known, F.lit("product_mismatch")),
        F.when(candidates > 1, F.lit("ambiguous_catalog"))))


def paused_alert(jobs: DataFrame, enabled: bool) -> DataFrame:
    """One row if work waits while the pipeline is paused: the backlog and its oldest job."""
    waiting = jobs.where(F.col("status").isin("queued", "failed")).agg(F.count("*").alias("backlog"), F.min("created_at").alias("oldest"))
    return waiting.where((F.col("backlog") > 0) & F.lit(not enabled))
