"""Dates, clocks and intervals, as column expressions. Every clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ORIGIN = "2001-01-01 00:00:00"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def parsed_date(c: Column) -> Column:
    """An ISO date, or day, month and year with - or /; null for what is no day of the calendar."""
    t = F.trim(c)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    other = F.when(t.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}$"), F.try_to_date(F.replace(t, F.lit("/"), F.lit("-")), "d-M-yyyy"))
    return F.coalesce(iso, other)


def resolved_date(parsed: Column, statement_date: Column, recovered: Column) -> tuple[Column, Column]:
    """(date, source): the parsed date if not after the statement, else one recovered from the document, else rejected."""
    source = F.when(parsed.isNull(), F.lit("statement_fallback")).when(parsed <= statement_date, F.lit("parser")).when(recovered <= statement_date, F.lit("pdf_context")).otherwise(F.lit("rejected_future"))
    day = F.when(source == "statement_fallback", statement_date).when(source == "parser", parsed).when(source == "pdf_context", recovered)
    return day, source


def strict_instant(c: Column) -> Column:
    """An ISO instant with seconds and an offset within 14 hours; null for any other text."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-](0\d|1[0-4]):[0-5]\d)$"
    return F.when(c.rlike(shape), F.try_to_timestamp(c))


def within(c: Column, now: str, since: str = "2000-01-01", ahead: str = "5 minutes") -> Column:
    """c if it lies between since and shortly after now, else null."""
    return F.when((c >= at(since)) & (c <= at(now) + F.expr(f"INTERVAL {ahead}")), c)


def instant_text(c: Column) -> Column:
    """UTC with microseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def cycle_start(unit: str, now: str) -> Column:
    """Start of the month, quarter or year of now."""
    return F.date_trunc(unit, at(now))


def quarter_hour(c: Column) -> Column:
    """Start of c's 15 minutes, counted from the start of 2001."""
    return F.window(c, "15 minutes").start


def jitter(key: Column, radius: int) -> Column:
    """A number from -radius to radius that the bytes of key fix."""
    places = F.sequence(F.lit(1), F.length(key))
    total = F.aggregate(F.transform(places, lambda i: F.ascii(F.substr(key, i, F.lit(1)))), F.lit(0), lambda a, x: a + x)
    return total % (2 * radius + 1) - radius


def next_observation(last: Column, key: Column, discontinued: Column, held: Column) -> Column:
    """30 days on, give or take 3, while a card is offered; 7, give or take 1, once it is not but held; then never."""
    days = F.when(~discontinued, F.lit(30) + jitter(key, 3)).when(held, F.lit(7) + jitter(key, 1))
    return last + F.make_dt_interval(days)


def retry_after(attempts: Column, failed_at: Column) -> tuple[Column, Column]:
    """(status, next try): 15 minutes after the first failure, an hour after the second, review from the third on."""
    status = F.when(attempts >= 3, F.lit("review")).otherwise(F.lit("failed"))
    wait = F.when(attempts <= 1, F.expr("INTERVAL '15' MINUTE")).otherwise(F.expr("INTERVAL '60' MINUTE"))
    return status, F.when(attempts < 3, failed_at + wait)
