"""Amounts, currencies and the calculators, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Banks of each market, by their normalised names.
UAE_BANKS = ("FAB", "Emirates NBD", "ADCB", "Mashreq", "CBD", "Dubai Islamic Bank", "RAKBANK", "Emirates Islamic", "HSBC UAE", "Citibank UAE")
INDIAN_BANKS = (
    "HDFC Bank", "SBI Card", "Axis Bank", "Amazon ICICI Bank", "ICICI Bank", "Kotak Bank", "IDFC FIRST Bank", "Yes Bank", "AU Small Finance Bank", "IndusInd Bank", "Standard Chartered", "American Express", "Citibank",
    "HSBC", "RBL Bank", "Federal Bank", "Karur Vysya Bank", "Bank of Baroda", "Canara Bank", "Punjab National Bank", "Union Bank of India", "Indian Bank", "Central Bank of India", "Indian Overseas Bank",
)


def market_currency(bank: Column) -> Column:
    """Currency of a normalised bank's market; null for a bank of neither, which is never taken for a default."""
    return F.when(bank.isin(*UAE_BANKS), F.lit("AED")).when(bank.isin(*INDIAN_BANKS), F.lit("INR"))


def transaction_currency(given: Column, market: Column) -> Column:
    """A given currency counts unless it is INR, which is only assumed; then the bank's market does, else INR."""
    own = F.upper(F.trim(given))
    return F.when((own != "") & (own != "INR"), own).otherwise(F.coalesce(market, F.lit("INR")))


def parsed_number(text: Column) -> Column:
    """A number among currency signs, separators and spaces; null if none is left."""
    return F.try_to_number(F.regexp_replace(text, "[^0-9.\\-]", ""), F.lit("S999999999999.999999")).cast("double")


def rupees(text: Column) -> Column:
    """First amount of a text, with lakh and crore."""
    found = F.regexp_extract(text, r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(lakhs?|lacs?|crores?|cr\b)?", 1)
    unit = F.lower(F.regexp_extract(text, r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(lakhs?|lacs?|crores?|cr\b)?", 2))
    n = F.when(found != "", F.regexp_replace(found, ",", "").cast("double"))
    return n * F.when(unit.rlike("^la"), F.lit(100_000.0)).when(unit.rlike("^cr"), F.lit(10_000_000.0)).otherwise(F.lit(1.0))


def cents(c: Column) -> Column:
    """Rounded to two places, halves up, as the calculators show it."""
    return F.floor(c * 100 + F.lit(0.5) + F.lit(1e-9)) / 100


def least_of(*cols: Column) -> Column:
    """Least of those that are known."""
    return reduce(lambda a, b: F.least(a, b), cols)


def card_value(amount: Column, rate_percent: Column, cap_left: Column) -> Column:
    """What a card gives for a purchase: its rate, within what is left of its cap if it has one."""
    return cents(F.least(cents(amount * rate_percent / 100), cap_left))


def milestone(target: Column, current: Column, planned: Column, days: Column) -> dict[str, Column]:
    """Remaining now, projected gap, daily pace (null without days) and status of a milestone."""
    projected = cents(current + planned)
    gap = cents(F.greatest(target - projected, F.lit(0.0)))
    pace = F.when(gap == 0, F.lit(0.0)).when(days == 0, F.lit(None)).otherwise(cents(gap / days))
    status = F.when(current >= target, F.lit("reached")).when(projected >= target, F.lit("on_track")).otherwise(F.lit("shortfall"))
    return {"remaining_now": cents(F.greatest(target - current, F.lit(0.0))), "projected_spend": projected, "projected_gap": gap, "daily_pace": pace, "status": status}


def ticket_offer(price: Column, count: Column, kind: Column, value: Column, cap: Column, fee: Column, uses: Column) -> dict[str, Column]:
    """What a ticket offer saves: pairs for one price, a percentage or a fixed sum, within cap and subtotal, if uses are left."""
    subtotal, fees = cents(price * count), cents(fee * count)
    raw = F.when(kind == "bogo", F.least(F.floor(count / 2), uses) * price).when(kind == "percent", subtotal * value / 100).when(kind == "fixed", value)
    saving = F.when(uses > 0, cents(F.least(raw, cap, subtotal))).otherwise(F.lit(0.0))
    all_ = subtotal + fees
    return {"ticket_subtotal": subtotal, "fees": fees, "savings": saving, "payable": cents(all_ - saving), "savings_percent": F.when(all_ == 0, F.lit(0.0)).otherwise(cents(saving / all_ * 100)), "available": uses > 0}
