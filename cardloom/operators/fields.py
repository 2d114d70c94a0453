"""Fields that card pages, statements and messages name: fees, rates, networks, products, last digits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.functions import text as T
from cardloom.operators.settle import settled

MONEY = r"(?i)(?:₹|rs\.?|inr)\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
#: The lines that name each field, what is read of the line or the next one, and how sure that is.
FIELDS = (
    ("joining_fee", r"(?i)\bjoining\s+fee\b", MONEY, 0.95), ("annual_fee", r"(?i)\b(annual fee|annual membership fee)\b", MONEY, 0.95),
    ("apr", r"(?i)\b(?:finance\s+charges?|annual percentage rate|apr)\b", r"(?i)([0-9]+(?:\.[0-9]+)?)%\s*(?:annually|annual|p\.?a\.?)", 0.94), ("network", r"(?i)^\s*(?:(?:card|payment)\s+)?network\b", r"(?i)\b(visa|mastercard|rupay|american express|amex)\b", 0.96),
)


def page_fields(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, field, value, confidence): of each field the first line that names it and gives a value, there or on the next line."""
    rows = docs.select(id_col, F.split(text_col, "\n").alias("arr"))
    pairs = F.transform("arr", lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get("arr", i + 1), F.lit("")).alias("next")))
    lines = rows.select(id_col, F.posexplode(pairs).alias("no", "x")).select(id_col, "no", "x.line", "x.next")
    found = []
    for name, label, value, sure in FIELDS:
        here, there = F.regexp_extract("line", value, 1), F.regexp_extract("next", value, 1)
        found.append(F.when(F.col("line").rlike(label), F.struct(F.lit(name).alias("field"), F.when(here != "", here).otherwise(there).alias("value"), F.lit(sure).alias("confidence"))))
    read = settled(lines.select(id_col, "no", F.explode(F.array_compact(F.array(*found))).alias("f")).select(id_col, "no", "f.*")).where("value <> ''")
    return read.groupBy(id_col, "field").agg(F.min_by("value", "no").alias("value"), F.max("confidence").alias("confidence"))


def last_four(c: Column) -> Column:
    """The one run of four digits behind a mask; null if there is none or several different ones."""
    seen = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)(?:[x*]{2,}[\s-]*)+(\d{4})(?!\d)"), F.lit(1)))
    return F.when(F.size(seen) == 1, F.get(seen, F.lit(0)))


#: Words of a subject line that name no product, beside those of every product (T.IGNORED_TOKENS).
SUBJECT_WORDS = ("email", "emails", "statements", "account", "monthly", "new")
#: Words from which a subject speaks of something else: the rest of it is left out.
SUBJECT_ENDS = ("ending", "period", "is")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Bank words that a card's name may begin with.
BANK_STARTS = ("axis", "hdfc", "sbi", "icici", "kotak", "idfc", "yes", "au", "indusind", "rbl")
#: Words that every card's name may have.
CARD_WORDS = ("credit", "card", "bank", "ltd", "limited", "first", "statement", "for")


def _shown(words: Column) -> Column:
    """The words with capitals, or null if there are none."""
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000))), " "))


def product_of_subject(subject: Column, issuer_words: tuple[str, ...]) -> Column:
    """The product that a message's subject names: its words up to one that ends the name, less issuer, months, numbers and
    words of every subject; null if none is left."""
    words = T.product_words(subject)
    stop = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(w.isin(*SUBJECT_ENDS), i)), lambda i: i.isNotNull()))
    words = F.when(stop.isNull(), words).otherwise(F.slice(words, F.lit(1), stop))
    issuer = {part.lower() for w in issuer_words for part in (w, *re.findall("[A-Z]?[a-z0-9]+|[A-Z]+", w))}
    dull = {*SUBJECT_WORDS, *T.IGNORED_TOKENS, *issuer}
    month = lambda w: F.substring(w, 1, 3).isin(*MONTHS) & w.rlike("^[a-z]{3,9}$") & F.lower(subject).rlike("20[0-9]{2}")
    left = F.filter(words, lambda w: ~w.isin(*dull) & ~w.rlike("^(x*[0-9]*)$") & ~month(w))
    return _shown(left)


def card_name(raw: Column, bank_words: tuple[str, ...]) -> Column:
    """A card's own name: its words less the bank's at the start and those that every card has; if none is left, the bank's."""
    words = F.filter(F.split(F.lower(raw), "[^a-z0-9+&]+"), lambda w: (w != "") & ~w.isin(*CARD_WORDS))
    banks = {*BANK_STARTS, *(b.lower() for b in bank_words)}
    start = F.coalesce(F.array_min(F.filter(F.transform(words, lambda w, i: F.when(~w.isin(*banks), i)), lambda i: i.isNotNull())), F.size(words))
    own = F.slice(words, start + 1, F.greatest(F.size(words) - start, F.lit(0)))
    return F.coalesce(_shown(own), _shown(words), raw)
