"""Cards, their benefits and mails about them: joins and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.functions import text as T
from cardloom.operators.settle import settled

#: What may become of a mail.
OUTCOMES = ("succeeded", "needsPassword", "needsCardAssignment", "discoveryQueued", "failed")


def searchable(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\bclub\b", ""), "[^a-z0-9]", "")


def card_of_mail(mails: DataFrame, cards: DataFrame) -> DataFrame:
    """(mail_id, card_id): the one card of the mail's user and bank whose last digits stand in the file name; else the one whose
    name, of five letters and more, stands in the subject; null if there is none or several.

    mails: (mail_id, user_id, bank, filename, subject); cards: (card_id, user_id, bank, card_name, last_four).
    """
    own = cards.select("user_id", "card_id", "last_four", T.bank_name(F.coalesce("bank", F.lit(""))).alias("_bank"), searchable(F.col("card_name")).alias("_name"))
    rows = mails.withColumn("_bank", T.bank_name(F.coalesce("bank", F.lit("")))).join(own, ["user_id", "_bank"], "left")
    four = F.trim("last_four")
    digits = four.rlike(r"^\d{4}$") & F.regexp_like("filename", F.concat(F.lit(r"(?<!\d)"), four, F.lit(r"(?!\d)")))
    product = (F.length("_name") >= 5) & F.contains(searchable(F.col("subject")), F.col("_name"))
    found = rows.groupBy("mail_id").agg(*[f.alias(n) for t, i in ((digits, 4), (product, 5)) for n, f in ((f"n{i}", F.count_if(t)), (f"c{i}", F.min(F.when(t, F.col("card_id")))))])
    return found.select("mail_id", F.when(F.col("n4") == 1, F.col("c4")).when(F.col("n5") == 1, F.col("c5")).alias("card_id"))


def outcome_tally(mails: DataFrame) -> DataFrame:
    """One row: how many mails came to each outcome, the others, and all."""
    known = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return mails.agg(*known, F.count_if(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False))).alias("other"), F.count("*").alias("mails"))


def offered_benefits(mappings: DataFrame, benefits: DataFrame, cards: DataFrame) -> DataFrame:
    """Mappings with their benefit and their card; those without either go."""
    return mappings.join(benefits, "benefit_id").join(cards, "card_id")


def deal_snapshot(mappings: DataFrame, benefits: DataFrame, cards: DataFrame, owned: DataFrame, spent: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(user_id, card_id, benefit_id, is_owned, cycle_spend, is_confirmed): all that ranking deals needs to know of a user's cards.

    owned: (user_id, card_id); spent: (user_id, card_id, spend); confirmed: (user_id, benefit_id). Sums and flags are grouped before
    they are joined, so no join multiplies rows.
    """
    offers = offered_benefits(mappings.select("card_id", "benefit_id"), benefits.select("benefit_id"), cards.select("card_id"))
    users = owned.select("user_id", "card_id").distinct().join(offers, "card_id")
    sums = spent.groupBy("user_id", "card_id").agg(F.sum("spend").alias("cycle_spend"))
    flags = confirmed.select("user_id", "benefit_id").distinct().withColumn("is_confirmed", F.lit(True))
    rows = users.join(sums, ["user_id", "card_id"], "left").join(flags, ["user_id", "benefit_id"], "left")
    return rows.select("user_id", "card_id", "benefit_id", F.coalesce("cycle_spend", F.lit(0)).alias("cycle_spend"), F.coalesce("is_confirmed", F.lit(False)).alias("is_confirmed"))


def bindings(keys: DataFrame, provenance: DataFrame, hashes: DataFrame) -> DataFrame:
    """(url_hash, cards): the cards bound to each hash, by key or by either hash of their provenance, in order."""
    each = F.explode(F.array("submitted_hash", "final_hash")).alias("url_hash")
    bound = keys.select("url_hash", "card_id").union(provenance.select(each, "card_id")).distinct()
    rows = hashes.select(F.lower("url_hash").alias("url_hash")).distinct().join(bound, "url_hash", "left")
    return rows.groupBy("url_hash").agg(F.array_join(F.array_sort(F.collect_set("card_id")), ",").alias("cards"))  # a url names few cards


def only_match(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(page_id, card_id): the one credit card of the page's issuer all of whose words the page has, of no other network or tier
    than the page names; null if there is none or several.

    pages: (page_id, issuer, content), distinct; candidates: (card_id, issuer, card_type, card_name, network). Cards alike in words, network and tier
    count once with their number; a card meets the pages that have its rarest word, so an issuer's cards and pages do not all meet.
    """
    key = lambda c: F.lower(F.trim(c)).alias("_issuer")
    content = T.page_text(F.col("content"))
    seen = settled(pages.select("page_id", key("issuer"), F.array_distinct(T.product_tokens(content)).alias("_words"), T.network(content).alias("_seen"), T.tier(content).alias("_tier")))
    cards = candidates.where(F.lower(F.trim("card_type")) == "credit").select("card_id", key("issuer"), T.product_tokens(F.col("card_name")).alias("_own"), F.coalesce(T.network(F.col("network")), T.network(F.col("card_name"))).alias("_network"), T.tier(F.col("card_name")).alias("_grade"))
    kinds = cards.where(F.size("_own") > 0).groupBy("_issuer", "_own", "_network", "_grade").agg(F.count("*").alias("n"), F.min("card_id").alias("card_id"))
    each = kinds.select("_issuer", "_own", F.explode(F.array_distinct("_own")).alias("token")).distinct()
    often = each.groupBy("_issuer", "token").agg(F.count("*").alias("often"))
    rarest = each.join(often, ["_issuer", "token"]).groupBy("_issuer", "_own").agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    wanted = rarest.select("_issuer", "token").distinct()
    spoken = seen.select("page_id", "_issuer", F.explode("_words").alias("token")).join(wanted, ["_issuer", "token"], "left_semi")
    met = spoken.join(rarest, ["_issuer", "token"]).select("page_id", "_issuer", "_own").join(seen.drop("_issuer"), "page_id").where(F.size(F.array_except("_own", "_words")) == 0)
    kinds = kinds.withColumnsRenamed({"_issuer": "i", "_own": "o"})
    fits = (F.col("_network").isNull() | F.col("_seen").eqNullSafe(F.col("_network"))) & (F.col("_grade").isNull() | F.col("_tier").eqNullSafe(F.col("_grade")))
    rows = met.join(kinds, (F.col("_issuer") == F.col("i")) & (F.col("_own") == F.col("o"))).where(fits).groupBy("page_id").agg(F.sum("n").alias("n"), F.min("card_id").alias("card_id"))
    return pages.select("page_id").join(rows, "page_id", "left").select("page_id", F.when(F.col("n") == 1, F.col("card_id")).alias("card_id"))
