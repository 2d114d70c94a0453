"""Which catalogue product a text or a page is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.functions import text as T
from cardloom.functions.rules import effective_network


def match_products(evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """(ev, id) for evidence (ev, issuer, signal) and catalogue (id, issuer, label); signal and label are product tokens.

    A label equal to the signal beats one whose words the signal holds, and more words beat fewer; if two products are best the id
    is null. Equal labels of an issuer count once, and so do equal signals. A label meets the signals that have its
    rarest word, or all of its letters in order; so what meets is little more than what matches, however many labels an issuer has.
    """
    labels = catalog.groupBy("issuer", "label").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))
    each = labels.select("issuer", "label", F.explode(F.array_distinct("label")).alias("token"))
    often = each.groupBy("issuer", "token").agg(F.count("*").alias("often"))
    rarest = each.join(often, ["issuer", "token"]).groupBy("issuer", "label").agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    signals = evidence.select("issuer", "signal").distinct()
    spoken = signals.select("issuer", "signal", F.explode(F.array_distinct("signal")).alias("token"))
    inside = spoken.join(rarest, ["issuer", "token"]).where(F.size(F.array_except("label", "signal")) == 0).select("issuer", "signal", "label")
    key = lambda c: F.array_join(c, "").alias("key")
    same = signals.select("issuer", "signal", key("signal")).join(labels.select("issuer", "label", key("label")), ["issuer", "key"]).select("issuer", "signal", "label")
    met = inside.union(same).distinct().join(labels, ["issuer", "label"])
    score = F.when(F.array_join("signal", "") == F.array_join("label", ""), F.lit(500)).otherwise(300 + 10 * F.size("label"))
    ranked = met.groupBy("issuer", "signal", score.alias("score"), (F.size("label") * 100 + F.length(F.array_join("label", ""))).alias("specificity")).agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    best = ranked.groupBy("issuer", "signal").agg(F.max_by(F.struct("id", "n"), F.struct("score", "specificity")).alias("best"))
    return evidence.select("ev", "issuer", "signal").join(best, ["issuer", "signal"]).select("ev", F.when(F.col("best.n") == 1, F.col("best.id")).alias("id"))


# ---------------------------------------------------------------- catalogue identities of pages

#: What stands before a product on pages about it, the words of its name that tell no product, and its tiers.
INTRODUCED = r"^(fees\s+and\s+charges\s+for|terms\s+and\s+conditions\s+for|benefits\s+of)\s+"
UNSPECIFIC = r"visa|master\s*card|rupay|american\s+express|amex|bank|credit|card|statement|your|the|for|club|axis|hdfc|icici|kotak|mahindra|indusind|hsbc|pnb|punjab|national|sbi|au"
TIERS = (("world-elite", r"world[\s-]+elite"), ("infinite", "infinite"), ("signature", "signature"), ("world", "world"), ("platinum", "platinum"), ("gold", "gold"), ("select", "select"), ("classic", "classic"))
#: Names that are a network or a tier and no product.
BARE = ("visa", "mastercard", "rupay", "americanexpress", "gold", "platinum", "infinite", "signature", "world")
#: Tiers that a family's name leaves out.
_TIER_WORDS = "|".join(p for _, p in TIERS)


def _letters(name: Column, leave_out: str) -> Column:
    own = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), INTRODUCED, "")), rf"\b(?:{leave_out})\b", " ")
    return F.regexp_replace(own, "[^a-z0-9]+", "")


def product_letters(name: Column) -> Column:
    """What tells a product from others of its issuer: its name without issuers, networks and the like."""
    return _letters(name, UNSPECIFIC)


def family_letters(name: Column) -> Column:
    """The product without its tier; a product that is all tier is its own family."""
    family, product = _letters(name, f"{UNSPECIFIC}|{_TIER_WORDS}"), product_letters(name)
    return F.when(family != "", family).otherwise(F.when(product != "", product))


def named_tier(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(rf"\b{p}\b"), F.lit(code)) for code, p in TIERS])


def _known(catalog: DataFrame) -> DataFrame:
    """Credit cards of the catalogue with all that is compared; others with their id alone."""
    network, _ = effective_network(F.col("network"), F.col("card_name"), F.col("bank"))
    return catalog.select("card_id", F.lower(F.trim("bank")).alias("_bank"), (F.lower(F.trim(F.coalesce("card_type", F.lit("")))) == "credit").alias("_credit"), family_letters(F.col("card_name")).alias("_family"), network.alias("_network"), named_tier(F.col("card_name")).alias("_tier"))


def _bindings(keys: DataFrame, provenance: DataFrame) -> DataFrame:
    """(url_hash, low, high): the least and the greatest card bound to a hash, by a key or by either hash of a provenance."""
    each = provenance.select(F.explode(F.array("submitted_hash", "final_hash")).alias("url_hash"), "card_id")
    both = keys.select("url_hash", "card_id").union(each).where("url_hash IS NOT NULL AND card_id IS NOT NULL")
    return both.groupBy(F.lower("url_hash").alias("url_hash")).agg(F.min("card_id").alias("low"), F.max("card_id").alias("high"))


def resolve_identities(requests: DataFrame, catalog: DataFrame, aliases: DataFrame, keys: DataFrame, provenance: DataFrame, domains: DataFrame) -> DataFrame:
    """(request_id, card_id, outcome): the catalogue card that each request is about, or why there is none.

    requests: (request_id, issuer, card_name, network, url, submitted_hash, final_hash); catalog: (card_id, bank, card_name, network, card_type);
    aliases: (card_id, alias); keys: (url_hash, card_id); provenance: (submitted_hash, final_hash, card_id); domains: (issuer, domain).

    Candidates come from three keys: a hash that a card is bound to, the issuer and the family of its name, the issuer and an
    alias. A bound card decides if it is a candidate by name and neither its network nor its tier speaks against it. Else
    candidates narrow to those of the same network and tier, where none equals none; one is the card, several are ambiguous,
    none of some is a conflict, and none of none is new. Outcomes before that: an identity that names no product, a url that is not in its one
    form, a host that is not the issuer's, hashes that are none, hashes bound to several cards. Each side is grouped to least, greatest and number
    before it is joined, so a family of many cards meets no request card by card.
    """
    network, _ = effective_network(F.col("network"), F.col("card_name"), F.col("issuer"))
    issuer, product, tier = F.lower(F.trim(F.coalesce("issuer", F.lit("")))), product_letters(F.col("card_name")), named_tier(F.col("card_name"))
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^https://([^/:?#]+)", 1)
    rows = requests.select(
        "request_id", issuer.alias("_bank"), product.alias("_product"), F.coalesce(family_letters(F.col("card_name")), tier).alias("_family"), network.alias("_network"), tier.alias("_tier"), "url", host.alias("_host"),
        F.lower("submitted_hash").alias("_one"), F.lower("final_hash").alias("_two"))

    # hosts: every tail of a host is looked up among the issuer's domains
    parts = F.split("_host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    approved = rows.select("request_id", "_bank", F.explode(tails).alias("domain")).join(domains.select(F.lower(F.trim("issuer")).alias("_bank"), "domain").distinct(), ["_bank", "domain"]).select("request_id").distinct().withColumn("_approved", F.lit(True))

    bound = _bindings(keys, provenance)
    for name in ("_one", "_two"):
        rows = rows.join(bound.select(F.col("url_hash").alias(name), F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high")), name, "left")
    rows = rows.join(approved, "request_id", "left").withColumn("_card", F.coalesce("_one_low", "_two_low"))

    known = _known(catalog)
    credit = known.where("_credit")
    named = credit.where("_family IS NOT NULL").select("_bank", F.concat(F.lit("f:"), "_family").alias("_key"), "card_id", "_network", "_tier")
    called = aliases.select("card_id", product_letters(F.col("alias")).alias("_alias")).where(F.col("_alias") != "").join(credit, "card_id")
    named = named.union(called.where(~F.col("_alias").isin(*BARE)).select("_bank", F.concat(F.lit("a:"), "_alias"), "card_id", "_network", "_tier"))
    own_keys = F.array_compact(F.array(F.concat(F.lit("f:"), "_family"), F.when(F.col("_product") != "", F.concat(F.lit("a:"), "_product"))))
    asked = rows.select("request_id", "_bank", "_network", "_tier", "_card", F.explode(own_keys).alias("_key"))
    # cards of a key by network and tier; a request reads those of its own, how many there are in all, and whether its bound card is there
    kinds = named.groupBy("_bank", "_key").agg(F.count("*").alias("_all"))
    fine = named.withColumn("_kind", F.concat_ws("|", F.coalesce("_network", F.lit("-")), F.coalesce("_tier", F.lit("-")))).groupBy("_bank", "_key", "_kind").agg(F.min("card_id").alias("_low"), F.max("card_id").alias("_high"))
    asked = asked.withColumn("_kind", F.concat_ws("|", F.coalesce("_network", F.lit("-")), F.coalesce("_tier", F.lit("-"))))
    there = named.select("_bank", "_key", F.col("card_id").alias("_card")).distinct().withColumn("_there", F.lit(True))
    found = asked.join(kinds, ["_bank", "_key"]).join(fine, ["_bank", "_key", "_kind"], "left").join(there, ["_bank", "_key", "_card"], "left")
    found = found.groupBy("request_id").agg(F.sum("_all").alias("_all"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_there").alias("_there"))

    held = known.select(F.col("card_id").alias("_card"), F.col("_bank").alias("b_bank"), "_credit", F.col("_network").alias("b_network"), F.col("_tier").alias("b_tier"))
    all_ = rows.join(found, "request_id", "left").join(held, "_card", "left")
    whole = F.lit("^[0-9a-f]{64}$")
    bare = (F.length("_product") < 2) | F.col("_product").isin(*BARE) & ~((F.col("_bank") == "american express") & F.col("_network").eqNullSafe("americanexpress") & F.col("_tier").isNotNull())
    torn = (F.col("_one_low") != F.col("_one_high")) | (F.col("_two_low") != F.col("_two_high")) | (F.col("_one_low") != F.col("_two_low"))
    against = lambda mine, theirs: F.col(theirs).isNotNull() & ~F.col(theirs).eqNullSafe(F.col(mine))
    unfit = ~F.col("b_bank").eqNullSafe(F.col("_bank")) | ~F.coalesce("_credit", F.lit(False)) | against("_network", "b_network") | against("_tier", "b_tier") | F.col("_there").isNull()
    outcome = (
        F.when((F.length("_bank") < 2) | bare, F.lit("invalid_catalog_identity")).when(~F.coalesce((F.trim("url") == T.canonical_url(F.col("url"))) & F.startswith("url", F.lit("https://")), F.lit(False)), F.lit("noncanonical_source_url")).when(F.col("_approved").isNull(), F.lit("unapproved_domain"))
        .when(~F.coalesce(F.regexp_like("_one", whole) & F.regexp_like("_two", whole), F.lit(False)), F.lit("invalid_url_hash")).when(F.coalesce(torn, F.lit(False)), F.lit("conflicting_url_identity"))
        .when(F.col("_card").isNotNull(), F.when(unfit, F.lit("url_identity_incompatible")).otherwise(F.lit("bound")))
        .when(F.col("_low") != F.col("_high"), F.lit("ambiguous_catalog_identity")).when(F.col("_low").isNotNull(), F.lit("matched")).when(F.coalesce("_all", F.lit(0)) > 0, F.lit("strong_catalog_identity_conflict")).otherwise(F.lit("new"))
    )
    card = F.when(outcome == "bound", F.col("_card")).when(outcome == "matched", F.col("_low"))
    return all_.select("request_id", card.alias("card_id"), outcome.alias("outcome"))
