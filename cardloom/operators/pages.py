"""What kind of page a page of an issuer is, from its url and the names in its structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.functions.lifecycle import tidy
from cardloom.operators.settle import settled

#: Words of urls and headings that make a page none of a product, one about a product's terms, one of a product.
UNSAFE = r"(?i)(?:^|[/?=&_.-])(?:login|log-in|apply|application|track|tracking|blog|stories?|story|protection|insurance|generic|help|support|learning-centre)(?:$|[/?=&_.-])"
CALCULATOR = "(?i)calculator"
TERMS = r"(?i)(?:benefits?|fees?|charges?|rewards?|terms?|conditions?|mitc)(?:$|[/?=&_.-])"
PRODUCT = r"(?i)(?:credit[-_ ]?cards?|cards?[-_ ]?credit|card[-_ ]?products?|product[-_ ]?cards?)(?:$|[/?=&_.-])"
#: Words that name no product of an issuer, in names and in paths.
PLAIN = ("bank", "credit", "card", "cards", "the", "and", "with", "for", "of", "html", "www", "en", "in", "personal", "products", "product", "apply", "now", "online", "best")
#: How much of a page's headings counts as evidence.
SHOWN = 3


def _texts(html: Column, tags: str) -> Column:
    """Texts of the elements of tags, in the order of the page."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<({tags})\b[^>]*>(.*?)</\1\s*>"), F.lit(2))
    return F.filter(F.transform(found, lambda x: tidy(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"(?i)&(?:nbsp|amp);", " "))), lambda x: x != "")


def _described(html: Column) -> Column:
    """Names of products in blocks of structured data, which may be one object, a list, or a graph of them."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"""), F.lit(1))

    def names(block):
        v = F.try_parse_json(block)
        many = F.concat(*[F.coalesce(F.try_variant_get(v, at, "array<variant>"), F.array().cast("array<variant>")) for at in ("$", "$['@graph']")], F.array(v))
        return F.filter(F.transform(many, lambda o: F.when(F.try_variant_get(o, "$['@type']", "string").isin("Product", "CreditCard", "FinancialProduct", "PaymentCard"), F.try_variant_get(o, "$.name", "string"))), lambda x: x.isNotNull())

    return F.flatten(F.transform(blocks, names))


def _words(c: Column, issuer: Column) -> Column:
    split = F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " ")
    return F.filter(F.array_except(F.split(F.lower(split), "[^a-z0-9]+"), issuer), lambda w: (F.length(w) > 1) & ~w.isin(*PLAIN))


def page_classes(pages: DataFrame) -> DataFrame:
    """(page_id, kind, confidence, name, warnings) for pages (page_id, issuer, url, html).

    A name is what stands before "card" in a heading, a part of the title or a structured-data block, without the issuer's words; it is the
    page's product if the path of the url has one of its words, or all of them run together. Main headings come before titles,
    titles before lesser headings and structured data. Urls and headings of forms, help and the like are none of a product's;
    with a product, one whose url speaks of terms is a document about it, else one that speaks of cards is the product's page, else one
    whose headings speak of terms a document. Rows are judged where they lie. A null url or page is ambiguous.
    """
    issuer = F.filter(F.split(F.lower(F.coalesce("issuer", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    html = F.coalesce("html", F.lit(""))
    ld = F.when(html.contains("ld+json"), _described(html)).otherwise(F.array().cast("array<string>"))
    rows = settled(pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), issuer.alias("issuer"), _texts(html, "title").alias("titles"), _texts(html, "h1").alias("h1"), _texts(html, "h2").alias("h2"), _texts(html, "title|h1|h2").alias("shown"), ld.alias("ld")))
    titles = F.flatten(F.transform("titles", lambda t: F.split(t, r"\s[|–—-]\s")))
    said = F.transform(F.concat("h1", titles, "h2", "ld"), lambda t: F.regexp_extract(t, r"(?i)^(.*?)\b(?:credit\s+)?cards?\b", 1))
    path = F.regexp_replace("url", r"^[a-zA-Z]+://[^/?#]*|[?#].*$", "")
    names = F.transform(said, lambda t: _words(t, F.col("issuer")))
    rows = settled(rows.select("page_id", "url", names.alias("names"), _words(path, F.col("issuer")).alias("path"), F.concat_ws("\n", "url", F.concat_ws(" ", F.slice(F.array_distinct("shown"), 1, SHOWN))).alias("evidence")))
    # words that a url runs together are one word of its path
    bound = F.filter("names", lambda n: (F.size(n) > 0) & (F.arrays_overlap(n, F.col("path")) | (F.length(F.array_join(n, "")) >= 4) & F.array_contains(F.col("path"), F.array_join(n, ""))))
    rows = rows.withColumn("name", F.get(bound, F.lit(0)))
    has, url, evidence = F.col("name").isNotNull(), F.col("url"), F.col("evidence")
    kind = (
        F.when(url.rlike(CALCULATOR) | evidence.rlike(UNSAFE), F.lit("not_a_card")).when(has & url.rlike(TERMS), F.lit("supporting_document")).when(has & evidence.rlike(PRODUCT), F.lit("card_product"))
        .when(has & evidence.rlike(TERMS), F.lit("supporting_document")).otherwise(F.lit("ambiguous"))
    )
    confidence = F.when(kind == "not_a_card", 0.99).when(kind == "card_product", 0.95).when(kind == "supporting_document", 0.86).otherwise(0.2)
    warning = F.when(kind == "not_a_card", F.lit("quarantined_page_pattern")).when(kind == "ambiguous", F.lit("insufficient_card_signals")).otherwise(F.lit(""))
    return rows.select("page_id", kind.alias("kind"), confidence.alias("confidence"), F.when(kind.isin("card_product", "supporting_document"), F.array_join("name", " ")).alias("name"), warning.alias("warnings"))
