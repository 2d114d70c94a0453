"""Products that pages say are no longer issued."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardloom.functions import lifecycle as L
from cardloom.operators.settle import settled


def ended_products(pages: DataFrame, html: str, product: str, issuer: str) -> DataFrame:
    """pages with evidence: an excerpt that says that the issuer's product is no longer issued, or null. One row in, one row out:
    whole pages are read where they lie, without a shuffle. A page that nowhere has the words is not cut up; a null page or product,
    or a product without words of its own, has no evidence; a null issuer has no words.
    """
    rows = pages.withColumn("_product", L.words(F.col(product))).withColumn("_issuer", L.words(F.coalesce(F.col(issuer), F.lit(""))))
    may = (F.size("_product") > 0) & F.col(html).rlike(rf"(?i)\b{L.ENDED}\b")
    rows = settled(rows.withColumn("_items", F.when(may, L.clauses(F.col(html)))))
    who = L.Subject(F.col("_product"), F.col("_issuer"))
    rows = settled(rows.withColumn("_items", L.judged(F.col("_items"), who)))
    rows = settled(rows.withColumn("_items", L.last_words(F.col("_items"), who)))
    return rows.withColumn("evidence", L.evidence(F.col("_items"))).drop("_product", "_issuer", "_items")
