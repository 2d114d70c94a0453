"""Sources in formats of their own: bulk dumps, sitemaps, attachments of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Attachments that go along with a statement but are none.
ANCILLARY = r"(?i)(terms|conditions|mitc|offer|brochure|leaflet|tariff|schedule of charges)"


def read_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a table dump: tabs between columns, \\N for null."""
    return spark.read.csv(path, schema=schema, sep="\t", nullValue="\\N", quote="", escape="\\", enforceSchema=True)


def sitemap(xml: Column) -> tuple[Column, Column]:
    """(kind, urls) of a sitemap: index, urlset, or invalid with none."""
    kind = F.when(xml.rlike(r"(?is)<sitemapindex\b.*</sitemapindex\s*>"), F.lit("index")).when(xml.rlike(r"(?is)<urlset\b.*</urlset\s*>"), F.lit("urlset")).otherwise(F.lit("invalid"))
    urls = F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*([^<]*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return kind, F.when(kind == "invalid", F.array().cast("array<string>")).otherwise(urls)


def statement_attachment(attachments: Column) -> Column:
    """Of an array of structs with filename and mime the one PDF that is no leaflet; where none or several are, the first PDF."""
    pdfs = F.filter(attachments, lambda a: (F.lower(a["mime"]) == "application/pdf") | F.lower(a["filename"]).endswith(".pdf"))
    own = F.filter(pdfs, lambda a: ~F.coalesce(a["filename"], F.lit("")).rlike(ANCILLARY))
    return F.when(F.size(own) == 1, F.get(own, F.lit(0))).otherwise(F.get(pdfs, F.lit(0)))
