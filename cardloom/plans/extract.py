"""Queries of extraction, canonical JSON, identity and the smaller functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import canonical as J
from cardloom.functions import dates as D
from cardloom.functions import text as T
from cardloom.operators import extraction as X
from cardloom.operators.settle import spread
from cardloom.plans.register import query
from cardloom.sources.tables import CLOCK, view


#: A line for each parser with a number N and an amount M, and the terms that it states: value, rate, cap, threshold, period.
MADE = (
    ("Get N% off on movie tickets this week", "entertainment", "percent_discount", None, "n", None, None, None), ("Buy one cinema ticket, get one free, capped at Rs. M, twice per month", "entertainment", "bogo", "m", None, None, None, "month"),
    ("Movie vouchers worth INR N with a milestone of ₹M monthly", "entertainment", "milestone", "n", None, None, "m", "month"), ("N% fuel surcharge waived, up to Rs M per billing cycle", "fuel", "fuel_surcharge_waiver", None, "n", "m", None, "statement month"),
    ("Nx reward points, capped at M reward points per quarter", "points", "reward_multiplier", None, "n", "m", None, "quarter"), ("Welcome gift: N reward points on spends of Rs. M", "points", "welcome_bonus", "n", None, None, "m", None),
    ("N renewal reward points on annual spends above Rs. M", "points", "milestone_bonus", "n", None, None, "m", "year"), ("Earn N air miles for every Rs. M spent", "miles", "air_miles", "n", None, None, "m", None),
    ("Air accident insurance cover up to Rs. N lakh", "insurance", "insurance_cover", "n * 100000", None, "n * 100000", None, None), ("N complimentary golf rounds per year", "golf", "golf_access", "n", None, None, None, "year"),
    ("Dedicated concierge services for number N", "concierge", "concierge_access", None, None, None, None, None), ("Renewal fee reversal on spends over Rs. M", "other", "fee_waiver", None, None, None, "m", "year"),
    ("Flat N% discount at supermarkets and grocery stores, maximum of Rs. M per day", "grocery", "percent_discount", None, "n", "m", None, "day"), ("Rs. M cashback on bills in a calendar month", "cashback", "cashback", "m", None, None, None, "calendar month"),
    ("Getting N reward points per Rs. M", "points", "reward_points", "n", None, None, "m", None), ("Lounge access: N free domestic visits each quarter, in a quarter", "travel", "lounge_access", "n", None, None, None, "quarter"),
    ("Is there N% cashback?", None, None, None, None, None, None, None), ("N points of order and M plain words", None, None, None, None, None, None, None),
)


_OF_PARTS = "SELECT p_partkey, p_partkey % {k} AS k, p_size AS n, 100 * (p_partkey % 90 + 10) AS m FROM part"
_OF_DOCUMENTS = "SELECT doc_id, doc_id % {k} AS k, doc_id % 50 + 1 AS n, 100 * (doc_id % 90 + 10) AS m FROM documents"


def _made_sql(source: str, key: str) -> str:
    """The terms of the made lines from the numbers they were made of."""
    case = lambda i: "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, row in enumerate(MADE) if (v := row[i]) is not None) + " END"
    text = lambda i: "CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, row in enumerate(MADE) if (v := row[i]) is not None) + " END"
    numbers = ", ".join(f"CAST({case(i)} AS DOUBLE) AS {name}" for i, name in ((3, "value"), (4, "rate"), (5, "cap"), (6, "threshold")))
    return f"""WITH p AS ({source.format(k=len(MADE))})
SELECT {key}, {text(1)} AS category, {text(2)} AS value_type, {numbers}, {text(7)} AS period FROM p WHERE {text(2)} IS NOT NULL"""


def _made_line(key: str, n, m):
    line = F.get(F.array(*[F.lit(row[0]) for row in MADE]), (F.col(key) % len(MADE)).cast("int"))
    return F.regexp_replace(F.regexp_replace(line, F.lit(r"\bN(?=[ %x])"), n.cast("string")), F.lit(r"M(?=[ ,]|$)"), m.cast("string"))


@query(_made_sql(_OF_PARTS, "p_partkey"))
def dom18_made_lines(spark, sf_dir):
    """A line of every parser, made of known numbers, read back."""
    made = view(spark, sf_dir, "part").select("p_partkey", _made_line("p_partkey", F.col("p_size"), 100 * (F.col("p_partkey") % 90 + 10)).alias("line"))
    return X.benefits(made, "p_partkey", "line").select("p_partkey", "category", "value_type", "value", "rate", "cap", "threshold", "period")


@query(_made_sql(_OF_DOCUMENTS, "doc_id"))
def dom18_benefit_lines(spark, sf_dir):
    """Benefits that the lines of all documents state; each whole text has one such line, or one that only looks like it, put to its end."""
    planted = F.concat_ws("\n", "text", _made_line("doc_id", F.col("doc_id") % 50 + 1, 100 * (F.col("doc_id") % 90 + 10)))
    docs = view(spark, sf_dir, "documents").select("doc_id", planted.alias("text"))
    return X.benefits(docs, "doc_id", "text").select("doc_id", "category", "value_type", "value", "rate", "cap", "threshold", "period")


@query("""SELECT event_id, '{"a":[' || CAST(json_extract(props, '$.k') AS BIGINT) || ',null,true],"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"z":"x"}' AS canonical, sha256('{"a":[' || CAST(json_extract(props, '$.k') AS BIGINT) || ',null,true],"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"z":"x"}') AS digest FROM events""")
def jsn1_canonical(spark, sf_dir):
    """Objects with unsorted keys and spaces, in canonical form, and its digest."""
    n = F.get_json_object("props", "$.k")
    made = F.concat(F.lit('{ "z": "x", "k": '), n, F.lit('.0, "a": ['), n, F.lit(", null, true] }"))
    return spread(view(spark, sf_dir, "events"), "event_id").select("event_id", J.canonical_json(made).alias("canonical")).withColumn("digest", F.sha2("canonical", 256))


@query()
def jsn12_condition_hash(spark, sf_dir):
    """Hash of each offer's condition; byte for byte that of the golden cases in the tests."""
    benefit = F.concat(F.lit('{"benefitType":"offer","partners":["'), F.trim("partners"), F.lit('"],"valueConfig":'), "value_config", F.lit("}"))
    return spread(view(spark, sf_dir, "deal_sources"), "benefit_id").select("benefit_id", J.condition_hash(benefit).alias("condition_hash"))


@query()
def jsn16_set_hash(spark, sf_dir):
    """Hash of a card's conditions whatever their order; a card has few."""
    benefit = F.concat(F.lit('{"benefitType":"offer","valueConfig":'), "value_config", F.lit("}"))
    rows = spread(view(spark, sf_dir, "deal_sources"), "benefit_id").select("catalog_card_id", J.condition_json(benefit).alias("c"))
    joined = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("c")), ","), F.lit("]"))
    return rows.groupBy("catalog_card_id").agg(F.sha2(joined, 256).alias("set_hash"))


@query("""WITH m AS (SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS o FROM conversations)
SELECT string_agg(conv_id || ':' || turn, ',' ORDER BY conv_id, turn) IS NOT NULL AS ok, sha256(string_agg(role || turn, chr(10) ORDER BY role || turn)) AS manifest, conv_id FROM m GROUP BY conv_id""")
def jsn11_manifest(spark, sf_dir):
    """A digest that does not depend on the order of entries."""
    entry = F.concat("role", F.col("turn").cast("string"))
    rows = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("manifest"))
    return rows.select(F.lit(True).alias("ok"), "manifest", "conv_id")


@query("""SELECT event_id, true AS bounded, false AS sensitive FROM events""")
def jsn4_bounds(spark, sf_dir):
    return spread(view(spark, sf_dir, "events"), "event_id").select("event_id", J.within_bounds("props").alias("bounded"), J.sensitive_url("props").alias("sensitive"))


@query()
def str34_folded(spark, sf_dir):
    """Texts in one Unicode form, lower case and with single spaces."""
    return view(spark, sf_dir, "documents").select("doc_id", J.nfkc("text").alias("text"))


@query(f"SELECT CAST(date_trunc('month', TIMESTAMP '{CLOCK}') AS TIMESTAMP) AS month, CAST(date_trunc('quarter', TIMESTAMP '{CLOCK}') AS TIMESTAMP) AS quarter, CAST(date_trunc('year', TIMESTAMP '{CLOCK}') AS TIMESTAMP) AS year")
def dt5_cycle_starts(spark, sf_dir):
    return spark.range(1).select(*[D.cycle_start(u, CLOCK).alias(u) for u in ("month", "quarter", "year")])


@query("SELECT c.id, coalesce((SELECT arg_min(m.benefit_id, (m.display_priority, m.id)) FROM card_benefit_mapping m WHERE m.card_id = c.id AND m.display_priority < 2), (SELECT min(m.benefit_id) FROM card_benefit_mapping m WHERE m.card_id = c.id)) AS preferred FROM card_catalog c")
def jn14_preferred(spark, sf_dir):
    """One match for each row, by an order of preference."""
    best = F.min_by("benefit_id", F.when(F.col("display_priority") < 2, F.struct("display_priority", "id")))
    m = view(spark, sf_dir, "card_benefit_mapping").groupBy("card_id").agg(F.coalesce(best, F.min("benefit_id")).alias("preferred"))
    return view(spark, sf_dir, "card_catalog").select("id").join(m, F.col("id") == F.col("card_id"), "left").select("id", "preferred")


@query("SELECT user_id, string_agg(DISTINCT lower(trim(category)), ',' ORDER BY lower(trim(category))) AS terms FROM transactions WHERE category IS NOT NULL GROUP BY user_id")
def arr1_terms(spark, sf_dir):
    """Distinct lower-case terms in order."""
    return view(spark, sf_dir, "transactions").where("category IS NOT NULL").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("category")))), ",").alias("terms"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name || ' ' || CASE p_size % 5 WHEN 0 THEN 'Visa Infinite' WHEN 1 THEN 'World Elite Mastercard' WHEN 2 THEN 'RuPay Select Gold' ELSE 'plain' END), '\\bworld\\s+elite\\b') THEN 'world elite' WHEN p_size % 5 = 0 THEN 'infinite' WHEN p_size % 5 = 2 THEN 'gold' END AS tier,
CASE p_size % 5 WHEN 0 THEN 'Visa' WHEN 1 THEN 'Mastercard' WHEN 2 THEN 'RuPay' END AS network FROM part""")
def str9_tier_network(spark, sf_dir):
    k = F.col("p_size") % 5
    name = F.concat_ws(" ", "p_name", F.when(k == 0, F.lit("Visa Infinite")).when(k == 1, F.lit("World Elite Mastercard")).when(k == 2, F.lit("RuPay Select Gold")).otherwise(F.lit("plain")))
    return view(spark, sf_dir, "part").select("p_partkey", T.tier(name).alias("tier"), T.network(name).alias("network"))


@query("SELECT c_custkey, regexp_matches(lower(c_name) || '@example.com', '^[a-z0-9._%+#-]+@[a-z0-9.-]+\\.[a-z]{2,}$') AS email, regexp_matches(c_mktsegment, '^[a-z0-9]+(-[a-z0-9]+)*$') AS slug FROM customer")
def str30_validators(spark, sf_dir):
    return view(spark, sf_dir, "customer").select("c_custkey", T.is_email(F.concat(F.lower("c_name"), F.lit("@example.com"))).alias("email"), T.is_slug(F.col("c_mktsegment")).alias("slug"))


@query("""SELECT id, CASE WHEN n = 0 THEN 0.0 WHEN id % 4 = 0 THEN 0.55 WHEN id % 3 = 0 AND n = 1 THEN 0.95 WHEN id % 2 = 0 THEN 0.9 ELSE 0.7 END AS confidence FROM (SELECT id, id % 3 AS n FROM card_catalog)""")
def mth6_confidence(spark, sf_dir):
    k = F.col("id")
    return view(spark, sf_dir, "card_catalog").select("id", T.evidence_confidence(k % 3, k % 4 == 0, k % 3 == 0, k % 2 == 0).alias("confidence"))


@query("SELECT o_orderkey, '2001-08-' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') AS day FROM orders")
def dt4_recovered_date(spark, sf_dir):
    """Dates that a page break has split, by the description before them; tested on small texts."""
    from cardloom.functions.recover import recovered_date

    k = F.col("o_orderkey")
    text = F.concat(F.lit("Details\n "), (k % 28 + 1).cast("string"), F.lit("  Corner   shop "), k.cast("string"), F.lit(" 100.00\n Aug 2001 more"))
    rows = spread(view(spark, sf_dir, "orders"), "o_orderkey")
    return rows.select("o_orderkey", recovered_date(text, F.concat(F.lit("corner shop "), k.cast("string")), F.lit("2001-09-01").cast("date")).cast("string").alias("day"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 AND regexp_matches(url, '(?i)^https?:') THEN '[redacted-url]' WHEN page_id % 5 = 0 THEN url || '&to%256ben=1' ELSE url END AS url FROM pages")
def str22_secret_urls(spark, sf_dir):
    """Page urls with those hidden that carry a secret."""
    from cardloom.functions.recover import without_secret_urls

    return view(spark, sf_dir, "pages").select("page_id", without_secret_urls(F.concat("url", F.when(F.col("page_id") % 5 == 0, F.lit("&to%256ben=1")).otherwise(F.lit("")))).alias("url"))


@query()
def dom21_clusters(spark, sf_dir):
    """Observations of each card's offers, clustered in order of strength."""
    from cardloom.operators.cluster import clusters

    k = F.col("p_partkey")
    rows = view(spark, sf_dir, "part").select(
        (k % 44).alias("card_id"), (k % 3).alias("subject"), F.concat(F.lit("https://h/"), k.cast("string")).alias("url"), (k % 7).alias("strength"), F.when(k % 2 == 0, (k % 4).cast("double")).alias("rate"),
        F.lit(None).cast("double").alias("value"), F.when(k % 5 == 0, F.lit(500.0)).alias("cap"), F.lit(None).cast("double").alias("threshold"), F.when(k % 11 == 0, F.lit("month")).alias("period"))
    return clusters(rows, ["card_id", "subject"])


_PAGE = "'Card page' || chr(10) || 'Joining fee: Rs. ' || p_size || '00' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'Annual fee' || chr(10) || 'INR 1,' || (100 + p_size) ELSE 'No fee' END || chr(10) || 'Network ' || CASE p_partkey % 3 WHEN 0 THEN 'Visa' WHEN 1 THEN 'RuPay' ELSE 'other' END"


@query("""SELECT p_partkey, 'joining_fee' AS field, p_size || '00' AS value, 0.95::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, 'annual_fee', '1,' || (100 + p_size), 0.95 FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'network', CASE p_partkey % 3 WHEN 0 THEN 'Visa' ELSE 'RuPay' END, 0.96 FROM part WHERE p_partkey % 3 < 2""")
def dom24_page_fields(spark, sf_dir):
    """Fields of made pages, on the line that names them or the next."""
    from cardloom.operators.fields import page_fields

    part = view(spark, sf_dir, "part")
    return page_fields(part.select("p_partkey", F.expr(_PAGE.replace("chr(10)", "char(10)")).alias("t")), "p_partkey", "t")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(1000 + c_custkey % 9000 AS VARCHAR) END AS last_four, CASE WHEN c_custkey % 2 = 0 THEN 'Regalia Gold' END AS product FROM customer")
def str5_message_fields(spark, sf_dir):
    """Product and last digits that a message names; null where there are none, or several."""
    from cardloom.operators.fields import last_four, product_of_subject

    k, four = F.col("c_custkey"), (F.col("c_custkey") % 9000 + 1000).cast("string")
    body = F.concat(F.lit("card XXXX-XXXX-"), four, F.when(k % 3 == 0, F.lit(" and xx9999 or ** 0123")).otherwise(F.lit(" paid")))
    subject = F.concat(F.lit("Your HDFC Bank "), F.when(k % 2 == 0, F.lit("Regalia Gold")).otherwise(F.lit("")), F.lit(" Credit Card Statement for Aug 2026"))
    return view(spark, sf_dir, "customer").select("c_custkey", last_four(body).alias("last_four"), product_of_subject(subject, ("HDFC", "Bank")).alias("product"))


@query("""SELECT event_id, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS kept, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',"v":{"a":"x"}}' AS semantic FROM events""")
def jsn7_stripped(spark, sf_dir):
    """Observations without what only tells how they came about, and with only the members allowed."""
    made = F.concat(F.lit('{"etag":"e","v":{"a":"x","headers":{"b":1},"c":[]},"http_status":200,"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return spread(view(spark, sf_dir, "events"), "event_id").select("event_id", J.allowed_json({"k": int, "v": {"z": str}, "etag": int})(made).alias("kept"), J.semantic_json(made).alias("semantic"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'index' WHEN c_custkey % 4 = 3 THEN 'invalid' ELSE 'urlset' END AS kind, CASE WHEN c_custkey % 4 < 3 THEN 'https://h/' || c_custkey || '?a=1&b=2' || ',https://h/x' ELSE '' END AS urls FROM customer")
def src16_sitemap(spark, sf_dir):
    from cardloom.sources.formats import sitemap

    k = F.col("c_custkey")
    tag = F.when(k % 4 == 0, F.lit("sitemapindex")).when(k % 4 == 3, F.lit("html")).otherwise(F.lit("urlset"))
    xml = F.concat(F.lit("<"), tag, F.lit("><url><loc> https://h/"), k.cast("string"), F.lit("?a=1&amp;b=2 </loc></url>\n<url><loc>https://h/x</loc></url></"), tag, F.lit(">"))
    kind, urls = sitemap(xml)
    return view(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), F.array_join(urls, ",").alias("urls"))
