"""Queries of cards, statements, payments, joins and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import text as T
from cardloom.operators import cards as C
from cardloom.operators import spend as S
from cardloom.plans.register import query
from cardloom.plans.text import _BANK
from cardloom.sources.tables import view

AS_OF = "2001-08-15"
_ACTIVE = f"is_active AND retired_at IS NULL AND coalesce(valid_from <= DATE '{AS_OF}', true) AND coalesce(valid_until >= DATE '{AS_OF}', true)"


@query("SELECT id, user_id, CAST(statement_date AS VARCHAR) AS statement_date, CAST(total_amount AS DOUBLE) AS total FROM statements WHERE user_id = 7 ORDER BY statement_date DESC, id LIMIT 20")
def src5_user_statements(spark, sf_dir):
    rows = view(spark, sf_dir, "statements").where("user_id = 7")
    return S.page(rows.select("id", "user_id", F.col("statement_date").cast("string").alias("statement_date"), F.col("total_amount").cast("double").alias("total")), [F.desc("statement_date"), "id"], 20)


@query("SELECT u.id, u.user_id, c.card_name, c.network FROM user_cards u LEFT JOIN card_catalog c ON c.id = u.catalog_card_id WHERE u.is_active")
def src6_cards_with_catalog(spark, sf_dir):
    catalog = view(spark, sf_dir, "card_catalog").select(F.col("id").alias("catalog_card_id"), "card_name", "network")
    return view(spark, sf_dir, "user_cards").where("is_active").join(catalog, "catalog_card_id", "left").select("id", "user_id", "card_name", "network")


@query("SELECT id, title FROM benefits WHERE regexp_matches(lower(title), 'ring|bolt|movie|cinema') OR category = 'ECONOMY'")
def src8_related_benefits(spark, sf_dir):
    return view(spark, sf_dir, "benefits").where(F.lower("title").rlike("ring|bolt|movie|cinema") | (F.col("category") == "ECONOMY")).select("id", "title")


@query("SELECT event_id, user_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7")
def src10_json_containment(spark, sf_dir):
    props = F.try_parse_json(F.col("props"))
    return view(spark, sf_dir, "events").where(F.try_variant_get(props, "$.k", "bigint") == 7).select("event_id", "user_id")


@query("SELECT * FROM (VALUES ('HDFC Bank', 1), ('ICICI Bank', 2), ('HSBC', 3)) AS t(issuer, place)")
def src18_values(spark, sf_dir):
    return spark.createDataFrame([("HDFC Bank", 1), ("ICICI Bank", 2), ("HSBC", 3)], "issuer string, place int")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src19_json_rows(spark, sf_dir):
    """A JSON array of objects as rows."""
    made = F.concat(F.lit("["), "props", F.lit("]"))
    return view(spark, sf_dir, "events").select("event_id", F.inline(F.from_json(made, "array<struct<k:bigint>>")))


@query("SELECT id, card_name FROM card_catalog WHERE NOT is_discontinued AND (contains(lower(card_name), 're') OR contains(lower(bank), 're')) ORDER BY card_name, id LIMIT 20")
def flt11_catalog_search(spark, sf_dir):
    rows = view(spark, sf_dir, "card_catalog").where(~F.col("is_discontinued") & (F.contains(F.lower("card_name"), F.lit("re")) | F.contains(F.lower("bank"), F.lit("re"))))
    return S.page(rows.select("id", "card_name"), ["card_name", "id"], 20)


@query(f"SELECT m.id, m.card_id, b.title FROM card_benefit_mapping m JOIN benefits b ON b.id = m.benefit_id WHERE {_ACTIVE}")
def flt7_active_benefits(spark, sf_dir):
    """Mappings of benefits that are active on a day."""
    active = C.active_benefits(view(spark, sf_dir, "benefits"), AS_OF).select(F.col("id").alias("benefit_id"), "title")
    return view(spark, sf_dir, "card_benefit_mapping").join(active, "benefit_id").select("id", "card_id", "title")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_card_id ORDER BY statement_date DESC, id DESC) AS n FROM statements)
SELECT id, user_card_id, CAST(greatest(total_amount - paid_amount, 0) AS DOUBLE) AS outstanding FROM l WHERE n = 1 AND payment_status <> 'paid' AND greatest(total_amount - paid_amount, 0) > 0""")
def flt10_due_bills(spark, sf_dir):
    return C.due_bills(view(spark, sf_dir, "statements")).select("id", "user_card_id", F.col("outstanding").cast("double").alias("outstanding"))


@query("SELECT user_card_id, id, CAST(total_amount AS DOUBLE) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_card_id ORDER BY statement_date DESC, id DESC) AS n FROM statements) WHERE n = 1")
def agg9_latest_statement(spark, sf_dir):
    return C.latest_by(view(spark, sf_dir, "statements"), "user_card_id", "statement_date", "id").select("user_card_id", "id", F.col("total_amount").cast("double").alias("total"))


@query("SELECT benefit_id, platform_key, count(DISTINCT user_id) AS confirmations FROM confirmations GROUP BY benefit_id, platform_key")
def agg15_distinct_confirm(spark, sf_dir):
    return view(spark, sf_dir, "confirmations").groupBy("benefit_id", "platform_key").agg(F.count_distinct("user_id").alias("confirmations"))


@query("WITH p AS (SELECT benefit_id, platform_key, count(DISTINCT user_id) AS n FROM confirmations GROUP BY benefit_id, platform_key) SELECT benefit_id, CAST(sum(n) AS BIGINT) AS confirmations, string_agg(platform_key, ',' ORDER BY platform_key) AS platforms FROM p GROUP BY benefit_id")
def agg16_confirmations(spark, sf_dir):
    """Sum over platforms: who confirms on two counts twice."""
    per = agg15_distinct_confirm(spark, sf_dir)
    return per.groupBy("benefit_id").agg(F.sum("confirmations").alias("confirmations"), F.array_join(F.array_sort(F.collect_set("platform_key")), ",").alias("platforms"))


@query("SELECT user_id, CASE WHEN bool_and(ticket_count IS NOT NULL) THEN 'verified' ELSE 'unverified' END AS confidence, CASE WHEN bool_and(ticket_count IS NOT NULL) THEN CAST(sum(ticket_count) AS BIGINT) ELSE 0 END AS tickets, CASE WHEN bool_and(ticket_count IS NOT NULL) THEN count(*) ELSE 0 END AS used FROM transactions WHERE category = 'entertainment' GROUP BY user_id")
def agg17_usage(spark, sf_dir):
    """Usage counts as verified only if every matching row has its number of tickets."""
    known = F.bool_and(F.col("ticket_count").isNotNull())
    rows = view(spark, sf_dir, "transactions").where("category = 'entertainment'").groupBy("user_id")
    return rows.agg(F.when(known, F.lit("verified")).otherwise(F.lit("unverified")).alias("confidence"), F.when(known, F.sum("ticket_count")).otherwise(F.lit(0)).alias("tickets"), F.when(known, F.count("*")).otherwise(F.lit(0)).alias("used"))


@query("""WITH m AS (SELECT id FROM benefits WHERE is_active AND category = 'SMALL'), h AS (SELECT DISTINCT benefit_id FROM card_benefit_mapping)
SELECT 'active' AS metric, count(*) AS n FROM m UNION ALL SELECT 'mapped', count(*) FROM m WHERE id IN (SELECT benefit_id FROM h) UNION ALL SELECT 'unmapped', count(*) FROM m WHERE id NOT IN (SELECT benefit_id FROM h)""")
def agg18_mapping_health(spark, sf_dir):
    mapped = view(spark, sf_dir, "card_benefit_mapping").select(F.col("benefit_id").alias("id"), F.lit(1).alias("m")).distinct()
    rows = view(spark, sf_dir, "benefits").where("is_active AND category = 'SMALL'").join(mapped, "id", "left").agg(F.count("*").alias("active"), F.count("m").alias("mapped"))
    return rows.select(F.expr("stack(3, 'active', active, 'mapped', mapped, 'unmapped', active - mapped) AS (metric, n)"))


@query("SELECT m.id FROM card_benefit_mapping m LEFT JOIN card_catalog c ON c.id = m.card_id LEFT JOIN benefits b ON b.id = m.benefit_id WHERE c.id IS NULL OR b.id IS NULL")
def jn5_orphans(spark, sf_dir):
    m = view(spark, sf_dir, "card_benefit_mapping")
    cards = view(spark, sf_dir, "card_catalog").select(F.col("id").alias("card_id"), F.lit(True).alias("has_card"))
    benefits = view(spark, sf_dir, "benefits").select(F.col("id").alias("benefit_id"), F.lit(True).alias("has_benefit"))
    return m.join(cards, "card_id", "left").join(benefits, "benefit_id", "left").where("has_card IS NULL OR has_benefit IS NULL").select("id")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def jn6_anti(spark, sf_dir):
    """Customers without an urgent order that is done."""
    urgent = view(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return view(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")


@query("SELECT id FROM card_catalog c WHERE NOT is_discontinued OR EXISTS (SELECT 1 FROM user_cards u WHERE u.catalog_card_id = c.id AND u.is_active)")
def jn7_semi(spark, sf_dir):
    held = view(spark, sf_dir, "user_cards").where("is_active").select(F.col("catalog_card_id").alias("id"), F.lit(True).alias("held")).distinct()
    return view(spark, sf_dir, "card_catalog").join(held, "id", "left").where("NOT is_discontinued OR held").select("id")


@query("""WITH s(issuer) AS (VALUES ('hdfc bank ltd'), ('ICICI'), ('Emirates NBD'), ('No such bank'))
SELECT issuer, count(DISTINCT c.id) AS cards, count(DISTINCT m.card_id) AS mapped_cards, count(m.id) AS mappings FROM s LEFT JOIN card_catalog c ON lower(trim(c.bank)) = lower(s.issuer) LEFT JOIN card_benefit_mapping m ON m.card_id = c.id GROUP BY issuer""")
def jn8_coverage(spark, sf_dir):
    issuers = spark.createDataFrame([(x,) for x in ("hdfc bank ltd", "ICICI", "Emirates NBD", "No such bank")], "issuer string")
    cards = view(spark, sf_dir, "card_catalog").select(F.col("id").alias("cid"), F.lower(F.trim("bank")).alias("key"))
    joined = issuers.join(cards, F.lower("issuer") == F.col("key"), "left").join(view(spark, sf_dir, "card_benefit_mapping"), F.col("card_id") == F.col("cid"), "left")
    return joined.groupBy("issuer").agg(F.count_distinct("cid").alias("cards"), F.count_distinct("card_id").alias("mapped_cards"), F.count("id").alias("mappings"))


@query("SELECT user_card_id, id, CAST(statement_date AS VARCHAR) AS statement_date FROM (SELECT *, row_number() OVER (PARTITION BY user_card_id ORDER BY statement_date DESC, total_amount DESC, id DESC) AS n FROM statements WHERE statement_date <= DATE '1999-06-30') WHERE n = 1")
def jn9_asof_cycle(spark, sf_dir):
    """The latest statement cycle that had ended by a day; equal ends go to the larger total."""
    done = view(spark, sf_dir, "statements").where(F.col("statement_date") <= F.lit("1999-06-30").cast("date"))
    return C.latest_by(done, "user_card_id", "statement_date", "total_amount", "id").select("user_card_id", "id", F.col("statement_date").cast("string").alias("statement_date"))


@query("""WITH r(benefit_id, merchant, since) AS (VALUES (1, 'bookmyshow', TIMESTAMP '1999-01-01'), (2, 'pvr', TIMESTAMP '2000-01-01'), (3, 'swiggy', TIMESTAMP '1998-06-01'))
SELECT user_card_id, benefit_id, count(*) AS used, CAST(sum(amount) AS DOUBLE) AS amount FROM transactions t JOIN r ON lower(trim(t.merchant_name)) = r.merchant AND t.transaction_date BETWEEN r.since AND TIMESTAMP '2001-06-30' GROUP BY user_card_id, benefit_id""")
def jn10_range_usage(spark, sf_dir):
    """Transactions in each rule's cycle; the rules are a short list given by the caller."""
    rules = spark.createDataFrame([(1, "bookmyshow", "1999-01-01"), (2, "pvr", "2000-01-01"), (3, "swiggy", "1998-06-01")], "benefit_id int, merchant string, since string")
    t = view(spark, sf_dir, "transactions").withColumn("merchant", S.merchant_value())
    joined = t.join(F.broadcast(rules), "merchant").where(F.col("transaction_date").between(F.col("since").cast("timestamp_ntz"), F.lit("2001-06-30").cast("timestamp_ntz")))
    return joined.groupBy("user_card_id", "benefit_id").agg(F.count("*").alias("used"), S.total("amount").alias("amount"))


@query("""SELECT j.id, p.page_id FROM jobs j JOIN pages p ON p.page_id = j.card_id UNION SELECT j.id, p.page_id FROM jobs j JOIN pages p ON p.page_id = j.staging_id UNION SELECT j.id, p.page_id FROM jobs j JOIN pages p ON p.page_id = j.id""")
def jn13_any_key(spark, sf_dir):
    """Rows that meet by any of three keys, as a union of joins on one key each."""
    jobs, pages = view(spark, sf_dir, "jobs"), view(spark, sf_dir, "pages").select("page_id")
    parts = [jobs.select("id", F.col(k).alias("page_id")).join(pages, "page_id").select("id", "page_id") for k in ("card_id", "staging_id", "id")]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("""WITH c AS (SELECT page_id % 97 AS claim, page_id % 11 AS card_id FROM pages UNION ALL SELECT doc_id % 97, doc_id % 3 FROM documents)
SELECT claim, string_agg(DISTINCT CAST(card_id AS VARCHAR), ',' ORDER BY CAST(card_id AS VARCHAR)) AS cards FROM c GROUP BY claim HAVING count(DISTINCT card_id) > 1""")
def jn16_claim_conflicts(spark, sf_dir):
    a = view(spark, sf_dir, "pages").select((F.col("page_id") % 97).alias("claim"), (F.col("page_id") % 11).alias("card_id"))
    b = view(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("claim"), (F.col("doc_id") % 3).alias("card_id"))
    grouped = a.union(b).groupBy("claim").agg(F.collect_set(F.col("card_id").cast("string")).alias("c"))
    return grouped.where(F.size("c") > 1).select("claim", F.array_join(F.array_sort("c"), ",").alias("cards"))


@query("SELECT page_id, CASE WHEN regexp_extract(lower(url), '://([^/?#:]+)', 1) = 'example.com' OR ends_with(regexp_extract(lower(url), '://([^/?#:]+)', 1), '.example.com') THEN 'example' WHEN ends_with(regexp_extract(lower(url), '://([^/?#:]+)', 1), '.net') THEN 'net' END AS issuer FROM pages")
def jn18_domain_match(spark, sf_dir):
    """Host equal to a listed domain or under it."""
    host = F.regexp_extract(F.lower("url"), "://([^/?#:]+)", 1)
    issuer = F.when((host == "example.com") | F.endswith(host, F.lit(".example.com")), F.lit("example")).when(F.endswith(host, F.lit(".net")), F.lit("net"))
    return view(spark, sf_dir, "pages").select("page_id", issuer.alias("issuer"))


@query("""WITH c AS (SELECT id AS source_id, user_card_id, statement_date AS source_date, CAST(900000.25 AS DECIMAL(12,2)) AS credit FROM statements WHERE id % 4 = 1),
o AS (SELECT c.source_id, s.id, s.statement_date, s.due_date, total_amount, paid_amount, total_amount - paid_amount AS due, credit FROM statements s JOIN c ON c.user_card_id = s.user_card_id AND s.statement_date < c.source_date AND s.id <> c.source_id
  WHERE payment_status IN ('pending', 'partial', 'overdue') AND total_amount > paid_amount),
r AS (SELECT *, coalesce(sum(due) OVER (PARTITION BY source_id ORDER BY statement_date, due_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
p AS (SELECT *, greatest(least(due, credit - before), 0) AS payment FROM r)
SELECT source_id, id, CAST(payment AS DOUBLE) AS payment, CASE WHEN paid_amount + payment >= total_amount THEN 'paid' ELSE 'partial' END AS status FROM p WHERE payment > 0""")
def win7_fifo_allocation(spark, sf_dir):
    st = view(spark, sf_dir, "statements")
    credits = st.where("id % 4 = 1").select(F.col("id").alias("source_id"), "user_card_id", F.col("statement_date").alias("source_date"), F.lit("900000.25").cast("decimal(12,2)").alias("credit"))
    return C.allocate_payments(st, credits)


@query("""SELECT id, 150.25 > 0 AND 150.25 <= total_amount - paid_amount AS accepted, CAST(CASE WHEN 150.25 <= total_amount - paid_amount THEN paid_amount + 150.25 ELSE paid_amount END AS DOUBLE) AS paid,
CASE WHEN NOT 150.25 <= total_amount - paid_amount THEN payment_status WHEN paid_amount + 150.25 >= total_amount THEN 'paid' ELSE 'partial' END AS status FROM statements""")
def dom39_apply_payment(spark, sf_dir):
    ok, paid, status = C.applied_payment(F.lit("150.25").cast("decimal(12,2)"))
    return view(spark, sf_dir, "statements").select("id", ok.alias("accepted"), paid.cast("double").alias("paid"), status.alias("status"))


@query("WITH c AS (SELECT user_card_id, max(statement_date) AS closed FROM statements WHERE statement_date < DATE '2001-05-01' GROUP BY user_card_id) SELECT t.pos FROM transactions t JOIN c ON c.user_card_id = t.user_card_id WHERE t.statement_id IS NULL AND t.transaction_date > CAST(c.closed AS TIMESTAMP)")
def srt1_unbilled(spark, sf_dir):
    st = view(spark, sf_dir, "statements").where(F.col("statement_date") < F.lit("2001-05-01").cast("date"))
    return C.unbilled(view(spark, sf_dir, "transactions"), st).select("pos")


@query("""WITH t AS (SELECT o_custkey, o_orderdate, o_totalprice, o_orderkey FROM orders WHERE o_orderkey % 2 = 0), i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1)
SELECT o_custkey, o_orderdate, o_totalprice, o_orderkey FROM i WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_custkey = i.o_custkey AND t.o_orderdate = i.o_orderdate)""")
def snk1_insert_new(spark, sf_dir):
    """Rows to append so that a natural key is never there twice."""
    rows = view(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    return C.insert_new(rows.where("o_orderkey % 2 = 0"), rows, ["o_custkey", "o_orderdate"])


@query("""SELECT id, user_id, CASE WHEN id % 3 = 0 THEN 'paid' ELSE payment_status END AS payment_status FROM statements""")
def snk2_upsert(spark, sf_dir):
    st = view(spark, sf_dir, "statements").select("id", "user_id", "payment_status")
    return C.upsert(st, st.where("id % 3 = 0").withColumn("payment_status", F.lit("paid")), ["id"])


@query("""WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS value FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT CASE WHEN c_custkey % 10 <> 9 THEN c_custkey END AS k, c_acctbal AS value FROM customer)
SELECT CASE WHEN i.k IS NULL THEN 'failed' WHEN e.k IS NULL THEN 'new' WHEN e.value IS NULL AND i.value IS NOT NULL THEN 'repaired' ELSE 'skipped' END AS outcome, count(*) AS n FROM i LEFT JOIN e ON e.k = i.k GROUP BY 1""")
def snk4_outcomes(spark, sf_dir):
    c = view(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("value"))
    new = c.select(F.when(F.col("c_custkey") % 10 != 9, F.col("c_custkey")).alias("k"), F.col("c_acctbal").alias("value"))
    return C.write_outcomes(old, new, "k")


@query("SELECT id, CASE WHEN last_four_digits IS NULL OR last_four_digits = '1234' THEN '9999' ELSE last_four_digits END AS last_four, CAST(coalesce(credit_limit, 5000) AS DOUBLE) AS credit_limit FROM user_cards")
def snk6_backfill(spark, sf_dir):
    four = F.col("last_four_digits")
    return view(spark, sf_dir, "user_cards").select("id", F.when(four.isNull() | (four == "1234"), F.lit("9999")).otherwise(four).alias("last_four"), F.coalesce(F.col("credit_limit").cast("double"), F.lit(5000.0)).alias("credit_limit"))


_IDENT = f"""WITH tok AS (SELECT id, {_BANK.replace('{0}', 'bank')} AS issuer, list_filter(string_split_regex(regexp_replace(lower(card_name), '[^a-z0-9]+', ' ', 'g'), '\\s+'), lambda t: t <> '' AND NOT list_contains({list(T.IGNORED_TOKENS)}, t)) AS toks FROM card_catalog),
e AS (SELECT p_partkey AS ev, {_BANK.replace('{0}', "CASE p_partkey % 3 WHEN 0 THEN 'HDFC' WHEN 1 THEN 'icici bank' ELSE 'axis' END")} AS issuer,
  list_filter(string_split_regex(regexp_replace(lower(p_name || ' ' || p_type || ' credit card'), '[^a-z0-9]+', ' ', 'g'), '\\s+'), lambda t: t <> '' AND NOT list_contains({list(T.IGNORED_TOKENS)}, t)) AS toks FROM part),
m AS (SELECT ev, id, CASE WHEN array_to_string(e.toks, '') = array_to_string(tok.toks, '') THEN 500 WHEN len(tok.toks) > 0 AND list_has_all(e.toks, tok.toks) THEN 300 + 10 * len(tok.toks) ELSE 0 END AS score, len(tok.toks) * 100 + length(array_to_string(tok.toks, '')) AS spec FROM e JOIN tok USING (issuer)),
b AS (SELECT *, rank() OVER (PARTITION BY ev ORDER BY score DESC, spec DESC) AS r FROM m WHERE score > 0)
SELECT ev, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM b WHERE r = 1 GROUP BY ev"""


@query(_IDENT)
def dom14_entity_match(spark, sf_dir):
    """The one product of the issuer that a text names most specifically; null if several are."""
    catalog = view(spark, sf_dir, "card_catalog").select("id", T.bank_name(F.col("bank")).alias("issuer"), T.product_tokens(F.col("card_name")).alias("label"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.lit("HDFC")).when(F.col("p_partkey") % 3 == 1, F.lit("icici bank")).otherwise(F.lit("axis"))
    evidence = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("ev"), T.bank_name(raw).alias("issuer"), T.product_tokens(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type"), F.lit("credit card"))).alias("signal"))
    from cardloom.operators.identity import match_products

    return match_products(evidence, catalog)
