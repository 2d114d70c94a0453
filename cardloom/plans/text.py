"""Queries of names, categories, URLs, pages and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import dates as D
from cardloom.functions import money as M
from cardloom.functions import text as T
from cardloom.plans.register import SQL, query
from cardloom.sources.tables import CLOCK, view


def _chain(column: str, rules, default: str) -> str:
    """The SQL of first_rule."""
    def test(n):
        return "(" + " AND ".join(f"contains({column}, '{x}')" for x in (n if isinstance(n, tuple) else (n,))) + ")"

    return "CASE " + " ".join(f"WHEN {' OR '.join(map(test, needles))} THEN '{r}'" for needles, r in rules) + f" ELSE {default} END"


_TITLE = "list_aggregate(list_transform(string_split_regex({0}, '\\s+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), 'string_agg', ' ')"
_BANK = _chain("lower({0})", T.BANK_RULES, _TITLE)
_WORD = _chain("upper({0})", [((k,), c) for k, c in T.KEYWORDS], "NULL")
_NAME = "upper(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_MAPPED = "CASE {0} " + " ".join(f"WHEN '{m}' THEN '{c}'" for m, c in T.MERCHANTS.items()) + " END"
_CATS = ", ".join(f"'{c}'" for c in T.CATEGORIES)


def _txns(spark, sf_dir):
    return view(spark, sf_dir, "transactions")


@query(f"SELECT pos, {_NAME.format('merchant_name')} AS merchant FROM transactions")
def str1_merchant(spark, sf_dir):
    return _txns(spark, sf_dir).select("pos", T.merchant(F.col("merchant_name")).alias("merchant"))


@query(f"SELECT id, {_BANK.replace('{0}', 'bank')} AS bank FROM card_catalog")
def str2_bank_name(spark, sf_dir):
    return view(spark, sf_dir, "card_catalog").select("id", T.bank_name(F.col("bank")).alias("bank"))


@query("""SELECT id, array_to_string(list_filter(string_split_regex(regexp_replace(replace(lower(regexp_replace(bank || ' ' || card_name, '([a-z])([A-Z])', '\\1 \\2', 'g')), 'american express', 'amex'), '[^a-z0-9]+', ' ', 'g'), '\\s+'),
lambda t: t <> '' AND t NOT IN (""" + ", ".join(f"'{t}'" for t in T.IGNORED_TOKENS) + ")), ' ') AS tokens FROM card_catalog")
def str4_product_tokens(spark, sf_dir):
    return view(spark, sf_dir, "card_catalog").select("id", F.array_join(T.product_tokens(F.concat_ws(" ", "bank", "card_name")), " ").alias("tokens"))


@query(f"SELECT pos, {_WORD.format('description')} AS category FROM transactions")
def str11_keyword(spark, sf_dir):
    return _txns(spark, sf_dir).select("pos", T.keyword_category(F.col("description")).alias("category"))


@query("SELECT pos, CASE " + " ".join(f"WHEN regexp_matches(lower(description), '\\b({w})\\b') THEN '{n}'" for n, w in T.TYPE_RULES)
       + " WHEN replace(lower(trim(transaction_type)), ' ', '_') IN (" + ", ".join(f"'{t}'" for t in T.PARSER_TYPES) + ") THEN replace(lower(trim(transaction_type)), ' ', '_') ELSE 'debit' END AS type FROM transactions")
def str13_txn_type(spark, sf_dir):
    return _txns(spark, sf_dir).select("pos", T.transaction_type(F.col("transaction_type"), F.col("description")).alias("type"))


_URL = r"""WITH u AS (SELECT page_id, regexp_extract(trim(url), '^(?i)(https?)://([^/?#@\s:]+)(:[0-9]+)?(/[^?#\s]*)?(\?[^#\s]*)?(#.*)?$', ['s', 'h', 'p', 'path', 'q', 'f']) AS x,
  regexp_matches(trim(url), '^(?i)(https?)://([^/?#@\s:]+)(:[0-9]+)?(/[^?#\s]*)?(\?[^#\s]*)?(#.*)?$') AS ok FROM pages),
v AS (SELECT page_id, ok, lower(x.s) || '://' || regexp_replace(lower(x.h), '\.$', '') || CASE WHEN lower(x.s) = 'http' AND x.p = ':80' OR lower(x.s) = 'https' AND x.p = ':443' THEN '' ELSE x.p END AS head,
  '/' || array_to_string(list_filter(string_split(x.path, '/'), lambda p: p <> '' AND p <> '.'), '/') AS path,
  array_to_string(list_sort(list_filter(string_split(substr(x.q, 2), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_[a-z0-9_]*|gclid|fbclid|ref)$'))), '&') AS q FROM u)
SELECT page_id, CASE WHEN ok THEN head || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS url FROM v"""


@query(_URL)
def str14_canonical_url(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(trim(url), '^(?i)https://([^/?#@\s]+)([^?#\s]*)') THEN 'https://' || lower(regexp_extract(trim(url), '^(?i)https://([^/?#@\s]+)([^?#\s]*)', 1)) || regexp_extract(trim(url), '^(?i)https://([^/?#@\s]+)([^?#\s]*)', 2) END AS url FROM pages")
def str17_display_url(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", T.display_url(F.col("url")).alias("url"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/section)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n+', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text FROM c""")
def str19_page_text(spark, sf_dir):
    return view(spark, sf_dir, "pages").select("page_id", T.page_text(F.col("html")).alias("text"))


@query()
def str21_redacted(spark, sf_dir):
    """Digit runs hidden; the pattern looks behind, which the SQL engine's expressions cannot."""
    return view(spark, sf_dir, "documents").select("doc_id", T.without_digit_runs(F.col("text")).alias("text"))


@query()
def str23_private_data(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", T.has_private_data(F.col("text")).alias("private"))


@query("SELECT pos, sha256('card-benefit-v2:' || user_card_id || ':' || description) AS digest, 'card-benefit-v2:' || user_card_id || ':' || sha256(description) AS scoped_key FROM transactions")
def str27_digests(spark, sf_dir):
    key = F.concat_ws(":", F.lit("card-benefit-v2"), F.col("user_card_id").cast("string"), "description")
    return _txns(spark, sf_dir).select("pos", F.sha2(key, 256).alias("digest"), F.concat_ws(":", F.lit("card-benefit-v2"), F.col("user_card_id").cast("string"), F.sha2("description", 256)).alias("scoped_key"))


_MONEY = r"regexp_extract('Fee Rs. ' || CAST(floor(p_retailprice) AS INTEGER) || ',500 ' || CASE p_size % 3 WHEN 0 THEN 'lakh' WHEN 1 THEN 'crores' ELSE 'only' END, '(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(lakhs?|lacs?|crores?|cr\b)?', {0})"


@query(f"SELECT p_partkey, CAST(replace({_MONEY.format(1)}, ',', '') AS DOUBLE) * CASE WHEN {_MONEY.format(2)} LIKE 'la%' THEN 100000.0 WHEN {_MONEY.format(2)} LIKE 'cr%' THEN 10000000.0 ELSE 1.0 END AS amount FROM part")
def str31_rupees(spark, sf_dir):
    unit = F.when(F.col("p_size") % 3 == 0, F.lit("lakh")).when(F.col("p_size") % 3 == 1, F.lit("crores")).otherwise(F.lit("only"))
    text = F.concat(F.lit("Fee Rs. "), F.floor("p_retailprice").cast("int").cast("string"), F.lit(",500 "), unit)
    return view(spark, sf_dir, "part").select("p_partkey", M.rupees(text).alias("amount"))


_DOM1 = f"""WITH n AS (SELECT pos, {_NAME.format("coalesce(merchant_name, '')")} AS name, description, lower(trim(category)) AS given, category FROM transactions),
m AS (SELECT *, CASE WHEN name NOT IN ('AMAZON', 'PAYPAL') THEN {_MAPPED.format('name')} END AS mapped, CASE WHEN given IN ({_CATS}) THEN given END AS valid, {_WORD.format('description')} AS word FROM n)"""


@query(f"{_DOM1} SELECT pos, coalesce(mapped, valid, word, 'other') AS category, CASE WHEN mapped IS NOT NULL THEN 'merchant_map' WHEN valid IS NOT NULL THEN 'model' WHEN word IS NOT NULL THEN 'keyword' ELSE 'unresolved' END AS source FROM m")
def dom1_categorise(spark, sf_dir):
    """Category and the tier that gave it."""
    category, source = T.categorised(F.col("merchant_name"), F.col("description"), F.col("category"))
    return _txns(spark, sf_dir).select("pos", category.alias("category"), source.alias("source"))


@query(f"{_DOM1} SELECT coalesce(mapped, word, 'other') AS category, count(*) AS examined, count(*) FILTER (WHERE coalesce(mapped, word, 'other') <> 'other' AND coalesce(mapped, word, 'other') IS DISTINCT FROM category) AS recategorised FROM m WHERE category IS NULL OR category = 'other' OR category NOT IN ({_CATS}) GROUP BY 1")
def dom2_recategorise(spark, sf_dir):
    """Backfill: of the uncategorised rows, how many get which category."""
    from cardloom.operators import spend as S

    rows = S.uncategorized(_txns(spark, sf_dir), T.CATEGORIES)
    new, _ = T.categorised(F.col("merchant_name"), F.col("description"), F.lit(None).cast("string"))
    rows = rows.select(new.alias("new"), "category")
    return rows.groupBy(F.col("new").alias("category")).agg(F.count("*").alias("examined"), F.count_if((F.col("new") != "other") & ~F.col("new").eqNullSafe(F.col("category"))).alias("recategorised"))


@query("SELECT pos, coalesce(CASE WHEN pos % 5 = 0 THEN 'bank_statement' END, CASE WHEN pos % 3 = 0 THEN 'verified_provider' END, CASE WHEN pos % 2 = 0 THEN 'merchant_registry' END) AS source FROM transactions")
def dom3_mcc_source(spark, sf_dir):
    """The first source that has a merchant code."""
    have = lambda n, name: F.when(F.col("pos") % n == 0, F.lit(name))
    return _txns(spark, sf_dir).select("pos", F.coalesce(have(5, "bank_statement"), have(3, "verified_provider"), have(2, "merchant_registry")).alias("source"))


@query("""SELECT pos, CASE WHEN upper(trim(currency)) NOT IN ('', 'INR') THEN upper(trim(currency)) ELSE coalesce(CASE user_id % 3 WHEN 0 THEN 'AED' WHEN 1 THEN 'INR' END, 'INR') END AS currency FROM transactions""")
def dom4_currency(spark, sf_dir):
    bank = F.when(F.col("user_id") % 3 == 0, F.lit("FAB")).when(F.col("user_id") % 3 == 1, F.lit("HDFC Bank")).otherwise(F.lit("Unknown"))
    return _txns(spark, sf_dir).select("pos", M.transaction_currency(F.col("currency"), M.market_currency(bank)).alias("currency"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN '31-02-1999' ELSE ' soon' END AS raw, o_orderdate FROM orders),
p AS (SELECT o_orderkey, CASE WHEN regexp_matches(trim(raw), '^\\d{4}-') THEN CAST(try_strptime(trim(raw), '%Y-%m-%d') AS DATE) ELSE CAST(try_strptime(replace(trim(raw), '/', '-'), '%d-%m-%Y') AS DATE) END AS parsed, DATE '1998-06-30' AS st FROM r)
SELECT o_orderkey, CASE WHEN parsed IS NULL THEN '1998-06-30' WHEN parsed <= st THEN CAST(parsed AS VARCHAR) END AS day, CASE WHEN parsed IS NULL THEN 'statement_fallback' WHEN parsed <= st THEN 'parser' ELSE 'rejected_future' END AS source FROM p""")
def dt3_resolved_date(spark, sf_dir):
    """Dates in several forms, resolved against a statement date."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d/M/yyyy")).when(k == 2, F.date_format(d, "dd-MM-yyyy")).when(k == 3, F.lit("31-02-1999")).otherwise(F.lit(" soon"))
    day, source = D.resolved_date(D.parsed_date(raw), F.lit("1998-06-30").cast("date"), F.lit(None).cast("date"))
    return view(spark, sf_dir, "orders").select("o_orderkey", day.cast("string").alias("day"), source.alias("source"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS instant, CASE WHEN ts BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2024-01-15 00:05:00' THEN ts END AS bounded FROM events")
def dt8_instants(spark, sf_dir):
    return view(spark, sf_dir, "events").select("event_id", D.instant_text(F.col("ts")).alias("instant"), D.within(F.col("ts"), "2024-01-15 00:00:00").alias("bounded"))


_SUM = "list_sum(list_transform(string_split(CAST(c.id AS VARCHAR) || 'k', ''), lambda x: ascii(x)))"


@query(f"""SELECT c.id, TIMESTAMP '{CLOCK}' + to_days(CAST(CASE WHEN NOT is_discontinued THEN 30 + {_SUM} % 7 - 3 WHEN held THEN 7 + {_SUM} % 3 - 1 END AS INTEGER)) AS next_at
FROM card_catalog c LEFT JOIN (SELECT DISTINCT catalog_card_id, true AS held FROM user_cards WHERE is_active AND catalog_card_id % 2 = 0) h ON h.catalog_card_id = c.id""")
def dt9_next_observation(spark, sf_dir):
    held = view(spark, sf_dir, "user_cards").where("is_active AND catalog_card_id % 2 = 0").select(F.col("catalog_card_id").alias("id"), F.lit(True).alias("held")).distinct()
    rows = view(spark, sf_dir, "card_catalog").join(held, "id", "left")
    key = F.concat(F.col("id").cast("string"), F.lit("k"))
    return rows.select("id", D.next_observation(D.at(CLOCK), key, F.col("is_discontinued"), F.coalesce("held", F.lit(False))).alias("next_at"))


@query("SELECT time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2001-01-01') AS bucket, user_id, count(*) AS attempts, count(*) <= 5 AS allowed FROM events GROUP BY 1, 2")
def dt12_rate_buckets(spark, sf_dir):
    """Attempts of a user in 15 minutes, and whether they are within five."""
    return view(spark, sf_dir, "events").groupBy(D.quarter_hour(F.col("ts")).alias("bucket"), "user_id").agg(F.count("*").alias("attempts"), (F.count("*") <= 5).alias("allowed"))


@query("SELECT id, CASE WHEN attempt_count >= 3 THEN 'review' ELSE 'failed' END AS status, CASE WHEN attempt_count <= 1 THEN created_at + INTERVAL 15 MINUTE WHEN attempt_count = 2 THEN created_at + INTERVAL 60 MINUTE END AS next_try FROM jobs WHERE status = 'failed'")
def dt13_retry(spark, sf_dir):
    status, when = D.retry_after(F.col("attempt_count"), F.col("created_at"))
    return view(spark, sf_dir, "jobs").where("status = 'failed'").select("id", status.alias("status"), when.alias("next_try"))


@query(f"SELECT a.pos, a.category, a.source, b.type, c.currency FROM ({SQL.get('dom1_categorise')}) a JOIN ({SQL.get('str13_txn_type')}) b ON a.pos = b.pos JOIN ({SQL.get('dom4_currency')}) c ON a.pos = c.pos")
def dom6_normalise(spark, sf_dir):
    """Type, currency, category and its source of every imported row, in one pass."""
    category, source = T.categorised(F.col("merchant_name"), F.col("description"), F.col("category"))
    bank = F.when(F.col("user_id") % 3 == 0, F.lit("FAB")).when(F.col("user_id") % 3 == 1, F.lit("HDFC Bank")).otherwise(F.lit("Unknown"))
    kind, currency = T.transaction_type(F.col("transaction_type"), F.col("description")), M.transaction_currency(F.col("currency"), M.market_currency(bank))
    return _txns(spark, sf_dir).select("pos", category.alias("category"), source.alias("source"), kind.alias("type"), currency.alias("currency"))
