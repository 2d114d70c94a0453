"""Queries of spend analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import money as M
from cardloom.functions import text as T
from cardloom.operators import spend as S
from cardloom.plans.register import query
from cardloom.sources.tables import CLOCK, view

_ELIGIBLE = "CASE WHEN transaction_type IN ('debit', 'credit', 'refund', 'fee', 'reward') THEN transaction_type ELSE 'debit' END = 'debit' AND normalized_type IS DISTINCT FROM 'cash_withdrawal'"
_BOUGHT = f"""bought AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, user_card_id, transaction_date, description, amount ORDER BY pos) AS n
  FROM transactions WHERE {_ELIGIBLE} AND amount > 0) WHERE n = 1)"""
_REWARD = "CASE WHEN reward_earned > 0 THEN reward_earned ELSE 0 END"


def _txns(spark, sf_dir):
    return view(spark, sf_dir, "transactions")


@query("SELECT pos, user_id, transaction_date, CAST(amount AS DOUBLE) AS amount FROM transactions WHERE category = 'food' AND transaction_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31' ORDER BY transaction_date DESC, pos LIMIT 50 OFFSET 20")
def src1_filtered_page(spark, sf_dir):
    """A page of the ledger in a closed period and a category, newest first."""
    rows = _txns(spark, sf_dir).where((F.col("category") == "food") & S.between(F.col("transaction_date"), "1997-01-01", "1998-12-31"))
    return S.page(rows.select("pos", "user_id", "transaction_date", F.col("amount").cast("double").alias("amount")), [F.desc("transaction_date"), "pos"], 50, 20)


@query("SELECT pos, user_id, transaction_date FROM transactions ORDER BY transaction_date DESC, pos LIMIT 12")
def src2_recent(spark, sf_dir):
    return S.page(_txns(spark, sf_dir).select("pos", "user_id", "transaction_date"), [F.desc("transaction_date"), "pos"], 12)


@query("SELECT pos, category FROM transactions WHERE category IS NULL OR category = 'other' OR category NOT IN ('food','fuel','grocery','entertainment','travel','shopping','utilities','insurance','medical','education','investment','transport','rental','subscription','gift','other')")
def src7_uncategorized(spark, sf_dir):
    return S.uncategorized(_txns(spark, sf_dir), T.CATEGORIES).select("pos", "category")


@query(f"WITH {_BOUGHT} SELECT user_id, CAST(sum(amount) AS DOUBLE) AS total_spend, CAST(sum({_REWARD}) AS DOUBLE) AS total_rewards, count(*) AS purchases FROM bought GROUP BY user_id")
def agg1_retail_totals(spark, sf_dir):
    return S.retail_totals(S.purchases(_txns(spark, sf_dir), keep=("reward_earned",)))


@query(f"WITH {_BOUGHT} SELECT user_id, coalesce(category, 'Other') AS category, CAST(sum(amount) AS DOUBLE) AS amount FROM bought GROUP BY ALL")
def agg1_category_totals(spark, sf_dir):
    return S.category_totals(S.purchases(_txns(spark, sf_dir), keep=("category",)))


@query(f"WITH {_BOUGHT} SELECT user_id, CAST(CAST(transaction_date + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS day, CAST(sum(amount) AS DOUBLE) AS amount FROM bought GROUP BY ALL")
def agg1_local_days(spark, sf_dir):
    """Day totals in a zone at +05:30."""
    return S.purchases(_txns(spark, sf_dir), keep=()).groupBy("user_id", S.local_date("+05:30").cast("string").alias("day")).agg(S.total("amount").alias("amount"))


@query(f"""WITH {_BOUGHT},
s AS (SELECT user_id, 5 - ((2001 * 12 + 8) - (year(transaction_date) * 12 + month(transaction_date))) AS month_index, amount, {_REWARD} AS reward FROM bought),
u AS (SELECT DISTINCT user_id FROM bought), i AS (SELECT CAST(i AS INTEGER) AS month_index FROM range(6) AS t(i)),
g AS (SELECT user_id, month_index, CAST(sum(amount) AS DOUBLE) AS spend, CAST(sum(reward) AS DOUBLE) AS rewards FROM s GROUP BY ALL)
SELECT u.user_id, i.month_index, coalesce(spend, 0) AS spend, coalesce(rewards, 0) AS rewards FROM u CROSS JOIN i LEFT JOIN g ON g.user_id = u.user_id AND g.month_index = i.month_index""")
def agg5_month_trend(spark, sf_dir):
    """Six-month spend and rewards of every user, with zeros."""
    return S.month_trend(S.purchases(_txns(spark, sf_dir), keep=("reward_earned",)), CLOCK)


@query(f"""WITH e AS (SELECT *, lower(trim(coalesce(merchant_name, ''))) AS m, trim(merchant_name) AS lab FROM transactions WHERE {_ELIGIBLE} AND transaction_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'),
l AS (SELECT *, CASE WHEN m = '' THEN 'Unknown merchant' ELSE lab END AS label FROM e),
k AS (SELECT user_id, 'category' AS kind, coalesce(category, 'other') AS key, upper(substr(coalesce(category, 'other'), 1, 1)) || substr(coalesce(category, 'other'), 2) AS label, amount, pos FROM l
  UNION ALL SELECT user_id, 'merchant', m, label, amount, pos FROM l
  UNION ALL SELECT user_id, 'movie', m, label, amount, pos FROM l WHERE category = 'entertainment' AND (platform IS NOT NULL OR merchant_subtype = 'movie_platform')
  UNION ALL SELECT user_id, 'travel', m, label, amount, pos FROM l WHERE category = 'travel'
  UNION ALL SELECT user_id, 'ecommerce', m, label, amount, pos FROM l WHERE channel = 'online'
  UNION ALL SELECT user_id, 'foodGrocery', m, label, amount, pos FROM l WHERE category IN ('food', 'grocery')
  UNION ALL SELECT user_id, 'fuel', m, label, amount, pos FROM l WHERE category = 'fuel'),
g AS (SELECT user_id, kind, key, sum(amount) AS amount, count(*) AS n, arg_min(label, pos) AS label FROM k WHERE key <> '' GROUP BY user_id, kind, key),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY amount DESC, n DESC, key) AS rk FROM g),
t AS (SELECT user_id, sum(amount) AS total, coalesce(sum(amount) FILTER (WHERE category IS NULL OR category = 'other' OR m = ''), 0) AS open FROM e GROUP BY user_id)
SELECT r.user_id, kind, key, label, CAST(amount AS DOUBLE) AS amount, n AS transactions, CAST(total AS DOUBLE) AS total_eligible, CAST(open AS DOUBLE) AS unresolved,
  CASE WHEN total = 0 THEN 0 ELSE round(CAST(amount AS DOUBLE) / CAST(total AS DOUBLE), 6) END AS share, CASE WHEN total = 0 THEN 0 ELSE round(CAST(open AS DOUBLE) / CAST(total AS DOUBLE), 6) END AS unresolved_share
FROM r JOIN t ON r.user_id = t.user_id WHERE rk = 1""")
def agg3_insights(spark, sf_dir):
    """Leading groups of the seven kinds for each user."""
    return S.spend_insights(_txns(spark, sf_dir), "1996-01-01", "2000-12-31")


@query("SELECT user_id, CAST(sum(credit_limit) AS DOUBLE) AS limits FROM (SELECT DISTINCT id, user_id, credit_limit FROM user_cards WHERE is_active AND credit_limit > 0) GROUP BY user_id")
def agg6_reported_limits(spark, sf_dir):
    cards = view(spark, sf_dir, "user_cards")
    return cards.where(F.col("is_active") & S.sound_amount(F.col("credit_limit"))).dropDuplicates(["id"]).groupBy("user_id").agg(S.total("credit_limit").alias("limits"))


@query(f"""WITH {_BOUGHT},
d AS (SELECT user_id, CAST(transaction_date AS DATE) AS day, sum(amount) AS amount FROM bought WHERE transaction_date >= DATE '1997-01-01' AND transaction_date < DATE '1999-01-01' GROUP BY ALL),
n AS (SELECT *, day >= DATE '1998-01-01' AS now FROM d)
SELECT user_id, CAST(sum(amount) FILTER (WHERE now) AS DOUBLE) AS total, count(*) FILTER (WHERE now) AS days, round(CAST(sum(amount) FILTER (WHERE now) AS DOUBLE) / count(*) FILTER (WHERE now), 4) AS daily_average,
  CAST(arg_min(day, (-amount, day)) FILTER (WHERE now) AS VARCHAR) AS peak_day, CAST(max(amount) FILTER (WHERE now) AS DOUBLE) AS peak_amount,
  CASE WHEN sum(amount) FILTER (WHERE NOT now) > 0 THEN round((CAST(sum(amount) FILTER (WHERE now) AS DOUBLE) - CAST(sum(amount) FILTER (WHERE NOT now) AS DOUBLE)) / CAST(sum(amount) FILTER (WHERE NOT now) AS DOUBLE) * 100, 4) END AS change_percent
FROM n GROUP BY user_id HAVING count(*) FILTER (WHERE now) > 0""")
def agg7_spend_trend(spark, sf_dir):
    return S.spend_trend(S.purchases(_txns(spark, sf_dir), keep=()), "1998-01-01", "1998-12-31").withColumn("peak_day", F.col("peak_day").cast("string"))


@query("SELECT strftime(transaction_date, '%Y-%m') AS month, coalesce(category, 'Other') AS category, CAST(sum(amount) AS DOUBLE) AS amount FROM transactions WHERE CASE WHEN transaction_type IN ('debit', 'credit', 'refund', 'fee', 'reward') THEN transaction_type ELSE 'debit' END = 'debit' GROUP BY ALL")
def agg8_monthly_categories(spark, sf_dir):
    return S.monthly_category_spend(_txns(spark, sf_dir))


@query(f"""WITH {_BOUGHT}, g AS (SELECT user_id, coalesce(category, 'Other') AS category, sum(amount) AS amount, min(pos) AS seen FROM bought GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, seen DESC) AS n FROM g) SELECT user_id, category, CAST(amount AS DOUBLE) AS amount FROM r WHERE n = 1""")
def agg10_top_category(spark, sf_dir):
    return S.top_category(S.purchases(_txns(spark, sf_dir), keep=("category",)))


@query(f"""WITH {_BOUGHT}, s AS (SELECT user_card_id, CAST(sum(amount) AS DOUBLE) AS subtotal FROM bought GROUP BY user_card_id), h AS (SELECT user_card_id, count(*) AS n_rows, max(transaction_date) AS latest FROM transactions GROUP BY user_card_id)
SELECT h.user_card_id, n_rows, latest, coalesce(subtotal, 0) AS subtotal FROM h LEFT JOIN s ON h.user_card_id = s.user_card_id""")
def agg11_group_subtotals(spark, sf_dir):
    return S.grouped_ledger(_txns(spark, sf_dir))


@query(f"""WITH {_BOUGHT}, s AS (SELECT user_card_id, CAST(sum(amount) AS DOUBLE) AS subtotal FROM bought GROUP BY user_card_id),
h AS (SELECT user_card_id, 'header' AS item, CAST(NULL AS BIGINT) AS pos FROM transactions GROUP BY user_card_id UNION ALL SELECT user_card_id, 'row', pos FROM transactions),
d AS (SELECT h.*, t.transaction_date FROM h LEFT JOIN transactions t ON h.pos = t.pos)
SELECT d.user_card_id, item, pos, row_number() OVER (PARTITION BY d.user_card_id ORDER BY item, transaction_date DESC, pos) - 1 AS idx, CASE WHEN item = 'header' THEN coalesce(subtotal, 0) END AS subtotal FROM d LEFT JOIN s ON d.user_card_id = s.user_card_id""")
def agg12_ledger_items(spark, sf_dir):
    """Each card's header, then its rows, with their places in the list."""
    from pyspark.sql import Window

    txns = _txns(spark, sf_dir)
    heads = S.grouped_ledger(txns).select("user_card_id", F.lit("header").alias("item"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("timestamp_ntz").alias("transaction_date"), "subtotal")
    rows = txns.select("user_card_id", F.lit("row").alias("item"), "pos", "transaction_date", F.lit(None).cast("double").alias("subtotal"))
    place = F.row_number().over(Window.partitionBy("user_card_id").orderBy("item", F.desc("transaction_date"), "pos")) - 1
    return heads.unionByName(rows).select("user_card_id", "item", "pos", place.cast("long").alias("idx"), "subtotal")


@query("SELECT user_card_id, CAST(sum(amount) AS DOUBLE) AS spend FROM transactions WHERE CASE WHEN transaction_type IN ('debit', 'credit', 'refund', 'fee', 'reward') THEN transaction_type ELSE 'debit' END = 'debit' AND transaction_date BETWEEN TIMESTAMP '2001-07-01' AND TIMESTAMP '2001-07-31 12:00:00' GROUP BY user_card_id")
def agg13_month_to_date(spark, sf_dir):
    return S.card_month_to_date(_txns(spark, sf_dir), "2001-07-31 12:00:00")


@query("""SELECT sha256(user_id || ':' || user_card_id || ':' || coalesce(category, 'points')) AS id, user_id, user_card_id, coalesce(category, 'points') AS reward_type, CAST(sum(reward_earned) AS DOUBLE) AS total_earned, CAST(sum(reward_earned) AS DOUBLE) AS available_balance,
CAST(0 AS DOUBLE) AS redeemed, max(transaction_date) AS last_earned, min(transaction_date) AS first_earned FROM transactions WHERE reward_earned IS NOT NULL GROUP BY user_id, user_card_id, coalesce(category, 'points')""")
def agg14_reward_balances(spark, sf_dir):
    return S.reward_balances(_txns(spark, sf_dir))


@query("SELECT DISTINCT category FROM transactions WHERE category IS NOT NULL ORDER BY category")
def srt11_filter_categories(spark, sf_dir):
    return _txns(spark, sf_dir).where("category IS NOT NULL").select("category").distinct().orderBy("category")


@query(f"""SELECT t.pos, coalesce(upper(t.currency) <> CASE WHEN contains(lower(bank), 'hsbc uae') THEN 'AED' WHEN contains(lower(bank), 'emirates nbd') THEN 'AED' WHEN contains(lower(bank), 'union') THEN NULL ELSE 'INR' END, false) AS "foreign"
FROM transactions t LEFT JOIN user_cards u ON t.user_card_id = u.id LEFT JOIN card_catalog c ON c.id = u.catalog_card_id""")
def flt8_foreign_spend(spark, sf_dir):
    cards = view(spark, sf_dir, "user_cards").join(view(spark, sf_dir, "card_catalog").select(F.col("id").alias("catalog_card_id"), "bank"), "catalog_card_id", "left")
    return S.foreign_spend(_txns(spark, sf_dir), cards.select(F.col("id").alias("card_id"), "bank"), M.market_currency(T.bank_name(F.col("bank")))).select("pos", "foreign")


@query("""SELECT pos, c.card_name, c.bank, CAST(amount AS DOUBLE) AS amount FROM transactions t LEFT JOIN user_cards u ON t.user_card_id = u.id LEFT JOIN card_catalog c ON u.catalog_card_id = c.id
ORDER BY transaction_date DESC, pos LIMIT 100""")
def jn1_enriched_ledger(spark, sf_dir):
    txns = _txns(spark, sf_dir)
    cards = view(spark, sf_dir, "user_cards").select(F.col("id").alias("user_card_id"), "catalog_card_id")
    catalog = view(spark, sf_dir, "card_catalog").select(F.col("id").alias("catalog_card_id"), "card_name", "bank")
    joined = txns.join(cards, "user_card_id", "left").join(catalog, "catalog_card_id", "left")
    return S.page(joined.select("pos", "card_name", "bank", F.col("amount").cast("double").alias("amount"), "transaction_date"), [F.desc("transaction_date"), "pos"], 100).drop("transaction_date")
