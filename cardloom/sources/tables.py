"""Reading tables, and views that give the sample star schema the shapes of card data.

A view is one SELECT in the part of SQL that Spark and DuckDB share; Spark runs it over the Parquet tables, and the SQL of
a query uses the same text, so both sides start from the same rows. ``CLOCK`` is the injected "now" of every operator.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CLOCK = "2001-08-15 12:00:00"

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")

_MERCHANT = """CASE k % 14 WHEN 0 THEN 'Swiggy' WHEN 1 THEN ' BookMyShow' WHEN 2 THEN 'Indian  Oil' WHEN 3 THEN 'Amazon' WHEN 4 THEN 'MakeMyTrip'
  WHEN 5 THEN 'bigbasket ' WHEN 6 THEN 'Corner Cafe' WHEN 7 THEN 'Uber' WHEN 8 THEN NULL WHEN 9 THEN 'PVR' WHEN 10 THEN 'Netflix' WHEN 11 THEN 'Zeta Stores' WHEN 12 THEN '' ELSE 'swiggy' END"""

VIEWS = {
    # a seventh of the orders comes twice, under other ids, as imports do
    "twice": "SELECT *, o_orderkey AS pos FROM orders UNION ALL SELECT *, o_orderkey + 1000000000 AS pos FROM orders WHERE o_orderkey % 7 = 0",
    "transactions": f"""SELECT t.pos, k, u AS user_id, u * 10 + month(ts) % 3 AS user_card_id, amount, currency,
  CASE k % 11 WHEN 0 THEN 'ATM cash withdrawal' WHEN 1 THEN 'Refund of order' WHEN 2 THEN 'Finance charge' WHEN 3 THEN 'Late fee' WHEN 4 THEN 'Points credit'
    WHEN 5 THEN 'Grand Hotel stay' WHEN 6 THEN 'City petrol pump' ELSE o_orderpriority END AS description,
  {_MERCHANT} AS merchant_name,
  CASE k % 13 WHEN 0 THEN 'food' WHEN 1 THEN 'entertainment' WHEN 2 THEN 'fuel' WHEN 3 THEN 'shopping' WHEN 4 THEN 'travel' WHEN 5 THEN 'grocery' WHEN 6 THEN NULL
    WHEN 7 THEN 'other' WHEN 8 THEN 'Groceries' WHEN 9 THEN 'food' WHEN 10 THEN 'utilities' ELSE 'transport' END AS category,
  CASE o_orderstatus WHEN 'F' THEN 'debit' WHEN 'O' THEN CASE WHEN k % 2 = 0 THEN 'credit' ELSE 'Debit ' END ELSE 'cash_withdrawal' END AS transaction_type,
  ts AS transaction_date, r.reward AS reward_earned,
  CASE WHEN k % 9 = 0 THEN 'cash_withdrawal' WHEN k % 9 < 5 THEN 'debit' END AS normalized_type,
  CASE WHEN k % 3 = 0 THEN 'online' END AS channel, CASE WHEN k % 5 = 1 THEN 'app' END AS platform,
  CASE WHEN k % 4 = 1 THEN 'movie_platform' END AS merchant_subtype, CASE WHEN k % 6 <> 0 THEN CAST(k % 4 AS INT) END AS ticket_count,
  CASE WHEN k % 5 < 3 THEN u * 10000 + year(ts) % 100 * 12 + month(ts) END AS statement_id
  FROM (SELECT pos, o_orderkey AS k, o_custkey AS u, o_orderstatus, o_orderpriority, o_orderdate AS ts,
    CAST(o_totalprice AS DECIMAL(12,2)) - CASE WHEN o_orderkey % 50 = 3 THEN CAST(o_totalprice AS DECIMAL(12,2)) ELSE 0 END AS amount,
    CASE o_orderkey % 10 WHEN 0 THEN 'USD' WHEN 1 THEN 'AED' WHEN 2 THEN NULL ELSE 'INR' END AS currency FROM twice) t
  LEFT JOIN (SELECT l_orderkey, sum(CAST(l_discount AS DECIMAL(12,2))) AS reward FROM lineitem GROUP BY l_orderkey) r ON r.l_orderkey = t.k""",
    "user_cards": """SELECT c_custkey * 10 + n AS id, c_custkey AS user_id, (c_custkey + n * 7) % 40 AS catalog_card_id, CAST(1000 + c_custkey % 9000 AS STRING) AS last_four_digits,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(12,2)) END AS credit_limit, c_custkey % 5 <> 0 AS is_active,
  CAST('1995-01-01' AS DATE) + CAST(c_custkey % 900 AS INT) AS created_at FROM customer CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) m""",
    "card_catalog": """SELECT p_partkey AS id, p_name AS card_name, CASE p_partkey % 10 WHEN 0 THEN 'hdfc bank ltd' WHEN 1 THEN 'ICICI' WHEN 2 THEN 'Amazon ICICI' WHEN 3 THEN 'Emirates NBD'
  WHEN 4 THEN 'SBI cards' WHEN 5 THEN 'HSBC UAE branch' WHEN 6 THEN 'hsbc' WHEN 7 THEN 'north  star union' WHEN 8 THEN 'axis' ELSE 'AU small' END AS bank,
  CASE p_partkey % 4 WHEN 0 THEN 'Visa' WHEN 1 THEN 'RuPay' WHEN 2 THEN NULL ELSE 'Mastercard' END AS network, p_type AS card_type,
  p_partkey % 9 = 0 AS is_discontinued FROM part""",
    "benefits": """SELECT p_partkey AS id, p_name AS title, p_type AS category, p_brand AS benefit_type, p_partkey % 8 <> 0 AS is_active,
  CASE WHEN p_partkey % 12 = 5 THEN CAST('2001-01-01' AS DATE) END AS retired_at,
  CASE WHEN p_partkey % 3 = 0 THEN CAST('1999-01-01' AS DATE) + p_size END AS valid_from, CASE WHEN p_partkey % 4 = 0 THEN CAST('2001-08-01' AS DATE) + p_size END AS valid_until,
  CASE WHEN p_partkey % 6 = 0 THEN 'dup-' || p_brand || p_type ELSE 'b-' || CAST(p_partkey AS STRING) END AS dedupe_key, p_size FROM part""",
    # a card has few benefits
    "card_benefit_mapping": "SELECT p_partkey - p_partkey % 5 AS card_id, CASE WHEN p_partkey % 31 = 0 THEN -p_partkey ELSE p_partkey END AS benefit_id, p_size % 3 AS display_priority, p_partkey AS id FROM part",
    "statements": """SELECT u * 10000 + y * 12 + m AS id, u AS user_id, u * 10 + m % 3 AS user_card_id, statement_date, CAST(statement_date + INTERVAL '20' DAY AS DATE) AS due_date, total_amount,
  CASE (u + m) % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'partial' WHEN 2 THEN 'overdue' ELSE 'pending' END AS payment_status,
  CASE (u + m) % 4 WHEN 0 THEN total_amount WHEN 1 THEN CAST(100.50 AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END AS paid_amount
  FROM (SELECT o_custkey AS u, year(o_orderdate) % 100 AS y, month(o_orderdate) AS m, last_day(max(o_orderdate)) AS statement_date,
    CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(14,2)) AS total_amount FROM orders GROUP BY o_custkey, year(o_orderdate) % 100, month(o_orderdate)) s""",
    "confirmations": "SELECT user_id, CAST(event_id % 60 AS BIGINT) AS benefit_id, lower(trim(event_type)) AS platform_key FROM events",
    "jobs": """SELECT event_id AS id, user_id AS card_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'leased' WHEN 'view' THEN 'succeeded' WHEN 'click' THEN 'failed' ELSE 'review' END AS status,
  'issuer ' || CAST(user_id % 12 AS STRING) AS issuer, 'card ' || CAST(user_id AS STRING) AS card_name, CASE WHEN event_id % 3 = 0 THEN 'automatic' ELSE 'manual' END AS run_mode,
  CASE WHEN event_id % 4 = 0 THEN 'v5' ELSE 'v6' END AS parser_version, CAST(event_id % 4 AS INT) AS attempt_count, ts AS created_at, ts + INTERVAL '1' DAY AS lease_expires_at,
  CASE WHEN event_id % 5 = 0 THEN event_id END AS staging_id FROM events""",
    "attempts": """SELECT page_id, 'source ' || CAST(page_id % 40 AS STRING) AS source_key, url, CASE page_id % 6 WHEN 0 THEN 'failed' WHEN 5 THEN 'blocked' ELSE 'fetched' END AS status,
  CASE page_id % 6 WHEN 0 THEN 503 WHEN 5 THEN 403 ELSE 200 END AS http_status, CAST('2001-08-01 00:00:00' AS TIMESTAMP) + CAST(page_id * 37 % 500 AS INT) * INTERVAL '1' HOUR AS attempted_at,
  CASE WHEN page_id % 6 = 0 THEN 'http_503' WHEN page_id % 6 = 5 THEN 'robots_denied' END AS error_code, page_id % 3 = 0 AS required FROM pages""",
    "observations": """SELECT conv_id AS card_id, turn, 'hash-' || CAST(length(text) % 7 AS STRING) AS semantic_hash, CAST('2001-06-01 00:00:00' AS TIMESTAMP) + CAST(turn * 5 + conv_id % 9 AS INT) * INTERVAL '1' DAY AS observed_at,
  role <> 'assistant' AS crawl_complete, CASE role WHEN 'user' THEN 0 WHEN 'system' THEN 1 ELSE 2 END AS source_priority FROM conversations""",
    "deal_sources": """SELECT p_partkey AS benefit_id, p_partkey - p_partkey % 5 AS catalog_card_id, p_name AS title, p_size % 5 AS display_priority,
  CASE p_partkey % 9 WHEN 0 THEN '{"discount_type":"BOGO","max_discount_per_transaction":' || CAST(p_size * 20 AS STRING) || ',"max_usage_per_month":2}'
    WHEN 1 THEN '{"discount_percent":"' || CAST(p_size AS STRING) || '","max_discount_per_transaction":150}' WHEN 2 THEN '{"discount_percent":' || CAST(p_size * 3 AS STRING) || '}'
    WHEN 3 THEN '{"threshold_amount":80000,"reward_value":500}' WHEN 4 THEN '{"category":"dining, Movies","multiplier":5,"unit":"points per Rs.150"}' WHEN 5 THEN '{"unit":"Fixed","annual_cap":6000}'
    WHEN 6 THEN '{"discount_amount":200,"monthly_cap":' || CAST(p_size * 6 AS STRING) || ',"min_transaction":' || CAST(p_size * 40 AS STRING) || '}' WHEN 7 THEN '{"discount_type":"bogo","max_usage_per_period":1}' ELSE '{"note":"none"}' END AS value_config,
  CASE p_size % 4 WHEN 0 THEN 'BookMyShow' WHEN 1 THEN ' District,Uber' WHEN 2 THEN '' ELSE 'PVR,INOX,cult.fit' END AS partners,
  CASE WHEN p_partkey % 5 = 0 THEN CAST('2001-07-01' AS DATE) + p_size END AS valid_until, p_partkey % 3 = 0 AS is_owned,
  CASE WHEN p_partkey % 4 = 0 THEN 'verified' ELSE 'unverified' END AS usage_confidence, CAST(p_partkey % 4 AS INT) AS used_transactions, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 100.0E0 END AS milestone_spend,
  CASE WHEN p_partkey % 6 = 0 THEN 'bookmyshow' ELSE '' END AS confirmed FROM part""",
    "terms": """SELECT side, k AS id, k % 23 AS card_id, CASE WHEN k % 4 = 0 THEN 'card-benefit-v2:' ELSE 'old:' END || CAST(k % 23 AS STRING) || ':' || CAST(k % 61 AS STRING) AS dedupe_key, 's' || CAST(k % 37 AS STRING) AS semantic_key,
  'c' || CAST(k % 61 AS STRING) || CASE WHEN side = 'p' AND k % 17 = 0 THEN 'x' ELSE '' END || CASE WHEN k % 29 = 3 THEN CAST(k % 2 AS STRING) ELSE '' END AS condition, 'u' || CAST(k % 5 AS STRING) AS source, 'j' || CAST(k % 37 % 12 AS STRING) AS subject, k % 3 > 0 AS v6
  FROM (SELECT 'c' AS side, p_partkey AS k FROM part WHERE p_partkey % 7 > 1 UNION ALL SELECT 'p' AS side, p_partkey + CASE WHEN p_partkey % 11 = 0 THEN 61 ELSE 0 END AS k FROM part WHERE p_partkey % 9 > 1) t""",
    "eval_results": """SELECT d.doc_id AS case_id, d.lang AS feature_key, l.quality = 1 AS baseline_pass, l.quality = 1 AND l.toxic = 0 AS candidate_pass, l.toxic = 1 AS severe, d.n_chars AS latency_ms,
  CAST(d.n_chars % 300 AS DECIMAL(12,2)) / 100 AS cost_usd, CASE WHEN d.doc_id % 7 = 0 THEN 'review' WHEN d.doc_id % 23 = 0 THEN 'execution_error' ELSE 'scored' END AS status
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


def needed(*names: str) -> list[str]:
    """Views that names need, in an order in which each comes after those it reads."""
    out: list[str] = []

    def add(name):
        if name in VIEWS and name not in out:
            for other in VIEWS:
                if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                    add(other)
            out.append(name)

    for n in names:
        add(n)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or base table over the Parquet tables in sf_dir."""
    made: dict[str, DataFrame] = {}

    def of(n: str) -> DataFrame:
        if n not in made:
            if n not in VIEWS:
                made[n] = spark.read.parquet(f"{sf_dir}/{n}.parquet")
            else:
                text, used = VIEWS[n].replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"), {}  # without a zone on both sides
                text = text.replace("{", "{{").replace("}", "}}")
                for other in (*VIEWS, *BASE):
                    if other != n and re.search(rf"(FROM|JOIN) {other}\b", text):
                        used[other] = of(other)
                        text = re.sub(rf"(FROM|JOIN) {other}\b", rf"\1 {{{other}}}", text)
                made[n] = spark.sql(text, **used)
        return made[n]

    return of(name)


def with_views(sql: str) -> str:
    """sql with the views it names put before it as common table expressions."""
    names = needed(*[n for n in VIEWS if re.search(rf"\b{n}\b", sql)])
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not head:
        return sql
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
