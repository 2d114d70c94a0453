"""Queries of decisions, lists and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import cards as C
from cardloom.operators import crawl as W
from cardloom.operators import decide as D
from cardloom.operators import spend as S
from cardloom.plans.register import query
from cardloom.sources.tables import view


def _jobs(spark, sf_dir):
    return view(spark, sf_dir, "jobs")


_ST = "CASE status WHEN 'succeeded' THEN 'completed' WHEN 'review' THEN 'review_required' ELSE status END"


@query(f"""WITH j AS (SELECT id, CASE WHEN run_mode = 'automatic' THEN 'scheduled' ELSE run_mode END AS m, {_ST} AS s, CASE WHEN id % 3 > 0 THEN created_at END AS n, id % 7 > 0 AS e FROM jobs)
SELECT id, CASE WHEN s NOT IN ('completed', 'staged', 'quarantined', 'review_required', 'failed') THEN 'none' WHEN m <> 'scheduled' OR NOT e THEN CASE WHEN n IS NULL THEN 'none' ELSE 'clear' END WHEN n IS NULL OR n <= TIMESTAMP '2024-01-15' THEN 'queue' ELSE 'none' END AS action FROM j""")
def flt14_requeue_action(spark, sf_dir):
    mode = F.when(F.col("run_mode") == "automatic", F.lit("scheduled")).otherwise(F.col("run_mode"))
    s = F.when(F.col("status") == "succeeded", F.lit("completed")).when(F.col("status") == "review", F.lit("review_required")).otherwise(F.col("status"))
    action = D.requeue_action(mode, s, F.when(F.col("id") % 3 > 0, F.col("created_at")), F.lit("2024-01-15").cast("timestamp_ntz"), F.col("id") % 7 > 0, F.lit(False))
    return _jobs(spark, sf_dir).select("id", action.alias("action"))


@query("""WITH c AS (SELECT page_id, page_id % 4 = 0 AS d, http_status AS h, page_id % 5 > 0 AS v, page_id % 3 = 0 AS x FROM (SELECT page_id, CASE WHEN page_id % 10 = 9 THEN 410 ELSE http_status END AS http_status FROM attempts)),
s AS (SELECT *, CASE WHEN d AND h = 200 AND v AND NOT x THEN 'reactivate' WHEN NOT d AND (h = 410 OR h = 200 AND v AND x) THEN 'mark_discontinued' END AS suggestion FROM c)
SELECT page_id, suggestion, coalesce(suggestion, CASE WHEN h = 410 AND d OR h = 200 AND v AND d = x THEN 'observe_current' END) AS observation FROM s""")
def dom27_lifecycle(spark, sf_dir):
    k = F.col("page_id")
    suggestion, seen = D.lifecycle(k % 4 == 0, F.when(k % 10 == 9, F.lit(410)).otherwise(F.col("http_status")), k % 5 > 0, k % 3 == 0)
    return view(spark, sf_dir, "attempts").select("page_id", suggestion.alias("suggestion"), seen.alias("observation"))


@query("SELECT page_id, CASE WHEN status <> 'fetched' AND page_id % 4 = 0 THEN 'incomplete' WHEN page_id % 4 > 0 THEN 'material' WHEN page_id % 3 > 0 THEN 'removal_review' ELSE 'no_change' END AS disposition FROM attempts")
def dom32_disposition(spark, sf_dir):
    k = F.col("page_id")
    return view(spark, sf_dir, "attempts").select("page_id", D.disposition(F.col("status") == "fetched", k % 3, k % 4).alias("disposition"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'unofficial_source' END, CASE WHEN p_size < 10 THEN 'low_confidence' END, CASE WHEN p_partkey % 7 = 0 THEN 'missing_statement_signal' WHEN NOT (length(p_name) >= 4 AND p_partkey % 2 = 0) THEN 'product_mismatch' END, CASE WHEN p_size % 3 > 1 THEN 'ambiguous_catalog' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part""")
def dom17_publish_gate(spark, sf_dir):
    k, name = F.col("p_partkey"), F.col("p_name")
    seen = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(k % 2 == 0, name).otherwise(F.lit("another"))))
    reasons = D.publish_reasons(k % 5 != 0, F.when(F.col("p_size") < 10, 0.5).otherwise(0.95), name, seen, F.col("p_size") % 3)
    return view(spark, sf_dir, "part").select("p_partkey", F.array_join(reasons, ",").alias("reasons"))


@query("SELECT b.id, b.title, CASE WHEN b.p_size > 30 THEN 'high' ELSE 'medium' END AS severity FROM benefits b JOIN card_benefit_mapping m ON m.benefit_id = b.id JOIN card_catalog c ON c.id = m.card_id WHERE b.category IN ('SMALL', 'ECONOMY')")
def dom42_benefit_inbox(spark, sf_dir):
    m = view(spark, sf_dir, "card_benefit_mapping").select(F.col("benefit_id").alias("id"), "card_id")
    cards = view(spark, sf_dir, "card_catalog").select(F.col("id").alias("card_id"))
    rows = view(spark, sf_dir, "benefits").where("category IN ('SMALL', 'ECONOMY')").join(m, "id").join(cards, "card_id", "left_semi")
    return rows.select("id", "title", F.when(F.col("p_size") > 30, F.lit("high")).otherwise(F.lit("medium")).alias("severity"))


@query("SELECT count(*) AS backlog, min(created_at) AS oldest FROM jobs WHERE status IN ('queued', 'failed') HAVING count(*) > 0")
def dom43_paused_alert(spark, sf_dir):
    return D.paused_alert(_jobs(spark, sf_dir), enabled=False)


@query("SELECT id, status, created_at FROM jobs WHERE status IN ('failed', 'review') AND parser_version = 'v6' ORDER BY created_at DESC, id LIMIT 50 OFFSET 50")
def dom44_filtered_page(spark, sf_dir):
    return S.page(_jobs(spark, sf_dir).where("status IN ('failed', 'review') AND parser_version = 'v6'").select("id", "status", "created_at"), [F.desc("created_at"), "id"], 50, 50)


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00%12') OR contains(lower(c_name), '0012') OR CAST(c_custkey AS VARCHAR) = '77'")
def dom46_customer_search(spark, sf_dir):
    """By id, or by a part of the name in which % is no wildcard."""
    name = F.lower("c_name")
    return view(spark, sf_dir, "customer").where(F.contains(name, F.lit("00%12")) | F.contains(name, F.lit("0012")) | (F.col("c_custkey").cast("string") == "77")).select("c_custkey", "c_name")


@query("SELECT id, 'catalog' AS lane FROM card_catalog WHERE is_discontinued UNION ALL SELECT id, 'benefit' FROM benefits WHERE NOT is_active")
def dom47_review_lanes(spark, sf_dir):
    a = view(spark, sf_dir, "card_catalog").where("is_discontinued").select("id", F.lit("catalog").alias("lane"))
    return a.unionByName(view(spark, sf_dir, "benefits").where("NOT is_active").select("id", F.lit("benefit").alias("lane")))


@query("SELECT e.event_id, s.user_card_id FROM events e LEFT JOIN (SELECT user_id, arg_max(user_card_id, (statement_date, id)) AS user_card_id FROM statements GROUP BY user_id) s ON s.user_id = e.user_id")
def jn17_indirect_lookup(spark, sf_dir):
    """Two steps: a row's user, and that user's most recent statement's card."""
    last = view(spark, sf_dir, "statements").groupBy("user_id").agg(F.max_by("user_card_id", F.struct("statement_date", "id")).alias("user_card_id"))
    return view(spark, sf_dir, "events").select("event_id", "user_id").join(last, "user_id", "left").select("event_id", "user_card_id")


@query("SELECT c.id, u.user_id IS NOT NULL AS is_owned, u.last_four_digits FROM card_catalog c LEFT JOIN (SELECT catalog_card_id, user_id, arg_max(last_four_digits, id) AS last_four_digits FROM user_cards WHERE user_id = 12 GROUP BY catalog_card_id, user_id) u ON u.catalog_card_id = c.id")
def jn4_ownership(spark, sf_dir):
    """A user's cards against the catalogue; of two of one product the later counts."""
    own = view(spark, sf_dir, "user_cards").where("user_id = 12").groupBy(F.col("catalog_card_id").alias("id")).agg(F.max_by("last_four_digits", "id").alias("last_four_digits"), F.lit(True).alias("owned"))
    return view(spark, sf_dir, "card_catalog").select("id").join(own, "id", "left").select("id", F.coalesce("owned", F.lit(False)).alias("is_owned"), "last_four_digits")


@query("SELECT page_id, unnest(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')) AS parameter FROM pages")
def jn12_lateral_rows(spark, sf_dir):
    """A row for each member of a list that a row holds."""
    parts = F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&", -1), lambda x: x != "")
    return view(spark, sf_dir, "pages").select("page_id", F.explode(parts).alias("parameter"))


@query("SELECT card_id, parser_version, count(*) AS n FROM jobs GROUP BY ALL HAVING count(*) > 1")
def jn11_same_card(spark, sf_dir):
    """Jobs of one card and parser that are more than one, without a self join."""
    return _jobs(spark, sf_dir).groupBy("card_id", "parser_version").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT t.user_card_id, count(*) AS n, count(DISTINCT CASE WHEN t.amount > 0 THEN t.transaction_date::DATE END) AS days FROM transactions t WHERE t.transaction_date >= DATE '1998-01-01' AND t.transaction_date < DATE '1998-02-01' + INTERVAL 1 DAY GROUP BY 1")
def flt5_calendar_range(spark, sf_dir):
    """Days from and to, the last whole."""
    t = F.col("transaction_date")
    rows = view(spark, sf_dir, "transactions").where((t >= F.lit("1998-01-01").cast("timestamp_ntz")) & (t < F.date_add(F.lit("1998-02-01").cast("date"), 1).cast("timestamp_ntz")))
    return rows.groupBy("user_card_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("amount") > 0, F.to_date("transaction_date"))).alias("days"))


@query("SELECT id, 10 - attempt_count * 2 + CASE WHEN run_mode = 'manual' THEN 1 ELSE 0 END AS score FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY 10 - attempt_count * 2 + CASE WHEN run_mode = 'manual' THEN 1 ELSE 0 END DESC, id) AS n FROM jobs) WHERE n = 1")
def win11_strongest(spark, sf_dir):
    """The strongest of each card's rows, ties to the smaller id."""
    score = 10 - F.col("attempt_count") * 2 + F.when(F.col("run_mode") == "manual", 1).otherwise(0)
    best = _jobs(spark, sf_dir).withColumn("score", score).groupBy("card_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    return best.select("b.id", (-F.col("b.s")).alias("score"))


@query("SELECT DISTINCT p_partkey FROM (SELECT p_partkey FROM part WHERE p_size < 10 UNION SELECT p_partkey FROM part WHERE p_type = 'SMALL')")
def set2_union(spark, sf_dir):
    part = view(spark, sf_dir, "part")
    return part.where("p_size < 10").select("p_partkey").union(part.where("p_type = 'SMALL'").select("p_partkey")).distinct()


@query("SELECT id, CAST(due_date AS VARCHAR) AS due_date, greatest(total_amount - paid_amount, 0)::DOUBLE AS outstanding, payment_status = 'paid' AS is_paid, payment_status <> 'paid' AND due_date < DATE '2001-06-01' AS is_overdue FROM statements")
def flt9_outstanding(spark, sf_dir):
    paid = F.col("payment_status") == "paid"
    return view(spark, sf_dir, "statements").select("id", F.col("due_date").cast("string").alias("due_date"), C.outstanding().cast("double").alias("outstanding"), paid.alias("is_paid"), (~paid & (F.col("due_date") < F.lit("2001-06-01").cast("date"))).alias("is_overdue"))


@query(f"SELECT page_id, CASE WHEN regexp_matches(url, '{W.UNSAFE}') THEN -1 WHEN regexp_matches(url, '{W.PRODUCT}') THEN 2 WHEN regexp_matches(url, '{W.SUPPORTING}') THEN 1 ELSE 0 END AS score FROM pages")
def srt5_candidate_score(spark, sf_dir):
    u = F.col("url")
    return view(spark, sf_dir, "pages").select("page_id", F.when(u.rlike(W.UNSAFE), -1).when(u.rlike(W.PRODUCT), 2).when(u.rlike(W.SUPPORTING), 1).otherwise(0).alias("score"))
