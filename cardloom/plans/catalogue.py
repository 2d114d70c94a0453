"""Queries of crawls, their snapshots and numbers, and of the identities of catalogue cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import attempts as A
from cardloom.operators import growth, identity, pages, removals, replay, snapshots
from cardloom.plans.register import query
from cardloom.sources.tables import CLOCK, view

# ---------------------------------------------------------------- snapshots

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
#: What happened to the orders: some went, some have another price or status, some came. Parts lost a size, customers stayed.
_NEW_ORDERS = """SELECT CASE WHEN o_orderkey % 101 = 0 THEN o_orderkey + 500000000 ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 89 < 2 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 5"""
_NEW_PARTS = "SELECT p_partkey, p_name, CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE p_size END AS p_size FROM part"


def _pairs(spark, sf_dir):
    orders, part, customer = (view(spark, sf_dir, t) for t in ("orders", "part", "customer"))
    new_orders, new_parts = spark.sql(_NEW_ORDERS.replace("FROM orders", "FROM {o}"), o=orders), spark.sql(_NEW_PARTS.replace("FROM part", "FROM {p}"), p=part)
    return {
        "orders": (orders, new_orders, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]), "part": (part, new_parts, "p_partkey", ["p_name", "p_size"]),
        "customer": (customer, customer.select("*"), "c_custkey", ["c_name", "c_acctbal"]),
    }


@query(f"""WITH n AS ({_NEW_ORDERS}), p AS ({_NEW_PARTS}),
o AS (SELECT 'orders' AS table_name, CAST(coalesce(a.o_orderkey, b.o_orderkey) AS VARCHAR) AS key, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'modified' END AS change,
  concat_ws(',', CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END, CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END, CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END) AS fields
  FROM orders a FULL JOIN n b ON a.o_orderkey = b.o_orderkey),
q AS (SELECT 'part' AS table_name, CAST(a.p_partkey AS VARCHAR) AS key, 'modified' AS change, 'p_size' AS fields FROM part a JOIN p b ON a.p_partkey = b.p_partkey WHERE a.p_size IS DISTINCT FROM b.p_size)
SELECT table_name, key, change, CASE WHEN change = 'modified' THEN fields ELSE '' END AS fields FROM o WHERE change <> 'modified' OR fields <> '' UNION ALL SELECT * FROM q""")
def agg36_snapshot_diff(spark, sf_dir):
    """What changed between two snapshots of three tables, by key and column."""
    return snapshots.snapshot_diff(_pairs(spark, sf_dir)).withColumnRenamed("table", "table_name")


@query("SELECT unnest(['orders', 'part', 'customer']) AS table_name, unnest([EXISTS (FROM orders WHERE o_orderkey % 97 = 5 OR o_orderkey % 101 = 0 OR o_orderkey % 89 < 2), EXISTS (FROM part WHERE p_partkey % 50 = 7 AND p_size IS NOT NULL), false]) AS mutated")
def agg36_mutated_tables(spark, sf_dir):
    """Which of three tables changed at all: digests alone."""
    return snapshots.mutated_tables(_pairs(spark, sf_dir)).withColumnRenamed("table", "table_name")


# ---------------------------------------------------------------- attempts

#: Twelve attempts a crawl. Crawls of one kind have more decisive sources than are kept, of another two attempts a source, of
#: another two at one instant; some attempts bring a history, which may end with the attempt itself.
_ATTEMPTS = """SELECT crawl, place, page_id, role, CASE WHEN crawl % 3 = 1 THEN 's' || CAST(place - place % 2 AS STRING) ELSE 's' || CAST(place AS STRING) END AS source_key, status, http_status, error_code, identity, attempted_at, kind, over
  FROM (SELECT CAST(page_id - page_id % 12 AS BIGINT) AS crawl0, CAST((page_id - page_id % 12) / 12 AS BIGINT) AS crawl, CAST(page_id % 12 AS BIGINT) AS place, page_id,
    CASE WHEN page_id % 12 < CASE WHEN (page_id - page_id % 12) / 12 % 3 = 1 THEN 2 ELSE 1 END THEN 'primary' WHEN (page_id - page_id % 12) / 12 % 5 = 0 OR page_id % 12 < 5 THEN 'required_supporting' ELSE 'supporting' END AS role,
    CASE WHEN (page_id - page_id % 12) / 12 % 4 < 2 THEN 'fetched' ELSE status END AS status, CASE WHEN (page_id - page_id % 12) / 12 % 4 < 2 THEN 200 ELSE http_status END AS http_status, CASE WHEN (page_id - page_id % 12) / 12 % 4 >= 2 THEN CASE WHEN error_code = 'http_503' THEN 'corrupt_pdf' ELSE error_code END END AS error_code,
    CASE WHEN page_id % 29 = 3 THEN 'b' ELSE 'a' END AS identity, CASE WHEN (page_id - page_id % 12) / 12 % 7 = 2 THEN CAST('2001-08-03 00:00:00' AS TIMESTAMP) ELSE attempted_at END AS attempted_at, CAST(page_id % 4 AS INT) AS kind, page_id % 60 = 7 AS over FROM attempts) t"""


def _attempts(spark, sf_dir):
    rows = spark.sql(_ATTEMPTS.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)").replace("FROM attempts", "FROM {a}"), a=view(spark, sf_dir, "attempts"))
    earlier = F.struct(F.lit("failed").alias("status"), F.lit(503).alias("http_status"), F.lit("http_5xx").alias("error_code"), F.lit(None).cast("string").alias("identity"), (F.col("attempted_at") - F.expr("INTERVAL '1' DAY")).alias("attempted_at"))
    return rows.withColumn("history", F.when(F.col("kind") == 1, F.array(earlier)).when(F.col("kind") == 2, F.array(earlier, A.entry()))).withColumnRenamed("over", "overflow")


_KEPT = f"""a AS (SELECT *, CASE WHEN kind IN (1, 2) THEN 2 ELSE 1 END AS entries FROM ({_ATTEMPTS}) x),
g AS (SELECT crawl, role, source_key, count(*) = count(DISTINCT attempted_at) AS clear, arg_max({{'status': status, 'http': http_status, 'code': error_code, 'at': attempted_at, 'place': place}}, (attempted_at, place)) AS l, min(place) AS first, sum(entries) AS n_history, bool_or(over) AS over, count(DISTINCT identity) AS ids FROM a GROUP BY 1, 2, 3),
s AS (SELECT crawl, role, source_key, role <> 'supporting' AS decisive, CASE WHEN clear THEN l.status ELSE 'failed' END AS status, CASE WHEN clear THEN l.http END AS http_status, CASE WHEN clear THEN l.code ELSE 'invalid_attempt_history' END AS error_code, CASE WHEN clear THEN l.place ELSE first END AS place,
  CASE WHEN clear THEN n_history ELSE 0 END AS n_history, clear AND over AS overflow, CASE WHEN clear THEN ids ELSE 0 END AS ids FROM g WHERE clear OR role <> 'supporting'),
r AS (SELECT *, row_number() OVER (PARTITION BY crawl ORDER BY CASE role WHEN 'primary' THEN 0 WHEN 'required_supporting' THEN 1 ELSE 2 END, place) AS n, count(*) FILTER (WHERE decisive) OVER (PARTITION BY crawl) AS d FROM s),
k AS (SELECT crawl, role, source_key, status, http_status, error_code, place, n_history, overflow, ids FROM r WHERE n <= 9 AND (d <= 9 OR n < 9)
  UNION ALL SELECT DISTINCT crawl, 'required_supporting', 'invalid-source', 'failed', NULL, 'decisive_attempt_overflow', NULL, 0, false, 0 FROM r WHERE d > 9),
o AS (SELECT *, coalesce(status = 'fetched' AND http_status BETWEEN 200 AND 299, false) AS ok FROM k),
z AS (SELECT crawl, bool_or(coalesce(error_code = 'decisive_attempt_overflow', false)) AS crowded, max(ids) > 1 AS torn, bool_or(overflow) AS over, count(*) FILTER (WHERE role = 'primary') AS p, count(*) FILTER (WHERE role = 'primary' AND ok) AS f, arg_min(error_code, place) FILTER (WHERE role = 'supporting' AND status = 'failed' AND error_code = 'corrupt_pdf') AS open,
  count(*) FILTER (WHERE role = 'required_supporting' AND NOT ok) AS lacking FROM o GROUP BY crawl),
t AS (SELECT crawl, CASE WHEN crowded THEN 'decisive_attempt_overflow' WHEN torn THEN 'final_resource_identity_conflict' WHEN over THEN 'attempt_history_overflow' WHEN p = 0 THEN 'missing_primary' WHEN p > 1 THEN 'multiple_primary' WHEN f = 0 THEN 'primary_incomplete' WHEN open IS NOT NULL THEN open WHEN lacking > 0 THEN 'required_supporting_incomplete' ELSE 'complete' END AS reason FROM z)"""


@query(f"""WITH {_KEPT} SELECT k.crawl, k.role, k.source_key, k.status, k.error_code, k.place, CAST(k.n_history AS INTEGER) AS n_history, k.overflow, t.reason FROM k JOIN t ON k.crawl = t.crawl""")
def dom30_compacted_attempts(spark, sf_dir):
    """What crawls keep of their attempts, one a source with its history, and what the crawl is thereby."""
    kept = A.compacted(_attempts(spark, sf_dir), "crawl", CLOCK.replace("08-15", "09-15"))
    rows = kept.join(A.assessed(kept, "crawl"), "crawl")
    return rows.select("crawl", "role", "source_key", "status", "error_code", "place", F.coalesce(F.size("history"), F.lit(0)).alias("n_history"), "overflow", "reason")


_CRAWLS = """SELECT crawl, crawl % 3 > 0 AS complete, CASE WHEN crawl % 4 > 0 THEN crawl % 4 END AS suppressed, CASE WHEN crawl % 5 > 0 THEN crawl % 3 END AS retries, crawl % 2 = 0 AS replay_passed, CASE WHEN crawl % 6 > 0 THEN crawl % 6 = 1 END AS proof_passed,
  CAST('2001-08-15 09:00:00' AS TIMESTAMP) + CAST(crawl % 60 AS INT) * INTERVAL '1' MINUTE AS started_at, CASE WHEN crawl % 11 > 0 THEN CAST('2001-08-15 09:00:00' AS TIMESTAMP) + CAST(crawl % 60 + crawl % 13 - 1 AS INT) * INTERVAL '1' MINUTE END AS completed_at
  FROM (SELECT DISTINCT CAST((page_id - page_id % 12) / 12 AS BIGINT) AS crawl FROM pages) c"""
_PROPOSED = "SELECT CAST((p_partkey - p_partkey % 20) / 20 AS BIGINT) AS crawl, CASE p_partkey % 8 WHEN 0 THEN 'additions' WHEN 1 THEN 'modifications' WHEN 2 THEN 'migrations' WHEN 3 THEN 'removals' WHEN 4 THEN 'conflicts' WHEN 5 THEN 'catalog_conflicts' ELSE 'additions' END AS kind FROM part"
_DECIDED = "SELECT CAST((event_id - event_id % 80) / 80 AS BIGINT) AS crawl, CASE event_id % 7 WHEN 0 THEN 'approve' WHEN 1 THEN 'edit' WHEN 2 THEN 'retire' WHEN 3 THEN 'retry' ELSE 'reject' END AS action, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'b' END AS benefit_id, CASE WHEN event_id % 5 < 3 THEN CAST(event_id % 5 - 1 AS INT) END AS proposal_index FROM events"
_ACT = "count(*) FILTER (WHERE action = '{}')"


@query(f"""WITH x AS ({_ATTEMPTS}), h AS (SELECT crawl, role, status, coalesce(error_code, '') AS code, CASE WHEN kind = 1 THEN 0 ELSE 1 END AS own, CASE WHEN kind IN (1, 2) THEN 1 ELSE 0 END AS had, over, kind = 3 AS reusable FROM x),
m AS (SELECT crawl, sum(own + had) AS fetch_attempts, sum(own) FILTER (WHERE status = 'fetched') AS fs, sum(own) FILTER (WHERE status = 'failed' AND code IN ('robots_denied')) AS fb, sum(had) AS hf, sum(own) FILTER (WHERE status = 'failed' AND code NOT IN ('http_404')) AS ff, count(*) FILTER (WHERE over) AS ov,
  count(*) FILTER (WHERE role = 'required_supporting') AS req, count(*) FILTER (WHERE role = 'required_supporting' AND status = 'fetched') AS rs, count(*) FILTER (WHERE role = 'required_supporting' AND status = 'failed') AS rf FROM h GROUP BY crawl),
c AS ({_CRAWLS}), p AS ({_PROPOSED}), d AS ({_DECIDED}),
k AS (SELECT crawl, {', '.join(f"count(*) FILTER (WHERE kind = '{a}') AS {n}" for a, n in A.PROPOSED.items())} FROM p GROUP BY crawl),
e AS (SELECT crawl, {', '.join(f"{_ACT.format(a)} AS {n}" for a, n in A.DECIDED.items())}, {_ACT.format('retry')} AS again, count(*) FILTER (WHERE action = 'reject' AND (coalesce(benefit_id, '') <> '' OR coalesce(proposal_index, -1) >= 0)) AS targeted_rejects, count(*) FILTER (WHERE action = 'reject' AND NOT (coalesce(benefit_id, '') <> '' OR coalesce(proposal_index, -1) >= 0)) AS global_rejects FROM d GROUP BY crawl)
SELECT c.crawl, m.fetch_attempts, coalesce(fs, 0) AS fetch_success, 0 AS fetch_not_modified, 0 AS fetch_blocked, 0 AS fetch_missing, coalesce(ff, 0) + hf AS fetch_failed, ov AS fetch_attempt_history_overflow, coalesce(fs, 0) / m.fetch_attempts::DOUBLE AS fetch_success_rate, req AS required_supporting_attempted, rs AS required_supporting_succeeded, rf AS required_supporting_failed, 0 AS required_supporting_omitted,
  CASE WHEN req = 0 THEN 1.0 ELSE rs / req::DOUBLE END AS required_supporting_success_rate, {', '.join(f"coalesce(k.{n}, 0) AS {n}" for n in A.PROPOSED.values())}, {', '.join(f"coalesce(e.{n}, 0) AS {n}" for n in (*A.DECIDED.values(), 'targeted_rejects', 'global_rejects'))}, CASE WHEN complete THEN 0 ELSE 1 END AS fetch_incomplete, coalesce(suppressed, 0) AS suppressed_removals,
  CASE WHEN suppressed > 0 AND NOT complete THEN 'incomplete_crawl' ELSE '' END AS suppressed_removal_reason_codes, coalesce(retries, again, 0) AS retries, replay_passed AS deterministic_replay_passed, coalesce(proof_passed, false) AS side_effect_proof_passed,
  coalesce(completed_at >= started_at AND completed_at <= started_at + INTERVAL 10 MINUTE, false) AS valid, CAST(started_at AS VARCHAR) AS processing_started_at, CAST(completed_at AS VARCHAR) AS processing_completed_at, CASE WHEN completed_at >= started_at AND completed_at <= started_at + INTERVAL 10 MINUTE THEN date_diff('millisecond', started_at, completed_at) END AS processing_duration_ms
FROM c JOIN m ON c.crawl = m.crawl LEFT JOIN k ON c.crawl = k.crawl LEFT JOIN e ON c.crawl = e.crawl""")
def agg29_crawl_metrics(spark, sf_dir):
    """All metrics of every crawl."""
    crawls = spark.sql(_CRAWLS.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)").replace("FROM pages", "FROM {p}"), p=view(spark, sf_dir, "pages"))
    proposals = spark.sql(_PROPOSED.replace("FROM part", "FROM {p}"), p=view(spark, sf_dir, "part"))
    decisions = spark.sql(_DECIDED.replace("FROM events", "FROM {e}"), e=view(spark, sf_dir, "events"))
    tried = _attempts(spark, sf_dir).withColumn("reusable", F.col("kind") == 3)
    out = A.crawl_metrics(crawls, tried, proposals, decisions, "crawl", CLOCK)
    return out.withColumns({c: F.col(c).cast("string") for c in ("processing_started_at", "processing_completed_at")})


# ---------------------------------------------------------------- removals

_HISTORY = """SELECT conv_id AS card_id, CAST('2001-06-01 00:00:00' AS TIMESTAMP) + CAST(turn * 5 + conv_id % 9 AS INT) * INTERVAL '1' DAY AS observed_at, role <> 'assistant' AS complete, turn FROM conversations"""


@query(f"""WITH h AS ({_HISTORY}), o AS (SELECT card_id, observed_at, complete, turn, row_number() OVER (PARTITION BY card_id ORDER BY observed_at DESC, complete DESC) AS n FROM h WHERE observed_at <= TIMESTAMP '2001-08-15 12:00:00'),
c AS (SELECT *, dense_rank() OVER (PARTITION BY card_id ORDER BY observed_at) AS seq FROM o WHERE n <= 24 AND complete), i AS (SELECT unnest([0, 1, 2, 3]) AS i),
b AS (SELECT DISTINCT card_id, i, seq, observed_at FROM c, i WHERE (turn + i + card_id) % 3 > 0),
u AS (SELECT card_id, i, max(n) AS streak FROM (SELECT card_id, i, seq - w AS island, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY card_id, i ORDER BY seq) AS w FROM b) GROUP BY ALL) GROUP BY card_id, i),
k AS (SELECT DISTINCT conv_id AS card_id, i, conv_id % 4 > 0 AS whole, CASE WHEN (conv_id + i) % 6 = 0 THEN DATE '2001-07-31' WHEN (conv_id + i) % 6 = 1 THEN DATE '2001-09-30' END AS e FROM conversations, i),
d AS (SELECT card_id, i, observed_at FROM b UNION SELECT card_id, i, TIMESTAMP '2001-08-15 12:00:00' FROM k),
g AS (SELECT card_id, i, count(DISTINCT observed_at) AS n, min(observed_at) AS f, max(observed_at) AS l FROM d GROUP BY card_id, i),
r AS (SELECT k.card_id, k.i, NOT whole AS suppressed, CASE WHEN NOT whole THEN 'suppressed' WHEN e < DATE '2001-08-15' THEN 'explicit_past_end_date' WHEN e IS NOT NULL THEN 'explicit_end_date_not_past' WHEN n >= 2 AND l >= f + INTERVAL 7 DAY THEN 'two_complete_observations' ELSE 'insufficient_complete_observations' END AS reason, n, streak
  FROM k JOIN g ON k.card_id = g.card_id AND k.i = g.i LEFT JOIN u ON k.card_id = u.card_id AND k.i = u.i)
SELECT card_id, 'b' || i AS benefit_id, suppressed, reason IN ('explicit_past_end_date', 'two_complete_observations') AS eligible, reason, CASE WHEN suppressed THEN 0 ELSE n END AS observations, CASE WHEN suppressed THEN 0 ELSE coalesce(streak, 0) END AS streak FROM r""")
def dom31_removals(spark, sf_dir):
    """What becomes of each possible removal, with the absences that speak for it and their longest unbroken run."""
    talks = view(spark, sf_dir, "conversations")
    history = spark.sql(_HISTORY.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)").replace("FROM conversations", "FROM {c}"), c=talks)
    ids = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when((F.col("turn") + i + F.col("card_id")) % 3 > 0, F.concat(F.when(i % 2 == 0, F.lit("b")).otherwise(F.lit("d")), i.cast("string"))))
    history = history.withColumn("absent_ids", F.array_compact(ids)).drop("turn")
    cards = talks.select(F.col("conv_id").alias("card_id")).distinct()
    end = F.when((F.col("card_id") + F.col("i")) % 6 == 0, F.lit("2001-07-31")).when((F.col("card_id") + F.col("i")) % 6 == 1, F.lit("2001-09-30")).cast("date")
    possible = cards.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("card_id", F.concat(F.lit("b"), F.col("i").cast("string")).alias("benefit_id"), F.when(F.col("i") % 2 == 1, F.concat(F.lit("d"), F.col("i").cast("string"))).alias("dedupe_key"), end.alias("effective_to"))
    crawls = cards.select("card_id", (F.col("card_id") % 4 > 0).alias("complete"), F.lit(CLOCK).cast("timestamp_ntz").alias("observed_at"))
    return removals.removal_policy(possible, crawls, history, CLOCK)


# ---------------------------------------------------------------- the funnel

_PEOPLE = """SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'referral' WHEN 2 THEN 'search' END AS source, started_at, CASE WHEN c_custkey % 10 < 6 THEN started_at + INTERVAL '1' DAY END AS completed_at, c_custkey % 10 < 6 AND c_custkey % 4 <> 2 AND c_custkey % 7 > 2 AS qualified, c_custkey % 5 AS cohort,
  CASE WHEN c_custkey % 10 < 6 THEN started_at + INTERVAL '2' DAY END AS invited_at, CASE WHEN c_custkey % 10 < 3 THEN started_at + INTERVAL '3' DAY END AS activated_at, CAST(c_custkey % 90 AS INT) AS support_minutes, c_custkey % 13 = 0 AS issue, c_custkey % 13 = 0 AND c_custkey % 1000 = 7 AS severe_open, c_custkey % 11 < 3 AS interviewed
  FROM (SELECT c_custkey, CAST('2024-01-01 08:00:00' AS TIMESTAMP) + CAST(c_custkey % 24 AS INT) * INTERVAL '1' DAY AS started_at FROM customer) c"""
_GROWN = "2024-02-01 00:00:00"


def _sql_band(metric: str, of: str) -> str:
    go, watch, run, least = growth.BANDS[metric]
    stop = f"b.run >= {run}" if run else f"w.d >= {least}"
    return f"""SELECT '{metric}' AS metric, 'all' AS scope, w.n::DOUBLE AS numerator, w.d AS denominator, w.n / w.d::DOUBLE AS ratio, CASE WHEN w.d = 0 THEN 'no_data' WHEN w.n / w.d::DOUBLE >= {go} THEN 'continue' WHEN w.n / w.d::DOUBLE < {watch} AND {stop} THEN 'stop' ELSE 'watch' END AS state
  FROM (SELECT coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(d), 0)::BIGINT AS d FROM {of}) w, (SELECT count(*) AS run FROM {of} WHERE d > 0 AND n < {watch} * d AND s > coalesce((SELECT max(s) FROM {of} WHERE d > 0 AND n >= {watch} * d), '')) b"""


@query(f"""WITH p AS ({_PEOPLE}), m AS (SELECT user_id, cohort, activated_at FROM p WHERE activated_at + INTERVAL 14 DAY <= TIMESTAMP '{_GROWN}'),
a AS (SELECT DISTINCT m.user_id FROM m JOIN events e ON e.user_id = m.user_id WHERE e.event_type IN ('purchase', 'click') AND date_diff('day', m.activated_at::DATE, e.ts::DATE) BETWEEN 8 AND 14),
d AS (SELECT m.user_id FROM m JOIN events e ON e.user_id = m.user_id WHERE e.event_type = 'purchase' AND e.ts >= m.activated_at AND e.ts <= m.activated_at + INTERVAL 14 DAY GROUP BY m.user_id HAVING count(*) >= 2),
ripe AS (SELECT m.*, a.user_id IS NOT NULL AS active, d.user_id IS NOT NULL AS decided FROM m LEFT JOIN a ON a.user_id = m.user_id LEFT JOIN d ON d.user_id = m.user_id),
s1 AS (SELECT CAST(date_trunc('week', started_at) AS VARCHAR) AS s, count(completed_at) AS n, count(*) AS d FROM p GROUP BY 1), s2 AS (SELECT CAST(date_trunc('week', started_at) AS VARCHAR) AS s, count(*) FILTER (WHERE completed_at IS NOT NULL AND qualified) AS n, count(completed_at) AS d FROM p GROUP BY 1),
s3 AS (SELECT CAST(cohort AS VARCHAR) AS s, count(activated_at) AS n, count(*) AS d FROM p WHERE invited_at IS NOT NULL GROUP BY 1), s4 AS (SELECT CAST(cohort AS VARCHAR) AS s, count(*) FILTER (WHERE active) AS n, count(*) AS d FROM ripe GROUP BY 1), s5 AS (SELECT CAST(cohort AS VARCHAR) AS s, count(*) FILTER (WHERE decided) AS n, count(*) AS d FROM ripe GROUP BY 1),
q AS (SELECT coalesce(source, 'unknown') AS scope, count(*) FILTER (WHERE qualified) AS n, count(*) AS d, sum(count(*) FILTER (WHERE qualified)) OVER () / sum(count(*)) OVER ()::DOUBLE AS o FROM p WHERE completed_at IS NOT NULL GROUP BY 1),
z AS (SELECT count(*) AS n, sum(support_minutes)::DOUBLE AS minutes, count(*) FILTER (WHERE issue)::DOUBLE AS issues, bool_or(severe_open) AS severe, count(*) FILTER (WHERE interviewed)::DOUBLE AS talks FROM p WHERE activated_at IS NOT NULL)
SELECT 'source_qualified' AS metric, scope, n::DOUBLE AS numerator, d AS denominator, n / d::DOUBLE AS ratio, CASE WHEN n / d::DOUBLE >= o THEN 'continue' WHEN o - n / d::DOUBLE >= 0.15 AND d >= 20 THEN 'stop' ELSE 'watch' END AS state FROM q
UNION ALL {' UNION ALL '.join(_sql_band(m, f's{i}') for i, m in enumerate(growth.BANDS, 1))}
UNION ALL SELECT 'support_load', 'all', minutes, n, minutes / n, CASE WHEN minutes / n <= 30 THEN 'continue' WHEN minutes / n <= 60 THEN 'watch' ELSE 'stop' END FROM z
UNION ALL SELECT 'trust_issue', 'all', issues, n, issues / n, CASE WHEN severe OR issues / n > 0.2 THEN 'stop' WHEN issues / n >= 0.1 THEN 'watch' ELSE 'continue' END FROM z
UNION ALL SELECT 'interview_coverage', 'all', talks, n, talks / n, CASE WHEN talks / n < 0.1 THEN 'stop' WHEN talks / n BETWEEN 0.2 AND 0.4 THEN 'continue' ELSE 'watch' END FROM z""")
def agg38_funnel(spark, sf_dir):
    """The nine ratios of the funnel over matured people, with what follows from each."""
    people = spark.sql(_PEOPLE.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)").replace("FROM customer", "FROM {c}"), c=view(spark, sf_dir, "customer"))
    events = view(spark, sf_dir, "events")
    sessions = events.select("user_id", F.col("ts").alias("at"), F.col("event_type").isin("purchase", "click").alias("meaningful"))
    return growth.scorecard(people, sessions, events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at")), _GROWN)


# ---------------------------------------------------------------- identities

_SHORT = "CASE WHEN k % 4 = 1 THEN 'Visa' WHEN k % 4 = 2 THEN 'RuPay' END"
#: A name that only one part has, of letters.
_NAME = "translate(CAST(k AS STRING), '0123456789', 'bcdfghjkmn')"
_CARDS = f"SELECT p_partkey AS card_id, 'Star Trust' AS bank, 'Zo' || n || CASE k % 3 WHEN 0 THEN ' Gold' WHEN 1 THEN ' Platinum' ELSE '' END || ' Credit Card' AS card_name, {_SHORT} AS network, CASE WHEN k % 19 = 4 THEN 'debit' ELSE 'Credit' END AS card_type FROM (SELECT p_partkey, p_partkey AS k, translate(CAST(p_partkey - p_partkey % 24 + CASE WHEN p_partkey % 24 IN (22, 23) THEN 20 ELSE p_partkey % 24 END AS STRING), '0123456789', 'bcdfghjkmn') AS n FROM part) p"
_ALIASES = f"SELECT p_partkey AS card_id, 'Alt' || {_NAME} AS alias FROM (SELECT p_partkey, p_partkey AS k FROM part) p WHERE k % 24 = 9"
_HASH = "sha2('{}' || CAST({} AS STRING), 256)"
_KEYS = f"SELECT {_HASH.format('u', 'k')} AS url_hash, CASE WHEN k % 24 = 12 THEN k + 1 ELSE k END AS card_id FROM (SELECT p_partkey AS k FROM part) p WHERE k % 24 IN (10, 11, 12, 13) UNION ALL SELECT {_HASH.format('u', 'k')}, k + 2 FROM (SELECT p_partkey AS k FROM part) p WHERE k % 24 = 13"
_SEEN = f"SELECT {_HASH.format('v', 'k')} AS submitted_hash, {_HASH.format('w', 'k')} AS final_hash, k AS card_id FROM (SELECT p_partkey AS k FROM part) p WHERE k % 24 IN (14, 15)"
#: Requests about the cards by what is asked otherwise: nothing, a foreign host, an odd url, a broken hash, no name, an alias, a bound
#: url with and without the right name, two bound cards, another network, another tier, a new name.
_REQUESTS = f"""SELECT k AS request_id, CASE WHEN k % 24 = 1 THEN ' star trust ' ELSE 'Star Trust' END AS issuer,
  CASE WHEN k % 24 = 5 THEN 'Gold Card' WHEN k % 24 = 9 THEN 'Benefits of Alt' || n || tier WHEN k % 24 = 11 THEN 'Other' || n WHEN k % 24 = 17 THEN 'Fresh' || n ELSE 'Fees and charges for Zo' || z || CASE WHEN k % 24 = 19 THEN ' Infinite' ELSE tier END || ' Credit Card' END AS card_name,
  CASE WHEN k % 24 = 18 THEN 'Mastercard' ELSE network END AS network,
  CASE WHEN k % 24 = 2 THEN 'https://star.example/a/' WHEN k % 24 = 3 THEN 'https://mystar.example/c' ELSE 'https://www.star.example/c' || CAST(k AS STRING) END AS url,
  CASE WHEN k % 24 = 4 THEN 'abc' WHEN k % 24 = 14 THEN {_HASH.format('w', 'k')} ELSE upper({_HASH.format('u', 'k')}) END AS submitted_hash, CASE WHEN k % 24 = 15 THEN {_HASH.format('v', 'k')} ELSE {_HASH.format('x', 'k')} END AS final_hash
  FROM (SELECT p_partkey AS k, {_SHORT.replace('k %', 'p_partkey %')} AS network, CASE p_partkey % 3 WHEN 0 THEN ' Gold' WHEN 1 THEN ' Platinum' ELSE '' END AS tier, {_NAME.replace('(k ', '(p_partkey ')} AS n,
    translate(CAST(p_partkey - p_partkey % 24 + CASE WHEN p_partkey % 24 IN (22, 23) THEN 20 ELSE p_partkey % 24 END AS STRING), '0123456789', 'bcdfghjkmn') AS z FROM part) p"""


def _duck(sql: str) -> str:
    import re

    return re.sub(r"sha2\((.*?), 256\)", r"sha256(\1)", sql)


def _letters_sql(c: str, words: str) -> str:
    return rf"regexp_replace(regexp_replace(trim(regexp_replace(lower({c}), '{identity.INTRODUCED}', '')), '\b(?:{words})\b', ' ', 'g'), '[^a-z0-9]+', '', 'g')"


_ALL = rf"{identity.UNSPECIFIC}|{'|'.join(p for _, p in identity.TIERS)}"
_TIER_SQL = "CASE " + " ".join(rf"WHEN regexp_matches(lower({{0}}), '\b{p}\b') THEN '{t}'" for t, p in identity.TIERS) + " END"


@query(rf"""WITH c AS (SELECT card_id, lower(card_type) = 'credit' AS credit, coalesce(nullif({_letters_sql('card_name', _ALL)}, ''), nullif({_letters_sql('card_name', identity.UNSPECIFIC)}, '')) AS family, lower(network) AS network, {_TIER_SQL.format('card_name')} AS tier FROM ({_CARDS})),
q AS (SELECT request_id AS k, {_letters_sql('card_name', identity.UNSPECIFIC)} AS product, coalesce(nullif({_letters_sql('card_name', _ALL)}, ''), nullif({_letters_sql('card_name', identity.UNSPECIFIC)}, '')) AS family, lower(network) AS network, {_TIER_SQL.format('card_name')} AS tier, url, lower(submitted_hash) AS h1, final_hash AS h2 FROM ({_duck(_REQUESTS)})),
b AS (SELECT url_hash AS h, card_id FROM ({_duck(_KEYS)}) UNION SELECT submitted_hash, card_id FROM ({_duck(_SEEN)}) UNION SELECT final_hash, card_id FROM ({_duck(_SEEN)})),
bound AS (SELECT k, count(DISTINCT card_id) AS n, min(card_id) AS card FROM q JOIN b ON b.h = q.h1 OR b.h = q.h2 GROUP BY k),
named AS (SELECT k, card_id FROM q JOIN c ON credit AND c.family = q.family UNION SELECT k, a.card_id FROM q JOIN ({_ALIASES}) a ON {_letters_sql('alias', identity.UNSPECIFIC)} = product JOIN c ON c.card_id = a.card_id AND credit),
fits AS (SELECT n.k, count(*) AS found, count(*) FILTER (WHERE c.network IS NOT DISTINCT FROM q.network AND c.tier IS NOT DISTINCT FROM q.tier) AS same, min(c.card_id) FILTER (WHERE c.network IS NOT DISTINCT FROM q.network AND c.tier IS NOT DISTINCT FROM q.tier) AS card FROM named n JOIN c ON c.card_id = n.card_id JOIN q ON q.k = n.k GROUP BY n.k),
o AS (SELECT q.k, bound.card AS held, fits.card AS own, CASE WHEN length(product) < 2 OR product IN ({', '.join(f"'{x}'" for x in identity.BARE)}) THEN 'invalid_catalog_identity' WHEN url LIKE '%/a/' THEN 'noncanonical_source_url' WHEN url LIKE 'https://mystar%' THEN 'unapproved_domain' WHEN length(h1) <> 64 THEN 'invalid_url_hash'
  WHEN bound.n > 1 THEN 'conflicting_url_identity' WHEN bound.n = 1 THEN CASE WHEN NOT c.credit OR c.network IS NOT NULL AND c.network IS DISTINCT FROM q.network OR c.tier IS NOT NULL AND c.tier IS DISTINCT FROM q.tier OR NOT EXISTS (FROM named n WHERE n.k = q.k AND n.card_id = bound.card) OR c.credit IS NULL THEN 'url_identity_incompatible' ELSE 'bound' END
  WHEN same > 1 THEN 'ambiguous_catalog_identity' WHEN same = 1 THEN 'matched' WHEN found > 0 THEN 'strong_catalog_identity_conflict' ELSE 'new' END AS outcome FROM q LEFT JOIN bound ON bound.k = q.k LEFT JOIN fits ON fits.k = q.k LEFT JOIN c ON c.card_id = bound.card)
SELECT k AS request_id, CASE outcome WHEN 'bound' THEN held WHEN 'matched' THEN own END AS card_id, outcome FROM o""")
def dom15_identity_resolution(spark, sf_dir):
    """Which catalogue card each request is about: by bound url, by family and by alias, narrowed by network and tier."""
    part = view(spark, sf_dir, "part")
    tables = [spark.sql(sql.replace("FROM part", "FROM {p}"), p=part) for sql in (_REQUESTS, _CARDS, _ALIASES, _KEYS, _SEEN)]
    domains = spark.sql("SELECT 'Star Trust' AS issuer, 'star.example' AS domain")
    return identity.resolve_identities(*tables, domains)


#: What pages say of the card of their number: its name with or without its tier, and a network, which may be another's.
_TOLD = f"""SELECT page_id, n, CASE WHEN page_id % 5 = 1 THEN '' ELSE CASE page_id % 3 WHEN 0 THEN ' Gold' WHEN 1 THEN ' Platinum' ELSE '' END END AS tier, CASE WHEN page_id % 5 = 3 THEN 'RuPay' WHEN page_id % 5 = 4 THEN NULL ELSE {_SHORT.replace('k %', 'page_id %')} END AS network, html
  FROM (SELECT page_id, html, translate(CAST(page_id - page_id % 24 + CASE WHEN page_id % 24 IN (22, 23) THEN 20 ELSE page_id % 24 END AS STRING), '0123456789', 'bcdfghjkmn') AS n FROM pages) p"""


@query(f"""WITH c AS (SELECT card_id, regexp_extract(card_name, '^Zo([a-z]+)', 1) AS n, CASE WHEN card_name LIKE '% Gold %' THEN ' Gold' WHEN card_name LIKE '% Platinum %' THEN ' Platinum' END AS tier, network FROM ({_CARDS}) WHERE lower(card_type) = 'credit'), q AS ({_TOLD})
SELECT page_id, CASE WHEN count(card_id) = 1 THEN min(card_id) END AS card_id FROM q LEFT JOIN c ON c.n = q.n AND (c.tier IS NULL OR c.tier = q.tier) AND (c.network IS NULL OR c.network = q.network) GROUP BY page_id""")
def dom16_only_match(spark, sf_dir):
    """The one card of a catalogue that a whole page can be about."""
    from cardloom.operators.portfolio import only_match

    told = spark.sql(_TOLD.replace("FROM pages", "FROM {p}"), p=view(spark, sf_dir, "pages"))
    content = F.concat_ws(" ", F.lit("<h1>All about the Zo"), F.concat("n", "tier"), F.lit(" credit card</h1>"), F.concat(F.lit("<p>on "), "network", F.lit("</p>")), "html")
    pages_ = told.select("page_id", F.lit("Star trust ").alias("issuer"), F.regexp_replace(content, "the Zo ", "the Zo").alias("content"))
    cards = spark.sql(_CARDS.replace("FROM part", "FROM {p}"), p=view(spark, sf_dir, "part")).withColumnRenamed("bank", "issuer")
    return only_match(pages_, cards)


# ---------------------------------------------------------------- pages

_PLACE = "'https://www.star.example' || CASE page_id % 10 WHEN 0 THEN '/credit-cards/orbit-nova' WHEN 1 THEN '/cards/orbitnova' WHEN 2 THEN '/orbit-nova/fees' WHEN 3 THEN '/blog/orbit-nova' WHEN 4 THEN '/calculator/orbit' WHEN 5 THEN '/savings/plan' WHEN 6 THEN '/credit-card/orbit-nova' WHEN 7 THEN '/orbit-nova' WHEN 8 THEN '/orbit/nova-card' ELSE '/comet' END"


@query("""SELECT page_id, kind, CASE kind WHEN 'not_a_card' THEN 0.99 WHEN 'card_product' THEN 0.95 WHEN 'supporting_document' THEN 0.86 ELSE 0.2 END AS confidence, CASE WHEN kind IN ('card_product', 'supporting_document') THEN 'orbit nova' END AS name, CASE kind WHEN 'not_a_card' THEN 'quarantined_page_pattern' WHEN 'ambiguous' THEN 'insufficient_card_signals' ELSE '' END AS warnings
FROM (SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'card_product' WHEN 1 THEN 'card_product' WHEN 2 THEN 'supporting_document' WHEN 3 THEN 'not_a_card' WHEN 4 THEN 'not_a_card' WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'card_product' WHEN 7 THEN 'supporting_document' WHEN 8 THEN 'card_product' ELSE 'ambiguous' END AS kind FROM pages)""")
def dom26_page_class(spark, sf_dir):
    """What kind of page each is: whole pages, with the names of a product in their structure."""
    head = """CASE page_id % 10 WHEN 0 THEN '<title>Apply | Star Bank</title><h1>Orbit Nova Star Credit Card</h1>' WHEN 1 THEN '<h1>OrbitNova Credit Card.</h1>' WHEN 6 THEN '<h1>More for you</h1><title>Orbit Nova Credit Card - Star Bank</title>'
      WHEN 7 THEN '<script type="application/ld+json">{"@type":"Product","name":"Orbit Nova Card"}</script><h2>Our charges.</h2>' WHEN 8 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Thing","name":"x"},{"@type":"CreditCard","name":"Star Orbit Nova Card"}]}</script><h1>Why this credit card?</h1>' ELSE '<h1>Orbit Nova Credit Card</h1>' END"""
    rows = view(spark, sf_dir, "pages").selectExpr("page_id", "'Star Bank' AS issuer", f"{_PLACE} AS url", f"{head} || coalesce(html, '') AS html")
    return pages.page_classes(rows)


# ---------------------------------------------------------------- portfolios

_SPENT = "SELECT o_custkey AS user_id, o_orderkey AS txn_id, o_orderdate AS bought_at, CAST(o_totalprice AS DOUBLE) AS amount, CASE o_orderkey % 4 WHEN 0 THEN 'food' WHEN 1 THEN 'fuel' WHEN 2 THEN 'travel' END AS category FROM orders"
#: Six cards: a capped rule for a category and a lower one for all, with or without a cap, a rule for large purchases alone.
_RULES = """SELECT card_id, 'c' || CAST(card_id AS STRING) AS rule_id, CASE card_id % 3 WHEN 0 THEN 'food' WHEN 1 THEN 'fuel' ELSE 'travel' END AS category, 0.05E0 AS rate, CASE WHEN card_id < 4 THEN 4000.0E0 END AS cap, CASE WHEN card_id = 2 THEN 100000.0E0 END AS least FROM (SELECT DISTINCT p_partkey % 6 AS card_id FROM part) c
  UNION ALL SELECT card_id, 'a' || CAST(card_id AS STRING), CAST(NULL AS STRING), 0.01E0, CASE WHEN card_id % 2 = 1 THEN 900.0E0 END, CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT p_partkey % 6 AS card_id FROM part) c"""
_OFFERED = "SELECT c_custkey AS user_id, card_id, (c_custkey + card_id) % 5 = 0 AS is_owned, CAST(card_id * 500 AS DOUBLE) AS annual_fee FROM customer JOIN (SELECT DISTINCT p_partkey % 6 AS card_id, p_partkey % 2 AS half FROM part) c ON c_custkey % 2 = half"
#: Used in the last month: known of some rules, not known of others.
_USED = "SELECT user_id, card_id, 'c' || CAST(card_id AS STRING) AS rule_id, CAST('2001-08-01' AS DATE) AS cycle, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id % 3 * 1500 AS DOUBLE) END AS used FROM (SELECT c_custkey AS user_id, half + 2 AS card_id FROM customer JOIN (SELECT DISTINCT p_partkey % 2 AS half FROM part) h ON c_custkey % 2 = half) o WHERE user_id % 7 < 4"
#: The gain of a month by its sums: as each card has one rule for a category and one for all, the order of purchases is without effect.
_FOLD = "least({cap}, 0.05 * s) AS {n}1, least(coalesce(acap, 1e300), 0.01 * (w - least({cap}, 0.05 * s) / 0.05)) AS {n}2"


@query(f"""WITH t AS (SELECT *, date_trunc('month', bought_at)::DATE AS cycle FROM ({_SPENT}) WHERE bought_at > TIMESTAMP '{CLOCK}' - INTERVAL 90 DAY AND bought_at <= TIMESTAMP '{CLOCK}' AND amount > 0),
r AS (SELECT card_id, max(category) AS category, max(cap) FILTER (WHERE rule_id LIKE 'c%') AS cap, max(least) AS least_, max(cap) FILTER (WHERE rule_id LIKE 'a%') AS acap FROM ({_RULES}) GROUP BY card_id), o AS ({_OFFERED}), u AS ({_USED}),
g AS (SELECT o.user_id, o.card_id, t.cycle, r.cap, r.acap, sum(CASE WHEN t.category = r.category AND amount >= coalesce(r.least_, 0) THEN amount ELSE 0 END) AS s, sum(amount) AS w FROM o JOIN r USING (card_id) JOIN t USING (user_id) GROUP BY ALL),
k AS (SELECT g.*, CASE WHEN cap IS NULL THEN 1e300 WHEN u.user_id IS NULL THEN cap WHEN used IS NULL THEN 0 ELSE greatest(cap - used, 0) END AS lo, CASE WHEN cap IS NULL THEN 1e300 ELSE greatest(cap - coalesce(used, 0), 0) END AS hi FROM g LEFT JOIN u ON u.user_id = g.user_id AND u.card_id = g.card_id AND u.cycle = g.cycle),
m AS (SELECT user_id, card_id, {_FOLD.format(cap='lo', n='l')}, {_FOLD.format(cap='hi', n='h')} FROM k), f AS (SELECT user_id, card_id, sum(l1 + l2) AS low, sum(h1 + h2) AS high FROM m GROUP BY ALL)
SELECT o.user_id, o.card_id, is_owned, round(coalesce(low, 0), 2) AS low, round(coalesce(high, 0), 2) AS high, round(coalesce(low, 0) * (365.0::DOUBLE / 90.0::DOUBLE) - CASE WHEN is_owned THEN 0 ELSE annual_fee END, 2) AS year_low, round(coalesce(high, 0) * (365.0::DOUBLE / 90.0::DOUBLE) - CASE WHEN is_owned THEN 0 ELSE annual_fee END, 2) AS year_high, coalesce(abs(low - high) < 1e-6, true) AS certain
FROM o LEFT JOIN f ON f.user_id = o.user_id AND f.card_id = o.card_id""")
def dom48_portfolio_replay(spark, sf_dir):
    """What each candidate card would have earned its user in ninety days: purchases folded through its rules, caps and cycles."""
    table = lambda sql, **of: spark.sql(sql.replace("FROM orders", "FROM {o}").replace("FROM part", "FROM {p}").replace("FROM customer", "FROM {c}"), **of)
    orders, part, customer = (view(spark, sf_dir, t) for t in ("orders", "part", "customer"))
    out = replay.portfolio_values(table(_SPENT, o=orders).withColumnRenamed("bought_at", "at"), table(_OFFERED, c=customer, p=part), table(_RULES, p=part), table(_USED, c=customer, p=part), CLOCK)
    return out.withColumns({c: F.round(c, 2) for c in ("low", "high", "year_low", "year_high")})
