"""Queries of crawls, histories and work queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import crawl as W
from cardloom.plans.register import query
from cardloom.sources.tables import view

#: Some leases still run and some have ended.
NOW = "2024-01-20 00:00:00"


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY card_id, semantic_hash ORDER BY observed_at DESC, turn DESC) AS n FROM observations), k AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY observed_at DESC, semantic_hash) AS place FROM o WHERE n = 1)
SELECT card_id, semantic_hash, turn, place FROM k WHERE place <= 24""")
def win3_history_24(spark, sf_dir):
    """The newest observation of each meaning, 24 of them at most."""
    return W.newest_per_key(view(spark, sf_dir, "observations"), "card_id", "semantic_hash", "observed_at", "turn").select("card_id", "semantic_hash", "turn", "place")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY attempted_at DESC, page_id DESC) AS n, count(*) OVER (PARTITION BY source_key) AS c FROM attempts), d AS (SELECT source_key, count(DISTINCT attempted_at) AS d FROM attempts GROUP BY source_key)
SELECT l.source_key, CASE WHEN c = d THEN status END AS status, page_id FROM l JOIN d USING (source_key) WHERE n = 1""")
def win10_terminal_attempt(spark, sf_dir):
    return W.terminal_attempts(view(spark, sf_dir, "attempts"), "source_key").select("source_key", "status", "page_id")


_ROLES = (
    "CASE WHEN page_id % 40 < 10 AND page_id % 10 <> 4 OR page_id % 40 = 13 THEN 'primary' WHEN page_id % 40 < 25 THEN 'supporting' ELSE 'required_supporting' END AS role",
    "CASE WHEN page_id % 10 = 5 THEN page_id % 80 ELSE page_id % 40 END AS identity", "CASE WHEN page_id % 12 = 0 THEN 'empty_shell' ELSE error_code END AS code",
)


@query(f"""WITH a AS (SELECT *, page_id % 10 AS crawl, {', '.join(_ROLES)} FROM attempts), t AS (SELECT crawl, role, source_key, count(DISTINCT identity) AS ids, count(*) AS n, max(attempted_at) AS at FROM a GROUP BY 1, 2, 3),
l AS (SELECT t.crawl, t.role, t.source_key, t.ids, t.n, count(*) AS same, min(a.status) AS status, min(a.http_status) AS http, min(a.code) AS code FROM t JOIN a ON a.crawl = t.crawl AND a.role = t.role AND a.source_key = t.source_key AND a.attempted_at = t.at GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT *, same = 1 AND status = 'fetched' AND http BETWEEN 200 AND 299 AS ok, role = 'supporting' AND same = 1 AND status = 'failed' AND code IN ('empty_shell') AS open FROM l),
g AS (SELECT crawl, max(ids) AS ids, max(n) AS n, count(*) FILTER (WHERE role = 'primary') AS p, count(*) FILTER (WHERE role = 'primary' AND ok) AS f, arg_min(code, source_key) FILTER (WHERE open) AS fallback, count(*) FILTER (WHERE role = 'required_supporting' AND NOT ok) AS lacking FROM k GROUP BY crawl),
r AS (SELECT crawl, CASE WHEN ids > 1 THEN 'final_resource_identity_conflict' WHEN n > 24 THEN 'attempt_history_overflow' WHEN p = 0 THEN 'missing_primary' WHEN p > 1 THEN 'multiple_primary' WHEN f = 0 THEN 'primary_incomplete' WHEN fallback IS NOT NULL THEN fallback WHEN lacking > 0 THEN 'required_supporting_incomplete' ELSE 'complete' END AS reason FROM g)
SELECT crawl, reason = 'complete' AS complete, reason FROM r""")
def dom29_completeness(spark, sf_dir):
    """Whether crawls are complete, and the first reason why not."""
    rows = view(spark, sf_dir, "attempts").selectExpr("*", "page_id % 10 AS crawl", *_ROLES).drop("error_code").withColumnRenamed("code", "error_code")
    return W.crawl_reason(rows, "crawl")


@query("""WITH g AS (SELECT card_id, max(CASE WHEN card_id % 5 = 0 THEN DATE '2001-06-15' WHEN card_id % 5 = 1 THEN DATE '2001-12-31' END) AS e, count(DISTINCT observed_at) AS n, min(observed_at) AS f, max(observed_at) AS l FROM observations WHERE crawl_complete GROUP BY card_id),
r AS (SELECT card_id, CASE WHEN e < DATE '2001-08-15' THEN 'explicit_past_end_date' WHEN e IS NOT NULL THEN 'explicit_end_date_not_past' WHEN l > TIMESTAMP '2001-08-15 12:00:00' THEN 'invalid_observation_history' WHEN n >= 2 AND l >= f + INTERVAL 7 DAY THEN 'two_complete_observations' ELSE 'insufficient_complete_observations' END AS reason FROM g)
SELECT card_id, reason IN ('explicit_past_end_date', 'two_complete_observations') AS eligible, reason FROM r""")
def dt11_retirement(spark, sf_dir):
    end = F.when(F.col("card_id") % 5 == 0, F.lit("2001-06-15").cast("date")).when(F.col("card_id") % 5 == 1, F.lit("2001-12-31").cast("date"))
    return W.retirement(view(spark, sf_dir, "observations").where("crawl_complete"), "card_id", end, "2001-08-15 12:00:00")


@query(f"""SELECT id, CASE WHEN staging_id IS NOT NULL THEN 'staged' WHEN attempt_count >= 3 THEN 'review_required' ELSE 'failed' END AS status,
CASE WHEN staging_id IS NULL AND attempt_count < 3 THEN TIMESTAMP '{NOW}' + CASE WHEN attempt_count = 1 THEN INTERVAL 15 MINUTE ELSE INTERVAL 60 MINUTE END END AS next_retry_at FROM jobs WHERE status = 'leased' AND lease_expires_at <= TIMESTAMP '{NOW}'""")
def que1_expired_leases(spark, sf_dir):
    return W.expired_leases(view(spark, sf_dir, "jobs"), NOW)


@query("""WITH i AS (SELECT lower(trim(issuer)) AS k, max(lease_expires_at) FILTER (WHERE status = 'leased') AS busy, arg_min({'id': id, 'issuer': issuer, 'card_name': card_name}, (card_name, created_at, id)) FILTER (WHERE status IN ('queued', 'failed') AND run_mode = 'manual') AS c FROM jobs WHERE parser_version = 'v6' GROUP BY 1),
t AS (SELECT DISTINCT busy AS moment FROM i WHERE busy IS NOT NULL), j AS (SELECT moment, arg_min(c, k) AS c FROM t LEFT JOIN i ON (busy IS NULL OR busy <= moment) AND c IS NOT NULL GROUP BY moment)
SELECT CAST(moment AS VARCHAR) AS moment, c.id AS id, c.issuer AS issuer, c.card_name AS card_name FROM j""")
def que1_claim_plan(spark, sf_dir):
    """The job to claim at each moment at which an issuer comes free; busy issuers are passed over."""
    return W.claim_timeline(view(spark, sf_dir, "jobs"), "manual", "v6").withColumn("moment", F.col("moment").cast("string"))


@query("SELECT id, created_at + INTERVAL 7 DAY AS due FROM jobs WHERE status = 'succeeded' AND created_at + INTERVAL 7 DAY <= TIMESTAMP '2024-01-20' ORDER BY created_at, id LIMIT 200")
def que2_due_requeue(spark, sf_dir):
    """Jobs due again, oldest first, two hundred at a time."""
    due = F.col("created_at") + F.expr("INTERVAL '7' DAY")
    rows = view(spark, sf_dir, "jobs").where((F.col("status") == "succeeded") & (due <= F.lit("2024-01-20").cast("timestamp_ntz")))
    return rows.orderBy("created_at", "id").limit(200).select("id", due.alias("due"))


@query("WITH o AS (SELECT issuer, min(card_name) AS url FROM jobs GROUP BY issuer), n AS (SELECT *, row_number() OVER (ORDER BY issuer) - 1 AS t, count(*) OVER () AS c FROM o) SELECT issuer, url FROM n WHERE t = 17 % c")
def srt7_rotation(spark, sf_dir):
    return W.rotation(view(spark, sf_dir, "jobs").select("issuer", F.col("card_name").alias("url")), 17)


@query()
def srt8_pilot(spark, sf_dir):
    """The first choice of five active jobs, one of each profile, from at least three issuers; tested by brute force."""
    k = F.col("id") % 5
    profile = F.get(F.array(*[F.lit(p) for p in W.PROFILES]), k.cast("int"))
    jobs = view(spark, sf_dir, "jobs").select("id", "issuer", profile.alias("profile"), (F.col("status") != "failed").alias("active"), (F.col("id") % 7 != 0).alias("approved"))
    return W.pilot(jobs)


@query("""WITH s AS (SELECT page_id, url, CAST(contains(lower(url), 'www') AS INT) + CAST(contains(lower(url), 'en') AS INT) AS h FROM pages) SELECT page_id, h * 100 + CASE WHEN h = 2 THEN 1000 ELSE 0 END - length(url) / 1000.0::DOUBLE AS score FROM s ORDER BY score DESC, page_id LIMIT 50""")
def srt4_url_rank(spark, sf_dir):
    rows = view(spark, sf_dir, "pages").select("page_id", W.url_score(F.col("url"), ["www", "en"]).alias("score"))
    return rows.orderBy(F.desc("score"), "page_id").limit(50)


@query("""WITH e AS (SELECT p_partkey AS k, 'fee' AS field, CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS existing FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part),
p AS (SELECT p_partkey AS k, 'fee' AS field, CAST(p_size % 20 AS VARCHAR) AS value, CASE WHEN p_partkey % 3 = 0 THEN 0.8 ELSE 0.95 END AS confidence FROM part UNION ALL SELECT p_partkey, 'type', lower(p_type), 0.99 FROM part)
SELECT * FROM (SELECT p.k, p.field, CASE WHEN coalesce(existing, '') = '' THEN 'backfill' WHEN lower(existing) <> lower(value) THEN 'conflict' END AS change FROM p LEFT JOIN e ON e.k = p.k AND e.field = p.field WHERE confidence >= 0.9) WHERE change IS NOT NULL""")
def dom25_field_diff(spark, sf_dir):
    part = view(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    old = part.select("k", F.expr("stack(2, 'fee', CASE WHEN p_size % 4 = 0 THEN '' ELSE CAST(p_size AS STRING) END, 'type', p_type) AS (field, existing)"))
    new = part.select("k", F.expr("stack(2, 'fee', CAST(p_size % 20 AS STRING), CASE WHEN p_partkey % 3 = 0 THEN 0.8D ELSE 0.95D END, 'type', lower(p_type), 0.99D) AS (field, value, confidence)"))
    return W.field_changes(old, new, "k")


@query(r"""WITH l AS (SELECT doc_id, i - 1 AS line_no, arr[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents), unnest(range(1, len(arr) + 1)) AS t(i))
SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '(?i)([0-9]+(?:\.[0-9]+)?)\s*%\s*cash\s*back') THEN 'cashback' WHEN regexp_matches(line, '(?i)fee\s+waive[rd][^0-9]*(?:rs\.?|inr|₹)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)') THEN 'fee_waiver' WHEN regexp_matches(line, '(?i)([0-9]+(?:\.[0-9]+)?)x?\s*(?:reward\s+)?points') THEN 'points'
WHEN regexp_matches(line, '(?i)([0-9]+(?:\.[0-9]+)?)\s*%\s*(?:off|discount)') THEN 'discount' WHEN regexp_matches(line, '(?i)(?:up\s+to|maximum(?:\s+of)?|capped\s+at)\s*(?:rs\.?|inr|₹)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)') THEN 'cap' ELSE 'licence' END AS kind,
CASE WHEN regexp_matches(line, '(?i)licen[sc]ed\s+under\s+(?:the\s+)?([a-z-]+)') THEN regexp_extract(line, '(?i)licen[sc]ed\s+under\s+(?:the\s+)?([a-z-]+)', 1) END AS value
FROM l WHERE regexp_matches(line, '(?i)licen[sc]ed\s+under\s+(?:the\s+)?([a-z-]+)') OR regexp_matches(line, '(?i)([0-9]+(?:\.[0-9]+)?)\s*%\s*cash\s*back|fee\s+waive[rd][^0-9]*(?:rs\.?|inr|₹)?\s*[0-9]|([0-9]+(?:\.[0-9]+)?)x?\s*(?:reward\s+)?points|([0-9]+(?:\.[0-9]+)?)\s*%\s*(?:off|discount)|(?:up\s+to|maximum(?:\s+of)?|capped\s+at)\s*(?:rs\.?|inr|₹)?\s*[0-9]')""")
def dom18_offer_lines(spark, sf_dir):
    """Lines that state an offer or a licence, by the first pattern that fits."""
    return W.offer_lines(view(spark, sf_dir, "documents"), "doc_id", "text")


def _several(test, value, *keys):
    over = f"OVER (PARTITION BY card_id, {', '.join(keys)})"
    v = f"CASE WHEN {test} THEN {value} END"
    return f"coalesce(min({v}) {over} <> max({v}) {over}, false)"


def _n(test, *keys):
    return f"count(*) FILTER (WHERE {test}) OVER (PARTITION BY card_id, {', '.join(keys)})"


_SPREAD = "CASE WHEN o IS NULL AND coalesce(max(CASE WHEN o = 'conflicting_proposed_terms' THEN 1 END) OVER (PARTITION BY card_id, side, dedupe_key), 0) = 1 THEN 'conflicting_proposed_terms' ELSE o END"
_C, _P, _FIT = "o IS NULL AND side = 'c'", "o IS NULL AND side = 'p'", "side = 'p' AND v6 AND NOT torn"


@query(f"""WITH a AS (SELECT *, CASE WHEN {_several("side = 'c'", 'condition', 'dedupe_key')} OR {_several("side = 'p'", 'condition', 'dedupe_key')} THEN 'dedupe_key_condition_mismatch' END AS o,
  {_several("side = 'p'", 'condition', 'semantic_key')} AND {_several("side = 'p'", 'source', 'semantic_key')} AS torn FROM terms),
b AS (SELECT * REPLACE (CASE WHEN o IS NULL AND torn THEN 'conflicting_proposed_terms' ELSE o END AS o) FROM a), b2 AS (SELECT * REPLACE ({_SPREAD} AS o) FROM b),
c AS (SELECT * REPLACE (CASE WHEN o IS NULL AND {_several(_FIT, 'semantic_key', 'subject')} AND {_several(_FIT, 'source', 'subject')} AND (({_FIT}) OR side = 'c') THEN 'conflicting_proposed_terms' ELSE o END AS o) FROM b2), c2 AS (SELECT * REPLACE ({_SPREAD} AS o) FROM c),
d AS (SELECT * REPLACE (CASE WHEN o IS NULL AND {_n(_C, 'dedupe_key')} > 0 AND {_n(_P, 'dedupe_key')} > 0 THEN CASE WHEN NOT {_several('o IS NULL', 'condition', 'dedupe_key')} THEN 'unchanged' ELSE 'dedupe_key_condition_mismatch' END ELSE o END AS o) FROM c2),
e AS (SELECT * REPLACE (CASE WHEN o IS NULL AND (side = 'c' AND NOT starts_with(dedupe_key, 'card-benefit-v2:') OR side = 'p' AND v6) AND {_n(_C + " AND NOT starts_with(dedupe_key, 'card-benefit-v2:')", 'condition')} = 1 AND {_n(_P + ' AND v6', 'condition')} = 1 THEN 'identity_migration' ELSE o END AS o) FROM d),
f AS (SELECT *, {_n(_C, 'semantic_key')} AS nc, {_n(_P, 'semantic_key')} AS np FROM e),
g AS (SELECT * EXCLUDE (nc, np) REPLACE (CASE WHEN o IS NULL AND nc > 0 AND np > 0 THEN CASE WHEN nc = 1 AND np = 1 THEN 'modification' ELSE 'ambiguous_benefit_match' END ELSE o END AS o) FROM f),
h AS (SELECT *, CASE WHEN o IS NULL AND side = 'p' AND {_n(_P, 'semantic_key')} > 1 AND {_several(_P, 'source', 'semantic_key')} THEN 'conflicting_proposed_terms' ELSE o END AS p FROM g)
SELECT side, id, card_id, coalesce(p, CASE WHEN side = 'p' THEN 'addition' ELSE 'possible_removal' END) AS outcome FROM h""")
def dom23_benefit_diff(spark, sf_dir):
    """What becomes of every current and proposed benefit."""
    from cardloom.operators.benefit_diff import diff

    return diff(view(spark, sf_dir, "terms")).select("side", "id", "card_id", "outcome")
