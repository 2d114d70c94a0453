"""Queries of data quality, grouped summaries and operator views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import cards as C
from cardloom.operators import quality as Q
from cardloom.operators import spend as S
from cardloom.plans.cards import _ACTIVE, AS_OF
from cardloom.plans.register import query
from cardloom.sources.tables import view


@query("SELECT issuer, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'succeeded') AS succeeded, bool_and(attempt_count < 4) AS all_tried_little, string_agg(DISTINCT parser_version, ',' ORDER BY parser_version) AS parsers FROM jobs GROUP BY issuer")
def agg19_conditional(spark, sf_dir):
    return view(spark, sf_dir, "jobs").groupBy("issuer").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "succeeded").alias("succeeded"), F.bool_and(F.col("attempt_count") < 4).alias("all_tried_little"), F.array_join(F.array_sort(F.collect_set("parser_version")), ",").alias("parsers"))


@query("SELECT dedupe_key, count(*) AS n FROM benefits GROUP BY dedupe_key HAVING count(*) > 1")
def agg20_having_dups(spark, sf_dir):
    return Q.duplicates(view(spark, sf_dir, "benefits"), F.col("dedupe_key"))


@query("SELECT regexp_replace(lower(trim(title)), '[^a-z0-9]+', '', 'g') AS name, coalesce(lower(category), '') AS cat, count(*) AS n FROM benefits GROUP BY 1, 2 HAVING count(*) > 1")
def agg21_identity_dups(spark, sf_dir):
    return Q.duplicates(view(spark, sf_dir, "benefits"), F.regexp_replace(F.lower(F.trim("title")), "[^a-z0-9]+", "").alias("name"), F.coalesce(F.lower("category"), F.lit("")).alias("cat"))


@query("SELECT status, parser_version, run_mode, count(*) AS n FROM jobs GROUP BY ALL")
def agg22_job_groups(spark, sf_dir):
    return view(spark, sf_dir, "jobs").groupBy("status", "parser_version", "run_mode").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (WHERE status IN ('queued', 'failed')) AS backlog, count(*) FILTER (WHERE status = 'leased') AS running, max(created_at) FILTER (WHERE status = 'succeeded') AS last_success, CASE WHEN count(*) FILTER (WHERE status = 'failed') * 2 > count(*) THEN 'failing' WHEN count(*) FILTER (WHERE status = 'queued') > 1000 THEN 'behind' ELSE 'healthy' END AS health FROM jobs")
def agg27_pipeline_health(spark, sf_dir):
    status = F.col("status")
    health = F.when(F.count_if(status == "failed") * 2 > F.count("*"), F.lit("failing")).when(F.count_if(status == "queued") > 1000, F.lit("behind")).otherwise(F.lit("healthy"))
    return view(spark, sf_dir, "jobs").agg(F.count_if(status.isin("queued", "failed")).alias("backlog"), F.count_if(status == "leased").alias("running"), F.max(F.when(status == "succeeded", F.col("created_at"))).alias("last_success"), health.alias("health"))


@query("""WITH c AS (SELECT user_id, count(*) AS cards FROM user_cards GROUP BY user_id), s AS (SELECT user_id, count(*) AS statements, CAST(max(statement_date) AS VARCHAR) AS last_statement FROM statements GROUP BY user_id), t AS (SELECT user_id, count(*) AS transactions FROM transactions GROUP BY user_id)
SELECT c_custkey AS user_id, coalesce(cards, 0) AS cards, coalesce(statements, 0) AS statements, last_statement, coalesce(transactions, 0) AS transactions FROM customer LEFT JOIN c ON c.user_id = c_custkey LEFT JOIN s ON s.user_id = c_custkey LEFT JOIN t ON t.user_id = c_custkey""")
def agg28_customer_overview(spark, sf_dir):
    """Each side is counted by user before it is joined."""
    out = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    for name, column in (("user_cards", "cards"), ("statements", "statements"), ("transactions", "transactions")):
        counts = view(spark, sf_dir, name).groupBy("user_id").agg(F.count("*").alias(column), *([F.max("statement_date").cast("string").alias("last_statement")] if name == "statements" else []))
        out = out.join(counts, "user_id", "left")
    return out.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cards", "statements", "transactions")], "last_statement")


@query("SELECT issuer, card_name, status AS reason, count(*) AS n FROM jobs WHERE status IN ('failed', 'review') GROUP BY ALL")
def agg30_issue_groups(spark, sf_dir):
    return view(spark, sf_dir, "jobs").where("status IN ('failed', 'review')").groupBy("issuer", "card_name", F.col("status").alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT b.category, count(*) AS mappings, count(DISTINCT m.card_id) AS cards FROM card_benefit_mapping m JOIN benefits b ON b.id = m.benefit_id WHERE {_ACTIVE} GROUP BY b.category")
def agg33_benefit_families(spark, sf_dir):
    active = C.active_benefits(view(spark, sf_dir, "benefits"), AS_OF).select(F.col("id").alias("benefit_id"), "category")
    return view(spark, sf_dir, "card_benefit_mapping").join(active, "benefit_id").groupBy("category").agg(F.count("*").alias("mappings"), F.count_distinct("card_id").alias("cards"))


@query("SELECT card_id, '[' || string_agg('{\"benefit_id\":' || benefit_id || ',\"priority\":' || display_priority || '}', ',' ORDER BY benefit_id) || ']' AS document FROM card_benefit_mapping GROUP BY card_id")
def agg34_ordered_document(spark, sf_dir):
    """Each card's mappings as one JSON text, in order; a card has few."""
    rows = F.array_sort(F.collect_list(F.struct("benefit_id", F.col("display_priority").alias("priority"))))
    return view(spark, sf_dir, "card_benefit_mapping").groupBy("card_id").agg(F.to_json(rows).alias("document"))


@query("SELECT issuer, count(*) AS n, sha256(count(*) || ':' || sum(CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15) AS BIGINT))) AS row_hash FROM jobs GROUP BY issuer")
def agg35_fingerprint(spark, sf_dir):
    """A fingerprint of each group's rows that does not hang on their order, so that no group is gathered."""
    part = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    rows = view(spark, sf_dir, "jobs").groupBy("issuer").agg(F.count("*").alias("n"), F.sum(part).alias("s"))
    return rows.select("issuer", "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("row_hash"))


@query("""WITH k AS (SELECT id, lower(trim(title)) || '|' || lower(category) || '|' || p_size AS k FROM benefits), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS n FROM k)
SELECT id, CASE WHEN n = 1 THEN k ELSE 'legacy:' || id END AS canonical_key FROM r""")
def win1_canonical_key(spark, sf_dir):
    return Q.canonical_key(view(spark, sf_dir, "benefits"), [F.lower(F.trim("title")), F.lower("category"), F.col("p_size").cast("string")], ["id"], "id")


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS n FROM conversations) SELECT conv_id, turn AS revision FROM r WHERE n = 1 AND role <> 'assistant'""")
def win2_latest_revision(spark, sf_dir):
    """The latest revision is chosen before the retired ones are dropped."""
    top = view(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("t"))
    last = view(spark, sf_dir, "conversations").join(top.select("conv_id", F.col("t.turn").alias("turn")), ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return last.where("role <> 'assistant'").select("conv_id", F.col("turn").alias("revision"))


_REVIEWS = "SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'pending' ELSE 'approved' END AS status, CAST('2024-01-01 00:00:00' AS TIMESTAMP) + CAST(page_id % 700 AS INT) * INTERVAL '1' HOUR AS created_at FROM pages"
_WORK = """SELECT id, CASE WHEN status = 'review' THEN 'review_required' WHEN status = 'succeeded' AND id % 9 = 0 THEN 'quarantined' WHEN status = 'succeeded' AND id % 9 = 1 THEN 'staged' ELSE status END AS status, card_id, CASE WHEN id % 10 = 3 THEN 'catalog-v1' ELSE 'benefits-v5' END AS parser_version,
  CASE WHEN run_mode = 'automatic' THEN 'scheduled' ELSE run_mode END AS run_mode, CASE WHEN id % 4 = 1 THEN CAST('2024-03-01 00:00:00' AS TIMESTAMP) END AS next_retry_at, created_at FROM jobs"""
_SHOWN = "SELECT id AS card_id, CASE WHEN id % 13 = 0 THEN ' x ' ELSE bank END AS bank, card_name FROM card_catalog"
_PAUSED = "SELECT true AS is_paused, max(created_at) AS updated_at FROM jobs"
_SAID = """SELECT CAST(conv_id * 100 + turn AS STRING) AS id, CASE conv_id % 4 WHEN 0 THEN 'statement_processing' WHEN 1 THEN 'card_data' WHEN 2 THEN 'recommendation' END AS feature_key, CASE WHEN conv_id % 7 = 0 THEN 'critical' WHEN conv_id % 7 = 1 THEN 'high' WHEN conv_id % 7 = 2 THEN 'low' END AS severity,
  CASE WHEN role = 'user' THEN 'pending' ELSE 'reviewed' END AS review_status, CAST('2024-01-15 00:00:00' AS TIMESTAMP) + CAST(turn * 31 + conv_id % 17 AS INT) * INTERVAL '1' HOUR AS created_at FROM conversations"""
_SECONDS = "greatest(CAST(floor(epoch(TIMESTAMP '2024-02-01' - {})) AS BIGINT), 0)"
_NAMED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_INBOX = f"""WITH r AS ({_REVIEWS}), w AS ({_WORK}), s AS ({_SHOWN}), p AS ({_PAUSED}), f AS ({_SAID}),
i AS (SELECT 'card-identity:' || id AS id, 'card_identity_review' AS type, 'normal' AS severity, 'Review card identity' AS title, status AS source_status, {_SECONDS.format('created_at')} AS age_seconds FROM r WHERE status = 'pending'
UNION ALL SELECT 'benefit-enrichment:' || w.id, 'benefit_enrichment_review', CASE w.status WHEN 'staged' THEN 'normal' ELSE 'high' END, CASE w.status WHEN 'failed' THEN 'Recover benefits' WHEN 'quarantined' THEN 'Review quarantined benefits' ELSE 'Review benefits' END
  || CASE WHEN length({_NAMED.format('bank')}) >= 2 AND length({_NAMED.format('card_name')}) >= 2 THEN ': ' || {_NAMED.format('bank')} || ' — ' || {_NAMED.format('card_name')} ELSE '' END, w.status, {_SECONDS.format('created_at')} FROM w JOIN s ON s.card_id = w.card_id WHERE w.status IN ('review_required', 'failed', 'quarantined', 'staged') AND parser_version <> 'catalog-v1'
UNION ALL SELECT 'system:benefit_enrichment_scheduled:paused', 'paused_pipeline', 'critical', 'Scheduled benefit enrichment is paused', 'paused', {_SECONDS.format('updated_at')} FROM p WHERE EXISTS (SELECT 1 FROM w WHERE run_mode = 'scheduled' AND status IN ('queued', 'failed') AND parser_version <> 'catalog-v1' AND next_retry_at IS NULL)
UNION ALL SELECT 'feedback:' || id, 'feedback_review', CASE WHEN severity IN ('critical', 'high') THEN severity ELSE 'normal' END, 'Review ' || CASE feature_key WHEN 'statement_processing' THEN 'statement processing' WHEN 'card_data' THEN 'card data' WHEN 'recommendation' THEN 'recommendation' ELSE 'AI output' END || ' feedback', review_status, {_SECONDS.format('created_at')} FROM f WHERE review_status = 'pending')"""


def _inbox(spark, sf_dir):
    from cardloom.operators import inbox

    def table(sql: str, name: str):
        return spark.sql(sql.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)").replace(f"FROM {name}", "FROM {t}"), t=view(spark, sf_dir, name))

    return inbox.items(table(_REVIEWS, "pages"), table(_WORK, "jobs"), table(_SHOWN, "card_catalog"), table(_PAUSED, "jobs"), table(_SAID, "conversations"), "2024-02-01 00:00:00")


@query(f"{_INBOX} SELECT id, type, severity, title, source_status, age_seconds FROM i ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, age_seconds DESC, id LIMIT 100")
def srt2_inbox(spark, sf_dir):
    """The hundred most pressing items of all five sources: severity, then age."""
    from cardloom.operators import inbox

    return inbox.ranked(_inbox(spark, sf_dir))


@query(f"{_INBOX} SELECT id, type, severity, title, source_status, age_seconds FROM i")
def dom41_inbox_items(spark, sf_dir):
    """Every item of the inbox."""
    return _inbox(spark, sf_dir)


_WAIT = """w AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '1-2' WHEN 1 THEN '3-6' WHEN 2 THEN '7+' WHEN 3 THEN 'legacy-6-plus' END AS cards, CASE c_custkey % 4 WHEN 0 THEN 'under-25k' WHEN 1 THEN '25k-50k' WHEN 2 THEN '50k-1l' ELSE '1l-plus' END AS band,
CASE c_custkey % 3 WHEN 0 THEN 'maximize_rewards' WHEN 1 THEN 'track_benefits' ELSE 'simplify_card_choices' END AS goal, CASE WHEN c_custkey % 6 = 0 THEN c_nationkey END AS extra FROM customer)"""


@query(f"""WITH {_WAIT} SELECT id, CASE WHEN cards IS NULL OR cards = 'legacy-6-plus' THEN 0 ELSE CASE cards WHEN '3-6' THEN 45 WHEN '7+' THEN 30 ELSE 15 END + CASE band WHEN '1l-plus' THEN 25 WHEN '50k-1l' THEN 20 WHEN '25k-50k' THEN 15 ELSE 10 END
+ CASE goal WHEN 'maximize_rewards' THEN 20 WHEN 'track_benefits' THEN 15 ELSE 10 END + coalesce(extra, 0) END AS rank_score, coalesce(cards = 'legacy-6-plus', false) AS needs_requalification FROM w""")
def srt3_waitlist_score(spark, sf_dir):
    """Seven and more cards score below three to six; old answers score nothing."""
    k = F.col("c_custkey")
    pick = lambda c, *pairs: F.coalesce(*[F.when(c == n, F.lit(v)) for n, v in pairs])
    cards = pick(k % 5, (0, "1-2"), (1, "3-6"), (2, "7+"), (3, "legacy-6-plus"))
    band = pick(k % 4, (0, "under-25k"), (1, "25k-50k"), (2, "50k-1l"), (3, "1l-plus"))
    goal = pick(k % 3, (0, "maximize_rewards"), (1, "track_benefits"), (2, "simplify_card_choices"))
    rows = view(spark, sf_dir, "customer").select(k.alias("id"), cards.alias("cards"), band.alias("band"), goal.alias("goal"), F.when(k % 6 == 0, F.col("c_nationkey")).alias("extra"))
    points = pick(F.col("cards"), ("3-6", 45), ("7+", 30), ("1-2", 15)) + pick(F.col("band"), ("1l-plus", 25), ("50k-1l", 20), ("25k-50k", 15), ("under-25k", 10)) + pick(F.col("goal"), ("maximize_rewards", 20), ("track_benefits", 15), ("simplify_card_choices", 10))
    old = F.col("cards").isNull() | (F.col("cards") == "legacy-6-plus")
    return rows.select("id", F.when(old, F.lit(0)).otherwise(points + F.coalesce("extra", F.lit(0))).alias("rank_score"), F.coalesce(F.col("cards") == "legacy-6-plus", F.lit(False)).alias("needs_requalification"))


@query("SELECT id, title, valid_until FROM (SELECT id, title, CAST(valid_until AS VARCHAR) AS valid_until FROM benefits ORDER BY valid_until DESC NULLS FIRST, title, id LIMIT 60)")
def srt6_null_order(spark, sf_dir):
    return S.page(view(spark, sf_dir, "benefits").select("id", "title", F.col("valid_until").cast("string").alias("valid_until")), [F.desc_nulls_first("valid_until"), "title", "id"], 60)


@query("SELECT id, array_to_string(list_filter([CASE WHEN network IS NULL THEN 'missing_network' END, CASE WHEN bank <> trim(lower(bank)) THEN 'noncanonical_bank' END, CASE WHEN is_discontinued THEN 'discontinued' END], lambda x: x IS NOT NULL), ',') AS reasons FROM card_catalog")
def set4_hygiene_reasons(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("network").isNull(), F.lit("missing_network")), F.when(F.col("bank") != F.trim(F.lower("bank")), F.lit("noncanonical_bank")), F.when(F.col("is_discontinued"), F.lit("discontinued"))))
    return view(spark, sf_dir, "card_catalog").select("id", F.array_join(reasons, ",").alias("reasons"))


_CHECKS = {
    "catalog_discontinued": ("SELECT id FROM card_catalog WHERE is_discontinued", lambda v: v("card_catalog").where("is_discontinued")),
    "benefits_on_many_cards": ("SELECT benefit_id FROM card_benefit_mapping GROUP BY benefit_id HAVING count(DISTINCT card_id) > 1", lambda v: v("card_benefit_mapping").groupBy("benefit_id").agg(F.count_distinct("card_id").alias("n")).where("n > 1")),
    "orphan_mappings": ("SELECT m.id FROM card_benefit_mapping m LEFT JOIN benefits b ON b.id = m.benefit_id WHERE b.id IS NULL", lambda v: v("card_benefit_mapping").join(v("benefits").select(F.col("id").alias("benefit_id")), "benefit_id", "left_anti")),
    "duplicate_mappings": ("SELECT card_id FROM card_benefit_mapping GROUP BY card_id, benefit_id HAVING count(*) > 1", lambda v: Q.duplicates(v("card_benefit_mapping"), F.col("card_id"), F.col("benefit_id"))),
    "pending_staging": ("SELECT id FROM jobs WHERE staging_id IS NOT NULL AND status = 'queued'", lambda v: v("jobs").where("staging_id IS NOT NULL AND status = 'queued'")),
    "job_groups": ("SELECT 1 FROM jobs GROUP BY status, parser_version, run_mode", lambda v: v("jobs").groupBy("status", "parser_version", "run_mode").count()),
    "failure_categories": ("SELECT 1 FROM jobs WHERE status IN ('failed', 'review') GROUP BY parser_version, status", lambda v: v("jobs").where("status IN ('failed', 'review')").groupBy("parser_version", "status").count()),
    "missing_network": ("SELECT id FROM card_catalog WHERE network IS NULL", lambda v: v("card_catalog").where("network IS NULL")),
    "duplicate_identity": ("SELECT 1 FROM benefits GROUP BY lower(trim(title)), lower(category) HAVING count(*) > 1", lambda v: Q.duplicates(v("benefits"), F.lower(F.trim("title")).alias("t"), F.lower("category").alias("c"))),
    "url_conflicts": ("SELECT url FROM pages GROUP BY url HAVING count(DISTINCT page_id) > 1", lambda v: v("pages").groupBy("url").agg(F.count_distinct("page_id").alias("n")).where("n > 1")),
    "missing_provenance": ("SELECT id FROM card_catalog c WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = c.id)", lambda v: v("card_catalog").join(v("pages").select(F.col("page_id").alias("id")), "id", "left_anti")),
    "active_on_discontinued": ("SELECT u.id FROM user_cards u JOIN card_catalog c ON c.id = u.catalog_card_id WHERE u.is_active AND c.is_discontinued", lambda v: v("user_cards").where("is_active").join(v("card_catalog").where("is_discontinued").select(F.col("id").alias("catalog_card_id")), "catalog_card_id", "left_semi")),
    "bad_amounts": ("SELECT pos FROM transactions WHERE amount <= 0", lambda v: v("transactions").where("amount <= 0")),
    "overpaid_statements": ("SELECT id FROM statements WHERE paid_amount > total_amount", lambda v: v("statements").where("paid_amount > total_amount")),
    "family_coverage": ("SELECT 1 FROM benefits GROUP BY category, benefit_type", lambda v: v("benefits").groupBy("category", "benefit_type").count()),
}


@query("WITH " + " UNION ALL ".join(f"SELECT '{n}' AS check_name, (SELECT count(*) FROM ({sql})) AS finding_count" for n, (sql, _) in _CHECKS.items()).replace("SELECT", "a AS (SELECT", 1) + ") SELECT * FROM a")
def set1_audit(spark, sf_dir):
    """Fifteen checks as rows of one table."""
    return Q.union_all([Q.finding(make(lambda n: view(spark, sf_dir, n)), name).select("check_name", "finding_count") for name, (_, make) in _CHECKS.items()])


@query("""WITH o AS (SELECT p_partkey AS k, sha256(p_name || '|' || p_size) AS h FROM part WHERE p_partkey % 5 > 0), n AS (SELECT p_partkey AS k, sha256(p_name || '|' || CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END) AS h FROM part WHERE p_partkey % 6 > 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'addition' WHEN n.k IS NULL THEN 'removal' WHEN o.h = n.h THEN 'unchanged' ELSE 'modification' END AS change FROM o FULL JOIN n ON o.k = n.k""")
def set5_diff(spark, sf_dir):
    part = view(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    old = Q.fingerprint(part.where("p_partkey % 5 > 0"), "k", "p_name", "p_size")
    new = Q.fingerprint(part.where("p_partkey % 6 > 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))), "k", "p_name", "p_size")
    return Q.changes(old, new, "k")


@query("SELECT page_id FROM (SELECT page_id FROM pages WHERE page_id % 2 = 0) a WHERE NOT EXISTS (SELECT 1 FROM attempts t WHERE t.page_id = a.page_id AND t.status = 'fetched') AND (SELECT bool_and(status <> 'lost') FROM attempts)")
def set6_absent(spark, sf_dir):
    """Known identities that a complete observation lacks; an incomplete one finds nothing absent."""
    attempts = view(spark, sf_dir, "attempts")
    complete = attempts.agg(F.bool_and(F.col("status") != "lost").alias("ok"))
    known = view(spark, sf_dir, "pages").where("page_id % 2 = 0").select("page_id").join(attempts.where("status = 'fetched'").select("page_id"), "page_id", "left_anti")
    return known.where(complete.scalar())


@query("WITH RECURSIVE t(n, depth) AS (SELECT 1, 0 UNION ALL SELECT n * 2 + b, depth + 1 FROM t, (SELECT 0 AS b UNION ALL SELECT 1) WHERE depth < 6) SELECT depth, count(*) AS nodes FROM t GROUP BY depth")
def set7_recursive(spark, sf_dir):
    """A tree walked level by level."""
    return spark.sql("WITH RECURSIVE t(n, depth) AS (SELECT 1, 0 UNION ALL SELECT n * 2 + b, depth + 1 FROM t JOIN (SELECT 0 AS b UNION ALL SELECT 1) WHERE depth < 6) SELECT depth, count(*) AS nodes FROM t GROUP BY depth")
