"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.operators import evals as E
from cardloom.operators.quality import histogram
from cardloom.operators.settle import settled
from cardloom.plans.register import query
from cardloom.sources.tables import view


@query("""SELECT feature_key, count(*) AS cases, round(count(*) FILTER (WHERE baseline_pass) / CAST(count(*) AS DOUBLE), 6) AS baseline_rate, round(count(*) FILTER (WHERE candidate_pass) / CAST(count(*) AS DOUBLE), 6) AS candidate_rate, count(*) FILTER (WHERE status = 'review') AS reviews,
CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, quantile_disc(latency_ms, 0.95) AS p95_ms,
array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE severe AND baseline_pass AND NOT candidate_pass) > 0 THEN 'severe_regression' END, CASE WHEN count(*) FILTER (WHERE status = 'execution_error') > 0 THEN 'execution_errors' END, CASE WHEN count(*) FILTER (WHERE status = 'review') > 0 THEN 'pending_review' END], lambda x: x IS NOT NULL), ',') AS blockers
FROM eval_results GROUP BY feature_key""")
def agg24_run_detail(spark, sf_dir):
    return E.run_summary(view(spark, sf_dir, "eval_results"), "feature_key")


@query("WITH c AS (SELECT feature_key, status, count(*) AS n FROM eval_results GROUP BY ALL) SELECT feature_key, string_agg(status || '=' || n, ',' ORDER BY status || '=' || n) AS histogram FROM c GROUP BY feature_key")
def agg23_run_histogram(spark, sf_dir):
    return histogram(view(spark, sf_dir, "eval_results"), "feature_key", "status")


#: Two outputs of the events as JSON: what the second has wrong hangs on event_id.
_OUTPUT = """'{{"a":{{"amount":' || CAST({amount} AS STRING) || ',"id":"c' || CAST({id} AS STRING) || '"}},"b":{{"rate":' || CAST({rate} AS STRING) || ',"type":"t"}},"kind":"' || {kind} || '","list":[' || CAST({once} AS STRING) || ',1]}}'"""
_BASE = _OUTPUT.format(amount="value", id="user_id % 7", rate="event_id % 3", kind="event_type", once="event_id % 2")
_CAND = _OUTPUT.format(
    amount="CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END", id="CASE WHEN event_id % 11 = 0 THEN 9 ELSE user_id % 7 END", rate="CASE WHEN event_id % 13 = 0 THEN 7 ELSE event_id % 3 END", kind="CASE WHEN event_id % 17 = 0 THEN 'an ERROR' ELSE event_type END", once="CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END",
)
_OPS = ("equals", "money", "catalog_id", "benefit", "exactly_once", "must_not_claim", "must_not_exist")
_HOLDS = """CASE o.op WHEN 'equals' THEN json_extract_string({j}, '$.kind') = event_type WHEN 'money' THEN abs(CAST(json_extract({j}, '$.a.amount') AS DOUBLE) - value) <= 0.01 + 1e-12 WHEN 'catalog_id' THEN json_extract_string({j}, '$.a.id') = 'c' || user_id % 7
  WHEN 'benefit' THEN CAST(json_extract({j}, '$.b.rate') AS BIGINT) = event_id % 3 AND json_extract_string({j}, '$.b.type') = 't' WHEN 'exactly_once' THEN CAST(json_extract({j}, '$.list[0]') AS BIGINT) <> 1 WHEN 'must_not_claim' THEN NOT contains(lower({j}), 'error') ELSE json_extract({j}, '$.missing') IS NULL END"""
_FIX = f"""f AS (SELECT event_id, user_id, value, event_type, {_BASE} AS b, {_CAND} AS c FROM events),
r AS (SELECT event_id, o.op, o.op NOT IN ('equals', 'exactly_once') AS sev, {_HOLDS.format(j='b')} AS baseline, {_HOLDS.format(j='c')} AS candidate FROM f, (VALUES {", ".join(f"('{o}')" for o in _OPS)}) AS o(op))"""


def _assertions(spark, sf_dir):
    """Seven assertions, one of each operator, of each of two outputs."""
    k, v = F.col("event_id"), F.col("value")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rows = view(spark, sf_dir, "events").selectExpr("event_id", "user_id", "value", "event_type", f"{_BASE} AS b", f"{_CAND} AS c")
    wanted = [
        ("equals", "$.kind", quoted(F.col("event_type")), ()), ("money", "$.a.amount", v.cast("string"), ()), ("catalog_id", "$.a.id", quoted(F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string"))), ()),
        ("benefit", "$.b", F.concat(F.lit('{"rate":'), (k % 3).cast("string"), F.lit(',"type":"t"}')), ()), ("exactly_once", "$.list", F.lit("1"), ()), ("must_not_claim", "$", None, ("Error",)), ("must_not_exist", "$.missing", None, ()),
    ]
    return E.assertions_of(rows, wanted, "b", "c").select("event_id", "assertions")


@query(f"WITH {_FIX} SELECT event_id, op, baseline, candidate FROM r")
def dom35_assertions(spark, sf_dir):
    return _assertions(spark, sf_dir).select("event_id", F.inline("assertions")).select("event_id", "op", "baseline", "candidate")


@query(f"WITH {_FIX}, g AS (SELECT event_id, bool_and(baseline) AS bp, bool_and(candidate) AS cp, bool_or(sev AND baseline AND NOT candidate) AS s FROM r GROUP BY event_id) SELECT event_id, bp AS baseline_passed, cp AS passed, bp AND NOT cp AS regression, bp AND NOT cp AND s AS severe_regression, NOT cp AS requires_review FROM g")
def dom34_eval_verdict(spark, sf_dir):
    """A verdict on each case from its seven assertions, in the row."""
    rows = settled(_assertions(spark, sf_dir))
    return rows.select("event_id", *[c.alias(n) for n, c in E.verdict(F.col("assertions")).items()])


@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha256('run-1:' || doc_id), 1, 2))::INT % 2 = 0 THEN 'baseline_is_a' ELSE 'baseline_is_b' END AS side FROM documents")
def dom38_blind_side(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", E.blind_side(F.concat(F.lit("run-1:"), F.col("doc_id").cast("string"))).alias("side"))


@query("SELECT doc_id, least(0.01::DOUBLE, 0.01::DOUBLE * n_chars / 9216.0::DOUBLE) AS cost FROM documents")
def mth5_eval_cost(spark, sf_dir):
    return view(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(0.01), F.lit(0.01) * F.col("n_chars") / 9216.0).alias("cost"))
