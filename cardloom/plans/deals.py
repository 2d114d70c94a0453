"""Queries of offers and calculators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import money as M
from cardloom.operators import deals as D
from cardloom.plans.register import query
from cardloom.sources.tables import view

REQUEST = D.Request(tickets=4, price=250.0, platform="BookMyShow", now="2001-08-02 00:00:00")

_NUM = "TRY_CAST(json_extract_string(value_config, '$.{0}') AS DOUBLE)"
_STR = "nullif(trim(json_extract_string(value_config, '$.{0}')), '')"
_RULES = f"""n AS (SELECT *, lower({_STR.format('discount_type')}) AS kind, {_NUM.format('discount_percent')} AS pct, {_STR.format('unit')} AS unit, {_NUM.format('threshold_amount')} AS thr, {_NUM.format('reward_value')} AS rew,
  coalesce({_NUM.format('multiplier')}, {_NUM.format('base_rate')}) AS rate, coalesce({_NUM.format('annual_cap')}, {_NUM.format('reward_value')}, {_NUM.format('currency_unit')}) AS ann, {_NUM.format('discount_amount')} AS amt,
  {_NUM.format('max_discount_per_transaction')} AS cap, {_NUM.format('max_usage_per_month')} AS mon, coalesce({_NUM.format('max_usage_per_month')}, {_NUM.format('max_usage_per_period')}) AS lim, {_NUM.format('monthly_cap')} AS mcap, {_NUM.format('min_transaction')} AS mint,
  list_contains(list_transform(string_split(lower(coalesce({_STR.format('category')}, '')), ','), lambda x: trim(x)), 'movies') AS movies FROM deal_sources),
s AS (SELECT *, CASE WHEN kind = 'bogo' THEN 'bogo' WHEN kind = 'percent' OR pct IS NOT NULL THEN 'percentDiscount' WHEN thr IS NOT NULL THEN 'milestone' WHEN movies AND rate IS NOT NULL AND unit IS NOT NULL AND lower(unit) <> 'fixed' THEN 'rewardMultiplier'
  WHEN lower(unit) = 'fixed' THEN 'annualAllowance' WHEN amt IS NOT NULL THEN 'fixedDiscount' END AS shape FROM n),
q AS (SELECT *, CASE WHEN shape IS NULL THEN 'no_offer_type' WHEN shape = 'bogo' AND coalesce(cap, 0) <= 0 THEN 'bogo_needs_cap' WHEN shape = 'bogo' AND coalesce(lim, 0) <= 0 THEN 'bogo_needs_limit' WHEN shape = 'bogo' AND mon IS NULL THEN 'bogo_needs_period'
  WHEN shape = 'percentDiscount' AND (pct IS NULL OR pct <= 0 OR pct > 100) THEN 'percent_out_of_range' WHEN shape = 'milestone' AND (thr IS NULL OR rew IS NULL) THEN 'milestone_incomplete' END AS reason FROM s),
r AS (SELECT *, CASE WHEN reason IS NULL THEN shape END AS offer_type FROM q)"""
_OFFERS = f"""{_RULES},
p AS (SELECT *, list_filter(list_transform(string_split(partners, ','), lambda x: CASE lower(trim(x)) WHEN 'bookmyshow' THEN 'BookMyShow' WHEN 'district' THEN 'Zomato' WHEN 'zomato' THEN 'Zomato' WHEN 'pvr' THEN 'PVR' WHEN 'inox' THEN 'INOX' END), lambda x: x IS NOT NULL) AS plats FROM r WHERE offer_type IS NOT NULL),
x AS (SELECT *, CASE WHEN offer_type IN ('bogo', 'percentDiscount', 'fixedDiscount') AND 1000 < mint THEN 'below_minimum' WHEN TIMESTAMP '2001-08-02' > valid_until THEN 'expired' WHEN offer_type = 'milestone' AND milestone_spend IS NULL THEN 'milestone_unknown'
  WHEN offer_type = 'milestone' AND milestone_spend < thr THEN 'milestone_not_met' WHEN offer_type = 'bogo' AND usage_confidence = 'verified' AND used_transactions >= lim THEN 'limit_reached' END AS ineligible,
  greatest(0, least(CASE offer_type WHEN 'bogo' THEN 2 * least(250, cap) WHEN 'percentDiscount' THEN least(1000 * pct / 100, coalesce(cap, 1e18)) WHEN 'fixedDiscount' THEN least(amt, coalesce(mcap, 1e18)) WHEN 'milestone' THEN rew ELSE 0 END, 1000)) AS savings,
  CASE WHEN list_contains(plats, 'BookMyShow') THEN 'explicit' WHEN confirmed = 'bookmyshow' THEN 'communityConfirmed' ELSE 'unconfirmed' END AS confidence FROM p),
t AS (SELECT *, 1000 - savings AS final_amount, CASE WHEN ineligible IS NULL AND offer_type NOT IN ('rewardMultiplier', 'annualAllowance') THEN
  CASE WHEN (usage_confidence = 'verified' OR (offer_type = 'percentDiscount' AND cap IS NULL) OR (offer_type = 'fixedDiscount' AND mcap IS NULL)) AND confidence = 'explicit' THEN 'guaranteed' ELSE 'potential' END END AS tier FROM x)"""


def _rules(spark, sf_dir):
    return D.normalised_rules(view(spark, sf_dir, "deal_sources"))


@query(f"WITH {_RULES} SELECT benefit_id, offer_type, reason, CASE WHEN offer_type IN ('bogo', 'percentDiscount') THEN cap END AS transaction_cap FROM r")
def dom7_rules(spark, sf_dir):
    """Open JSON objects as offer types, or why not."""
    return _rules(spark, sf_dir).select("benefit_id", "offer_type", "reason", "transaction_cap")


@query(f"""WITH {_OFFERS} SELECT benefit_id, ineligible, savings, confidence, tier,
CASE offer_type WHEN 'bogo' THEN printf('BOGO up to %.0f, %d a month', cap, CAST(lim AS INTEGER)) WHEN 'annualAllowance' THEN printf('Up to %.0f a year', ann) WHEN 'rewardMultiplier' THEN printf('%.0f %s', rate, unit) ELSE printf('%s saves %.2f (%s usage)', offer_type, CAST(savings AS DOUBLE), usage_confidence) END AS explanation FROM t""")
def dom8_deal_evaluation(spark, sf_dir):
    return D.evaluated(_rules(spark, sf_dir), REQUEST).select("benefit_id", "ineligible", "savings", "confidence", "tier", "explanation")


_ORDER = "ORDER BY savings DESC, final_amount, CASE confidence WHEN 'explicit' THEN 3 WHEN 'communityConfirmed' THEN 2 WHEN 'unconfirmed' THEN 1 ELSE 0 END DESC, display_priority DESC, catalog_card_id, benefit_id"


@query(f"""WITH {_OFFERS}, w AS (SELECT benefit_id, tier, savings, row_number() OVER (PARTITION BY tier {_ORDER}) AS place, CASE WHEN is_owned THEN row_number() OVER (PARTITION BY tier, is_owned {_ORDER}) END AS owned_place FROM t WHERE tier IS NOT NULL)
SELECT benefit_id, tier, savings, CASE WHEN place <= 20 THEN place END AS place, CASE WHEN owned_place <= 20 THEN owned_place END AS owned_place FROM w WHERE place <= 20 OR owned_place <= 20""")
def win9_deal_rank(spark, sf_dir):
    """The twenty best offers of each tier, overall and owned."""
    return D.ranked_deals(D.evaluated(_rules(spark, sf_dir), REQUEST), 20).select("benefit_id", "tier", "savings", "place", "owned_place")


@query("""WITH c AS (SELECT p_partkey, p_size, floor(floor(p_retailprice * (p_size % 9) * 0.5 / 100 * 100 + 0.5 + 1e-9) / 100 * 100 + 0.5 + 1e-9) / 100 AS gross, CASE WHEN p_partkey % 3 = 0 THEN 20.0 END AS cap FROM part),
v AS (SELECT p_partkey, p_partkey % 100 AS purchase, CASE WHEN cap IS NULL THEN gross ELSE least(gross, cap) END AS value FROM c) SELECT p_partkey, value, value = max(value) OVER (PARTITION BY purchase) AS wins FROM v""")
def mth1_card_compare(spark, sf_dir):
    """What each card gives for its purchase, and which win, equal ones together."""
    from pyspark.sql import Window

    cap = F.when(F.col("p_partkey") % 3 == 0, F.lit(20.0))
    value = M.card_value(F.col("p_retailprice"), (F.col("p_size") % 9) * F.lit(0.5), cap)
    rows = view(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 100).alias("purchase"), value.alias("value"))
    return rows.select("p_partkey", "value", (F.col("value") == F.max("value").over(Window.partitionBy("purchase"))).alias("wins"))


@query("""WITH m AS (SELECT c_custkey, 5000.0 AS target, greatest(c_acctbal, 0) AS cur, c_custkey % 900 * 1.0 AS planned, c_custkey % 15 AS days FROM customer),
p AS (SELECT *, floor((cur + planned) * 100 + 0.5 + 1e-9) / 100 AS projected FROM m), g AS (SELECT *, floor(greatest(target - projected, 0) * 100 + 0.5 + 1e-9) / 100 AS gap FROM p)
SELECT c_custkey, floor(greatest(target - cur, 0) * 100 + 0.5 + 1e-9) / 100 AS remaining_now, projected AS projected_spend, gap AS projected_gap, CASE WHEN gap = 0 THEN 0 WHEN days = 0 THEN NULL ELSE floor(gap / days * 100 + 0.5 + 1e-9) / 100 END AS daily_pace,
  CASE WHEN cur >= target THEN 'reached' WHEN projected >= target THEN 'on_track' ELSE 'shortfall' END AS status FROM g""")
def mth2_milestone(spark, sf_dir):
    out = M.milestone(F.lit(5000.0), F.greatest(F.col("c_acctbal"), F.lit(0.0)), (F.col("c_custkey") % 900).cast("double"), F.col("c_custkey") % 15)
    return view(spark, sf_dir, "customer").select("c_custkey", *[c.alias(n) for n, c in out.items()])


@query("""WITH i AS (SELECT p_partkey, p_retailprice AS price, p_size % 7 + 1 AS n, CASE p_partkey % 3 WHEN 0 THEN 'bogo' WHEN 1 THEN 'percent' ELSE 'fixed' END AS kind, p_size * 1.0 AS v, CASE WHEN p_partkey % 4 = 0 THEN 300.0 END AS cap, 12.5 AS fee, p_partkey % 3 AS uses FROM part),
s AS (SELECT *, floor(price * n * 100 + 0.5 + 1e-9) / 100 AS sub, floor(fee * n * 100 + 0.5 + 1e-9) / 100 AS fees FROM i),
r AS (SELECT *, CASE kind WHEN 'bogo' THEN least(n // 2, uses) * price WHEN 'percent' THEN sub * v / 100 ELSE v END AS raw FROM s),
w AS (SELECT *, CASE WHEN uses > 0 THEN floor(least(raw, coalesce(cap, 1e18), sub) * 100 + 0.5 + 1e-9) / 100 ELSE 0 END AS saving FROM r)
SELECT p_partkey, sub AS ticket_subtotal, fees, saving AS savings, floor((sub + fees - saving) * 100 + 0.5 + 1e-9) / 100 AS payable, CASE WHEN sub + fees = 0 THEN 0 ELSE floor(saving / (sub + fees) * 100 * 100 + 0.5 + 1e-9) / 100 END AS savings_percent, uses > 0 AS available FROM w""")
def mth3_ticket_offer(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, F.lit("bogo")).when(k % 3 == 1, F.lit("percent")).otherwise(F.lit("fixed"))
    out = M.ticket_offer(F.col("p_retailprice"), F.col("p_size") % 7 + 1, kind, F.col("p_size").cast("double"), F.when(k % 4 == 0, F.lit(300.0)), F.lit(12.5), k % 3)
    return view(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in out.items()])
