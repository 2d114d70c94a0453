"""Operators on small frames: the cases that their definitions turn on."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from cardloom.functions import dates as D
from cardloom.functions import money as M
from cardloom.functions import text as T
from cardloom.operators import benefit_diff, cards, crawl, deals, evals, identity, spend

TXN = "user_id long, user_card_id long, amount decimal(12,2), transaction_date timestamp_ntz, description string, merchant_name string, category string, transaction_type string, normalized_type string, reward_earned decimal(12,2), channel string, platform string, merchant_subtype string, pos long"


def txns(spark, *rows):
    base = dict(user_id=1, user_card_id=1, amount="10", at="2026-07-01 00:00:00", description="d", merchant_name="M", category=None, transaction_type="debit", normalized_type=None, reward_earned=None, channel=None, platform=None, merchant_subtype=None)
    out = []
    for i, r in enumerate(rows):
        x = base | {"pos": i} | r
        reward = None if x["reward_earned"] is None else Decimal(x["reward_earned"])
        out.append((x["user_id"], x["user_card_id"], Decimal(x["amount"]), dt.datetime.fromisoformat(x["at"]), x["description"], x["merchant_name"], x["category"], x["transaction_type"], x["normalized_type"], reward, x["channel"], x["platform"], x["merchant_subtype"], x["pos"]))
    return spark.createDataFrame(out, TXN)


def one(df):
    return df.collect()[0].asDict()


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in cols.items())).select(column.alias("v")).first()["v"]


def test_period_bounds_are_closed(spark):
    rows = txns(spark, {"at": "2026-07-01 00:00:00"}, {"at": "2026-06-30 23:59:59.999999"}, {"at": "2026-07-31 12:00:00", "description": "e"}, {"at": "2026-07-31 12:00:00.000001", "description": "f"})
    assert one(spend.retail_totals(spend.purchases(rows, "2026-07-01", "2026-07-31 12:00:00")))["total_spend"] == 20


def test_what_counts_as_a_purchase(spark):
    rows = txns(spark, {}, {"description": "2", "transaction_type": "credit"}, {"description": "3", "normalized_type": "cash_withdrawal"}, {"description": "4", "transaction_type": "cash_withdrawal"}, {"description": "5", "transaction_type": None}, {"description": "6", "amount": "0"}, {"description": "7", "amount": "-5"})
    assert one(spend.retail_totals(spend.purchases(rows))) == {"user_id": 1, "total_spend": 30.0, "total_rewards": 0.0, "purchases": 3}  # unknown types read as debit


def test_first_row_of_a_natural_key_wins(spark):
    rows = txns(spark, {"category": "food", "reward_earned": "2", "pos": 5}, {"category": "fuel", "reward_earned": "9", "pos": 3}, {"at": "2026-07-01 00:00:00.000001"})
    bought = spend.purchases(rows)
    got = {x["category"]: x["amount"] for x in spend.category_totals(bought).collect()}
    assert got == {"fuel": 10.0, "Other": 10.0}
    assert one(spend.retail_totals(bought))["total_rewards"] == 9


def test_insights_rank_amount_then_count_then_name(spark):
    rows = txns(spark, {"merchant_name": " Beta Cafe", "amount": "10"}, {"merchant_name": "Alpha Cafe", "amount": "10"}, {"merchant_name": "gamma", "amount": "5"}, {"merchant_name": "GAMMA ", "amount": "5"}, {"merchant_name": "", "amount": "7", "category": "food"})
    got = {x["kind"]: x for x in spend.spend_insights(rows, "2026-01-01", "2026-12-31").collect()}
    assert (got["merchant"]["key"], got["merchant"]["label"], got["merchant"]["transactions"]) == ("gamma", "gamma", 2)
    assert got["category"]["key"] == "other" and got["category"]["label"] == "Other" and got["category"]["unresolved"] == 37
    assert "foodGrocery" not in got  # a group without a name is no group
    tie = txns(spark, {"merchant_name": "Beta"}, {"merchant_name": "Alpha"})
    assert {x["kind"]: x["key"] for x in spend.spend_insights(tie, "2026-01-01", "2026-12-31").collect()}["merchant"] == "alpha"


def test_months_are_those_of_the_reporting_zone(spark):
    rows = txns(spark, {"at": "2026-06-30 19:00:00"})
    got = {x["month_index"]: x["spend"] for x in spend.month_trend(spend.purchases(rows), "2026-08-02 00:00:00", zone="+05:30").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 10, 5: 0}
    got = {x["month_index"]: x["spend"] for x in spend.month_trend(spend.purchases(rows), "2026-08-02 00:00:00").collect()}
    assert got[3] == 10


def test_trend_and_top_category(spark):
    rows = txns(spark, {"at": "2026-07-02 01:00:00", "amount": "30"}, {"at": "2026-07-01 01:00:00", "amount": "30"}, {"at": "2026-06-20 00:00:00", "amount": "20"})
    got = one(spend.spend_trend(spend.purchases(rows), "2026-07-01", "2026-07-31"))
    assert (got["daily_average"], str(got["peak_day"]), got["change_percent"]) == (30.0, "2026-07-01", 200.0)
    assert one(spend.spend_trend(spend.purchases(rows.where("amount = 30")), "2026-07-01", "2026-07-31"))["change_percent"] is None
    tie = txns(spark, {"category": "a"}, {"category": "b", "description": "2"})
    assert one(spend.top_category(spend.purchases(tie)))["category"] == "b"  # seen last


def test_empty_tables(spark):
    none = txns(spark).where("false") if False else txns(spark, {}).where("false")
    assert spend.month_trend(spend.purchases(none), "2026-08-02 00:00:00").count() == 0
    assert spend.spend_insights(none, "2026-01-01", "2026-12-31").count() == 0


# ---------------------------------------------------------------- statements


ST = "id long, user_card_id long, statement_date date, due_date date, total_amount decimal(12,2), paid_amount decimal(12,2), payment_status string"


def statements(spark, *rows):
    return spark.createDataFrame([(i, 1, dt.date.fromisoformat(d), dt.date.fromisoformat(d), Decimal(t), Decimal(p), s) for i, d, t, p, s in rows], ST)


def test_credits_pay_the_oldest_first_and_nothing_is_lost(spark):
    st = statements(spark, (1, "2026-01-31", "100", "20", "partial"), (2, "2026-02-28", "50", "0", "overdue"), (3, "2026-03-31", "70", "70", "paid"), (4, "2026-04-30", "90", "0", "pending"), (5, "2026-05-31", "10", "0", "pending"))
    credit = spark.createDataFrame([(4, 1, dt.date(2026, 4, 30), Decimal("100")), (5, 1, dt.date(2026, 5, 31), Decimal("500"))], "source_id long, user_card_id long, source_date date, credit decimal(12,2)")
    got = {(x["source_id"], x["id"]): (x["payment"], x["status"]) for x in cards.allocate_payments(st, credit).collect()}
    assert got == {(4, 1): (80.0, "paid"), (4, 2): (20.0, "partial"), (5, 1): (80.0, "paid"), (5, 2): (50.0, "paid"), (5, 4): (90.0, "paid")}


def test_writes_repeat_safely(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k long, v string")
    assert [tuple(x) for x in cards.insert_new(t, new, ["k"]).collect()] == [(3, "y")]
    assert sorted(tuple(x) for x in cards.upsert(t, new, ["k"]).collect()) == [(1, "a"), (2, "x"), (3, "z")]
    assert cards.insert_new(cards.upsert(t, new, ["k"]), new, ["k"]).count() == 0


def test_ambiguity_picks_none(spark):
    catalog = spark.createDataFrame([(1, "I", ["eazydiner", "platinum"]), (2, "I", ["platinum"]), (3, "I", ["platinum"]), (4, "J", ["gold"])], "id long, issuer string, label array<string>")
    signals = spark.createDataFrame([(10, "I", ["eazydiner", "platinum"]), (11, "I", ["my", "platinum"]), (12, "I", ["gold"]), (13, "I", ["x", "eazydiner", "platinum"])], "ev long, issuer string, signal array<string>")
    assert {x["ev"]: x["id"] for x in identity.match_products(signals, catalog).collect()} == {10: 1, 11: None, 13: 1}


# ---------------------------------------------------------------- offers


def offers(spark, config, partners="BookMyShow", **more):
    base = {"is_owned": True, "usage_confidence": "unverified", "used_transactions": 0, "milestone_spend": None, "confirmed": "", "valid_until": None, "display_priority": 0} | more
    df = spark.createDataFrame([(1, 1, "t", config, partners)], "benefit_id long, catalog_card_id long, title string, value_config string, partners string")
    kinds = {"is_owned": "boolean", "used_transactions": "int", "milestone_spend": "double", "valid_until": "date", "display_priority": "int"}
    return deals.normalised_rules(df.withColumns({k: F.lit(v).cast(kinds.get(k, "string")) for k, v in base.items()}))


REQUEST = deals.Request(4, 250.0, None, "2026-08-02 00:00:00")


def test_offer_types_and_reasons(spark):
    cases = {
        '{"discount_type":"BOGO","max_discount_per_transaction":500,"max_usage_per_month":2}': ("bogo", None), '{"discount_type":"bogo","max_discount_per_transaction":500}': (None, "bogo_needs_limit"),
        '{"discount_type":"bogo","max_discount_per_transaction":500,"max_usage_per_period":1,"usage_period":"Quarter"}': ("bogo", None), '{"discount_percent":"10"}': ("percentDiscount", None), '{"discount_percent":101}': (None, "percent_out_of_range"),
        '{"threshold_amount":80000}': (None, "milestone_incomplete"), '{"category":"Dining, Movies","multiplier":5,"unit":"points"}': ("rewardMultiplier", None), '{"unit":"FIXED","reward_value":100}': ("annualAllowance", None), '{"unit":"fixed"}': (None, "allowance_not_positive"),
        '{"discount_amount":0}': (None, "discount_not_positive"), '{"unit":5,"multiplier":2,"category":"movies"}': (None, "no_offer_type"), "not json": (None, "no_offer_type"), None: (None, "no_offer_type"),
    }
    for config, want in cases.items():
        got = one(offers(spark, config))
        assert (got["offer_type"], got["reason"]) == want, config


def test_savings_caps_and_tiers(spark):
    def run(config, request=REQUEST, **more):
        return one(deals.evaluated(offers(spark, config, **more), request))

    bogo = '{"discount_type":"bogo","max_discount_per_transaction":200,"max_usage_per_month":2}'
    assert run(bogo)["savings"] == 400 and run(bogo)["tier"] == "potential"  # the cap is for each pair
    assert run(bogo, usage_confidence="verified")["tier"] == "guaranteed"
    assert run(bogo, usage_confidence="verified", used_transactions=2)["ineligible"] == "limit_reached"
    assert run('{"discount_percent":10}')["tier"] == "guaranteed" and run('{"discount_percent":10,"max_discount_per_transaction":50}')["savings"] == 50
    assert run('{"discount_amount":1500,"monthly_cap":1500}')["savings"] == 1000  # never more than the price
    assert run('{"discount_amount":100,"min_transaction":1001}')["ineligible"] == "below_minimum"
    milestone = '{"threshold_amount":80000,"reward_value":500}'
    assert [run(milestone, milestone_spend=s)["ineligible"] for s in (None, 100.0, 80000.0)] == ["milestone_unknown", "milestone_not_met", None]
    assert run('{"unit":"fixed","annual_cap":6000}')["tier"] is None and run('{"unit":"fixed","annual_cap":6000}')["savings"] == 0
    other = deals.Request(4, 250.0, "Zomato", REQUEST.now)
    assert run('{"discount_percent":10}', other)["confidence"] == "unconfirmed" and run('{"discount_percent":10}', other, confirmed="zomato")["confidence"] == "communityConfirmed"
    assert run('{"discount_percent":10}', other, partners="District,Uber")["confidence"] == "explicit"


def test_calculators(spark):
    got = {n: value(spark, c, x=1.0) for n, c in M.milestone(F.lit(100000.0), F.lit(72000.0), F.lit(8000.0), F.lit(14)).items()}
    assert got == {"remaining_now": 28000, "projected_spend": 80000, "projected_gap": 20000, "daily_pace": 1428.57, "status": "shortfall"}
    assert value(spark, M.milestone(F.lit(100.0), F.lit(1.0), F.lit(0.0), F.lit(0))["daily_pace"], x=1.0) is None
    out = M.ticket_offer(F.lit(300.0), F.lit(3), F.lit("bogo"), F.lit(0.0), F.lit(250.0), F.lit(20.0), F.lit(1))
    assert {n: value(spark, c, x=1.0) for n, c in out.items()} == {"ticket_subtotal": 900, "fees": 60, "savings": 250, "payable": 710, "savings_percent": 26.04, "available": True}


# ---------------------------------------------------------------- text, urls, dates


def test_bank_names_keep_their_order(spark):
    cases = {"HSBC UAE Bank": "HSBC UAE", "hsbc": "HSBC", "Amazon Pay ICICI": "Amazon ICICI Bank", "Bank of Baroda": "Bank of Baroda", "emirates islamic": "Emirates Islamic", "some NEW bank": "Some New Bank", "au small": "AU Small Finance Bank"}
    assert {k: value(spark, T.bank_name(F.col("x")), x=k) for k in cases} == cases


def test_categories_by_tier(spark):
    category, source = T.categorised(F.col("m"), F.col("d"), F.col("g"))
    cases = [("swiggy ", "x", "fuel", "food", "merchant_map"), ("AMAZON", "x", " Fuel ", "fuel", "model"), ("Amazon", "AMAZON order", "nonsense", "shopping", "keyword"), ("?", "vocab", None, "transport", "keyword"), ("?", "?", None, "other", "unresolved")]
    for m, d, g, c, s in cases:
        assert (value(spark, category, m=m, d=d, g=g), value(spark, source, m=m, d=d, g=g)) == (c, s)
    assert value(spark, T.transaction_type(F.col("p"), F.col("d")), p="Cash Withdrawal", d="plain") == "cash_withdrawal"
    assert value(spark, T.transaction_type(F.col("p"), F.col("d")), p="credit", d="Late fee reversed") == "refund"


def test_urls_and_pages(spark):
    cases = {"HTTPS://Bank.Example.:443/a/./b/../c//?utm_source=x&b=2&a=1#top": "https://bank.example/a/c?a=1&b=2", "http://h/../../x": "http://h/x", "ftp://h/": None, "http://user@h/": None, "https://h": "https://h/"}
    assert {k: value(spark, T.canonical_url(F.col("x")), x=k) for k in cases} == cases
    html = "<style>p{}</style><p>Fees &amp; charges</p><script>x<y</script><div>Rs.&nbsp;5</div>"
    assert value(spark, T.page_text(F.col("x")), x=html) == "Fees & charges\nRs. 5"
    assert value(spark, T.without_digit_runs(F.col("x")), x="card 4111 1111-1111 1111 pin 12345") == "card [redacted]pin 12345"


def test_dates(spark):
    parse = lambda x: value(spark, D.parsed_date(F.col("x")), x=x)
    assert [str(parse(x)) for x in ("2026-08-11", "11/8/2026", "31-02-2026", "soon", "2026-08-11T10:00:00Z")] == ["2026-08-11", "2026-08-11", "None", "None", "2026-08-11"]
    day, source = D.resolved_date(D.parsed_date(F.col("x")), F.lit("2026-08-15").cast("date"), F.lit("2026-08-11").cast("date"))
    assert [(str(value(spark, day, x=x)), value(spark, source, x=x)) for x in ("2026-08-10", "2027-08-10", "?")] == [("2026-08-10", "parser"), ("2026-08-11", "pdf_context"), ("2026-08-15", "statement_fallback")]
    assert value(spark, D.jitter(F.col("x"), 3), x="abc") == (97 + 98 + 99) % 7 - 3
    assert [value(spark, M.rupees(F.col("x")), x=x) for x in ("Rs. 1,500", "₹2.5 lakh", "1 crore", "none")] == [1500, 250000, 10000000, None]


# ---------------------------------------------------------------- crawls, differences, evaluation


def test_histories_keep_the_newest_of_each_key(spark):
    rows = spark.createDataFrame([(1, f"h{i % 30}", dt.datetime(2026, 1, 1) + dt.timedelta(days=i), i) for i in range(60)], "card_id long, semantic_hash string, observed_at timestamp_ntz, turn long")
    got = crawl.newest_per_key(rows, "card_id", "semantic_hash", "observed_at", "turn").collect()
    assert len(got) == 24 and min(x["turn"] for x in got) == 36


def test_retirement_needs_a_week(spark):
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    rows = spark.createDataFrame([(1, day(0)), (1, day(7)), (2, day(0)), (2, day(6)), (3, day(0)), (3, day(0))], "card_id long, observed_at timestamp_ntz")
    got = {x["card_id"]: x["eligible"] for x in crawl.retirement(rows, "card_id", F.lit(None).cast("date"), "2026-03-01 00:00:00").collect()}
    assert got == {1: True, 2: False, 3: False}


def test_outcomes_of_a_benefit_diff(spark):
    rows = [
        ("c", 1, "k1", "s1", "t1", "u1"), ("p", 2, "k1", "s1", "t1", "u1"),  # the same
        ("c", 3, "k2", "s2", "t2", "u1"), ("p", 4, "k2", "s2", "t3", "u1"),  # another condition under one key
        ("c", 5, "k3", "s3", "t4", "u1"), ("p", 6, "card-benefit-v2:4", "s4", "t4", "u1"),  # a new identity
        ("c", 7, "card-benefit-v2:5", "s5", "t5", "u1"), ("p", 8, "card-benefit-v2:6", "s5", "t6", "u1"),  # new terms
        ("p", 9, "k7", "s6", "t7", "u1"), ("p", 10, "k8", "s6", "t8", "u2"),  # two sources disagree
        ("c", 11, "card-benefit-v2:9", "s7", "t9", "u1"), ("p", 12, "k10", "s8", "t10", "u1"),
    ]
    terms = spark.createDataFrame([(s, i, 1, d, k, c, u, f"subject{i}", True) for s, i, d, k, c, u in rows], "side string, id long, card_id long, dedupe_key string, semantic_key string, condition string, source string, subject string, v6 boolean")
    got = {x["id"]: x["outcome"] for x in benefit_diff.diff(terms).collect()}
    assert got == {1: "unchanged", 2: "unchanged", 3: "dedupe_key_condition_mismatch", 4: "dedupe_key_condition_mismatch", 5: "identity_migration", 6: "identity_migration", 7: "modification", 8: "modification", 9: "conflicting_proposed_terms", 10: "conflicting_proposed_terms", 11: "possible_removal", 12: "addition"}


def test_assertions_and_verdicts(spark):
    v = F.try_parse_json(F.col("x"))

    def check(op, path, wanted, x, claim=""):
        return value(spark, evals.holds(op, v, path, F.lit(wanted), F.col("x"), (claim,)), x=x)

    x = '{"a":{"n":10.005,"z":null},"t":"No Fees"}'
    assert check("money", "$.a.n", "10", x) and not check("money", "$.a.n", "9", x) and not check("money", "$.b", "9", x)
    assert check("equals", "$.t", '"No Fees"', x) and check("must_not_exist", "$.b", "", x) and not check("must_not_exist", "$.a.z", "", x)
    assert not check("must_not_claim", "$", "", x, "no fees") and check("must_not_claim", "$", "", x, "free")
    rows = spark.createDataFrame([(1, True, True, True), (1, True, False, False), (2, True, False, True), (3, False, False, True)], "id long, baseline boolean, candidate boolean, severe boolean")
    got = {x["id"]: (x["regression"], x["severe_regression"]) for x in evals.verdicts(rows, "id").collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (False, False)}


def test_late_events_revise_what_was_given_out(spark, tmp_path):
    """Files whose events go back in time: at the end each event has the count that a batch query gives."""
    from datetime import datetime, timedelta

    from cardloom.streaming import replay as R

    minutes = [[0, 50, 100], [40, 55, 200], [10, 70, 130, 195], [300, 65]]
    schema = "event_id long, user_id long, ts timestamp_ntz"
    rows = []
    for i, file in enumerate(minutes):
        own = [(10 * i + j, 1, datetime(2024, 1, 1) + timedelta(minutes=m)) for j, m in enumerate(file)]
        rows += own
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    out = R.run(R.sliding(R.source(spark, str(tmp_path), "events")), "update", ["event_id"])
    want = {i: sum(t - timedelta(hours=1) <= x <= t for _, _, x in rows) for i, _, t in rows}
    assert {r["event_id"]: r["recent"] for r in out.collect()} == want
