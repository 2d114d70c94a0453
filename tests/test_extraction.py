"""Golden lines and condition hashes, canonical JSON, and the case tables of small helpers."""

import json

import pytest
from pyspark.sql import functions as F

from cardloom.functions import canonical as J
from cardloom.operators import extraction as X

#: Lines with the terms that must be read from them, and conditions with the hash that they must have.
LINES = [
    ('Get 10% cashback on dining spends, capped at ₹500 per statement month.', ('cashback', 'cashback', None, 10, 500, None, 'statement month', None)),
    ('Get 2 complimentary airport lounge visits per quarter.', ('travel', 'lounge_access', 2, None, None, None, 'quarter', None)),
    ('Annual fee waiver on spends of ₹2 lakh in a year.', ('other', 'fee_waiver', None, None, None, 200000, 'year', None)),
    ('Earn 5 reward points for every ₹150 spent on eligible purchases.', ('points', 'reward_points', 5, None, None, 150, None, None)),
    ('Get 25% off movie tickets up to Rs. 100 per transaction on BookMyShow.', ('entertainment', 'percent_discount', None, 25, None, None, None, None)),
    ('Fuel surcharge waiver on fuel transactions up to ₹400 per month.', ('fuel', 'fuel_surcharge_waiver', None, None, 400, None, 'month', None)),
    ('Travel insurance cover of ₹5 lakh excluding pre-existing conditions.', ('insurance', 'insurance_cover', 500000, None, 500000, None, None, None)),
    ('Get 1 PVR INOX Movie Ticket on every spend of Rs. 10,000 in a monthly billing cycle. Earn tickets worth Rs. 300 each for achieving every spends milestone of Rs. 10,000.', ('entertainment', 'milestone', 300, None, None, 10000, 'month', None)),
    ('Buy 1 movie ticket and get 1 free on BookMyShow, capped at Rs. 500 per booking, twice per month.', ('entertainment', 'bogo', 500, None, None, None, 'month', None)),
    ('Get 5% cashback on online spends, valid until 31 December 2026.', ('cashback', 'cashback', None, 5, None, None, None, '2026-12-31')),
    ('Get up to ₹500 cashback on eligible spends.', None),
    ('This offer is no longer available: Get 5% cashback on online spends.', None),
]
HASHES = [
    ({'category': 'cashback', 'benefitType': 'cashback', 'semanticKey': 'cashback:cashback:dining', 'valueConfig': {'cap': 500, 'period': 'statement month', 'rate': 10}, 'restrictions': ['dining spends'], 'rate': 10, 'cap': 500, 'period': 'statement month'}, "3567ec7d041e9db31c9cf33930c66a34b3b0258cdfd2f110bcac2144b5157705"),
    ({'category': 'travel', 'benefitType': 'lounge_access', 'semanticKey': 'travel:lounge_access:general', 'valueConfig': {'frequency': '2 visits', 'period': 'quarter', 'value': 2}, 'value': 2, 'frequency': '2 visits', 'period': 'quarter'}, "ab7145d940d1e6a23b552a14292b456f1f229c90c81359774eb583bc47712f13"),
    ({'category': 'other', 'benefitType': 'fee_waiver', 'semanticKey': 'other:fee_waiver:general', 'valueConfig': {'fee_type': 'annual', 'min_spend': 200000, 'period': 'year', 'threshold': 200000}, 'threshold': 200000, 'period': 'year'}, "84dfc514417249894345b8d54cc1028dd8c536060ee0ecce176efe9f19ea25e7"),
    ({'category': 'points', 'benefitType': 'reward_points', 'semanticKey': 'rewards:reward_points:general', 'valueConfig': {'threshold': 150, 'value': 5}, 'restrictions': ['eligible purchases'], 'value': 5, 'threshold': 150}, "d5a21f5acd12490936bf719c0c2de71de0e3029fe514ff21e448fca0ac22260a"),
    ({'category': 'entertainment', 'benefitType': 'percent_discount', 'semanticKey': 'entertainment:percent_discount:movie_tickets', 'valueConfig': {'category': 'movie_tickets', 'discount_percent': 25, 'discount_type': 'percent', 'max_discount_per_transaction': 100, 'rate': 25}, 'partners': ['BookMyShow'], 'rate': 25}, "c3c7a8ee0b1562cb4c36f629bcd4ade4e9388fb0f251153ff177089f868c4103"),
    ({'category': 'fuel', 'benefitType': 'fuel_surcharge_waiver', 'semanticKey': 'fuel:fuel_surcharge_waiver:general', 'valueConfig': {'cap': 400, 'max_waiver': 400, 'period': 'month', 'waiver_type': 'fuel_surcharge'}, 'restrictions': ['fuel transactions'], 'cap': 400, 'period': 'month'}, "d3bdc6c1465b1b6fda0901736a1f89036956c9c87be43591f8fb58092f2a6e11"),
    ({'category': 'insurance', 'benefitType': 'insurance_cover', 'semanticKey': 'insurance:insurance_cover:travel_insurance', 'valueConfig': {'cap': 500000, 'coverage_amount': 500000, 'coverage_type': 'travel insurance', 'value': 500000}, 'restrictions': ['travel insurance'], 'exclusions': ['pre-existing conditions'], 'value': 500000, 'cap': 500000}, "b0c237a9220148754df38637ada45d8e98206bc636bf7b8052c80d1683893572"),
    ({'category': 'entertainment', 'benefitType': 'milestone', 'semanticKey': 'entertainment:milestone:movie_tickets', 'valueConfig': {'category': 'movie_tickets', 'milestone_type': 'monthly', 'period': 'month', 'reward_value': 300, 'threshold': 10000, 'threshold_amount': 10000, 'value': 300}, 'partners': ['PVR', 'INOX'], 'value': 300, 'threshold': 10000, 'period': 'month'}, "fdbc36a1fbf66c14f1e7f545eaeef5cffebab0935c6c20ca363b4e8beb16e451"),
    ({'category': 'entertainment', 'benefitType': 'bogo', 'semanticKey': 'entertainment:bogo:movie_tickets', 'valueConfig': {'category': 'movie_tickets', 'discount_type': 'bogo', 'frequency': '2 redemptions', 'max_discount_per_transaction': 500, 'max_usage_per_month': 2, 'period': 'month', 'value': 500}, 'partners': ['BookMyShow'], 'value': 500, 'frequency': '2 redemptions', 'period': 'month'}, "866d7641d31c08ff5bb1d152523d3f7a18acaa5d1fa153107a0c6efc7580d457"),
    ({'category': 'cashback', 'benefitType': 'cashback', 'semanticKey': 'cashback:cashback:online', 'valueConfig': {'rate': 5}, 'restrictions': ['online spends'], 'rate': 5, 'validUntil': '2026-12-31'}, "a24dce97719f3782f3798dd752f939a28e8e935ce098aa972ae953440f037b89"),
]


def test_golden_lines(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINES)], "id int, text string")
    got = {x["id"]: tuple(x)[2:] for x in X.benefits(df, "id", "text").collect()}
    assert got == {i: w for i, (_, w) in enumerate(LINES) if w}


def test_lines_are_read_one_by_one(spark):
    text = "Intro\n\n1% fuel surcharge waiver up to Rs. 250 per month\nEarn 2 air miles per Rs. 100 spent on travel\nIs there 5% cashback?\n24x7 concierge service\n20% off on dining, capped at Rs. 300"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = [(x["id"], x["line_no"], x["value_type"], x["rate"], x["value"], x["cap"]) for x in X.benefits(df, "id", "text").orderBy("line_no").collect()]
    assert got == [(1, 2, "fuel_surcharge_waiver", 1.0, None, 250.0), (1, 3, "air_miles", None, 2.0, None), (1, 5, "concierge_access", None, None, None), (1, 6, "percent_discount", 20.0, None, 300.0)]


def test_condition_hashes(spark):
    df = spark.createDataFrame([(i, json.dumps(b)) for i, (b, _) in enumerate(HASHES)], "id int, b string")
    assert {x["id"]: x["h"] for x in df.select("id", J.condition_hash("b").alias("h")).collect()} == {i: h for i, (_, h) in enumerate(HASHES)}


@pytest.mark.parametrize("one, other", [({"valueConfig": {"minSpend": "₹2 lakh"}}, {"valueConfig": {"min_spend": 200000}}), ({"category": "Rewards"}, {"category": "points"}), ({"partners": ["B", "a", "A"]}, {"partners": ["a", "b"]}), ({"exclusions": ["Fuel"]}, {"exclusions": {"sourceTerms": "fuel"}})])
def test_conditions_that_mean_the_same(one, other):
    assert J.stable(J.condition(one)) == J.stable(J.condition(other))


def test_numbers_and_keys():
    assert [J.number_text(x) for x in (1.0, -2.5, 1e21, 1.5e-7, 0.000001, 123456789012345680000.0)] == ["1", "-2.5", "1e+21", "1.5e-7", "0.000001", "123456789012345680000"]
    assert J.stable({"b": [1.0, None, True], "a": "é"}) == '{"a":"é","b":[1,null,true]}'
    assert J.canonical({"a b": 1, "aB": 2, "a_b": 3}) == {"a_b": 3}  # the exact name counts


def test_json_that_is_none_and_bounds(spark):
    df = spark.createDataFrame([("{bad",), (None,), ('{"u":"https://x/?token=1"}',), (json.dumps({"k": {"k": {"k": {"k": {"k": {"k": {}}}}}}}),)], "j string")
    rows = df.select("j", J.canonical_json("j").alias("c"), J.within_bounds("j").alias("b"), J.sensitive_url("j").alias("s"), J.nfkc(F.lit("ＡＢ  c")).alias("n")).collect()
    assert [(x["c"] is None, x["b"], x["s"]) for x in rows] == [(True, None, None), (True, None, None), (False, True, True), (False, False, False)]
    assert rows[0]["n"] == "ab c"


def test_dates_that_a_break_has_split():
    import datetime as dt

    from cardloom.functions.recover import split_date

    text = "Page 1\n 11  CORNER   Shop (Main) 42.00\n August 26 total\n 12 other\nJuly 2026"
    day = dt.date(2026, 8, 20)
    assert split_date(text, "Corner shop (main)", day) == dt.date(2026, 8, 11)
    assert split_date(text, "other", day) == dt.date(2026, 7, 12)
    assert split_date(text, "missing", day) is None and split_date(None, "other", day) is None and split_date(text, "", day) is None
    assert split_date("31 x\nFeb 2026", "x", day) is None and split_date("1 x\nJan 2020", "x", day) is None


def test_urls_with_secrets_are_hidden():
    from cardloom.functions.recover import hide_secrets

    assert hide_secrets("see https://h/p?a=1 and https://h/p?tok%2565n=1, http://user@h/ or https%3A%2F%2Fh%2F%3Fapi_key%3D2") == "see https://h/p?a=1 and [redacted-url] [redacted-url] or [redacted-url]"
    assert hide_secrets(None) is None


def test_clusters_join_what_agrees(spark):
    from cardloom.operators.cluster import clusters

    rows = [(1, "b", 5, 10.0, None), (1, "a", 5, None, 500.0), (1, "c", 4, 12.0, None), (1, "d", 3, None, None), (1, "e", 2, 12.0, 500.0), (2, "f", 1, None, None)]
    df = spark.createDataFrame([(k, u, s, r, None, c, None, None) for k, u, s, r, c in rows], "k long, url string, strength int, rate double, value double, cap double, threshold double, period string")
    got = {x["url"]: (x["cluster"], x["strongest"]) for x in clusters(df, ["k"]).collect()}
    assert got == {"a": (0, True), "b": (0, False), "c": (1, True), "d": (0, False), "e": (1, False), "f": (0, True)}


def test_names_in_messages_and_pages(spark):
    from cardloom.operators import fields as P

    def of(column, x):
        return spark.createDataFrame([(x,)], "x string").select(column.alias("v")).first()["v"]

    subject = lambda x: of(P.product_of_subject(F.col("x"), ("IndusInd", "Bank")), x)
    assert [subject(x) for x in ("IndusInd Bank EazyDiner Platinum Credit Card Statement - Aug 2026", "Your statement is here", "Statement for 12")] == ["Eazy Diner Platinum", None, None]
    assert [of(P.last_four(F.col("x")), x) for x in ("xxxx 1234", "XX12 3456", "**1111 then **1111", "**1111 **2222", "1234")] == ["1234", None, "1111", None, None]
    assert of(P.card_name(F.col("x"), ("HDFC", "Bank")), "HDFC Bank Regalia gold Credit Card") == "Regalia Gold" and of(P.card_name(F.col("x"), ("HDFC", "Bank")), "HDFC Bank") == "Hdfc"


def test_sources_of_their_own(spark, tmp_path):
    from cardloom.sources import formats

    (tmp_path / "dump.tsv").write_text("1\tcafé\t\\N\n2\t\\N\t2.50\n")
    assert [tuple(x) for x in formats.read_dump(spark, f"{tmp_path}/dump.tsv", "id int, name string, fee double").collect()] == [(1, "café", None), (2, None, 2.5)]
    mails = [(1, [("MITC terms.pdf", "application/pdf"), ("Aug.PDF", "x")]), (2, [("a.pdf", "p"), ("b.pdf", "p")]), (3, [("a.txt", "text/plain")]), (4, None)]
    df = spark.createDataFrame(mails, "id int, a array<struct<filename:string,mime:string>>")
    got = {x["id"]: x["f"] for x in df.select("id", formats.statement_attachment(F.col("a"))["filename"].alias("f")).collect()}
    assert got == {1: "Aug.PDF", 2: "a.pdf", 3: None, 4: None}


def test_members_kept_and_stripped():
    assert J.allowed({"a": 1, "b": True, "c": {"d": "x", "e": 1}, "f": "g"}, {"a": int, "b": int, "c": {"d": str}, "f": int}) == {"a": 1, "c": {"d": "x"}}
    assert J.without({"etag": "x", "a": {"headers": {}}, "b": [None, ""]}, J.TRANSPORT) is None
