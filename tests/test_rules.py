"""Rules of catalogues, mails, pages and statements on small cases, with nulls and empty values."""

import pytest
from pyspark.sql import functions as F

from cardloom.functions import rules as R
from cardloom.functions.recover import read_pdf
from cardloom.operators import extraction as X, portfolio as P


def of(spark, column, *values, schema="x string"):
    return [r["v"] for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema).select(column.alias("v")).collect()]


def test_networks_and_conflicts(spark):
    rows = [("Visa", "Gold Mastercard", "x"), (None, "AMEX Gold", "American Express"), ("rupay", "Gold", "american express "), (None, None, None), ("visa", "visa", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    n, k = R.effective_network(*map(F.col, "abc"))
    assert [tuple(x) for x in df.select(n, k).collect()] == [(None, True), ("americanexpress", False), (None, True), (None, False), ("visa", False)]


def test_components_of_urls(spark):
    assert of(spark, R.decoded(F.col("x")), "a%20b+c", "%C3%A9", "%", "%4", "%g1", "%ff", "", None) == ["a b c", "é", None, None, None, None, "", None]
    ident = of(spark, R.source_identity(F.col("x")), "https://a.b/p/", "HTTPS://A.B:443/p", "https://a.b/p?token=1", "https://a.b/p?file=my%20pan", "https://u@a.b/", "http://a.b/p", "https://a.b/p?file=%", None)
    assert ident[0] == ident[1] is not None and ident[2:] == [None] * 6


def test_numbers_that_doubles_hold(spark):
    assert of(spark, R.safe_numbers(F.col("x")), '{"a":1.5,"b":"1e400"}', "[1e5,-0]", "[0.1234567]", "9007199254740993", "1e-9", "1e21", "{}") == [True, True, False, False, False, False, True]


def test_persons(spark):
    say = R.names_person(F.col("x"), F.array(F.lit("regalia gold")))
    assert of(spark, say, "made for asha rao", "points for customers.", "for Regalia Gold!", "to a", "for one two three four five", "for o'neil will be", "", None) == [True, False, False, False, False, True, False, True]


def test_json_in_answers(spark):
    assert of(spark, R.healed(F.col("x")), 'ok [{"a":1},', '{"a":{"b":1', "[]", " text ", "", '[{"a":1}, {"b"') == ['[{"a":1}]', '{"a":{"b":1}}', "[]", "text", "", '[{"a":1}]']


def test_small_print_goes_unless_purchases_follow(spark):
    body = "x " * 1750 + "end."  # 3,504 characters
    bought = "\n12/08/2001 AMAZON order Rs. 99.00\n"
    got = of(spark, R.pruned(F.col("x")), f"{body} MITC rest", f"{body} MITC rest{bought}", f"{body} MITC {bought} list of branches z", "mitc short", "", None)
    assert got[0] == body + " " and got[1].endswith("99.00") and got[2].endswith("99.00\n ") and got[3:] == ["mitc short", "", None]


def test_subjects(spark):
    df = spark.createDataFrame([("cashback", "cashback", "on movies, not eligible for fuel"), ("points", None, None), ("travel", "lounge_access", "global")], "c string, k string, t string")
    assert [x["v"] for x in df.select(R.offer_subject(F.col("c"), F.col("k"), F.col("t")).alias("v")).collect()] == ["cashback:cashback:movie", "rewards:benefit:general", "travel:lounge_access:international"]


def test_text_of_pdf_files():
    import zlib

    shown = b"BT (A \\(b\\) \\101) Tj T* <0041> Tj [(c) -3 (d)] TJ ET"
    packed = zlib.compress(shown)
    file = b"%PDF-1.7\n1 0 obj << /Length 5 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj"
    assert read_pdf(file) == ("A (b) A\n\x00Acd", 1, None) and read_pdf(b"%PDF-1.4 nothing") == ("", 0, None) and read_pdf(b"x") == (None, None, "not_pdf") and read_pdf(None) == (None, None, None)


def test_lines_of_a_page_in_reading_order():
    shown = b"BT 1 0 0 1 50 100 Tm (low) Tj 1 0 0 1 300 700 Tm (right) Tj 1 0 0 1 50 700 Tm (left) Tj 0 -20 Td (under) Tj 12 TL T* (next) Tj (quoted) ' ET BT 5 800 TD [(t) 3 (op)] TJ ET"
    assert read_pdf(b"%PDF-1.4\n<<>> stream\n" + shown + b"\nendstream")[0].split("\n") == ["top", "left", "right", "under", "next", "quoted", "low"]


def test_files_over_a_limit_are_refused_not_cut():
    import zlib

    page, body = b"<</Type /Page>>\n", b"<<>> stream\nBT (some text) Tj ET\nendstream\n"
    assert read_pdf(b"%PDF-1.4\n" + page * 64 + body) == ("some text", 64, None) and read_pdf(b"%PDF-1.4\n" + page * 65 + body) == (None, None, "oversized")
    assert read_pdf(b"%PDF-1.4\n<</Type /Pages /Kids []>>" + page + body)[1] == 1 and read_pdf(b"%PDF-1.4\n/Encrypt 1 0 R" + body)[2] == "encrypted"
    long = b"BT (" + b"x" * 999 + b") Tj ET "
    assert len(read_pdf(b"%PDF-1.4\n<<>> stream\n" + long * 900 + b"\nendstream")[0]) == 900 * 1000 - 1 and read_pdf(b"%PDF-1.4\n<<>> stream\n" + long * 1001 + b"\nendstream")[2] == "oversized"
    bomb = zlib.compress(b"BT" + b" " * 20_000_000 + b"ET")
    assert read_pdf(b"%PDF-1.4\n<</Filter /FlateDecode>> stream\n" + bomb + b"\nendstream")[2] == "oversized"


def test_the_card_of_a_mail(spark):
    mails = spark.createDataFrame([(1, 1, "HDFC", "x1234.pdf", "s"), (2, 1, "HDFC", None, "Your Regalia Gold"), (3, 1, "HDFC", "1234 5678", ""), (4, 1, "ICICI", "1234", ""), (5, 2, None, None, None)], "mail_id int, user_id int, bank string, filename string, subject string")
    cards = spark.createDataFrame([(7, 1, "hdfc bank", "Regalia Gold", "1234"), (8, 1, "HDFC", "Gold", "5678"), (9, 1, "HDFC", None, None)], "card_id int, user_id int, bank string, card_name string, last_four string")
    assert {x["mail_id"]: x["card_id"] for x in P.card_of_mail(mails, cards).collect()} == {1: 7, 2: 7, 3: None, 4: None, 5: None}


@pytest.mark.parametrize("line, looks", [("What is 5% cashback?", True), ("5% cashback is not eligible here", True), ("5% cashback", True), ("Earlier, 5% cashback", True), ("Merchants for 5% cashback are listed below", True), ("Get 5% cashback on fuel", False)])
def test_lines_that_only_look_like_offers(spark, line, looks):
    assert of(spark, X.no_offer(F.col("x")), line) == [looks]


def test_members_that_may_stay(spark):
    assert of(spark, R.sanitised(F.col("x"), R.SUMMARY), '{"additions":3,"crawl_complete":"true","review_status":"approved","token":"x"}', '{"additions":-1}', "{bad", None) == ['{"additions":3,"review_status":"approved"}', "{}", "{}", "{}"]
