"""Crawls, snapshots, removals, the funnel, and identities of catalogue cards on small cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cardloom.operators import attempts as A, growth, identity as I, pages as P, removals as R, snapshots as S

T0 = datetime(2024, 5, 1)
ENTRY = "struct<status:string,http_status:int,error_code:string,identity:string,attempted_at:timestamp_ntz>"
ATTEMPTS = f"crawl int, place long, role string, source_key string, status string, http_status int, error_code string, identity string, attempted_at timestamp_ntz, history array<{ENTRY}>, overflow boolean"
NOW = "2024-05-02 00:00:00"


def attempt(place, role="primary", key="p", status="fetched", http=200, error=None, final=None, at=None, history=None, crawl=1, overflow=False):
    return (crawl, place, role, key, status, http, error, final, T0 + timedelta(minutes=place if at is None else at), history, overflow)


def compact(spark, *rows, most=A.KEPT):
    kept = A.compacted(spark.createDataFrame(list(rows), ATTEMPTS), "crawl", NOW, most)
    return sorted(kept.collect(), key=lambda r: (r["crawl"], r["place"] is None, r["place"])), {r["crawl"]: r["reason"] for r in A.assessed(kept, "crawl").collect()}


def test_retries_become_one_attempt_with_its_history(spark):
    bad = dict(status="failed", http=503, error="http_5xx")
    [kept], reasons = compact(spark, attempt(0, **bad), attempt(1, **bad), attempt(2))
    assert [h["http_status"] for h in kept["history"]] == [503, 503, 200] and reasons == {1: "complete"}
    # put together once more, nothing is lost or doubled
    row = (1, kept["place"], kept["role"], kept["source_key"], kept["status"], kept["http_status"], kept["error_code"], kept["identity"], kept["attempted_at"], [tuple(h) for h in kept["history"]], kept["overflow"])
    [again], _ = compact(spark, row)
    assert again["history"] == kept["history"] and again["attempted_at"] == kept["attempted_at"]


def test_unlike_final_resources_leave_a_crawl_open(spark):
    [kept], reasons = compact(spark, attempt(0, status="failed", http=500, error="http_5xx", final="b"), attempt(1, final="c"))
    assert [h["identity"] for h in kept["history"]] == ["b", "c"] and reasons == {1: "final_resource_identity_conflict"}


def test_attempts_at_one_instant_or_in_the_future_have_no_last(spark):
    kept, reasons = compact(
        spark, attempt(0, at=5), attempt(1, at=5), attempt(2, "supporting", "s", at=9), attempt(3, "supporting", "s", at=9), attempt(0, crawl=2), attempt(1, "required_supporting", "r", at=60 * 24 + 6, crawl=2), attempt(2, "required_supporting", "q", at=60 * 24 + 4, crawl=2))
    assert [(r["crawl"], r["role"], r["error_code"], r["place"]) for r in kept] == [(1, "primary", "invalid_attempt_history", 0), (2, "primary", None, 0), (2, "required_supporting", "invalid_attempt_history", 1), (2, "required_supporting", None, 2)]
    assert reasons == {1: "primary_incomplete", 2: "required_supporting_incomplete"}


def test_decisive_sources_are_not_dropped_in_silence(spark):
    many = [attempt(0), *[attempt(i, "required_supporting", f"r{i}") for i in range(1, 10)], *[attempt(20 + i, "supporting", f"s{i}") for i in range(3)]]
    kept, reasons = compact(spark, *many)
    assert len(kept) == 9 and kept[-1]["error_code"] == "decisive_attempt_overflow" and [r["place"] for r in kept[:-1]] == list(range(8)) and reasons == {1: "decisive_attempt_overflow"}
    kept, reasons = compact(spark, *many[:6], *many[10:], *[attempt(30 + i, "supporting", f"t{i}") for i in range(4)])  # six decisive ones: three optional ones fit
    assert [r["place"] for r in kept] == [0, 1, 2, 3, 4, 5, 20, 21, 22] and reasons == {1: "complete"}


def test_long_histories_keep_their_end(spark):
    [kept], reasons = compact(spark, *[attempt(i, http=200 + i) for i in range(9)])
    assert [h["http_status"] for h in kept["history"]] == [203, 204, 205, 206, 207, 208] and kept["overflow"] and reasons == {1: "attempt_history_overflow"}
    _, reasons = compact(spark, attempt(0, overflow=True))
    assert reasons == {1: "attempt_history_overflow"}


@pytest.mark.parametrize("rows, reason", [
    ([attempt(0, "supporting", "s")], "missing_primary"), ([attempt(0), attempt(1, key="q")], "multiple_primary"), ([attempt(0, status="failed", http=404)], "primary_incomplete"), ([attempt(0, status="not_modified", http=304)], "complete"),
    ([attempt(0), attempt(1, "supporting", "s", "failed", 200, "corrupt_pdf"), attempt(2, "supporting", "t", "failed", 200, "empty_shell")], "corrupt_pdf"), ([attempt(0), attempt(1, "supporting", "s", "failed", 404, "http_404")], "complete"),
    ([attempt(0), attempt(1, "required_supporting", None)], "complete"),
])
def test_reasons_of_crawls(spark, rows, reason):
    assert compact(spark, *rows)[1] == {1: reason}


def test_metrics_count_histories_and_failures_by_kind(spark):
    old = [("failed", 503, "http_5xx", None, T0), ("failed", 403, "http_403", None, T0), ("failed", 404, "soft_404", None, T0), ("not_modified", 304, None, None, T0), ("fetched", 200, None, None, T0)]
    rows = [attempt(0, history=old), attempt(1, "required_supporting", "a", "failed", None, "deadline_exceeded"), attempt(2, "required_supporting", "b", "failed", 500, "http_5xx"), attempt(3, "required_supporting", "c", "not_modified", 304)]
    tried = spark.createDataFrame(rows, ATTEMPTS).withColumn("reusable", F.col("place") != 2)
    crawls = spark.createDataFrame([(1, False, 2, None, True, None, T0, T0 + timedelta(minutes=3)), (2, None, None, 5, None, True, T0, T0 - timedelta(minutes=3))], "crawl int, complete boolean, suppressed int, retries int, replay_passed boolean, proof_passed boolean, started_at timestamp_ntz, completed_at timestamp_ntz")
    proposals = spark.createDataFrame([(1, "additions"), (1, "migrations"), (1, "other")], "crawl int, kind string")
    decisions = spark.createDataFrame([(1, "reject", None, 0), (1, "reject", "", -1), (1, "reject", "b", None), (1, "retry", None, None)], "crawl int, action string, benefit_id string, proposal_index int")
    got = {r["crawl"]: r.asDict() for r in A.crawl_metrics(crawls, tried, proposals, decisions, "crawl", NOW).collect()}
    one = got[1]
    assert [one[c] for c in ("fetch_attempts", "fetch_success", "fetch_not_modified", "fetch_blocked", "fetch_missing", "fetch_failed")] == [8, 1, 2, 1, 1, 3] and one["fetch_success_rate"] == 3 / 8
    assert [one[f"required_supporting_{c}"] for c in ("attempted", "succeeded", "failed", "omitted", "success_rate")] == [2, 1, 1, 1, 1 / 3]
    assert (one["targeted_rejects"], one["global_rejects"], one["retries"], one["staged_additions"], one["identity_migrations"]) == (2, 1, 1, 1, 1)
    assert (one["suppressed_removal_reason_codes"], one["processing_duration_ms"], one["valid"], one["fetch_incomplete"]) == ("incomplete_crawl", 180_000, True, 1)
    assert (got[2]["fetch_attempts"], got[2]["fetch_success_rate"], got[2]["required_supporting_success_rate"], got[2]["valid"], got[2]["processing_duration_ms"], got[2]["retries"]) == (0, 0.0, 1.0, False, None, 5)


# ---------------------------------------------------------------- snapshots


def test_only_buckets_that_differ_are_compared(spark):
    rows = [(i, f"name {i}", None if i % 3 else float(i)) for i in range(3000)]
    old = spark.createDataFrame(rows, "id int, name string, x double").repartition(5)
    new = spark.createDataFrame([(i, n, None if i == 30 else x) for i, n, x in rows if i != 7] + [(9000, None, None)], "id int, name string, x double").repartition(3)
    got = {(r["key"], r["change"], r["fields"]) for r in S.changed_rows(old, new, "id", ["name", "x"]).collect()}
    assert got == {("7", "removed", ""), ("30", "modified", "x"), ("9000", "added", "")}
    assert S.differing_buckets(old, new, "id", ["name", "x"]).count() <= 3 and S.differing_buckets(old, old.repartition(7), "id", ["name", "x"]).count() == 0


def test_nulls_count_where_they_stand_and_repeated_rows_count(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "y", "y"), (2, "y", "y"), (None, "z", "z")], "id int, a string, b string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", "y"), (None, "z", "z")], "id int, a string, b string")
    assert {(r["key"], r["change"], r["fields"]) for r in S.changed_rows(a, b, "id", ["a", "b"]).collect()} - {(None, "added", ""), (None, "removed", "")} == {("1", "modified", "a,b"), ("2", "modified", "a,b")}
    tables = {"same": (a, a, "id", ["a"]), "other": (a, b, "id", ["a"]), "gone": (a, None, "id", ["a"]), "empty": (a.limit(0), a.limit(0), "id", ["a"])}
    assert {r["table"]: r["mutated"] for r in S.mutated_tables(tables).collect()} == {"same": False, "other": True, "gone": True, "empty": False}


# ---------------------------------------------------------------- removals


def test_absences_that_retire(spark):
    day = lambda d: T0 + timedelta(days=d)
    history = [("c", day(0), True, ["a", "b", "a"]), ("c", day(2), True, ["a"]), ("c", day(4), False, ["b"]), ("c", day(8), True, ["a", "b"]), ("c", day(40), True, ["z"]), ("d", day(0), True, ["a"])]
    possible = [("c", "a", None, None), ("c", "z", "b", None), ("c", "q", None, None), ("c", "e", None, day(3).date()), ("c", "f", None, day(90).date()), ("d", "a", None, None), ("x", "a", None, None)]
    crawls = [("c", True, day(9)), ("d", False, day(9)), (None, True, day(9))]
    got = R.removal_policy(spark.createDataFrame(possible, "card_id string, benefit_id string, dedupe_key string, effective_to date"), spark.createDataFrame(crawls, "card_id string, complete boolean, observed_at timestamp_ntz"), spark.createDataFrame(history, "card_id string, observed_at timestamp_ntz, complete boolean, absent_ids array<string>"), "2024-05-10 00:00:00")
    by = {(r["card_id"], r["benefit_id"]): (r["reason"], r["observations"], r["streak"]) for r in got.collect()}
    assert by == {
        ("c", "a"): ("two_complete_observations", 4, 3), ("c", "z"): ("two_complete_observations", 3, 1), ("c", "q"): ("insufficient_complete_observations", 1, 0), ("c", "e"): ("explicit_past_end_date", 1, 0), ("c", "f"): ("explicit_end_date_not_past", 1, 0),
        ("d", "a"): ("suppressed", 0, 0), ("x", "a"): ("suppressed", 0, 0),
    }


# ---------------------------------------------------------------- the funnel

PEOPLE = "user_id int, source string, started_at timestamp_ntz, completed_at timestamp_ntz, qualified boolean, cohort int, invited_at timestamp_ntz, activated_at timestamp_ntz, support_minutes int, issue boolean, severe_open boolean, interviewed boolean"


def test_each_person_matures_alone(spark):
    person = lambda i, active: (i, "s", T0, T0, True, 1, T0, active, 10, False, False, i == 1)
    people = spark.createDataFrame([person(1, T0), person(2, T0), person(3, T0 + timedelta(days=3)), person(4, None)], PEOPLE)
    at = lambda i, d, m=True: (i, T0 + timedelta(days=d), m)
    sessions = spark.createDataFrame([at(1, 7), at(1, 8), at(2, 14, False), at(2, 15), at(3, 9)], "user_id int, at timestamp_ntz, meaningful boolean")
    decisions = spark.createDataFrame([at(2, 1)[:2], at(2, 14)[:2], at(1, 1)[:2], at(1, 20)[:2]], "user_id int, at timestamp_ntz")
    own = {r["user_id"]: (r["active"], r["decided"]) for r in growth.matured(people, sessions, decisions, "2024-05-16 00:00:00").collect()}
    assert own == {1: (True, False), 2: (False, True)}
    card = {(r["metric"], r["scope"]): (r["numerator"], r["denominator"], r["state"]) for r in growth.scorecard(people, sessions, decisions, "2024-05-16 00:00:00").collect()}
    assert card["week2_retention", "all"] == (1, 2, "continue") and card["invite_activation", "all"] == (3, 4, "continue") and card["interview_coverage", "all"] == (1, 3, "continue") and len(card) == 9
    empty = {r["metric"]: r["state"] for r in growth.scorecard(people.limit(0), sessions, decisions, NOW).collect()}
    assert set(empty.values()) == {"no_data"} and len(empty) == 8


def test_only_a_run_of_bad_samples_at_the_end_stops(spark):
    def state(*samples):
        return growth.banded(spark.createDataFrame([(f"w{i}", *s) for i, s in enumerate(samples)], "sample string, numerator long, denominator long"), "application_completion").first()["state"]

    assert [state((1, 10), (1, 10)), state((1, 10), (4, 10), (1, 10)), state((1, 10), (1, 10), (4, 10)), state((4, 10), (0, 0), (1, 10), (0, 0), (1, 10)), state((6, 10)), state((0, 0))] == ["stop", "watch", "watch", "stop", "continue", "no_data"]


# ---------------------------------------------------------------- identities


def test_labels_meet_signals_by_their_rarest_word(spark):
    catalog = [(1, "i", ["gold"]), (2, "i", ["gold", "travel"]), (3, "i", ["gold", "travel"]), (4, "i", ["mega", "gold"]), (5, "j", ["mega"]), (6, "i", []), (7, "i", ["me", "ga"]), (8, "i", None)]
    evidence = [(10, "i", ["gold", "x"]), (11, "i", ["travel", "gold"]), (12, "i", ["y", "mega", "gold"]), (13, "i", ["mega"]), (14, "i", []), (15, "k", ["gold"]), (16, None, ["gold"]), (17, "i", ["gold", "x"])]
    got = {r["ev"]: r["id"] for r in I.match_products(spark.createDataFrame(evidence, "ev int, issuer string, signal array<string>"), spark.createDataFrame(catalog, "id int, issuer string, label array<string>")).collect()}
    assert got == {10: 1, 11: None, 12: 4, 13: 7, 14: 6, 17: 1}


def test_every_outcome_of_an_identity(spark):
    h = lambda c: c * 64
    cards = [(1, "Star", "Zo Gold", "Visa", "credit"), (2, "star ", "Zo Gold Card", "Visa", "Credit"), (3, "Star", "Kip Platinum", None, "credit"), (4, "Star", "Lum", None, "debit"), (5, "Star", "Pru World", None, "credit"), (6, "American Express", "Gold", None, "credit")]
    ask = lambda i, name, url="https://a.star.example/c", one="0", two="1", network=None, issuer="Star": (i, issuer, name, network, url, h(one), h(two))
    requests = [
        ask(1, "Zo Gold", network="Visa"), ask(2, "Kip Platinum"), ask(3, "Kip"), ask(4, "Neu"), ask(5, "Gold"), ask(6, "Kip Platinum", "https://star.example/a/"), ask(7, "Kip Platinum", "https://b.example/c"), ask(8, "Kip Platinum", one="x"), ask(9, "Kip Platinum", one="a"), ask(10, "Kip Platinum", two="b"),
        ask(11, "Kip Platinum", one="c", two="a"), ask(12, "Other", one="a"), ask(13, "Kip Gold", one="a"), ask(14, "Nick"), ask(15, "Lum"), ask(16, "Gold Card", "https://amex.example/g", issuer="American Express"), ask(17, "Terms and conditions for Kip Platinum", network="RuPay"), ask(18, None), ask(19, "Kip Platinum", None), ask(20, "Zo Gold Visa", one="d"),
    ]
    got = I.resolve_identities(
        spark.createDataFrame(requests, "request_id int, issuer string, card_name string, network string, url string, submitted_hash string, final_hash string"), spark.createDataFrame(cards, "card_id int, bank string, card_name string, network string, card_type string"), spark.createDataFrame([(5, "Nick"), (5, "Gold"), (4, "Nick")], "card_id int, alias string"),
        spark.createDataFrame([(h("A").lower(), 3), (h("b"), 3), (h("b"), 5), (h("d"), 2)], "url_hash string, card_id int"), spark.createDataFrame([(h("c"), h("e"), 5), (None, None, 1)], "submitted_hash string, final_hash string, card_id int"), spark.createDataFrame([("star", "star.example"), ("american express", "amex.example")], "issuer string, domain string"))
    by = {r["request_id"]: (r["card_id"], r["outcome"]) for r in got.collect()}
    none = lambda o: (None, o)
    assert by == {
        1: none("ambiguous_catalog_identity"), 2: (3, "matched"), 3: none("strong_catalog_identity_conflict"), 4: none("new"), 5: none("invalid_catalog_identity"), 6: none("noncanonical_source_url"), 7: none("unapproved_domain"), 8: none("invalid_url_hash"), 9: (3, "bound"), 10: none("conflicting_url_identity"),
        11: none("conflicting_url_identity"), 12: none("url_identity_incompatible"), 13: none("url_identity_incompatible"), 14: none("strong_catalog_identity_conflict"), 15: none("new"), 16: (6, "matched"), 17: none("strong_catalog_identity_conflict"), 18: none("invalid_catalog_identity"), 19: none("noncanonical_source_url"), 20: (2, "bound"),
    }


# ---------------------------------------------------------------- pages


def test_kinds_of_pages(spark):
    rows = [
        ("https://s.example/credit-cards/nova", "<title>Welcome</title><h1>Nova <b>Star</b> Credit Card</h1>"), ("https://s.example/nova/fees", "<h1>Nova Card</h1>"), ("https://s.example/nova", "<h1>Nova Card</h1><h2>Our rewards</h2>"), ("https://s.example/nova", "<h1>Nova Card</h1>"), ("https://s.example/credit-cards/comet", "<h1>Nova Credit Card</h1>"),
        ("https://s.example/nova/login?next=1", "<h1>Nova Card</h1>"), ("https://s.example/emi-calculator", "<h1>Nova Card</h1>"), ("https://s.example/credit-cards/blue-moon", '<script type="application/ld+json">[{"@type":"CreditCard","name":"Star Blue Moon Card"}]</script>'), ("https://s.example/credit-cards/bluemoon", "<h1>BlueMoon card</h1>"),
        ("https://s.example/credit-cards/nova", '<script type="application/ld+json">{broken</script>'), (None, None), ("https://s.example/credit-cards/wealth", "<h1>A card for life</h1><title>Wealth Credit Card - Star Bank</title>"),
    ]
    df = spark.createDataFrame([(i, "Star Bank", u, h) for i, (u, h) in enumerate(rows)], "page_id int, issuer string, url string, html string")
    got = [(r["kind"], r["name"]) for r in P.page_classes(df).orderBy("page_id").collect()]
    assert got == [("card_product", "nova"), ("supporting_document", "nova"), ("supporting_document", "nova"), ("ambiguous", None), ("ambiguous", None), ("not_a_card", None), ("not_a_card", None), ("card_product", "blue moon"), ("card_product", "blue moon"), ("ambiguous", None), ("ambiguous", None), ("card_product", "wealth")]


# ---------------------------------------------------------------- queues


def test_busy_issuers_are_passed_over(spark):
    from cardloom.operators import crawl as W

    at = lambda h: T0 + timedelta(hours=h)
    jobs = [
        (1, "alpha", "b", "queued", "manual", "v6", at(0), None), (2, " Alpha ", "a", "failed", "manual", "v6", at(1), None), (3, "alpha", "c", "leased", "manual", "v6", at(0), at(5)), (4, "beta", "a", "queued", "manual", "v6", at(0), None), (5, "beta", "z", "leased", "other", "v6", at(0), at(3)),
        (6, "gamma", "a", "queued", "automatic", "v6", at(0), None), (7, "delta", "a", "queued", "manual", "v6", at(2), None), (8, "aaa", "a", "queued", "manual", "v5", at(0), None), (9, "beta", "a", "queued", "manual", "v6", at(-1), None),
    ]
    df = spark.createDataFrame(jobs, "id int, issuer string, card_name string, status string, run_mode string, parser_version string, created_at timestamp_ntz, lease_expires_at timestamp_ntz")
    plan = lambda h: [r["id"] for r in W.claim_plan(df, at(h).strftime("%Y-%m-%d %H:%M:%S"), "manual", "v6").collect()]
    assert [plan(2), plan(3), plan(5)] == [[7], [9], [2]]
    assert {(r["moment"], r["id"]) for r in W.claim_timeline(df, "manual", "v6").collect()} == {(at(3), 9), (at(5), 2)}
    assert W.claim_plan(df.where("issuer = 'gamma'"), "2024-05-09 00:00:00", "manual", "v6").collect() == []


# ---------------------------------------------------------------- portfolios


def test_purchases_use_up_caps_in_order(spark):
    from cardloom.operators import replay as P

    day = lambda d: datetime(2024, 5, d, 10)
    bought = [(1, 1, day(1), 100.0, "food"), (1, 2, day(2), 300.0, "food"), (1, 3, day(3), 100.0, "fuel"), (1, 4, datetime(2024, 4, 30, 10), 200.0, "food"), (1, 5, day(4), -50.0, "food"), (1, 6, datetime(2023, 12, 1), 900.0, "food"), (2, 7, day(1), 10.0, None), (3, 8, day(1), 1000.0, "food")]
    rules = [("A", "best", "food", 0.10, 30.0, None), ("A", "next", "food", 0.05, 4.0, 200.0), ("A", "all", None, 0.01, None, None), ("B", "all", None, 0.02, None, None), ("C", "none", "food", 0.0, None, None)]
    wanted = [(1, "A", True, 99.0), (1, "B", False, 10.0), (1, "C", False, 5.0), (2, "A", False, None), (3, "A", True, None), (4, "A", True, None)]
    usage = [(1, "A", "best", datetime(2024, 4, 1).date(), 15.0), (3, "A", "best", datetime(2024, 5, 1).date(), None)]
    got = P.portfolio_values(spark.createDataFrame(bought, "user_id int, txn_id int, at timestamp_ntz, amount double, category string"), spark.createDataFrame(wanted, "user_id int, card_id string, is_owned boolean, annual_fee double"), spark.createDataFrame(rules, "card_id string, rule_id string, category string, rate double, cap double, least double"), spark.createDataFrame(usage, "user_id int, card_id string, rule_id string, cycle date, used double"), "2024-05-31 00:00:00")
    by = {(r["user_id"], r["card_id"]): (round(r["low"], 6), round(r["high"], 6), r["certain"]) for r in got.collect()}
    # May: 100 by best 10; 300: 200 of it by best 20, 80 by next 4, 20 by all 0.2; fuel 1. April: 15 of 30 are left: 150 by best, 50 by next 2.5
    assert by[1, "A"] == (10 + 20 + 4 + 0.2 + 1 + 15 + 2.5, 52.7, True) and by[1, "B"] == (14.0, 14.0, True) and by[1, "C"] == (0.0, 0.0, True)
    assert by[2, "A"] == (0.1, 0.1, True) and by[4, "A"] == (0.0, 0.0, True)
    # not known: nothing left of best, or all of it
    assert by[3, "A"] == (4 + 9.2, 30 + 4 + 6.2, False)
    year = {(r["user_id"], r["card_id"]): r["year_low"] for r in got.collect()}
    assert abs(year[1, "B"] - (14 * 365 / 90 - 10)) < 1e-9 and abs(year[1, "A"] - 52.7 * 365 / 90) < 1e-9


# ---------------------------------------------------------------- the inbox


def test_items_of_the_inbox(spark):
    from cardloom.operators import inbox

    at = lambda h: T0 + timedelta(hours=h)
    reviews = spark.createDataFrame([("a", "pending", at(0)), ("b", "done", at(0)), (None, "pending", at(0))], "id string, status string, created_at timestamp_ntz")
    jobs = [("j1", "failed", 1, "v", "scheduled", None, at(-3)), ("j2", "staged", 1, "v", "manual", None, at(1)), ("j3", "review_required", 2, "v", "manual", None, None), ("j4", "failed", 1, "catalog-v1", "scheduled", None, at(0)), ("j5", "queued", 1, "v", "scheduled", at(90), at(0)), ("j6", "quarantined", 9, "v", "manual", None, at(0))]
    cards = spark.createDataFrame([(1, "Star\u200b  Bank", " Nova\tCard " + "x" * 90), (2, "S", "Nova")], "card_id int, bank string, card_name string")
    said = [("f1", "card_data", "critical", "pending", at(2)), ("f2", None, "odd", "pending", at(50)), ("f3", "card_data", "high", "read", at(0))]
    make = lambda paused: inbox.items(
        reviews, spark.createDataFrame(jobs, "id string, status string, card_id int, parser_version string, run_mode string, next_retry_at timestamp_ntz, created_at timestamp_ntz"), cards, spark.createDataFrame([(paused, at(-1))], "is_paused boolean, updated_at timestamp_ntz"),
        spark.createDataFrame(said, "id string, feature_key string, severity string, review_status string, created_at timestamp_ntz"), at(3).strftime("%Y-%m-%d %H:%M:%S"))
    got = [tuple(r) for r in inbox.ranked(make(True)).collect()]
    name = ("Star Bank — Nova Card " + "x" * 90)[: len("Star Bank — ") + 80]
    assert got == [
        ("system:benefit_enrichment_scheduled:paused", "paused_pipeline", "critical", "Scheduled benefit enrichment is paused", "paused", 14400), ("feedback:f1", "feedback_review", "critical", "Review card data feedback", "pending", 3600),
        ("benefit-enrichment:j1", "benefit_enrichment_review", "high", f"Recover benefits: {name}", "failed", 21600), ("benefit-enrichment:j3", "benefit_enrichment_review", "high", "Review benefits", "review_required", 0),
        ("card-identity:a", "card_identity_review", "normal", "Review card identity", "pending", 10800), ("benefit-enrichment:j2", "benefit_enrichment_review", "normal", f"Review benefits: {name}", "staged", 7200), ("feedback:f2", "feedback_review", "normal", "Review AI output feedback", "pending", 0),
    ]
    assert make(False).where("type = 'paused_pipeline'").count() == 0 and inbox.ranked(make(True), 2).count() == 2


def test_the_only_card_of_a_page(spark):
    from cardloom.operators.portfolio import only_match

    cards = [(1, "star", "Credit", "Zenith Travel Platinum", "Visa"), (2, "Star ", "credit", "Orbit", "RuPay"), (3, "star", "debit", "Orbit", None), (4, "moon", "credit", "Orbit", None), (5, "star", "credit", "Moon", None), (6, "star", "credit", "Sun", None), (7, "star", "credit", "Sun", None), (8, "star", "credit", "Credit card", None), (9, "star", None, "Orbit", None)]
    pages = [(1, " Star", "<h1>Zenith Travel Platinum Visa</h1>"), (2, "star", "The Orbit card by RuPay"), (3, "star", "Moon or Sun?"), (4, "star", "Orbit on Mastercard"), (5, "star", "<p>moon moon</p>"), (6, "star", "sun"), (7, None, "moon"), (8, "star", None), (9, "star", "Zenith Travel Gold Visa"), (10, "moon", "orbit")]
    got = only_match(spark.createDataFrame(pages, "page_id int, issuer string, content string"), spark.createDataFrame(cards, "card_id int, issuer string, card_type string, card_name string, network string"))
    assert {r["page_id"]: r["card_id"] for r in got.collect()} == {1: 1, 2: 2, 3: None, 4: None, 5: 5, 6: None, 7: None, 8: None, 9: None, 10: 4}
