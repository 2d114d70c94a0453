"""Queries that once took a subset of the ids, against their SQL without that subset, or by brute force."""

import itertools

import duckdb
import pytest

from cardloom.plans.registry import QUERIES, SQL
from cardloom.sources.tables import BASE
from tests.test_queries import rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


WHOLE = ("dom14_entity_match", "jn16_claim_conflicts", "src19_json_rows", "que1_claim_plan", "jn1_enriched_ledger", "dom18_made_lines")


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_dates_of_all_orders(spark, duck):
    assert QUERIES["dt4_recovered_date"](spark, SF).count() == duck.execute("SELECT count(*) FROM orders").fetchone()[0]


@pytest.mark.parametrize("seed", range(6))
def test_pilot_against_all_combinations(spark, seed):
    import random

    from cardloom.operators import crawl as W

    r = random.Random(seed)
    profiles = W.PROFILES[:4]
    rows_ = [(r.randint(0, 30), f" Issuer {r.randint(0, 1 + seed)}", r.choice(profiles), r.random() < 0.9, r.random() < 0.8) for _ in range(60)]
    if seed == 0:  # an id may stand for several profiles, and a better issuer come late
        rows_ = [(1, "x", profiles[0], True, True), (1, "x", profiles[1], True, True), (2, "x", profiles[1], True, True), (9, "y", profiles[1], True, True), (5, "y", profiles[2], True, True), (6, "z", profiles[3], True, True)]
    fits = [x for x in rows_ if x[3] and (x[4] or x[2] == W.WITHOUT_URL)]
    by = [sorted({(i, n.strip().lower()) for i, n, p, *_ in fits if p == q}) for q in profiles]
    all_ = [c for c in itertools.product(*by) if len({i for i, _ in c}) == 4 and len({n for _, n in c}) >= 3]
    df = spark.createDataFrame(rows_, "id long, issuer string, profile string, active boolean, approved boolean")
    got = W.pilot(df, profiles).collect()
    assert [tuple(x) for x in got] == ([tuple(i for i, _ in min(all_))] if all_ else [])
