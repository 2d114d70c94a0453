"""Costly work on each row is dealt to all tasks and done once; quick ways give what plain ones do."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from cardloom.functions import canonical as J, recover as V
from cardloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["dom19_document_benefits", "dom18_made_lines", "str25_pruned", "dt4_recovered_date", "jsn9_sanitised_summary", "jsn10_sanitised_attempt", "jsn12_condition_hash", "jsn16_set_hash", "dom8_deal_evaluation", "dom7_rules"])
def test_rows_are_dealt_to_all_tasks(spark, name):
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF))


def test_dates_without_a_pattern_for_each_row(monkeypatch):
    r, statement = random.Random(1), dt.date(2001, 9, 1)
    bits = ["\n", " ", "12", "3", "Shop", "shop", "a.b", "aug", "Aug", "2001", "01", "x", "\t", "\x1c", "\n12 shop a.b", " z\nAug 2001 ", "100"]
    cases = [("".join(r.choice(bits) for _ in range(r.randint(1, 14))), r.choice(["shop", "SHOP a.b", "a.b", "12", "shop shop", "sh"])) for _ in range(4000)]

    def plainly(text, description):
        told = r"\s+".join(map(re.escape, description.split()))
        m = re.search(rf"(?:^|\n)\s*(\d{{1,2}})\s+{told}[^\n]*\n\s*([A-Za-z]{{3,9}})\s+(\d{{4}}|\d{{2}})\b", text, re.IGNORECASE)
        return m and m.groups()

    want = [plainly(*c) for c in cases]
    assert sum(w is not None for w in want) > 50
    monkeypatch.setattr(V.re, "search", None)  # none is built
    assert [V._around(t, d.split()) for t, d in cases] == want
    assert V.split_date("\n12 shop\nAug 01", "Shop", statement) == dt.date(2001, 8, 12)


def test_each_distinct_json_text_is_read_once(spark, monkeypatch):
    import pandas as pd

    seen = []
    column = J._column(lambda v: seen.append(v) or J.stable(v), "string")
    assert list(column.func(pd.Series(['{"a": 1}', None, "no", '{"a": 1}', "[2]"] * 3))) == ['{"a":1}', None, None, '{"a":1}', "[2]"] * 3
    assert seen == [{"a": 1}, [2]]


def test_statements_are_put_in_form_once(spark):
    from cardloom.functions.rules import SUMMARY, pruned, sanitised

    df = spark.createDataFrame([("a  b",)], "t string")
    assert plan(df.select(pruned(F.col("t")).alias("x"))).split("== Physical Plan ==")[1].count("{2,}") == 1
    assert plan(df.select(sanitised(F.col("t"), SUMMARY).alias("x"))).split("== Physical Plan ==")[1].count("parseJson(t#") == 1
