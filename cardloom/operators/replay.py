"""What a card would have earned: purchases replayed through its rules, with their caps and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Days that are replayed, and that a year has.
DAYS, YEAR = 90, 365
RULE = "struct<rule_id:string,category:string,rate:double,cap:double,least:double>"
STATE = "struct<left:array<double>,gain:double>"


def cycles(purchases: DataFrame, now: str, days: int = DAYS) -> DataFrame:
    """(user_id, cycle, bought): the purchases of each user in each calendar month of the days before now, in order of time.

    purchases: (user_id, txn_id, at, amount, category). A row holds one user's month.
    """
    clock = F.lit(now).cast("timestamp_ntz")
    rows = purchases.where((F.col("at") > clock - F.expr(f"INTERVAL '{days}' DAY")) & (F.col("at") <= clock) & (F.col("amount") > 0))
    entry = F.struct("at", "txn_id", F.col("amount").cast("double").alias("amount"), "category")
    return rows.groupBy("user_id", F.date_trunc("month", "at").cast("date").alias("cycle")).agg(F.array_sort(F.collect_list(entry)).alias("bought"))


def card_rules(rules: DataFrame) -> DataFrame:
    """(card_id, rules): a card's rules, the best rate first, ties by rule_id. rules: (card_id, rule_id, category, rate, cap, least); a rule without a
    category is for all purchases, one without a cap has none, and one with a least amount needs a purchase of it."""
    fits = rules.where(F.col("rate") > 0)
    entry = F.struct((-F.col("rate").cast("double")).alias("k"), "rule_id", "category", F.col("rate").cast("double").alias("rate"), F.coalesce(F.col("cap").cast("double"), F.lit(float("inf"))).alias("cap"), F.coalesce(F.col("least").cast("double"), F.lit(0.0)).alias("least"))
    own = F.transform(F.array_sort(F.collect_list(entry)), lambda r: F.struct(*[r[c].alias(c) for c in ("rule_id", "category", "rate", "cap", "least")]))
    return fits.groupBy("card_id").agg(own.alias("rules"))


def replayed(bought: Column, rules: Column, left: Column) -> Column:
    """What the purchases gain by the rules, of which each gives no more than what is left of its cap.

    The fold goes through the purchases in order; each goes to its best rule until that is used up, and with the rest of its amount
    to the next.
    """
    def buy(state, t):
        def use(s, i):
            rule = F.get(rules, i)
            fits = (rule["category"].isNull() | (rule["category"] == t["category"])) & (t["amount"] >= rule["least"]) & (s["open"] > 0)
            gain = F.when(fits, F.least(s["open"] * rule["rate"], F.get(s["left"], i))).otherwise(0.0)
            # an amount that a rule takes whole is taken without a division
            whole = fits & (s["open"] * rule["rate"] <= F.get(s["left"], i))
            rest = F.when(whole, 0.0).otherwise(s["open"] - gain / rule["rate"])
            return F.struct(rest.alias("open"), F.transform(s["left"], lambda x, j: F.when(j == i, x - gain).otherwise(x)).alias("left"), (s["gain"] + gain).alias("gain"))

        start = F.struct(t["amount"].alias("open"), state["left"].alias("left"), F.lit(0.0).alias("gain"))
        after = F.aggregate(F.sequence(F.lit(0), F.size(rules) - 1), start, use)
        # read once
        return F.transform(F.array(after), lambda a: F.struct(a["left"].alias("left"), (state["gain"] + a["gain"]).alias("gain")).cast(STATE))[0]

    return F.aggregate(bought, F.struct(left.alias("left"), F.lit(0.0).alias("gain")).cast(STATE), buy, lambda s: s["gain"])


def portfolio_values(purchases: DataFrame, candidates: DataFrame, rules: DataFrame, usage: DataFrame, now: str, days: int = DAYS) -> DataFrame:
    """(user_id, card_id, is_owned, low, high, year_low, year_high, certain) of each candidate card.

    candidates: (user_id, card_id, is_owned, annual_fee); usage: (user_id, card_id, rule_id, cycle, used), used null where it is
    not known. What has been used of a rule's cap in a cycle is no longer there; where it is not known, low takes the cap as used up and
    high as untouched, and the value is a range. A cycle that usage does not name is untouched. A year is the days taken as often as it has
    them, less the fee of a card that is not owned. Users meet their own candidates alone; cycles, rules and usage are grouped before.
    """
    months = cycles(purchases, now, days)
    known = F.map_from_entries(F.collect_list(F.struct("rule_id", F.struct((F.col("used").isNull()).alias("unknown"), F.coalesce(F.col("used").cast("double"), F.lit(0.0)).alias("used")))))
    used = usage.groupBy("user_id", "card_id", "rule_id", "cycle").agg(F.when(F.count("used") == F.count("*"), F.max("used")).alias("used")).groupBy("user_id", "card_id", "cycle").agg(known.alias("usage"))
    own = candidates.join(card_rules(rules), "card_id")
    rows = own.join(months, "user_id").join(used, ["user_id", "card_id", "cycle"], "left")

    def left(unknown_used: bool):
        def one(r):
            u = F.try_element_at(F.col("usage"), r["rule_id"])
            taken = F.when(F.coalesce(u["unknown"], F.lit(False)), r["cap"] if unknown_used else F.lit(0.0)).otherwise(F.coalesce(u["used"], F.lit(0.0)))
            return F.when(r["cap"] == float("inf"), r["cap"]).otherwise(F.greatest(r["cap"] - taken, F.lit(0.0)))

        return F.transform("rules", one)

    gains = rows.select("user_id", "card_id", replayed(F.col("bought"), F.col("rules"), left(True)).alias("low"), replayed(F.col("bought"), F.col("rules"), left(False)).alias("high"))
    sums = gains.groupBy("user_id", "card_id").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    out = candidates.join(sums, ["user_id", "card_id"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("low", "high")})
    fee = F.when(F.col("is_owned"), 0.0).otherwise(F.coalesce(F.col("annual_fee").cast("double"), F.lit(0.0)))
    year = lambda c: (F.col(c) * (YEAR / days) - fee).alias(f"year_{c}")
    return out.select("user_id", "card_id", "is_owned", "low", "high", year("low"), year("high"), (F.col("low") == F.col("high")).alias("certain"))
