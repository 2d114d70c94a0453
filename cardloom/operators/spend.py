"""Spend analytics: which transactions count, de-duplication, roll-ups, trends, leading groups.

Operators take transactions with the columns of the view ``transactions``. Amounts stay decimal; the grouped results are
doubles only at the end. First-row-wins is a grouped minimum by ingest place, which combines before the shuffle and so
bears a key that holds many of the rows; nothing is numbered in a window over raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The five types a stored transaction can have; any other reads as debit.
TYPES = ("debit", "credit", "refund", "fee", "reward")
NATURAL_KEY = ("user_id", "user_card_id", "transaction_date", "description", "amount")


def decoded_type(c: Column) -> Column:
    return F.when(c.isin(*TYPES), c).otherwise(F.lit("debit"))


def eligible() -> Column:
    """Debits that are no cash withdrawals; without a normalised type they count."""
    return (decoded_type(F.col("transaction_type")) == "debit") & ~F.col("normalized_type").eqNullSafe("cash_withdrawal")


def sound_amount(c: Column) -> Column:
    d = c.cast("double")
    return c.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf"))


def between(c: Column, start=None, through=None) -> Column:
    """Closed bounds, either of which may be missing."""
    out = F.lit(True)
    if start is not None:
        out = out & (c >= F.lit(start).cast("timestamp_ntz"))
    if through is not None:
        out = out & (c <= F.lit(through).cast("timestamp_ntz"))
    return out


def first_of(df: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """For each key the row that is least by order."""
    rest = [c for c in df.columns if c not in key]
    held = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return held.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def purchases(txns: DataFrame, start=None, through=None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Canonical purchases: eligible, of a sound amount, in the period, each natural key once.

    keep: the columns besides the key and pos that are needed; only these are shuffled. Left out, all are.
    """
    rows = txns.where(between(F.col("transaction_date"), start, through) & eligible() & sound_amount(F.col("amount")))
    return first_of(rows if keep is None else rows.select(*NATURAL_KEY, "pos", *keep), NATURAL_KEY, "pos")


def reward() -> Column:
    r = F.col("reward_earned")
    return F.when(sound_amount(r), r).otherwise(F.lit(0).cast("decimal(12,2)"))


def total(c: Column | str) -> Column:
    return F.sum(c).cast("double")


def retail_totals(bought: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    return bought.groupBy(*by).agg(total("amount").alias("total_spend"), total(reward()).alias("total_rewards"), F.count("*").alias("purchases"))


def category_totals(bought: DataFrame) -> DataFrame:
    return bought.groupBy("user_id", F.coalesce("category", F.lit("Other")).alias("category")).agg(total("amount").alias("amount"))


def local_date(zone: str) -> Column:
    """Calendar day in the reporting zone of an instant stored in UTC."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("transaction_date")))


def month_trend(bought: DataFrame, now: str, months: int = 6, zone: str = "UTC") -> DataFrame:
    """(user_id, month_index, spend, rewards) for every user and each of the months up to now, with zeros."""
    today = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit(now).cast("timestamp_ntz")))
    day = local_date(zone)
    back = (F.year(today) * 12 + F.month(today)) - (F.year(day) * 12 + F.month(day))
    index = F.lit(months - 1) - back
    def of(k: int, c: Column) -> Column:
        return F.coalesce(F.sum(F.when(index == k, c)).cast("double"), F.lit(0.0))

    # one pass: a user's months are columns of one group, so no calendar is joined
    per_user = bought.groupBy("user_id").agg(F.array(*[F.struct(of(k, F.col("amount")).alias("spend"), of(k, reward()).alias("rewards")) for k in range(months)]).alias("m"))
    return per_user.select("user_id", F.posexplode("m").alias("month_index", "x")).select("user_id", "month_index", "x.spend", "x.rewards")


# ---------------------------------------------------------------- insights


def merchant_value() -> Column:
    return F.lower(F.trim(F.coalesce("merchant_name", F.lit(""))))


def title(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000))


def spend_insights(txns: DataFrame, start: str, end: str) -> DataFrame:
    """Per user the leading group of each of seven kinds. Rows are not de-duplicated here and any amount counts."""
    rows = txns.where(eligible() & between(F.col("transaction_date"), start, end))
    merchant, category = merchant_value(), F.col("category")
    label = F.when(merchant == "", F.lit("Unknown merchant")).otherwise(F.trim("merchant_name"))

    def kind(name, test, key, shown):
        return F.when(test, F.struct(F.lit(name).alias("kind"), key.alias("key"), shown.alias("label")))

    other = F.coalesce(category, F.lit("other"))
    movie = (category == "entertainment") & (F.col("platform").isNotNull() | F.col("merchant_subtype").eqNullSafe("movie_platform"))
    kinds = F.array_compact(F.array(
        kind("category", F.lit(True), other, title(other)), kind("merchant", merchant != "", merchant, label), kind("movie", movie, merchant, label),
        kind("travel", category == "travel", merchant, label), kind("ecommerce", F.col("channel") == "online", merchant, label),
        kind("foodGrocery", category.isin("food", "grocery"), merchant, label), kind("fuel", category == "fuel", merchant, label)))
    groups = rows.select("user_id", "amount", "pos", F.explode(kinds).alias("k")).where("k.key <> ''")
    groups = groups.groupBy("user_id", "k.kind", "k.key").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), F.min_by("k.label", "pos").alias("label"))
    best = groups.groupBy("user_id", "kind").agg(F.min(F.struct((-F.col("amount")).alias("a"), (-F.col("n")).alias("b"), F.col("key"), F.col("label"))).alias("top"))
    unresolved = F.when(category.isNull() | (category == "other") | (merchant == ""), F.col("amount"))
    totals = rows.groupBy("user_id").agg(F.sum("amount").alias("all"), F.coalesce(F.sum(unresolved), F.lit(0)).alias("open"))
    share = lambda x: F.when(F.col("all") == 0, F.lit(0.0)).otherwise(F.round(x.cast("double") / F.col("all").cast("double"), 6))
    amount = -F.col("top.a")
    return best.join(totals, "user_id").select("user_id", "kind", F.col("top.key").alias("key"), F.col("top.label").alias("label"), amount.cast("double").alias("amount"), (-F.col("top.b")).alias("transactions"), F.col("all").cast("double").alias("total_eligible"), F.col("open").cast("double").alias("unresolved"), share(amount).alias("share"), share(F.col("open")).alias("unresolved_share"))


# ---------------------------------------------------------------- trends and ledgers


def spend_trend(bought: DataFrame, start: str, through: str) -> DataFrame:
    """Per user: average over days with spend, peak day (earliest on ties), change against the equally long window before."""
    begin, end = F.lit(start).cast("date"), F.date_add(F.lit(through).cast("date"), 1)
    length = F.datediff(end, begin)
    day = F.to_date("transaction_date")
    days = bought.where((day >= F.date_sub(begin, length)) & (day < end)).groupBy("user_id", day.alias("day")).agg(F.sum("amount").alias("amount"))
    now = F.col("day") >= begin
    out = days.groupBy("user_id").agg(
        F.sum(F.when(now, F.col("amount"))).alias("total"), F.count_if(now).alias("days"), F.min(F.when(now, F.struct((-F.col("amount")).alias("a"), "day"))).alias("peak"),
        F.coalesce(F.sum(F.when(~now, F.col("amount"))), F.lit(0)).alias("prior")).where("days > 0")
    change = F.when(F.col("prior") > 0, F.round((F.col("total").cast("double") - F.col("prior").cast("double")) / F.col("prior").cast("double") * 100, 4))
    return out.select("user_id", F.col("total").cast("double").alias("total"), "days", F.round(F.col("total").cast("double") / F.col("days"), 4).alias("daily_average"), F.col("peak.day").alias("peak_day"), (-F.col("peak.a")).cast("double").alias("peak_amount"), change.alias("change_percent"))


def monthly_category_spend(txns: DataFrame) -> DataFrame:
    """Debits by month and category; cash is not excluded here and every row counts."""
    month = F.date_format("transaction_date", "yyyy-MM")
    return txns.where(decoded_type(F.col("transaction_type")) == "debit").groupBy(month.alias("month"), F.coalesce("category", F.lit("Other")).alias("category")).agg(total("amount").alias("amount"))


def top_category(bought: DataFrame) -> DataFrame:
    """The category of the largest total; of equal ones that first seen last."""
    groups = bought.groupBy("user_id", F.coalesce("category", F.lit("Other")).alias("category")).agg(F.sum("amount").alias("amount"), F.min("pos").alias("seen"))
    best = groups.groupBy("user_id").agg(F.max(F.struct("amount", "seen", "category")).alias("top"))
    return best.select("user_id", F.col("top.category").alias("category"), F.col("top.amount").cast("double").alias("amount"))


def grouped_ledger(txns: DataFrame, by: str = "user_card_id") -> DataFrame:
    """Headers of the ledger's groups: all rows, and the subtotal over canonical purchases alone."""
    marked = txns.groupBy(by).agg(F.count("*").alias("n_rows"), F.max("transaction_date").alias("latest"))
    sums = purchases(txns, keep=() if by in NATURAL_KEY else (by,)).groupBy(by).agg(total("amount").alias("subtotal"))
    return marked.join(sums, by, "left").select(by, "n_rows", "latest", F.coalesce("subtotal", F.lit(0.0)).alias("subtotal"))


def card_month_to_date(txns: DataFrame, now: str) -> DataFrame:
    start = F.date_trunc("month", F.lit(now).cast("timestamp_ntz"))
    rows = txns.where((decoded_type(F.col("transaction_type")) == "debit") & (F.col("transaction_date") >= start) & (F.col("transaction_date") <= F.lit(now).cast("timestamp_ntz")))
    return rows.groupBy("user_card_id").agg(total("amount").alias("spend"))


def foreign_spend(txns: DataFrame, card_bank: DataFrame, market: Column) -> DataFrame:
    """Transactions in another currency than the market of the card's bank; false where that is unknown. card_bank: (card_id, bank)."""
    joined = txns.join(card_bank.withColumn("market", market), F.col("user_card_id") == F.col("card_id"), "left")
    flag = F.coalesce(F.upper("currency") != F.col("market"), F.lit(False))
    return joined.withColumn("foreign", flag)


def reward_balances(txns: DataFrame) -> DataFrame:
    """Earned rewards by user, card and kind, under a digest of the key."""
    rows = txns.where(F.col("reward_earned").isNotNull()).groupBy("user_id", "user_card_id", F.coalesce("category", F.lit("points")).alias("reward_type")).agg(total("reward_earned").alias("total_earned"), F.max("transaction_date").alias("last_earned"), F.min("transaction_date").alias("first_earned"))
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.col("user_card_id").cast("string"), "reward_type")
    return rows.select(F.sha2(key, 256).alias("id"), "user_id", "user_card_id", "reward_type", "total_earned", F.col("total_earned").alias("available_balance"), F.lit(0.0).alias("redeemed"), "last_earned", "first_earned")


def uncategorized(txns: DataFrame, known: tuple[str, ...]) -> DataFrame:
    c = F.col("category")
    return txns.where(c.isNull() | (c == "other") | ~c.isin(*known))


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
