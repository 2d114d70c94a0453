"""Offer rules: open JSON to one of six offer types, and what each is worth for a request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardloom.operators.settle import settled, spread

#: Booking platforms by the names that partners have.
PLATFORMS = {"bookmyshow": "BookMyShow", "district": "Zomato", "zomato": "Zomato", "pvr": "PVR", "inox": "INOX", "cinepolis": "Cinepolis", "moviemax": "Moviemax"}
#: How much a platform's confidence counts.
CONFIDENCE = {"explicit": 3, "communityConfirmed": 2, "unconfirmed": 1, "notRequested": 0}


@dataclass(frozen=True)
class Request:
    tickets: int
    price: float
    platform: str | None
    now: str

    @property
    def gross(self) -> float:
        return self.tickets * self.price


class Config:
    """Getters of the members of an open JSON object, read into columns of their own: a number may be written as text, a text must be one."""

    def __init__(self, column: str):
        self.text = F.col(column)

    def read(self, rows: DataFrame, numbers: tuple[str, ...], texts: tuple[str, ...]) -> DataFrame:
        """rows with each member read once, as text, and of texts the type too; the object is parsed once for all types."""
        rows = settled(rows.withColumn("_parsed", F.try_parse_json(self.text)))
        kinds = {f"kind_{k}": F.schema_of_variant(F.try_variant_get("_parsed", f"$.{k}", "variant")) for k in texts}
        return settled(rows.withColumns({f"own_{k}": F.get_json_object(self.text, f"$.{k}") for k in numbers + texts} | kinds).drop("_parsed"))

    def number(self, key: str) -> Column:
        n = F.col(f"own_{key}").try_cast("double")
        return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)

    def integer(self, key: str) -> Column:
        n = self.number(key)
        return F.when(n == F.round(n), n.cast("int"))

    def string(self, key: str) -> Column:
        t = F.trim(f"own_{key}")
        return F.when((F.col(f"kind_{key}") == "STRING") & (t != ""), t)


def normalised_rules(sources: DataFrame) -> DataFrame:
    """Sources with offer_type, its terms, and reason where no offer can be made of the object. Nothing is ever made up."""
    c = Config("value_config")
    numbers = ("discount_percent", "threshold_amount", "reward_value", "multiplier", "base_rate", "annual_cap", "currency_unit", "discount_amount", "max_discount_per_transaction", "monthly_cap", "min_transaction")
    integers, texts = ("max_usage_per_month", "max_usage_per_period"), ("discount_type", "unit", "milestone_type", "category", "usage_period")
    read = {f"n_{k}": c.number(k) for k in numbers} | {f"i_{k}": c.integer(k) for k in integers} | {f"s_{k}": c.string(k) for k in texts}
    rows = settled(c.read(spread(sources, "benefit_id"), numbers + integers, texts).select("*", *[v.alias(k) for k, v in read.items()]))
    monthly, given = F.col("i_max_usage_per_month"), F.lower("s_usage_period")
    rows = rows.withColumns({
        "kind": F.lower("s_discount_type"), "percent": F.col("n_discount_percent"), "threshold": F.col("n_threshold_amount"), "reward": F.col("n_reward_value"), "unit": F.col("s_unit"), "cap": F.col("n_max_discount_per_transaction"),
        "rate": F.coalesce("n_multiplier", "n_base_rate"), "annual": F.coalesce("n_annual_cap", "n_reward_value", "n_currency_unit"), "amount": F.col("n_discount_amount"), "limit": F.coalesce(monthly, F.col("i_max_usage_per_period")),
        "period": F.when(monthly.isNotNull(), F.lit("month")).when(given.isin("month", "quarter", "year"), given), "movies": F.array_contains(F.transform(F.split(F.lower(F.coalesce("s_category", F.lit(""))), ","), lambda x: F.trim(x)), "movies")})
    col = F.col
    rows = rows.withColumn(
        "shape",
        F.when(col("kind") == "bogo", F.lit("bogo")).when((col("kind") == "percent") | col("percent").isNotNull(), F.lit("percentDiscount"))
        .when(col("s_milestone_type").isNotNull() | col("threshold").isNotNull(), F.lit("milestone")).when(col("movies") & col("rate").isNotNull() & (F.lower("unit") != "fixed"), F.lit("rewardMultiplier"))
        .when(F.lower("unit") == "fixed", F.lit("annualAllowance")).when(col("amount").isNotNull(), F.lit("fixedDiscount")))

    def bad(name: str) -> Column:
        return col(name).isNull() | (col(name) <= 0)

    tests = (
        (None, None, "no_offer_type"), ("bogo", bad("cap"), "bogo_needs_cap"), ("bogo", bad("limit"), "bogo_needs_limit"), ("bogo", col("period").isNull(), "bogo_needs_period"), ("percentDiscount", bad("percent") | (col("percent") > 100), "percent_out_of_range"),
        ("milestone", col("threshold").isNull() | col("reward").isNull(), "milestone_incomplete"), ("rewardMultiplier", bad("rate"), "rate_not_positive"), ("annualAllowance", bad("annual"), "allowance_not_positive"), ("fixedDiscount", bad("amount"), "discount_not_positive"),
    )
    reason = F.coalesce(*[F.when(col("shape").isNull() if name is None else (col("shape") == name) & test, F.lit(said)) for name, test, said in tests])
    rows = rows.withColumn("reason", reason).withColumn("offer_type", F.when(col("reason").isNull(), col("shape")))
    ok = lambda name, column: F.when(col("offer_type") == name, col(column))
    return settled(rows.select(
        *[F.col(f"`{c}`") for c in sources.columns], "offer_type", "reason", ok("percentDiscount", "percent").alias("discount_percent"), F.coalesce(ok("bogo", "cap"), ok("percentDiscount", "cap")).alias("transaction_cap"),
        ok("fixedDiscount", "amount").alias("fixed_amount"), ok("fixedDiscount", "n_monthly_cap").alias("cycle_cap"), ok("bogo", "limit").alias("redemption_limit"), ok("bogo", "period").alias("cycle_period"), ok("milestone", "threshold").alias("milestone_threshold"),
        ok("milestone", "reward").alias("milestone_reward"), ok("annualAllowance", "annual").alias("annual_allowance"), ok("rewardMultiplier", "rate").alias("reward_rate"), ok("rewardMultiplier", "unit").alias("reward_unit"),
        F.when(col("offer_type").isin("bogo", "percentDiscount", "fixedDiscount"), col("n_min_transaction")).alias("min_transaction")))


def eligible_platforms(partners: Column) -> Column:
    """Booking platforms among the partners, in their own names."""
    names = F.create_map(*[F.lit(x) for kv in PLATFORMS.items() for x in kv])
    return F.array_distinct(F.array_compact(F.transform(partners, lambda p: F.try_element_at(names, F.lower(F.trim(p))))))


def ineligible(r: Request) -> Column:
    """First reason why a rule does not apply; null if it does."""
    now = F.lit(r.now).cast("timestamp_ntz")
    limit = (F.col("offer_type") == "bogo") & (F.col("usage_confidence") == "verified") & (F.col("used_transactions") >= F.col("redemption_limit"))
    return (
        F.when(F.lit(r.gross) < F.col("min_transaction"), F.lit("below_minimum")).when(now > F.col("valid_until").cast("timestamp_ntz"), F.lit("expired"))
        .when((F.col("offer_type") == "milestone") & F.col("milestone_spend").isNull(), F.lit("milestone_unknown"))
        .when((F.col("offer_type") == "milestone") & (F.col("milestone_spend") < F.col("milestone_threshold")), F.lit("milestone_not_met")).when(limit, F.lit("limit_reached"))
    )


def platform_confidence(r: Request, eligible: Column, confirmed: Column) -> Column:
    """A platform that does not match lowers the confidence; it never rules an offer out."""
    if r.platform is None:
        return F.when(F.size(eligible) > 0, F.lit("explicit")).when(F.size(confirmed) > 0, F.lit("communityConfirmed")).otherwise(F.lit("notRequested"))
    asked = r.platform.lower()
    has = lambda names: F.exists(names, lambda p: F.lower(p) == asked)
    return F.when(has(eligible), F.lit("explicit")).when(has(confirmed), F.lit("communityConfirmed")).otherwise(F.lit("unconfirmed"))


def savings(r: Request) -> Column:
    """What the offer saves of the request: never more than its price; programmes without a sum of money save nothing."""
    price, gross, cap = F.lit(r.price), F.lit(r.gross), F.col("transaction_cap")
    kind = F.col("offer_type")
    raw = (
        F.when(kind == "bogo", F.lit(float(r.tickets // 2)) * F.least(price, cap)).when(kind == "percentDiscount", F.least(gross * F.col("discount_percent") / 100, cap))
        .when(kind == "fixedDiscount", F.least(F.col("fixed_amount"), F.col("cycle_cap"))).when(kind == "milestone", F.col("milestone_reward")).otherwise(F.lit(0.0))
    )
    return F.greatest(F.lit(0.0), F.least(raw, gross))


def evaluated(rules: DataFrame, r: Request) -> DataFrame:
    """Accepted rules with reason, savings, confidence, tier and an explanation."""
    eligible, confirmed = eligible_platforms(F.split("partners", ",")), F.filter(F.split("confirmed", ","), lambda p: p != "")
    kind = F.col("offer_type")
    rows = rules.where(kind.isNotNull()).withColumns({"ineligible": ineligible(r), "savings": savings(r), "confidence": platform_confidence(r, eligible, confirmed)})
    rows = rows.withColumn("final_amount", F.lit(r.gross) - F.col("savings"))
    free = (kind == "percentDiscount") & F.col("transaction_cap").isNull() | (kind == "fixedDiscount") & F.col("cycle_cap").isNull()
    sure = ((F.col("usage_confidence") == "verified") | free) & (F.col("confidence") == "explicit")
    ranked = F.col("ineligible").isNull() & ~kind.isin("rewardMultiplier", "annualAllowance")
    whole = lambda c: F.format_string("%.0f", c)
    text = (
        F.when(kind == "bogo", F.concat(F.lit("BOGO up to "), whole(F.col("transaction_cap")), F.lit(", "), F.col("redemption_limit").cast("string"), F.lit(" a "), F.col("cycle_period")))
        .when(kind == "annualAllowance", F.concat(F.lit("Up to "), whole(F.col("annual_allowance")), F.lit(" a year"))).when(kind == "rewardMultiplier", F.concat(whole(F.col("reward_rate")), F.lit(" "), F.col("reward_unit")))
        .otherwise(F.concat(kind, F.lit(" saves "), F.format_string("%.2f", F.col("savings")), F.lit(" ("), F.col("usage_confidence"), F.lit(" usage)")))
    )
    return settled(rows.withColumns({"tier": F.when(ranked, F.when(sure, F.lit("guaranteed")).otherwise(F.lit("potential"))), "explanation": text}))


def ranked_deals(offers: DataFrame, most: int | None = None) -> DataFrame:
    """Place of each ranked offer in its tier, overall and among owned cards. most: only the first so many of either ranking,
    with the places up to it; then every partition ranks its own offers first, and few of them are shuffled."""
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    order = [F.desc("savings"), F.asc("final_amount"), F.desc(sure[F.col("confidence")]), F.desc("display_priority"), F.asc("catalog_card_id"), F.asc("benefit_id")]
    rows = offers.where("tier IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("tier").orderBy(*order))
    own_place = F.row_number().over(Window.partitionBy("tier", "is_owned").orderBy(*order))
    if most is None:
        return rows.withColumns({"place": place, "owned_place": F.when(F.col("is_owned"), own_place)})
    none = F.lit(None).cast("int")
    first = rows.withColumn("place", place).where(F.col("place") <= most).withColumn("owned_place", none)
    own = rows.where("is_owned").withColumn("owned_place", own_place).where(F.col("owned_place") <= most).withColumn("place", none)
    key = [c for c in first.columns if c not in ("place", "owned_place")]
    return first.unionByName(own).groupBy("tier", "benefit_id").agg(*[F.first(c).alias(c) for c in key if c not in ("tier", "benefit_id")], F.max("place").alias("place"), F.max("owned_place").alias("owned_place"))
