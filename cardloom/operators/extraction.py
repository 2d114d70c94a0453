"""Benefits stated in lines of text, as typed terms.

A line is first put into one form: lower case, single words, amounts as ``sum N``, percentages as ``N percent``, plain plurals
as singulars, filler words gone, periods as one word. Terms are then read as a number before or after some words of that
form. Parsers are tried in a fixed order, and the first whose terms are there makes the benefit. All of it is native
expressions, so a document's lines never leave the JVM. Lines that ask, deny or hedge state no benefit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from cardloom.functions.rules import once
from cardloom.operators.settle import settled, spread

TERMS = ("category", "value_type", "value", "rate", "cap", "threshold", "period", "effective_to")

#: Lines with these words state no benefit that holds.
NEGATIVE = ("no longer available", "discontinued", "not applicable", "is not offered", "withdrawn")
#: Signs of the currency, and what the words behind an amount multiply it by.
CURRENCY = ("₹", "rs.", "rs", "inr")
UNITS = {"lakh": 100_000, "lac": 100_000, "crore": 10_000_000}
#: Spellings that mean the same.
SAME = {
    "points": "point", "rewards": "reward", "spends": "spend", "miles": "mile", "visits": "visit", "lounges": "lounge", "movies": "movie", "rounds": "round", "games": "game", "lessons": "lesson",
    "services": "service", "days": "day", "lakhs": "lakh", "lacs": "lac", "crores": "crore", "waived": "waiver", "reversal": "waiver", "one": "1", "first": "1st", "discounted": "discount", "coverage": "cover",
    "earns": "earn", "earning": "earn", "get": "earn", "getting": "earn", "restaurants": "restaurant", "groceries": "grocery", "utilities": "utility", "pharmacies": "pharmacy", "payments": "payment", "bills": "bill",
    "purchases": "purchase", "stores": "store", "flights": "flight", "hotels": "hotel", "offers": "offer", "ends": "end", "expires": "expire", "times": "time",
}
#: Words that say nothing between a cue and its number.
FILLERS = ("of", "the", "a", "an")
#: Periods, and the words that come before one.
PERIODS = {"statement month": "statement month", "calendar month": "calendar month", "billing cycle": "statement month", "month": "month", "quarter": "quarter", "year": "year", "annum": "year", "week": "week", "day": "day"}
PERIOD_CUES = ("per", "in", "in 1", "in each")
#: The category of a discount by the first words found.
DISCOUNTS = (
    ("dining", ("dining", "restaurant", "eazydiner")), ("grocery", ("grocery", "supermarket", "bigbasket")), ("utility", ("utility", "bill payment")), ("healthcare", ("healthcare", "medical", "pharmacy", "hospital")),
    ("general", ("all spend", "all purchase", "all retail spend", "all retail purchase", "general spend", "general purchase", "general retail spend", "general retail purchase")),
    ("shopping", ("shopping", "retail", "department store")), ("travel", ("travel", "flight", "hotel")),
)
#: Words of a film benefit, of a limit, of a welcome, of a lounge visit.
FILM = ("movie", "cinema", "bookmyshow", "pvr", "inox")
LIMITS = ("capped at", "capped to", "maximum", "up to")
WELCOME = ("card issuance", "welcome", "joining", "1st usage")
LOUNGE = ("complimentary", "free", "domestic", "international", "airport", "lounge", "access")
UNTIL = ("valid until", "valid through", "offer end", "expire", "expire on", "effective until")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def said(line: Column) -> Column:
    """The one form of a line: words with single spaces, one at either end."""
    signs = "|".join(map(re.escape, CURRENCY))
    c = F.concat(F.lit(" "), F.regexp_replace(F.lower(line), r"(?<=\d),(?=\d)", ""), F.lit(" "))
    c = F.regexp_replace(c, rf"(?<![a-z])(?:{signs})[ ,]*(?=\d)", " sum ")
    c = F.regexp_replace(F.replace(c, F.lit("%"), F.lit(" percent ")), r"(?<=\d) ?[x×](?= )", " fold")
    words = F.filter(F.split(F.regexp_replace(c, r"(?<!\d)\.|\.(?!\d)|[^a-z0-9.×]+", " "), " +"), lambda w: ~w.isin("", *FILLERS))
    table = F.create_map(*[F.lit(x) for pair in SAME.items() for x in pair])
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " "), F.lit(" "))


class Line:
    """Reads numbers and amounts around words of a line in its one form."""

    def __init__(self, form: Column):
        self.c = form

    def has(self, *phrases: str) -> Column:
        return self.c.rlike(f" (?:{'|'.join(phrases)})(?= )")

    def _read(self, pattern: str, group: int = 1) -> Column:
        return once(F.regexp_extract(self.c, pattern, group), lambda found: F.when(found != "", found))

    def before(self, *phrases: str) -> Column:
        """The number right before one of the phrases."""
        return self._read(f" {NUMBER} (?:{'|'.join(phrases)})(?= )").cast("double")

    def after(self, *phrases: str, then: str = "") -> Column:
        """The number right after one of the phrases, and before then."""
        return self._read(f" (?:{'|'.join(phrases)}) {NUMBER}{' ' + then if then else ''}(?= )").cast("double")

    def amount(self, *phrases: str, then: str = "") -> Column:
        """The amount of money right after one of the phrases, and before then."""
        lead = f" (?:{'|'.join(phrases)})" if phrases else ""
        pattern = f"{lead} sum ([0-9]+(?:\\.[0-9]+)?(?: (?:{'|'.join(UNITS)}))?){' ' + then if then else ''}(?= )"

        def read(found):
            times, unit = F.lit(1.0), F.substring_index(found, " ", -1)
            for name, n in UNITS.items():
                times = F.when(unit == name, float(n)).otherwise(times)
            return F.when(found != "", F.substring_index(found, " ", 1).cast("double") * times)

        return F.when(F.contains(self.c, F.lit(" sum ")), once(F.regexp_extract(self.c, pattern, 1), read))

    def period(self) -> Column:
        name = self._read(f" (?:{'|'.join(PERIOD_CUES)}) ({'|'.join(PERIODS)})(?= )")
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair]), name)

    def until(self) -> Column:
        pattern = f" (?:{'|'.join(UNTIL)})(?: on)? ([0-9]{{1,2}}) ({'|'.join(MONTHS)}) ([0-9]{{4}})(?= )"
        month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), self._read(pattern, 2))
        return F.concat_ws("-", self._read(pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(self._read(pattern, 1), 2, "0"))


def read_terms(lines: DataFrame, text: str, form: str | None = None) -> DataFrame:
    """lines with the terms that the parsers ask for, each read once. form: their one form, where it is known."""
    lines = lines if form else settled(lines.withColumn("form", said(F.col(text))))
    x = Line(F.col("form"))
    denied = F.rtrim(F.col(text)).endswith("?")
    for words in NEGATIVE:
        denied = denied | F.contains(F.lower(F.col(text)), F.lit(words))
    category = F.coalesce(*[F.when(x.has(*words), F.lit(name)) for name, words in DISCOUNTS])
    terms = {
        "negative": denied, "capped": x.amount(*LIMITS), "spent": x.amount("spend", "spend above", "spend over", "spend more than"), "every": x.amount("for every", "per"), "per": x.period(), "until": x.until(),
        "points": x.before("reward point", "bonus reward point", "welcome reward point"), "movie": x.has(*FILM), "off": x.before("percent off", "percent discount"),
        "pair": (x.has("bogo") | x.has("buy 1") & x.has("earn 1")) & x.has("once", "twice", "[0-9]+ time"), "milestone": x.has("milestone"), "worth": x.amount("worth"), "every_spend": F.coalesce(x.amount("milestone"), x.amount("every spend")),
        "monthly": x.has("monthly"), "annual": x.has("annual"), "fuel": x.has("fuel surcharge waiver"), "fuel_rate": F.coalesce(x.before("percent fuel surcharge waiver"), x.after("fuel surcharge waiver", then="percent")),
        "times": x.before("fold reward point"), "point_cap": x.after(*LIMITS, then="reward point"), "welcome": x.has(*WELCOME, "within [0-9]+ day"), "first_use": x.has("1st usage"),
        "bonus": x.before("bonus reward point", "welcome reward point", "renewal reward point"), "miles": x.after("earn", then="(?:air )?mile"), "cover": F.when(x.has("insurance"), x.amount("cover", "cover up to")),
        "golf": x.has("complimentary golf (?:round|game|visit|lesson)"), "golf_visits": x.before("complimentary golf (?:round|game|visit|lesson)"),
        "concierge": x.has("concierge service", "concierge assistance") & x.has("complimentary", "dedicated", "24 fold 7", "24x7", "24×7", "round clock", "round-the-clock"),
        "fee": x.has("annual fee", "renewal fee", "membership fee") & x.has("waiver"), "discounted": x.after("discount", then="percent"), "spend_category": category, "film": x.has("movie", "cinema"), "cashback": x.has("cashback"),
        "up_to": x.has("up to"), "up_to_sum": x.has("up to sum"), "back": x.before("percent cashback"), "fixed_back": x.amount(then="cashback"), "earned": x.after("earn", then="reward point"),
        "visits": F.when(x.has("lounge"), x.before(f"(?:(?:{'|'.join(LOUNGE)}) )*visit")),
    }
    return settled(lines.select("*", *[c.alias(name) for name, c in terms.items()]))


def benefit() -> Column:
    """The benefit that the read terms make, a struct of TERMS; null if none."""

    def of(test: str, category: str, kind: str, **terms: str) -> Column:
        if kind in ("cashback", "reward_points", "lounge_access"):
            terms = {"effective_to": "nullif(until, '')"} | terms
        own = {"category": category, "value_type": f"'{kind}'"} | terms
        kinds = dict.fromkeys(TERMS, "double") | dict.fromkeys(("category", "value_type", "period", "effective_to"), "string")
        return F.when(F.expr(test), F.struct(*[F.expr(own.get(t, "NULL")).cast(kinds[t]).alias(t) for t in TERMS]))

    parsers = (
        of("movie AND off IS NOT NULL", "'entertainment'", "percent_discount", rate="off"),
        of("movie AND pair AND capped IS NOT NULL", "'entertainment'", "bogo", value="capped", period="per"),
        of("movie AND milestone AND worth IS NOT NULL AND every_spend IS NOT NULL", "'entertainment'", "milestone", value="worth", threshold="every_spend", period="CASE WHEN monthly THEN 'month' END"),
        of("fuel AND coalesce(fuel_rate, capped) IS NOT NULL", "'fuel'", "fuel_surcharge_waiver", rate="fuel_rate", cap="capped", period="per"),
        of("times IS NOT NULL", "'points'", "reward_multiplier", rate="times", cap="point_cap", period="per"),
        of("welcome AND points IS NOT NULL AND (spent IS NOT NULL OR first_use)", "'points'", "welcome_bonus", value="points", threshold="spent"),
        of("bonus IS NOT NULL AND spent IS NOT NULL", "'points'", "milestone_bonus", value="bonus", threshold="spent", period="CASE WHEN annual THEN 'year' END"),
        of("miles IS NOT NULL AND every IS NOT NULL", "'miles'", "air_miles", value="miles", threshold="every"),
        of("cover IS NOT NULL", "'insurance'", "insurance_cover", value="cover", cap="cover"),
        of("golf", "'golf'", "golf_access", value="golf_visits", period="per"),
        of("concierge", "'concierge'", "concierge_access"),
        of("fee AND spent IS NOT NULL", "'other'", "fee_waiver", threshold="spent", period="'year'"),
        of("NOT cashback AND NOT film AND coalesce(off, discounted) IS NOT NULL AND spend_category IS NOT NULL", "spend_category", "percent_discount", rate="coalesce(off, discounted)", cap="capped", period="per"),
        of("cashback AND (back IS NOT NULL OR fixed_back IS NOT NULL AND NOT up_to_sum)", "'cashback'", "cashback", value="CASE WHEN back IS NULL THEN fixed_back END", rate="back", cap="CASE WHEN back IS NOT NULL OR NOT up_to THEN capped END", period="per"),
        of("earned IS NOT NULL", "'points'", "reward_points", value="earned", threshold="every"),
        of("visits IS NOT NULL", "'travel'", "lounge_access", value="visits", period="per"),
    )
    return F.when(~F.col("negative"), F.coalesce(*parsers))


def benefits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, the terms) of every line that states a benefit."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    # most lines are prose: a cheap test comes before the parsers
    may = lines.where(F.col("line").rlike(r"(?i)(point|cashback|waiv|%|lounge|golf|concierge|mile|cover|buy|bogo|reversal|worth)"))
    read = read_terms(spread(may, id_col), "line").select(id_col, "line_no", benefit().alias("b"))
    return read.where("b IS NOT NULL").select(id_col, "line_no", "b.*")


# ---------------------------------------------------------------- benefits over several lines, and what they come to

#: Words with which a clause of its own begins.
OPENINGS = ("earn", "enjoy", "buy", "avail", "complimentary", "welcome", "annual", "fuel", "insurance", "concierge")
#: Lines behind one that may belong to it.
REACH = 6


def opens(form: Column) -> Column:
    """Whether a clause of its own begins with a line in its one form."""
    return form.rlike(f"^ (?:{'|'.join(OPENINGS)}) ")


def clause(i: Column, arr: str, forms: str, reach: int = REACH) -> Column:
    """The line at place i with those after it up to the next clause of its own, at most reach of them. forms: all lines in their one form."""

    def joined(n):
        return F.concat_ws(" ", F.get(arr, i), F.array_join(F.slice(arr, i + 2, n), " "))

    stop = F.array_position(F.transform(F.slice(forms, i + 2, F.lit(reach)), opens), F.lit(True)).cast("int")
    return once(stop, lambda s: joined(F.when(s > 0, s - 1).otherwise(F.lit(reach))))


def document_benefits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """benefits, and those that a line begins and the lines after it complete: a pair or milestone whose terms follow, a discount
    whose limit does. (id, line_no, the terms)."""
    rows = spread(docs.select(id_col, text_col), id_col).select(id_col, F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("arr"))
    rows = settled(settled(rows).withColumn("forms", F.transform("arr", said)))
    lines = settled(rows.select(id_col, "arr", "forms", F.posexplode("arr").alias("line_no", "line")).withColumn("form", F.get("forms", F.col("line_no"))))
    lead = F.col("form").rlike(r" (?:bogo|buy 1|milestone|every spend|percent off|percent discount)(?= )")
    may = lines.where(lead | F.col("line").rlike(r"(?i)(point|cashback|waiv|%|lounge|golf|concierge|mile|cover|worth)"))
    may = may.withColumn("whole", F.when(lead, clause(F.col("line_no"), "arr", "forms")))
    alone = read_terms(settled(may.select(id_col, "line_no", "line", "form", "whole")), "line", "form").select(id_col, "line_no", "whole", benefit().alias("one"))
    open_ = F.col("one").isNull() | (F.col("one.value_type") == "percent_discount") & F.col("one.cap").isNull()
    both = read_terms(settled(alone.withColumn("text", F.when(open_, F.col("whole")))), "text").select(id_col, "line_no", "one", benefit().alias("more"))
    chosen = F.when(F.col("one").isNull() | F.col("more.cap").isNotNull(), F.coalesce("more", "one")).otherwise(F.col("one"))
    return both.select(id_col, "line_no", chosen.alias("b")).where("b IS NOT NULL").select(id_col, "line_no", "b.*")


#: Words with which a question begins; words that refuse, that speak of a limit reached or of former terms; words of
#: lists of merchants, and words that point to one.
QUESTIONS = ("what", "which", "how", "when", "where", "why", "can", "will", "does", "is", "are")
REFUSALS = ("not eligible", "never eligible", "not applicable", "never applicable", "not qualify", "not included in", "excluded from", "ineligible for", "transaction amounting", "capping reached")
FORMER = ("earlier", "capping")
LISTS, POINTERS = ("category", "categories", "code", "codes", "mcc", "mccs", "merchant", "merchants"), ("stated", "listed", "provided", "detailed", "identified")


def no_offer(line: Column) -> Column:
    """Whether a line only looks like an offer: it asks, refuses, tells of former terms, is a bare rate, or points to a list."""
    x = Line(said(line))
    first = F.substring_index(F.ltrim(x.c), " ", 1)
    asks = first.isin(*QUESTIONS) & F.rtrim(line).endswith("?")
    bare = x.c.rlike(f"^ {NUMBER} (?:percent cashback|fold reward point) $")
    return asks | x.has(*REFUSALS) | first.isin(*FORMER) | bare | x.has(*LISTS) & x.has(*POINTERS)


def projected(found: DataFrame, card: str, url: str, excerpt: str) -> DataFrame:
    """(card, value_type, subject, the terms, pages): observations of offers without lines that are none, those of one subject whose
    terms agree put together; of each the terms of its strongest observation, the one that knows most."""
    from cardloom.functions.rules import offer_subject
    from cardloom.operators.cluster import TERMS as KNOWN, clusters

    rows = found.where(~no_offer(F.col(excerpt)))
    rows = rows.withColumns({"subject": offer_subject(F.col("category"), F.col("value_type"), F.col(excerpt)), "strength": F.size(F.array_compact(F.array(*[F.col(t).cast("string") for t in KNOWN])))})
    key = [card, "value_type", "subject"]
    placed = clusters(rows.select(*key, F.col(url).alias("url"), "strength", *KNOWN), key)
    named = rows.select(*key, F.col(url).alias("url"), *KNOWN).join(placed, [*key, "url"])
    return named.groupBy(*key, "cluster").agg(*[F.min(F.when(F.col("strongest"), F.col(t))).alias(t) for t in KNOWN], F.count_distinct("url").alias("pages")).drop("cluster")
