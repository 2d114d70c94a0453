"""What a page says of the end of a product, read as a sequence of clauses.

``clauses`` cuts a page into items: headings, table rows, product tiles and tables (which end what a heading spoke of), status
elements, and the clauses of all other text. ``judged`` tells what each says by itself. ``evidence`` goes through them once, as
an automaton whose state is the heading in force, what was said under it, and the evidence so far. A heading that names all words of the product opens its
scope; one that names another product closes it; one of plain section words leaves it. Under the heading these count:

- a clause with the product as its subject, or on a page without headings, anywhere;
- a clause or status element with no subject of its own;
- "this card", if neither the clauses before it under the heading compare products nor the last words before it name another.

A table row counts alone. Any word that is neither the product's, its issuer's, nor one of plain lifecycle speech makes the
subject another product's, and so does a named card other than the product.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words that tell no product.
FILLERS = ("bank", "credit", "card", "cards", "the", "and", "with")
#: Words of headings of plain sections.
SECTIONS = (
    "about", "access", "annual", "application", "apply", "apr", "availability", "benefit", "benefits", "charge", "charges", "contact", "details", "document", "documents", "eligibility", "faq", "feature", "features", "fee", "fees", "frequently", "how", "important", "information",
    "interest", "joining", "key", "lounge", "milestone", "offer", "offers", "overview", "points", "pricing", "product", "question", "questions", "rate", "rates", "reward", "rewards", "status", "term", "terms", "update", "notice", "discontinuation", "welcome",
)
#: Words with which the end of a product is told.
LIFECYCLE = (
    "and", "april", "august", "available", "been", "december", "discontinued", "due", "effective", "february", "from", "has", "immediate", "immediately", "is", "issued", "january", "july", "june", "longer", "march", "may", "no", "not", "november", "october", "of", "on", "portfolio",
    "review", "september", "the", "this", "to", "withdrawn",
)
#: Words that set products side by side, and those that do so behind a clause's subject.
COMPARING = ("alternative", "compare", "comparison", "related", "successor", "replacement", "replace", "replaces", "replaced", "versus", "vs")
TURNING = (*COMPARING, "instead", "other", "while", "whereas")
#: The length of an excerpt, and how far behind its heading "this card" is read.
EXCERPT, NEAR = 512, 2000

ENDED = r"(?:discontinued|withdrawn|no\s+longer\s+(?:available|issued))"
THIS = r"\b(?:this|the)\s+(?:credit\s+)?card\b"
_TAGGED = r"""(?is)<(?:div|span|p|td)\b[^>]*\b(?:class|data-status|aria-label)\s*=\s*["'][^"']*(?:status|availability)[^"']*["'][^>]*>"""
_TILE = r"""(?is)<(?:table\b|(?:div|section|article)\b[^>]*\b(?:class|data-component)\s*=\s*["'][^"']*(?:product[-_ ]?card|card[-_ ]?product|product[-_ ]?tile)[^"']*["'])[^>]*>"""
ITEM = "struct<kind:string,text:string,cells:array<string>>"
STATE = "struct<on:boolean,head:string,no:int,said:int,mixed:boolean,pos:int,found:array<struct<no:int,rule:int,pos:int,excerpt:string>>>"


def words(c: Column) -> Column:
    """Words of two characters and more that may tell a product."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*FILLERS))


def tidy(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clauses(html: Column) -> Column:
    """A page as an array of ITEM: kind h (heading), r (table row with its cells), b (a table or tile begins), s (status element), t (clause)."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    for pattern, mark in (
        (r"(?i)<h[1-6]\b[^>]*>", "\x01h"), (r"(?i)</h[1-6]\s*>", "\x01t"), (r"(?i)<tr\b[^>]*>", "\x01r"), (r"(?i)</(?:tr|table)\s*>", "\x01t"), (r"(?i)</t[dh]\s*>", "\x02\n"), (_TILE, "\x01b\x01t"), (_TAGGED, "\x01s"),
        (r"(?i)</(?:div|span|p)\s*>", "\n\x03"), (r"(?i)</?(?:article|aside|br|div|li|p|section)\b[^>]*>", "\n"), (r"<[^>]+>", " "), (r"(?i)&(?:nbsp|amp);", " "),
    ):
        t = F.regexp_replace(t, pattern, mark)
    parts = F.split(F.concat(F.lit("t"), t), "\x01", -1)

    def items(p):
        kind, rest = F.substring(p, 1, 1), F.substring(p, 2, 1 << 30)
        none = F.array().cast("array<string>")
        # a status element ends at the first closing tag; what follows is text again
        status = F.substring_index(rest, "\x03", 1)
        behind = F.when(F.contains(rest, F.lit("\x03")), F.substring(rest, F.length(status) + 2, F.length(rest))).otherwise(F.lit(""))
        cut = lambda x: F.filter(F.transform(F.split(F.translate(x, "\x02\x03", "\n\n"), r"(?<=[.!?])(?=\s|$)|\n"), tidy), lambda y: y.rlike("[^.!? ]"))
        item = lambda k, x, cells=none: F.struct(F.lit(k).alias("kind"), x.alias("text"), cells.alias("cells"))
        texts = lambda x, k: F.transform(cut(x), lambda y: item(k, y))
        plain = tidy(F.translate(rest, "\x02\x03", "  "))
        cells = F.filter(F.transform(F.split(F.translate(rest, "\x03", " "), "\x02"), tidy), lambda c: c != "")
        return (
            F.when(kind == "h", F.array(item("h", plain))).when(kind == "r", F.array(item("r", plain, cells))).when(kind == "b", F.array(item("b", F.lit(""))))
            .when(kind == "s", F.concat(F.array(item("s", tidy(status))), texts(behind, "t"))).otherwise(texts(rest, "t"))
        )

    return F.flatten(F.transform(parts, items))


class Subject:
    """A product and its issuer, and whom a text speaks of."""

    def __init__(self, product: Column, issuer: Column):
        """product, issuer: their words, as arrays."""
        self.product, self.issuer = product, issuer
        self.strong = F.array_except(self.product, self.issuer)
        gap = r"[\s\W_]*"
        self.direct = F.concat(F.lit(r"(?i)\b"), F.array_join(self.product, gap), F.lit(rf"\b(?:{gap}(?:credit{gap})?card)?{gap}(?:has{gap}been|is){gap}(?:discontinued|withdrawn|no{gap}longer{gap}(?:available|issued))\b"))
        self.issued_by = F.when(F.size(self.issuer) > 0, F.concat(F.lit(r"(?i)\b"), F.array_join(self.issuer, gap), F.lit(r"\b"))).otherwise(F.lit("(?!)"))

    def named(self, c: Column) -> Column:
        return F.size(F.array_except(self.product, words(c))) == 0

    def other_card(self, c: Column) -> Column:
        """Whether a card that is named, between stops, is another than the product."""
        def named(piece):
            own = F.regexp_extract(piece, r"(?i)^(.*)\bcard\b", 1)
            identity = F.filter(F.array_except(words(own), self.issuer), lambda w: w != "this")
            return (F.size(identity) > 0) & ((F.size(F.array_except(identity, self.strong)) > 0) | (F.size(identity) != F.size(self.strong)))

        return F.exists(F.split(c, r"[,:;.!?–—-]"), named)

    def competing(self, c: Column) -> Column:
        """Whether c has a word that belongs neither to the product nor to lifecycle speech."""
        rest = F.filter(F.array_except(F.array_except(words(c), self.product), self.issuer), lambda w: ~w.isin(*SECTIONS, *LIFECYCLE) & ~w.rlike(r"^\d{1,4}$"))
        return self.other_card(c) | (F.size(rest) > 0)

    def other_product(self, c: Column) -> Column:
        """Whether a heading or cell names another product."""
        own = words(c)
        bare = F.array_except(own, self.issuer)
        distinctive = F.filter(bare, lambda w: ~w.isin(*SECTIONS))
        section = F.size(distinctive) == 0
        short = (F.size(own) <= 6) & (F.length(c) <= 96)
        return ~self.named(c) & ~section & (c.rlike(r"(?i)\bcard\b") | (F.size(F.array_intersect(own, self.issuer)) > 0) | short)


def _any(of: tuple[str, ...]) -> str:
    return r"(?i)\b(?:" + "|".join(of) + r")\b"


def judged(items: Column, who: Subject) -> Column:
    """Items with what each says by itself: opens or closes the product's scope; row, direct, neutral, status: evidence by one of
    the rules; anaphora: it says so of "this card", before: its words up to that."""
    says = lambda c: c.rlike(rf"(?i)\b{ENDED}\b") & ~c.rlike(r"(?i)\bnot\s+(?:been\s+)?(?:discontinued|withdrawn)\b")
    pattern = r"\b(?:this|the)\s+(?:credit\s+)?card\s+(?:(?:has\s+been\s+|is\s+)(?:discontinued|withdrawn)|is\s+no\s+longer\s+(?:available|issued))\b"
    # a rule is asked only of items of its kind that have the words; most items have not
    only = lambda test, value: F.when(test, value).otherwise(F.lit(False))

    def one(x):
        c, kind = x["text"], x["kind"]
        heading, ended, text = kind == "h", c.rlike(rf"(?i)\b{ENDED}\b"), kind.isin("t", "s")
        rest = F.regexp_replace(F.regexp_replace(c, who.direct, " "), who.issued_by, " ")
        stray = F.exists(x["cells"], lambda y: ~y.rlike(rf"(?i)\b{ENDED}\b") & who.other_product(y))
        opens = only(heading, who.named(c))
        return F.struct(
            kind.alias("kind"), c.alias("text"), opens.alias("opens"), only(heading & ~opens, who.other_product(c)).alias("closes"),
            only(ended & (kind == "r"), who.named(c) & says(c) & ~comparing(c) & ~who.competing(c) & ~stray).alias("row"),
            only(ended & text, F.regexp_like(c, who.direct) & ~rest.rlike(_any((*TURNING, "card"))) & ~who.competing(rest)).alias("direct"),
            only(ended & text, says(c) & ~c.rlike("(?i)" + THIS) & ~comparing(c) & ~who.competing(c)).alias("neutral"),
            only(ended & (kind == "s"), says(c) & ~who.competing(c)).alias("status"),
            only(ended & text, c.rlike("(?i)" + pattern)).alias("anaphora"), only(ended, ~who.competing(F.regexp_extract(c, r"(?is)^(.*?)" + pattern, 1))).alias("alone"), F.regexp_extract(c, r"(?is)^(.*?)" + pattern, 1).alias("before"),
            only(text, comparing(c)).alias("compares"),
        )

    return F.transform(items, one)


def comparing(c: Column) -> Column:
    return c.rlike(_any(COMPARING))


def last_words(marked: Column, who: Subject) -> Column:
    """The items with lone: whether the clause before names no other product; asked only where the next item is an anaphora."""
    def one(x, i):
        before = F.get(marked, i - 1)
        own = F.when(x["anaphora"] & before["kind"].isin("t", "s"), ~who.competing(before["text"])).otherwise(F.lit(True))
        return F.struct(*[x[f].alias(f) for f in ("text", "opens", "closes", "row", "direct", "neutral", "status", "anaphora", "alone", "before", "compares", "kind")], own.alias("lone"))

    return F.transform(marked, one)


def evidence(marked: Column) -> Column:
    """The automaton: the best evidence of the items, in the order of headings, rules and places; null if none."""
    bare = ~F.exists(marked, lambda x: x["kind"] == "h")

    def step(state, x):
        on, text = state["on"], x["kind"].isin("t", "s")
        spoken = F.when(x["before"].rlike("[A-Za-z0-9]"), x["alone"] & ~comparing(x["before"])).otherwise(x["lone"])
        rule = (
            F.when(x["row"], 0).when(x["direct"] & (on | bare), 1).when(x["neutral"] & on, 2).when(x["status"] & on, 3)
            .when(x["anaphora"] & on & ~state["mixed"] & (state["said"] <= NEAR) & spoken, 4)
        )
        # the rule is read once
        entry = F.filter(F.transform(F.array(rule), lambda r: F.struct(
            F.when(r == 0, 0).otherwise(state["no"] + 1).alias("no"), r.alias("rule"), (state["pos"] + 0).alias("pos"),
            F.substring(tidy(F.concat(F.when((r == 0) | ~on, F.lit("")).otherwise(state["head"]), F.lit(" "), x["text"])), 1, EXCERPT).alias("excerpt"))), lambda e: e["rule"].isNotNull())
        return F.struct(
            F.when(x["opens"], True).when(x["closes"] | (x["kind"] == "b"), False).otherwise(on).alias("on"), F.when(x["opens"], x["text"]).otherwise(state["head"]).alias("head"), (state["no"] + F.when(x["opens"], 1).otherwise(0)).alias("no"),
            F.when(x["opens"], 0).otherwise(state["said"] + F.when(text, F.length(x["text"]) + 1).otherwise(0)).alias("said"), F.when(x["opens"], False).otherwise(state["mixed"] | x["compares"]).alias("mixed"), (state["pos"] + 1).alias("pos"),
            F.concat(state["found"], entry).alias("found")).cast(STATE)

    start = F.struct(F.lit(False).alias("on"), F.lit("").alias("head"), F.lit(0).alias("no"), F.lit(0).alias("said"), F.lit(False).alias("mixed"), F.lit(0).alias("pos"), F.array().alias("found")).cast(STATE)
    return F.aggregate(marked, start, step, lambda s: F.regexp_replace(F.array_min(s["found"])["excerpt"], r"(https?://[^\s?#]+)[?#]\S*", "$1"))
