"""Rules of catalogues, mails and pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cardloom.functions import text as T

#: Networks by the words that name them.
NETWORKS = (("americanexpress", "american express"), ("americanexpress", "amex"), ("mastercard", "mastercard"), ("mastercard", "master card"), ("rupay", "rupay"), ("visa", "visa"))
#: Query keys that a source may have, and words that its values must not have.
SOURCE_KEYS = ("document", "file", "locale", "version")
SECRET_WORDS = ("authorization", "bearer", "access token", "refresh token", "lease token", "password", "secret", "credential", "customer", "account", "phone", "email", "pan", "card number", "card no")
#: Words after "for" or "to" that make no person of what stands there.
NO_PERSON = (
    "applicant", "applicants", "cardholder", "cardholders", "customer", "customers", "member", "members", "user", "users", "access", "accelerated", "annual", "airport", "bank", "benefit", "benefits", "bonus", "cap", "cashback", "card", "conditions",
    "complimentary", "credit", "cover", "dining", "discount", "domestic", "earn", "enjoy", "exclusive", "fee", "fees", "forex", "fuel", "get", "international", "insurance", "interest", "lounge", "mastercard", "markup", "maximum", "milestone", "miles",
    "minimum", "mitc", "most", "movie", "offer", "offers", "important", "points", "program", "reward", "rewards", "rupay", "spend", "surcharge", "terms", "threshold", "ticket", "tickets", "travel", "unlimited", "visa", "waiver", "welcome", "zero", "apr", "renewal",
)
#: Parts of a page that hold no product.
CHROME = ("header", "nav", "footer", "aside")
#: What an offer is about, by category: the words looked for, and what some of them are called.
SUBJECTS = ("dining", "fuel", "grocery", "groceries", "travel", "movies", "movie", "online", "e-shopping", "e shopping", "upi", "international", "utility")
INSURED = ("air accident insurance", "personal accident insurance", "travel insurance", "purchase protection", "card fraud", "lost card")
CALLED = {"groceries": "grocery", "movies": "movie", "e-shopping": "online", "e shopping": "online"}
LIMITING = ("except", "excluding", "exclude", "excludes", "not valid", "not eligible", "does not apply")


def once(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def named_network(text: Column) -> Column:
    """The network whose words a text holds, the first of NETWORKS."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    return F.coalesce(*[F.when(F.contains(words, F.lit(f" {name} ")), F.lit(code)) for code, name in NETWORKS])


def effective_network(stored: Column, card_name: Column, issuer: Column) -> tuple[Column, Column]:
    """(network, conflict) of a card: as stored, as its name says, as its issuer implies; a conflict if two of them differ."""
    a, b = named_network(stored), named_network(card_name)
    c = F.when(F.lower(F.trim(issuer)) == "american express", F.lit("americanexpress"))
    own = F.coalesce(a, b)
    conflict = F.coalesce((a != b) | (own != c), F.coalesce(a != b, F.lit(False)) | F.coalesce(own != c, F.lit(False)))
    return F.when(~conflict, F.coalesce(own, c)), conflict


def decoded(component: Column) -> Column:
    """A url component with its escapes read and + as a blank; null if an escape is broken or its bytes are no UTF-8."""
    bad = component.rlike("%(?![0-9A-Fa-f]{2})")
    out = F.try_url_decode(F.when(~bad, component))
    return F.when(~F.contains(out, F.lit("�")) | F.contains(component, F.lit("�")), out)


def scoped_key(card_id: Column, condition_hash: Column) -> Column:
    return F.concat(F.lit("card-benefit-v2:"), F.lower(card_id.cast("string")), F.lit(":"), condition_hash)


def may_enqueue(issuer: Column, url: Column, url_hash: Column, bank: Column, card_url: Column, card_type: Column, discontinued: Column, held: Column, unresolved: Column) -> Column:
    """Whether a request for a card may be queued: its issuer, its one url and that url's hash are the catalogue's, it is a credit
    card that is still issued or held, and its identity is clear. What is missing counts against it."""
    one, other = T.canonical_url(url), T.canonical_url(card_url)
    same = lambda a, b: F.lower(F.trim(a)) == F.lower(F.trim(b))
    ok = F.length(F.trim(bank)).between(2, 120) & same(issuer, bank) & (F.lower(F.trim(card_type)) == "credit") & (one == other) & (F.lower(url_hash) == F.sha2(one, 256))
    return F.coalesce(ok & (~F.coalesce(discontinued, F.lit(False)) | F.coalesce(held, F.lit(False))) & ~unresolved, F.lit(False))


def sound_names(names: Column, most: int = 2, longest: int = 100) -> Column:
    """At most so many names, none of them null, blank or too long."""
    return (F.size(names) <= most) & F.forall(names, lambda n: n.isNotNull() & F.length(F.trim(n)).between(1, longest))


def safe_numbers(json: Column) -> Column:
    """Whether every number of a JSON text survives double precision: plain, at most six decimals, 2^53 without its point."""
    bare = F.regexp_replace(json, r'"(?:[^"\\\\]|\\\\.)*"', "")
    numbers = F.regexp_extract_all(bare, F.lit(r"(-?[0-9][0-9.eE+-]*)"), F.lit(1))

    def safe(t):
        short = F.regexp_replace(F.regexp_replace(t.try_cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", "")
        t = F.when(t.rlike("[eE]"), short).otherwise(t)  # in its plain form
        digits = F.regexp_replace(t, "[-.]", "").try_cast("decimal(38,0)")
        size = F.abs(t.try_cast("double"))
        return F.coalesce((size == 0) | (size >= 1e-6) & (size < 1e21) & t.rlike(r"^-?[0-9]+(\.[0-9]{1,6})?$") & (digits <= 9007199254740991), F.lit(False))

    return F.forall(numbers, safe)


def label_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def label_matches(labels: Column, query: Column) -> Column:
    """Whether some label holds the query, by words; an empty query fits all."""
    q = label_words(query)
    return (q == "") | F.exists(labels, lambda x: F.coalesce(F.contains(label_words(x), q), F.lit(False)))


def source_identity(url: Column) -> Column:
    """A digest that stands for an https source without showing it; null for what is no such url or may carry a secret."""
    u = F.trim(url)
    shape = r"^(?i)https://([a-z0-9.-]+(?::[0-9]+)?)(/[^?#\s]*)?(\?[^#\s]+)?$"
    host, path, query = (F.regexp_extract(u, shape, i) for i in (1, 2, 3))
    entries = F.when(query != "", F.split(F.substring(query, 2, 2048), "&", -1)).otherwise(F.array().cast("array<string>"))

    def sound(e):
        key, value = F.lower(F.substring_index(e, "=", 1)), F.substring(e, F.instr(e, "=") + 1, 2048)
        plain = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(decoded(value), F.lit("@")), "[_-]+", " "), " +", " "))
        secret = F.contains(plain, F.lit("@")) | F.contains(F.lower(value), F.lit("%25"))
        for w in SECRET_WORDS:
            secret = secret | F.contains(plain, F.lit(w))
        return F.contains(e, F.lit("=")) & key.isin(*SOURCE_KEYS) & (F.length(value) <= 512) & plain.rlike(r"^[a-z0-9 .~/]+$") & ~secret & (F.length(F.regexp_replace(plain, "[^0-9]", "")) < 10)

    bare = F.when((path == "") | (path == "/"), F.when(query != "", F.lit("/")).otherwise(F.lit(""))).otherwise(path)
    one = F.regexp_replace(F.concat(F.lit("https://"), F.regexp_replace(F.lower(host), ":443$", ""), bare, query), "/$", "")
    ok = F.length(u).between(9, 2048) & u.rlike(shape) & (F.size(entries) <= 8) & F.forall(entries, sound)
    return F.when(ok, F.sha2(one, 256))


def product_part(html: Column, name: Column) -> Column:
    """A page without its header, navigation and the like; of it the first main section that has all words of the name, if one has."""
    roles = "banner|navigation|contentinfo|complementary"
    cleaned = html
    for _ in range(2):  # parts within parts
        for tag in CHROME:
            cleaned = F.regexp_replace(cleaned, rf"(?is)<{tag}\b[^>]*>(?:(?!<{tag}\b).)*?</{tag}\s*>", " ")
        cleaned = F.regexp_replace(cleaned, rf"""(?is)<([a-z][a-z0-9]*)\b[^>]*\brole\s*=\s*["']?(?:{roles})["']?[^>]*>.*?</\1\s*>""", " ")
    mains = F.regexp_extract_all(cleaned, F.lit(r"(?is)(<main\b[^>]*>.*?</main\s*>)"), F.lit(1))
    wanted = T.product_tokens(name)
    own = F.filter(mains, lambda m: F.size(F.array_except(wanted, T.product_tokens(T.page_text(m)))) == 0)
    return F.when(F.size(wanted) == 0, cleaned).otherwise(F.coalesce(F.get(own, F.lit(0)), cleaned))


#: Words before a person, and words behind one.
PERSON_CUES, PERSON_VERBS, MOST_NAMES = ("for", "to"), ("is", "get", "gets", "receive", "receives", "will"), 4


def names_person(text: Column, known: Column) -> Column:
    """Whether a text speaks of a person: of one to four words of letters between a cue and a verb, a stop or the end, that are not
    all words of cards, nor a phrase known."""
    clauses = F.transform(F.split(F.lower(text), "[.,;:!?]"), lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != ""))

    def phrase(words, i):
        rest = F.slice(words, i + 2, F.lit(MOST_NAMES + 1))
        verb = F.array_min(F.filter(F.transform(rest, lambda w, j: F.when(w.isin(*PERSON_VERBS), j)), lambda j: j.isNotNull()))
        own = F.when(verb.isNull(), rest).otherwise(F.slice(rest, F.lit(1), verb))
        return F.when(F.get(words, i).isin(*PERSON_CUES) & F.size(own).between(1, MOST_NAMES), own)

    found = F.filter(F.flatten(F.transform(clauses, lambda words: F.transform(words, lambda _, i: phrase(words, i)))), lambda p: p.isNotNull())

    def person(words):
        named = F.forall(words, lambda w: w.rlike(r"^\p{L}[\p{L}\p{M}'-]+$"))
        return named & ~F.array_contains(known, F.array_join(words, " ")) & F.exists(words, lambda w: ~w.isin(*NO_PERSON))

    return F.coalesce(F.exists(found, person), F.lit(True))


def healed(text: Column) -> Column:
    """The JSON in a model's answer: from its first bracket on; a list that was cut ends behind its last whole object, an object
    that was cut gets the braces it lacks."""
    t = F.regexp_extract(F.trim(text), r"(?s)([\[{].*)$", 1)
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    upto = F.regexp_extract(t, r"(?s)^(.*\})", 1)
    array = F.when(t.endswith("]"), t).otherwise(F.concat(F.regexp_replace(F.when(upto != "", upto).otherwise(t), r",\s*$", ""), F.lit("]")))
    lacking = F.greatest(count("{") - count("}"), F.lit(0))
    return F.when(t.startswith("["), array).when(t.startswith("{") & ~t.endswith("}"), F.concat(t, F.repeat(F.lit("}"), lacking))).otherwise(F.when(t == "", F.trim(text)).otherwise(t))


def offer_subject(category: Column, kind: Column, excerpt: Column) -> Column:
    """category:kind:qualifier of an offer, from the words of its excerpt before any limitation."""
    limits = "|".join(LIMITING)
    text = F.concat(F.lit(" "), F.regexp_replace(F.replace(F.lower(excerpt), F.lit("online/offline"), F.lit("general")), rf"(?s)\b(?:{limits})\b.*$", ""), F.lit(" "))
    place = lambda w: F.regexp_instr(text, F.lit(rf"\b{w}\b"))
    lounge = F.when(text.rlike(r"\bdomestic\b|\b(in|across) india\b"), F.lit("domestic")).when(text.rlike(r"\b(international|global)\b"), F.lit("international")).otherwise(F.lit("general"))
    insured = F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w.replace(" ", "_"))) for w in INSURED], F.lit("general"))
    first = F.array_min(F.filter(F.array(*[F.struct(place(w).alias("at"), F.lit(i).alias("i"), F.lit(CALLED.get(w, w)).alias("w")) for i, w in enumerate(SUBJECTS)]), lambda x: x["at"] > 0))["w"]
    qualifier = F.when(kind == "lounge_access", lounge).when(category == "insurance", insured).when(category.isin("cashback", "points", "miles"), F.coalesce(first, F.lit("general"))).when(category == "entertainment", F.lit("movie_tickets")).otherwise(F.lit("general"))
    return F.concat_ws(":", F.when(category == "points", F.lit("rewards")).otherwise(category), F.coalesce(kind, F.lit("benefit")), qualifier)


def statement_dates(model: Column, found: Column, received: Column, due: Column) -> tuple[Column, Column]:
    """(statement date, due date): the model's, else the one in the text, else the day the mail came; twenty days later if none is due."""
    day = F.coalesce(model, found, received)
    return day, F.coalesce(due, F.date_add(day, 20))


def merged_json(old: Column, new: Column) -> Column:
    """A JSON object of texts with the members of a map put in; what the map has counts."""
    had = F.coalesce(F.from_json(old, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(had, lambda k, _: ~F.map_contains_key(new, k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, new)))))


#: How sure a judge must be to decide.
LEAST_CONFIDENCE = 0.7


def recommendation_verdict(baseline: Column, candidate: Column, rubric: Column, schema: Column, severe: Column, winner: Column, confidence: Column) -> dict[str, Column]:
    """passed, regression, severe_regression, requires_review. The judge (winner "baseline" or "candidate", confidence) is heard only
    if rubric, schema and candidate hold."""
    heard = rubric & schema & candidate & winner.isNotNull() & confidence.isNotNull()
    sure = heard & (confidence >= LEAST_CONFIDENCE)
    broken, judged = baseline & ~candidate, F.coalesce(sure & (winner == "baseline"), F.lit(False))
    chosen = F.coalesce(sure & (winner == "candidate"), F.lit(False))
    return {"passed": candidate & ~judged, "regression": broken | judged, "severe_regression": broken & severe, "requires_review": ~(rubric & schema & candidate & chosen)}


# ---------------------------------------------------------------- statements and summaries

#: Words with which a statement's small print begins, and from which character on it may be cut.
SMALL_PRINT = (
    "most important terms & conditions", "most important terms and conditions", "mitc", "important information for cardholders", "important information", "rights of cardholder", "cardholder agreement", "dispute redressal", "grievance redressal", "branch addresses", "list of branches",
)
KEPT_CHARS = 3500
#: Merchants that tell a line of purchases.
PURCHASED_AT = ("swiggy", "zomato", "amazon", "flipkart", "uber", "ola", "petrol", "payment received", "paytm", "gpay", "phonepe", "netflix", "spotify", "interest charged", "finance charge")


def states_purchase(line: Column) -> Column:
    """Whether a line of 15 to 200 characters has an amount, and a date or a merchant."""
    low = F.lower(F.trim(line))
    amount = low.rlike(r"(₹|\brs\b\.?|\binr\b) *[0-9]") | low.rlike(r"\b[0-9,]+\.[0-9]{2} *(cr|dr|c|d)\b")
    date = low.rlike(r"\b[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2,4}\b") | low.rlike(r"\b[0-9]{2} +(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* +[0-9]{2,4}\b")
    return F.length(low).between(15, 200) & amount & (date | low.rlike("|".join(PURCHASED_AT)))


def pruned(text: Column) -> Column:
    """A statement without its small print: cut at the first of its words behind KEPT_CHARS characters after which no purchase comes."""
    words = "|".join(w.replace("&", "\\&") for w in SMALL_PRINT)

    def purchased(lines):
        """Characters up to the end of the last purchase."""
        last = F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(states_purchase(x), i)), lambda i: i.isNotNull()))
        return F.length(F.array_join(F.slice(lines, F.lit(1), last + 1), "\n"))

    def cut(t):
        start = F.greatest(F.lit(KEPT_CHARS + 1), F.coalesce(once(F.split(t, "\n", -1), purchased), F.lit(0)))
        found = once(start, lambda s: F.struct(s.alias("start"), F.regexp_instr(F.lower(F.substring(t, s + 1, F.length(t))), F.lit(words)).alias("at")))
        return once(found, lambda f: F.when(f["at"] > 0, F.substring(t, F.lit(1), f["start"] + f["at"] - 1)).otherwise(t))

    return once(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\n+", "\n"), " {2,}", " "), r"^\s+|\s+$", ""), cut)


#: Members that a run's summary may keep, by what they must be.
SUMMARY = {
    "flag": ("reused_staging", "material_proposal", "successful_no_change", "crawl_complete", "raw_body_stored", "evidence_passed", "idempotency_passed", "retry_scheduled", "lease_expired", "pilot_qualified"),
    "count": ("source_documents", "proposals", "additions", "modifications", "possible_removals", "retirement_eligible_removals", "suppressed_removal_count", "conflicts", "unsafe_mutation_count", "approved_count", "retired_count", "rejected_count", "retained_count"),
    "digest": ("source_manifest_hash", "canonical_benefit_hash"), "id": ("run_id",), "word": ("quarantine_reason",), "disposition": ("proposal_disposition",), "review": ("review_status",),
}
#: Members that an attempt at a source may keep.
ATTEMPT = {"flag": ("required",), "count": ("http_status", "redirect_count", "content_length"), "digest": ("content_hash", "resource_identity_hash"), "word": ("status", "error_code", "role")}
#: What a member must look like: its type in JSON and its text.
KINDS = {
    "flag": ("BOOLEAN", "true|false"), "count": ("BIGINT", "[0-9]{1,9}"), "digest": ("STRING", "[0-9a-f]{64}"), "id": ("STRING", "[0-9a-f-]{1,64}"), "word": ("STRING", "[a-z0-9_]{1,64}"),
    "disposition": ("STRING", "material|removal_review|no_change|incomplete"), "review": ("STRING", "approved|rejected"),
}


def sanitised(json: Column, members: dict[str, tuple[str, ...]]) -> Column:
    """The JSON object with those members alone that are allowed and look as they must, in order of their names."""

    def of(v):
        kept = []
        for name, kind in sorted((n, k) for k, names in members.items() for n in names):
            type_, shape = KINDS[kind]
            own = F.try_variant_get(v, f"$.{name}", "variant")
            text = F.try_variant_get(v, f"$.{name}", "string")
            ok = (F.schema_of_variant(own) == type_) & text.rlike(f"^(?:{shape})$")
            kept.append(F.when(ok, F.concat(F.lit(f'"{name}":'), F.concat(F.lit('"'), text, F.lit('"')) if type_ == "STRING" else text)))
        return F.concat(F.lit("{"), F.concat_ws(",", *kept), F.lit("}"))

    return once(F.try_parse_json(json), of)
