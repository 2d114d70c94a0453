"""Crawl bookkeeping and work queues: completeness, retirement, histories, claims, rotation, page kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardloom.operators.cards import latest_by

KEPT = 24


def newest_per_key(df: DataFrame, group: str, key: str, at: str, *tie: str, most: int = KEPT) -> DataFrame:
    """For each group the newest row of each key, and of these the newest most. A group keeps most rows, so its history is short."""
    rest = [c for c in df.columns if c not in (group, key)]
    once = df.groupBy(group, key).agg(F.max(F.struct(at, *[c for c in tie if c != key], *[c for c in rest if c not in (at, *tie)])).alias("_row"))
    once = once.select(group, key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(at), key))
    return once.withColumn("place", place).where(F.col("place") <= most)


def terminal_attempts(attempts: DataFrame, group: str) -> DataFrame:
    """The last attempt of each source; null status where two attempts share an instant, as then none is last."""
    last = latest_by(attempts, group, "attempted_at", "page_id")
    clear = attempts.groupBy(group).agg((F.count("*") == F.count_distinct("attempted_at")).alias("clear"))
    return last.join(clear, group).withColumn("status", F.when(F.col("clear"), F.col("status")))


def retirement(observed: DataFrame, key: str, end: Column, now: str) -> DataFrame:
    """(key, eligible, reason) from complete absences (key, observed_at, end_date): a past end date, or two absences seven days apart."""
    today = F.lit(now).cast("date")
    seen = observed.groupBy(key).agg(F.max(end).alias("end"), F.count_distinct("observed_at").alias("n"), F.min("observed_at").alias("first"), F.max("observed_at").alias("last"))
    wide = (F.col("n") >= 2) & (F.col("last") >= F.col("first") + F.expr("INTERVAL '7' DAY"))
    reason = (
        F.when(F.col("end") < today, F.lit("explicit_past_end_date")).when(F.col("end").isNotNull(), F.lit("explicit_end_date_not_past"))
        .when(F.col("last") > F.lit(now).cast("timestamp_ntz"), F.lit("invalid_observation_history")).when(wide, F.lit("two_complete_observations")).otherwise(F.lit("insufficient_complete_observations"))
    )
    return seen.select(key, reason.isin("explicit_past_end_date", "two_complete_observations").alias("eligible"), reason.alias("reason"))


def expired_leases(jobs: DataFrame, now: str) -> DataFrame:
    """What becomes of leases that ran out: staged work stays staged, a third attempt goes to review, others are tried again."""
    clock = F.lit(now).cast("timestamp_ntz")
    late = jobs.where((F.col("status") == "leased") & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= clock)))
    status = F.when(F.col("staging_id").isNotNull(), F.lit("staged")).when(F.col("attempt_count") >= 3, F.lit("review_required")).otherwise(F.lit("failed"))
    wait = F.when(F.col("attempt_count") == 1, F.expr("INTERVAL '15' MINUTE")).otherwise(F.expr("INTERVAL '60' MINUTE"))
    return late.select("id", status.alias("status"), F.when(status == "failed", clock + wait).alias("next_retry_at"))


def claimable(jobs: DataFrame, run_mode: str, parser: str) -> DataFrame:
    """(key, issuer, busy_until, first): each issuer's last lease of the parser and the first job that could be claimed of it."""
    mine = jobs.where(F.col("parser_version") == parser).withColumn("key", F.lower(F.trim("issuer")))
    waits = F.col("status").isin("queued", "failed") & (F.col("run_mode") == run_mode)
    return mine.groupBy("key").agg(F.max(F.when(F.col("status") == "leased", F.col("lease_expires_at"))).alias("busy_until"), F.min(F.when(waits, F.struct("card_name", "created_at", "id", "issuer"))).alias("first"))


def claim_plan(jobs: DataFrame, now: str, run_mode: str, parser: str) -> DataFrame:
    """The one job to claim: first issuer without a live lease, then card, age and id."""
    clock = F.lit(now).cast("timestamp_ntz")
    free = claimable(jobs, run_mode, parser).where(F.col("first").isNotNull() & (F.col("busy_until").isNull() | (F.col("busy_until") <= clock)))
    return free.orderBy("key").limit(1).select("first.id", "first.issuer", "first.card_name")


def claim_timeline(jobs: DataFrame, run_mode: str, parser: str) -> DataFrame:
    """(moment, id, issuer, card_name): the job to claim at each moment at which an issuer's last lease ends, were none claimed before.

    One pass groups the jobs to a row an issuer; the window runs over those.
    """
    rows = claimable(jobs, run_mode, parser).withColumn("since", F.coalesce("busy_until", F.lit("0001-01-01").cast("timestamp_ntz")))
    free = Window.orderBy("since").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.min(F.when(F.col("first").isNotNull(), F.struct("key", "first"))).over(free)
    return rows.withColumn("best", best).where("busy_until IS NOT NULL").select(F.col("busy_until").alias("moment"), "best.first.id", "best.first.issuer", "best.first.card_name").distinct()


def rotation(candidates: DataFrame, slot: int) -> DataFrame:
    """One candidate a day, in turn: issuers in order, each with its least url."""
    one = candidates.groupBy("issuer").agg(F.min("url").alias("url"))
    turn = F.row_number().over(Window.orderBy("issuer")) - 1  # a row for each issuer
    numbered = one.withColumns({"turn": turn, "n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    return numbered.where(F.col("turn") == F.lit(slot) % F.col("n")).select("issuer", "url")


#: The profiles of a pilot, and the one that needs no approved url.
PROFILES = ("straightforward", "redirect_or_js", "terms_linked", "known_invalid", "additional_valid")
WITHOUT_URL = "known_invalid"


def first_choice(short: list[list[tuple[int, str]]], least: int) -> list[int] | None:
    """The first combination, in order of ids, of one (id, issuer) of each list with unlike ids and least issuers."""

    def search(i: int, ids: list[int], issuers: frozenset) -> list[int] | None:
        if len(issuers) + len(short) - i < least:
            return None
        if i == len(short):
            return ids
        for x, issuer in short[i]:
            if x not in ids and (found := search(i + 1, [*ids, x], issuers | {issuer})):
                return found
        return None

    return search(0, [], frozenset())


def pilot(candidates: DataFrame, profiles: tuple[str, ...] = PROFILES, least: int = 3) -> DataFrame:
    """(id0, id1, ...): the first combination, in order of ids, of one candidate for each profile with at least that many
    issuers; no row if there is none. candidates: (id, issuer, profile, active, approved).

    Given the choices for the other profiles, the one for a profile is the least id that they do not use and, if they have
    one issuer too few, of none of theirs. They use less than n ids and hold back less than ``least`` issuers; so of each
    issuer the first n ids of a profile suffice, and of these the first n * least. The search sees that many rows in all.
    """
    n = len(profiles)
    fits = F.col("profile").isin(*profiles) & F.col("active") & (F.col("approved") | (F.col("profile") == WITHOUT_URL))
    rows = candidates.where(fits).select("profile", "id", F.lower(F.trim("issuer")).alias("issuer")).distinct()
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("profile", "issuer").orderBy("id"))).where(F.col("n") <= n)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("profile").orderBy("id", "issuer"))).where(F.col("n") <= n * least)
    names = [f"id{i}" for i in range(n)]

    def choose(frame):
        import pandas as pd

        short = [sorted(zip(own["id"].tolist(), own["issuer"])) for p in profiles for own in [frame[frame["profile"] == p]]]
        found = first_choice(short, least)
        return pd.DataFrame([found] if found else [], columns=names)

    return rows.groupBy().applyInPandas(choose, ", ".join(f"{c} long" for c in names))


# ---------------------------------------------------------------- kinds of page

#: What urls and texts of each kind of page hold.
UNSAFE = r"(?i)(login|sign-?in|careers|stories|track-your|useful-links|press)"
PRODUCT = r"(?i)(credit[ -]?cards?|apply now|card benefits)"
SUPPORTING = r"(?i)(terms|fees|charges|conditions|faq|guide)"


def url_score(url: Column, tokens: list[str]) -> Column:
    """A hundred for each word of the product in the url, a thousand more for all, less for length."""
    hits = sum((F.contains(F.lower(url), F.lit(t)).cast("int") for t in tokens), F.lit(0))
    return hits * 100 + F.when(hits == len(tokens), 1000).otherwise(0) - F.length(url) / 1000


def field_changes(existing: DataFrame, proposed: DataFrame, key: str) -> DataFrame:
    """(key, field, change): a proposed field of confidence 0.9 and more fills a hole or conflicts with what is there."""
    joined = proposed.where("confidence >= 0.9").join(existing, [key, "field"], "left")
    had = F.coalesce("existing", F.lit(""))
    change = F.when(had == "", F.lit("backfill")).when(F.lower(had) != F.lower("value"), F.lit("conflict"))
    return joined.select(key, "field", change.alias("change")).where("change IS NOT NULL")


# ---------------------------------------------------------------- offers in text


def offer_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, kind, value) of each line that states an offer: the first of an ordered list of patterns that it fits.

    A line of its own is read with native expressions; nothing of a document but its lines moves.
    """
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    amount = r"(?:rs\.?|inr|₹)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
    patterns = (
        ("cashback", r"(?i)([0-9]+(?:\.[0-9]+)?)\s*%\s*cash\s*back"), ("fee_waiver", rf"(?i)fee\s+waive[rd][^0-9]*{amount}"), ("points", r"(?i)([0-9]+(?:\.[0-9]+)?)x?\s*(?:reward\s+)?points"),
        ("discount", r"(?i)([0-9]+(?:\.[0-9]+)?)\s*%\s*(?:off|discount)"), ("cap", rf"(?i)(?:up\s+to|maximum(?:\s+of)?|capped\s+at)\s*{amount}"), ("licence", r"(?i)licen[sc]ed\s+under\s+(?:the\s+)?([a-z-]+)"),
    )
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, p in reversed(patterns):
        kind, value = F.when(F.col("line").rlike(p), F.lit(name)).otherwise(kind), F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)).otherwise(value)
    return lines.select(id_col, "line_no", kind.alias("kind"), value.alias("value")).where("kind IS NOT NULL")


#: What blocks a pilot's jobs from being promoted, and the flag of a job that must hold.
PILOT_FLAGS = {
    "pilot_safety_metadata_invalid": "safety_valid", "pilot_computed_evidence_invalid": "evidence_valid", "deterministic_replay_failed": "replay_passed", "side_effect_proof_failed": "side_effects_passed", "pilot_crawl_incomplete": "crawl_complete", "pilot_source_mismatch": "source_valid",
}
#: The same for counts that must be zero.
PILOT_COUNTS = {"pilot_suppressed_removals": "suppressed", "pilot_conflict_unresolved": "conflicts", "unsafe_mutation": "unsafe"}


def pilot_gate(jobs: DataFrame, group: str, profiles: tuple[str, ...] = PROFILES, least: int = 3) -> DataFrame:
    """(group, status, blockers) of each pilot: not started, running while too few jobs are in it, blocked with its reasons, or passed.

    jobs: (group, promoted, profile, issuer, the flags and counts): jobs of pilots, promoted or not.
    """
    n = len(profiles)
    bad = {name: F.max(~F.coalesce(F.col(c), F.lit(False))) for name, c in PILOT_FLAGS.items()} | {name: F.max(F.coalesce(F.col(c), F.lit(-1)) != 0) for name, c in PILOT_COUNTS.items()}
    known = F.col("profile").isin(*profiles)
    issuer = F.when(F.trim("issuer") != "", F.lower(F.trim("issuer")))
    seen = jobs.groupBy(group).agg(
        F.count("*").alias("jobs"), F.count_if("promoted").alias("promoted"), F.count_if(known).alias("known"), F.count_distinct(F.when(known, F.col("profile"))).alias("profiles"), F.count_distinct(issuer).alias("issuers"), *[c.alias(name) for name, c in bad.items()])
    cohort = [F.when((F.col("jobs") != n) | (F.col("known") != n) | (F.col("profiles") != n), F.lit("pilot_profile_coverage")), F.when(F.col("issuers") < least, F.lit("pilot_issuer_diversity"))]
    reasons = F.array_compact(F.array(*cohort, *[F.when(F.col(name), F.lit(name)) for name in bad]))
    one = lambda x: F.array(F.lit(x))
    handed = (F.col("promoted") == n) & (F.col("jobs") == n)
    blockers = F.when(F.col("jobs") == 0, one("pilot_not_started")).when(F.col("jobs") < n, one("pilot_incomplete")).when((F.col("promoted") > 0) & ~handed, one("pilot_job_count")).otherwise(reasons)
    status = F.when(F.col("jobs") == 0, F.lit("not_started")).when(F.col("jobs") < n, F.lit("running")).when((F.col("promoted") > 0) & ~handed, F.lit("blocked")).when(F.size(reasons) > 0, F.lit("blocked")).otherwise(F.lit("passed"))
    return seen.select(group, status.alias("status"), F.array_join(blockers, ",").alias("blockers"))


#: Failures of a supporting source that leave a crawl open.
FALLBACK_FAILURES = ("corrupt_pdf", "empty_shell", "challenge_page", "js_challenge", "identity_mismatch", "identity_ambiguous", "unapproved_query", "invalid_source_url")


def crawl_reason(attempts: DataFrame, crawl: str, most: int = KEPT) -> DataFrame:
    """(crawl, complete, reason) from attempts (crawl, role, source_key, status, http_status, error_code, identity, attempted_at, page_id).

    The first reason that holds, in this order: a source with two final identities, one with too long a history, no primary source
    or several, an unsuccessful primary one, the failure of a supporting one (the first by key) that must be followed up, an
    unsuccessful required one. A source's last attempt counts; two at its last instant are none.
    """
    key = [crawl, "role", "source_key"]
    per = attempts.groupBy(*key).agg(F.count_distinct("identity").alias("identities"), F.count("*").alias("n"), F.max_by(F.struct("status", "http_status", "error_code"), F.struct("attempted_at", "page_id")).alias("last"), F.max("attempted_at").alias("at"))
    ties = attempts.groupBy(*key, "attempted_at").agg(F.count("*").alias("same"))
    per = per.join(ties.withColumnRenamed("attempted_at", "at"), [*key, "at"]).withColumn("last", F.when(F.col("same") == 1, F.col("last")))
    ok = F.coalesce((F.col("last.status") == "fetched") & F.col("last.http_status").between(200, 299), F.lit(False))
    role = lambda r: F.col("role") == r
    failed = role("supporting") & (F.col("last.status") == "failed") & F.col("last.error_code").isin(*FALLBACK_FAILURES)
    seen = per.groupBy(crawl).agg(
        F.max("identities").alias("identities"), F.max("n").alias("n"), F.count_if(role("primary")).alias("primaries"), F.count_if(role("primary") & ok).alias("fetched"),
        F.min_by(F.when(failed, F.col("last.error_code")), F.when(failed, F.col("source_key"))).alias("fallback"), F.count_if(role("required_supporting") & ~ok).alias("lacking"))
    reason = (
        F.when(F.col("identities") > 1, F.lit("final_resource_identity_conflict")).when(F.col("n") > most, F.lit("attempt_history_overflow")).when(F.col("primaries") == 0, F.lit("missing_primary")).when(F.col("primaries") > 1, F.lit("multiple_primary"))
        .when(F.col("fetched") == 0, F.lit("primary_incomplete")).when(F.col("fallback").isNotNull(), F.col("fallback")).when(F.col("lacking") > 0, F.lit("required_supporting_incomplete")).otherwise(F.lit("complete"))
    )
    return seen.select(crawl, (reason == "complete").alias("complete"), reason.alias("reason"))
